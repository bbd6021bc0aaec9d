"""Writing and reading file formats that Spark has no writer for.

A task writes to a temporary name of its own, so retried and speculative attempts never meet;
it reports the file in a row, and only rows of attempts that succeeded reach the driver. Tasks
then give those files their final names, which may be done again without harm. The driver
writes the manifest, again by way of a temporary name, and deletes what other attempts left. A
reader trusts the manifest alone. Formats keep the number of files within ``MOST_FILES``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession

from discweave.llm.common import open_fs

MANIFEST = "manifest.json"
#: Rows that :func:`commit` takes to the driver at most; writers let files grow to stay within it.
MOST_FILES = 1 << 16


class Sink:
    """One file under a temporary name; ``size`` counts the bytes written."""

    def __init__(self, folder: str, name: str):
        self.name, self.temporary, self.size = name, f"_temporary/{name}.{uuid.uuid4().hex}", 0
        self.fs, base = open_fs(folder)
        self.fs.create_dir(f"{base}/_temporary", recursive=True)
        self.stream = self.fs.open_output_stream(f"{base}/{self.temporary}", compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def commit(written: DataFrame, folder: str, order: list[str]) -> list[dict]:
    """Run the writing plan ``written`` and publish its files; returns the manifest's entries.

    ``written`` has a row per file with name, temporary and whatever the format records about
    it; there are ``MOST_FILES`` at most. The files are renamed in tasks.
    """
    files = sorted((row.asDict() for row in written.collect()), key=lambda f: tuple(f[k] for k in order))
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)
    if files:
        names = written.sparkSession.createDataFrame([(f.pop("temporary"), f["name"]) for f in files], "temporary string, name string")
        moved = names.repartition(min(256, 1 + len(files) // 16)).mapInArrow(mover(folder), "name string").count()
        if moved != len(files):
            raise RuntimeError(f"{len(files) - moved} files were not published")
    with fs.open_output_stream(f"{base}/{MANIFEST}.tmp", compression=None) as out:
        out.write(json.dumps({"files": files}, sort_keys=True).encode())
    fs.move(f"{base}/{MANIFEST}.tmp", f"{base}/{MANIFEST}")
    if fs.get_file_info(f"{base}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{base}/_temporary")
    return files


def mover(folder: str) -> Callable:
    def run(batches):
        fs, base = open_fs(folder)
        for batch in batches:
            for temporary, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{base}/{temporary}").type == pafs.FileType.File:
                    fs.move(f"{base}/{temporary}", f"{base}/{name}")
                elif fs.get_file_info(f"{base}/{name}").type != pafs.FileType.File:  # else moved by an earlier attempt
                    raise FileNotFoundError(f"{folder}/{temporary}")
            yield pa.RecordBatch.from_arrays([batch.column(1)], names=["name"])

    return run


def manifest(folder: str) -> list[dict]:
    fs, base = open_fs(folder)
    with fs.open_input_stream(f"{base}/{MANIFEST}", compression=None) as f:
        return json.loads(f.read())["files"]


def one_task_each(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A DataFrame with each row in a partition of its own."""
    if not rows:
        return spark.createDataFrame([], schema)
    numbered = spark.createDataFrame([Row(_task=i, **r) for i, r in enumerate(rows)], f"_task int, {schema}")
    return numbered.repartitionById(len(rows), numbered["_task"]).drop("_task")


def read_chunks(folder: str, name: str, size: int = 4 << 20) -> Iterator[bytes]:
    fs, base = open_fs(folder)
    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
        while data := f.read(size):
            yield data
