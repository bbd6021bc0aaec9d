"""A data source of sector-ranged reads: parts of large files without loading a file.

``spark.read.format("sectors").option("path", file).option("first", 0).option("last", 4095)``
gives (path, sector, data), 2048 bytes a row; ranges are split into partitions of ``per_task``
sectors, and a read never goes past the end of its file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from discweave.sources.bytes import SECTOR


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class SectorReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.first, self.last = int(options.get("first", 0)), options.get("last")
        self.per_task = int(options.get("per_task", 16_384))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            end = (os.path.getsize(path) + SECTOR - 1) // SECTOR - 1
            last = min(end, int(self.last)) if self.last is not None else end
            out += [Range(path, a, min(a + self.per_task - 1, last)) for a in range(self.first, last + 1, self.per_task)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            f.seek(part.first * SECTOR)
            for begin in range(part.first, part.last + 1, 1024):
                count = min(1024, part.last + 1 - begin)
                rows = [d for _ in range(count) if (d := f.read(SECTOR))]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows)), pa.array(range(begin, begin + len(rows)), pa.int64()), pa.array(rows, pa.binary())], names=["path", "sector", "data"])


class SectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sectors"

    def schema(self) -> str:
        return "path string, sector bigint, data binary"

    def reader(self, schema) -> SectorReader:
        return SectorReader(self.options)
