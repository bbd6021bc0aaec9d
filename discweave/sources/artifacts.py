"""Artefacts: strict JSON in, pretty JSON out, provenance and copies."""

from __future__ import annotations

import json
import os
import shutil
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


class ArtifactError(ValueError):
    pass


def unknown_fields(value, kind: DataType, at: str = "$") -> list[str]:
    """Paths of the fields of a JSON value that a type does not declare, at any depth."""
    if isinstance(kind, StructType) and isinstance(value, dict):
        out = [f"{at}.{k}" for k in value if k not in kind.names]
        return out + [p for f in kind.fields if f.name in value for p in unknown_fields(value[f.name], f.dataType, f"{at}.{f.name}")]
    if isinstance(kind, ArrayType) and isinstance(value, list):
        return [p for i, v in enumerate(value) for p in unknown_fields(v, kind.elementType, f"{at}[{i}]")]
    if isinstance(kind, MapType) and isinstance(value, dict):
        return [p for k, v in value.items() for p in unknown_fields(v, kind.valueType, f"{at}.{k}")]
    return []


def strict_json(rows: DataFrame, column: str, schema: StructType, out: str = "doc") -> DataFrame:
    """``out``: the parsed document and ``violations``: unknown top-level fields, or ``malformed``.

    A parser in fail-fast mode lets extra fields pass, so the keys are compared themselves.
    """
    keys = F.json_object_keys(column)
    extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, schema.names))))
    return rows.withColumn(out, F.from_json(column, schema)).withColumn("violations", F.when(keys.isNull(), F.array(F.lit("malformed"))).otherwise(extra))


def read_artifact(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON document as one row; unknown fields anywhere and malformed text raise."""
    with open(path, encoding="utf-8") as f:
        try:
            value = json.load(f)
        except ValueError as e:
            raise ArtifactError(f"{path}: {e}") from e
    if found := unknown_fields(value, schema):
        raise ArtifactError(f"{path}: unknown fields {', '.join(found)}")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_artifact(df: DataFrame, path: str) -> None:
    """The single row of ``df`` as an indented UTF-8 document, nulls kept."""
    rows = df.limit(2).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()
    if len(rows) != 1:
        raise ArtifactError(f"an artefact is one row, not {'none' if not rows else 'several'}")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(rows[0][0]), f, indent=2, ensure_ascii=False)
        f.write("\n")


def record_stage(spark: SparkSession, table_path: str, stage: str, started: datetime, inputs: list[str], outputs: list[str]) -> None:
    """Append a row to the table of stage runs."""
    now = datetime.now(UTC)
    row = [(stage, started.isoformat(), now.isoformat(), int((now - started).total_seconds() * 1000), inputs, outputs)]
    spark.createDataFrame(row, "stage string, started_at string, finished_at string, duration_ms long, inputs array<string>, outputs array<string>").write.mode("append").parquet(table_path)


def mirror_json(source: str, target: str) -> list[str]:
    """Copy every ``*.json`` below ``source`` to ``target`` under the same relative path."""
    copied = []
    for folder, _, names in sorted(os.walk(source)):
        for n in sorted(names):
            if n.endswith(".json"):
                relative = os.path.relpath(os.path.join(folder, n), source)
                os.makedirs(os.path.dirname(os.path.join(target, relative)), exist_ok=True)
                shutil.copyfile(os.path.join(source, relative), os.path.join(target, relative))
                copied.append(relative)
    return copied


def copy_range(parts: list[tuple[str, int, int]], target: str, chunk: int = 4 << 20) -> int:
    """Bytes [first, last] of each file, one after another, in chunks; returns how many."""
    total = 0
    with open(target, "wb") as out:
        for path, first, last in parts:
            with open(path, "rb") as f:
                f.seek(first)
                left = last - first + 1
                while left > 0 and (data := f.read(min(chunk, left))):
                    out.write(data)
                    left -= len(data)
                    total += len(data)
    return total


def rename_outputs(plan: list[tuple[str, str]], overwrite: bool) -> None:
    """Copy (source, target) pairs; a target that exists, or is named twice, fails unless allowed."""
    targets = [t for _, t in plan]
    taken = sorted({t for t in targets if targets.count(t) > 1} | {t for t in targets if os.path.exists(t)})
    if taken and not overwrite:
        raise ArtifactError(f"would overwrite {', '.join(taken)}")
    for source, target in plan:
        shutil.copyfile(source, target)


def inside(base: str, path: str) -> bool:
    root = os.path.realpath(base)
    return os.path.commonpath([root, os.path.realpath(path)]) == root


# --- schemas -------------------------------------------------------------------------------------

#: JSON Schema types of Spark types.
JSON_TYPES = {"string": "string", "boolean": "boolean", "double": "number", "float": "number", "int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer"}


def json_schema(kind: DataType, title: str | None = None) -> dict:
    """The JSON Schema of a type: objects refuse other fields and require those that are not null."""
    if isinstance(kind, StructType):
        fields = {f.name: json_schema(f.dataType) if not f.nullable else {"anyOf": [json_schema(f.dataType), {"type": "null"}]} for f in kind.fields}
        out = {"type": "object", "additionalProperties": False, "properties": fields, "required": [f.name for f in kind.fields if not f.nullable]}
    elif isinstance(kind, ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    elif isinstance(kind, MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    else:
        out = {"type": JSON_TYPES[kind.simpleString()]}
    return {"title": title, **out} if title else out


def write_schemas(kinds: dict[str, StructType], folder: str) -> list[str]:
    """A ``<name>.schema.json`` for every artefact type; returns the paths."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    for name, kind in sorted(kinds.items()):
        paths.append(os.path.join(folder, f"{name}.schema.json"))
        with open(paths[-1], "w", encoding="utf-8") as f:
            json.dump(json_schema(kind, name), f, indent=2, ensure_ascii=False)
    return paths


def shape(value):
    """The types of a JSON value: objects by key, a list by its first element."""
    if isinstance(value, dict):
        return {k: shape(v) for k, v in sorted(value.items())}
    if isinstance(value, list):
        return [shape(value[0])] if value else []
    names = ((bool, "bool"), (int, "int"), (float, "float"), (str, "str"), (type(None), "null"))
    return next(name for kind, name in names if isinstance(value, kind))


@F.arrow_udf(StringType())
def json_shape(documents: pa.Array) -> pa.Array:
    """:func:`shape` of JSON texts, as JSON; null for null and for what is no JSON."""
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(shape(json.loads(text)))
        except ValueError:
            return None

    return pa.array([one(t) for t in documents.to_pylist()], pa.string())
