"""Order-insensitive comparison of a Spark result with DuckDB SQL over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def cell(v) -> str:
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if v != v else format(round(v, 6) + 0.0, ".6f")
    if hasattr(v, "tolist"):
        v = v.tolist()
    return "[" + ",".join(map(cell, v)) + "]" if isinstance(v, list) else str(v)


def canonical(arrow) -> tuple[list[str], list[tuple]]:
    frame = arrow.to_pandas(integer_object_nulls=True)
    names = sorted(frame.columns)
    return names, sorted(tuple(map(cell, r)) for r in frame[names].itertuples(index=False))


def duck(connection, sql: str):
    found = connection.sql(sql).arrow()
    return found.read_all() if hasattr(found, "read_all") else found
