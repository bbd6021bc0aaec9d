"""Plumbing that the operators of this subpackage share.

Every intermediate table goes to the folder the cluster names in ``spark.checkpoint.dir``; a
lost executor costs at most the tasks it was running. Files that Spark has no writer for are
opened through ``pyarrow.fs``, which reaches local, HDFS, S3 and GCS folders alike.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: Folders made by :func:`scratch` that are still there, and the configuration that reaches them.
_made: dict[str, object] = {}
WORD_SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where driver and executors are one
    process and none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="discweave-"))
    return _own_dir[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made[path] = spark._jsc.hadoopConfiguration()
    return path


class Workspace:
    """The intermediate tables of one run. Those that the result no longer needs are dropped on
    the way, the others with the driver."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, scratch(spark, label)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage, runs the plan once."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """One table in a workspace of its own."""
    return Workspace(df.sparkSession, label).put(df, "t")


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def clean() -> None:
    """Delete every folder that :func:`scratch` named, where the JVM still answers."""
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    while jvm is not None and _made:
        path, conf = _made.popitem()
        try:
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(conf).delete(hadoop, True)
        except Exception:  # the gateway is gone; the folder outlives the driver
            return


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


def text_or_empty(col) -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


# --- deterministic range shards ------------------------------------------------------------

#: A table is cut into so many shards at most; beyond that the shards grow, not their number.
MOST_SHARDS = 1 << 14
SALTS = 1 << 16


@dataclass
class Shards:
    """``splits``: ascending (key, tie, salt) at which a shard begins; a null key is the last of all."""

    splits: list[tuple[int | None, int, int]]
    total: float

    def __len__(self) -> int:
        return len(self.splits) + 1


def plan_shards(df: DataFrame, key: str, weight, shard_weight: float, tie=None, salted: bool = False, per_shard: int = 40) -> Shards:
    """Cut ``df`` by (``key``, ``tie``) into shards of about ``shard_weight``.

    The split points come from the (key, tie) pairs whose hash falls into a fixed residue class
    and from all that weigh half a shard and more, so the same table gives the same shards in
    every run, however its files are split. At most ``per_shard`` pairs per shard, or 20,000,
    reach the driver, and there are ``MOST_SHARDS`` shards at most. With ``salted``, a pair heavier
    than that is itself cut by a salt of its rows (see :func:`shard_of`).
    """
    pairs = df.select(F.col(key).cast("long").alias("k"), (F.lit(0) if tie is None else tie).cast("long").alias("t"), (weight if not isinstance(weight, str) else F.col(weight)).alias("w"))
    sized = pairs.agg(F.sum("w").alias("w"), F.approx_count_distinct(F.xxhash64("k", "t")).alias("n")).first()
    total = float(sized["w"] or 0)
    shards = max(1, min(MOST_SHARDS, math.ceil(total / shard_weight)))
    if shards == 1:
        return Shards([], total)
    rate, heavy = max(1, sized["n"] // max(20_000, per_shard * shards)), total / shards / 2
    slim = pairs.groupBy("k", "t").agg(F.sum("w").alias("w"))
    found = slim.where((F.col("w") >= heavy) | (F.pmod(F.xxhash64("k", "t"), F.lit(rate)) == 0)).collect()
    sample = sorted((r["k"] is None, r["k"] or 0, r["t"], float(r["w"] or 0)) for r in found)
    weights = np.array([w if w >= heavy else w * rate for *_, w in sample])
    running = np.cumsum(weights)
    splits = set()
    for target in running[-1] * np.arange(1, shards) / shards if len(sample) else []:
        i = int(np.searchsorted(running, target, side="left"))
        none, k, t, w = sample[i]
        if salted and w >= heavy:
            splits.add((none, k, t, int((target - running[i] + weights[i]) / weights[i] * SALTS)))
        elif i + 1 < len(sample):
            splits.add((*sample[i + 1][:3], 0))
    return Shards([(None if none else k, t, s) for none, k, t, s in sorted(splits)], total)


def key_splits(df: DataFrame, key: str, weight, shard_weight: float) -> list[tuple[int | None, int, int]]:
    """The split points alone."""
    return plan_shards(df, key, weight, shard_weight).splits


def rank(points: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """For each row how many points are at or below it; both are columns, the first weighs most."""
    low = np.searchsorted(points[0], rows[0], side="left")
    high = np.searchsorted(points[0], rows[0], side="right")
    if len(points) == 1:
        return high
    out, tied = low.copy(), high > low
    for at in np.unique(low[tied]):
        here = tied & (low == at)
        end = int(high[here][0])
        out[here] = at + rank([p[at:end] for p in points[1:]], [r[here] for r in rows[1:]])
    return out


def row_salt() -> F.Column:
    """A number under ``SALTS`` for each row. It tells rows apart that are alike, nothing else."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))


def shard_of(shards: Shards, key: F.Column, tie: F.Column | None = None, salt: F.Column | None = None) -> F.Column:
    """The shard number of each row: how many split points are at or below it."""
    points = [np.array([k is None for k, _, _ in shards.splits], np.int64), *(np.array([p[i] or 0 for p in shards.splits], np.int64) for i in range(3))]

    @F.arrow_udf("int")
    def shard(keys: pa.Array, ties: pa.Array, salts: pa.Array) -> pa.Array:
        none = keys.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.fill_null(keys.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        columns = [none, known, ties.cast(pa.int64()).to_numpy(zero_copy_only=False), salts.cast(pa.int64()).to_numpy(zero_copy_only=False)]
        return pa.array(rank(points, columns).astype(np.int32))

    zero = F.lit(0).cast("long")
    return shard(key.cast("long"), zero if tie is None else tie, zero if salt is None else salt)


# --- a filter of bounded size ----------------------------------------------------------------

#: 64-bit words of 16 bits a key, but no more than a million of them, are what is broadcast.
MOST_BITS = 1 << 26


def filter_bits(keys: int) -> int | None:
    """Bits for a filter of so many keys; None where the largest one would let most rows through."""
    return max(1 << 16, min(MOST_BITS, 1 << (16 * keys).bit_length())) if keys <= MOST_BITS else None


def with_filter(df: DataFrame, key: F.Column, keys: DataFrame, column: str, bits: int | None = None, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``keys[column]``, by a broadcast bitmap.

    The bitmap is sized by the number of keys unless ``bits`` says otherwise, up to ``MOST_BITS``:
    a million rows of 12 bytes. Beyond that there is no filter: all rows may be in. It lets more
    rows through, never fewer; callers join exactly afterwards. ``keep`` False gives the other
    rows, none of which is in ``keys``. A null key is in no filter.
    """
    bits = filter_bits(keys.count()) if bits is None else bits
    if bits is None:
        return df if keep else df.where("false")
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits)).cast("int")
    words = (
        keys.select(place(F.col(column)).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, pmod(p, 64)))").alias("_bits"))
    )
    marked = df.withColumn("_place", place(key)).withColumn("_word", F.shiftright("_place", 6))
    bit = F.expr("shiftright(_bits, pmod(_place, 64)) & 1 = 1")
    if keep:
        hit = marked.join(F.broadcast(words), "_word").where(bit)
    else:
        hit = marked.join(F.broadcast(words), "_word", "left").where(~F.coalesce(bit, F.lit(False)))
    return hit.drop("_word", "_bits", "_place")


def keep_rows(docs: DataFrame, key: F.Column, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (key, kept) does not drop.

    Rows whose key is in no drop decision stay where they are; the others meet the kept keys
    in a join, so only their texts move. Of rows that share a key of which some row is kept
    and some is dropped, one stays: that with the least hash of all its columns. Callers put
    into the key all that a decision hangs on, so such rows differ in other columns at most.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), key.alias("_key"))
    dropped, kept = decisions.where("not kept").select("key"), decisions.where("kept").select(F.col("key").alias("_key")).distinct()
    bits = filter_bits(dropped.count())
    if bits is None:
        sure, maybe = packed.where("false"), packed
    else:
        sure, maybe = (with_filter(packed, F.col("_key"), dropped, "key", bits, keep) for keep in (False, True))
    tied = decisions.groupBy("key").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all")).where("some and not all").select(F.col("key").alias("_key"))
    tied = materialize(tied, "tied")
    if tied.isEmpty():
        return sure.select("_row.*").unionByName(maybe.join(kept, "_key", "left_semi").select("_row.*"))
    lone = maybe.join(tied, "_key", "left_anti").join(kept, "_key", "left_semi")
    again = maybe.join(tied, "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return sure.select("_row.*").unionByName(lone.select("_row.*")).unionByName(again.select("_row.*"))
