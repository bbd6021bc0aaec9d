"""Exact deduplication by a log-structured merge index, in DataFrame operations throughout.

* Memtable and flush: the digests of the normalised texts are written as a log of rows. Every
  slice of it (a quarter of the scan's tasks) is one memtable: an entry a digest, which keeps
  the row that stays (the most code points, then the smallest identifier) and counts the rows.
  It is flushed as a run: a table bucketed by digest and sorted within each bucket.
* Compaction: runs are merged two by two, level by level, each merge a full outer sort-merge join
  of two runs bucket by bucket, without a shuffle. The merged run keeps the better row and the sum.
* Filter: a bitmap over the digests of the last run that occur more than once, sized by their
  number. The second pass over the texts probes it and leaves out nearly all documents that have
  no equal.
* Hits are verified byte by byte: what passes is grouped by the normalised text itself. Within
  a task equal texts collapse to one row before they are shuffled, so a hot text moves once per
  task however many copies it has. Should two texts share a digest, their documents are matched
  by text instead of by digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.llm.common import WORD_SEPARATORS, Workspace, keep_rows, materialize, text_or_empty, with_filter

#: Memtables, and so runs of the lowest level.
RUNS = 4


def normalised(text: F.Column) -> F.Column:
    return F.translate(text, WORD_SEPARATORS, "")


def text_digest(text: F.Column) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


#: What orders rows of one text: more code points, then the smaller identifier (null last); the
#: number the row got in the log settles what is left.
BEST = "named_struct('less', -n, 'none', id IS NULL, 'id', id, 'row', row)"


def compact(rows: DataFrame, *key: str) -> DataFrame:
    """One entry a digest: the row that stays and the number of rows."""
    return rows.groupBy(*key).agg(F.min(F.expr(BEST)).alias("best"), F.count("*").alias("size"))


def run_table(work: Workspace, entries: DataFrame, name: str) -> DataFrame:
    """``entries`` as a run: bucketed by digest as the shuffle deals it, sorted in every bucket."""
    spark = work.spark
    known = f"discweave_{name}_{uuid.uuid4().hex}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries.write.option("compression", "zstd").option("path", f"{work.path}/{name}").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(known)
    back = spark.table(known)
    spark.sql(f"DROP TABLE {known}")  # the name alone; the files are the workspace's
    return back


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """The entries of two runs as those of one."""
    right = right.select("digest", F.col("best").alias("other"), F.col("size").alias("more"))
    both = left.join(right, "digest", "full_outer")
    return both.select("digest", F.least("best", "other").alias("best"), (F.coalesce("size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("size"))


def index(work: Workspace, rows: DataFrame) -> DataFrame:
    """The entries of all rows (id, row, n, digest, run), by runs merged level by level."""
    level = [run_table(work, compact(rows.where(F.col("run") == r), "digest"), f"run_0_{r}") for r in range(RUNS)]
    depth = 0
    while len(level) > 1:
        depth += 1
        after = [run_table(work, merged(a, b), f"run_{depth}_{k}") for k, (a, b) in enumerate(zip(level[::2], level[1::2], strict=True))]
        work.drop(*[f"run_{depth - 1}_{k}" for k in range(len(level))])
        level = after
    return level[0]


def decide(rows: DataFrame, entries: DataFrame, *key: str) -> DataFrame:
    """Each row's group, from the entries of groups of two rows and more."""
    alone = F.col("best").isNull()
    return rows.join(entries, list(key), "left").select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("n").alias("n_chars"),
        "spelling",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=text_digest) -> DataFrame:
    """The group of equal texts of every row and which row stays.

    Texts are equal when the same after deleting white space ``[\\x20\\x09-\\x0D]``. Returns, per
    row, doc_id, keep_id, group_size, kept, text_sha256, n_chars and spelling (a hash of the text as
    it is). A null text is the empty text, and all empty texts are one group. Exactly one row of a
    group is kept, also where rows share an identifier. A null identifier loses to any other;
    where only such rows are tied, keep_id is null. Other columns are not read. An empty table
    gives no rows. ``digest`` maps a normalised text to its index key; any function gives right
    results, as hits are verified by bytes.
    """
    work = Workspace(docs.sparkSession, "exact")
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    row, body = F.monotonically_increasing_id(), normalised(F.col("text"))
    log = own.select("id", row.alias("row"), digest(body).alias("digest"), text_digest(body).alias("sha"), F.length("text").alias("n"), F.xxhash64("text").alias("spelling"))
    rows = work.put(log, "rows").withColumn("run", F.pmod(F.shiftright("row", 33), F.lit(RUNS)))
    entries = index(work, rows).where("size > 1")
    keyed = own.withColumn("body", body).withColumn("digest", digest(F.col("body")))
    hits = with_filter(keyed.select("digest", "body"), F.col("digest"), entries, "digest")
    texts = hits.groupBy("digest", "body").agg(F.count("*").alias("copies")).groupBy("digest").agg(F.count("*").alias("texts"), F.sum("copies").alias("copies"))
    verified = work.put(entries.join(texts, "digest", "left").withColumn("same", F.coalesce((F.col("texts") == 1) & (F.col("copies") == F.col("size")), F.lit(False))), "verified")
    apart = verified.where("not same").select("digest")
    same = verified.where("same").select("digest", "best", "size")
    if apart.isEmpty():
        return decide(rows, same, "digest")
    # Texts that share a digest: their documents are matched by the whole text instead.
    rest = keyed.join(apart, "digest", "left_semi").select("id", F.length("text").alias("n"), "body", text_digest(F.col("body")).alias("sha"), F.xxhash64("text").alias("spelling"), F.monotonically_increasing_id().alias("row"))
    rest = work.put(rest, "collided")
    return decide(rows.join(apart, "digest", "left_anti"), same, "digest").unionByName(decide(rest, compact(rest, "body"), "body"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Nulls, empty texts, ties and repeated ids fare as :func:`exact_groups` says; of rows alike in id
    and spelling one stays, and which other columns it has is settled by their hash.
    """
    decided = exact_groups(docs, id_col, text_col)
    decided = materialize(decided.select(F.struct("doc_id", F.col("text_sha256").alias("sha"), F.col("n_chars").alias("n"), "spelling").alias("key"), "kept"), "exact-decided")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = F.struct(docs[id_col].cast("long").alias("doc_id"), text_digest(normalised(text)).alias("sha"), F.length(text).alias("n"), F.xxhash64(text).alias("spelling"))
    return keep_rows(docs, key, decided)
