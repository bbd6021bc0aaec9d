"""Near-duplicate detection: MinHash banding, signature verification, exact confirmation, and
connected components by alternating large-star and small-star.

1. Signatures. One pass over the texts takes the set of word shingles as 64-bit hashes and the
   minima of ``BANDS * ROWS`` universal hash functions over it, of which 16 bits are kept.
   Documents with equal sets (by a 128-bit digest) are one class from here on.
2. Bands. Classes that agree on all rows of a band are in one bucket, and every member is compared
   by signature with the smallest class of the bucket. The components of the edges that pass are
   clusters. A bucket that lies in one cluster is done. In any other, the members outside its
   main cluster are compared with all members, and what passes joins clusters. So every two
   classes that share a bucket and have like signatures are in one cluster, and what is unlike
   its bucket joins nothing.
3. Confirmation. A cluster is dealt into blocks. The texts of a block go to one task with that of
   the cluster's smallest class, and are compared on their full shingle sets, unless already
   connected. Where links leave a cluster of several blocks in pieces, the members outside its
   largest piece are compared with all members of other blocks. Components of the confirmed
   links are the result.

A group of copies thus costs a few rows a member: only members that the group's smallest one does
not reach are compared with more than a block. At a similarity of exactly 0.8 a pair shares no
bucket with probability 6e-7, and fails the signature test with about 3e-7.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.llm.common import Workspace, keep_rows, materialize, text_or_empty, with_filter
from discweave.llm.components import star_components
from discweave.llm.words import row_groups, tidy, words_of

ROWS, BANDS = 5, 36
HASHES = ROWS * BANDS
_random = np.random.default_rng(20_011)
MULTIPLY = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A block: so many classes and so many shingles at most, but one class at least.
TASK_CLASSES, TASK_SHINGLES = 1500, 1_500_000


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text (none null) the sorted set of hashes of ``width`` words each, A-Z lowered."""
    words = words_of(texts, lower=True)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words.spelled), np.uint64, len(words.spelled))[words.codes]
    hashed: dict[int, np.ndarray] = {}

    def hashes(size: int) -> np.ndarray:
        """Of every ``size`` words in a row, across texts as well."""
        if size not in hashed:
            n = max(0, len(h) - size + 1)
            out = np.full(n, size, np.uint64)
            for k in range(size):
                out = out * MIX + h[k : n + k]
                out ^= out >> np.uint64(29)
            out *= MIX
            hashed[size] = out ^ (out >> np.uint64(32))
        return hashed[size]

    found = []
    for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True):
        size = min(width, b - a)
        found.append(np.unique(hashes(size)[a : b - size + 1]) if size else np.zeros(0, np.uint64))
    return found


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        table = shingles[at : at + 256, None] * MULTIPLY
        table += ADD
        np.minimum(least, table.min(axis=0), out=least)
    return ((least * MIX) >> np.uint64(48)).astype(np.uint16)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def enough(percent: int) -> int:
    """Equal hashes that two signatures have at least if their sets are ``percent`` alike, but for
    a chance of 3e-7 (five standard deviations)."""
    likeness = percent / 100
    return max(0, math.floor(HASHES * likeness - 5 * math.sqrt(HASHES * likeness * (1 - likeness))))


def signatures_of(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), HASHES)


class Forest:
    """Union-find over positions; the root is the smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def confirmed(sets: list[np.ndarray], signatures: np.ndarray, percent: int, labels: list, strays: list[bool] | None = None) -> Iterator[tuple[int, int]]:
    """Links (positions) that connect what no earlier link did; a spanning forest of all links.

    Positions with one label are connected already. ``strays``: compare only pairs with a stray.
    Every pair whose signatures agree on enough hashes and that is not connected yet is settled
    on the full sets.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    least = enough(percent)
    every, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(codes, kind="stable")
    owners, first = owner[order], np.searchsorted(codes[order], np.arange(len(every) + 1))
    forest = Forest(n)
    head: dict = {}
    for k, label in enumerate(labels):
        forest.join(head.setdefault(label, k), k)
    roots = np.array([forest.root(x) for x in range(n)])
    stray = np.ones(n, bool) if strays is None else np.array(strays, bool)
    for i in range(1, n):
        fits = (np.minimum(sizes[:i], sizes[i]) * 100 >= percent * np.maximum(sizes[:i], sizes[i])) & (roots[:i] != roots[i])
        if not stray[i]:
            fits &= stray[:i]
        others = np.flatnonzero(fits)
        if len(others):
            others = others[(signatures[others] == signatures[i]).sum(axis=1) >= least]
        if not len(others):
            continue
        own = codes[ends[i] - sizes[i] : ends[i]]
        if len(others) <= 8:
            shared = np.array([np.isin(codes[ends[j] - sizes[j] : ends[j]], own, assume_unique=True).sum() for j in others])
        else:
            lengths = first[own + 1] - first[own]
            at = np.arange(lengths.sum()) + np.repeat(first[own] - (np.cumsum(lengths) - lengths), lengths)
            shared = np.bincount(owners[at], minlength=n)[others]
        linked = others[100 * shared >= percent * (sizes[others] + sizes[i] - shared)]
        joined = False
        for j in linked.tolist():
            if forest.join(j, i):
                joined = True
                yield j, i
        if joined:
            roots = np.array([forest.root(x) for x in range(n)])


def grouped(batches, key: int) -> Iterator[list[tuple]]:
    """Lists of consecutive rows that agree in their first ``key`` columns."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[0][:key] != row[:key]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def links_batch(links: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])


# --- plans ---------------------------------------------------------------------------------------


def sign(texts: DataFrame, width: int) -> DataFrame:
    """id, mark, n, set, signature of rows (id, mark, text); the last two are null for empty sets."""

    def run(batches):
        for batch in batches:
            for a, b in row_groups(batch.column(2)):
                sets = shingle_sets(batch.column(2)[a:b], width)
                keys = [set_key(s) if len(s) else None for s in sets]
                signatures = [signature(s).tobytes() if len(s) else None for s in sets]
                columns = [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "n", "set", "signature"])
            batch = columns = sets = None
            tidy()

    return texts.mapInArrow(run, "id long, mark long, n long, set binary, signature binary")


def alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (u, v, own, other) the pairs whose two signatures agree on enough hashes."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                same = (signatures_of(part.column(2).to_pylist()) == signatures_of(part.column(3).to_pylist())).sum(axis=1) >= enough(percent)
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(same)) for k in (0, 1)], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def labelled(members: DataFrame, components: DataFrame, key: str = "cls") -> DataFrame:
    """``members`` with label: the component of ``key``, or ``key`` itself."""
    known = components.select(F.col("node").alias(key), F.col("component").alias("_component"))
    return members.join(known, key, "left").withColumn("label", F.coalesce("_component", key)).drop("_component")


def strays_and_all(members: DataFrame, group: str, blocks: F.Column) -> DataFrame:
    """Tasks that compare, in each group of (group, cls, label, weight), every member outside the
    group's main label with every member.

    Members are dealt to blocks by hash, strays to blocks of their own; a task is a block of
    strays and a block of all, so there are strays * members of it and not members squared.
    ``blocks``: how many blocks rows (n, weight) take. Returns group, a, b, stray, cls, label.
    """
    sizes = members.groupBy(group, "label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    whole = sizes.groupBy(group).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.count("*").alias("labels"), F.max("n").alias("most"))
    whole = whole.where("labels > 1").withColumn("bs", blocks).withColumn("n", F.col("n") - F.col("most")).withColumn("as", F.least(blocks, F.col("bs"))).select(group, "main", "as", "bs")
    placed = members.join(whole, group).withColumn("a", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("as")).cast("int")).withColumn("b", F.pmod(F.xxhash64("cls"), F.col("bs")).cast("int"))
    over = lambda count, a, b, stray: F.transform(F.sequence(F.lit(0), F.col(count).cast("int") - 1), lambda k: F.struct((k if a is None else F.col(a)).alias("a"), (k if b is None else F.col(b)).alias("b"), F.lit(stray).alias("stray")))
    tasks = F.when(F.col("label") == F.col("main"), over("as", None, "b", False)).otherwise(F.concat(over("as", None, "b", False), over("bs", "a", None, True)))
    return placed.select(group, "cls", "label", F.explode(tasks).alias("t")).select(group, "t.a", "t.b", "t.stray", "cls", "label")


def like_strays(tasks: DataFrame, agree: Callable) -> DataFrame:
    """(u, v): labels that rows (group, a, b, stray, cls, label, signature) of a task join by signature.
    ``agree(signatures)`` gives a function that tells which of them a signature is like."""

    def run(batches):
        for rows in grouped(batches, 3):
            strays = {r[4]: (r[5], r[6]) for r in rows if r[3]}
            rest = {r[4]: (r[5], r[6]) for r in rows if not r[3]}
            if not strays or not rest:
                continue
            names = sorted({x[0] for x in [*strays.values(), *rest.values()]})
            place = {x: k for k, x in enumerate(names)}
            like, labels = agree([x[1] for x in rest.values()]), np.array([place[x[0]] for x in rest.values()])
            forest, roots, links = Forest(len(names)), np.arange(len(names)), []
            for label, signed in strays.values():
                others = np.flatnonzero(roots[labels] != roots[place[label]])
                near = others[like(signed, others)]
                fresh = [(place[label], k) for k in np.unique(labels[near]).tolist() if forest.join(place[label], k)]
                links += [(names[x], names[y]) for x, y in fresh]
                if fresh:
                    roots = np.array([forest.root(x) for x in range(len(names))])
            if links:
                yield links_batch(links)
        tidy()

    return tasks.mapInArrow(run, "u long, v long")


def agreement(percent: int) -> Callable:
    """Of MinHash signatures."""
    def agree(column: list[bytes]) -> Callable:
        table = signatures_of(column)
        return lambda signed, others: (table[others] == np.frombuffer(signed, np.uint16)).sum(axis=1) >= enough(percent)

    return agree


def settled(work: Workspace, shared: DataFrame, signatures: DataFrame, clusters: DataFrame, agree: Callable) -> DataFrame:
    """``clusters`` (node, component) grown until every two members of a bucket with like signatures are
    in one. ``shared``: (bucket, cls) of the buckets that have several members."""
    inside = labelled(shared.select("bucket", "cls"), clusters)
    open_ = inside.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.bit_xor("cls").alias("x"), F.bit_xor(F.xxhash64("cls")).alias("y"))
    open_ = work.put(open_.where("low <> high").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "open")  # equal buckets once
    if open_.isEmpty():
        return clusters
    blocks = F.greatest(F.ceil(F.col("n") / TASK_CLASSES), F.lit(1)).cast("int")
    members = work.put(inside.join(open_, "bucket").withColumn("weight", F.lit(1)), "members")
    tasks = strays_and_all(members, "bucket", blocks).join(signatures, "cls")
    tasks = tasks.select("bucket", "a", "b", "stray", "cls", "label", "signature").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    joined = star_components(work.put(like_strays(tasks, agree), "joined"))
    work.drop("members")
    every = labelled(shared.select("cls").distinct(), clusters)
    every = work.put(labelled(every.withColumnRenamed("label", "old"), joined, "old").select(F.col("cls").alias("node"), F.col("label").alias("component")), "every")
    return every.join(every.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component").select("node", "component")


def confirm(tasks: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) between classes of a task: rows group, a, b, stray, cls, label, set,
    signature, text. Where no row is a stray all pairs are compared, else those with one."""
    return tasks.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", F.desc("stray"), "cls").mapInArrow(confirmer(width, percent), "u long, v long")


def confirmer(width: int, percent: int) -> Callable:
    def run(batches):
        for rows in grouped(batches, 3):
            seen: dict = {}
            for _, _, _, stray, cls, label, key, signed, text in rows:  # a stray comes first as such
                if cls not in seen:
                    shingles = shingle_sets(pa.array([text]), width)[0]
                    if set_key(shingles) == key:
                        seen[cls] = (shingles, signed, label, stray)
            if len(seen) < 2:
                continue
            names = list(seen)
            sets, signed, labels, strays = (list(x) for x in zip(*seen.values(), strict=True))
            found = list(confirmed(sets, signatures_of(signed), percent, labels, strays if any(strays) else None))
            if found:
                yield links_batch([(names[i], names[j]) for i, j in found])
        tidy()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Each row's shingle count and near-duplicate component.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets of
    distinct ``width``-word shingles; a document of fewer words has its whole sequence as one
    shingle. Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach),
    kept (doc_id = component_id) and text_hash. A text that is null or without words has an
    empty set and is alone. A null id is never the smallest, unless all ids of a component are
    null: then component_id is null and all are kept. Rows that share an id are separate
    documents, kept where that id is the smallest. Other columns are not read; an empty table
    gives no rows.
    """
    work = Workspace(docs.sparkSession, "minhash")
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = work.put(sign(own.select("id", "mark", "text"), width), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")
    classes = signed.where("set IS NOT NULL").groupBy("set").agg(first, F.any_value("n").alias("n"), F.any_value("signature").alias("signature"))
    classes = work.put(classes.select(F.monotonically_increasing_id().alias("cls"), "set", F.col("first.id").alias("id"), F.col("first.mark").alias("mark"), "n", "signature"), "classes")
    clusters = work.put(clustered(work, classes, percent), "clusters")

    blocks = F.greatest(F.ceil(F.col("n") / TASK_CLASSES), F.ceil(F.col("weight") / TASK_SHINGLES), F.lit(1)).cast("int")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).select("cluster", blocks.alias("blocks"))
    placed = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    spread = F.when(F.col("cls") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    tasks = work.put(placed.select("cluster", F.explode(spread).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("stray"), "cls", F.col("cls").alias("label")), "tasks")
    links = work.put(confirm(with_texts(tasks, clusters, own), width, percent), "links")
    tops = star_components(links)
    left = work.put(labelled(clusters.join(sizes.where("blocks > 1"), "cluster").select("cluster", "cls", "weight"), tops), "left")
    strays = work.put(strays_and_all(left, "cluster", blocks), "strays")
    if not strays.isEmpty():
        more = work.put(confirm(with_texts(strays, clusters, own), width, percent), "more")
        tops = star_components(links.unionByName(more))

    known = work.put(tops.select(F.col("node").alias("cls"), F.col("component").alias("top")).join(classes.select("cls", "id"), "cls"), "known")
    least = known.groupBy("top").agg(F.min("id").alias("component"))
    reached = known.join(least, "top").select("cls", F.col("component").alias("other"), F.lit(True).alias("grouped"))
    component = F.when(F.col("grouped"), F.col("other")).otherwise(F.col("id"))
    found = work.put(classes.select("cls", "set", "id").join(reached, "cls", "left").select("set", component.alias("component")), "components")
    work.drop("clusters", "links", "tasks", "left", "strays", "known")
    result = signed.select("id", "n", "set", "mark").join(found, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component"))
    result = result.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("mark").alias("text_hash"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def clustered(work: Workspace, classes: DataFrame, percent: int) -> DataFrame:
    """(cls, cluster, weight, id, mark, set, signature) of the classes in clusters of two and more;
    a cluster is named by its smallest class."""
    rows_of = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring("signature", b * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    members = classes.select("cls", F.posexplode(rows_of).alias("band", "rows")).select("cls", F.xxhash64("band", "rows").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("cls").alias("head"), F.count("*").alias("size")).where("size > 1").select("bucket", "head")
    shared = work.put(members.join(heads, "bucket").select("bucket", "cls", "head"), "shared")
    signatures = classes.select("cls", "signature")
    edges = shared.where("cls <> head").select(F.col("cls").alias("u"), F.col("head").alias("v")).distinct()
    pairs = edges.join(signatures.withColumnsRenamed({"cls": "u", "signature": "own"}), "u").join(signatures.withColumnsRenamed({"cls": "v", "signature": "other"}), "v")
    clusters = star_components(work.put(alike(pairs.select("u", "v", "own", "other"), percent), "edges"))
    clusters = settled(work, shared, signatures, clusters, agreement(percent))
    return clusters.withColumnsRenamed({"node": "cls", "component": "cluster"}).join(classes, "cls").select("cls", "cluster", F.col("n").alias("weight"), "id", "mark", "set", "signature")


def with_texts(tasks: DataFrame, clusters: DataFrame, own: DataFrame) -> DataFrame:
    """``tasks`` with set, signature and text of each class, found by its first document."""
    members = tasks.join(clusters.select("cls", "id", "mark", "set", "signature"), "cls").withColumnRenamed("id", "of")
    at = F.xxhash64("mark", "id")
    near = with_filter(own, at, clusters.select(at.alias("at")), "at")
    near = near.join(members, "mark").where(F.col("id").eqNullSafe(F.col("of")))
    return near.select("cluster", "a", "b", "stray", "cls", "label", "set", "signature", "text")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the one its component keeps, with all columns.

    Nulls, empty texts and repeated ids fare as :func:`near_duplicates` says: a text without words
    stays, and so do all rows that share the smallest id of a component and its text.
    """
    found = near_duplicates(docs, id_col, text_col, width, percent)
    decided = materialize(found.select(F.struct("doc_id", "text_hash").alias("key"), "kept"), "minhash-decided")
    key = F.struct(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("text_hash"))
    return keep_rows(docs, key, decided)
