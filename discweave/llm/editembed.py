"""Document fingerprints by randomised edit embedding.

All documents share one table of random bits R[step][character class]. A walk over a text puts
out the current character at every step and moves on to the next one where the bit says so;
two texts at a small edit distance fall into step again after each difference, so the edit
distance of texts becomes the Hamming distance of walks. A fingerprint samples the walk: a hex
digit, hashed from step and character, at each of a shared list of steps that holds all of the
first 64 and 64 of every octave after them. Runs of eight digits are the bands that candidates
are found by; weighted agreement of all digits verifies them. How soon walks fall into step again
is chance, so the search for pairs has ``WALKS`` of them, each begun at another step of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.llm.common import SALTS, Workspace, materialize, plan_shards, row_salt, shard_of, text_or_empty, with_filter
from discweave.llm.components import star_components
from discweave.llm.minhash import labelled, settled
from discweave.llm.words import tidy

CLASSES, PERIOD = 128, 1 << 13
PER_OCTAVE, OCTAVES = 64, 34
WALKS = 8
_random = np.random.default_rng(60_013)
BITS = _random.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
BITS[:, -1] = 1  # no walk stays at a character for ever
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: What one task of the pair search compares: so many fingerprints at most, or else blocks of these.
TASK_PRINTS = 500


def dwell_table() -> np.ndarray:
    """For a character class met at a step: how many steps the walk stays."""
    out = np.zeros((CLASSES, PERIOD), np.int64)
    for c in range(CLASSES):
        ones = np.flatnonzero(BITS[c])
        out[c] = ones[np.searchsorted(ones, np.arange(PERIOD))] - np.arange(PERIOD) + 1
    return out


def sampled_steps() -> tuple[np.ndarray, np.ndarray]:
    """The sampled steps, ascending, and how many steps of the walk each speaks for."""
    steps, weights = [np.arange(PER_OCTAVE)], [np.ones(PER_OCTAVE)]
    low = PER_OCTAVE
    for _ in range(OCTAVES):
        cell = low // PER_OCTAVE  # one step from each of 64 cells
        steps.append(low + np.arange(PER_OCTAVE) * cell + _random.integers(0, cell, PER_OCTAVE))
        weights.append(np.full(PER_OCTAVE, float(cell)))
        low *= 2
    return np.concatenate(steps), np.concatenate(weights)


DWELL = dwell_table()
STEPS, WEIGHTS = sampled_steps()
STEP_SALT = (STEPS.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
DWELL_BYTES = [bytes(row.clip(0, 255).astype(np.uint8)) for row in DWELL]
if DWELL.max() > 255:
    raise ValueError("a walk stays too long at one character")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(codes: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
    """For each text (code points) the step at which its walk, begun at ``starts``, comes to each
    character, and at the end the step after the last. Texts advance side by side, the longest
    first; the few that are left in the end go on one by one."""
    order = sorted(range(len(codes)), key=lambda k: -len(codes[k]))
    lengths = np.array([len(codes[k]) for k in order])
    places = np.concatenate([[0], np.cumsum(lengths + 1)])
    flat = np.zeros(places[-1], np.int64)
    for k, at in zip(order, places, strict=False):
        flat[at : at + len(codes[k])] = codes[k] % CLASSES
    steps = np.zeros(places[-1], np.int64)
    now = np.array([starts[k] for k in order], np.int64)
    table, mask = DWELL.reshape(-1), PERIOD - 1
    i, alive = 0, len(order)
    while alive:
        while alive and lengths[alive - 1] <= i:
            alive -= 1
            steps[places[alive] + i] = now[alive]
        if alive < 64:
            break
        until = lengths[alive - 1]
        at, step = places[:alive] + i, now[:alive]
        for i in range(i, until):
            steps[at] = step
            step += table[(flat[at] << 13) | (step & mask)]
            at += 1
        i = until
    for k in range(alive):
        step, out = int(now[k]), []
        begin, end = places[k] + i, places[k] + lengths[k]
        for c in flat[begin:end].tolist():
            out.append(step)
            step += DWELL_BYTES[c][step & mask]
        out.append(step)
        steps[begin : end + 1] = out
    found: list = [None] * len(codes)
    for k, at, n in zip(order, places, lengths, strict=False):
        found[k] = steps[at : at + n + 1]
    return found


def digits(codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The digits of a text whose walk comes to its characters at ``steps``."""
    end = min(int(steps[-1]), 3 * len(codes))
    n = int(np.searchsorted(STEPS, end))
    at = np.searchsorted(steps[:-1], STEPS[:n], side="right") - 1
    mixed = (codes[at].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ STEP_SALT[:n]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(60)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the longer walk on which two fingerprints agree, less what chance gives; 0 to 1."""
    short, long = sorted((len(a), len(b)))
    if not long:
        return 1.0
    same = float(WEIGHTS[:short][a[:short] == b[:short]].sum() / WEIGHTS[:long].sum())
    return 1.0 if same == 1.0 else max(0.0, (same - 1 / 16) * 16 / 15)


def as_text(found: np.ndarray) -> str:
    return HEX[found].tobytes().decode()


def as_digits(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode(), np.uint8)
    return codes - np.where(codes < 58, 48, 87).astype(np.uint8)


def fingerprints_of(texts: list[str], number: int = 0) -> list[np.ndarray]:
    """The fingerprints by walk ``number``."""
    codes, start = [code_points(t) for t in texts], number * PERIOD // WALKS
    return [digits(c, s - start) for c, s in zip(codes, walk(codes, [start] * len(codes)), strict=True)]


def in_blocks(rows: Iterator[tuple], chars: int = 2_000_000, most: int = 2000) -> Iterator[list[tuple]]:
    """Lists of rows, cut by the summed length of their last column."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= chars or len(held) >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint (of the first walk), others (of the other walks) of every whole
    text; a null text is empty, and an empty one has empty fingerprints. Equal texts have equal
    fingerprints. A row gives a row."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for block in in_blocks(rows):
                first, *others = ([as_text(f) for f in fingerprints_of([t for _, t in block], k)] for k in range(WALKS))
                columns = [pa.array([k for k, _ in block], batch.schema.field(0).type), pa.array([len(t) for _, t in block], pa.int64()), pa.array(first, pa.string()), pa.array(list(map(list, zip(*others, strict=True))), pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "fingerprint", "others"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string, others array<string>")


def near_rows(prints: list[list[np.ndarray]], threshold: float, side: list[int] | None = None) -> Iterator[tuple[int, int, float]]:
    """Every two positions, of different sides if given, whose best likeness is ``threshold`` or more.

    A row of ``prints`` has a fingerprint for each walk. A pair whose 32 heaviest digits disagree
    more than the threshold allows is settled by these.
    """
    total = np.concatenate([[0.0], np.cumsum(WEIGHTS)])
    lost = 1 - (threshold * 15 / 16 + 1 / 16)
    tables = []
    for found in zip(*prints, strict=True):
        sizes = np.array([len(f) for f in found])
        table = np.full((len(found), sizes.max()), 255, np.uint8)
        for row, f in zip(table, found, strict=True):
            row[: len(f)] = f
        tables.append((table, sizes))
    sides = None if side is None else np.array(side)
    for i in range(len(prints) - 1):
        others = np.arange(i + 1, len(prints))
        if sides is not None:
            others = others[sides[others] != sides[i]]
        best = np.zeros(len(others))
        for table, sizes in tables:
            own = sizes[i]
            low, weights = max(0, own - 32), WEIGHTS[:own]
            whole = total[np.maximum(own, sizes[others])]
            apart = (table[others, low:own] != table[i, low:own]) @ weights[low:]
            at = np.flatnonzero(apart <= lost * whole + 1e-9 * whole)
            if len(at):
                same = ((table[others[at], :own] == table[i, :own]) @ weights) / np.maximum(whole[at], 1)
                value = np.where((same == 1) | (whole[at] == 0), 1.0, np.maximum(0.0, (same - 1 / 16) * 16 / 15))
                best[at] = np.maximum(best[at], value)
        for k in np.flatnonzero(best >= threshold):
            yield i, int(others[k]), float(best[k])


def near_pairs(prints: DataFrame, threshold: float = 0.8, band: int = 8) -> DataFrame:
    """(doc_id, head, likeness) of every two documents that share a bucket and are alike by
    ``threshold`` or more in some walk; head is the smaller one, likeness that of the best walk.

    A bucket holds the fingerprints with the same ``band`` digits at the same place of a walk, and all of
    its members are compared with each other; buckets with the same members are one. A bucket
    over ``TASK_PRINTS`` is dealt into blocks, every two of which are one task's. Documents with
    equal fingerprints are one member there and pairs of likeness 1, however short; unlike ones
    shorter than a band meet nothing. A group of m alike gives m * (m - 1) / 2 rows. Rows without
    identifier are left out, and a document makes no pair with itself.
    """
    known = prints.where("doc_id IS NOT NULL").select("doc_id", F.concat(F.array("fingerprint"), "others").alias("walks"))
    known = materialize(known.withColumn("set", F.xxhash64(F.concat_ws(" ", "walks"))), "edit-prints")
    classes = materialize(known.groupBy("set").agg(F.any_value("walks").alias("walks")), "edit-classes")
    own, other = known.select("set", "doc_id").distinct(), known.select("set", F.col("doc_id").alias("head")).distinct()
    copies = own.join(other, "set").where("doc_id > head").select("doc_id", "head", F.lit(1.0).alias("likeness"))

    of_walk = classes.select("set", F.posexplode("walks").alias("walk", "print")).where(F.length("print") >= band)
    places = F.sequence(F.lit(0), F.floor(F.length("print") / band).cast("int") - 1)
    cut = of_walk.select("set", "walk", F.posexplode(F.transform(places, lambda k: F.substring("print", k * band + 1, F.lit(band)))).alias("place", "part"))
    members = cut.select("set", F.xxhash64("walk", "place", "part").alias("bucket")).distinct()
    held = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("set").alias("x"), F.bit_xor(F.xxhash64("set")).alias("y")).where("n > 1")
    apart = held.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / TASK_PRINTS).cast("int").alias("blocks"))
    placed = members.join(apart, "bucket").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b")))
    dealt = placed.select("set", "bucket", "block", F.explode(tasks).alias("task")).select("bucket", "task.a", "task.b", "block", "set").join(classes.select("set", "walks"), "set")
    dealt = dealt.select("bucket", "a", "b", "block", "set", "walks").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "set")

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        side = [r[0] for r in rows]
        found = list(near_rows([[as_digits(t) for t in r[2]] for r in rows], threshold, side if len(set(side)) > 1 else None))
        columns = [[rows[i][1] for i, _, _ in found], [rows[j][1] for _, j, _ in found], [v for *_, v in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["u", "v", "likeness"])

    def run(batches):
        task, rows = None, []
        for batch in batches:
            for bucket, a, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, a, b) != task:
                    if len(rows) > 1:
                        yield settle(rows)
                    task, rows = (bucket, a, b), []
                rows.append(row)
        if len(rows) > 1:
            yield settle(rows)

    found = dealt.mapInArrow(run, "u long, v long, likeness double").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("likeness").alias("likeness"))
    pairs = found.join(own.withColumnsRenamed({"set": "u", "doc_id": "a"}), "u").join(other.withColumnsRenamed({"set": "v", "head": "b"}), "v").where("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("doc_id"), F.least("a", "b").alias("head"), "likeness")
    return pairs.unionByName(copies).groupBy("doc_id", "head").agg(F.max("likeness").alias("likeness"))


#: Digits of the bands that the query's candidates share: one of eight in every octave.
BAND_PLACES = [PER_OCTAVE * o + 8 * (3 * o % 8) for o in range(OCTAVES + 1)]


def buckets_of(found: np.ndarray) -> list[int]:
    """A number for the digits of each band that is taken, and its octave.

    Texts of four octaves and more take those from the third on, as openings are shared by unlike
    texts; shorter ones their last two. So texts of about one length have octaves in common.
    """
    whole = [(o, p) for o, p in enumerate(BAND_PLACES) if p + 8 <= len(found)]
    taken = whole[min(2, max(0, len(whole) - 2)) :]
    return [(o << 32) | int.from_bytes(bytes(found[p : p + 8 : 2] << 4 | found[p + 1 : p + 8 : 2]), "big") for o, p in taken]


def print_mark(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def near_notes(own: DataFrame, threshold: float) -> DataFrame:
    """(k, tie, near) of rows (k, tie, id, text): the smallest id that near fingerprints reach.

    Documents of one fingerprint are one class. Classes whose fingerprints have the same band in
    some octave are in one bucket; every two of a bucket that are alike by ``threshold`` or more
    are linked: members meet the bucket's smallest class, and those outside its main cluster meet
    all others, in blocks, as in :mod:`minhash`.
    """
    work = Workspace(own.sparkSession, "edit")

    def marks(batches):
        for batch in batches:
            for block in in_blocks(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                found = fingerprints_of([r[-1] for r in block])
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in block], pa.int64()) for k in range(3)] + [pa.array(map(print_mark, found), pa.int64()), pa.array(map(buckets_of, found), pa.list_(pa.int64())), pa.array([f.tobytes() for f in found], pa.binary())], names=["k", "tie", "id", "cls", "buckets", "signature"])
            batch = block = found = None
            tidy()

    prints = work.put(own.select("k", "tie", "id", "text").mapInArrow(marks, "k long, tie long, id long, cls long, buckets array<long>, signature binary"), "prints")
    members = prints.select("cls", F.explode("buckets").alias("bucket")).distinct()
    heads = members.groupBy("bucket").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    shared = work.put(members.join(heads, "bucket").select("bucket", "cls", "head"), "shared")

    # the fingerprints of the classes that share a bucket
    found = shared.select("cls").distinct()
    signatures = with_filter(prints.select("cls", "signature"), F.col("cls"), found, "cls").join(found, "cls", "left_semi")
    signatures = work.put(signatures.groupBy("cls").agg(F.any_value("signature").alias("signature")), "signatures")
    edges = shared.where("cls <> head").select(F.col("cls").alias("u"), F.col("head").alias("v")).distinct()
    pairs = edges.join(signatures.withColumnsRenamed({"cls": "u", "signature": "own"}), "u").join(signatures.withColumnsRenamed({"cls": "v", "signature": "other"}), "v")

    def alike(batches):
        for batch in batches:
            near = [likeness(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)) >= threshold for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near, pa.bool_())) for k in (0, 1)], names=["u", "v"])

    def agree(column: list[bytes]):
        sizes = np.array([len(x) for x in column])
        table = np.full((len(column), int(sizes.max())), 255, np.uint8)  # no digit
        for row, x in zip(table, column, strict=True):
            row[: len(x)] = np.frombuffer(x, np.uint8)
        total = np.concatenate([[0.0], np.cumsum(WEIGHTS)])

        def like(one: bytes, others: np.ndarray) -> np.ndarray:
            own = np.frombuffer(one, np.uint8)[: table.shape[1]]
            same = (table[others, : len(own)] == own) @ WEIGHTS[: len(own)] / total[np.maximum(sizes[others], len(one))]
            return (same - 1 / 16) * 16 / 15 >= threshold

        return like

    clusters = star_components(work.put(pairs.select("u", "v", "own", "other").mapInArrow(alike, "u long, v long"), "edges"))
    clusters = settled(work, shared, signatures, clusters, agree)
    labels = labelled(prints.groupBy("cls").agg(F.min("id").alias("id")), clusters)
    labels = labels.join(labels.groupBy("label").agg(F.min("id").alias("near")), "label").select("cls", "near")
    notes = work.put(prints.select("k", "tie", "cls").distinct().join(labels, "cls").select("k", "tie", "near"), "notes")
    work.drop("prints", "shared", "signatures", "edges")
    return notes


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 32 << 20, near: float | None = None) -> DataFrame:
    """Each document's fingerprint against that of an edited text and of the next document.

    The next document is the one with the next smaller id, that of the last the first. The
    edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document. Rows that share an id follow each other by a hash of their text;
    null ids come last. Null texts are empty, and two empty texts are alike. An only row is its
    own next. Other columns are not read; an empty table gives no rows.

    With ``near``, near_class is the smallest id that links of fingerprints alike by ``near`` or more
    reach (see :func:`near_notes`): that of a document without such links is its own, or the
    smallest of its fingerprint; null if none of them has an id.

    Documents are dealt by ranges of ids in one shuffle, those that share an id to several
    shards if need be; the first text of each shard goes to the shard before it as well, so no
    task needs more than its own rows.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("k"), F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    shards = plan_shards(own, "k", F.octet_length("text"), shard_bytes, F.col("tie"), salted=True)
    sharded = own.withColumn("task", shard_of(shards, F.col("k"), F.col("tie"), row_salt()))
    heads = sharded.groupBy("task").agg(F.max(F.struct("k", "tie")).alias("h")).select("task", "h.k", "h.tie").orderBy("task").collect()  # a row a shard
    followed = [(h["k"], h["tie"], heads[(i + 1) % len(heads)]["task"]) for i, h in enumerate(heads)]
    after = F.broadcast(docs.sparkSession.createDataFrame(followed, "k long, tie long, task int"))
    tails = own.join(after, ["k", "tie"]).groupBy("task", "k", "tie").agg(F.max("text").alias("text"))
    nothing = F.lit(None).cast("long")
    tails = tails.select("k", nothing.alias("id"), "text", "tie", "task", F.lit(1).alias("tail"), F.lit(1).alias("kind"), nothing.alias("near"))
    spread = sharded.withColumns({"tail": F.lit(0), "kind": F.lit(1), "near": nothing}).unionByName(tails)
    if near is not None:  # a note comes right before the rows it is about, in every shard that has some
        ends = [shard_of(shards, F.col("k"), F.col("tie"), F.lit(salt).cast("long")) for salt in (0, SALTS - 1)]
        notes = near_notes(own, near).withColumn("task", F.explode(F.sequence(*ends)))
        spread = spread.unionByName(notes.select("k", nothing.alias("id"), F.lit("").alias("text"), "tie", "task", F.lit(0).alias("tail"), F.lit(0).alias("kind"), "near"))
    spread = spread.repartitionById(len(shards), F.col("task"))
    dealt = spread.sortWithinPartitions("task", "tail", F.desc("k"), F.desc("tie"), "kind", F.desc("text")).select("id", "task", "tail", "kind", "near", "text")

    def run(batches):
        def rows():
            note = None
            for batch in batches:
                for key, task, tail, kind, value, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind:
                        yield key, task, tail, note, text
                    else:
                        note = value

        held: list[tuple] = []
        for block in in_blocks(rows()):
            held += block
            if len(held) > 1:
                if (out := settle(held)) is not None:
                    yield out
                held = held[-1:]
        tidy()

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        """Results of all rows that are followed by one of the same task, tails left out."""
        at = [i for i in range(len(rows) - 1) if rows[i][2] == 0 and rows[i + 1][1] == rows[i][1]]
        if not at:
            return None
        texts = [r[-1] for r in rows]
        codes = [code_points(t) for t in texts]
        steps = walk(codes, [0] * len(codes))
        kept = {i: len(codes[i]) - len(codes[i]) // 2 for i in at}
        pieces = [codes[i + 1][: len(codes[i]) // 2] for i in at]
        beyond = walk(pieces, [int(steps[i][kept[i]]) for i in at])
        found = [digits(c, s) for c, s in zip(codes, steps, strict=True)]
        columns: list[list] = [[] for _ in range(7)]
        for i, piece, more in zip(at, pieces, beyond, strict=True):
            k = kept[i]
            edited = digits(np.concatenate([codes[i][:k], piece]), np.concatenate([steps[i][:k], more]))
            text = texts[i][:k] + texts[i + 1][: len(codes[i]) // 2]
            values = (rows[i][0], len(codes[i]), hashlib.sha256(text.encode()).hexdigest(), as_text(found[i]), as_text(edited), likeness(found[i], edited), likeness(found[i], found[i + 1]))
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        if near is not None:
            arrays, names = [*arrays, pa.array([rows[i][3] for i in at], pa.int64())], [*names, "near_class"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + ", near_class long" * (near is not None))
