"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent, normalised. The
exponent is bisected so that the weights reach a target entropy, or so that no source has to
be repeated more often than a limit. The weights are realised within a token budget: the
documents of a source are dealt to blocks of a stated size by hash, every epoch goes through
the blocks in a permutation of its own, and the last epoch stops where the source's budget
ends. What is scheduled is spread evenly over the stream, so that any stretch of it has the
target mixture.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discweave.llm.common import materialize, text_or_empty


def tempered(tokens: dict, exponent: float) -> dict:
    """Normalised weights; a source without tokens weighs nothing."""
    top = max(tokens.values(), default=0)
    raised = {s: (t / top) ** exponent if t else 0.0 for s, t in tokens.items()}
    total = sum(raised.values())
    return {s: r / total if total else 0.0 for s, r in raised.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def repeats(tokens: dict, weights: dict, budget: float | None) -> dict:
    """Epochs of each source. Without a budget the least repeated source is gone through once."""
    rates = {s: weights[s] / t for s, t in tokens.items() if t}
    scale = budget if budget is not None else 1 / min(rates.values(), default=1.0)
    return {s: r * scale for s, r in rates.items()}


def bisect_exponent(tokens: dict, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, rounds: int = 60) -> float:
    """The exponent in [0, 1] at which the weights just meet the target.

    Entropy falls and the most repeated source's epochs fall as the exponent grows from 0
    (sources alike) to 1 (shares as they are). ``target_entropy``, in nats: the largest
    exponent with at least that entropy. ``max_repeats``: the smallest exponent with no more
    epochs than that. A target that no exponent meets gives the end nearest to it.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either a target entropy or a limit of repetitions")

    def flat_enough(x: float) -> bool:
        weights = tempered(tokens, x)
        if target_entropy is not None:
            return entropy(weights) >= target_entropy
        return max(repeats(tokens, weights, budget).values(), default=0.0) > max_repeats

    low, high = 0.0, 1.0
    if not flat_enough(low):
        return low
    if flat_enough(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if flat_enough(middle) else (low, middle)
    return low if target_entropy is not None else high


@dataclass
class Mixture:
    """What was decided: tokens, weight and epochs of each source (None: a null source)."""

    tokens: dict
    exponent: float
    weights: dict
    epochs: dict


#: Blocks whose order one task settles.
CELL_BLOCKS = 1000


def word_count(text: F.Column) -> F.Column:
    """Words between ASCII white space; a longer one counts for every 16 characters begun, so that
    scripts without spaces weigh by their length."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]{1,16}")).cast("long")


def source_key(source: F.Column) -> F.Column:
    """A source as a string that is never null; a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def place_hash(identifier: F.Column, seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), identifier.cast("string"))


def schedule(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, block_tokens: int = 200_000, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[Mixture, DataFrame, DataFrame]:
    """Decide a mixture: (the decision, number of blocks of each source, the plan of blocks).

    The plan has a row per source (key), block and epoch: at (where in the stream, 0 to 1) and
    cut, the largest place hash that still fits where the block is only taken in part. The
    number of sources must fit the driver; blocks and documents stay distributed. A null
    source is a source; a null text or one without words has no tokens and goes with the block
    its hash puts it in; a null id is hashed like any other, and rows that share an id stay
    together. Without a budget each document is in the stream once at least. No rows give no
    blocks.
    """
    spark = docs.sparkSession
    measured = docs.select(source_key(F.col(source_col)).alias("key"), place_hash(F.col(id_col), seed).alias("h"), word_count(text_or_empty(text_col)).alias("tokens"))
    measured = materialize(measured.groupBy("key", "h").agg(F.sum("tokens").alias("tokens")), "mixing-measured")
    tokens = {r["key"]: int(r["t"]) for r in measured.groupBy("key").agg(F.sum("tokens").alias("t")).collect()}
    exponent = bisect_exponent(tokens, target_entropy, max_repeats, budget)
    weights = tempered(tokens, exponent)
    epochs = repeats(tokens, weights, budget) | {s: 1.0 for s, t in tokens.items() if not t}
    counts = {s: max(1, math.ceil(t / block_tokens)) for s, t in tokens.items()}
    known = spark.createDataFrame([(s, n, max(1, math.ceil(n / CELL_BLOCKS)), float(epochs[s]), tokens[s]) for s, n in counts.items()], "key string, blocks long, cells long, epochs double, total long")
    slim = in_blocks(measured, known)
    sized = slim.groupBy("key", "block").agg(F.sum("tokens").alias("size")).join(F.broadcast(known.drop("blocks")), "key")
    last = F.greatest(F.ceil(F.col("epochs") - 1e-9).cast("int"), F.lit(1)) - 1
    turns = sized.withColumn("epoch", F.explode(F.sequence(F.lit(0), last))).withColumn("rank", F.xxhash64(F.lit(seed), "epoch", "block"))
    # the tokens before a block: those of the cells before its cell, and of the blocks before it in there
    turns = turns.withColumn("cell", F.floor((F.col("rank") / float(1 << 64) + 0.5) * F.col("cells")))
    cells = turns.groupBy("key", "epoch", "cell").agg(F.sum("size").alias("held"))
    cells = cells.withColumn("earlier", F.sum("held").over(Window.partitionBy("key", "epoch").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).drop("held")
    order = Window.partitionBy("key", "epoch", "cell").orderBy("rank", "block")
    turns = turns.join(cells, ["key", "epoch", "cell"]).withColumn("before", F.col("earlier") + F.sum("size").over(order) - F.col("size"))
    share = F.least(F.lit(1.0), F.col("epochs") - F.col("epoch"))
    turns = turns.withColumn("room", F.round(share * F.col("total")).cast("long") - F.col("before"))
    turns = turns.withColumn("at", (F.col("epoch") + (F.col("before") + F.col("size") / 2) / F.greatest("total", F.lit(1))) / F.greatest("epochs", F.lit(1e-9)))
    turns = materialize(turns.where("room > 0 OR total = 0 OR (size = 0 AND epoch = 0)").select("key", "block", "epoch", "size", "room", "at"), "mixing-turns")
    partly = turns.where("room < size").select("key", "block", "epoch", "room")
    running = F.sum("tokens").over(Window.partitionBy("key", "block", "epoch").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    inside = slim.join(partly, ["key", "block"]).withColumn("until", running)
    cuts = inside.where("until <= room").groupBy("key", "block", "epoch").agg(F.max("h").alias("cut"))
    plan = turns.join(cuts, ["key", "block", "epoch"], "left").where("room >= size OR cut IS NOT NULL").select("key", "block", "epoch", "at", "cut")
    return Mixture(tokens, exponent, weights, epochs), known.select("key", "blocks"), materialize(plan, "mixing-plan")


def in_blocks(df: DataFrame, known: DataFrame) -> DataFrame:
    """``df`` (key, h, ...) with the block of each row; ``known`` has a row per source."""
    return df.join(F.broadcast(known.select("key", "blocks")), "key").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks"))).drop("blocks")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, **options) -> tuple[Mixture, DataFrame]:
    """The mixture, and the rows of ``docs`` repeated or left out as it says, in a struct ``row``
    beside key, epoch, block, at and h (a hash of the id); sort by ``at`` for the order of the stream."""
    decision, known, plan = schedule(docs, id_col=id_col, source_col=source_col, seed=seed, **options)
    inner = docs.select(source_key(docs[source_col]).alias("key"), place_hash(docs[id_col], seed).alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = in_blocks(inner, known).join(plan, ["key", "block"]).where("cut IS NULL OR h <= cut")
    return decision, out.select("row", "key", "epoch", "block", "at", "h")


def mixed_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: float = 2.0, **options) -> DataFrame:
    """Per document and epoch: doc_id, source, tokens, epoch, block, at, and the source's weight."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    decision, rows = mix(own, "doc_id", "source", text_col="text", max_repeats=max_repeats, **options)
    weights = docs.sparkSession.createDataFrame([(s, w, float(decision.epochs[s])) for s, w in decision.weights.items()], "key string, weight double, epochs double")
    rows = rows.select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), word_count(F.coalesce("row.text", F.lit(""))).alias("tokens"), "epoch", "block", "at")
    return rows.join(F.broadcast(weights), "key").drop("key")


def mixed_rows(docs: DataFrame, max_repeats: float = 2.0, **options) -> DataFrame:
    """The stream itself: rows of ``docs`` with all their columns, repeated as the weights ask,
    range-sorted by their place in the stream."""
    _, rows = mix(docs, max_repeats=max_repeats, **options)
    spread = rows.withColumn("tie", F.xxhash64("key", "block", "h"))
    return spread.repartitionByRange("at", "tie").sortWithinPartitions("at", "tie").select("row.*")
