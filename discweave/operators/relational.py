"""Joins, reconciliation and aggregates, by column names and a partition key.

Every operator takes DataFrames and returns one lazily; nothing here collects. The leading key
(a disc, a customer, a brand) bounds every group, and none of the joins is a product of a
group with itself unless the operator is about pairs within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- lookups -------------------------------------------------------------------------------------


def lookup_with_fallback(left: DataFrame, right: DataFrame, group: str, key: str, out: str) -> DataFrame:
    """``left`` with ``out``: its (group, key) if ``right`` has it, else the group's smallest key.

    A group that ``right`` does not have at all gives null (see :func:`required`); ``remapped``
    tells which rows fell back.
    """
    known = right.select(group, F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    least = known.groupBy(group).agg(F.min("_key").alias("_least"))
    hit = left.join(known, (left[group] == known[group]) & (left[key] == known["_key"]), "left").drop(known[group])
    both = hit.join(least, group, "left")
    return both.withColumn(out, F.coalesce("_key", "_least")).withColumn("remapped", F.col("_key").isNull() & F.col("_least").isNotNull()).drop("_key", "_least")


def misses(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` that a strict lookup in ``right`` would fail for."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def required(df: DataFrame, column: str, message: str) -> DataFrame:
    """``df``, raising when evaluated if ``column`` is null anywhere."""
    value = F.when(F.col(column).isNull(), F.raise_error(F.lit(message)).cast(df.schema[column].dataType)).otherwise(F.col(column))
    return df.withColumn(column, value)


def zip_positional(left: DataFrame, right: DataFrame, group: str, left_order: list, right_order: list) -> DataFrame:
    """The n-th row of a group on one side with the n-th on the other, down to the shorter side."""
    a = left.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*left_order)))
    b = right.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*right_order)))
    return a.join(b, [group, "pos"])


def two_level_match(left: DataFrame, right: DataFrame, fine: str, coarse: str, left_order: list, right_order: list) -> DataFrame:
    """Positional match within ``fine`` groups that both sides have; rows of ``left`` in other
    fine groups are matched positionally within ``coarse``. ``level`` says which it was."""
    there = right.select(fine).distinct()
    near = zip_positional(left.join(there, fine, "left_semi"), right.drop(coarse), fine, left_order, right_order).withColumn("level", F.lit("fine"))
    far = zip_positional(left.join(there, fine, "left_anti"), right.drop(fine), coarse, left_order, right_order).withColumn("level", F.lit("coarse"))
    return near.unionByName(far)


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the ids that only one side has: differences both ways, without repeats."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def full_outer_counts(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str, unknown=None) -> DataFrame:
    """Rows per key on either side, 0 where a side has none; null keys count under ``unknown``."""
    k = lambda df: F.coalesce(df[key], F.lit(unknown)) if unknown is not None else df[key]
    count = lambda df, name: df.groupBy(k(df).alias(key)).agg(F.count("*").alias(name))
    out = count(left, left_name).join(count(right, right_name), key, "full_outer")
    return out.select(key, F.coalesce(left_name, F.lit(0)).alias(left_name), F.coalesce(right_name, F.lit(0)).alias(right_name))


def missing_required(df: DataFrame, group: str, value: str, needed: list[str]) -> DataFrame:
    """(group, missing): the required values a group lacks, sorted; groups that lack none are left out."""
    have = df.groupBy(group).agg(F.collect_set(F.when(F.col(value).isin(*needed), F.col(value))).alias("_have"))
    out = have.select(group, F.array_sort(F.array_except(F.array(*map(F.lit, needed)), "_have")).alias("missing"))
    return out.where(F.size("missing") > 0)


def first_match_or_default(left: DataFrame, right: DataFrame, key: str, value: str, order: list, default) -> DataFrame:
    """``left`` with the value of the first matching row of ``right``, else ``default``."""
    first = right.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("_value"))
    return left.join(first, key, "left").withColumn(value, F.coalesce("_value", F.lit(default))).drop("_value")


# --- intervals -----------------------------------------------------------------------------------


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_low: str, a_high: str, b_low: str, b_high: str, width: float, inclusive: bool = True) -> DataFrame:
    """Pairs of rows whose intervals meet, by an equi-join on buckets of ``width``.

    Each interval is put into the buckets it touches; a pair is kept only in the bucket where
    the later of the two begins, so it appears once. Intervals should span few buckets: take
    a width about as long as they are. Ends are inclusive, or else [low, high). Rows with a
    null end meet nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = lambda df, low, high: df.where(F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(high) >= F.col(low))).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    pairs = spread(a, a_low, a_high).join(spread(b, b_low, b_high), [*keys, "_bucket"])
    meets = (F.col(a_low) <= F.col(b_high)) & (F.col(b_low) <= F.col(a_high)) if inclusive else (F.col(a_low) < F.col(b_high)) & (F.col(b_low) < F.col(a_high))
    first = F.floor(F.greatest(a_low, b_low) / width).cast("long") == F.col("_bucket")
    return pairs.where(meets & first).drop("_bucket")


def segment_slices(segments: DataFrame, files: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Slices of consecutive files that segments [start, end) cover: rel_start and duration in
    each file [file_start, file_end). Slices of no length are left out."""
    pairs = interval_overlap(segments, files, keys, "seg_start", "seg_end", "file_start", "file_end", width, inclusive=False)
    start = F.greatest(F.lit(0.0), F.col("seg_start") - F.col("file_start"))
    end = F.least(F.col("file_end") - F.col("file_start"), F.col("seg_end") - F.col("file_start"))
    return pairs.withColumn("rel_start", start).withColumn("duration", end - start).where("duration > 0")


# --- pairs within groups -------------------------------------------------------------------------


def overlap_pairs(rects: DataFrame, group: str, pos: str, metric, threshold: float) -> DataFrame:
    """(group, a, b, ratio) of the pairs a < b of a group whose overlap exceeds ``threshold``.

    ``metric(prefix_a, prefix_b)`` is a column over columns named ``a_*`` and ``b_*``. Groups are
    the boxes of one menu page; that bounds the pairs.
    """
    side = lambda p: rects.select(F.col(group), *[F.col(c).alias(f"{p}_{c}") for c in rects.columns if c != group])
    pairs = side("a").join(side("b"), group).where(F.col(f"a_{pos}") < F.col(f"b_{pos}"))
    return pairs.select(group, F.col(f"a_{pos}").alias("a"), F.col(f"b_{pos}").alias("b"), metric.alias("ratio")).where(F.col("ratio") > threshold)


def nearest_links(points: DataFrame, group: str, idx: str, x: str, y: str) -> DataFrame:
    """(group, idx, up, down, left, right): the nearest other point of each direction.

    The score is the distance along the direction plus half of that across; the smallest index
    wins a tie, and 0 stands for none.
    """
    a = points.select(group, F.col(idx).alias("idx"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    b = points.select(group, F.col(idx).alias("_to"), F.col(x).alias("_bx"), F.col(y).alias("_by"))
    dx, dy = F.col("_bx") - F.col("_x"), F.col("_by") - F.col("_y")
    pairs = a.join(b, group).where((F.col("idx") != F.col("_to")))
    best = lambda cond, along, across: F.min(F.when(cond, F.struct((F.abs(along) + 0.5 * F.abs(across)).alias("s"), "_to")))["_to"]
    links = pairs.groupBy(group, "idx").agg(best(dy < 0, dy, dx).alias("up"), best(dy > 0, dy, dx).alias("down"), best(dx < 0, dx, dy).alias("left"), best(dx > 0, dx, dy).alias("right"))
    out = a.select(group, "idx").join(links, [group, "idx"], "left")
    return out.select(group, "idx", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("up", "down", "left", "right")])


def broken_links(links: DataFrame, group: str) -> DataFrame:
    """(group, idx, direction, target) of the links, 0 aside, whose target is no index of the group."""
    flat = links.select(group, "idx", F.explode(F.create_map(*[x for d in ("up", "down", "left", "right") for x in (F.lit(d), F.col(d))])).alias("direction", "target")).where("target <> 0")
    known = links.select(group, F.col("idx").alias("target"))
    return flat.join(known, [group, "target"], "left_anti").select(group, "idx", "direction", "target")


def best_line(rects: DataFrame, lines: DataFrame, group: str, pos: str, line_pos: str, least_overlap: int = 40) -> DataFrame:
    """For each rectangle (x1, y1, x2, y2) the text line (lx1, ly1, lx2, ly2) of its group that
    shares at least ``least_overlap`` pixels of width and is nearest by centre; delta is how far
    down the line is."""
    pairs = rects.join(lines, group).where(F.least("x2", "lx2") - F.greatest("x1", "lx1") >= least_overlap)
    delta = (F.col("ly1") + F.col("ly2")) / 2.0 - (F.col("y1") + F.col("y2")) / 2.0
    best = pairs.groupBy(group, pos).agg(F.min_by(F.struct(F.col(line_pos).alias("line"), delta.alias("delta")), F.struct(F.abs(delta), line_pos)).alias("_b"))
    return best.select(group, pos, "_b.line", "_b.delta")


def consensus_shift(best: DataFrame, group: str, least_rows: int = 3, low: float = 4, high: float = 40) -> DataFrame:
    """The common shift of a group: the median of its deltas if there are enough and it is neither
    negligible nor implausible, else 0."""
    shift = F.percentile("delta", 0.5)
    return best.groupBy(group).agg(F.when((F.count("*") >= least_rows) & F.abs(shift).between(low, high), shift).otherwise(0.0).alias("shift"))


# --- aggregates ----------------------------------------------------------------------------------


def upper_median(value: str) -> Column:
    """The element at index n // 2 of the sorted values."""
    return F.element_at(F.array_sort(F.collect_list(value)), (F.floor(F.count(value) / 2) + 1).cast("int"))


def rank_edge(value: str, third: int) -> Column:
    """The element at index third * n // 3 of the sorted values."""
    return F.element_at(F.array_sort(F.collect_list(value)), (F.floor(F.count(value) * third / 3) + 1).cast("int"))


def envelope(df: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """The range of a group's known ranges, the list of them, and whether slicing is possible:
    with any end missing, ``ranges`` is null."""
    known = F.col(low).isNotNull() & F.col(high).isNotNull()
    return df.groupBy(group).agg(
        F.min(F.when(known, F.col(low))).alias("first"),
        F.max(F.when(known, F.col(high))).alias("last"),
        F.when(F.bool_or(~known), F.lit(None)).otherwise(F.count("*")).alias("ranges"),
    )


def signature_dedup(df: DataFrame, signature: list[str], pos: str) -> DataFrame:
    """One row a signature: a dense id in order of first occurrence, that place, all places, count."""
    found = df.groupBy(*signature).agg(F.min(pos).alias("first_pos"), F.array_sort(F.collect_list(pos)).alias("positions"), F.count("*").alias("n"))
    return numbered(found, "first_pos", "config_id")


def numbered(df: DataFrame, order: str, out: str, cells: int = 1024) -> DataFrame:
    """``out``: 1, 2, ... by a numeric column over the whole table, without one task for all: rows are
    numbered within ``cells`` equal ranges of the column, after the rows of the ranges before."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    width = (high - low) / cells or 1
    placed = df.withColumn("_cell", F.least(F.lit(cells - 1), F.floor((F.col(order) - F.lit(low)) / F.lit(width))))
    before = placed.groupBy("_cell").agg(F.count("*").alias("_c"))
    before = before.select("_cell", (F.sum("_c").over(Window.orderBy("_cell")) - F.col("_c")).alias("_before"))  # at most ``cells`` rows
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(order))
    return placed.join(F.broadcast(before), "_cell").withColumn(out, (rank + F.col("_before")).cast("int")).drop("_cell", "_before")


def union_edges(edges: DataFrame, keys: list[str], target: str, version: str) -> DataFrame:
    """One edge per key, the one written last."""
    return edges.groupBy(*keys).agg(F.max_by(target, version).alias(target))


def histogram_cut(df: DataFrame, group: str, bin_col: str, share: float) -> DataFrame:
    """The smallest bin of a group at which the running count reaches ``share`` of its rows."""
    bins = df.groupBy(group, bin_col).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    bins = bins.withColumn("_cum", F.sum("_n").over(w.orderBy(bin_col))).withColumn("_all", F.sum("_n").over(w))
    return bins.where(F.col("_cum") >= share * F.col("_all")).groupBy(group).agg(F.min(bin_col).alias("cut"))


def weighted_peak(df: DataFrame, group: str, bin_col: str, weight: Column) -> DataFrame:
    """The bin of a group with the greatest summed weight, the smallest on a tie."""
    bins = df.groupBy(group, bin_col).agg(F.sum(weight).alias("_w"))
    return bins.groupBy(group).agg(F.max_by(bin_col, F.struct(F.col("_w"), -F.col(bin_col))).alias("peak"))


def iqr_bounds(value: str, k: float = 1.5) -> tuple[Column, Column, Column]:
    """(lower fence, upper fence, interquartile range) as aggregates, quartiles by interpolation."""
    q1, q3 = F.percentile(value, 0.25), F.percentile(value, 0.75)
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1), q3 - q1


def iqr_filter(df: DataFrame, group: str, first: str, second: str, least_rows: int = 6) -> DataFrame:
    """Leaves out rows that are low in both columns; only in groups of ``least_rows`` or more
    whose ranges are not 0."""
    lo1, _, r1 = iqr_bounds(first)
    lo2, _, r2 = iqr_bounds(second)
    stats = df.groupBy(group).agg(F.count("*").alias("_n"), lo1.alias("_lo1"), r1.alias("_r1"), lo2.alias("_lo2"), r2.alias("_r2"))
    active = (F.col("_n") >= least_rows) & (F.col("_r1") != 0) & (F.col("_r2") != 0)
    low = (F.col(first) < F.col("_lo1")) & (F.col(second) < F.col("_lo2"))
    return df.join(stats, group).where(~(active & low)).drop("_n", "_lo1", "_r1", "_lo2", "_r2")


def regularise_heights(df: DataFrame, group: str, y1: str, y2: str, frame_h: int, least_rows: int = 4, k: float = 1.5) -> DataFrame:
    """``new_y1`` and ``new_y2``: boxes whose height lies within the group's fences get the median
    height (half to even) about their centre, moved into the frame; others, and groups of fewer
    than ``least_rows`` or without spread, stay."""
    tall = df.withColumn("_h", F.col(y2) - F.col(y1) + 1)
    lo, hi, spread = iqr_bounds("_h", k)
    stats = tall.groupBy(group).agg(F.count("*").alias("_n"), F.bround(F.percentile("_h", 0.5)).cast("int").alias("_m"), lo.alias("_lo"), hi.alias("_hi"), spread.alias("_r"))
    both = tall.join(stats, group)
    top = F.bround((F.col(y1) + F.col(y2)) / 2.0 - (F.col("_m") - 1) / 2.0).cast("int")
    low = top + F.col("_m") - 1
    inside = (F.col("_n") >= least_rows) & (F.col("_r") != 0) & F.col("_h").between(F.col("_lo"), F.col("_hi"))
    moved = F.when(top < 0, F.lit(0)).when(low >= frame_h, F.greatest(F.lit(0), frame_h - F.col("_m"))).otherwise(top)
    end = F.when(top < 0, F.least(F.lit(frame_h - 1), F.col("_m") - 1)).when(low >= frame_h, F.lit(frame_h - 1)).otherwise(low)
    both = both.withColumn("new_y1", F.when(inside, moved).otherwise(F.col(y1))).withColumn("new_y2", F.when(inside, end).otherwise(F.col(y2)))
    return both.drop("_h", "_n", "_m", "_lo", "_hi", "_r")


def proportional(df: DataFrame, group: str, size: str, total: str, order: list, out: str) -> DataFrame:
    """Each row's share of its group's ``total`` in proportion to ``size``, and where it starts."""
    w = Window.partitionBy(group)
    share = F.col(size) / F.sum(size).over(w) * F.col(total)
    df = df.withColumn(out, share)
    return df.withColumn("offset", F.sum(out).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(out))


def verify_durations(df: DataFrame, expected: str, actual: str, tolerance: float) -> DataFrame:
    """delta, within and status (missing, error, ok, mismatch): a null actual was not there, a
    negative one could not be read."""
    if tolerance < 0:
        raise ValueError("a tolerance is not negative")
    there = F.col(actual).isNotNull() & (F.col(actual) >= 0)
    delta = F.when(there, F.col(actual) - F.col(expected))
    status = F.when(F.col(actual).isNull(), "missing").when(F.col(actual) < 0, "error").when(F.abs(delta) <= tolerance, "ok").otherwise("mismatch")
    return df.withColumn("delta", delta).withColumn("status", status).withColumn("within", F.when(there, F.abs(delta) <= tolerance))


def page_assignment(buttons: DataFrame, seen: DataFrame, group: str, button: str, page: str, state: str, index: str, total: Column, pages: Column) -> DataFrame:
    """The page of each button: seen on some page, the first of them; known but not seen, the last
    page of the group; unknown, by its index in equal parts, the last part taking the rest."""
    first = seen.groupBy(group, button).agg(F.min(page).alias("_first"))
    last = seen.groupBy(group).agg(F.max(page).alias("_last"))
    per = F.greatest(F.lit(1), F.floor(total / pages))
    by_index = F.least(pages - 1, F.floor(F.col(index) / per)).cast("long")
    out = buttons.join(first, [group, button], "left").join(last, group, "left")
    return out.withColumn("page", F.when(F.col("_first").isNotNull(), F.col("_first")).when(F.col(state) == "known", F.coalesce("_last", F.lit(0))).otherwise(by_index)).drop("_first", "_last")


# --- orders --------------------------------------------------------------------------------------


def stride_sample(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """Every k-th row of a group with k = max(1, n // cap), at most ``cap`` of them."""
    w = Window.partitionBy(group)
    df = df.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_stride", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / cap)))
    kept = df.where(F.col("_rn") % F.col("_stride") == 0).withColumn("pick", (F.col("_rn") / F.col("_stride")).cast("int"))
    return kept.where(F.col("pick") < cap).drop("_rn", "_stride")


def top_k(df: DataFrame, group: str, by: list, k: int, position: list) -> DataFrame:
    """The first ``k`` of a group by one order, numbered by another."""
    kept = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("_rank") <= k)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*position))).drop("_rank")


def longest_last(df: DataFrame, group: str, value: str, size: str, pos: str) -> DataFrame:
    """The largest of a group's candidates, the last of equals."""
    return df.groupBy(group).agg(F.max_by(value, F.struct(size, pos)).alias(value))


def column_major(df: DataFrame, group: str, x: str, y: str, tie: str) -> DataFrame:
    """``pos`` in column order: left of or at the upper median of x first, each column downwards.
    Where x spreads by less than 40 the order is by rows."""
    stats = df.groupBy(group).agg(upper_median(x).alias("_m"), (F.max(x) - F.min(x)).alias("_spread"))
    both = df.join(stats, group)
    flat = F.col("_spread") < 40
    column = F.when(flat, F.lit(0)).otherwise((F.col(x) > F.col("_m")).cast("int"))
    order = Window.partitionBy(group).orderBy(column, F.col(y), F.when(flat, F.col(x)), F.col(tie))
    return both.withColumn("pos", F.row_number().over(order)).drop("_m", "_spread")


def header_first(df: DataFrame, group: str, x1: str, y1: str, x2: str, frame_w: int, frame_h: int, tie: str) -> DataFrame:
    """``pos``: the header first, then the boxes centred left of the frame's middle, then the others,
    each column downwards. The header is one box at most: of those at least 0.6 of the frame wide
    that begin in its top 0.3, the highest, of these the widest."""
    wide = (F.col(x2) - F.col(x1) + 1 >= 0.6 * frame_w) & (F.col(y1) < 0.3 * frame_h)
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.when(wide, 0).otherwise(1), y1, F.desc(F.col(x2) - F.col(x1)), tie)) == 1
    bucket = F.when(wide & first, 0).when((F.col(x1) + F.col(x2)) / 2 < frame_w // 2, 1).otherwise(2)
    return df.withColumn("bucket", bucket).withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("bucket", y1, x1, tie)))


def choose_order(df: DataFrame) -> DataFrame:
    """row or col for rows of (graph_ok, dist_row, dist_col, score_row, score_col): the link graph
    if it works; a path shorter by a tenth; the smaller displacement; rows."""
    by_score = F.when(F.col("score_row").isNull() & F.col("score_col").isNull(), "row").when(F.col("score_row").isNull(), "col").when(F.col("score_col").isNull(), "row").when(F.col("score_row") <= F.col("score_col"), "row").otherwise("col")
    paths = (F.col("dist_row") > 0) & (F.col("dist_col") > 0)
    choice = F.when(F.col("graph_ok"), "graph").when(paths & (F.col("dist_col") <= F.col("dist_row") * 0.9), "col").when(paths & (F.col("dist_row") <= F.col("dist_col") * 0.9), "row").otherwise(by_score)
    return df.withColumn("choice", choice)


def best_candidate(df: DataFrame, key: str, name: str, text: str, quality: str, pos: str) -> DataFrame:
    """The label candidate of each key: highest quality, then longest, then first, ``hue`` never;
    then a ``spu_*`` one instead if its quality is within 0.01 and its length within 2."""
    ranked = df.where(F.col(name) != "hue")
    order = F.struct((-F.col(quality)).alias("q"), (-F.length(text)).alias("l"), F.col(pos))
    row = F.struct(name, text, quality, pos)
    best = ranked.groupBy(key).agg(F.min_by(row, order).alias("_best"), F.min_by(F.when(F.col(name).startswith("spu_"), row), F.when(F.col(name).startswith("spu_"), order)).alias("_spu"))
    close = (F.col(f"_best.{quality}") - F.col(f"_spu.{quality}") <= 0.01) & (F.abs(F.length(f"_best.{text}") - F.length(f"_spu.{text}")) <= 2)
    chosen = F.when(F.coalesce(close, F.lit(False)), F.col("_spu")).otherwise(F.col("_best"))
    return best.withColumn("_c", chosen).select(key, f"_c.{name}", f"_c.{text}", f"_c.{quality}")
