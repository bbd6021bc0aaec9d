"""Positional computations as window functions, always within a partition key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(group: list[str], order: list, *, rows: tuple[int, int] | None = None):
    w = Window.partitionBy(*group).orderBy(*order)
    return w.rowsBetween(*rows) if rows else w


def running_offset(value: str, group: list[str], order: list) -> Column:
    """Exclusive running sum: where each row starts."""
    upto = over(group, order, rows=(Window.unboundedPreceding, 0))
    return F.sum(value).over(upto) - F.col(value)


def renumber(df: DataFrame, group: list[str], order: list, out: str = "new_id", prefix: str = "btn") -> DataFrame:
    """playback_order 1, 2, ... and the identifiers that go with it."""
    n = F.row_number().over(over(group, order))
    return df.withColumn("playback_order", n).withColumn(out, F.concat(F.lit(prefix), F.col("playback_order").cast("string")))


def path_length(df: DataFrame, group: list[str], order: list, x: str, y: str) -> DataFrame:
    """Manhattan length of the path through a group's points; 0 for one point."""
    w = over(group, order)
    step = F.abs(F.col(x) - F.lag(x).over(w)) + F.abs(F.col(y) - F.lag(y).over(w))
    return df.withColumn("_step", step).groupBy(*group).agg(F.coalesce(F.sum("_step"), F.lit(0)).alias("path"))


def rank_displacement(df: DataFrame, group: list[str], order: list, rank: str) -> DataFrame:
    """Sum of distances between the places in ``order`` and in ``rank``; null where a rank is
    missing or a group has one row."""
    placed = df.withColumn("_idx", F.row_number().over(over(group, order))).withColumn("_rank", F.row_number().over(over(group, [F.col(rank).asc_nulls_last(), *order])))
    ok = (F.count("*") >= 2) & (F.count(rank) == F.count("*"))
    return placed.groupBy(*group).agg(F.when(ok, F.sum(F.abs(F.col("_rank") - F.col("_idx")))).alias("displacement"))


def min_spread_window(df: DataFrame, group: list[str], value: str, tie: list, size: int) -> DataFrame:
    """The ``size`` consecutive rows by ``value`` whose last and first differ least, the first such
    window on a tie; groups of ``size`` rows and fewer stay whole."""
    order = [F.col(value), *tie]
    w, all_rows = over(group, order), Window.partitionBy(*group)
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count("*").over(all_rows))
    df = df.withColumn("_spread", F.lead(value, size - 1).over(w) - F.col(value))
    best = F.min(F.when(F.col("_spread").isNotNull(), F.struct("_spread", "_rn"))).over(all_rows)["_rn"]
    kept = df.withColumn("_from", F.when(F.col("_n") > size, best).otherwise(F.lit(1)))
    return kept.where((F.col("_rn") >= F.col("_from")) & (F.col("_rn") < F.col("_from") + size)).drop("_rn", "_n", "_spread", "_from")


def best_group(df: DataFrame, parent: str, group: str, size: int, first: str, second: str) -> DataFrame:
    """(parent, group) of exactly ``size`` rows with the least spreads of two columns, in that
    order; the smallest group name on a tie."""
    spread = lambda c: F.max(c) - F.min(c)
    groups = df.groupBy(parent, group).agg(F.count("*").alias("n"), spread(first).alias("a"), spread(second).alias("h")).where(F.col("n") == size)
    return groups.groupBy(parent).agg(F.min_by(group, F.struct("a", "h", group)).alias(group), F.min(F.struct("a", "h", group))["a"].alias("spread"))


def moving_average(value: str, group: list[str], order: list, reach: int) -> Column:
    """Centred mean over ``reach`` rows on either side, cut off at the ends."""
    return F.avg(value).over(over(group, order, rows=(-reach, reach)))


def projection(boxes: DataFrame, group: str, x1: str, x2: str, height: str, width: int) -> DataFrame:
    """(group, x, density) for every x of a frame: the summed height of the boxes over it.

    A difference array and a running sum, so a box costs two rows however wide it is.
    """
    low = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col(x1)))
    high = F.greatest(low, F.least(F.lit(width - 1), F.col(x2)))
    tall = F.greatest(F.lit(1), F.col(height))
    steps = boxes.select(group, F.explode(F.array(F.struct(low.alias("x"), tall.alias("d")), F.struct((high + 1).alias("x"), (-tall).alias("d")))).alias("s")).select(group, "s.x", "s.d")
    grid = boxes.select(group).distinct().select(group, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    changes = steps.groupBy(group, "x").agg(F.sum("d").alias("d"))
    both = grid.join(changes, [group, "x"], "left")
    return both.select(group, "x", F.sum(F.coalesce("d", F.lit(0))).over(over([group], ["x"], rows=(Window.unboundedPreceding, 0))).alias("density"))


def deepest_valley(profile: DataFrame, group: str, x: str, v: str, low: int, high: int) -> DataFrame:
    """The lowest point of a profile between ``low`` and ``high`` (the first on a tie), the peaks on
    its sides, its depth relative to the higher one, the density on each side, and the width of
    the stretch around it within 5 % of the peak.

    A group's profile, a value for each column of a frame, is one sorted array; what is sought is
    found by passes over it."""
    rows = profile.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(v).cast("double").alias("v")))).alias("_all"))
    rows = rows.withColumn("_in", F.filter("_all", lambda r: r["x"].between(low, high)))
    rows = rows.withColumn("_low", F.array_min(F.transform("_in", lambda r: F.struct(r["v"], r["x"]))))
    rows = rows.where("_low IS NOT NULL").withColumn("valley_x", F.col("_low.x")).withColumn("valley", F.col("_low.v"))
    for name, side in (("left", lambda r: r["x"] < F.col("valley_x")), ("right", lambda r: r["x"] > F.col("valley_x"))):
        values = F.transform(F.filter("_in", side), lambda r: r["v"])
        rows = rows.withColumn(f"{name}_peak", F.coalesce(F.array_max(values), F.lit(0.0))).withColumn(f"{name}_density", F.aggregate(values, F.lit(0.0), lambda s, r: s + r))
    rows = rows.withColumn("peak", F.greatest("left_peak", "right_peak")).withColumn("depth", F.when(F.col("peak") > 0, (F.col("peak") - F.col("valley")) / F.col("peak")))
    # the plateau is what lies between the nearest points above the tolerance on either side
    rows = rows.withColumn("_high", F.filter("_all", lambda r: r["v"] > F.col("valley") + F.col("peak") * 0.05))
    xs = lambda array, keep: F.transform(F.filter(array, keep) if keep else F.col(array), lambda r: r["x"])
    left = F.coalesce(F.array_max(xs("_high", lambda r: r["x"] < F.col("valley_x"))), F.array_min(xs("_all", None)) - 1)
    right = F.coalesce(F.array_min(xs("_high", lambda r: r["x"] > F.col("valley_x"))), F.array_max(xs("_all", None)) + 1)
    return rows.withColumn("gutter", right - left - 1).drop("_all", "_in", "_low", "_high")


def gutter(valleys: DataFrame, min_depth: float = 0.6, min_width: int = 20, min_balance: float = 0.25) -> DataFrame:
    """``gutter_x``: where a valley parts two columns, null where it does not."""
    balance = F.when((F.col("left_density") > 0) & (F.col("right_density") > 0), F.least("left_density", "right_density") / F.greatest("left_density", "right_density")).otherwise(0.0)
    enough = (F.col("left_density") >= F.col("peak") * 3) & (F.col("right_density") >= F.col("peak") * 3)
    ok = (F.col("peak") > 0) & (F.col("depth") >= min_depth) & (F.col("gutter") >= min_width) & enough & (balance >= min_balance)
    return valleys.withColumn("gutter_x", F.when(ok, F.col("valley_x")))


def islands(df: DataFrame, group: list[str], order: list, starts: Column, out: str = "island") -> DataFrame:
    """``out`` numbers, from 1, the stretches that begin wherever ``starts`` holds."""
    return df.withColumn(out, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(over(group, order, rows=(Window.unboundedPreceding, 0))))


def int_islands(df: DataFrame, group: str, value: str, gap: int = 2) -> DataFrame:
    """(group, island, first, last, n): distinct integers at most ``gap`` apart."""
    points = df.select(group, value).where(F.col(value).isNotNull()).distinct()
    starts = F.col(value) - F.lag(value).over(over([group], [value])) > gap
    return islands(points, [group], [value], starts).groupBy(group, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n"))


def bands(df: DataFrame, group: str, order: list, value: str, threshold: float, pos: str, least: int) -> DataFrame:
    """Stretches of ``least`` rows or more above a threshold: (group, first, last, n)."""
    above = df.withColumn("_above", F.col(value) > threshold)
    starts = F.col("_above") != F.lag("_above").over(over([group], order))
    runs = islands(above, [group], order, starts).where("_above")
    return runs.groupBy(group, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def split_tall(df: DataFrame, first: str, last: str, most: int) -> DataFrame:
    """Bands taller than ``most`` in equal parts of at most that."""
    size = F.col(last) - F.col(first) + 1
    parts = F.ceil(size / most).cast("int")
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("_n", parts).withColumn("_size", size).withColumn("_first", F.col(first))
    edge = lambda k: F.col("_first") + F.floor(F.col("_size") * k / F.col("_n")).cast("int")
    return out.withColumn(first, edge(F.col("_k"))).withColumn(last, edge(F.col("_k") + 1) - 1).withColumn("part", F.col("_k")).drop("_k", "_n", "_size", "_first")


def gap_groups(df: DataFrame, group: list[str], order: list, low: Column, previous_high: str, gap: float, out: str = "part") -> DataFrame:
    """New part wherever a row begins more than ``gap`` after the end of the one before."""
    return islands(df, group, order, low - F.lag(previous_high).over(over(group, order)) > gap, out)


def max_gap_split(df: DataFrame, group: str, value: str, tie: list) -> DataFrame:
    """(group, split, gap): the middle of the widest gap between neighbours, the first on a tie."""
    w = over([group], [F.col(value), *tie])
    gaps = df.withColumn("_gap", F.lead(value).over(w) - F.col(value)).withColumn("_mid", (F.lead(value).over(w) + F.col(value)) / 2.0).where("_gap IS NOT NULL")
    return gaps.groupBy(group).agg(F.max_by("_mid", F.struct(F.col("_gap"), -F.col("_mid"))).alias("split"), F.max("_gap").alias("gap"))


def frame_difference(frame: Column, previous: Column) -> Column:
    """Mean absolute difference of two arrays of one length; null without a previous one."""
    total = F.aggregate(F.zip_with(frame, previous, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.when(previous.isNotNull(), total / F.size(frame))


def page_segments(frames: DataFrame, group: list[str], order: list, frame: str, threshold: float) -> DataFrame:
    """``page`` numbers, from 1: a new one where a frame differs from the one before by more."""
    w = over(group, order)
    changed = frames.withColumn("diff", frame_difference(F.col(frame), F.lag(frame).over(w)))
    return islands(changed, group, order, F.col("diff").isNull() | (F.col("diff") > threshold), "page")


def variance(values: Column) -> Column:
    """Population variance of an array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double")) / n
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + (v.cast("double") - mean) * (v.cast("double") - mean)) / n


def image_similarity(a: Column, b: Column, most: float = 255.0) -> Column:
    """1 less the root mean square difference over ``most``; 0 if the sizes differ."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(1 - F.sqrt(squares / F.size(a)) / most)


def upper_median(values: str, group: str) -> Column:
    """For every row the element at index n // 2 of its group's sorted values that are not null."""
    found = F.array_sort(F.collect_list(values).over(Window.partitionBy(group)))
    return F.try_element_at(found, (F.floor(F.size(found) / 2) + 1).cast("int"))


def margins(height: int) -> tuple[int, int]:
    """Top and bottom of a frame that bands keep clear of."""
    return max(8, int(height * 0.04)), max(24, int(height * 0.08))


def fill_missing(df: DataFrame, group: str, least: int = 7, most: int = 9, top: int = 0, height: int = 480) -> DataFrame:
    """Bands (x1, y1, x2, y2) of regular spacing with the missing ones put in, ``made`` telling which.

    Groups of ``least`` to ``most`` bands get one in the middle of every gap between centres over
    1.5 times the upper median gap, and one a median gap above the first and below the last where
    that leaves more than 1.4 of it to the frame's margin and the band ends before the other
    margin. A band made has the upper medians of x1 and x2 and of the height.
    """
    w, page = over([group], ["y1", "x1"]), Window.partitionBy(group)
    rows = df.select(group, "x1", "y1", "x2", "y2").withColumn("_c", (F.col("y1") + F.col("y2")) / 2.0).withColumn("_h", F.col("y2") - F.col("y1") + 1)
    rows = rows.withColumn("_gap", F.lead("_c").over(w) - F.col("_c")).withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("*").over(page))
    for out, of in (("_step", "_gap"), ("_tall", "_h"), ("_x1", "x1"), ("_x2", "x2")):
        rows = rows.withColumn(out, upper_median(of, group))
    above, below = margins(height)
    high, low = top + above, top + height - below
    half = F.greatest(F.lit(8), F.floor(F.col("_tall") / 2).cast("int"))

    def band(when: Column, at: Column, keep) -> Column:
        """The band made about ``at`` (cut off towards zero), or null."""
        at = at.cast("int")
        begin, end = F.greatest(F.lit(top), at - half), F.least(F.lit(top + height - 1), at + half)
        fits = F.col("_n").between(least, most) & F.coalesce(when, F.lit(False)) & keep(begin, end)
        return F.when(fits, F.struct(F.col("_x1").alias("x1"), begin.cast("int").alias("y1"), F.col("_x2").alias("x2"), end.cast("int").alias("y2"), F.lit(True).alias("made")))

    first, last, step, c = F.col("_k") == 1, F.col("_k") == F.col("_n"), F.col("_step"), F.col("_c")
    own = F.struct(*[F.col(x).cast("int").alias(x) for x in ("x1", "y1", "x2", "y2")], F.lit(False).alias("made"))
    between = band(F.col("_gap") > 1.5 * step, c + F.col("_gap") / 2.0, lambda b, e: F.lit(True))
    over_ = band(first & (c - high > 1.4 * step), c - step, lambda b, e: e < low)
    under = band(last & (low - c > 1.4 * step), c + step, lambda b, e: b > high)
    return rows.select(group, F.explode(F.array_compact(F.array(own, between, over_, under))).alias("_b")).select(group, "_b.*")
