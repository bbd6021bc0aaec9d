"""Detectors on decoded frames: row-major arrays of levels from 0 to 255, one row of the table a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discweave.operators import folds
from discweave.sources import bytes as disc

# Weights of red, green and blue in a grey level, of 65,536.
RED, GREEN, BLUE = 19595, 38470, 7471
# Mean difference of a moving menu, level of a changed cell, shares of the frame a box takes.
MOVING, CHANGED, LEAST_SHARE, MOST_SHARE, SAME_BOX = 5.0, 20, 0.005, 0.5, 0.9
# The side, step, level and dark share of a thumbnail's core, where it is looked for
# (left, right, top, margin below), and what is put around it.
CORE, STEP, DARK, DARK_SHARE = 60, 10, 60, 0.75
AREA = (80, 320, 50, 80)
AROUND, ABOVE = 40, 30


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not for every element of a lambda within."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grey(cells: Column) -> Column:
    """Levels of interleaved red, green and blue."""
    def levels(c: Column) -> Column:
        at = lambda i, k: F.element_at(c, (i * 3 + k + 1).cast("int")).cast("long")
        level = lambda i: F.shiftright(at(i, 0) * RED + at(i, 1) * GREEN + at(i, 2) * BLUE + 32768, 16).cast("int")
        return F.when(F.size(c) < 3, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 3).cast("int") - 1), level))

    return bound(cells, levels)


def contrast(cells: Column) -> Column:
    """Levels spread over 0 to 255; a frame of one level stays."""
    def spread(ends: Column) -> Column:
        scale = F.lit(255.0) / (ends["high"] - ends["low"])
        level = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v * scale + -ends["low"] * scale).cast("int")))
        return F.when(ends["high"] > ends["low"], F.transform(cells, level)).otherwise(cells.cast("array<int>"))

    return bound(F.struct(F.array_min(cells).alias("low"), F.array_max(cells).alias("high")), spread)


def differences(frames: DataFrame, group: str, order: str, cells: str, coloured: bool = False, moving: float = MOVING) -> DataFrame:
    """(group, still, widest) of a group's few sampled frames: the greatest difference of every cell
    between neighbours. ``still``: no two neighbours differ by ``moving`` in the mean; a single
    frame is still, and has no ``widest``. Frames of a group have one size; a null frame is left out.
    """
    w = Window.partitionBy(group).orderBy(order)
    pairs = frames.where(F.col(cells).isNotNull()).select(group, order, cells).withColumn("_p", F.lag(cells).over(w))
    apart = F.zip_with(cells, "_p", lambda a, b: F.abs(a.cast("int") - b.cast("int")))
    pairs = pairs.withColumn("_d", F.when(F.col("_p").isNotNull(), grey(apart) if coloured else apart))
    mean = F.aggregate("_d", F.lit(0).cast("long"), lambda s, v: s + v) / F.size("_d")
    found = pairs.groupBy(group).agg(F.max(mean).alias("_m"), F.collect_list("_d").alias("_all"))
    widest = F.aggregate(F.slice("_all", 2, 1 << 30), F.try_element_at("_all", F.lit(1)), lambda s, d: F.zip_with(s, d, lambda a, b: F.greatest(a, b)))
    return found.select(group, (F.coalesce("_m", F.lit(0.0)) < moving).alias("still"), widest.alias("widest"))


def difference_boxes(found: DataFrame, group: str, width: int, expected: int, changed: int = CHANGED) -> DataFrame:
    """(group, pos, x1, y1, x2, y2): what lights up in menus that move, from :func:`differences`.

    The ``expected`` largest connected parts, those nearly within another joined to it, less what
    is tiny or half a frame; ``pos`` is the order from the top. Ties keep the scan's order.
    """
    moving = found.where(~F.col("still") & F.col("widest").isNotNull())
    cells = moving.select(group, F.transform("widest", lambda v: v > changed).alias("_on"))
    parts = disc.grid_components(cells, group, width, "_on")
    broad = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    ranked = parts.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(broad.desc(), "component"))).where(F.col("pos") <= expected)
    merged = folds.greedy_merge(ranked.select(group, "pos", "x1", "y1", "x2", "y2"), group, SAME_BOX)
    full = moving.select(group, F.size("widest").alias("_n"))
    area = (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)
    sized = merged.join(full, group).where(area.between(F.col("_n") * LEAST_SHARE, F.col("_n") * MOST_SHARE)).drop("_n")
    kept = folds.greedy_suppress(sized, group, SAME_BOX)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("y1", "x1", "pos")))


def dark_cores(frames: DataFrame, key: str, cells: str, width: int, core: int = CORE, step: int = STEP, dark: int = DARK, share: float = DARK_SHARE, area: tuple[int, int, int, int] = AREA) -> DataFrame:
    """(key, x, y, height, score): squares of side ``core`` of which more than ``share`` is darker than ``dark``.

    Cells are counted once, in tiles of side ``step`` that divides ``core``; a square is the sum
    of its tiles. Empty and null frames give nothing.
    """
    if core % step:
        raise ValueError("the step must divide the core")
    left, right, top, below = area
    reach = core // step
    flat = frames.where(F.size(cells) >= width).select(key, F.floor(F.size(cells) / width).cast("int").alias("height"), F.posexplode(cells).alias("_i", "_v")).where(F.col("_v") < dark)
    x, y = F.col("_i") % width - left, F.floor(F.col("_i") / width).cast("int") - top
    near = flat.where((x >= 0) & (x < right - left) & (y >= 0))
    tiles = near.groupBy(key, "height", F.floor(x / step).cast("int").alias("_x"), F.floor(y / step).cast("int").alias("_y")).agg(F.count("*").alias("_n"))
    back = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - (reach - 1)), F.col(c)))
    squares = tiles.select(key, "height", "_y", "_n", back("_x").alias("_cx")).select(key, "height", "_n", "_cx", back("_y").alias("_cy"))
    counted = squares.groupBy(key, "height", (F.col("_cx") * step + left).alias("x"), (F.col("_cy") * step + top).alias("y")).agg(F.sum("_n").alias("_n"))
    inside = counted.where((F.col("x") < right - core) & (F.col("y") < F.col("height") - below - core))
    seen = (F.least(F.col("x") + core, F.lit(width)) - F.col("x")) * (F.least(F.col("y") + core, F.col("height")) - F.col("y"))
    return inside.withColumn("score", F.col("_n") / seen).where(F.col("score") > share).select(key, "x", "y", "height", "score")


def dark_thumbnails(cores: DataFrame, key: str, width: int, expected: int, core: int = CORE, around: int = AROUND, above: int = ABOVE) -> DataFrame:
    """(key, pos, x1, y1, x2, y2): cores grown to thumbnails, darkest first without those a darker one
    covers by half, then the ``expected`` upper ones; ties keep the scan's order."""
    grown = cores.select(
        key, "score", (F.col("y").cast("long") * width + F.col("x")).alias("pos"),
        F.greatest(F.lit(0), F.col("x") - around).alias("x1"), F.greatest(F.lit(0), F.col("y") - above).alias("y1"),
        F.least(F.lit(width - 1), F.col("x") + core + around).alias("x2"), F.least(F.col("height") - 1, F.col("y") + core + above).alias("y2"))
    kept = folds.score_suppress(grown, key, "score", 0.5).join(grown.select(key, "pos", "score"), [key, "pos"])
    order = Window.partitionBy(key).orderBy("y1", F.col("score").desc(), "pos")
    return kept.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= expected).drop("score")
