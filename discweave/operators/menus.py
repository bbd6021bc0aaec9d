"""Operators on menus: routing, candidate sources, densities, text bands and text lines of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discweave.functions import text
from discweave.operators import folds
from discweave.operators import windows as win

# Names of menu domains and of the files that hold them.
ROOT_FILE, ROOT_MENU, TITLE_MENUS, ROOT_MENUS = "VIDEO_TS.VOB", "dvd_root", "VTSM", "VMGM"
MENU_FILE = r"^VTS_.*_0\.VOB$"


def is_candidate(menu_id: Column, rect: Column) -> Column:
    """A button that may lead to a title's chains: of a title set's menu, and with a rectangle."""
    return F.coalesce(F.upper(menu_id).startswith(TITLE_MENUS), F.lit(False)) & rect.isNotNull()


def menu_file(menu_id: Column) -> Column:
    """The file a menu lies in by its name; null if the name does not tell."""
    base = text.menu_base(menu_id)
    number = F.try_element_at(F.split(base, "_"), F.lit(2))
    titled = F.upper(base).startswith(TITLE_MENUS) & number.rlike(r"^\d+$")
    root = F.upper(base).startswith(ROOT_MENUS) | (base == ROOT_MENU)
    return F.when(titled, F.concat(F.lit("VTS_"), number, F.lit("_0.VOB"))).when(root, F.lit(ROOT_FILE))


def route_menus(menus: DataFrame, files: DataFrame, disc: str, menu_id: str, name: str) -> DataFrame:
    """``menus`` with ``file``: the one its name says if the disc has it, else the disc's root menu
    file, else the first menu file of a title set, else null."""
    have = files.select(disc, F.col(name).alias("file")).distinct()
    rest = files.groupBy(disc).agg(F.max(F.when(F.col(name) == ROOT_FILE, F.col(name))).alias("_root"), F.min(F.when(F.col(name).rlike(MENU_FILE), F.col(name))).alias("_first"))
    named = menus.withColumn("_file", menu_file(F.col(menu_id)))
    found = named.join(have, (named[disc] == have[disc]) & (named["_file"] == have["file"]), "left").drop(have[disc])
    return found.join(rest, disc, "left").withColumn("file", F.coalesce("file", "_root", "_first")).drop("_file", "_root", "_first")


def first_source(found: DataFrame, group: str, priority: str) -> DataFrame:
    """The rows of the source of least priority number that found anything for a group."""
    best = found.groupBy(group).agg(F.min(priority).alias(priority))
    return found.join(best, [group, priority])


def or_fixture(rows: DataFrame, kinds: DataFrame, fixture: list[dict], key: str, kind: str) -> DataFrame:
    """``rows``, and for every ``key`` of an UNKNOWN ``kind`` those of ``fixture``, a few, in their place."""
    unknown = kinds.where(F.col(kind) == "UNKNOWN").select(key)
    made = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in fixture])).alias("_f")
    fields = [F.col(f"_f.{c}").cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != key]
    return rows.join(unknown, key, "left_anti").unionByName(unknown.select(key, made).select(key, *fields))


def densities(df: DataFrame, key: str, cells: str, width: int, threshold: float, axis: str) -> DataFrame:
    """(key, row or column, density): the share of a row's or column's cells over ``threshold``."""
    flat = df.select(key, F.posexplode(cells).alias("_pos", "_v"))
    line = F.floor(F.col("_pos") / width) if axis == "row" else F.col("_pos") % width
    return flat.groupBy(key, line.cast("int").alias(axis)).agg(F.avg((F.col("_v") > threshold).cast("double")).alias("density"))


def crop(cells: Column, width: int, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The cells of a box out of a row-major array; null where the array ends before, or is null."""
    return F.transform(F.sequence(F.lit(0), w * h - 1), lambda k: F.get(cells, ((y + F.floor(k / w)) * width + x + k % w).cast("int")))


def best_offset(df: DataFrame, key: str, cells: str, width: int, template: str, template_width: int, step: int = 2) -> DataFrame:
    """(key, x, y, score): where a template lies best in a grid, by the mean absolute difference at
    every ``step``-th offset; the first of equals by row. Templates that do not fit give nothing."""
    size = lambda c, w: F.floor(F.size(c) / w).cast("int")
    room = df.withColumn("_h", size(template, template_width)).withColumn("_down", size(cells, width) - F.col("_h"))
    room = room.where((F.col("_down") > 0) & F.lit(width > template_width))
    offsets = room.withColumn("y", F.explode(F.sequence(F.lit(0), "_down", F.lit(step)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - template_width), F.lit(step))))
    patch = crop(F.col(cells), width, F.col("x"), F.col("y"), F.lit(template_width), F.col("_h"))
    apart = F.aggregate(F.zip_with(patch, template, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size(template)
    scored = offsets.withColumn("score", apart)
    return scored.groupBy(key).agg(F.min(F.struct("score", "y", "x")).alias("_b")).select(key, "_b.x", "_b.y", "_b.score")


# --- text bands of a page ------------------------------------------------------------------------

# What a band of text measures.
BAND_LEAST, BAND_MOST, WIDE_SPAN, SPAN, ENOUGH_ROWS, ENOUGH_BANDS, LEFT_PAD = 6, 120, 0.6, 0.4, 8, 10, 8


def text_bands(rows: DataFrame, page: str, width: int, height: int) -> DataFrame:
    """Full-width text bands (page, x1, y1, x2, y2) of bitmaps, from their rows (page, y, filled, min_x,
    max_x; the last two null where nothing is filled).

    Rows much fuller than a page's mean are islands at most two apart. Islands of a plausible
    height, clear of the margins, are padded; those that span enough of the width and are not
    twice as high as the upper median stay; missing ones are put in (:func:`windows.fill_missing`),
    and all get the upper median height.
    """
    top, bottom = win.margins(height)
    every = Window.partitionBy(page)
    both = rows.withColumn("_r", F.col("filled") / float(width)).withColumn("_mean", F.avg("_r").over(every)).withColumn("_sigma", F.stddev_pop("_r").over(every))
    both = both.withColumn("_strong", F.col("_r") >= F.greatest(F.col("_mean") + F.col("_sigma"), F.lit(0.01))).withColumn("_hits", F.sum(F.col("_strong").cast("int")).over(every))
    both = both.withColumn("_on", F.when(F.col("_hits") >= ENOUGH_ROWS, F.col("_strong")).otherwise(F.col("_r") >= F.greatest(F.col("_mean") + 0.5 * F.col("_sigma"), F.lit(0.005))))
    order = every.orderBy("y")
    last = F.last(F.when(F.col("_on"), F.col("y")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_new", F.when(F.col("_on") & (last.isNull() | (F.col("y") > last + 2)), 1).otherwise(0))
    both = both.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(page, "_island")
    for name, end in (("y1", F.min), ("y2", F.max)):
        both = both.withColumn(name, end(F.when(F.col("_on"), F.col("y"))).over(island))
    bands = both.where(F.col("y").between(F.col("y1"), F.col("y2"))).groupBy(page, "_island", "y1", "y2").agg(F.min("min_x").alias("_a"), F.max("max_x").alias("_b"))
    tall = F.col("y2") - F.col("y1") + 1
    bands = bands.where(tall.between(BAND_LEAST, BAND_MOST) & (F.col("y1") > top) & (F.col("y2") < height - bottom) & (F.col("_b") > F.col("_a")))
    up, down = F.greatest(F.lit(3), F.floor(tall * 0.4).cast("int")), F.greatest(F.lit(6), tall)
    bands = bands.select(page, F.greatest(F.lit(top), F.col("y1") - up).alias("y1"), F.least(F.lit(height - 1), F.col("y2") + down).alias("y2"), "_a", ((F.col("_b") - F.col("_a") + 1) / float(width)).alias("_span"))
    bands = bands.withColumn("_h", F.col("y2") - F.col("y1") + 1).withColumn("_m", win.upper_median("_h", page)).where(F.col("_h") <= 2 * F.col("_m"))
    bands = bands.withColumn("_wide", F.sum((F.col("_span") >= WIDE_SPAN).cast("int")).over(every))
    kept = bands.where(F.col("_span") >= F.when(F.col("_wide") >= ENOUGH_BANDS, WIDE_SPAN).otherwise(SPAN))
    kept = kept.select(page, F.greatest(F.lit(0), F.col("_a") - LEFT_PAD).alias("x1"), "y1", F.lit(width - 1).alias("x2"), "y2")
    return same_height(win.fill_missing(kept, page, 7, ENOUGH_BANDS - 1, 0, height).drop("made"), page, width, height)


def same_height(bands: DataFrame, page: str, width: int, height: int) -> DataFrame:
    """Bands of the upper median height about their centres, between the margins, two rows more above."""
    top, bottom = win.margins(height)
    least, most = top, height - 1 - bottom
    rows = bands.withColumn("_h", F.col("y2") - F.col("y1") + 1).withColumn("_m", win.upper_median("_h", page))
    half = F.greatest(F.lit(1), F.floor(F.col("_m") / 2).cast("int"))
    rows = rows.withColumn("_a", F.bround((F.col("y1") + F.col("y2")) / 2.0 - half).cast("int"))
    rows = rows.withColumn("_a", F.col("_a") - F.greatest(F.lit(0), F.col("_a") + F.col("_m") - 1 - most))
    rows = rows.withColumn("_a", F.col("_a") + F.greatest(F.lit(0), least - F.col("_a"))).withColumn("_b", F.least(F.lit(most), F.col("_a") + F.col("_m") - 1))
    rows = rows.withColumn("_a", F.greatest(F.lit(least), F.col("_a") - 2))
    return rows.where("_b > _a").select(page, "x1", F.col("_a").alias("y1"), F.lit(width - 1).alias("x2"), F.col("_b").alias("y2"))


# --- lines of text boxes -------------------------------------------------------------------------


def text_lines(boxes: DataFrame, page: str, tolerance: float = 10, least_boxes: int = 20, least_width: int = 250, least_height: int = 10, most_height: int = 40, least_aspect: float = 10.0,
               pads: tuple[int, int, int, int] = (10, 10, 80, 10), trim: bool = False, gap: int = 120, side_width: int = 160, side_x: int = 220, main_width: int = 220) -> DataFrame:
    """Boxes of characters (page, pos, x1, y1, x2, y2) put together into boxes of lines.

    A line is what lies within ``tolerance`` of its first box's top (:func:`folds.anchored_lines`).
    Lines of fewer than ``least_boxes`` go. With ``trim`` a line is cut at gaps over ``gap``; a narrow
    first part near the left edge is left off if the last part is broad, else a narrow last part
    is. What has the size and shape of a line is padded (left, top, right, bottom).
    """
    lines = folds.anchored_lines(boxes, page, "y1", "x1", "pos", tolerance).select(page, "pos", "line")
    rows = boxes.join(lines, [page, "pos"])
    order = Window.partitionBy(page, "line").orderBy("x1", "y1", "pos")
    cut = F.when(F.col("x1") - F.lag("x2").over(order) > gap, 1).otherwise(0)
    rows = rows.withColumn("_cut", cut).withColumn("_part", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    box = F.struct(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    parts = rows.groupBy(page, "line", "_part").agg(F.count("*").alias("n"), box.alias("b"))
    whole = parts.groupBy(page, "line").agg(
        F.sum("n").alias("n"), F.count("*").alias("parts"), F.min_by("b", "_part").alias("first"), F.max_by("b", "_part").alias("final"),
        F.struct(F.min("b.x1").alias("x1"), F.min("b.y1").alias("y1"), F.max("b.x2").alias("x2"), F.max("b.y2").alias("y2")).alias("all"))
    broad = lambda c: F.col(f"{c}.x2") - F.col(f"{c}.x1")
    side = F.lit(trim) & (F.col("parts") >= 2)
    no_left = side & (broad("first") <= side_width) & (F.col("first.x2") <= side_x) & (broad("final") >= main_width)
    chosen = whole.where(F.col("n") >= least_boxes).withColumn("r", F.when(no_left, F.col("final")).when(side & (broad("final") <= side_width), F.col("first")).otherwise(F.col("all")))
    w, h = broad("r"), F.col("r.y2") - F.col("r.y1")
    fits = (w >= least_width) & h.between(least_height, most_height) & (F.when(h > 0, w / h).otherwise(0.0) >= least_aspect)
    left, top, right, low = pads
    return chosen.where(fits).select(page, "line", F.greatest(F.lit(0), F.col("r.x1") - left).alias("x1"), F.greatest(F.lit(0), F.col("r.y1") - top).alias("y1"), (F.col("r.x2") + right).alias("x2"), (F.col("r.y2") + low).alias("y2"))


# --- accuracy reports ----------------------------------------------------------------------------


def upsert(known: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``known`` with the rows of ``fresh`` in place of those of the same key, or added."""
    return known.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def variant_picks(scores: DataFrame, button: str, margin: float = 0.01) -> DataFrame:
    """(button, best, best_sim, safe, safe_sim) of rows (button, name, sim, len, pos).

    ``best``: the variant of highest likeness, then longest, then first. ``safe``: ``primary`` (0
    where it lacks), unless another one, ``hue`` aside, is better by more than ``margin``; then the
    best of these.
    """
    better = lambda *c: F.struct(*c, -F.col("pos"))
    primary = scores.where("name = 'primary'").groupBy(button).agg(F.max("sim").alias("_p"))
    rows = scores.join(primary, button, "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    ahead = (F.col("name") != "hue") & (F.col("sim") > F.col("_p") + margin)
    key = better("sim", "len")
    out = rows.groupBy(button).agg(F.max_by("name", key).alias("best"), F.max_by("sim", key).alias("best_sim"), F.max_by(F.when(ahead, F.col("name")), F.when(ahead, key)).alias("_safe"), F.max(F.when(ahead, F.col("sim"))).alias("_sim"), F.max("_p").alias("_p"))
    return out.select(button, "best", "best_sim", F.coalesce("_safe", F.lit("primary")).alias("safe"), F.coalesce("_sim", "_p").alias("safe_sim"))
