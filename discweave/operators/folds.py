"""Operators whose result depends on the order rows are taken in.

Each is one higher-order ``aggregate`` over the sorted array of a group's rows, so it runs in
the JVM with the group as its unit: the boxes of one menu page, a few dozen rows. A group's
array is built by a map-side combining ``collect_list`` and never leaves its task. (Merging to a
fixed point has no such form; it is a grouped map.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_rows(df: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """(group, rows): the rows as structs, order columns first, sorted by them."""
    fields = [*order, *[c for c in columns if c not in order]]
    return df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))


def fold(rows: DataFrame, group: str, kind: str, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(group, item): what ``step(kept, row)`` leaves in the array of type ``kind``."""
    start = F.array().cast(f"array<{kind}>")
    return rows.select(group, F.explode(F.aggregate("rows", start, step)).alias("item"))


def _share(a: Column, b: Column) -> Column:
    """Overlap of two corner rectangles over the smaller area, pixels inclusive."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + 1)
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + 1)
    size = lambda r: (r["x2"] - r["x1"] + 1) * (r["y2"] - r["y1"] + 1)
    return w * h / F.least(size(a), size(b)).cast("double")


BOX = "struct<pos:bigint,x1:int,y1:int,x2:int,y2:int>"


def _box(r: Column) -> Column:
    return F.struct(r["pos"].cast("bigint").alias("pos"), *[r[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])


def greedy_suppress(df: DataFrame, group: str, threshold: float = 0.9) -> DataFrame:
    """Boxes (pos, x1, y1, x2, y2) in order of pos, without those that overlap a kept one by more."""
    def step(kept: Column, r: Column) -> Column:
        return F.when(F.exists(kept, lambda k: _share(k, r) > threshold), kept).otherwise(F.array_append(kept, _box(r)))

    return fold(sorted_rows(df, group, ["pos"], ["x1", "y1", "x2", "y2"]), group, BOX, step).select(group, "item.*")


def score_suppress(df: DataFrame, group: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Boxes (pos, x1, y1, x2, y2), best score first, without those of which a better one covers more
    than ``threshold`` of their own area; far edges are outside."""
    rows = df.withColumn("_rank", -F.col(score))

    def covered(k: Column, r: Column) -> Column:
        w, h = F.least(k["x2"], r["x2"]) - F.greatest(k["x1"], r["x1"]), F.least(k["y2"], r["y2"]) - F.greatest(k["y1"], r["y1"])
        return (w > 0) & (h > 0) & (w * h > threshold * (r["x2"] - r["x1"]) * (r["y2"] - r["y1"]))

    def step(kept: Column, r: Column) -> Column:
        return F.when(F.exists(kept, lambda k: covered(k, r)), kept).otherwise(F.array_append(kept, _box(r)))

    return fold(sorted_rows(rows, group, ["_rank", "pos"], ["x1", "y1", "x2", "y2"]), group, BOX, step).select(group, "item.*")


def greedy_merge(df: DataFrame, group: str, threshold: float = 0.9) -> DataFrame:
    """Boxes in order of pos; one that overlaps a merged box by more grows the first such box."""
    def step(merged: Column, r: Column) -> Column:
        numbered = F.transform(merged, lambda m, i: F.struct(i.alias("i"), (_share(m, r) > threshold).alias("hit")))
        first = F.element_at(F.filter(numbered, lambda n: n["hit"]), 1)["i"]
        grown = lambda m: F.struct(m["pos"].alias("pos"), F.least(m["x1"], r["x1"]).alias("x1"), F.least(m["y1"], r["y1"]).alias("y1"), F.greatest(m["x2"], r["x2"]).alias("x2"), F.greatest(m["y2"], r["y2"]).alias("y2"))
        hits = F.exists(merged, lambda m: _share(m, r) > threshold)
        return F.when(hits, F.transform(merged, lambda m, i: F.when(i == first, grown(m)).otherwise(m))).otherwise(F.array_append(merged, _box(r)))

    return fold(sorted_rows(df, group, ["pos"], ["x1", "y1", "x2", "y2"]), group, BOX, step).select(group, "item.*")


def dedup_by_centre(df: DataFrame, group: str, centre: str, score: str, pos: str, reach: int = 100) -> DataFrame:
    """The best-scored rows whose centres are at least ``reach`` apart: by score, each kept unless
    a kept one is nearer."""
    rows = df.select(group, (-F.col(score)).alias("rank"), F.col(pos).alias("pos"), F.col(centre).cast("double").alias("centre"))

    def step(kept: Column, r: Column) -> Column:
        near = F.exists(kept, lambda k: F.abs(k["centre"] - r["centre"]) < reach)
        return F.when(near, kept).otherwise(F.array_append(kept, F.struct(r["pos"].cast("bigint").alias("pos"), r["centre"].alias("centre"))))

    return fold(sorted_rows(rows, group, ["rank", "pos"], ["centre"]), group, "struct<pos:bigint,centre:double>", step).select(group, "item.*")


def greedy_match(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """(group, pos, match): each left box, in order, takes the unused right box it overlaps most
    (over the smaller area, more than nothing; the smallest pos on a tie); null if there is none."""
    a = sorted_rows(left, group, ["pos"], ["x1", "y1", "x2", "y2"])
    b = sorted_rows(right, group, ["pos"], ["x1", "y1", "x2", "y2"]).withColumnRenamed("rows", "others")
    rows = a.join(b, group, "left")

    def step(taken: Column, r: Column) -> Column:
        free = F.filter(F.coalesce("others", F.array().cast(f"array<{BOX}>")), lambda o: (_share(o, r) > 0) & ~F.exists(taken, lambda t: F.coalesce(t["match"] == o["pos"], F.lit(False))))
        scored = F.array_sort(F.transform(free, lambda o: F.struct((-_share(o, r)).alias("s"), o["pos"].cast("bigint").alias("pos"))))
        best = F.when(F.size(scored) > 0, F.element_at(scored, 1)["pos"])
        return F.array_append(taken, F.struct(r["pos"].cast("bigint").alias("pos"), best.alias("match")))

    b_typed = rows.withColumn("others", F.expr(f"transform(others, o -> cast(named_struct('pos', o.pos, 'x1', o.x1, 'y1', o.y1, 'x2', o.x2, 'y2', o.y2) as {BOX}))"))
    return fold(b_typed, group, "struct<pos:bigint,match:bigint>", step).select(group, "item.*")


def anchored_lines(df: DataFrame, group: str, y: str, x: str, pos: str, tolerance: float) -> DataFrame:
    """``line`` numbers, from 1: in order of (y, x), a row is on the current line while it is within
    ``tolerance`` of that line's first row."""
    rows = df.select(group, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.col(pos).cast("bigint").alias("pos"))
    kind = "struct<pos:bigint,line:int,anchor:double>"

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = F.coalesce(F.abs(r["y"] - last["anchor"]) <= tolerance, F.lit(False))
        return F.array_append(done, F.struct(r["pos"].alias("pos"), F.when(same, last["line"]).otherwise(F.coalesce(last["line"], F.lit(0)) + 1).alias("line"), F.when(same, last["anchor"]).otherwise(r["y"]).alias("anchor")))

    return fold(sorted_rows(rows, group, ["y", "x", "pos"], []), group, kind, step).select(group, "item.*")


def first_fit_rows(df: DataFrame, group: str, centre: str, sort: list[str], pos: str, tolerance: float) -> DataFrame:
    """``line``: the first line whose first member's centre is within ``tolerance``, else a new one."""
    rows = df.select(group, *[F.col(c).alias(f"s{i}") for i, c in enumerate(sort)], F.col(pos).cast("bigint").alias("pos"), F.col(centre).cast("double").alias("c"))
    kind = "struct<pos:bigint,line:int,anchor:double>"

    def step(done: Column, r: Column) -> Column:
        fits = F.array_min(F.transform(F.filter(done, lambda d: F.abs(d["anchor"] - r["c"]) <= tolerance), lambda d: d["line"]))
        anchor = F.element_at(F.filter(done, lambda d: d["line"] == fits), 1)["anchor"]
        new = F.coalesce(F.array_max(F.transform(done, lambda d: d["line"])), F.lit(0)) + 1
        return F.array_append(done, F.struct(r["pos"].alias("pos"), F.coalesce(fits, new).alias("line"), F.when(fits.isNotNull(), anchor).otherwise(r["c"]).alias("anchor")))

    return fold(sorted_rows(rows, group, [f"s{i}" for i in range(len(sort))] + ["pos"], ["c"]), group, kind, step).select(group, "item.*")


def first_fit_edges(df: DataFrame, group: str, tolerance: float = 20.0) -> DataFrame:
    """``line`` of boxes (pos, x1, y1, y2) in order of (y1, x1): the first line whose first box's top, or
    whose first box's lower edge, is within ``tolerance`` of the box's, else a new one."""
    kind = "struct<pos:bigint,line:int,top:double,low:double>"

    def step(done: Column, r: Column) -> Column:
        near = lambda d: (F.abs(d["top"] - r["y1"]) <= tolerance) | (F.abs(d["low"] - r["y2"]) <= tolerance)
        line = F.array_min(F.transform(F.filter(done, near), lambda d: d["line"]))
        new = F.coalesce(F.array_max(F.transform(done, lambda d: d["line"])), F.lit(0)) + 1
        first = F.element_at(F.filter(done, lambda d: d["line"] == line), 1)
        edge = lambda c, own: F.when(line.isNotNull(), first[c]).otherwise(r[own].cast("double")).alias(c)
        return F.array_append(done, F.struct(r["pos"].cast("bigint").alias("pos"), F.coalesce(line, new).alias("line"), edge("top", "y1"), edge("low", "y2")))

    return fold(sorted_rows(df, group, ["y1", "x1", "pos"], ["y2"]), group, kind, step).select(group, "item.pos", "item.line")


def same_rect_groups(df: DataFrame, group: str, distance: float = 30.0, ratio: float = 0.7, expected: int = 1000) -> DataFrame:
    """``leader``: the first box without one leads, and takes every later box that is near it by
    centre and alike in area; at most ``expected`` leaders, further boxes have none."""
    kind = "struct<pos:bigint,leader:bigint,cx:double,cy:double,area:double>"
    rows = sorted_rows(df, group, ["pos"], ["x1", "y1", "x2", "y2"])

    def step(done: Column, r: Column) -> Column:
        cx, cy = (r["x1"] + r["x2"]) / 2.0, (r["y1"] + r["y2"]) / 2.0
        area = ((r["x2"] - r["x1"] + 1) * (r["y2"] - r["y1"] + 1)).cast("double")
        leaders = F.filter(done, lambda d: d["leader"] == d["pos"])
        near = F.filter(leaders, lambda d: (F.sqrt((d["cx"] - cx) * (d["cx"] - cx) + (d["cy"] - cy) * (d["cy"] - cy)) <= distance) & (F.least(d["area"], area) / F.greatest(d["area"], area) >= ratio))
        own = F.when(F.size(leaders) < expected, r["pos"].cast("bigint"))
        leader = F.when(F.size(near) > 0, F.element_at(near, 1)["pos"]).otherwise(own)
        return F.array_append(done, F.struct(r["pos"].cast("bigint").alias("pos"), leader.alias("leader"), cx.alias("cx"), cy.alias("cy"), area.alias("area")))

    return fold(rows, group, kind, step).select(group, "item.pos", "item.leader")


def block_merge(df: DataFrame, group: str, reach: int = 8, most_height: int = 120) -> DataFrame:
    """Dark blocks of a page grown into boxes: (group, pos, x1, y1, x2, y2).

    In order of pos each block that no box has taken begins one, which takes every free block
    that begins within ``reach`` of its right edge and shares rows with it, or begins within
    ``reach`` of its lower edge, shares columns and keeps it within ``most_height``; the box has
    grown when the next is tested, and goes round until nothing is taken. A block that began a box
    stays free for later ones. One task a page: a page is dozens of blocks.
    """
    kind = df.schema[group].dataType.simpleString()

    def boxes(rows: list[tuple]) -> Iterator[tuple]:
        taken = [False] * len(rows)
        for first, (pos, *box) in enumerate(rows):
            if taken[first]:
                continue
            grew = True
            while grew:
                grew = False
                for k, (_, x1, y1, x2, y2) in enumerate(rows):
                    if taken[k] or k == first:
                        continue
                    beside = abs(x1 - box[2]) <= reach and y2 >= box[1] and y1 <= box[3]
                    under = abs(y1 - box[3]) <= reach and x2 >= box[0] and x1 <= box[2]
                    grown = [min(box[0], x1), min(box[1], y1), max(box[2], x2), max(box[3], y2)]
                    if beside or under and grown[3] - grown[1] < most_height:
                        box, taken[k], grew = grown, True, True
            yield pos, *box

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("pos", "x1", "y1", "x2", "y2")), strict=True))
        out = list(zip(*boxes(rows), strict=True))
        columns = [pa.array([table.column(0)[0].as_py()] * len(out[0]), table.schema.field(0).type), pa.array(out[0], pa.int64()), *(pa.array(c, pa.int32()) for c in out[1:])]
        return pa.Table.from_arrays(columns, names=[group, "pos", "x1", "y1", "x2", "y2"])

    return df.select(group, F.col("pos").cast("long"), *[F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")]).groupBy(group).applyInArrow(merge, f"{group} {kind}, pos long, x1 int, y1 int, x2 int, y2 int")


def traverse(links: DataFrame, starts: DataFrame, group: str, mode: str = "row") -> DataFrame:
    """(group, path): the indices in the order of a walk over links (idx, up, down, left, right)
    from each group's ``start``; null unless the walk comes to all of them.

    Row mode goes right as long as that leads to something new, then down from the start of the
    row; column mode goes down, then right from the top of the column.
    """
    ahead, aside = ("right", "down") if mode == "row" else ("down", "right")
    graph = links.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("idx", F.struct(F.col(ahead).alias("ahead"), F.col(aside).alias("aside"))))).alias("g"), F.count("*").alias("n"))
    rows = graph.join(starts, group)
    kind = rows.schema["start"].dataType.simpleString()
    state = lambda path, at, head, done: F.struct(path.alias("path"), at.cast(kind).alias("at"), head.cast(kind).alias("head"), done.alias("done"))

    def step(s: Column, _: Column) -> Column:
        usable = lambda v: F.coalesce((v != 0) & F.map_contains_key("g", v) & ~F.array_contains(s["path"], v), F.lit(False))
        one, two = F.try_element_at("g", s["at"])["ahead"].cast(kind), F.try_element_at("g", s["head"])["aside"].cast(kind)
        on = F.when(usable(F.coalesce(one, F.lit(0))), one).when(usable(F.coalesce(two, F.lit(0))), two)
        head = F.when(usable(F.coalesce(one, F.lit(0))), s["head"]).otherwise(F.coalesce(on, s["head"]))
        stop = s["done"] | on.isNull()
        return state(F.when(stop, s["path"]).otherwise(F.array_append(s["path"], on)), F.when(stop, s["at"]).otherwise(on), F.when(stop, s["head"]).otherwise(head), stop)

    walked = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("n"))), state(F.array(F.col("start")), F.col("start"), F.col("start"), F.lit(False)), step)
    return rows.select(group, "n", walked.alias("w")).select(group, F.when(F.size("w.path") == F.col("n"), F.col("w.path")).alias("path"))
