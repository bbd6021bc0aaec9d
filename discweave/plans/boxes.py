"""Queries of rectangles: geometry, spatial joins, order-dependent folds and reading orders.

Part p is box number p of menu page p // 40, at a place and of a size made from its numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.functions import geometry as geo
from discweave.operators import folds
from discweave.operators import relational as rel
from discweave.operators import windows as win
from discweave.plans.catalogue import Tables, query


def rects(t: Tables) -> DataFrame:
    x, y = (F.col("p_partkey") * 37 % 600).cast("int"), (F.col("p_partkey") * 53 % 480).cast("int")
    return t.part.select(F.floor(F.col("p_partkey") / 40).alias("page"), F.col("p_partkey").alias("pos"), x.alias("x1"), y.alias("y1"), (x + 19 + F.col("p_size") * 2).alias("x2"), (y + 14 + F.col("p_size")).alias("y2"))


RECTS = """rects AS (SELECT p_partkey // 40 AS page, p_partkey AS pos, CAST(p_partkey * 37 % 600 AS INT) AS x1, CAST(p_partkey * 53 % 480 AS INT) AS y1,
    CAST(p_partkey * 37 % 600 + 19 + p_size * 2 AS INT) AS x2, CAST(p_partkey * 53 % 480 + 14 + p_size AS INT) AS y2 FROM part)"""
NUMBERED = RECTS + ", n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS rn FROM rects)"


def share_sql(a: str, b: str) -> str:
    w, h = (f"greatest(0, least({a}.{v}2, {b}.{v}2) - greatest({a}.{v}1, {b}.{v}1) + 1)" for v in "xy")
    size = lambda r: f"(({r}.x2 - {r}.x1 + 1) * ({r}.y2 - {r}.y1 + 1))"
    return f"({w} * {h} / CAST(least({size(a)}, {size(b)}) AS DOUBLE))"


def corners(prefix: str = "") -> tuple:
    return tuple(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))


@query(f"""
    WITH {RECTS}, s AS (SELECT *, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h FROM rects)
    SELECT pos, CAST(w * h AS INT) AS area, w > 0 AND h > 0 AND h <= 3 * w AS upright, x1 + w / 2.0 AS cx,
           CASE WHEN x2 - x1 >= 80 AND y2 - y1 >= 60 THEN 'large' ELSE 'small' END AS size_class,
           w * h / 414720.0 BETWEEN 0.005 AND 0.5 AS fits, w BETWEEN 50 AND 300 AND h BETWEEN 50 AND 300 AND least(w, h) / greatest(w, h) > 0.25 AS thumbnail,
           x1 >= 10 AND y1 >= 10 AND x1 + w <= 710 AND y1 + h <= 566 AS inside FROM s
""")
def rect_metrics(t: Tables) -> DataFrame:
    """Measures and filters of single boxes."""
    b = rects(t).withColumn("w", F.col("x2") - F.col("x1") + 1).withColumn("h", F.col("y2") - F.col("y1") + 1)
    w, h = F.col("w"), F.col("h")
    return b.select("pos", geo.area(w, h).alias("area"), geo.is_upright(w, h).alias("upright"), geo.centre(F.col("x1"), w).alias("cx"), geo.size_class(*corners()).alias("size_class"), geo.area_share_ok(w, h, 720 * 576).alias("fits"), geo.is_thumbnail(w, h).alias("thumbnail"), geo.within_margins(F.col("x1"), F.col("y1"), w, h, 720, 576, 10).alias("inside"))


@query(f"""
    WITH {RECTS}, s AS (SELECT pos, x1 * (1 + pos % 2) AS x, y1 * (1 + pos % 2) AS y, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h, x1, y1, x2, y2,
                               40 + pos % 5 * 120 AS iw, 30 + pos % 4 * 130 AS ih, CASE WHEN pos % 3 = 0 THEN 120 ELSE 720 END AS tw FROM rects),
    n AS (SELECT *, CAST(greatest(1, round_even(w * CAST(0.9 AS DOUBLE), 0)) AS INT) AS nw, CAST(greatest(1, round_even(h * CAST(0.9 AS DOUBLE), 0)) AS INT) AS nh,
          CASE WHEN x + w <= iw AND y + h <= ih THEN 'inside' WHEN w <= iw AND h <= ih THEN 'cut' WHEN x + w <= iw * 1.2 AND y + h <= ih * 1.2 THEN 'cut' WHEN x + w <= 1024 AND y + h <= 1024 THEN 'scaled' ELSE 'kept' END AS arm,
          CASE WHEN w > 100 AND h < 90 AND w < floor(tw * 0.9) THEN CASE WHEN x + w / 2.0 > tw * 0.45 THEN 'right' WHEN y > 200 THEN 'low' ELSE 'high' END ELSE 'kept' END AS tarm FROM s)
    SELECT pos, arm, CAST(CASE arm WHEN 'cut' THEN greatest(0, x) WHEN 'scaled' THEN round_even(x * CAST(iw AS DOUBLE) / 1024, 0) ELSE x END AS INT) AS nx, CAST(CASE arm WHEN 'scaled' THEN round_even(y * CAST(ih AS DOUBLE) / 1024, 0) ELSE y END AS INT) AS ny,
           CAST(CASE arm WHEN 'cut' THEN least(w, greatest(1, iw - x)) WHEN 'scaled' THEN round_even(w * CAST(iw AS DOUBLE) / 1024, 0) ELSE w END AS INT) AS nw,
           CAST(CASE arm WHEN 'cut' THEN least(h, greatest(1, ih - y)) WHEN 'scaled' THEN round_even(h * CAST(ih AS DOUBLE) / 1024, 0) ELSE h END AS INT) AS nh,
           CAST(x + floor((w - n.nw) / 2.0) AS INT) AS sx, CAST(y + floor((h - n.nh) / 2.0) AS INT) AS sy, n.nw AS sw, n.nh AS sh,
           tarm, CAST(CASE tarm WHEN 'right' THEN greatest(0, x - 8) ELSE x END AS INT) AS tx,
           CAST(CASE tarm WHEN 'low' THEN greatest(0, y - round_even(h * CAST(0.2 AS DOUBLE), 0)) WHEN 'high' THEN greatest(0, y - round_even(h * CAST(0.35 AS DOUBLE), 0)) ELSE y END AS INT) AS ty,
           CAST(CASE WHEN tarm = 'kept' THEN w ELSE round_even(w * CAST(0.88 AS DOUBLE), 0) END AS INT) AS tw,
           CAST(CASE tarm WHEN 'low' THEN h + round_even(h * CAST(0.2 AS DOUBLE), 0) + round_even(h * CAST(0.05 AS DOUBLE), 0) WHEN 'high' THEN h + round_even(h * CAST(0.35 AS DOUBLE), 0) + round_even(h * CAST(0.1 AS DOUBLE), 0) ELSE h END AS INT) AS th,
           CASE WHEN w <= 1.6 * h AND h <= 1.6 * w THEN CAST(least(719, x2 + floor(2.5 * w)) AS INT) ELSE x2 END AS wide,
           CAST(greatest(0, x1 - greatest(4, floor(w * 0.05))) AS INT) AS px, CAST(least(575, y2 + greatest(4, floor(h * 0.10))) AS INT) AS py
    FROM n
""")
def rect_adjustments(t: Tables) -> DataFrame:
    """Boxes fitted to an image, shrunk, given room for text, widened and padded.
    The boxes of odd numbers lie twice as far out, and images are of twenty sizes."""
    x1, y1, x2, y2 = corners()
    pos, (_, _, w, h) = F.col("pos"), geo.to_sized(x1, y1, x2, y2)
    x, y = (x1 * (1 + pos % 2)).cast("int"), (y1 * (1 + pos % 2)).cast("int")
    sx, sy, sw, sh = geo.shrink(x, y, w, h, 0.9)
    px, _, _, py = geo.pad_box(x1, y1, x2, y2, 720, 576)
    fitted = geo.normalise_to_image(x, y, w, h, 40 + pos % 5 * 120, 30 + pos % 4 * 130)
    room = geo.text_room(x, y, w, h, F.when(pos % 3 == 0, 120).otherwise(720))
    return rects(t).select("pos", fitted.alias("n"), room.alias("t"), sx.alias("sx"), sy.alias("sy"), sw.alias("sw"), sh.alias("sh"), geo.expand_right(x1, y1, x2, y2).alias("wide"), px.alias("px"), py.alias("py")).select(
        "pos", "n.arm", *[F.col(f"n.{c}").alias(f"n{c}") for c in "xywh"], "sx", "sy", "sw", "sh", F.col("t.arm").alias("tarm"), *[F.col(f"t.{c}").alias(f"t{c}") for c in "xywh"], "wide", "px", "py")


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey * 7 % 1024 AS INT) AS a, CAST(l_suppkey * 11 % 1024 AS INT) AS b,
                      CAST(l_partkey * 13 % 1024 AS INT) AS c, CAST(l_suppkey * 17 % 1024 AS INT) AS d FROM lineitem),
         g AS (SELECT *, c > 720 OR d > 576 AS off, CASE WHEN d > 480 THEN 576 ELSE 480 END AS hh FROM s),
         v AS (SELECT *, CAST(CASE WHEN off THEN round_even(CAST(a * 720 / 1024.0 AS DOUBLE), 0) ELSE a END AS INT) AS x1, CAST(CASE WHEN off THEN round_even(CAST(c * 720 / 1024.0 AS DOUBLE), 0) ELSE c END AS INT) AS x2,
                      CAST(CASE WHEN off THEN round_even(CAST(b * hh / 1024.0 AS DOUBLE), 0) ELSE b END AS INT) AS y1, CAST(CASE WHEN off THEN round_even(CAST(d * hh / 1024.0 AS DOUBLE), 0) ELSE d END AS INT) AS y2 FROM g)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2
    FROM v WHERE x1 <> x2 AND y1 <> y2
""")
def grid_scale(t: Tables) -> DataFrame:
    """Coordinates of the 1024 grid as pixels, half to even."""
    v = lambda c, k: (F.col(c) * k % 1024).cast("int")
    out = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geo.grid_to_frame(v("l_partkey", 7), v("l_suppkey", 11), v("l_partkey", 13), v("l_suppkey", 17)).alias("r"))
    return out.where("r IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.*")


@query(f"""
    WITH {RECTS} SELECT page, a, b, round(ratio, 5) AS ratio, round(other, 5) AS other FROM (
        SELECT a.page, a.pos AS a, b.pos AS b, {share_sql("a", "b")} AS ratio,
               greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))
               / CAST(least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS DOUBLE) AS other
        FROM rects a JOIN rects b ON a.page = b.page AND a.pos < b.pos) WHERE ratio > 0.2
""")
def overlap_pairs(t: Tables) -> DataFrame:
    """Overlapping boxes of a page, by both measures."""
    other = geo.overlap_exclusive(*(tuple([F.col(f"{p}_x1"), F.col(f"{p}_y1"), F.col(f"{p}_x2") - F.col(f"{p}_x1"), F.col(f"{p}_y2") - F.col(f"{p}_y1")]) for p in "ab"))
    metric = F.struct(geo.overlap_inclusive(corners("a_"), corners("b_")).alias("r"), other.alias("o"))
    pairs = rel.overlap_pairs(rects(t), "page", "pos", metric, F.struct(F.lit(0.2).alias("r"), F.lit(1e9).alias("o")))
    return pairs.select("page", "a", "b", F.round("ratio.r", 5).alias("ratio"), F.round("ratio.o", 5).alias("other"))


def directions_sql(condition: str, along: str, across: str) -> str:
    return f"coalesce(first(b.pos ORDER BY abs({along}) + 0.5 * abs({across}), b.pos) FILTER (WHERE {condition}), 0)"


LINKS = f"""links AS (SELECT a.page, a.pos AS idx, {directions_sql("b.y1 < a.y1", "b.y1 - a.y1", "b.x1 - a.x1")} AS up, {directions_sql("b.y1 > a.y1", "b.y1 - a.y1", "b.x1 - a.x1")} AS down,
    {directions_sql("b.x1 < a.x1", "b.x1 - a.x1", "b.y1 - a.y1")} AS "left", {directions_sql("b.x1 > a.x1", "b.x1 - a.x1", "b.y1 - a.y1")} AS "right"
    FROM rects a LEFT JOIN rects b ON a.page = b.page AND a.pos <> b.pos GROUP BY 1, 2)"""


@query(f"WITH {RECTS}, {LINKS} SELECT * FROM links")
def nearest_links(t: Tables) -> DataFrame:
    """The neighbour of each box in four directions."""
    return rel.nearest_links(rects(t), "page", "pos", "x1", "y1")


@query(f"""
    WITH {RECTS}, l AS (SELECT page, pos AS idx, CASE WHEN pos % 40 = 39 THEN 0 WHEN pos % 9 = 0 THEN pos + 1000000 ELSE pos + 1 END AS r FROM rects)
    SELECT l.page, l.idx, 'right' AS direction, r AS target FROM l LEFT JOIN rects k ON k.page = l.page AND k.pos = r WHERE r <> 0 AND k.pos IS NULL
""")
def broken_links(t: Tables) -> DataFrame:
    """G1: links to what is not there."""
    pos, zero = F.col("pos"), F.lit(0).cast("long")
    right = F.when(pos % 40 == 39, zero).when(pos % 9 == 0, pos + 1000000).otherwise(pos + 1)
    links = rects(t).select("page", pos.alias("idx"), zero.alias("up"), zero.alias("down"), zero.alias("left"), right.alias("right"))
    return rel.broken_links(links, "page")


@query(f"""
    WITH RECURSIVE {NUMBERED}, k AS (
        SELECT page, rn, [{{'pos': pos, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM n WHERE rn = 1
        UNION ALL SELECT k.page, n.rn, CASE WHEN len(list_filter(k.kept, lambda o: {share_sql("o", "n")} > 0.5)) > 0 THEN k.kept
            ELSE list_append(k.kept, {{'pos': n.pos, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}}) END
        FROM k JOIN n ON n.page = k.page AND n.rn = k.rn + 1),
    f AS (SELECT page, unnest(kept) AS i FROM k WHERE rn = (SELECT max(rn) FROM n WHERE n.page = k.page))
    SELECT page, i.pos AS pos, i.x1 AS x1, i.y1 AS y1, i.x2 AS x2, i.y2 AS y2 FROM f
""")
def greedy_nms(t: Tables) -> DataFrame:
    """Boxes that overlap a kept one go."""
    return folds.greedy_suppress(rects(t), "page", 0.5)


@query(f"""
    WITH RECURSIVE {NUMBERED}, k AS (
        SELECT page, rn, [{{'pos': pos, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM n WHERE rn = 1
        UNION ALL SELECT k.page, n.rn, CASE WHEN len(list_filter(k.kept, lambda o: {share_sql("o", "n")} > 0.5)) > 0
            THEN list_transform(k.kept, lambda o, i: CASE WHEN i = list_position(list_transform(k.kept, lambda q: {share_sql("q", "n")} > 0.5), true)
                THEN {{'pos': o.pos, 'x1': least(o.x1, n.x1), 'y1': least(o.y1, n.y1), 'x2': greatest(o.x2, n.x2), 'y2': greatest(o.y2, n.y2)}} ELSE o END)
            ELSE list_append(k.kept, {{'pos': n.pos, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}}) END
        FROM k JOIN n ON n.page = k.page AND n.rn = k.rn + 1),
    f AS (SELECT page, unnest(kept) AS i FROM k WHERE rn = (SELECT max(rn) FROM n WHERE n.page = k.page))
    SELECT page, i.pos AS pos, i.x1 AS x1, i.y1 AS y1, i.x2 AS x2, i.y2 AS y2 FROM f
""")
def greedy_merge(t: Tables) -> DataFrame:
    """A box that overlaps a merged one grows it."""
    return folds.greedy_merge(rects(t), "page", 0.5)


@query(f"""
    WITH RECURSIVE {RECTS}, s AS (SELECT page, pos, (y1 + y2) / 2.0 AS c, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) DESC, pos) AS rn FROM rects),
    k AS (SELECT page, rn, [{{'pos': pos, 'c': c}}] AS kept FROM s WHERE rn = 1
        UNION ALL SELECT k.page, s.rn, CASE WHEN len(list_filter(k.kept, lambda o: abs(o.c - s.c) < 100)) > 0 THEN k.kept ELSE list_append(k.kept, {{'pos': s.pos, 'c': s.c}}) END
        FROM k JOIN s ON s.page = k.page AND s.rn = k.rn + 1),
    f AS (SELECT page, unnest(kept) AS i FROM k WHERE rn = (SELECT max(rn) FROM s WHERE s.page = k.page))
    SELECT page, i.pos AS pos, CAST(i.c AS DOUBLE) AS centre FROM f
""")
def centre_dedup(t: Tables) -> DataFrame:
    """By score, kept unless a kept centre is near."""
    b = rects(t).withColumn("c", (F.col("y1") + F.col("y2")) / 2.0).withColumn("score", F.col("x2") - F.col("x1"))
    return folds.dedup_by_centre(b, "page", "c", "score", "pos", 100)


@query(f"""
    WITH RECURSIVE {RECTS}, l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS rn FROM rects WHERE pos % 2 = 0),
    r AS (SELECT page, list({{'pos': pos, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY pos) AS o FROM rects WHERE pos % 2 = 1 GROUP BY 1),
    b AS (SELECT l.page, l.pos, l.rn, list_sort(list_transform(list_filter(r.o, lambda q: {share_sql("q", "l")} > 0), lambda q: {{'s': -{share_sql("q", "l")}, 'pos': q.pos}})) AS c
          FROM l LEFT JOIN r USING (page)),
    k AS (SELECT page, rn, pos, c[1].pos AS match, CASE WHEN c[1].pos IS NULL THEN [] ELSE [c[1].pos] END AS used FROM b WHERE rn = 1
        UNION ALL SELECT page, rn, pos, m, CASE WHEN m IS NULL THEN used ELSE list_append(used, m) END FROM (
            SELECT b.page, b.rn, b.pos, k.used, list_filter(b.c, lambda q: NOT list_contains(k.used, q.pos))[1].pos AS m FROM k JOIN b ON b.page = k.page AND b.rn = k.rn + 1))
    SELECT page, pos, match FROM k
""")
def greedy_match(t: Tables) -> DataFrame:
    """Each box takes the free one it overlaps most."""
    b = rects(t)
    return folds.greedy_match(b.where("pos % 2 = 0"), b.where("pos % 2 = 1"), "page")


@query(f"""
    WITH RECURSIVE {NUMBERED}, m AS (SELECT *, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, CAST((x2 - x1 + 1) * (y2 - y1 + 1) AS DOUBLE) AS area FROM n),
    k AS (SELECT page, rn, pos, pos AS leader, [{{'pos': pos, 'cx': cx, 'cy': cy, 'area': area}}] AS led FROM m WHERE rn = 1
        UNION ALL SELECT page, rn, pos, coalesce(f, pos), CASE WHEN f IS NULL THEN list_append(led, {{'pos': pos, 'cx': cx, 'cy': cy, 'area': area}}) ELSE led END FROM (
            SELECT m.*, k.led, list_filter(k.led, lambda o: sqrt((o.cx - m.cx) * (o.cx - m.cx) + (o.cy - m.cy) * (o.cy - m.cy)) <= 60 AND least(o.area, m.area) / greatest(o.area, m.area) >= 0.7)[1].pos AS f
            FROM k JOIN m ON m.page = k.page AND m.rn = k.rn + 1))
    SELECT page, pos, leader FROM k
""")
def same_rect_groups(t: Tables) -> DataFrame:
    """Boxes near a leader and alike in size follow it."""
    return folds.same_rect_groups(rects(t), "page", 60.0, 0.7)


@query("""
    WITH g AS (SELECT p_partkey // 40 AS page, p_partkey AS pos, p_partkey % 40 AS k, count(*) OVER (PARTITION BY p_partkey // 40) AS n, min(p_partkey) OVER (PARTITION BY p_partkey // 40) AS start FROM part)
    SELECT page, CASE WHEN n = 40 AND page % 3 <> 0 THEN string_agg(pos, ',' ORDER BY pos) END AS path FROM g GROUP BY page, n
""")
def link_traversal(t: Tables) -> DataFrame:
    """A walk over the links of an 8 by 5 grid; every third page has a link missing."""
    b = rects(t).withColumn("k", F.col("pos") % 40)
    right = F.when((F.col("k") % 8 == 7) | (F.col("page") % 3 == 0) & (F.col("k") == 3), F.lit(0)).otherwise(F.col("pos") + 1)
    down = F.when(F.col("k") >= 32, F.lit(0)).otherwise(F.col("pos") + 8)
    links = b.select("page", F.col("pos").alias("idx"), F.lit(0).cast("long").alias("up"), down.cast("long").alias("down"), F.lit(0).cast("long").alias("left"), right.cast("long").alias("right"))
    starts = b.groupBy("page").agg(F.min("pos").alias("start"))
    return folds.traverse(links, starts, "page", "row").select("page", F.array_join(F.transform("path", lambda p: p.cast("string")), ",").alias("path"))


@query(f"""
    WITH {RECTS}, s AS (SELECT *, abs(x1 - lag(x1) OVER w) + abs(y1 - lag(y1) OVER w) AS step FROM rects WINDOW w AS (PARTITION BY page ORDER BY pos)),
    r AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY pos) AS a, row_number() OVER (PARTITION BY page ORDER BY y1, x1, pos) AS b FROM rects)
    SELECT page, path, CAST(displacement AS BIGINT) AS displacement FROM (SELECT page, CAST(coalesce(sum(step), 0) AS BIGINT) AS path FROM s GROUP BY 1)
    JOIN (SELECT page, CASE WHEN count(*) >= 2 THEN sum(abs(b - a)) END AS displacement FROM r GROUP BY 1) USING (page)
""")
def path_and_displacement(t: Tables) -> DataFrame:
    """The length of a path, and how far an order is from another."""
    b = rects(t)
    ranked = b.withColumn("rank", F.row_number().over(win.over(["page"], ["y1", "x1", "pos"])))
    return win.path_length(b, ["page"], ["pos"], "x1", "y1").join(win.rank_displacement(ranked, ["page"], ["pos"], "rank"), "page")


@query("""
    WITH s AS (SELECT c_custkey, c_custkey % 5 = 0 AS graph_ok, c_custkey % 7 AS dist_row, c_custkey % 6 AS dist_col,
                      nullif(c_custkey % 4, 0) AS score_row, nullif(c_custkey % 3, 0) AS score_col FROM customer),
         k AS (SELECT *, CASE WHEN score_row IS NULL AND score_col IS NULL THEN 'row' WHEN score_row IS NULL THEN 'col' WHEN score_col IS NULL THEN 'row'
                    WHEN score_row <= score_col THEN 'row' ELSE 'col' END AS by_score FROM s)
    SELECT c_custkey, CASE WHEN graph_ok THEN 'graph' WHEN dist_row > 0 AND dist_col > 0 AND dist_col <= dist_row * 0.9 THEN 'col'
        WHEN dist_row > 0 AND dist_col > 0 AND dist_row <= dist_col * 0.9 THEN 'row' ELSE by_score END AS choice FROM k
""")
def order_choice(t: Tables) -> DataFrame:
    """Which of the candidate orders is taken."""
    k = F.col("c_custkey")
    s = t.customer.select("c_custkey", (k % 5 == 0).alias("graph_ok"), (k % 7).alias("dist_row"), (k % 6).alias("dist_col"), F.nullif(k % 4, F.lit(0)).alias("score_row"), F.nullif(k % 3, F.lit(0)).alias("score_col"))
    return rel.choose_order(s).select("c_custkey", "choice")


@query(f"""
    WITH {RECTS}, m AS (SELECT page, list_sort(list(x1))[len(list(x1)) // 2 + 1] AS m, max(x1) - min(x1) AS spread FROM rects GROUP BY 1)
    SELECT page, pos AS box, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE WHEN spread < 40 THEN 0 ELSE CAST(x1 > m AS INT) END, y1, CASE WHEN spread < 40 THEN x1 END, pos) AS INT) AS pos
    FROM rects JOIN m USING (page)
""")
def column_major_order(t: Tables) -> DataFrame:
    """The left column downwards, then the right one."""
    b = rects(t).withColumnRenamed("pos", "box")
    return rel.column_major(b, "page", "x1", "y1", "box").select("page", "box", "pos")


@query(f"""
    WITH {RECTS}, b AS (SELECT page, pos AS box, pos * 37 % 130 AS x1, y1, pos * 37 % 130 + x2 - x1 AS x2 FROM rects),
    h AS (SELECT page, first(box ORDER BY y1, x2 - x1 DESC, box) AS header FROM b WHERE x2 - x1 + 1 >= 150 * 0.6 AND y1 < 520 * 0.3 GROUP BY 1),
    k AS (SELECT b.*, CASE WHEN box = header THEN 0 WHEN (x1 + x2) / 2.0 < 75 THEN 1 ELSE 2 END AS bucket FROM b LEFT JOIN h USING (page))
    SELECT page, box, CAST(bucket AS INT) AS bucket, CAST(row_number() OVER (PARTITION BY page ORDER BY bucket, y1, x1, box) AS INT) AS pos FROM k
""")
def header_first_order(t: Tables) -> DataFrame:
    """One header at most, then the left column, then the right one."""
    x = (F.col("pos") * 37 % 130).cast("int")
    b = rects(t).select("page", F.col("pos").alias("box"), x.alias("x1"), "y1", (x + F.col("x2") - F.col("x1")).alias("x2"))
    return rel.header_first(b, "page", "x1", "y1", "x2", 150, 520, "box").select("page", "box", "bucket", "pos")


@query(f"""
    WITH RECURSIVE {RECTS}, s AS (SELECT page, pos, (y1 + y2) / 2.0 AS c, row_number() OVER (PARTITION BY page ORDER BY y1, x1, pos) AS rn FROM rects),
    k AS (SELECT page, rn, pos, 1 AS line, [c] AS anchors FROM s WHERE rn = 1
        UNION ALL SELECT page, rn, pos, coalesce(f, len(anchors) + 1), CASE WHEN f IS NULL THEN list_append(anchors, c) ELSE anchors END FROM (
            SELECT s.*, k.anchors, list_position(list_transform(k.anchors, lambda a: abs(a - s.c) <= 18), true) AS f FROM k JOIN s ON s.page = k.page AND s.rn = k.rn + 1))
    SELECT page, pos, CAST(line AS INT) AS line FROM k
""")
def first_fit_rows(t: Tables) -> DataFrame:
    """The first row whose first member is near takes a box."""
    b = rects(t).withColumn("c", (F.col("y1") + F.col("y2")) / 2.0)
    return folds.first_fit_rows(b, "page", "c", ["y1", "x1"], "pos", 18.0).select("page", "pos", "line")


@query(f"""
    WITH {RECTS}, p AS (SELECT a.page, a.pos, b.pos AS line, (b.y1 + b.y2) / 2.0 - (a.y1 + a.y2) / 2.0 AS delta FROM rects a JOIN rects b ON a.page = b.page
                        WHERE a.pos % 2 = 0 AND b.pos % 2 = 1 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) >= 40),
    m AS (SELECT page, pos, first({{'l': line, 'd': delta}} ORDER BY abs(delta), line) AS b FROM p GROUP BY 1, 2)
    SELECT page, CASE WHEN count(*) >= 3 AND abs(median(b.d)) BETWEEN 4 AND 40 THEN median(b.d) ELSE 0 END AS shift FROM m GROUP BY 1
""")
def line_shift(t: Tables) -> DataFrame:
    """The nearest text line of each box, and the shift most agree on."""
    b = rects(t)
    lines = b.where("pos % 2 = 1").select("page", F.col("pos").alias("line_pos"), *[F.col(c).alias("l" + c) for c in ("x1", "y1", "x2", "y2")])
    return rel.consensus_shift(rel.best_line(b.where("pos % 2 = 0"), lines, "page", "pos", "line_pos"), "page")


@query(f"""
    WITH {RECTS}, s AS (SELECT page, pos, x2 - x1 + 1 AS w, (x2 - x1 + 1) * (y2 - y1 + 1) AS a, pos % 4 AS menu FROM rects),
    g AS (SELECT page, menu, max(a) - min(a) AS sa, max(w) - min(w) AS sw FROM s GROUP BY 1, 2 HAVING count(*) = 10)
    SELECT page, first(menu ORDER BY sa, sw, menu) AS menu, CAST(min(sa) AS INT) AS spread FROM g GROUP BY 1
""")
def best_menu_group(t: Tables) -> DataFrame:
    """The group of the wanted size with the least spread."""
    b = rects(t).withColumn("w", F.col("x2") - F.col("x1") + 1).withColumn("a", F.col("w") * (F.col("y2") - F.col("y1") + 1)).withColumn("menu", F.col("pos") % 4)
    return win.best_group(b, "page", "menu", 10, "a", "w").select("page", "menu", F.col("spread").cast("int").alias("spread"))


@query(f"""
    WITH RECURSIVE {RECTS}, b AS (SELECT page, list({{'pos': pos, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY pos) AS b, len(b) AS n FROM rects GROUP BY 1),
    k AS (SELECT page, 1 AS i, 0 AS j, b[1] AS box, [0] AS used, false AS grew, CAST(NULL AS STRUCT(pos BIGINT, x1 INT, y1 INT, x2 INT, y2 INT)) AS done FROM b
        UNION ALL SELECT page, CASE WHEN j = 0 AND skip OR j > n AND NOT grew THEN i + 1 ELSE i END, CASE WHEN j = 0 AND skip THEN 0 WHEN j > n THEN CAST(grew AS INT) ELSE j + 1 END,
            CASE WHEN j = 0 THEN b[i] WHEN hit THEN {{'pos': box.pos, 'x1': least(box.x1, o.x1), 'y1': least(box.y1, o.y1), 'x2': greatest(box.x2, o.x2), 'y2': greatest(box.y2, o.y2)}} ELSE box END,
            CASE WHEN hit THEN list_append(used, j) ELSE used END, CASE WHEN j = 0 OR j > n THEN false ELSE grew OR hit END, CASE WHEN j > n AND NOT grew THEN box END
        FROM (SELECT *, j BETWEEN 1 AND n AND j <> i AND NOT list_contains(used, j) AND (abs(o.x1 - box.x2) <= 8 AND NOT (o.y2 < box.y1 OR o.y1 > box.y2)
                OR abs(o.y1 - box.y2) <= 8 AND NOT (o.x2 < box.x1 OR o.x1 > box.x2) AND greatest(box.y2, o.y2) - least(box.y1, o.y1) + 1 <= 120) AS hit
            FROM (SELECT k.*, b.b, b.n, list_contains(used, i) AS skip, b.b[j] AS o FROM k JOIN b USING (page) WHERE i <= n)))
    SELECT page, done.pos AS pos, done.x1 AS x1, done.y1 AS y1, done.x2 AS x2, done.y2 AS y2 FROM k WHERE done IS NOT NULL
""")
def block_merge(t: Tables) -> DataFrame:
    """Blocks that grow to the right and downwards to a fixed point."""
    return folds.block_merge(rects(t), "page", 8, 120)


@query(f"""
    WITH {RECTS}, x AS (SELECT page, unnest(range(greatest(0, least(719, x1)), greatest(0, least(719, x2)) + 1)) AS x, greatest(1, y2 - y1 + 1) AS h FROM rects),
    g AS (SELECT page, unnest(range(720)) AS x FROM (SELECT DISTINCT page FROM rects)),
    d AS (SELECT g.page, g.x, coalesce(sum(h), 0) AS v FROM g LEFT JOIN x ON x.page = g.page AND x.x = g.x GROUP BY 1, 2),
    m AS (SELECT page, x, avg(v) OVER (PARTITION BY page ORDER BY x ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS v FROM d),
    v AS (SELECT page, first(x ORDER BY v, x) AS vx, min(v) AS vv FROM m WHERE x BETWEEN 108 AND 612 GROUP BY 1),
    p AS (SELECT page, vx, vv, greatest(coalesce(max(v) FILTER (WHERE x < vx), 0), coalesce(max(v) FILTER (WHERE x > vx), 0)) AS peak,
                 coalesce(sum(v) FILTER (WHERE x < vx), 0) AS l, coalesce(sum(v) FILTER (WHERE x > vx), 0) AS r FROM m JOIN v USING (page) WHERE x BETWEEN 108 AND 612 GROUP BY 1, 2, 3),
    b AS (SELECT page, coalesce(min(x) FILTER (WHERE x > vx AND v > vv + peak * 0.05), max(x) + 1) - coalesce(max(x) FILTER (WHERE x < vx AND v > vv + peak * 0.05), min(x) - 1) - 1 AS gutter
          FROM m JOIN p USING (page) GROUP BY 1)
    SELECT page, vx AS valley_x, round(vv, 4) AS valley, round(peak, 4) AS peak, CAST(gutter AS INT) AS gutter,
           CASE WHEN peak > 0 AND (peak - vv) / peak >= 0.1 AND gutter >= 2 AND l >= peak * 3 AND r >= peak * 3
                AND CASE WHEN l > 0 AND r > 0 THEN least(l, r) / greatest(l, r) ELSE 0 END >= 0.25 THEN vx END AS gutter_x
    FROM p JOIN b USING (page)
""")
def moving_average_valley(t: Tables) -> DataFrame:
    """A projection, smoothed, its deepest valley, and whether that parts columns."""
    b = rects(t).withColumn("h", F.col("y2") - F.col("y1") + 1)
    profile = win.projection(b, "page", "x1", "x2", "h", 720)
    smooth = profile.select("page", "x", win.moving_average("density", ["page"], ["x"], 5).alias("v"))
    valleys = win.gutter(win.deepest_valley(smooth, "page", "x", "v", 108, 612), min_depth=0.1, min_width=2)
    return valleys.select("page", "valley_x", F.round("valley", 4).alias("valley"), F.round("peak", 4).alias("peak"), "gutter", "gutter_x")
