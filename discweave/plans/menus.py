"""Queries of menus: routing, sources, densities, text bands, lines of text and accuracy reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.operators import folds, menus
from discweave.plans.boxes import NUMBERED, RECTS, rects
from discweave.plans.catalogue import Tables, query
from discweave.sources.artifacts import json_shape


@query(r"""
    WITH m AS (SELECT c_custkey, c_nationkey AS disc, CASE c_custkey % 5 WHEN 1 THEN printf('VTS_%02d_0.VOB', CAST(c_custkey % 20 AS INT)) WHEN 2 THEN 'VIDEO_TS.VOB' WHEN 3 THEN 'VIDEO_TS.VOB' END AS want FROM customer),
         f AS (SELECT DISTINCT s_nationkey AS disc, CASE WHEN s_suppkey % 8 = 0 THEN 'VIDEO_TS.VOB' ELSE printf('VTS_%02d_%d.VOB', CAST(s_suppkey % 20 AS INT), CAST(s_suppkey % 3 AS INT)) END AS file FROM supplier),
         r AS (SELECT disc, max(file) FILTER (WHERE file = 'VIDEO_TS.VOB') AS root, min(file) FILTER (WHERE regexp_matches(file, '^VTS_.*_0\.VOB$')) AS first FROM f GROUP BY 1)
    SELECT c_custkey, coalesce(f.file, root, first) AS file, c_custkey % 5 = 1 AND c_custkey % 7 <> 0 AS candidate
    FROM m LEFT JOIN f ON f.disc = m.disc AND f.file = want LEFT JOIN r ON r.disc = m.disc
""")
def menu_routing(t: Tables) -> DataFrame:
    """The file of each menu with its fallbacks, and whether its button may lead to a title."""
    k, number = F.col("c_custkey"), lambda c: F.format_string("%02d", c)
    name = F.when(k % 5 == 1, F.concat(F.lit("vtsm_"), number(k % 20), F.lit("_pgc01"))).when(k % 5 == 2, "VMGM_pgc02").when(k % 5 == 3, "dvd_root").when(k % 5 == 4, "other")
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("disc"), name.alias("menu_id"), F.when(k % 7 != 0, F.struct(F.lit(1).alias("w"))).alias("rect"))
    s = F.col("s_suppkey")
    file = F.when(s % 8 == 0, "VIDEO_TS.VOB").otherwise(F.concat(F.lit("VTS_"), number(s % 20), F.lit("_"), (s % 3).cast("string"), F.lit(".VOB")))
    files = t.supplier.select(F.col("s_nationkey").alias("disc"), file.alias("name"))
    routed = menus.route_menus(rows, files, "disc", "menu_id", "name")
    return routed.select("c_custkey", "file", menus.is_candidate(F.col("menu_id"), F.col("rect")).alias("candidate"))


@query("""
    SELECT o_custkey AS disc, o_orderkey AS button, CAST(o_orderkey % 4 AS INT) AS source FROM orders
    WHERE o_orderkey % 4 = (SELECT min(o.o_orderkey % 4) FROM orders o WHERE o.o_custkey = orders.o_custkey)
""")
def navigation_sources(t: Tables) -> DataFrame:
    """Overlays before navigation packs of menus, of titles, and tables: the first that finds any."""
    found = t.orders.select(F.col("o_custkey").alias("disc"), F.col("o_orderkey").alias("button"), (F.col("o_orderkey") % 4).cast("int").alias("source"))
    return menus.first_source(found, "disc", "source").select("disc", "button", "source")


@query("""
    SELECT o_custkey AS disc, o_orderkey AS pgc, CAST(0 AS DOUBLE) AS start FROM orders WHERE o_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, f.pgc, f.start FROM customer, (VALUES (1, CAST(0 AS DOUBLE)), (2, CAST(600 AS DOUBLE))) f(pgc, start) WHERE c_custkey % 3 = 0
""")
def fixture_fallback(t: Tables) -> DataFrame:
    """SRC25: the rows of a fixture for discs of unknown kind."""
    kinds = t.customer.select(F.col("c_custkey").alias("disc"), F.when(F.col("c_custkey") % 3 == 0, "UNKNOWN").otherwise("DVD").alias("kind"))
    rows = t.orders.select(F.col("o_custkey").alias("disc"), F.col("o_orderkey").alias("pgc"), F.lit(0.0).alias("start"))
    return menus.or_fixture(rows, kinds, [{"pgc": 1, "start": 0.0}, {"pgc": 2, "start": 600.0}], "disc", "kind")


@query("""
    WITH c AS (SELECT vec_id, i, embedding[i + 1] > 0.02 AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings))
    SELECT vec_id, 'row' AS axis, CAST(i // 8 AS INT) AS line, round(avg(CAST(v AS INT)), 6) AS density FROM c GROUP BY 1, 3
    UNION ALL SELECT vec_id, 'column', CAST(i % 8 AS INT), round(avg(CAST(v AS INT)), 6) FROM c GROUP BY 1, 3
""")
def pixel_density(t: Tables) -> DataFrame:
    """How full the rows and columns of grids are."""
    cells = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("cells"))
    parts = [menus.densities(cells, "vec_id", "cells", 8, 0.02, axis).select("vec_id", F.lit(axis).alias("axis"), F.col(axis).alias("line"), F.round("density", 6).alias("density")) for axis in ("row", "column")]
    return parts[0].unionByName(parts[1])


@query("""
    SELECT vec_id, list_transform([embedding[11], embedding[12], embedding[13], embedding[19], embedding[20], embedding[21]], lambda v: round(CAST(v AS DOUBLE), 6)) AS cells FROM embeddings
""")
def grid_crop(t: Tables) -> DataFrame:
    """SNK8: the cells of a box out of a grid. What rounds to zero keeps its sign, as in SQL."""
    two = [F.lit(v) for v in (2, 1, 3, 2)]
    rounded = lambda v: F.signum(v) * F.round(F.abs(v), 6)
    return t.embeddings.select("vec_id", F.transform(menus.crop(F.col("embedding"), 8, *two), lambda v: rounded(v.cast("double"))).alias("cells"))


@query("""
    WITH g AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
         o AS (SELECT vec_id, e, [e[12], e[13], e[14], e[20], e[21], e[22]] AS t, unnest(range(0, len(e) // 8 - 2 + 1, 2)) AS y FROM g),
         p AS (SELECT *, unnest(range(0, 8 - 3 + 1, 2)) AS x FROM o),
         s AS (SELECT vec_id, x, y, list_sum(list_transform(range(6), lambda i: abs(e[(y + i // 3) * 8 + x + i % 3 + 1] - t[i + 1]))) / 6 AS score FROM p)
    SELECT vec_id, CAST(first(x ORDER BY score, y, x) AS INT) AS x, CAST(first(y ORDER BY score, y, x) AS INT) AS y, round(min(score), 6) AS score FROM s GROUP BY 1
""")
def template_offset(t: Tables) -> DataFrame:
    """Where a piece of a grid lies best in it, at every second offset."""
    piece = menus.crop(F.col("embedding"), 8, *[F.lit(v) for v in (3, 1, 3, 2)])
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("cells"), piece.cast("array<double>").alias("piece"))
    return menus.best_offset(rows, "vec_id", "cells", 8, "piece", 3, 2).withColumn("score", F.round("score", 6))


@query("""
    WITH p AS (SELECT DISTINCT p_partkey // 12 AS page FROM part),
         g AS (SELECT page, y, CASE WHEN y BETWEEN 30 AND 437 THEN page * 12 + (y - 30) // 34 END AS k FROM (SELECT page, unnest(range(480)) AS y FROM p)),
         r AS (SELECT page, y, p_partkey IS NOT NULL AND (y - 30) % 34 < 8 + p_size % 6 AND p_partkey % 12 <> page % 15 AND (y - 30) % 34 <> 3 AS on_, p_size, p_partkey FROM g LEFT JOIN part ON p_partkey = k),
         f AS (SELECT page, CAST(y AS INT) AS y, CASE WHEN on_ THEN 300 + p_size ELSE (y * 7 + page) % 5 END AS filled, CASE WHEN on_ THEN 20 + p_partkey % 9 * 10 ELSE 10 END AS a, CASE WHEN on_ THEN 20 + p_partkey % 9 * 10 + 250 + p_size * 8 ELSE 20 END AS b FROM r),
         m AS (SELECT page, avg(filled / 720.0) AS mean, stddev_pop(filled / 720.0) AS sd FROM f GROUP BY 1),
         h AS (SELECT f.*, filled / 720.0 AS ratio, mean, sd, sum(CASE WHEN filled / 720.0 >= greatest(mean + sd, 0.01) THEN 1 ELSE 0 END) OVER (PARTITION BY page) AS hits FROM f JOIN m USING (page)),
         l AS (SELECT *, ratio >= CASE WHEN hits >= 8 THEN greatest(mean + sd, 0.01) ELSE greatest(mean + 0.5 * sd, 0.005) END AS lit FROM h),
         n AS (SELECT page, y, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS gap FROM l WHERE lit),
         i AS (SELECT page, y, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y ROWS UNBOUNDED PRECEDING) AS island FROM n),
         e AS (SELECT page, island, min(y) AS y1, max(y) AS y2 FROM i GROUP BY 1, 2),
         s AS (SELECT e.page, y1, y2, min(a) AS a, max(b) AS b FROM e JOIN f ON f.page = e.page AND f.y BETWEEN y1 AND y2 GROUP BY 1, 2, 3),
         c AS (SELECT page, greatest(19, greatest(0, y1 - greatest(3, CAST(floor((y2 - y1 + 1) * 0.4) AS INT)))) AS y1, least(479, y2 + greatest(6, y2 - y1 + 1)) AS y2, a, (b - a + 1) / 720.0 AS span
               FROM s WHERE y2 - y1 + 1 BETWEEN 6 AND 120 AND y1 > 19 AND y2 < 480 - 38 AND b > a),
         d AS (SELECT page, list_sort(list(y2 - y1 + 1))[count(*) // 2 + 1] AS med FROM c GROUP BY 1),
         w AS (SELECT c.*, sum(CASE WHEN span >= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY page) AS wide FROM c JOIN d USING (page) WHERE NOT (y2 - y1 + 1 > med * 2)),
         q AS (SELECT page, CAST(greatest(0, a - 8) AS INT) AS x1, CAST(y1 AS INT) AS y1, 719 AS x2, CAST(y2 AS INT) AS y2 FROM w WHERE span >= CASE WHEN wide >= 10 THEN 0.6 ELSE 0.4 END),
         z AS (SELECT *, (y1 + y2) / 2.0 AS c, lead((y1 + y2) / 2.0) OVER (PARTITION BY page ORDER BY y1, x1) - (y1 + y2) / 2.0 AS gap FROM q),
         u AS (SELECT page, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL))[(count(gap) // 2) + 1] AS step, list_sort(list(y2 - y1 + 1))[count(*) // 2 + 1] AS tall, list_sort(list(x1))[count(*) // 2 + 1] AS mx1, min(c) AS first, max(c) AS last
               FROM z GROUP BY 1 HAVING count(*) BETWEEN 7 AND 9),
         v AS (SELECT page, 'gap' AS why, CAST(trunc(c + gap / 2.0) AS INT) AS mid, tall, mx1 FROM z JOIN u USING (page) WHERE gap > 1.5 * step
               UNION ALL SELECT page, 'top', CAST(trunc(first - step) AS INT), tall, mx1 FROM u WHERE first - 19 > 1.4 * step
               UNION ALL SELECT page, 'low', CAST(trunc(last + step) AS INT), tall, mx1 FROM u WHERE 442 - last > 1.4 * step),
         x AS (SELECT page, why, mx1 AS x1, greatest(0, mid - greatest(8, tall // 2)) AS y1, least(479, mid + greatest(8, tall // 2)) AS y2 FROM v),
         y AS (SELECT page, x1, y1, y2 FROM q UNION ALL SELECT page, x1, y1, y2 FROM x WHERE why = 'gap' OR why = 'top' AND y2 < 442 OR why = 'low' AND y1 > 19),
         j AS (SELECT page, list_sort(list(y2 - y1 + 1))[count(*) // 2 + 1] AS m FROM y GROUP BY 1),
         k1 AS (SELECT y.page, x1, m, CAST(round_even(CAST((y1 + y2) / 2.0 - greatest(1, m // 2) AS DOUBLE), 0) AS INT) AS a FROM y JOIN j USING (page)),
         k2 AS (SELECT page, x1, m, a - greatest(0, a + m - 1 - 441) AS a FROM k1),
         k3 AS (SELECT page, x1, m, a + greatest(0, 19 - a) AS a FROM k2)
    SELECT page, CAST(x1 AS INT) AS x1, CAST(greatest(19, a - 2) AS INT) AS y1, 719 AS x2, CAST(least(441, a + m - 1) AS INT) AS y2 FROM k3 WHERE least(441, a + m - 1) > greatest(19, a - 2)
""")
def text_bands(t: Tables) -> DataFrame:
    """Bands of text of pages 720 by 480, a part a band."""
    pages = t.part.select(F.floor(F.col("p_partkey") / 12).alias("page")).distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(479))).alias("y"))
    k, y = F.col("p_partkey"), F.col("y")
    own = pages.withColumn("k", F.when(y.between(30, 437), F.col("page") * 12 + F.floor((y - 30) / 34))).join(t.part.select("p_partkey", "p_size"), F.col("k") == F.col("p_partkey"), "left")
    on = F.coalesce(((y - 30) % 34 < 8 + F.col("p_size") % 6) & (k % 12 != F.col("page") % 15) & ((y - 30) % 34 != 3), F.lit(False))
    left = (20 + k % 9 * 10).cast("int")
    rows = own.select("page", "y", F.when(on, 300 + F.col("p_size")).otherwise((y * 7 + F.col("page")) % 5).cast("int").alias("filled"), F.when(on, left).otherwise(10).alias("min_x"), F.when(on, left + 250 + F.col("p_size") * 8).otherwise(20).alias("max_x"))
    return menus.text_bands(rows, "page", 720, 480)


@query(f"""
    WITH RECURSIVE {RECTS}, s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, x1, pos) AS rn FROM rects),
    k AS (SELECT page, pos, rn, 1 AS line, y1 AS anchor FROM s WHERE rn = 1
        UNION ALL SELECT s.page, s.pos, s.rn, CASE WHEN abs(s.y1 - k.anchor) <= 15 THEN k.line ELSE k.line + 1 END, CASE WHEN abs(s.y1 - k.anchor) <= 15 THEN k.anchor ELSE s.y1 END FROM k JOIN s ON s.page = k.page AND s.rn = k.rn + 1),
    c AS (SELECT r.*, line, CASE WHEN x1 - lag(x2) OVER (PARTITION BY page, line ORDER BY x1, y1, pos) > 60 THEN 1 ELSE 0 END AS cut FROM rects r JOIN k USING (page, pos)),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY page, line ORDER BY x1, y1, pos ROWS UNBOUNDED PRECEDING) AS part FROM c),
    p AS (SELECT page, line, part, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM g GROUP BY 1, 2, 3),
    w AS (SELECT page, line, sum(n) AS n, count(*) AS parts, first(p ORDER BY part) AS f, first(p ORDER BY part DESC) AS l, {{'x1': min(x1), 'y1': min(y1), 'x2': max(x2), 'y2': max(y2)}} AS a FROM p GROUP BY 1, 2),
    r AS (SELECT page, line, CASE WHEN parts >= 2 AND f.x2 - f.x1 <= 120 AND f.x2 <= 220 AND l.x2 - l.x1 >= 90 THEN {{'x1': l.x1, 'y1': l.y1, 'x2': l.x2, 'y2': l.y2}}
               WHEN parts >= 2 AND l.x2 - l.x1 <= 120 THEN {{'x1': f.x1, 'y1': f.y1, 'x2': f.x2, 'y2': f.y2}} ELSE a END AS r FROM w WHERE n >= 2)
    SELECT page, CAST(line AS INT) AS line, greatest(0, r.x1 - 10) AS x1, greatest(0, r.y1 - 10) AS y1, r.x2 + 80 AS x2, r.y2 + 10 AS y2 FROM r
    WHERE r.x2 - r.x1 >= 60 AND r.y2 - r.y1 BETWEEN 10 AND 90 AND CASE WHEN r.y2 > r.y1 THEN (r.x2 - r.x1) / CAST(r.y2 - r.y1 AS DOUBLE) ELSE 0 END >= 1.5
""")
def text_lines(t: Tables) -> DataFrame:
    """Boxes put together into lines, side groups trimmed, gated and padded."""
    return menus.text_lines(rects(t), "page", 15, least_boxes=2, least_width=60, least_height=10, most_height=90, least_aspect=1.5, trim=True, gap=60, side_width=120, side_x=220, main_width=90)


@query(f"""
    WITH RECURSIVE {RECTS}, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x2 - x1 DESC, pos) AS rn FROM rects),
    k AS (SELECT page, rn, [{{'pos': pos, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM n WHERE rn = 1
        UNION ALL SELECT k.page, n.rn, CASE WHEN len(list_filter(k.kept, lambda o: least(o.x2, n.x2) > greatest(o.x1, n.x1) AND least(o.y2, n.y2) > greatest(o.y1, n.y1)
            AND (least(o.x2, n.x2) - greatest(o.x1, n.x1)) * (least(o.y2, n.y2) - greatest(o.y1, n.y1)) > 0.5 * (n.x2 - n.x1) * (n.y2 - n.y1))) > 0 THEN k.kept
            ELSE list_append(k.kept, {{'pos': n.pos, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}}) END FROM k JOIN n ON n.page = k.page AND n.rn = k.rn + 1),
    f AS (SELECT page, unnest(kept) AS i FROM k WHERE rn = (SELECT max(rn) FROM n WHERE n.page = k.page))
    SELECT page, i.pos AS pos, i.x1 AS x1, i.y1 AS y1, i.x2 AS x2, i.y2 AS y2 FROM f
""")
def scored_boxes(t: Tables) -> DataFrame:
    """The best boxes, without those that a better one covers by half."""
    return folds.score_suppress(rects(t).withColumn("score", F.col("x2") - F.col("x1")), "page", "score", 0.5)


@query(f"""
    WITH RECURSIVE {NUMBERED.replace("ORDER BY pos) AS rn", "ORDER BY y1, x1, pos) AS rn")},
    k AS (SELECT page, rn, pos, 1 AS line, [{{'t': y1, 'l': y2}}] AS anchors FROM n WHERE rn = 1
        UNION ALL SELECT page, rn, pos, coalesce(f, len(anchors) + 1), CASE WHEN f IS NULL THEN list_append(anchors, {{'t': y1, 'l': y2}}) ELSE anchors END FROM (
            SELECT n.*, k.anchors, list_position(list_transform(k.anchors, lambda a: abs(a.t - n.y1) <= 20 OR abs(a.l - n.y2) <= 20), true) AS f FROM k JOIN n ON n.page = k.page AND n.rn = k.rn + 1))
    SELECT page, pos, CAST(line AS INT) AS line FROM k
""")
def edge_rows(t: Tables) -> DataFrame:
    """The first row that a box's top or lower edge fits."""
    return folds.first_fit_edges(rects(t), "page", 20.0).select("page", "pos", "line")


@query("""
    WITH v AS (SELECT event_id // 4 AS button, CASE event_id % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'spu' WHEN 2 THEN 'hue' ELSE 'blend' END AS name, round(value, 1) / 100 AS sim, length(props) AS len, event_id AS pos FROM events),
         b AS (SELECT button, first(name ORDER BY sim DESC, len DESC, pos) AS best, max(sim) AS best_sim, coalesce(max(sim) FILTER (WHERE name = 'primary'), 0) AS p FROM v GROUP BY 1),
         s AS (SELECT v.button, first(name ORDER BY sim DESC, len DESC, pos) AS safe, max(sim) AS safe_sim FROM v JOIN b USING (button) WHERE name <> 'hue' AND sim > p + 0.01 GROUP BY 1)
    SELECT button, best, best_sim, coalesce(safe, 'primary') AS safe, coalesce(safe_sim, p) AS safe_sim FROM b LEFT JOIN s USING (button)
""")
def variant_picks(t: Tables) -> DataFrame:
    """The best variant of each button, and the one taken with a margin."""
    names = F.element_at(F.array(*map(F.lit, ["primary", "spu", "hue", "blend"])), (F.col("event_id") % 4 + 1).cast("int"))
    rows = t.events.select(F.floor(F.col("event_id") / 4).alias("button"), names.alias("name"), (F.round("value", 1) / 100).alias("sim"), F.length("props").alias("len"), F.col("event_id").alias("pos"))
    return menus.variant_picks(rows, "button")


@query("""
    SELECT doc_id, CASE WHEN l.quality IS NOT NULL THEN 'fresh' ELSE 'known' END AS run, coalesce(CAST(l.quality AS BIGINT), d.n_chars) AS score FROM documents d FULL JOIN labels l USING (doc_id)
""")
def report_upsert(t: Tables) -> DataFrame:
    """A report's rows with newer ones of the same name in place."""
    known = t.documents.select("doc_id", F.lit("known").alias("run"), F.col("n_chars").cast("long").alias("score"))
    return menus.upsert(known, t.labels.select("doc_id", F.lit("fresh").alias("run"), F.col("quality").cast("long").alias("score")), "doc_id")


@query(r"""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"b": ["float"], "k": "int"}' WHEN event_id % 3 = 1 THEN '{"k": "int"}' END AS shape FROM events
""")
def json_shapes(t: Tables) -> DataFrame:
    """the types of JSON documents."""
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.regexp_replace("props", r"\}$", ', "b": [1.5, null]}')).when(k == 1, F.col("props")).otherwise(F.lit("{broken"))
    return t.events.select("event_id", json_shape(text).alias("shape"))
