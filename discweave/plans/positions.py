"""Queries of positional computations over events, lines and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.functions import text
from discweave.operators import folds
from discweave.operators import windows as win
from discweave.plans.catalogue import Tables, query


def seconds(t: Tables) -> DataFrame:
    """Events with their time as seconds, whole seconds cut off."""
    return t.events.select("event_id", "user_id", "event_type", "value", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))


SECONDS = "s AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"


@query("""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n,
                      lead(l_extendedprice, 2) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) - l_extendedprice AS spread FROM lineitem),
         b AS (SELECT l_orderkey, first(rn ORDER BY spread, rn) AS start FROM s WHERE spread IS NOT NULL GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM s LEFT JOIN b USING (l_orderkey)
    WHERE n <= 3 OR (rn >= start AND rn < start + 3)
""")
def min_spread_window(t: Tables) -> DataFrame:
    """The so many rows closest together."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey"]
    return win.min_spread_window(t.lineitem.select("l_orderkey", *keys, "l_extendedprice"), ["l_orderkey"], "l_extendedprice", keys, 3).select("l_orderkey", *keys)


@query(f"""
    WITH {SECONDS}, d AS (SELECT DISTINCT user_id, s // 3600 AS h FROM s),
    f AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY user_id ORDER BY h) <= 2 THEN 0 ELSE 1 END AS new FROM d),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY h ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT user_id, CAST(island AS BIGINT) AS island, min(h) AS first, max(h) AS last, count(*) AS n FROM g GROUP BY 1, 2
""")
def int_islands(t: Tables) -> DataFrame:
    """Stretches of integers at most two apart."""
    hours = seconds(t).select("user_id", F.floor(F.col("s") / 3600).alias("h"))
    return win.int_islands(hours, "user_id", "h", 2)


@query("""
    WITH a AS (SELECT *, value > 12 AS above FROM events),
    f AS (SELECT *, CASE WHEN above = lag(above) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM a),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM f)
    SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g WHERE above GROUP BY user_id, i HAVING count(*) >= 2
""")
def bool_bands(t: Tables) -> DataFrame:
    """Stretches above a threshold that are long enough."""
    return win.bands(t.events.select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", 12.0, "event_id", 2)


@query("""
    WITH s AS (SELECT p_partkey, p_size * 3 AS size, unnest(range(CAST(ceil(p_size * 3 / 40.0) AS INT))) AS k, CAST(ceil(p_size * 3 / 40.0) AS INT) AS n FROM part)
    SELECT p_partkey, CAST(k AS INT) AS part, CAST(size * k // n AS INT) AS first, CAST(size * (k + 1) // n - 1 AS INT) AS last FROM s
""")
def split_tall_bands(t: Tables) -> DataFrame:
    """Bands over a height in equal parts."""
    bands = t.part.select("p_partkey", F.lit(0).alias("first"), (F.col("p_size") * 3 - 1).alias("last"))
    return win.split_tall(bands, "first", "last", 40).select("p_partkey", "part", "first", "last")


@query(f"""
    WITH {SECONDS}, f AS (SELECT *, CASE WHEN s - lag(s + CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY s, event_id) > 7200 THEN 1 WHEN lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM s)
    SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM f
""")
def gap_split(t: Tables) -> DataFrame:
    """A new part where a row begins too far from the end of the one before."""
    timed = seconds(t).withColumn("end", F.col("s") + F.floor("value").cast("long"))
    return win.gap_groups(timed, ["user_id"], ["s", "event_id"], F.col("s"), "end", 7200).select("event_id", "user_id", "part")


@query(f"""
    WITH {SECONDS}, g AS (SELECT user_id, lead(s) OVER w - s AS gap, (lead(s) OVER w + s) / 2.0 AS mid FROM s WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
    SELECT user_id, first(mid ORDER BY gap DESC, mid) AS split, max(gap) AS gap FROM g WHERE gap IS NOT NULL GROUP BY 1
""")
def max_gap(t: Tables) -> DataFrame:
    """The middle of the widest gap."""
    return win.max_gap_split(seconds(t), "user_id", "s", ["event_id"])


@query("""
    WITH RECURSIVE s AS (SELECT l_orderkey, CAST(l_partkey AS BIGINT) * 1000 + l_suppkey * 10 + l_linenumber AS pos, CAST(l_quantity AS DOUBLE) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, CAST(l_partkey AS BIGINT) * 1000 + l_suppkey * 10 + l_linenumber) AS rn FROM lineitem),
    k AS (SELECT l_orderkey, rn, pos, 1 AS line, y AS anchor FROM s WHERE rn = 1
          UNION ALL SELECT s.l_orderkey, s.rn, s.pos, CASE WHEN abs(s.y - k.anchor) <= 6 THEN k.line ELSE k.line + 1 END, CASE WHEN abs(s.y - k.anchor) <= 6 THEN k.anchor ELSE s.y END
          FROM k JOIN s ON s.l_orderkey = k.l_orderkey AND s.rn = k.rn + 1)
    SELECT l_orderkey, pos, CAST(line AS INT) AS line, anchor FROM k
""")
def anchored_lines(t: Tables) -> DataFrame:
    """A row stays on a line while it is near the line's first row."""
    pos = F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return folds.anchored_lines(t.lineitem.withColumn("pos", pos), "l_orderkey", "l_quantity", "l_extendedprice", "pos", 6.0)


@query("""
    WITH f AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
    d AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, p), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / len(embedding) AS diff, p IS NULL AS first FROM f)
    SELECT vec_id, label, CAST(sum(CASE WHEN first OR diff > 0.14 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS page FROM d
""")
def page_segmentation(t: Tables) -> DataFrame:
    """A new page where a frame differs from the one before."""
    return win.page_segments(t.embeddings, ["label"], ["vec_id"], "embedding", 0.14).select("vec_id", "label", "page")


@query("""
    WITH v AS (SELECT vec_id, label, list_var_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM embeddings)
    SELECT label, first(vec_id ORDER BY v DESC, vec_id) AS vec_id, round(max(v), 6) AS variance FROM v GROUP BY 1
""")
def best_frame_by_variance(t: Tables) -> DataFrame:
    """The frame with the most contrast."""
    v = t.embeddings.withColumn("v", win.variance(F.col("embedding")))
    return v.groupBy("label").agg(F.max_by("vec_id", F.struct(F.col("v"), -F.col("vec_id"))).alias("vec_id"), F.round(F.max("v"), 6).alias("variance"))


@query("""
    WITH f AS (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
    SELECT vec_id, round(1 - sqrt(list_sum(list_transform(list_zip(embedding, p), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) / len(embedding)) / 255, 8) AS similarity FROM f WHERE p IS NOT NULL
""")
def image_similarity(t: Tables) -> DataFrame:
    """one less the root mean square difference."""
    pairs = t.embeddings.withColumn("p", F.lag("embedding").over(win.over(["label"], ["vec_id"]))).where("p IS NOT NULL")
    return pairs.select("vec_id", F.round(win.image_similarity(F.col("embedding"), F.col("p")), 8).alias("similarity"))


@query("""
    WITH b AS (SELECT p_partkey // 8 AS page, p_partkey % 8 AS k, CAST(60 + p_partkey % 11 AS INT) AS x1, CAST(600 + p_partkey % 7 AS INT) AS x2,
                      CAST(24 + p_partkey // 8 % 4 * 30 + p_partkey % 8 * 32 + CASE WHEN p_partkey % 8 > p_partkey // 8 % 9 THEN 40 ELSE 0 END AS INT) AS y1, p_size % 9 + 10 AS tall FROM part),
         r AS (SELECT page, x1, y1, x2, CAST(y1 + tall - 1 AS INT) AS y2, (y1 + y1 + tall - 1) / 2.0 AS c FROM b),
         g AS (SELECT *, lead(c) OVER (PARTITION BY page ORDER BY y1, x1) - c AS gap FROM r),
         s AS (SELECT page, count(*) AS n, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL))[(count(gap) // 2) + 1] AS step, CAST(list_sort(list(y2 - y1 + 1))[count(*) // 2 + 1] AS INT) AS tall,
                      list_sort(list(x1))[count(*) // 2 + 1] AS mx1, list_sort(list(x2))[count(*) // 2 + 1] AS mx2, min(c) AS first, max(c) AS last FROM g GROUP BY 1 HAVING count(*) BETWEEN 7 AND 9),
         m AS (SELECT page, 'gap' AS why, CAST(trunc(c + gap / 2.0) AS INT) AS mid, s.* EXCLUDE (page) FROM g JOIN s USING (page) WHERE gap > 1.5 * step
               UNION ALL SELECT page, 'top', CAST(trunc(first - step) AS INT), s.* EXCLUDE (page) FROM s WHERE first - 19 > 1.4 * step
               UNION ALL SELECT page, 'low', CAST(trunc(last + step) AS INT), s.* EXCLUDE (page) FROM s WHERE 442 - last > 1.4 * step),
         p AS (SELECT *, greatest(0, mid - greatest(8, tall // 2)) AS y1, least(479, mid + greatest(8, tall // 2)) AS y2 FROM m)
    SELECT page, x1, y1, x2, y2, false AS made FROM r
    UNION ALL SELECT page, mx1, CAST(y1 AS INT), mx2, CAST(y2 AS INT), true FROM p WHERE why = 'gap' OR why = 'top' AND y2 < 442 OR why = 'low' AND y1 > 19
""")
def fill_missing_bands(t: Tables) -> DataFrame:
    """Bands of regular spacing with the missing ones put in, between, above and below."""
    page, k = F.floor(F.col("p_partkey") / 8), F.col("p_partkey") % 8
    y = 24 + page % 4 * 30 + k * 32 + F.when(k > page % 9, 40).otherwise(0)
    rows = t.part.select(page.alias("page"), (60 + F.col("p_partkey") % 11).cast("int").alias("x1"), y.cast("int").alias("y1"), (600 + F.col("p_partkey") % 7).cast("int").alias("x2"), (y + F.col("p_size") % 9 + 9).cast("int").alias("y2"))
    return win.fill_missing(rows, "page", 7, 9, 0, 480)


@query("""
    SELECT c_custkey, CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS INT) AS key, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS INT), c_name) AS INT) AS pos,
           'btn' || c_custkey AS button, printf('VTSM_%02d_pgc%02d', c_nationkey, CAST(c_custkey % 7 AS INT)) AS menu
    FROM customer
""")
def digit_key_sort(t: Tables) -> DataFrame:
    """Order by the digits of a name, and made identifiers."""
    keyed = t.customer.withColumn("key", text.digit_key(F.col("c_name")))
    n = F.row_number().over(win.over(["c_nationkey"], ["key", "c_name"]))
    return keyed.select("c_custkey", "key", n.alias("pos"), text.button_id(F.col("c_custkey")).alias("button"), text.menu_id(F.col("c_nationkey"), F.col("c_custkey") % 7).alias("menu"))


@query("""
    SELECT o_orderkey, unnest(range(0, CAST(o_totalprice AS BIGINT) // 1000 + 1, 25)) AS at FROM orders
""")
def timestamps(t: Tables) -> DataFrame:
    """Times at a fixed step up to a length."""
    return t.orders.select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.round("o_totalprice") / 1000).cast("long"), F.lit(25).cast("long"))).alias("at"))


@query("""
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r,
                      sum(l_quantity) OVER (PARTITION BY l_orderkey) AS s, l_orderkey % 200 AS total FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN r = 1 AND total - s > 0.05 THEN d + total - s ELSE d END AS duration, CAST(greatest(total, s) AS DOUBLE) AS pgc FROM l
""")
def cell_reconcile(t: Tables) -> DataFrame:
    """Cells that fall short of their chain stretch the last one; longer ones lengthen the chain."""
    keys = ["l_linenumber", "l_partkey", "l_suppkey"]
    w = win.over(["l_orderkey"], [F.desc(c) for c in keys])
    rows = t.lineitem.withColumn("last", F.row_number().over(w) == 1).withColumn("s", F.sum("l_quantity").over(win.Window.partitionBy("l_orderkey"))).withColumn("total", (F.col("l_orderkey") % 200).cast("double"))
    short = F.col("total") - F.col("s")
    return rows.select("l_orderkey", *keys, F.when(F.col("last") & (short > 0.05), F.col("l_quantity") + short).otherwise(F.col("l_quantity")).alias("duration"), F.greatest("total", "s").alias("pgc"))


@query("""
    WITH r AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS a FROM events GROUP BY 1, 2)
    SELECT event_type, sum(n)::BIGINT AS total, count(*) AS suites, round(avg(a), 5) AS mean_of_means, round(sum(CASE WHEN a >= 10 THEN 1 ELSE 0 END) / count(*), 5) AS pass_rate, round(min(a), 5) AS worst, round(max(a), 5) AS best FROM r GROUP BY 1
""")
def suite_statistics(t: Tables) -> DataFrame:
    """Totals, rates and means of means over two levels."""
    per = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("a"))
    return per.groupBy("event_type").agg(F.sum("n").alias("total"), F.count("*").alias("suites"), F.round(F.avg("a"), 5).alias("mean_of_means"), F.round(F.avg((F.col("a") >= 10).cast("int")), 5).alias("pass_rate"), F.round(F.min("a"), 5).alias("worst"), F.round(F.max("a"), 5).alias("best"))


@query("""
    WITH t AS (SELECT o_orderkey AS pos, o_custkey AS grp, o_totalprice AS start FROM orders)
    SELECT grp, pos FROM (SELECT *, coalesce(max(start) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) WHERE start >= before
""")
def monotonic_starts(t: Tables) -> DataFrame:
    """Entries that do not go back behind an accepted one; what is refused never raises the bar."""
    rows = t.orders.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("start"))
    before = F.max("start").over(win.over(["grp"], ["pos"], rows=(win.Window.unboundedPreceding, -1)))
    return rows.withColumn("before", F.coalesce(before, F.lit(0.0))).where("start >= before").select("grp", "pos")


