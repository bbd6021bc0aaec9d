"""Queries of label text: cleaning, quality, choice among candidates, accuracy."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from discweave.functions import text
from discweave.operators import relational as rel
from discweave.operators import windows as win
from discweave.plans.catalogue import Tables, query


@query(r"""
    SELECT page_id, CASE WHEN t = '' THEN 'untitled' ELSE t END AS name FROM (
        SELECT page_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/|?*\\]', '', 'g'),
               '[\x00-\x1F]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 120), '[._]+$', '') AS t FROM pages)
""")
def sanitize_label(t: Tables) -> DataFrame:
    """file names from labels."""
    return t.pages.select("page_id", text.sanitize(F.col("url")).alias("name"))


@query(r"""
    WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '  S' || o_orderkey || 'E2   2/Nov' WHEN 1 THEN 'Part ' || o_orderkey || 'x O c t 3' WHEN 2 THEN 'C 366 and j a n'
                      WHEN 3 THEN o_orderpriority || E'\t' || o_orderstatus || ' 12 / Dec' WHEN 4 THEN 'O 0 ct B ' || o_orderkey % 100 ELSE '7days  8' || o_orderstatus END AS label FROM orders),
         a AS (SELECT o_orderkey, trim(regexp_replace(replace(label, E'\t', ' '), '\s+', ' ', 'g')) AS t FROM s),
         b AS (SELECT o_orderkey, regexp_replace(regexp_replace(t, '(\d)([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])(\d)', '\1 \2', 'g') AS t FROM a),
         c AS (SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\bJ\s*a\s*n\b', 'Jan', 'g'), '(?i)\bO\s*c\s*t\b', 'Oct', 'g'), '(?i)\bO\s*0\s*c\s*t\b', 'Oct', 'g'),
                      '(?i)\bN\s*o\s*v\b', 'Nov', 'g'), '(?i)\bD\s*e\s*c\b', 'Dec', 'g') AS t FROM b)
    SELECT o_orderkey, trim(regexp_replace(regexp_replace(regexp_replace(t, '\b([A-Za-z])\s+(\d{2,4})\b', '\1\2', 'g'), '\b(\d{1,2})\s*/\s*([A-Za-z]{3})\b', '\1 \2', 'g'), '\s+', ' ', 'g')) AS label FROM c
""")
def cleanup_text(t: Tables) -> DataFrame:
    """read labels made regular."""
    k = F.col("o_orderkey").cast("string")
    m = F.col("o_orderkey") % 6
    label = (
        F.when(m == 0, F.concat(F.lit("  S"), k, F.lit("E2   2/Nov"))).when(m == 1, F.concat(F.lit("Part "), k, F.lit("x O c t 3"))).when(m == 2, F.lit("C 366 and j a n"))
        .when(m == 3, F.concat("o_orderpriority", F.lit("\t"), "o_orderstatus", F.lit(" 12 / Dec"))).when(m == 4, F.concat(F.lit("O 0 ct B "), (F.col("o_orderkey") % 100).cast("string")))
        .otherwise(F.concat(F.lit("7days  8"), "o_orderstatus"))
    )
    return t.orders.select("o_orderkey", text.cleanup(label).alias("label"))


@query(r"""
    SELECT doc_id, round(CASE WHEN length(text) > 0 THEN 0.5 * length(regexp_replace(text, '[^\pL\pN .,!?''()-]', '', 'g')) / length(text)
        + 0.5 * length(regexp_replace(text, '[^\pL\pN]', '', 'g')) / length(text) ELSE 0 END, 6) AS quality FROM documents
""")
def text_quality(t: Tables) -> DataFrame:
    """how much of a text is what labels are made of."""
    return t.documents.select("doc_id", F.round(text.quality(F.col("text")), 6).alias("quality"))


@query(r"""
    WITH s AS (SELECT item_id, text AS t, list_transform(range(greatest(1, length(text) - 10)), lambda i: CASE WHEN (item_id + i) % 7 = 0 THEN -1.0 ELSE (item_id * 13 + i * 7) % 120 + 0.0 END) AS q FROM benchmark),
         c AS (SELECT item_id, t, q, list_sum(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN regexp_matches(t[i], '[\pL\pN .,!?''()-]') THEN least(1, greatest(0, coalesce(q[i], 0) / 100)) ELSE 0 END)) / length(t) AS w,
                      (length(regexp_replace(t, '[^\pL\pN .,!?''()-]', '', 'g')) + length(regexp_replace(t, '[^\pL\pN]', '', 'g'))) * 0.5 / length(t) AS p,
                      least(1, list_avg(list_filter(q, lambda x: x >= 0)) / 100) AS m FROM s)
    SELECT item_id, round(w, 6) AS weighted, round(m, 6) AS confidence, round(0.6 * w + 0.25 * p + 0.15 * m, 6) AS blended FROM c
""")
def weighted_and_blended_quality(t: Tables) -> DataFrame:
    """Quality weighted by the confidence of each character; the last ten have none."""
    label = F.col("text")
    confidences = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.length(label) - 10) - 1), lambda i: F.when((F.col("item_id") + i) % 7 == 0, F.lit(-1.0)).otherwise(((F.col("item_id") * 13 + i * 7) % 120).cast("double")))
    rows = t.benchmark.select("item_id", label.alias("t"), confidences.alias("q"))
    w, m = text.weighted_quality(F.col("t"), F.col("q")), text.mean_confidence(F.col("q"))
    return rows.select("item_id", F.round(w, 6).alias("weighted"), F.round(m, 6).alias("confidence"), F.round(text.blended_quality(w, text.quality(F.col("t")), m), 6).alias("blended"))


CANDIDATES = """c AS (SELECT event_id // 8 AS label, event_id AS pos, ['primary', 'spu_a', 'spu_b', 'spu_c', 'spu_d', 'spu_e', 'blend', 'hue'][event_id % 8 + 1] AS name,
    props || repeat('x', CAST(user_id % 4 AS INT)) AS txt, floor(value) / 100 AS quality FROM events)"""


@query(f"""
    WITH {CANDIDATES}, b AS (SELECT label, first({{'n': name, 't': txt, 'q': quality}} ORDER BY quality DESC, length(txt) DESC, pos) AS b,
        first({{'n': name, 't': txt, 'q': quality}} ORDER BY quality DESC, length(txt) DESC, pos) FILTER (WHERE name LIKE 'spu%') AS s FROM c WHERE name <> 'hue' GROUP BY 1),
    k AS (SELECT label, CASE WHEN b.q - s.q <= 0.01 AND abs(length(b.t) - length(s.t)) <= 2 THEN s ELSE b END AS c FROM b)
    SELECT label, c.n AS name, c.t AS txt, c.q AS quality FROM k
""")
def best_candidate(t: Tables) -> DataFrame:
    """The best of several readings, with a leaning to one family."""
    names = F.array(*map(F.lit, ["primary", "spu_a", "spu_b", "spu_c", "spu_d", "spu_e", "blend", "hue"]))
    rows = t.events.select(F.floor(F.col("event_id") / 8).alias("label"), F.col("event_id").alias("pos"), F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")).alias("name"), F.concat("props", F.repeat(F.lit("x"), (F.col("user_id") % 4).cast("int"))).alias("txt"), (F.floor("value") / 100).alias("quality"))
    return rel.best_candidate(rows, "label", "name", "txt", "quality", "pos")


@query("""
    WITH l AS (SELECT d.doc_id, lang, CASE WHEN quality = 1 THEN 'good ' || d.doc_id END AS fixture, row_number() OVER (PARTITION BY lang ORDER BY d.doc_id) AS k FROM documents d LEFT JOIN labels USING (doc_id)),
         m AS (SELECT *, CASE WHEN fixture IS NULL THEN sum(CAST(fixture IS NULL AS INT)) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) END AS n FROM l),
         r AS (SELECT item_id + 1 AS n, 'line ' || item_id AS line FROM benchmark)
    SELECT doc_id, CASE WHEN coalesce(fixture, line, '') = '' THEN 'untitled_' || doc_id ELSE replace(coalesce(fixture, line), ' ', '_') END AS label FROM m LEFT JOIN r USING (n)
""")
def stub_label(t: Tables) -> DataFrame:
    """A label from a fixture, else the next reference line, else the identifier."""
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", F.when(F.col("quality") == 1, F.concat(F.lit("good "), "doc_id")).alias("fixture"))
    missing = F.col("fixture").isNull()
    n = F.sum(missing.cast("long")).over(win.over(["lang"], ["doc_id"], rows=(win.Window.unboundedPreceding, 0)))
    rows = rows.withColumn("n", F.when(missing, n))
    lines = t.benchmark.select((F.col("item_id") + 1).alias("n"), F.concat(F.lit("line "), "item_id").alias("line"))
    raw = F.coalesce("fixture", "line", F.lit(""))
    return rows.join(lines, "n", "left").select("doc_id", F.when(raw == "", F.concat(F.lit("untitled_"), "doc_id")).otherwise(text.sanitize(raw)).alias("label"))


@F.arrow_udf(DoubleType())
def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Likeness of two labels by matching blocks, twice the matched length over both lengths."""
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@query()
def similarity_report(t: Tables) -> DataFrame:
    """Likeness of labels to what was expected, per group."""
    pairs = t.orders.select("o_orderpriority", text.normalise_label(F.concat("o_orderpriority", F.lit(" | "), F.col("o_custkey").cast("string"))).alias("expected"), F.concat("o_orderstatus", F.lit(" "), F.col("o_orderkey").cast("string")).alias("read"))
    scored = pairs.withColumn("s", ratio("expected", "read"))
    return scored.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.min("s"), 6).alias("worst"), F.sum((F.col("s") >= 0.5).cast("int")).alias("passed"))


@query(r"""
    SELECT doc_id, length(regexp_replace(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) AS n FROM documents
""")
def without_space(t: Tables) -> DataFrame:
    """texts compared without white space."""
    return t.documents.select("doc_id", F.length(text.without_space(F.col("text"))).cast("long").alias("n"))


@query(r"""
    WITH l AS (SELECT o_orderkey, o_orderkey // 10 AS log, CASE o_orderkey % 3 WHEN 0 THEN 'Track ' || (o_orderkey % 7) || ': AVSEQ' || (o_orderkey % 90 + 10) || '.MPG'
               WHEN 1 THEN 'Entry point: track ' || (o_orderkey % 5) || ' 00:' || (o_orderkey % 50 + 10) || ':00' ELSE 'noise ' || o_orderkey END AS line FROM orders)
    SELECT log, regexp_extract(line, '^Track (\d+)', 1) AS track, first(regexp_extract(line, ': (\S+)', 1) ORDER BY o_orderkey) AS what FROM l WHERE o_orderkey % 3 = 0 GROUP BY 1, 2
    UNION ALL SELECT log, regexp_extract(line, 'track (\d+)', 1), regexp_extract(line, '(\d\d:\d\d:\d\d)', 1) FROM l WHERE o_orderkey % 3 = 1
""")
def log_line_parse(t: Tables) -> DataFrame:
    """SRC8: tracks and entry points from the lines of a tool's log."""
    from discweave.sources.inventory import parse_tool_log

    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("Track "), (k % 7).cast("string"), F.lit(": AVSEQ"), (k % 90 + 10).cast("string"), F.lit(".MPG"))).when(k % 3 == 1, F.concat(F.lit("Entry point: track "), (k % 5).cast("string"), F.lit(" 00:"), (k % 50 + 10).cast("string"), F.lit(":00"))).otherwise(F.concat(F.lit("noise "), k.cast("string")))
    lines = t.orders.select(F.floor(k / 10).alias("log"), k.alias("pos"), line.alias("line"))
    tracks, entries = parse_tool_log(lines, "log", "line", "pos")
    return tracks.select("log", F.col("track_no").cast("string").alias("track"), F.col("file_name").alias("what")).unionByName(entries.select("log", F.col("track_no").cast("string").alias("track"), F.col("timecode").alias("what")))


@query(r"""
    SELECT p_partkey, CAST(p_partkey % 40 AS INT) AS n, CAST(p_partkey * 37 % 600 AS INT) AS x, CAST(p_partkey * 53 % 480 AS INT) AS y, CAST(19 + p_size * 2 AS INT) AS w, CAST(14 + p_size AS INT) AS h, p_name AS label FROM part
""")
def coordinate_lines(t: Tables) -> DataFrame:
    """Boxes and numbered labels from text lines."""
    x, y = F.col("p_partkey") * 37 % 600, F.col("p_partkey") * 53 % 480
    line = F.format_string("%d %d,%d - %d,%d", F.col("p_partkey") % 40, x, y, x + 19 + F.col("p_size") * 2, y + 14 + F.col("p_size"))
    named = F.concat((F.col("p_partkey") % 40).cast("string"), F.lit(". "), "p_name")
    return t.part.select("p_partkey", text.coordinate_line(line).alias("c"), text.numbered_line(named)["text"].alias("label")).select("p_partkey", "c.*", "label")


@query(r"""
    SELECT c_custkey, CAST(nullif(regexp_replace(substr(c_name, 6), '[^0-9]', '', 'g'), '') AS INT) AS track, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'VTSM_' || printf('%02d', c_nationkey) WHEN 2 THEN 'VMGM' ELSE NULL END AS base FROM customer
""")
def track_names(t: Tables) -> DataFrame:
    """SRC7 P14: numbers after a prefix, and menu names cut at their chain."""
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.lit("")).when(k == 1, text.menu_id(F.col("c_nationkey"), F.col("c_custkey") % 9)).when(k == 2, F.lit("VMGM"))
    return t.customer.select("c_custkey", text.track_number(F.col("c_name"), "Custo").alias("track"), text.menu_base(name).alias("base"))
