"""Queries of joins, reconciliation, aggregates and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.operators import relational as rel
from discweave.operators import windows as win
from discweave.plans import constraints
from discweave.plans.catalogue import Tables, query

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def lines(t: Tables) -> DataFrame:
    """Lines as cells of their order: sectors [lo, hi] by running quantity."""
    cells = t.lineitem.select("l_orderkey", *LINE_ORDER, "l_quantity")
    cells = cells.withColumn("lo", win.running_offset("l_quantity", ["l_orderkey"], LINE_ORDER))
    return cells.withColumn("hi", F.col("lo") + F.col("l_quantity"))


LINES_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey
        ROWS UNBOUNDED PRECEDING) - l_quantity AS lo,
    sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey
        ROWS UNBOUNDED PRECEDING) AS hi FROM lineitem"""


@query("""
    WITH chain AS (SELECT o_custkey, o_orderkey, sum(l_quantity) AS length FROM orders
                   JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
         placed AS (SELECT *, sum(length) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
                              ROWS UNBOUNDED PRECEDING) - length AS start_time FROM chain)
    SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS entry_id, start_time, start_time + length AS end_time,
           CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY start_time, CAST(o_orderkey AS VARCHAR)) AS INT) AS playback_order
    FROM placed
""")
def segment_timeline(t: Tables) -> DataFrame:
    """Every chain's segment on its title's clock, in playback order."""
    chain = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("length"))
    chain = t.orders.select("o_custkey", "o_orderkey").join(chain, F.col("o_orderkey") == F.col("l_orderkey"))
    chain = chain.withColumn("start_time", win.running_offset("length", ["o_custkey"], ["o_orderkey"]))
    out = chain.select("o_custkey", F.col("o_orderkey").cast("string").alias("entry_id"), "start_time", (F.col("start_time") + F.col("length")).alias("end_time"))
    return win.renumber(out, ["o_custkey"], ["start_time", "entry_id"]).drop("new_id")


@query("""
    SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers,
           count(DISTINCT (n_nationkey, c_mktsegment)) FILTER (WHERE c_mktsegment IS NOT NULL) AS segments
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
    GROUP BY r_name
""")
def hierarchy_summary(t: Tables) -> DataFrame:
    """A1 A3: counts along a hierarchy, level by level so that nothing is counted twice."""
    per_nation = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("c"), F.count_distinct("c_mktsegment").alias("s"))
    nations = t.nation.join(per_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    per_region = nations.groupBy("n_regionkey").agg(F.count("*").alias("nations"), F.sum("c").alias("customers"), F.sum("s").alias("segments"))
    out = t.region.join(per_region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return out.select("r_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nations", "customers", "segments")])


@query("""
    WITH o AS (SELECT o_orderkey, c_nationkey AS nation, o_custkey + 37 AS cust FROM orders JOIN customer ON c_custkey = o_custkey),
         m AS (SELECT c_nationkey AS nation, min(c_custkey) AS least FROM customer GROUP BY 1)
    SELECT o_orderkey, nation, cust, coalesce(c_custkey, least) AS target, c_custkey IS NULL AS remapped
    FROM o LEFT JOIN customer ON c_custkey = cust AND c_nationkey = nation LEFT JOIN m USING (nation)
""")
def fallback_remap(t: Tables) -> DataFrame:
    """A key looked up within its group, else the group's smallest."""
    left = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("nation"), (F.col("o_custkey") + 37).alias("cust"))
    right = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust"))
    return rel.lookup_with_fallback(left, right, "nation", "cust", "target")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def strict_lookup_check(t: Tables) -> DataFrame:
    """What a strict lookup would fail for."""
    orders = t.orders.select("o_orderkey", "o_custkey")
    return rel.misses(orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query("""
    WITH c AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer),
         s AS (SELECT s_nationkey AS nation, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS pos FROM supplier)
    SELECT nation, CAST(pos AS INT) AS pos, c_custkey, s_suppkey FROM c JOIN s USING (nation, pos)
""")
def positional_zip(t: Tables) -> DataFrame:
    """The n-th customer with the n-th supplier of a nation."""
    a = t.customer.select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    b = t.supplier.select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return rel.zip_positional(a, b, "nation", [F.desc("c_acctbal"), "c_custkey"], [F.desc("s_acctbal"), "s_suppkey"]).select("nation", "pos", "c_custkey", "s_suppkey")


@query("""
    WITH l AS (SELECT s_suppkey, s_nationkey AS nation, n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey),
         r AS (SELECT c_custkey, n_nationkey AS nation, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey - CASE WHEN c_nationkey % 3 = 0 AND c_nationkey > 0 THEN 1 ELSE 0 END),
         fl AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY s_suppkey) AS pos FROM l WHERE nation IN (SELECT nation FROM r)),
         fr AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY c_custkey) AS pos FROM r),
         cl AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY s_suppkey) AS pos FROM l WHERE nation NOT IN (SELECT nation FROM r)),
         cr AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY c_custkey) AS pos FROM r)
    SELECT s_suppkey, c_custkey, 'fine' AS level FROM fl JOIN fr USING (nation, pos)
    UNION ALL SELECT s_suppkey, c_custkey, 'coarse' FROM cl JOIN cr USING (region, pos)
""")
def two_level_target_match(t: Tables) -> DataFrame:
    """Positions within a nation, or within the region where the nation has none."""
    nations = t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    left = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation")).join(nations, "nation")
    near = F.col("c_nationkey") - F.when((F.col("c_nationkey") % 3 == 0) & (F.col("c_nationkey") > 0), 1).otherwise(0)  # so that some nations have none
    right = t.customer.select("c_custkey", near.cast(nations.schema["nation"].dataType).alias("nation")).join(nations, "nation")
    return rel.two_level_match(left, right, "nation", "region", ["s_suppkey"], ["c_custkey"]).select("s_suppkey", "c_custkey", "level")


@query("""
    WITH a AS (SELECT DISTINCT doc_id + 1 AS doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents)
    SELECT doc_id, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT doc_id, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def reconcile_ids(t: Tables) -> DataFrame:
    """Ids that one side lacks."""
    return rel.reconcile(t.labels.select((F.col("doc_id") + 1).alias("doc_id")), t.documents.select("doc_id"), "doc_id")


@query("""
    SELECT nation, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers
    FROM (SELECT coalesce(nullif(c_nationkey, 3), -1) AS nation, count(*) AS n FROM customer GROUP BY 1) a
    FULL JOIN (SELECT coalesce(nullif(s_nationkey, 5), -1) AS nation, count(*) AS n FROM supplier GROUP BY 1) b USING (nation)
""")
def full_outer_counts(t: Tables) -> DataFrame:
    """Counts on either side, 0 where there are none, null keys under one name."""
    a = t.customer.select(F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    b = t.supplier.select(F.nullif("s_nationkey", F.lit(5)).alias("nation"))
    return rel.full_outer_counts(a, b, "nation", "customers", "suppliers", -1)


@query("""
    SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus, p_brand, s_name, l_extendedprice
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
""")
def star_manifest(t: Tables) -> DataFrame:
    """All artefacts of an entry side by side."""
    out = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return out.select("o_orderkey", *LINE_ORDER, "o_orderstatus", "p_brand", "s_name", "l_extendedprice")


NEEDED = ["click", "error", "purchase", "refund", "signup", "view"]


@query("""
    WITH need AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS v),
         lack AS (SELECT user_id, v FROM (SELECT DISTINCT user_id FROM events), need
                  EXCEPT SELECT user_id, event_type FROM events)
    SELECT user_id, string_agg(v, ',' ORDER BY v) AS missing FROM lack GROUP BY user_id
""")
def required_minus_present(t: Tables) -> DataFrame:
    """What each group lacks of a required set."""
    return rel.missing_required(t.events, "user_id", "event_type", NEEDED).withColumn("missing", F.array_join("missing", ","))


@query(f"""
    WITH l AS (SELECT *, hi - 1 AS last FROM ({LINES_SQL})),
         f AS (SELECT l_orderkey, k, k * 40.0 AS f_lo, k * 40.0 + 39 AS f_hi
               FROM (SELECT l_orderkey, unnest(range(CAST(ceil(max(hi) / 40) AS BIGINT))) AS k FROM l GROUP BY l_orderkey))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k AS file_no,
           greatest(lo, f_lo) AS first, least(last, f_hi) AS last_sector
    FROM l JOIN f USING (l_orderkey) WHERE lo <= f_hi AND f_lo <= last
""")
def interval_overlap_inclusive(t: Tables) -> DataFrame:
    """Sector ranges against files, ends inclusive, by buckets."""
    ranges = lines(t).withColumn("last", F.col("hi") - 1)
    files = ranges.groupBy("l_orderkey").agg(F.ceil(F.max("hi") / 40).cast("long").alias("n"))
    files = files.select("l_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("file_no"))
    files = files.withColumn("f_lo", F.col("file_no") * 40.0).withColumn("f_hi", F.col("f_lo") + 39)
    out = rel.interval_overlap(ranges, files, ["l_orderkey"], "lo", "last", "f_lo", "f_hi", 40.0)
    return out.select("l_orderkey", *LINE_ORDER, "file_no", F.greatest("lo", "f_lo").alias("first"), F.least("last", "f_hi").alias("last_sector"))


@query(f"""
    WITH f AS ({LINES_SQL}),
         s AS (SELECT l_orderkey, k, k * 25.0 AS s_lo, least(k * 25.0 + 25, total) AS s_hi
               FROM (SELECT l_orderkey, max(hi) AS total, unnest(range(CAST(ceil(max(hi) / 25) AS BIGINT))) AS k FROM f GROUP BY l_orderkey))
    SELECT l_orderkey, k AS segment, l_linenumber, l_partkey, l_suppkey, greatest(0, s_lo - lo) AS rel_start,
           least(hi - lo, s_hi - lo) - greatest(0, s_lo - lo) AS duration
    FROM f JOIN s USING (l_orderkey) WHERE s_lo < hi AND lo < s_hi
""")
def segment_slices(t: Tables) -> DataFrame:
    """The parts of files that half-open segments take."""
    files = lines(t).withColumnsRenamed({"lo": "file_start", "hi": "file_end"})
    total = files.groupBy("l_orderkey").agg(F.max("file_end").alias("total"))
    segments = total.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / 25).cast("long") - 1)))
    segments = segments.select("l_orderkey", "segment", (F.col("segment") * 25.0).alias("seg_start"), F.least(F.col("segment") * 25.0 + 25, "total").alias("seg_end"))
    return rel.segment_slices(segments, files, ["l_orderkey"], 25.0).select("l_orderkey", "segment", *LINE_ORDER, "rel_start", "duration")


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                      l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) * o_totalprice AS share
               FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(share, 3) AS share,
           round(sum(share) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) - share, 3) AS start
    FROM s
""")
def proportional_duration(t: Tables) -> DataFrame:
    """A total dealt out by size."""
    both = t.lineitem.join(t.orders.select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = rel.proportional(both, "l_orderkey", "l_extendedprice", "o_totalprice", LINE_ORDER, "share")
    return out.select("l_orderkey", *LINE_ORDER, F.round("share", 3).alias("share"), F.round("offset", 3).alias("start"))


@query("""
    SELECT l_orderkey, min(l_partkey) FILTER (WHERE ok) AS first, max(l_partkey + l_linenumber) FILTER (WHERE ok) AS last,
           CASE WHEN bool_or(NOT ok) THEN NULL ELSE count(*) END AS ranges
    FROM (SELECT *, l_linenumber <> 7 AS ok FROM lineitem) GROUP BY l_orderkey
""")
def sector_envelope_null_rule(t: Tables) -> DataFrame:
    """The range of known ranges; any unknown one rules slicing out."""
    first = F.when(F.col("l_linenumber") != 7, F.col("l_partkey"))
    ranges = t.lineitem.select("l_orderkey", first.alias("a"), (first + F.col("l_linenumber")).alias("b"))
    return rel.envelope(ranges, "l_orderkey", "a", "b")


@query("""
    WITH d AS (SELECT o_orderkey, o_totalprice AS expected, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE actual END AS actual
               FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS actual FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
    SELECT o_orderkey, expected, actual, round(CASE WHEN actual >= 0 THEN actual - expected END, 2) AS delta,
           CASE WHEN actual IS NULL THEN 'missing' WHEN actual < 0 THEN 'error' WHEN abs(actual - expected) <= 20000 THEN 'ok' ELSE 'mismatch' END AS status,
           CASE WHEN actual >= 0 THEN abs(actual - expected) <= 20000 END AS within
    FROM d
""")
def duration_verify(t: Tables) -> DataFrame:
    """Expected against actual, with a tolerance."""
    sums = t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("actual"))
    both = t.orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    both = both.select("o_orderkey", F.col("o_totalprice").alias("expected"), F.when(F.col("o_orderkey") % 11 == 0, -1.0).otherwise(F.col("actual")).alias("actual"))
    return rel.verify_durations(both, "expected", "actual", 20000.0).withColumn("delta", F.round("delta", 2))


@query("""
    SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_done, count(*) AS n FROM orders GROUP BY 1
    UNION ALL SELECT c_custkey, true, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def all_done(t: Tables) -> DataFrame:
    """Whether all of a group is done; of nothing, all is."""
    per = t.orders.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_done"), F.count("*").alias("n"))
    out = t.customer.select(F.col("c_custkey").alias("o_custkey")).join(per, "o_custkey", "left")
    return out.select("o_custkey", F.coalesce("all_done", F.lit(True)).alias("all_done"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""
    WITH d AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
         l AS (SELECT lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
    SELECT lang, 'count_mismatch' AS code, d.n || ' vs ' || coalesce(l.n, 0) AS message FROM d LEFT JOIN l USING (lang) WHERE d.n <> coalesce(l.n, 0)
    UNION ALL SELECT lang, 'unlabelled', CAST(count(*) AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1
    UNION ALL SELECT lang, 'unexpected_kind', CAST(count(*) AS VARCHAR) FROM documents JOIN labels USING (doc_id) WHERE toxic NOT IN (0) GROUP BY 1
""")
def validation_issues(t: Tables) -> DataFrame:
    """Checks of two artefacts against each other, as rows."""
    docs, labels = t.documents.select("doc_id", "lang"), t.labels
    counts = rel.full_outer_counts(docs, labels.join(docs, "doc_id"), "lang", "n", "m").where("n <> m")
    issue = lambda df, code: df.groupBy("lang").agg(F.count("*").cast("string").alias("message")).select("lang", F.lit(code).alias("code"), "message")
    out = counts.select("lang", F.lit("count_mismatch").alias("code"), F.concat_ws(" vs ", "n", "m").alias("message"))
    out = out.unionByName(issue(docs.join(labels, "doc_id", "left_anti"), "unlabelled"))
    return out.unionByName(issue(docs.join(labels, "doc_id").where("toxic NOT IN (0)"), "unexpected_kind"))


@query("""
    SELECT 'rect' AS artifact, p_partkey AS id, 'C1' AS rule FROM part WHERE NOT (least(p_size - 3, p_size % 7, p_size % 5) >= 0 AND p_size % 7 <> 0 AND p_size % 5 <> 0)
    UNION ALL SELECT 'segment', event_id, 'C12' FROM events WHERE NOT coalesce(value - 5 >= 0 AND user_id >= 0 AND user_id > value - 5, false)
    UNION ALL SELECT 'ocr', event_id, 'C13' FROM events
    WHERE NOT coalesce(value / 100 BETWEEN 0 AND 1 AND event_type IN ('click', 'view') AND (event_type = 'click') <> (user_id % 2 = 0) , false)
""")
def constraint_violations(t: Tables) -> DataFrame:
    """Rows that break their artefact's rules."""
    rects = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") - 3).alias("x"), F.lit(0).alias("y"), (F.col("p_size") % 7).alias("w"), (F.col("p_size") % 5).alias("h"))
    segments = t.events.select(F.col("event_id").alias("id"), (F.col("value") - 5).alias("start_time"), F.col("user_id").alias("end_time"))
    source = F.when(F.col("event_type") == "click", "spu").when(F.col("event_type") == "view", "background").otherwise(F.col("event_type"))
    ocr = t.events.select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("confidence"), source.alias("source"), (F.col("event_type") == "click").alias("spu_text_nonempty"), (F.col("user_id") % 2 == 0).alias("background_attempted"))
    parts = [constraints.violations(df, name, "id").select(F.lit(name).alias("artifact"), "id", "rule") for name, df in (("rect", rects), ("segment", segments), ("ocr", ocr))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def repeated_keys(t: Tables) -> DataFrame:
    """Keys that occur more than once in their scope."""
    return constraints.repeated_keys(t.lineitem, ["l_orderkey"], "l_linenumber")


@query("""
    SELECT event_type, round(avg(value), 4) AS mean, round(var_pop(value), 3) AS variance, round(stddev_pop(value), 4) AS sigma,
           round(greatest(avg(value) + 1.5 * stddev_pop(value), 10), 4) AS threshold
    FROM events GROUP BY 1
""")
def mean_sigma_threshold(t: Tables) -> DataFrame:
    """A10: mean, variance, and a threshold of so many deviations with a floor."""
    limit = F.greatest(F.avg("value") + 1.5 * F.stddev_pop("value"), F.lit(10.0))
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.var_pop("value"), 3).alias("variance"), F.round(F.stddev_pop("value"), 4).alias("sigma"), F.round(limit, 4).alias("threshold"))


@query("""
    SELECT l_orderkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS upper, median(l_quantity) AS middle,
           list_sort(list(l_quantity))[len(list(l_quantity)) // 3 + 1] AS low, list_sort(list(l_quantity))[2 * len(list(l_quantity)) // 3 + 1] AS high
    FROM lineitem GROUP BY 1
""")
def upper_vs_true_median(t: Tables) -> DataFrame:
    """The upper and the true median, and the edges at fixed ranks."""
    v = "l_quantity"
    return t.lineitem.groupBy("l_orderkey").agg(rel.upper_median(v).alias("upper"), F.percentile(v, 0.5).alias("middle"), rel.rank_edge(v, 1).alias("low"), rel.rank_edge(v, 2).alias("high"))


@query("""
    WITH s AS (SELECT p_brand, count(*) AS n, quantile_cont(p_size, .25) AS a, quantile_cont(p_size, .75) AS b,
                      quantile_cont(p_retailprice, .25) AS c, quantile_cont(p_retailprice, .75) AS d FROM part GROUP BY 1)
    SELECT p_partkey, p_brand, p_size FROM part JOIN s USING (p_brand)
    WHERE NOT (n >= 6 AND b <> a AND d <> c AND p_size < a - .2 * (b - a) AND p_retailprice < c - .2 * (d - c))
""")
def iqr_outlier_filter(t: Tables) -> DataFrame:
    """Rows low in both columns go."""
    lo1, _, r1 = rel.iqr_bounds("p_size", 0.2)
    lo2, _, r2 = rel.iqr_bounds("p_retailprice", 0.2)
    stats = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), lo1.alias("a"), r1.alias("ra"), lo2.alias("c"), r2.alias("rc"))
    low = (F.col("n") >= 6) & (F.col("ra") != 0) & (F.col("rc") != 0) & (F.col("p_size") < F.col("a")) & (F.col("p_retailprice") < F.col("c"))
    return t.part.join(stats, "p_brand").where(~low).select("p_partkey", "p_brand", "p_size")


@query("""
    WITH r AS (SELECT p_partkey // 40 AS page, p_partkey, CAST(p_partkey * 53 % 480 AS INT) AS y1, CAST(p_partkey * 53 % 480 + p_size AS INT) AS y2, CAST(p_size + 1 AS INT) AS h FROM part),
         s AS (SELECT page, count(*) AS n, CAST(round_even(median(h), 0) AS INT) AS m, quantile_cont(h, .25) AS a, quantile_cont(h, .75) AS b FROM r GROUP BY 1),
         c AS (SELECT *, n >= 4 AND b <> a AND NOT (h < a - 0.2 * (b - a) OR h > b + 0.2 * (b - a)) AS fits, CAST(round_even(CAST((y1 + y2) / 2.0 - (m - 1) / 2.0 AS DOUBLE), 0) AS INT) AS top FROM r JOIN s USING (page))
    SELECT page, p_partkey, CAST(CASE WHEN NOT fits THEN y1 WHEN top < 0 THEN 0 WHEN top + m - 1 >= 500 THEN greatest(0, 499 - (m - 1)) ELSE top END AS INT) AS new_y1,
           CAST(CASE WHEN NOT fits THEN y2 WHEN top < 0 THEN least(499, m - 1) WHEN top + m - 1 >= 500 THEN 499 ELSE top + m - 1 END AS INT) AS new_y2 FROM c
""")
def regularise_heights(t: Tables) -> DataFrame:
    """Boxes inside the fences get the median height about their centre, within the frame."""
    y = (F.col("p_partkey") * 53 % 480).cast("int")
    rows = t.part.select(F.floor(F.col("p_partkey") / 40).alias("page"), "p_partkey", y.alias("y1"), (y + F.col("p_size")).alias("y2"))
    return rel.regularise_heights(rows, "page", "y1", "y2", 500, 4, 0.2).select("page", "p_partkey", "new_y1", "new_y2")


@query("""
    WITH b AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
         c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
         w AS (SELECT event_type, bin, round(sum(value), 6) AS w FROM (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, value FROM events) GROUP BY 1, 2)
    SELECT event_type, cut, peak FROM (SELECT event_type, min(bin) AS cut FROM c WHERE cum >= .75 * total GROUP BY 1)
    JOIN (SELECT event_type, first(bin ORDER BY w DESC, bin) AS peak FROM w GROUP BY 1) USING (event_type)
""")
def histogram_cut(t: Tables) -> DataFrame:
    """Where a histogram reaches a share, and its heaviest bin."""
    binned = t.events.select("event_type", "value", F.floor("value").cast("long").alias("bin"), F.floor(F.col("value") / 10).cast("long").alias("wide"))
    return rel.histogram_cut(binned, "event_type", "bin", 0.75).join(rel.weighted_peak(binned, "event_type", "wide", F.col("value")), "event_type")


@query("""
    WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, event_id, CAST(rn // greatest(1, n // 100) AS INT) AS pick FROM n
    WHERE rn % greatest(1, n // 100) = 0 AND rn // greatest(1, n // 100) < 100
""")
def stride_sample(t: Tables) -> DataFrame:
    """A systematic sample, which is what it is for."""
    return rel.stride_sample(t.events.select("event_type", "event_id"), "event_type", ["event_id"], 100)


@query("""
    SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INT) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 12
""")
def top_k_then_position(t: Tables) -> DataFrame:
    """The first by one order, numbered by another."""
    return rel.top_k(t.part, "p_brand", [F.desc("p_retailprice"), "p_partkey"], 12, ["p_size", "p_partkey"]).select("p_brand", "p_partkey", "pos")


@query("""
    SELECT conv_id, first(turn ORDER BY strlen(text) DESC, turn DESC) AS turn FROM conversations GROUP BY 1
""")
def longest_last(t: Tables) -> DataFrame:
    """The longest candidate, the last of equals."""
    sized = t.conversations.select("conv_id", "turn", F.octet_length("text").alias("size"), F.col("turn").alias("pos"))
    return rel.longest_last(sized, "conv_id", "turn", "size", "pos")


@query("""
    WITH s AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS signature FROM conversations GROUP BY 1),
         g AS (SELECT signature, min(conv_id) AS first_pos, count(*) AS n, string_agg(conv_id, ',' ORDER BY conv_id) AS members FROM s GROUP BY 1)
    SELECT signature, first_pos, n, members, CAST(row_number() OVER (ORDER BY first_pos) AS INT) AS config_id FROM g
""")
def signature_dedup(t: Tables) -> DataFrame:
    """Equal configurations once, numbered by first occurrence, with their members."""
    roles = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]), ">").alias("signature"))
    out = rel.signature_dedup(roles, ["signature"], "conv_id")
    return out.select("signature", "first_pos", "n", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("members"), "config_id")


@query("""
    SELECT user_id, event_type, first(value ORDER BY event_id DESC) AS value FROM events GROUP BY 1, 2
""")
def edge_union(t: Tables) -> DataFrame:
    """Of edges with one key the one written last."""
    return rel.union_edges(t.events.select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "value", "event_id")


@query("""
    WITH seen AS (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_type <> 'signup' GROUP BY 1, 2),
         last AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type <> 'signup' GROUP BY 1),
         want AS (SELECT DISTINCT user_id, b, i FROM events, (VALUES ('click', 0), ('view', 1), ('signup', 2), ('other', 3)) w(b, i))
    SELECT want.user_id, b AS button, CASE WHEN first IS NOT NULL THEN first WHEN b <> 'other' THEN coalesce(last, 0)
           ELSE least(1, i // 2) END AS page
    FROM want LEFT JOIN seen ON seen.user_id = want.user_id AND event_type = b LEFT JOIN last ON last.user_id = want.user_id
""")
def page_assignment(t: Tables) -> DataFrame:
    """The page of each button: first seen, else the last, else by its index."""
    seen = t.events.where("event_type <> 'signup'").select("user_id", F.col("event_type").alias("button"), F.col("event_id").alias("at"))
    wanted = [("click", 0, "known"), ("view", 1, "known"), ("signup", 2, "known"), ("other", 3, "unknown")]
    each = F.array(*[F.struct(F.lit(b).alias("button"), F.lit(i).alias("i"), F.lit(s).alias("state")) for b, i, s in wanted])
    buttons = t.events.select("user_id").distinct().select("user_id", F.inline(each))
    return rel.page_assignment(buttons, seen, "user_id", "button", "at", "state", "i", F.lit(4), F.lit(2)).select("user_id", "button", "page")


@query("""
    SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels USING (doc_id)
""")
def first_or_default(t: Tables) -> DataFrame:
    """The first match, else a default."""
    return rel.first_match_or_default(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), "doc_id", "quality", ["quality"], -1)
