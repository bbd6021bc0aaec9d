"""Queries of frame detectors: vectors as frames eight wide, six frames a menu."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.operators import frames
from discweave.plans.catalogue import Tables, query

LEVELS = "list_transform(embedding, lambda v: CAST(least(255, floor(abs(CAST(v AS DOUBLE)) * 600)) AS INT))"


def levels(t: Tables) -> DataFrame:
    level = lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 600)).cast("int")
    return t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 6).alias("menu"), F.transform("embedding", level).alias("cells"))


@query(f"""
    WITH f AS (SELECT vec_id, vec_id // 6 AS menu, {LEVELS} AS c FROM embeddings),
    p AS (SELECT menu, vec_id, c, lag(c) OVER (PARTITION BY menu ORDER BY vec_id) AS p FROM f),
    d AS (SELECT menu, vec_id, unnest(list_transform(range(1, len(c) + 1), lambda i: abs(c[i] - p[i]))) AS d, unnest(range(len(c))) AS i FROM p WHERE p IS NOT NULL),
    m AS (SELECT menu, max(mean) AS mean FROM (SELECT menu, vec_id, avg(d) AS mean FROM d GROUP BY 1, 2) GROUP BY 1),
    w AS (SELECT menu, i, max(d) AS d FROM d GROUP BY 1, 2),
    s AS (SELECT menu, CAST(sum(d) AS BIGINT) AS total, count(*) FILTER (WHERE d > 150) AS lit FROM w GROUP BY 1)
    SELECT g.menu, coalesce(mean, 0) < 70 AS still, total, lit FROM (SELECT DISTINCT menu FROM f) g LEFT JOIN m USING (menu) LEFT JOIN s USING (menu)
""")
def frame_differences(t: Tables) -> DataFrame:
    """Whether a menu moves, and its cells' greatest differences."""
    found = frames.differences(levels(t), "menu", "vec_id", "cells", moving=70.0)
    total = F.aggregate("widest", F.lit(0).cast("long"), lambda s, v: s + v)
    return found.select("menu", "still", total.alias("total"), F.when(F.col("widest").isNotNull(), F.size(F.filter("widest", lambda v: v > 150)).cast("long")).alias("lit"))


@query()
def difference_boxes(t: Tables) -> DataFrame:
    """Boxes of what lights up in menus that move."""
    return frames.difference_boxes(frames.differences(levels(t), "menu", "vec_id", "cells", moving=60.0), "menu", 8, 4, 170)


@query(f"""
    WITH f AS (SELECT vec_id, {LEVELS} AS c FROM embeddings),
    m AS (SELECT vec_id, c, list_min(c) AS lo, list_max(c) AS hi FROM f),
    e AS (SELECT vec_id, CASE WHEN hi > lo THEN list_transform(c, lambda v: CAST(least(255, greatest(0, floor(v * (255.0::DOUBLE / (hi - lo)) + -lo * (255.0::DOUBLE / (hi - lo))))) AS INT)) ELSE c END AS e FROM m),
    o AS (SELECT vec_id, e, unnest([1, 2, 3, 4]) AS x FROM e), p AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS y FROM o),
    s AS (SELECT vec_id, x, y, list_sum(list_transform(range(4), lambda i: CASE WHEN e[(y + i // 2) * 8 + x + i % 2 + 1] < 60 THEN 1 ELSE 0 END)) / 4.0 AS score FROM p)
    SELECT vec_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, 8 AS height, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0.5
""")
def dark_cores(t: Tables) -> DataFrame:
    """Dark squares of frames of full contrast."""
    return small_cores(t)


def small_cores(t: Tables) -> DataFrame:
    spread = levels(t).withColumn("cells", frames.contrast(F.col("cells")))
    return frames.dark_cores(spread, "vec_id", "cells", 8, 2, 1, 60, 0.5, (1, 7, 0, 1))


@query()
def dark_thumbnails(t: Tables) -> DataFrame:
    """Thumbnails around dark squares, best first without overlap, the upper three."""
    return frames.dark_thumbnails(small_cores(t), "vec_id", 8, 3, 2, 1, 1)
