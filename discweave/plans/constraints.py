"""The constraint catalogue as data: (id, level, expression that holds), and its two uses.

``violations`` reports, ``enforce`` raises when evaluated; nothing drops rows. Expressions that
are null count as violated only where the rule says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    artifact: str
    holds: str  # SQL over the artefact's columns


RECT = "least({0}.x, {0}.y, {0}.w, {0}.h) >= 0 AND {0}.w <> 0 AND {0}.h <> 0"
KINDS = "kind IN ('dvd_cell', 'dvd_pgc', 'time_range', 'track', 'segment_item')"
UNIQUE = "size(array_distinct({0})) = size({0})"

ROW_RULES = [
    Rule("C1", "rect", "least(x, y, w, h) >= 0 AND w <> 0 AND h <> 0"),
    Rule("C2", "target", f"""{KINDS} AND CASE kind
        WHEN 'dvd_cell' THEN coalesce(title_id > 0 AND pgc_id > 0 AND cell_id > 0, false)
        WHEN 'dvd_pgc' THEN coalesce(title_id > 0 AND pgc_id > 0, false)
        WHEN 'time_range' THEN coalesce(start_time >= 0 AND end_time > start_time, false)
        WHEN 'track' THEN coalesce(track_no > 0, false)
        WHEN 'segment_item' THEN coalesce(item_no > 0, false) END"""),
    Rule("C3", "cell", """cell_id > 0 AND start_time >= 0 AND end_time > start_time
        AND (first_sector IS NULL) = (last_sector IS NULL)
        AND coalesce(first_sector >= 0 AND last_sector >= first_sector, true) AND coalesce(vob_id > 0, true)"""),
    Rule("C4", "pgc", "pgc_id > 0 AND " + UNIQUE.format("cells.cell_id")),
    Rule("C5", "title", "title_id > 0 AND " + UNIQUE.format("pgcs.pgc_id")),
    Rule("C6", "button", "length(button_id) > 0 AND length(menu_id) > 0 AND title_id > 0 AND pgc_id > 0"),
    Rule("C8", "nav", """(dvd IS NOT NULL) = (disc_format = 'DVD') AND (svcd IS NOT NULL) = (disc_format = 'SVCD')
        AND (vcd IS NOT NULL) = (disc_format = 'VCD') AND disc_format IN ('DVD', 'SVCD', 'VCD', 'UNKNOWN')"""),
    Rule("C9", "ingest", """(NOT has_video_ts OR (disc_type_guess = 'DVD' AND video_ts_report IS NOT NULL)) AND disc_report IS NOT NULL"""),
    Rule("C10", "track", "track_no > 0"),
    Rule("C12", "segment", "start_time >= 0 AND end_time >= 0 AND end_time > start_time"),
    Rule("C13", "ocr", """confidence BETWEEN 0 AND 1 AND source IN ('spu', 'background')
        AND spu_text_nonempty <> background_attempted AND (source = 'spu') = spu_text_nonempty"""),
    Rule("C14", "verify", "tolerance_sec >= 0"),
]

#: Columns that identify a row within its disc, by artefact.
KEYS = {"title": "title_id", "button": "button_id", "menu_entry": "entry_id", "menu_image": "entry_id", "ocr": "entry_id", "segment": "entry_id", "extract": "entry_id"}


def rule(rule_id: str) -> Rule:
    return next(r for r in ROW_RULES if r.id == rule_id)


def violations(df: DataFrame, artifact: str, key: str) -> DataFrame:
    """(key, rule) of every row that breaks a rule of its artefact; a rule that comes to null is broken."""
    broken = [F.when(~F.coalesce(F.expr(r.holds), F.lit(False)), F.lit(r.id)) for r in ROW_RULES if r.artifact == artifact]
    found = df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))
    return found


def repeated_keys(df: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Keys that occur more than once within their scope."""
    return df.groupBy(*scope, key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose key no owner has."""
    return df.join(owners.select(key).distinct(), key, "left_anti")


def enforce(df: DataFrame, artifact: str) -> DataFrame:
    """``df``, raising when a row that breaks a rule is evaluated."""
    guard = F.lit(True)
    for r in (r for r in ROW_RULES if r.artifact == artifact):
        guard = F.when(F.coalesce(F.expr(r.holds), F.lit(False)), guard).otherwise(F.raise_error(F.lit(f"{r.id} is violated")).cast("boolean"))
    return df.where(guard)


def outside(paths: DataFrame, path: str, base: str) -> DataFrame:
    """Paths that leave a base folder (C17), by their normal form."""
    root = base.rstrip("/") + "/"
    return paths.where(~F.col(path).startswith(root) | F.col(path).rlike(r"(^|/)\.\.(/|$)"))
