"""The artefact pipeline: each stage a lazy DataFrame over many discs at once.

``STAGES`` maps a stage to what it needs and what builds it; :func:`select_stages` slices by
name, and :func:`run` builds only what the asked stages need. Artefacts are immutable: stages
that give entries new identifiers add columns to a new table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discweave.functions import text
from discweave.operators import relational as rel
from discweave.operators import windows as win

Tables = dict[str, DataFrame]


def timing(t: Tables) -> DataFrame:
    """The segment of every menu entry on its title's clock.

    Chains follow each other within a title by pgc_id; an entry covers its chain, or its cell
    if it names one. A target that the navigation does not have raises.
    """
    chains = t["cells"].groupBy("disc_id", "title_id", "pgc_id").agg(F.min("start_time").alias("_s"), F.max("end_time").alias("_e")).withColumn("length", F.col("_e") - F.col("_s"))
    offset = win.running_offset("length", ["disc_id", "title_id"], ["pgc_id"])
    chains = chains.withColumn("offset", offset)
    key = ["disc_id", "title_id", "pgc_id"]
    entries = t["menu_map"].join(chains, key, "left")
    cells = t["cells"].select(*key, "cell_id", F.col("start_time").alias("_cs"), F.col("end_time").alias("_ce"))
    entries = entries.join(cells, [*key, "cell_id"], "left")
    whole = F.col("kind") != "dvd_cell"
    start = F.col("offset") + F.when(whole, 0.0).otherwise(F.col("_cs") - F.col("_s"))
    end = F.col("offset") + F.when(whole, F.col("length")).otherwise(F.col("_ce") - F.col("_s"))
    out = entries.select("disc_id", "entry_id", start.alias("start_time"), end.alias("end_time"))
    return rel.required(rel.required(out, "start_time", "target without navigation"), "end_time", "target without navigation")


def segments(t: Tables) -> DataFrame:
    """Segments in playback order with new identifiers; ties are ordered by identifier as text."""
    return win.renumber(t["timing"], ["disc_id"], ["start_time", "entry_id"])


def menu_map(t: Tables) -> DataFrame:
    """Buttons with a target chain that exists: their own, else the smallest of the title."""
    chains = t["cells"].select("disc_id", "title_id", "pgc_id").distinct().withColumn("scope", F.struct("disc_id", "title_id"))
    buttons = t["buttons"].withColumn("scope", F.struct("disc_id", "title_id"))
    found = rel.lookup_with_fallback(buttons, chains, "scope", "pgc_id", "target_pgc")
    found = rel.required(found, "target_pgc", "title without chains")
    cell = F.col("cell_id") if "cell_id" in t["buttons"].columns else F.lit(None).cast("int")
    return found.select("disc_id", F.col("button_id").alias("entry_id"), "menu_id", "title_id", F.col("target_pgc").alias("pgc_id"), cell.alias("cell_id"), F.when(cell.isNull(), "dvd_pgc").otherwise("dvd_cell").alias("kind"), "remapped")


def menu_validation(t: Tables) -> DataFrame:
    """(disc_id, code, message): entries and buttons that do not agree, kinds that do not fit."""
    a = t["menu_map"].select("disc_id", F.col("entry_id").alias("id"))
    b = t["buttons"].select("disc_id", F.col("button_id").alias("id"))
    issue = lambda df, code: df.groupBy("disc_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("id"))).alias("message")).select("disc_id", F.lit(code).alias("code"), "message")
    counts = a.groupBy("disc_id").agg(F.count("*").alias("m")).join(b.groupBy("disc_id").agg(F.count("*").alias("n")), "disc_id", "full_outer").where("NOT (m <=> n)")
    counts = counts.select("disc_id", F.lit("count_mismatch").alias("code"), F.concat_ws(" vs ", F.coalesce("m", F.lit(0)), F.coalesce("n", F.lit(0))).alias("message"))
    wrong = t["menu_map"].where("kind NOT IN ('dvd_cell', 'dvd_pgc')").select("disc_id", F.col("entry_id").alias("id"))
    return issue(b.join(a, ["disc_id", "id"], "left_anti"), "missing_in_menu_map").unionByName(issue(a.join(b, ["disc_id", "id"], "left_anti"), "missing_in_nav_buttons")).unionByName(counts).unionByName(issue(wrong, "unexpected_target_kind"))


def labels(t: Tables) -> DataFrame:
    """Labels without a reader: an entry's fixture text, else the next unused reference line of its
    disc in entry order, else nothing; empty labels are named after the entry."""
    entries = t["menu_map"].select("disc_id", "entry_id", text.digit_key(F.col("entry_id")).alias("_k"))
    known = entries.join(t["label_texts"].select("disc_id", "entry_id", "fixture"), ["disc_id", "entry_id"], "left")
    missing = F.col("fixture").isNull()
    w = Window.partitionBy("disc_id").orderBy("_k", "entry_id").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("n", F.when(missing, F.sum(missing.cast("int")).over(w)))
    read = known.join(t["reference_lines"].select("disc_id", F.col("n").cast("bigint").alias("n"), "line"), ["disc_id", "n"], "left")
    raw = F.coalesce("fixture", "line", F.lit(""))
    clean = text.sanitize(text.cleanup(raw))
    return read.select("disc_id", "entry_id", raw.alias("raw_text"), F.when(F.trim(raw) == "", F.concat(F.lit("untitled_"), "entry_id")).otherwise(clean).alias("cleaned_label"), F.lit(0.9).alias("confidence"), F.lit("spu").alias("source"))


def extract(t: Tables) -> DataFrame:
    """Slices of the disc's files that each segment takes."""
    files = t["media_files"].withColumn("file_start", win.running_offset("seconds", ["disc_id"], ["path"])).withColumn("file_end", F.col("file_start") + F.col("seconds"))
    seg = t["segments"].select("disc_id", "entry_id", "playback_order", F.col("start_time").alias("seg_start"), F.col("end_time").alias("seg_end"))
    return rel.segment_slices(seg, files.select("disc_id", "path", "file_start", "file_end"), ["disc_id"], 600.0).select("disc_id", "entry_id", "playback_order", "path", "rel_start", "duration")


def verify_extract(t: Tables) -> DataFrame:
    """Each segment's expected length against what was cut."""
    cut = t["extract"].groupBy("disc_id", "entry_id").agg(F.sum("duration").alias("actual"))
    both = t["segments"].withColumn("expected", F.col("end_time") - F.col("start_time")).join(cut, ["disc_id", "entry_id"], "left")
    return rel.verify_durations(both, "expected", "actual", 1.0).select("disc_id", "entry_id", "expected", "actual", "delta", "within", "status")


def finalize(t: Tables) -> DataFrame:
    """The manifest: one row per entry, all artefacts joined, with its output name."""
    key = ["disc_id", "entry_id"]
    rows = t["segments"].join(t["labels"], key).join(t["verify_extract"].select(*key, "status", "within"), key)
    rows = rows.join(t["menu_map"].select(*key, "menu_id", "title_id", "pgc_id", "kind"), key)
    n = F.row_number().over(Window.partitionBy("disc_id").orderBy("playback_order", "entry_id"))
    return rows.withColumn("output_index", n).withColumn("output_name", F.concat(text.output_prefix(F.col("output_index")), "cleaned_label", F.lit(".mkv")))


#: stage: (tables it reads, what builds it)
STAGES: dict[str, tuple[list[str], Callable[[Tables], DataFrame]]] = {
    "menu_map": (["buttons", "cells"], menu_map),
    "menu_validation": (["menu_map", "buttons"], menu_validation),
    "timing": (["menu_map", "cells"], timing),
    "segments": (["timing"], segments),
    "labels": (["menu_map", "label_texts", "reference_lines"], labels),
    "extract": (["segments", "media_files"], extract),
    "verify_extract": (["segments", "extract"], verify_extract),
    "finalize": (["segments", "labels", "verify_extract", "menu_map"], finalize),
}


def select_stages(stage: str | None = None, until: str | None = None, start: str | None = None) -> list[str]:
    """One stage, a prefix or a suffix of the list; at most one of the three may be given."""
    if sum(x is not None for x in (stage, until, start)) > 1:
        raise ValueError("give one of stage, until and start")
    names = list(STAGES)
    for x in (stage, until, start):
        if x is not None and x not in names:
            raise ValueError(f"unknown stage {x!r}; there are {', '.join(names)}")
    if stage:
        return [stage]
    return names[: names.index(until) + 1] if until else names[names.index(start) :] if start else names


def run(tables: Tables, stages: list[str] | None = None) -> Tables:
    """``tables`` with the artefacts of ``stages``; what they need and is not there raises."""
    out = dict(tables)
    for name in stages or list(STAGES):
        needs, build = STAGES[name]
        if lacking := [n for n in needs if n not in out]:
            raise ValueError(f"{name} needs {', '.join(lacking)}")
        out[name] = build(out)
    return out
