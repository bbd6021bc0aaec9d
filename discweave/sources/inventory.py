"""Disc folders and text artefacts as DataFrames.

A file table has disc_id, path (relative to the disc, ``/``) and size_bytes; :func:`list_files`
makes one from folders that Spark can list, without opening a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from discweave.functions import text

# What tells the formats apart.
DVD_DIR = r"(?i)^VIDEO_TS/"
SVCD_CONTROL, SVCD_MEDIA = r"(?i)^SVCD/(INFO|ENTRIES|SEARCH|TRACKS)\.(SVD|DAT)$", r"(?i)^MPEG2/.*\.MPG$"
VCD_CONTROL, VCD_MEDIA = r"(?i)^VCD/(INFO|ENTRIES|LOT|PSD)\.VCD$", r"(?i)^MPEGAV/.*\.(DAT|MPG)$"
REQUIRED = ["VIDEO_TS.BUP", "VIDEO_TS.IFO"]
TITLE_FILE = r"(?i)^VTS_(\d{2})_0\.IFO$"
TRACKS = {"DVD": r"(?i)^VIDEO_TS/VTS_\d\d_[1-9]\.VOB$", "SVCD": r"(?i)^MPEG2/AVSEQ\d+\.MPG$", "VCD": r"(?i)^MPEGAV/AVSEQ\d+\.DAT$"}


def list_files(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """The files under each folder, by disc id; contents are not read."""
    parts = []
    for disc, folder in sorted(folders.items()):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
        base = F.lit(folder.rstrip("/").removeprefix("file:").lstrip("/"))
        relative = F.expr("substring(p, instr(p, b) + length(b) + 1)")
        parts.append(found.select(F.lit(disc).alias("disc_id"), F.col("path").alias("p"), base.alias("b"), F.col("length").alias("size_bytes")).select("disc_id", relative.alias("path"), "size_bytes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per file, whatever patterns matched it and however it was spelled."""
    w = Window.partitionBy("disc_id", F.lower("path")).orderBy("path")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(path, r"\.([^./]+)$", 1), F.lit("")))


def disc_formats(files: DataFrame) -> DataFrame:
    """(disc_id, disc_format): DVD before SVCD before VCD, else UNKNOWN."""
    has = lambda pattern: F.bool_or(F.col("path").rlike(pattern))
    kind = F.when(has(DVD_DIR), "DVD").when(has(SVCD_CONTROL) & has(SVCD_MEDIA), "SVCD").when(has(VCD_CONTROL) & has(VCD_MEDIA), "VCD").otherwise("UNKNOWN")
    return files.groupBy("disc_id").agg(kind.alias("disc_format"))


def disc_report(files: DataFrame) -> DataFrame:
    """Counts, sizes, directories and media totals of every disc."""
    files = distinct_files(files)
    total = lambda pattern, what: F.coalesce(F.sum(F.when(F.col("path").rlike(pattern), what)), F.lit(0))
    kinds = disc_formats(files)
    report = files.groupBy("disc_id").agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"),
        F.array_sort(F.collect_set(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")))).alias("directories"),
        total(SVCD_MEDIA, F.lit(1)).alias("mpeg2_file_count"), total(SVCD_MEDIA, F.col("size_bytes")).alias("mpeg2_total_bytes"),
        total(VCD_MEDIA, F.lit(1)).alias("mpegav_file_count"), total(VCD_MEDIA, F.col("size_bytes")).alias("mpegav_total_bytes"),
    )
    tracks = video_tracks(files).groupBy("disc_id").agg(F.count("*").alias("video_track_count"), F.array_sort(F.collect_list("path")).alias("video_track_files"))
    out = report.join(kinds, "disc_id").join(tracks, "disc_id", "left")
    return out.withColumn("video_track_count", F.coalesce("video_track_count", F.lit(0))).withColumn("video_track_files", F.coalesce("video_track_files", F.array().cast("array<string>")))


def video_tracks(files: DataFrame) -> DataFrame:
    """(disc_id, path, pos) of the programme files of each disc's format."""
    rule = None
    for kind, pattern in TRACKS.items():
        hit = (F.col("disc_format") == kind) & F.col("path").rlike(pattern)
        rule = hit if rule is None else rule | hit
    found = files.join(disc_formats(files), "disc_id").where(rule)
    return found.select("disc_id", "path", F.row_number().over(Window.partitionBy("disc_id").orderBy("path")).alias("pos"))


def video_ts_report(files: DataFrame) -> DataFrame:
    """Totals of VIDEO_TS folders by kind, number of titles, and the required files that lack."""
    inside = distinct_files(files).where(F.col("path").rlike(r"(?i)^VIDEO_TS/[^/]+$")).withColumn("name", name(F.col("path"))).withColumn("ext", extension(F.col("path")))
    size = lambda ext: F.coalesce(F.sum(F.when(F.col("ext") == ext, F.col("size_bytes"))), F.lit(0))
    return inside.groupBy("disc_id").agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"),
        F.count_distinct(F.nullif(F.regexp_extract("name", TITLE_FILE, 1), F.lit(""))).alias("vts_title_count"),
        size("IFO").alias("ifo_total_bytes"), size("BUP").alias("bup_total_bytes"), size("VOB").alias("vob_total_bytes"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), "name", "size_bytes"))), lambda f: F.struct(f["name"].alias("name"), f["size_bytes"].alias("size_bytes"))).alias("files"),
        F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), F.collect_set(F.upper("name")))).alias("missing"),
    )


def title_files(files: DataFrame) -> DataFrame:
    """(disc_id, title_id, path) of the title set files, by title."""
    return files.withColumn("title_id", F.nullif(F.regexp_extract(name(F.col("path")), TITLE_FILE, 1), F.lit("")).cast("int")).where("title_id IS NOT NULL").select("disc_id", "title_id", "path")


def directory_navigation(files: DataFrame, kind: str) -> DataFrame:
    """Tracks and control-file flags of SVCD or VCD discs, from names alone."""
    control, pattern, prefix = (SVCD_CONTROL, TRACKS["SVCD"], "AVSEQ") if kind == "SVCD" else (VCD_CONTROL, TRACKS["VCD"], "AVSEQ")
    own = files.join(disc_formats(files).where(F.col("disc_format") == kind), "disc_id")
    tracks = own.where(F.col("path").rlike(pattern)).select("disc_id", F.struct(text.track_number(name(F.col("path")), prefix).alias("track_no"), name(F.col("path")).alias("file_name"), "size_bytes").alias("t"))
    flags = own.groupBy("disc_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("path").rlike(control), F.struct(F.upper(name(F.col("path"))), F.lit(True)))))).alias("control_files"))
    return tracks.groupBy("disc_id").agg(F.array_sort(F.collect_list("t")).alias("tracks")).join(flags, "disc_id")


def heuristic_navigation(files: DataFrame, seconds: float = 600.0) -> DataFrame:
    """One chain, cell and button per programme file, for discs whose tables cannot be read."""
    n = F.row_number().over(Window.partitionBy("disc_id").orderBy("path"))
    found = files.where(F.col("path").rlike(TRACKS["DVD"])).withColumn("n", n)
    return found.select("disc_id", F.lit(1).alias("title_id"), F.col("n").alias("pgc_id"), F.col("n").alias("cell_id"), F.lit(0.0).alias("start_time"), F.lit(seconds).alias("end_time"), text.button_id(F.col("n")).alias("button_id"), "path")


def parse_tool_log(lines: DataFrame, group: str, line: str, pos: str) -> tuple[DataFrame, DataFrame]:
    """Tracks and entry points from log lines; of a repeated track number the first line counts."""
    found = lines.select(group, pos, text.track_line(F.col(line)).alias("t"), text.entry_line(F.col(line)).alias("e"))
    tracks = found.where("t IS NOT NULL").groupBy(group, "t.track_no").agg(F.min_by("t.file_name", pos).alias("file_name"))
    entries = found.where("e IS NOT NULL").select(group, pos, "e.track_no", "e.timecode")
    return tracks, entries


def reference_lines(lines: DataFrame, group: str, line: str, pos: str) -> DataFrame:
    """Lines of reference text: byte order mark off, stripped, empty ones out, numbered from 1."""
    clean = lines.withColumn(line, text.strip(F.regexp_replace(line, "^﻿", ""))).where(F.col(line) != "")
    return clean.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(pos)))
