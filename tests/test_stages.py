import json

import pytest
from pyspark.sql import functions as F

from discweave.plans import constraints, stages
from discweave.sources import artifacts, inventory
from discweave.sources.adapters import StubMedia, ToolError, cut_commands, input_flags, run_tool

CELLS = "disc_id string, title_id int, pgc_id int, cell_id int, start_time double, end_time double"
BUTTONS = "disc_id string, button_id string, menu_id string, title_id int, pgc_id int"


def tables(spark):
    cells = [("d", 1, p, 1, 0.0, 600.0) for p in (1, 2, 3)]
    buttons = [("d", f"btn{p}", "dvd_root", 1, p) for p in (1, 2)] + [("d", "btn10", "dvd_root", 1, 9)]
    return {
        "cells": spark.createDataFrame(cells, CELLS),
        "buttons": spark.createDataFrame(buttons, BUTTONS),
        "label_texts": spark.createDataFrame([("d", "btn1", "Episode 1")], "disc_id string, entry_id string, fixture string"),
        "reference_lines": spark.createDataFrame([("d", 1, "פרק 2")], "disc_id string, n int, line string"),
        "media_files": spark.createDataFrame([("d", "a.vob", 900.0), ("d", "b.vob", 900.0)], "disc_id string, path string, seconds double"),
    }


def test_whole_run(spark, rows):
    out = stages.run(tables(spark))
    assert rows(out["menu_map"], "entry_id", "pgc_id", "remapped") == [("btn1", 1, False), ("btn10", 1, True), ("btn2", 2, False)]
    # equal starts are ordered by identifier as text
    assert rows(out["segments"], "playback_order", "entry_id", "start_time", "end_time") == [(1, "btn1", 0.0, 600.0), (2, "btn10", 0.0, 600.0), (3, "btn2", 600.0, 1200.0)]
    assert rows(out["labels"], "entry_id", "cleaned_label") == [("btn1", "Episode_1"), ("btn10", "untitled_btn10"), ("btn2", "פרק_2")]
    assert rows(out["extract"].where("entry_id = 'btn2'"), "path", "rel_start", "duration") == [("a.vob", 600.0, 300.0), ("b.vob", 0.0, 300.0)]
    assert rows(out["verify_extract"], "entry_id", "status") == [("btn1", "ok"), ("btn10", "ok"), ("btn2", "ok")]
    assert rows(out["finalize"], "output_name") == [("01_Episode_1.mkv",), ("02_untitled_btn10.mkv",), ("03_פרק_2.mkv",)]
    assert out["menu_validation"].count() == 0


def test_missing_navigation_raises(spark):
    t = tables(spark)
    t["buttons"] = t["buttons"].withColumn("title_id", F.lit(7))
    with pytest.raises(Exception, match="title without chains"):
        stages.run(t, ["menu_map"])["menu_map"].collect()
    with pytest.raises(ValueError, match="needs"):
        stages.run({}, ["timing"])


def test_stage_selection():
    assert stages.select_stages(until="timing") == ["menu_map", "menu_validation", "timing"]
    assert stages.select_stages(start="verify_extract") == ["verify_extract", "finalize"]
    assert stages.select_stages(stage="labels") == ["labels"] and len(stages.select_stages()) == len(stages.STAGES)
    with pytest.raises(ValueError):
        stages.select_stages(stage="labels", until="timing")
    with pytest.raises(ValueError):
        stages.select_stages(stage="nothing")


def test_constraints(spark, rows):
    segment = spark.createDataFrame([("a", 0.0, 1.0), ("b", -1.0, 1.0), ("c", 2.0, 2.0), ("d", None, 2.0)], "entry_id string, start_time double, end_time double")
    assert rows(constraints.violations(segment, "segment", "entry_id")) == [("b", "C12"), ("c", "C12"), ("d", "C12")]
    with pytest.raises(Exception, match="C12"):
        constraints.enforce(segment, "segment").collect()
    target = "kind string, title_id int, pgc_id int, cell_id int, track_no int, item_no int, start_time double, end_time double"
    found = spark.createDataFrame([("dvd_pgc", 1, 1, None, None, None, None, None), ("track", None, None, None, 0, None, None, None), ("time_range", None, None, None, None, None, 1.0, 2.0), ("x", 1, 1, 1, 1, 1, 1.0, 2.0)], target)
    assert rows(constraints.violations(found, "target", "kind")) == [("track", "C2"), ("x", "C2")]
    ocr = spark.createDataFrame([("a", 0.9, "spu", True, False), ("b", 0.9, "spu", True, True), ("c", 1.2, "background", False, True)], "entry_id string, confidence double, source string, spu_text_nonempty boolean, background_attempted boolean")
    assert rows(constraints.violations(ocr, "ocr", "entry_id")) == [("b", "C13"), ("c", "C13")]
    cells = "disc string, pgc_id int, cells array<struct<cell_id:int>>"
    pgc = spark.createDataFrame([("d", 1, [(1,), (2,)]), ("e", 1, [(1,), (1,)])], cells)
    assert rows(constraints.violations(pgc, "pgc", "disc")) == [("e", "C4")]
    paths = spark.createDataFrame([("/out/a",), ("/out/../b",), ("/outside",)], "p string")
    assert rows(constraints.outside(paths, "p", "/out")) == [("/out/../b",), ("/outside",)]


def test_strict_artifacts(spark, tmp_path, rows):
    schema = spark.createDataFrame([], "ok boolean, items array<struct<id:string,n:int>>").schema
    good = tmp_path / "good.json"
    good.write_text(json.dumps({"ok": True, "items": [{"id": "a", "n": None}]}))
    df = artifacts.read_artifact(spark, str(good), schema)
    artifacts.write_artifact(df, str(tmp_path / "out" / "again.json"))
    assert json.loads((tmp_path / "out" / "again.json").read_text()) == {"ok": True, "items": [{"id": "a", "n": None}]}
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"ok": True, "items": [{"id": "a", "extra": 1}]}))
    with pytest.raises(artifacts.ArtifactError, match=r"items\[0\].extra"):
        artifacts.read_artifact(spark, str(bad), schema)
    lines = spark.createDataFrame([('{"ok": true}',), ('{"ok": true, "x": 1}',), ("no",)], "line string")
    assert [r[0] for r in artifacts.strict_json(lines, "line", schema).select("violations").collect()] == [[], ["x"], ["malformed"]]
    assert artifacts.mirror_json(str(tmp_path), str(tmp_path / "m")) == ["bad.json", "good.json", "out/again.json"]
    assert artifacts.inside(str(tmp_path), str(tmp_path / "x")) and not artifacts.inside(str(tmp_path), str(tmp_path / ".." / "x"))


def test_byte_range_copy(tmp_path):
    (tmp_path / "a").write_bytes(b"0123456789")
    (tmp_path / "b").write_bytes(b"abcdef")
    n = artifacts.copy_range([(str(tmp_path / "a"), 7, 9), (str(tmp_path / "b"), 0, 1)], str(tmp_path / "c"), chunk=2)
    assert n == 5 and (tmp_path / "c").read_bytes() == b"789ab"
    with pytest.raises(artifacts.ArtifactError):
        artifacts.rename_outputs([(str(tmp_path / "a"), str(tmp_path / "b"))], overwrite=False)


def test_inventories(spark, rows, tmp_path):
    for name in ("VIDEO_TS/VTS_01_0.IFO", "VIDEO_TS/VTS_01_1.VOB", "VIDEO_TS/VTS_02_0.IFO", "VIDEO_TS/VIDEO_TS.IFO"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    files = inventory.list_files(spark, {"dvd": f"file://{tmp_path}"})
    more = [("svcd", "SVCD/INFO.SVD", 1), ("svcd", "MPEG2/AVSEQ01.MPG", 10), ("vcd", "VCD/INFO.VCD", 1), ("vcd", "MPEGAV/AVSEQ02.DAT", 9), ("odd", "readme", 1)]
    files = files.unionByName(spark.createDataFrame(more, "disc_id string, path string, size_bytes long"))
    assert rows(inventory.disc_formats(files)) == [("dvd", "DVD"), ("odd", "UNKNOWN"), ("svcd", "SVCD"), ("vcd", "VCD")]
    report = inventory.video_ts_report(files).first()
    assert (report.file_count, report.total_bytes, report.vts_title_count, report.missing) == (4, 20, 2, ["VIDEO_TS.BUP"])
    assert rows(inventory.disc_report(files), "disc_id", "video_track_count") == [("dvd", 1), ("odd", 0), ("svcd", 1), ("vcd", 1)]
    assert inventory.directory_navigation(files, "VCD").first()["tracks"][0]["track_no"] == 2
    assert inventory.heuristic_navigation(files).first()["button_id"] == "btn1"
    twice = spark.createDataFrame([("d", "A/b", 1), ("d", "a/B", 1)], "disc_id string, path string, size_bytes long")
    assert inventory.distinct_files(twice).count() == 1
    text_lines = spark.createDataFrame([("r", "﻿ one ", 1), ("r", "  ", 2), ("r", "two", 3)], "g string, line string, pos int")
    assert rows(inventory.reference_lines(text_lines, "g", "line", "pos").select("n", "line")) == [(1, "one"), (2, "two")]


def test_adapters():
    assert StubMedia().duration("x") == 600.0
    with pytest.raises(ToolError, match="not installed"):
        run_tool(["no-such-tool-here"])
    with pytest.raises(ToolError, match="failed"):
        run_tool(["false"])
    with pytest.raises(ToolError, match="more than"):
        run_tool(["sleep", "5"], timeout=0.1)
    assert len(list(cut_commands([("a", 0, 1)], "out"))) == 1 and len(list(cut_commands([("a", 0, 1), ("b", 0, 1)], "out", "safe"))) == 3
    with pytest.raises(ValueError):
        input_flags("wild")
