import pytest
from pyspark.sql import functions as F

from discweave.functions import geometry as geo
from discweave.functions import text
from discweave.operators import folds
from discweave.operators import relational as rel
from discweave.operators import windows as win


def test_anchored_lines_are_not_gap_lines(spark, rows):
    ys = [0, 4, 8, 12, 16, 30, 33]
    df = spark.createDataFrame([("p", i, y, 0) for i, y in enumerate(ys)], "page string, pos long, y int, x int")
    assert [r[2] for r in rows(folds.anchored_lines(df, "page", "y", "x", "pos", 6))] == [1, 1, 2, 2, 3, 4, 4]
    by_gap = win.islands(df, ["page"], ["y"], F.col("y") - F.lag("y").over(win.over(["page"], ["y"])) > 6)
    assert [r[0] for r in rows(by_gap.orderBy("y").select("island"))] == [1, 1, 1, 1, 1, 2, 2]


def test_first_fit_takes_the_first_row_that_fits(spark, rows):
    df = spark.createDataFrame([("p", i, c) for i, c in enumerate([0, 30, 15, 48, 47])], "page string, pos long, c int")
    assert rows(folds.first_fit_rows(df, "page", "c", ["pos"], "pos", 18).select("pos", "line")) == [(0, 1), (1, 2), (2, 1), (3, 2), (4, 2)]


BOXES = [("p", 0, 0, 0, 9, 9), ("p", 1, 1, 1, 10, 10), ("p", 2, 40, 40, 49, 49), ("p", 3, 2, 2, 11, 11)]
KIND = "page string, pos long, x1 int, y1 int, x2 int, y2 int"


def test_greedy_boxes(spark, rows):
    df = spark.createDataFrame(BOXES, KIND)
    assert rows(folds.greedy_suppress(df, "page", 0.5), "pos") == [(0,), (2,)]
    assert rows(folds.greedy_merge(df, "page", 0.5)) == [("p", 0, 0, 0, 11, 11), ("p", 2, 40, 40, 49, 49)]
    chain = spark.createDataFrame([("p", 0, 0, 0, 9, 9), ("p", 1, 20, 0, 29, 9), ("p", 2, 10, 0, 19, 9)], KIND)
    assert rows(folds.block_merge(chain, "page", 1, 120)) == [("p", 0, 0, 0, 29, 9)]
    assert folds.greedy_suppress(df.where("false"), "page").count() == 0


def test_greedy_match_is_exclusive(spark, rows):
    left = spark.createDataFrame([("p", 0, 0, 0, 9, 9), ("p", 1, 0, 0, 9, 9), ("q", 2, 0, 0, 9, 9)], KIND)
    right = spark.createDataFrame([("p", 7, 0, 0, 9, 9), ("p", 8, 5, 5, 14, 14)], KIND)
    assert rows(folds.greedy_match(left, right, "page")) == [("p", 0, 7), ("p", 1, 8), ("q", 2, None)]


def test_traversal_of_a_grid(spark, rows):
    links = [("m", 1, 0, 3, 0, 2), ("m", 2, 0, 4, 1, 0), ("m", 3, 1, 0, 0, 4), ("m", 4, 2, 0, 3, 0)]
    df = spark.createDataFrame(links, "menu string, idx long, up long, down long, left long, right long")
    starts = spark.createDataFrame([("m", 1)], "menu string, start long")
    assert folds.traverse(df, starts, "menu", "row").first()["path"] == [1, 2, 3, 4]
    assert folds.traverse(df, starts, "menu", "col").first()["path"] == [1, 3, 2, 4]
    cut = df.withColumn("down", F.when(F.col("idx") == 1, F.lit(0).cast("long")).otherwise(F.col("down")))
    assert folds.traverse(cut, starts, "menu", "row").first()["path"] is None


def test_interval_join_equals_nested_loops(spark, rows):
    import random

    rng = random.Random(5)
    make = lambda n: [(rng.choice("ab"), i, a := rng.randint(0, 60), a + rng.randint(0, 25)) for i in range(n)]
    a, b = make(60), make(50)
    da = spark.createDataFrame(a, "k string, i int, lo int, hi int")
    db = spark.createDataFrame(b, "k string, j int, lo2 int, hi2 int")
    for inclusive in (True, False):
        got = rows(rel.interval_overlap(da, db, ["k"], "lo", "hi", "lo2", "hi2", 7, inclusive).select("i", "j"))
        want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and ((x[2] <= y[3] and y[2] <= x[3]) if inclusive else (x[2] < y[3] and y[2] < x[3])))
        assert got == want


def test_lookup_and_required(spark, rows):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "g int, k int")
    right = spark.createDataFrame([(1, 5), (1, 3)], "g int, k int")
    out = rel.lookup_with_fallback(left, right, "g", "k", "t")
    assert rows(out.select("g", "k", "t", "remapped")) == [(1, 5, 5, False), (1, 9, 3, True), (2, 1, None, False)]
    with pytest.raises(Exception, match="no chain"):
        rel.required(out, "t", "no chain").collect()


def test_positional_zip_stops_at_the_shorter(spark, rows):
    a = spark.createDataFrame([("x", 3), ("x", 1), ("y", 1)], "g string, a int")
    b = spark.createDataFrame([("x", 10)], "g string, b int")
    assert rows(rel.zip_positional(a, b, "g", ["a"], ["b"]).select("g", "a", "b")) == [("x", 1, 10)]


def test_rounding_is_half_to_even_and_floors_go_down(spark):
    df = spark.createDataFrame([(0, 0, 5, 5)], "x int, y int, w int, h int")
    x, y, w, h = geo.shrink(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 0.5)
    assert tuple(df.select(x, y, w, h).first()) == (1, 1, 2, 2)
    grown = geo.shrink(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 1.6)
    assert df.select(grown[0]).first()[0] == -2


def test_labels(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert one(text.sanitize, "  a:b/c\td  e.. ") == "abcd_e"
    assert one(text.sanitize, "..__") == "untitled" and len(one(text.sanitize, "x" * 300)) == 120
    assert one(text.sanitize, "פרק 2") == "פרק_2"
    assert one(text.cleanup, "S4E2  12/Nov O c t  C 366") == "S 4 E 2 12 Nov Oct C366"
    assert one(text.cleanup, "a b") == "a b" and one(text.quality, "") == 0.0
    assert one(text.quality, "ab#") == pytest.approx(2 / 3)
    assert one(text.normalise_label, " a   b ||") == "a b"
    assert one(lambda c: text.track_number(c, "AVSEQ"), "avseq07b1.mpg") == 71
    assert one(lambda c: text.track_number(c, "AVSEQ"), "OTHER07") is None
    assert one(text.menu_base, "VTSM_01_pgc02") == "VTSM_01" and one(text.menu_base, "") is None


def test_pages_and_variance(spark, rows):
    df = spark.createDataFrame([("v", i, f) for i, f in enumerate([[0.0, 0.0], [1.0, 1.0], [9.0, 9.0], [9.0, 9.0]])], "v string, i int, f array<double>")
    assert [r[0] for r in rows(win.page_segments(df, ["v"], ["i"], "f", 4.0).orderBy("i").select("page"))] == [1, 1, 2, 2]
    assert df.where("i = 2").select(win.variance(F.array(F.lit(1.0), F.lit(3.0)))).first()[0] == 1.0


def test_fill_missing(spark, rows):
    bands = lambda page, ys: [(page, 50, y, 600, y + 19) for y in ys]
    data = bands("a", [100, 130, 160, 220, 250, 280, 310]) + bands("b", [100, 130, 160]) + bands("c", [25, 85, 145, 205, 265, 325, 385, 415])
    df = spark.createDataFrame(data, "page string, x1 int, y1 int, x2 int, y2 int")
    made = [r[:5] for r in rows(win.fill_missing(df, "page", 7, 9, 0, 480)) if r[5]]
    # in the gap, above and below; too few bands; nothing is missing where the frame leaves no room
    assert made == [("a", 50, 69, 600, 89), ("a", 50, 189, 600, 209), ("a", 50, 339, 600, 359)]


def test_boxes_and_images(spark):
    one = lambda f, *v: tuple(spark.createDataFrame([v], "x int, y int, w int, h int").select(f(*map(F.col, "xywh")).alias("r")).first()[0])
    fit = lambda *v: one(lambda *c: geo.normalise_to_image(*c, F.lit(500), F.lit(400)), *v)
    assert fit(10, 10, 20, 20) == ("inside", 10, 10, 20, 20)
    assert fit(100, 380, 60, 150) == ("cut", 100, 380, 60, 20) and fit(600, 10, 40, 20) == ("cut", 600, 10, 1, 20)
    assert fit(0, 0, 590, 450) == ("cut", 0, 0, 500, 400) and fit(200, 0, 700, 1024) == ("scaled", 98, 0, 342, 400) and fit(500, 0, 600, 20) == ("kept", 500, 0, 600, 20)
    room = lambda *v: one(lambda *c: geo.text_room(*c, F.lit(720)), *v)
    assert room(400, 50, 200, 40) == ("right", 392, 50, 176, 40) and room(10, 250, 150, 30) == ("low", 10, 244, 132, 38)
    assert room(10, 5, 150, 30) == ("high", 10, 0, 132, 43) and room(0, 5, 700, 30) == ("kept", 0, 5, 700, 30) and room(10, 5, 100, 30) == ("kept", 10, 5, 100, 30)


def test_one_header_and_heights_within_the_frame(spark, rows):
    df = spark.createDataFrame([("p", 1, 0, 10, 80), ("p", 2, 0, 5, 70), ("p", 3, 0, 90, 99), ("p", 4, 60, 1, 99), ("p", 5, 0, 60, 20)], "page string, pos long, x1 int, y1 int, x2 int")
    got = rel.header_first(df, "page", "x1", "y1", "x2", 100, 100, "pos").orderBy("pos").select("pos", "bucket").collect()
    ordered = rel.header_first(df.withColumnRenamed("pos", "box"), "page", "x1", "y1", "x2", 100, 100, "box")
    assert [r.box for r in ordered.orderBy("pos").collect()] == [2, 1, 5, 3, 4] and len(got) == 5
    tall = spark.createDataFrame([("p", k, y, y + h - 1) for k, (y, h) in enumerate([(0, 10), (50, 14), (90, 13), (130, 9), (200, 60), (290, 11)])], "page string, k int, y1 int, y2 int")
    assert rows(rel.regularise_heights(tall, "page", "y1", "y2", 300).select("k", "new_y1", "new_y2")) == [(0, 0, 11), (1, 51, 62), (2, 90, 101), (3, 128, 139), (4, 200, 259), (5, 288, 299)]


def test_blocks_grow_right_and_down_only(spark, rows):
    cells = lambda *at: spark.createDataFrame([("p", k, x, y, x + 7, y + 7) for k, (x, y) in enumerate(at)], KIND)
    assert rows(folds.block_merge(cells((0, 0), (8, 0), (0, 8)), "page", 8)) == [("p", 0, 0, 0, 15, 15)]
    assert rows(folds.block_merge(cells((8, 0), (0, 0)), "page", 8)) == [("p", 0, 8, 0, 15, 7), ("p", 1, 0, 0, 15, 7)]  # a block to the left is not taken, and a first block stays free
    tower = rows(folds.block_merge(cells(*((0, 8 * k) for k in range(20))), "page", 8))
    assert tower[0] == ("p", 0, 0, 0, 7, 119) and len(tower) == 2
    assert folds.block_merge(cells((0, 0)).where("false"), "page").count() == 0


def test_best_candidate_leans_to_its_family(spark, rows):
    df = spark.createDataFrame([(1, "primary", "abcd", 0.905, 0), (1, "spu_a", "abc", 0.90, 1), (1, "hue", "zzzz", 1.0, 2), (2, "primary", "abcdef", 0.9, 0), (2, "spu_a", "abc", 0.9, 1)], "k int, name string, t string, q double, pos int")
    assert rows(rel.best_candidate(df, "k", "name", "t", "q", "pos").select("k", "name")) == [(1, "spu_a"), (2, "primary")]


def test_fill_missing_bands_reads_every_part(spark):
    from discweave.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["fill_missing_bands"](spark, sf)
    assert got.where("not made").count() == spark.read.parquet(f"{sf}/part.parquet").count() and not got.where("made").isEmpty()
