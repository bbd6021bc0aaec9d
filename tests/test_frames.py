"""Frame detectors against step-by-step counts on frames of a plausible size."""

import numpy as np
import pytest

from discweave.operators import frames
from discweave.plans import catalogue

WIDTH, HEIGHT = 360, 300


def box(frame, x1, y1, x2, y2, level):
    frame[y1 : y2 + 1, x1 : x2 + 1] = level


def table(spark, grids):
    data = [(m, i, None if g is None else [int(v) for v in g.reshape(-1)]) for m, i, g in grids]
    return spark.createDataFrame(data, "menu string, pos int, cells array<int>")


def test_boxes_of_a_moving_menu(spark, rows):
    still = np.full((HEIGHT, WIDTH), 90)
    first, second, third = still.copy(), still.copy(), still.copy()
    box(second, 40, 30, 159, 79, 220)  # a highlight, a second one, one of a few pixels, one just dim
    box(third, 200, 150, 319, 199, 220)
    box(third, 10, 280, 12, 282, 220)
    box(third, 40, 220, 159, 260, 105)
    given = table(spark, [("a", 0, first), ("a", 1, second), ("a", 2, third), ("b", 0, still), ("b", 1, still), ("c", 0, still), ("d", 0, None)])
    found = frames.differences(given, "menu", "pos", "cells")
    assert rows(found, "menu", "still") == [("a", False), ("b", True), ("c", True)]
    boxes = frames.difference_boxes(found, "menu", WIDTH, 6)
    assert rows(boxes, "menu", "pos", "x1", "y1", "x2", "y2") == [("a", 1, 40, 30, 159, 79), ("a", 2, 200, 150, 319, 199)]
    assert rows(frames.difference_boxes(found, "menu", WIDTH, 1), "menu", "pos", "x1", "y1", "x2", "y2") == [("a", 1, 40, 30, 159, 79)]
    assert frames.differences(given.limit(0), "menu", "pos", "cells").count() == 0


def test_colours_weigh_as_grey(spark, rows):
    pairs = spark.createDataFrame([("a", 0, [0, 0, 0, 10, 20, 30]), ("a", 1, [255, 0, 0, 10, 120, 30])], "menu string, pos int, cells array<int>")
    found = frames.differences(pairs, "menu", "pos", "cells", coloured=True)
    assert rows(found, "menu", "still", "widest") == [("a", False, [(255 * 19595 + 32768) >> 16, (100 * 38470 + 32768) >> 16])]


def brute_cores(grid):
    lo, hi = int(grid.min()), int(grid.max())
    spread = np.clip((grid * (255.0 / (hi - lo)) - lo * (255.0 / (hi - lo))).astype(int), 0, 255) if hi > lo else grid
    out = []
    for y in range(50, HEIGHT - 80 - 60, 10):
        for x in range(80, 320 - 60, 10):
            share = float((spread[y : y + 60, x : x + 60] < 60).mean())
            if share > 0.75:
                out.append((x, y, share))
    return out


def brute_thumbnails(cores, expected):
    kept = []
    for x, y, score in sorted(cores, key=lambda c: -c[2]):
        a = (max(0, x - 40), max(0, y - 30), min(WIDTH - 1, x + 100), min(HEIGHT - 1, y + 90))
        size = (a[2] - a[0]) * (a[3] - a[1])
        if all((min(a[2], b[2]) - max(a[0], b[0])) <= 0 or (min(a[3], b[3]) - max(a[1], b[1])) <= 0 or (min(a[2], b[2]) - max(a[0], b[0])) * (min(a[3], b[3]) - max(a[1], b[1])) <= 0.5 * size for b in kept):
            kept.append(a)
    return sorted(kept, key=lambda b: b[1])[:expected]


@pytest.mark.parametrize("seed", [1, 2])
def test_dark_cores_and_thumbnails(spark, rows, seed):
    random = np.random.default_rng(seed)
    grid = random.integers(100, 240, (HEIGHT, WIDTH))
    box(grid, 95, 55, 175, 130, 40)
    box(grid, 230, 100, 300, 175, 45)
    grid[np.ix_(range(60, 125), range(100, 170))] += random.integers(0, 50, (65, 70))
    given = table(spark, [("a", 0, grid), ("b", 0, np.full((HEIGHT, WIDTH), 200)), ("c", 0, None), ("d", 0, np.zeros((0, WIDTH), int))])
    spread = given.withColumn("cells", frames.contrast(given["cells"]))
    cores = frames.dark_cores(spread, "menu", "cells", WIDTH)
    want = brute_cores(grid)
    assert want and rows(cores, "menu", "x", "y", "score") == sorted([("a", x, y, pytest.approx(s)) for x, y, s in want])
    boxes = frames.dark_thumbnails(cores, "menu", WIDTH, 3)
    got = [tuple(r)[2:] for r in boxes.orderBy("pos").select("menu", "pos", "x1", "y1", "x2", "y2").collect()]
    assert got == brute_thumbnails(want, 3)


def test_queries_of_frames_at_their_table(spark, rows):
    sf = "/root/testdata/sf0.001"
    names = ["difference_boxes", "dark_thumbnails"]
    found = {n: rows(catalogue.QUERIES[n](spark, sf)) for n in names}
    assert all(len(found[n]) == len(set(found[n])) > 0 for n in names)
