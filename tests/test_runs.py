"""Masks as runs against the same masks as pixels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmetrics.operators import runs, shape
from maskmetrics.operators.evaluate import mask_pairs
from maskmetrics.operators.kernel import binary_mask, mask_features
from maskmetrics.schemas import FEATURES

KEYS = ["image_id", "ann"]


def masks():
    """Noise of several densities, rings, diagonals, frames that touch the edge, single pixels."""
    r = np.random.default_rng(1)
    out = [r.random((24, 31)) < d for d in (0.03, 0.3, 0.5, 0.8, 0.97)]
    y, x = np.mgrid[:24, :31]
    out += [(np.hypot(y - 12, x - 15) < 11) & (np.hypot(y - 12, x - 15) > 5), abs(y - x) < 1, (y + x) % 2 == 0, np.ones((24, 31), bool), (y == 3) & (x == 30), (y < 2) | (y > 21), x == 7, (y == 5) & (x > 2)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k // 4, k % 4, int(x), int(y)) for k, m in enumerate(masks()) for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows + rows[:50], "image_id long, ann long, x long, y long").repartition(5)


def plain(mask):
    """Runs of an array."""
    out = []
    for x in range(mask.shape[1]):
        steps = np.diff(np.concatenate([[0], mask[:, x].astype(int), [0]]))
        out += [(x, int(a), int(b)) for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1), strict=True)]
    return out


def counts(mask):
    flat = mask.T.ravel()
    cuts = np.flatnonzero(np.diff(np.concatenate([[False], flat])))
    return np.diff(np.concatenate([[0], cuts, [len(flat)]])).tolist()


def test_runs_and_codes(spark, table):
    own = runs.runs_of_pixels(table, KEYS)
    want = sorted((k // 4, k % 4, *run) for k, m in enumerate(masks()) for run in plain(m))
    assert sorted(map(tuple, own.collect())) == want
    assert sorted(map(tuple, runs.pixels_of_runs(own, KEYS).collect())) == sorted(set(map(tuple, table.collect())))
    coded = runs.counts_of_runs(own, KEYS, 24, 31)
    got = {(r["image_id"], r["ann"]): [n for n in r["counts"]] for r in coded.collect()}
    assert got == {(k // 4, k % 4): counts(m) for k, m in enumerate(masks())}
    assert sorted(map(tuple, runs.runs_of_counts(coded, KEYS).collect())) == want
    odd = spark.createDataFrame([(0, 0, 4, [16]), (0, 1, 4, None), (0, 2, 4, []), (0, 3, 4, [0, 9, 0, 3, 4]), (1, 0, 4, [2, 1, 0, 1])], "image_id long, ann long, height int, counts array<long>")
    assert sorted(map(tuple, runs.runs_of_counts(odd, KEYS).collect())) == [(0, 3, 0, 0, 4), (0, 3, 1, 0, 4), (0, 3, 2, 0, 4), (1, 0, 0, 2, 4)]
    for bad in ((0, 0, 4, [3, -1]), (0, 0, 0, [3, 1])):
        with pytest.raises(Exception, match="run-length"):
            runs.runs_of_counts(spark.createDataFrame([bad], odd.schema), KEYS).collect()


def test_compact_text_of_codes(spark):
    r = random.Random(6)
    codes = [[], [0, 5], [40], [15, 16, 31, 32], [3, 1, 40, 2], [0, 10**8, 3], [r.randrange(5000) for _ in range(300)], None]
    rows = spark.createDataFrame(list(enumerate(codes)), "k long, counts array<long>")
    coded = rows.withColumn("text", runs.text_of_counts(rows["counts"]))
    got = sorted(coded.withColumn("back", runs.counts_of_text(coded["text"])).collect())
    assert [x["back"] for x in got] == codes
    # by hand: 40 is 8 and more to come, then 1; the fourth length is told by its difference to the second
    assert [x["text"] for x in got][:3] == ["", "05", "X1"] and got[4]["text"] == "31X11"
    with pytest.raises(Exception, match="not a run-length text"):
        spark.createDataFrame([("a b",)], "t string").select(runs.counts_of_text(F.col("t"))).collect()


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_features_equal_those_of_pixels(spark, table):
    own = runs.runs_of_pixels(table, KEYS)
    for f in (shape.extent, shape.perimeter, shape.box_counts):
        got, want = (sorted(map(tuple, g.collect())) for g in (getattr(runs, f.__name__)(own, KEYS), f(table.distinct(), KEYS)))
        assert len(got) == len(want) and all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
    r = np.random.default_rng(2)
    images = [r.integers(0, 256, (24, 31, 3)).astype(np.uint8) for _ in range(4)]
    pixels = [(i, x, y, *map(int, images[i][y, x])) for i in range(4) for y in range(24) for x in range(31)]
    sums = runs.column_sums(spark.createDataFrame(pixels, "image_id long, x long, y long, b int, g int, r int"))
    got = {(row["image_id"], row["ann"]): row for row in runs.features(own, sums, KEYS, 24, 31).collect()}
    assert len(got) == len(masks())
    for k, m in enumerate(masks()):
        want = mask_features(images[k // 4], m)
        assert all(close(got[k // 4, k % 4][c], want[c]) for c in FEATURES), k


@pytest.mark.parametrize("how", ["and", "or", "minus", "xor"])
def test_set_operations(spark, how):
    r = random.Random(3)
    make = lambda d: {(i, x, y) for i in range(3) for x in range(9) for y in range(12) if r.random() < d}
    a, b = make(0.5), make(0.4) - {(2, x, y) for x in range(9) for y in range(12)}
    own = [runs.runs_of_pixels(spark.createDataFrame(sorted(s), "m long, x long, y long"), ["m"]) for s in (a, b)]
    want = {"and": a & b, "or": a | b, "minus": a - b, "xor": a ^ b}[how]
    got = runs.combine(*own, ["m"], how)
    assert {tuple(x) for x in runs.pixels_of_runs(got, ["m"]).collect()} == want
    assert got.count() == runs.runs_of_pixels(spark.createDataFrame(sorted(want), "m long, x long, y long"), ["m"]).count()  # none touch
    with pytest.raises(KeyError):
        runs.combine(*own, ["m"], "nor")


def test_overlaps_equal_those_of_pixels(spark, monkeypatch):
    r = random.Random(4)
    sides = []
    for _ in range(2):
        rows = set()
        for k in range(20):
            x0, y0, w, h = r.randrange(30), r.randrange(30), r.randint(1, 12), r.randint(1, 30)
            rows |= {(k % 2, k, x, y) for x in range(x0, x0 + w) for y in range(y0, y0 + h) if r.random() < 0.9}
        sides.append(spark.createDataFrame(sorted(rows), "image_id long, id long, x long, y long"))
    want = sorted(map(tuple, mask_pairs(*sides, 0.05).collect()))
    own = [runs.runs_of_pixels(s, ["image_id", "id"]) for s in sides]
    for band in (1 << 10, 7):
        monkeypatch.setattr(runs, "BAND", band)
        got = sorted(map(tuple, runs.run_pairs(*own, 0.05).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(close(g[3], w[3]) for g, w in zip(got, want, strict=True)) and want


def test_masks_of_a_hundred_million_pixels(spark):
    """A square with a square hole, from its code: nothing grows with the pixels."""
    n, edge = 10_000, 10
    code = [0, edge * n, *([edge, n - 2 * edge] * (n - 2 * edge))]
    code = [0, edge * n + edge] + [n - 2 * edge, 2 * edge] * (n - 2 * edge - 1) + [n - 2 * edge, edge + edge * n]
    own = runs.runs_of_counts(spark.createDataFrame([(0, 0, n, code)], "image_id long, ann long, height int, counts array<long>"), KEYS).cache()
    hole = n - 2 * edge
    assert own.count() == 2 * edge + 2 * hole
    assert tuple(runs.extent(own, KEYS).first())[2:] == (n * n - hole * hole, 0, 0, n, n)
    # the outer border runs through the corners' centres; around the hole its four corners are cut
    assert runs.perimeter(own, KEYS).first()["perimeter"] == pytest.approx(4 * (n - 1) + 4 * (hole - 1) + 4 * math.sqrt(2))
    boxes = {r["scale"]: r["boxes"] for r in runs.box_counts(own, KEYS).collect()}
    assert boxes[1] == n * n - hole * hole and boxes[8192] == 4 and len(boxes) == 14
    assert runs.run_pairs(*[own.select("image_id", own["ann"].alias("id"), "x", "y1", "y2")] * 2, 0.9).first()["iou"] == 1.0
    whole = runs.combine(own, own, KEYS, "xor")
    assert whole.count() == 0
    own.unpersist()


@pytest.mark.parametrize("old, new", [((24, 31), (48, 62)), ((24, 31), (24, 31)), ((24, 31), (7, 50)), ((24, 31), (101, 5)), ((1, 1), (9, 4)), ((24, 31), (1, 1)), ((13, 17), (12, 18))])
def test_resizing_is_that_of_arrays(spark, old, new):
    r = np.random.default_rng(5)
    arrays = [r.random(old) < d for d in (0.2, 0.5, 0.9)]
    rows = [(k, *map(int, run)) for k, m in enumerate(arrays) for run in plain(m)]
    own = spark.createDataFrame([(k, *run, *old, *new) for k, *run in rows], "m long, x long, y1 long, y2 long, h int, w int, nh int, nw int")
    want = sorted((k, *run) for k, m in enumerate(arrays) for run in plain(binary_mask(m.astype(float), *new)))
    assert sorted(map(tuple, runs.resized(own, ["m"], ("h", "w"), ("nh", "nw")).collect())) == want
    assert sorted(map(tuple, runs.resized(own, ["m"], old, new).collect())) == want
