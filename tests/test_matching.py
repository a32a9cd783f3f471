"""Matching and suppression against the serial rules."""

import random
from itertools import product

import pytest

from maskmetrics.operators.evaluate import box_pairs, kept_boxes, match_boxes_once, match_masks_once, one_to_one, suppressed

BOX = "image_id long, id long, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = sum((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b))
    return w * h / (both - w * h) if w > 0 and h > 0 else 0.0


def greedy(pairs):
    """``(image, r, p, iou)`` taken by descending overlap, each instance once."""
    used, out = set(), []
    for image, r, p, score in sorted(pairs, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if ("r", image, r) not in used and ("p", image, p) not in used:
            used |= {("r", image, r), ("p", image, p)}
            out.append((image, r, p, score))
    return sorted(out)


def test_one_to_one_takes_pairs_in_order(spark):
    assert sorted(map(tuple, one_to_one(spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 1, 0.8), (1, 2, 2, 0.6)], "k long, r_id long, p_id long, iou double"), "k").collect())) == [(1, 1, 1, 0.9), (1, 2, 2, 0.6)]
    r = random.Random(1)
    pairs = {(r.randrange(8), r.randrange(12), r.randrange(12)): r.choice([0.5, 0.6, 0.6, 0.7, r.random()]) for _ in range(500)}
    pairs = [(*k, v) for k, v in pairs.items()]
    chain = [(99, k // 2 + k % 2, k // 2, 1 - k / 100) for k in range(20)]  # each pair waits for the one before
    got = one_to_one(spark.createDataFrame(pairs + chain, "k long, r_id long, p_id long, iou double"), "k")
    assert got.columns == ["k", "ref_id", "pred_id", "iou"] and sorted(map(tuple, got.collect())) == greedy(pairs + chain)
    assert one_to_one(spark.createDataFrame([], "k long, r_id long, p_id long, iou double"), "k").count() == 0


def random_boxes(r, n):
    out = []
    for k in range(n):
        size = 4.0 ** r.uniform(-3, 7)
        w, h = size * r.uniform(0.3, 1), size * r.uniform(0.05, 1)
        x, y = (r.choice([r.uniform(-300, 300), float(r.randrange(-64, 64))]) for _ in "xy")
        out.append((r.randrange(3), k, x, y, x + w, y + h))
    moved = [(i, n + k, x1 + r.uniform(-0.3, 0.3) * (x2 - x1), y1, x2, y2 + r.uniform(-0.2, 0.4) * (y2 - y1)) for i, k, x1, y1, x2, y2 in out]
    return out, moved + [(i, 2 * n + k, *b) for i, k, *b in out[: n // 3]]


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 0.93, 1.0])
def test_box_pairs_are_all_pairs(spark, threshold):
    left, right = random_boxes(random.Random(2), 150)
    want = sorted((a[0], a[1], b[1]) for a, b in product(left, right) if a[0] == b[0] and iou(a[2:], b[2:]) >= threshold)
    inf, nan = float("inf"), float("nan")
    odd = [(0, 10**6, -inf, 0.0, inf, 9.0), (0, 10**6 + 1, 0.0, 0.0, nan, 9.0), (0, 10**6 + 2, None, 0.0, 1.0, 1.0), (0, 10**6 + 3, 5.0, 5.0, 5.0, 9.0), (0, 10**6 + 4, 9.0, 9.0, 1.0, 1.0), (None, 10**6 + 5, 0.0, 0.0, 1.0, 1.0)]
    got = box_pairs(spark.createDataFrame(left + odd, BOX), spark.createDataFrame(right + odd, BOX), threshold)
    assert len(want) >= 50 and sorted((r["image_id"], r["r_id"], r["p_id"]) for r in got.collect()) == want
    with pytest.raises(ValueError):
        box_pairs(spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX), 0)


def test_large_boxes_take_few_rows(spark):
    """A box of 20,000 pixels beside small ones, at a low threshold: rows that are filed do not follow its size."""
    far = 3e8
    left = spark.createDataFrame([(0, 1, 0.0, 0.0, 2e4, 2e4), (0, 2, far, far, far + 1e-3, far + 1e-3), (0, 3, 0.0, 0.0, 1e100, 1e100)], BOX)
    right = spark.createDataFrame([(0, 4, 0.0, 0.0, 2e4, 5e3), (0, 5, 1.0, 1.0, 4.0, 4.0), (0, 6, far, far, far + 1e-3, far + 1e-3), (0, 7, 0.0, 0.0, 1e100, 1e100)], BOX)
    assert sorted((r["r_id"], r["p_id"]) for r in box_pairs(left, right, 0.1).collect()) == [(1, 4), (2, 6), (3, 7)]
    plan = box_pairs(left, right, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3 and "CartesianProduct" not in plan


def test_boxes_and_masks_once(spark):
    left, right = random_boxes(random.Random(3), 120)
    pairs = [(a[0], a[1], b[1], iou(a[2:], b[2:])) for a, b in product(left, right) if a[0] == b[0] and iou(a[2:], b[2:]) >= 0.2]
    got = match_boxes_once(spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX), 0.2).collect()
    assert sorted((r["image_id"], r["ref_id"], r["pred_id"]) for r in got) == [p[:3] for p in greedy(pairs)]
    ref, pred = [[(0, k, x, 0) for k, lo, hi in own for x in range(lo, hi)] for own in ([(1, 0, 10), (2, 2, 12)], [(1, 0, 11), (2, 6, 20)])]
    got = match_masks_once(*(spark.createDataFrame(p, "image_id long, id long, x int, y int") for p in (ref, pred)), 0.1).collect()
    assert sorted((r["ref_id"], r["pred_id"]) for r in got) == [(1, 1), (2, 2)]


def serial(boxes, threshold):
    """The serial rule; boxes are ``(image, class, id, confidence, x1, y1, x2, y2)``."""
    kept, groups = [], {}
    for b in sorted(boxes, key=lambda b: (-b[3] if b[3] is not None else float("inf"), b[2])):
        own = groups.setdefault(b[:2], [])
        if all(iou(b[4:], k[4:]) <= threshold for k in own):
            own.append(b)
            kept.append(b[:3])
    return sorted(kept, key=repr)


@pytest.mark.parametrize("images, n, threshold", [(2, 600, 0.3), (1000, 100_000, 0.5)])
def test_suppression_is_the_serial_rule(spark, images, n, threshold):
    r = random.Random(4)
    boxes = []
    for k in range(n):
        x, y = r.uniform(0, 100), r.uniform(0, 100)
        boxes.append((r.randrange(images), r.choice(["a", "b", None]), k, r.choice([0.5, None, round(r.random(), 2)]), x, y, x + r.uniform(3, 25), y + r.uniform(3, 25)))
    table = spark.createDataFrame(boxes, "image_id long, class_name string, id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = kept_boxes(table, threshold)
    assert got.columns == table.columns and sorted((tuple(x)[:3] for x in got.collect()), key=repr) == serial(boxes, threshold)
    if n < 1000:
        out = {tuple(x) for x in suppressed(table, threshold).collect()}
        assert out == {b[:3] for b in boxes} - set(serial(boxes, threshold))


def test_suppression_goes_on_after_what_was_suppressed(spark):
    """Each box overlaps the next: every second one stays."""
    row = [(0, "a", k, 1 - k / 100, 3.0 * k, 0.0, 3.0 * k + 5, 5.0) for k in range(21)]
    table = spark.createDataFrame(row, "image_id long, class_name string, id long, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(x["id"] for x in kept_boxes(table, 0.2).collect()) == list(range(0, 21, 2))


@pytest.mark.parametrize("threshold", [0.05, 0.4, 0.5, 1.0])
def test_pairs_of_a_table_with_itself(spark, threshold):
    """Each pair once, those of two sizes and of equal boxes too, and none with itself."""
    r = random.Random(7)
    rows = []
    for k in range(240):
        size = 2.0 ** r.randint(-3, 6)
        x, y = r.randint(-8, 8) * size / 4, r.randint(-8, 8) * size / 4
        rows.append((k % 3, k, x, y, x + size * r.choice([1, 1.25, 2]), y + size * r.choice([1, 1.5])))
    table = spark.createDataFrame(rows, BOX)
    got = sorted(map(tuple, box_pairs(table, table, threshold, once=True).select("image_id", "r_id", "p_id").collect()))
    assert got == sorted((a[0], a[1], b[1]) for a, b in product(rows, rows) if a[0] == b[0] and a[1] < b[1] and iou(a[2:], b[2:]) >= threshold)
    assert got or threshold == 1.0
