import random

import numpy as np
import pytest
from helpers import values
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from maskmetrics.functions import expressions
from maskmetrics.operators import aggregates, evaluate, selection

NAN = float("nan")


def test_statistic_rows_skip_what_is_missing(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", NAN), ("a", 4.0), ("b", NAN), ("b", None), ("c", float("inf"))], "image_id string, v double")
    images = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "image_id string")
    got = values(aggregates.statistic_rows(rows, images, ["v"]), "image_id", "row_type", "floc_count", "v")
    assert got == sorted(
        [("a", "mean", 3, 2.5), ("a", "median", 3, 2.5), ("b", "mean", 2, None), ("b", "median", 2, None), ("c", "mean", 1, None), ("c", "median", 1, None), ("d", "mean", 0, None), ("d", "median", 0, None)], key=repr
    )


def test_counts_of_configured_classes_only(spark):
    boxes = spark.createDataFrame([("f/a", 0, "rotifers", [1.0], 0.5), ("f/a", 1, "Rotifers", [2.0], 0.5), ("f/a", 2, "other", [3.0], 0.25)], "origin string, pos int, class_name string, bbox_xyxy array<double>, confidence double")
    images = spark.createDataFrame([("f/a",), ("f/b",)], "origin string")
    got = aggregates.class_counts(boxes, images, ["rotifers", "nematoda"])
    assert values(got, "origin", "rotifers", "nematoda") == [("f/a", 1, 0), ("f/b", 0, 0)]
    assert aggregates.class_counts(boxes, images, []).columns == ["origin"]
    docs = {r["origin"]: r["objects"] for r in aggregates.documents(boxes, images).collect()}
    assert [o["class"] for o in docs["f/a"]] == ["rotifers", "Rotifers", "other"] and docs["f/b"] == []
    assert aggregates.manifest(images, boxes.limit(0), boxes).first().asDict() == {"images_processed": 2, "flocs_detected": 0, "microorganisms_detected": 3}


def test_limit_before_and_after_a_filter(spark):
    rows = spark.createDataFrame([("a", 0, "x", 0.9), ("a", 1, "Floc", 0.25), ("a", 2, "floc", 0.8)], "origin string, pos int, class_name string, confidence double")
    after = selection.first_results(selection.of_class(selection.confident(rows, 0.25), "FLOC"), ["origin"], 1)
    assert values(after, "pos") == [(1,)]
    before = selection.of_class(selection.first_results(rows, ["origin"], 1), "floc")
    assert before.count() == 0
    assert values(selection.numbered(rows, ["origin"]), "pos", "annotation_id") == [(0, 1), (1, 2), (2, 3)]


def test_categories(spark):
    table = lambda rows: spark.createDataFrame(rows, "id long, name string")
    ranked = selection.rank_categories(table([(7, " rotifers\n"), (2, "nematoda")]))
    assert values(ranked, "label", "name") == [(1, "nematoda"), (2, "rotifers")]
    assert selection.rank_categories(table([(2, "b"), (2, "a")])).count() == 2
    for bad in ([(0, "a")], [(1, " ")], [(1, "a"), (2, "a")], [], [(None, "a")], [(1, None)]):
        with pytest.raises(ValueError):
            selection.rank_categories(table(bad))
    results = spark.createDataFrame([(2,), (1,)], "label int")
    assert values(selection.name_labels(results, ranked), "class_name") == [("nematoda",), ("rotifers",)]
    with pytest.raises(PySparkException):
        selection.name_labels(spark.createDataFrame([(3,)], "label int"), ranked).collect()


def test_pairs_stop_at_the_shortest(spark):
    rows = spark.createDataFrame([("a", [1, 2, 3], [0.5, 0.6]), ("b", [], [0.1]), ("c", None, [0.1])], "origin string, label array<int>, score array<double>")
    assert values(selection.pair_results(rows, ["origin"], ["label", "score"]), "origin", "pos", "label", "score") == [("a", 0, 1, 0.5), ("a", 1, 2, 0.6)]


def test_matching_and_scores(spark):
    box = "image_id int, id int, x1 double, y1 double, x2 double, y2 double"
    reference = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 100.0, 100.0, 300.0, 300.0), (2, 3, 0.0, 0.0, 0.0, 0.0)], box)
    predicted = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 9.0), (1, 2, 0.0, 0.0, 10.0, 10.0), (1, 3, 100.0, 100.0, 300.0, 250.0), (2, 4, 0.0, 0.0, 0.0, 0.0)], box)
    matches = evaluate.match_boxes(reference, predicted)
    assert values(matches, "ref_id", "pred_id", "iou") == [(1, 2, 1.0), (2, 3, 0.75)]
    got = evaluate.scores(reference, predicted, matches).first()
    assert (got["missed"], got["false_predictions"], got["precision"]) == (1, 2, 0.5)
    none = evaluate.scores(reference.limit(0), predicted.limit(0), matches.limit(0)).first()
    assert none["precision"] is None and none["f1"] is None


def test_histogram_has_empty_bins(spark):
    rows = spark.createDataFrame([(0.0,), (5.0,), (4.9999999999,), (1000.0,), (None,)], "relative_error_pct double")
    got = values(evaluate.error_histogram(rows), "bin", "n")
    assert got == [(0, 1), (1, 2), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1)]


def test_expressions(spark):
    row = spark.createDataFrame([("file:/x/sp%20ace+%C3%A9.tar.bmp", 10, 20, 30, NAN)], "o string, b int, g int, r int, v double")
    got = row.select(expressions.file_name(F.col("o")).alias("n"), expressions.stem(expressions.file_name(F.col("o"))).alias("s"), expressions.gray(F.col("b"), F.col("g"), F.col("r")).alias("y"), expressions.finite(F.col("v")).alias("f")).first()
    assert tuple(got) == ("sp ace+é.tar.bmp", "sp ace+é.tar", 22, None)


def iou_of(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    common = max(w, 0) * max(h, 0)
    return common / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - common)


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.9])
def test_box_matches_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(3)
    sides = []
    for _ in range(2):
        corners = [(k % 3, k, rng.randrange(-40, 60), rng.randrange(-40, 60)) for k in range(150)]
        sides.append([(i, k, float(x), float(y), float(x + rng.randrange(1, 40)), float(y + rng.randrange(1, 40))) for i, k, x, y in corners])
    sides[1][:40] = sides[0][:40]  # equal boxes
    sides[1][40:60] = [(*a[:4], a[4] + 1, a[5]) for a in sides[0][40:60]]
    best = [{}, {}]
    for a in sides[0]:
        for b in sides[1]:
            if a[0] == b[0] and (iou := iou_of(a, b)) >= threshold:
                best[0][a[1]] = min(best[0].get(a[1], (0, 0)), (-iou, b[1]))
                best[1][b[1]] = min(best[1].get(b[1], (0, 0)), (-iou, a[1]))
    want = sorted((a, b) for a, (_, b) in best[0].items() if best[1][b][1] == a)
    kind = "image_id int, id int, x1 double, y1 double, x2 double, y2 double"
    odd = [(0, 900, None, 0.0, 1.0, 1.0), (0, 901, float("nan"), 0.0, 1.0, 1.0), (0, 902, 5.0, 5.0, 5.0, 5.0)]
    ref, pred = (spark.createDataFrame(rows + odd, kind) for rows in sides)
    got = evaluate.match_boxes(ref, pred, threshold).collect()
    assert sorted((r["ref_id"], r["pred_id"]) for r in got) == want and len(want) > 20
    with pytest.raises(ValueError):
        evaluate.match_boxes(ref, pred, 0.0)


@pytest.mark.parametrize("cells", [2, 8, 64])
def test_statistics_are_those_of_the_sorted_values(spark, cells):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=2001).tolist(), "b": [7.0] * 500, None: rng.integers(0, 4, 99).astype(float).tolist(), "one": [2.5], "two": [1.0, 4.0]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "kind string, value double").repartition(3)
    got = {r["kind"]: r for r in evaluate.statistics(df, "value", ["kind"], cells).collect()}
    assert set(got) == {*groups, "empty"}
    for k, xs in groups.items():
        assert got[k]["n"] == len(xs) and got[k]["min"] == min(xs) and got[k]["max"] == max(xs)
        for name, p in evaluate.PERCENTILES.items():
            assert got[k][name] == pytest.approx(np.percentile(xs, 100 * p), abs=1e-12), (k, name)
    assert got["empty"]["n"] == 0 and got["empty"]["median"] is None and got["empty"]["iqr"] is None
    whole = evaluate.statistics(df, "value", (), cells).first()
    assert whole["median"] == pytest.approx(np.median([x for xs in groups.values() for x in xs]))
