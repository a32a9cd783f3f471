"""Predicted instances against reference instances: matching, error statistics, histograms, scores.

Nothing fixes how instances are matched, on which side of the threshold equality falls, or how errors are signed.  Here: a pair must be the best partner of both sides (or, by the ``_once`` functions, of
those that better pairs leave), equality counts, and an error is prediction minus reference, relative to the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import finite
from ..sources.storage import Written

# Edges of the relative-error bins in percent; the last bin is open.
ERROR_EDGES = (0, 5, 10, 20, 30, 50, 100)
# Percentiles of the statistics.
PERCENTILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def overlap(left: str, right: str):
    """Intersection over union of two boxes ``x1, y1, x2, y2`` with the given prefixes; 0 where they do not meet."""
    a, b = (lambda c: F.col(left + c)), (lambda c: F.col(right + c))
    w = F.greatest(F.least(a("x2"), b("x2")) - F.greatest(a("x1"), b("x1")), F.lit(0.0))
    h = F.greatest(F.least(a("y2"), b("y2")) - F.greatest(a("y1"), b("y1")), F.lit(0.0))
    area = lambda p: (p("x2") - p("x1")) * (p("y2") - p("y1"))
    return F.coalesce(w * h / F.nullif(area(a) + area(b) - w * h, F.lit(0.0)), F.lit(0.0))


def box_pairs(left: DataFrame, right: DataFrame, threshold: float, key: str = "image_id", once: bool = False) -> DataFrame:
    """``key, r_id, p_id, iou`` of all pairs of ``(key, id, x1, y1, x2, y2)`` rows that overlap by ``threshold`` at least.

    ``once`` is for a table against itself: two boxes are one pair, the smaller id as ``r_id``, and a box is none with itself.

    A range join over grids of several sizes.  Boxes that overlap by ``t`` have longer sides within a factor of ``1 / t``, and their
    centres are at most ``(1 - t) / 2t`` widths and heights of either one apart.  So a left box is filed once, in the grid of its own
    size under the tile of its centre; a right one in the grids of the sizes that a partner can have, under the one or two tiles an
    axis where its centre can lie: a bounded number of rows however large a box is, and every pair meets once.  ``threshold`` is over
    0 and at most 1; boxes with a null, NaN or infinite coordinate and those without an area overlap nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"the threshold must be over 0 and at most 1, not {threshold}")
    # sizes of partners lie in two grids at most, or three at their edges, and most boxes are small against their tiles: fewer copies of a right box
    base, reach = max(4.0, threshold**-2), (1 - threshold) / (2 * threshold)
    edge = F.pow(F.lit(base), F.col("grid") + 1)  # no side of the grid's boxes is longer
    tile_side = edge * max(1.0, 2 * reach)

    def boxes(df: DataFrame, p: str) -> DataFrame:
        sides = [F.col(c).cast("double").alias(p + c) for c in ("x1", "y1", "x2", "y2")]
        rows = df.select(F.col(key).alias(key), F.col("id").alias(p + "id"), *sides)
        w, h = (F.col(f"{p}{c}2") - F.col(f"{p}{c}1") for c in "xy")
        rows = rows.select("*", w.alias("w"), h.alias("h"), *[((F.col(f"{p}{c}1") + F.col(f"{p}{c}2")) / 2).alias(f"m{c}") for c in "xy"])
        return rows.where(" and ".join(f"{c} > 0 and {c} < double('infinity')" for c in "wh"))  # an unknown or endless side is not

    def grid(side: Column) -> Column:
        return F.floor(F.log(side) / F.log(F.lit(base))).cast("int")

    def tile(middle: Column) -> Column:  # beyond all that can be told apart, tiles are one
        return F.floor(F.greatest(F.least(middle / tile_side, F.lit(4e15)), F.lit(-4e15)))

    longer = F.greatest("w", "h")
    ref = boxes(left, "r_").withColumn("grid", grid(longer)).select("*", tile(F.col("mx")).alias("tx"), tile(F.col("my")).alias("ty")).drop("w", "h", "mx", "my")
    spread = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pred = boxes(right, "p_").repartition(spread)  # few bytes that take much work: Spark would put small tables into one task
    smallest = grid(longer) if once else grid(longer * threshold * (1 - 1e-9))  # the smaller box of a pair is filed with the larger one
    pred = pred.select("*", smallest.alias("from"), F.explode(F.sequence(smallest, grid(longer / threshold * (1 + 1e-9)))).alias("grid"))
    for c, width in (("x", "w"), ("y", "h")):
        middle = F.col(f"m{c}")
        far = F.least(F.col(width), edge) * (reach * (1 + 1e-9)) + F.abs(middle) * 1e-12  # for rounding
        pred = pred.select("*", F.explode(F.sequence(tile(middle - far), tile(middle + far))).alias(f"t{c}"))
    pred = pred.drop("w", "h", "mx", "my") if once else pred.drop("w", "h", "mx", "my", "from")
    pairs = ref.join(pred, [key, "grid", "tx", "ty"]).withColumn("iou", overlap("r_", "p_")).where(F.col("iou") >= threshold)
    if once:  # boxes of one grid meet twice
        pairs = pairs.where((F.col("grid") > F.col("from")) | (F.col("r_id") < F.col("p_id"))).withColumns({"r_id": F.least("r_id", "p_id"), "p_id": F.greatest("r_id", "p_id")})
    return pairs.select(key, "r_id", "p_id", "iou")


def match_boxes(reference: DataFrame, predicted: DataFrame, threshold: float = 0.5, key: str = "image_id") -> DataFrame:
    """``image, ref_id, pred_id, iou`` of the mutual best matches of ``(image, id, x1, y1, x2, y2)`` rows; ties go to the smaller id.

    Boxes as in :func:`box_pairs`.
    """
    return mutual_best(box_pairs(reference, predicted, threshold, key), key)


def match_boxes_once(reference: DataFrame, predicted: DataFrame, threshold: float = 0.5, key: str = "image_id") -> DataFrame:
    """As :func:`match_boxes`, but matched one to one until no pair is left; see :func:`one_to_one`."""
    return one_to_one(box_pairs(reference, predicted, threshold, key), key)


def mask_pairs(reference: DataFrame, predicted: DataFrame, threshold: float, key: str = "image_id") -> DataFrame:
    """``key, r_id, p_id, iou`` of all pairs of masks that overlap by ``threshold`` at least, from pixel rows ``(key, id, x, y)``.

    Pixels of one image meet by their place, so only masks that share one are compared; repeated pixels count once.
    """
    ref, pred = (df.select(key, F.col("id").alias(n), "x", "y").distinct() for df, n in ((reference, "r_id"), (predicted, "p_id")))
    common = ref.join(pred, [key, "x", "y"]).groupBy(key, "r_id", "p_id").agg(F.count("*").alias("common"))
    sizes = [df.groupBy(key, n).agg(F.count("*").alias(size)) for df, n, size in ((ref, "r_id", "r_size"), (pred, "p_id", "p_size"))]
    pairs = common.join(sizes[0], [key, "r_id"]).join(sizes[1], [key, "p_id"])
    iou = F.col("common") / (F.col("r_size") + F.col("p_size") - F.col("common"))
    return pairs.withColumn("iou", iou).where(F.col("iou") >= threshold).select(key, "r_id", "p_id", "iou")


def match_masks(reference: DataFrame, predicted: DataFrame, threshold: float = 0.5, key: str = "image_id") -> DataFrame:
    """``image, ref_id, pred_id, iou`` of the mutual best matches of masks, given as pixel rows ``(image, id, x, y)``; ties go to the smaller id."""
    return mutual_best(mask_pairs(reference, predicted, threshold, key), key)


def match_masks_once(reference: DataFrame, predicted: DataFrame, threshold: float = 0.5, key: str = "image_id") -> DataFrame:
    """As :func:`match_masks`, but matched one to one until no pair is left; see :func:`one_to_one`."""
    return one_to_one(mask_pairs(reference, predicted, threshold, key), key)


def mutual_best(scored: DataFrame, key: str) -> DataFrame:
    """Of scored pairs ``(image, r_id, p_id, iou)`` those that are the best of both sides; ties go to the smaller id.

    One aggregation finds the best pair of every instance of either side, combined before its shuffle; a pair that is found twice is mutual.
    """
    r, p = F.col("r_id"), F.col("p_id")
    sides = F.array(F.struct(F.lit(0).alias("side"), r.alias("r"), F.when(F.lit(False), p).alias("p")), F.struct(F.lit(1).alias("side"), F.when(F.lit(False), r).alias("r"), p.alias("p")))
    best = scored.select(key, F.struct((-F.col("iou")).alias("iou"), "r_id", "p_id").alias("pair"), F.explode(sides).alias("own")).groupBy(key, "own").agg(F.min("pair").alias("pair"))
    twice = best.groupBy(key, F.col("pair.r_id").alias("ref_id"), F.col("pair.p_id").alias("pred_id")).agg(F.count("*").alias("_n"), (-F.min("pair.iou")).alias("iou"))
    return twice.where("_n = 2").select(key, "ref_id", "pred_id", "iou")


def one_to_one(scored: DataFrame, key: str) -> DataFrame:
    """``key, ref_id, pred_id, iou``: what taking pairs by descending ``iou`` gives, each instance once; ties go to the smaller ids.

    A pair that is the best of both its sides is taken whatever comes after, so each round takes all such pairs at once and drops the
    pairs that share an instance with one, until none is left.  Every round writes what is left to the shared folder, and its joins
    are by instance; the best pair of all is always among those taken, so rounds end.
    """
    left = Written(scored.select(key, "r_id", "p_id", "iou"), "pairs")
    taken: list[Written] = []
    while not left.rows.isEmpty():
        taken.append(Written(mutual_best(left.rows, key), "matched"))
        rows = left.rows
        for own, side in (("r_id", "ref_id"), ("p_id", "pred_id")):
            used = taken[-1].rows.select(F.col(key), F.col(side).alias(own))
            rows = rows.join(used, [key, own], "left_anti")
        done, left = left, Written(rows.select(key, "r_id", "p_id", "iou"), "pairs")
        done.drop()
    found = mutual_best(left.rows, key)
    left_over = [t.rows for t in taken]
    for rows in left_over:
        found = found.unionByName(rows)
    return found


def suppressed(boxes: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("image_id", "class_name"), order: Sequence[str] = ("id",)) -> DataFrame:
    """``keys.., id`` of the boxes ``(keys.., id, confidence, x1, y1, x2, y2)`` that a better kept one of the same keys overlaps by more than ``threshold``.

    Boxes are better by descending confidence, nulls last, then by ``order``, which must leave no ties within the keys.  Serial rule:
    from the best on, a box is kept unless a kept one overlaps it.  As rounds: a box that nothing better overlaps is kept, what it
    overlaps goes, and with it all that those would have dropped; what is left is looked at again, until no overlap is left.
    ``id`` tells the boxes of the keys apart.  Null keys are a key of their own.  Boxes without an area or with a coordinate that is
    null or not finite overlap nothing and are kept.
    """
    names = list(keys)
    named = boxes.select(F.struct(*names).alias("_key"), F.struct(F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("low"), *order, F.col("id").alias("_id")).alias("id"), "x1", "y1", "x2", "y2")
    pairs = box_pairs(named, named, threshold, "_key", once=True).where(F.col("iou") > threshold)
    left, gone = Written(pairs.select("_key", F.col("r_id").alias("better"), F.col("p_id").alias("worse")), "overlaps"), []
    while not left.rows.isEmpty():
        rows = left.rows
        first = rows.join(rows.select("_key", F.col("worse").alias("better")).distinct(), ["_key", "better"], "left_anti")
        gone.append(Written(first.select("_key", "worse").distinct(), "suppressed"))
        out = gone[-1].rows
        for side in ("better", "worse"):
            rows = rows.join(out.select("_key", F.col("worse").alias(side)), ["_key", side], "left_anti")
        done, left = left, Written(rows.select("_key", "better", "worse"), "overlaps")
        done.drop()
    found = left.rows.select("_key", "worse")
    for own in gone:
        found = found.unionByName(own.rows)
    return found.select(*[F.col("_key")[k].alias(k) for k in names], F.col("worse._id").alias("id"))


def kept_boxes(boxes: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("image_id", "class_name"), order: Sequence[str] = ("id",)) -> DataFrame:
    """The rows of ``boxes`` that :func:`suppressed` does not name."""
    out = suppressed(boxes, threshold, keys, order)
    same = None
    for k in (*keys, "id"):  # null keys too
        own = boxes[k].eqNullSafe(out[k])
        same = own if same is None else same & own
    return boxes.join(out, same, "left_anti")


def scores(reference: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: instance counts, misses, false predictions, precision, recall and F1 (null where they are not defined)."""
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((reference, "reference"), (predicted, "predicted"), (matches, "matched"))]
    row = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    row = row.withColumn("missed", F.col("reference") - F.col("matched")).withColumn("false_predictions", F.col("predicted") - F.col("matched"))
    row = row.withColumn("precision", ratio("matched", "predicted")).withColumn("recall", ratio("matched", "reference"))
    both = F.col("precision") + F.col("recall")
    return row.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)))


def errors(pairs: DataFrame, predicted: str = "predicted", reference: str = "reference") -> DataFrame:
    """Add ``absolute_error``, ``relative_error_pct`` (null against 0) and ``signed_error``."""
    diff = F.col(predicted) - F.col(reference)
    return pairs.withColumn("absolute_error", F.abs(diff)).withColumn("relative_error_pct", 100 * F.abs(diff) / F.nullif(F.abs(F.col(reference)), F.lit(0.0))).withColumn("signed_error", diff)


#: Cells of one narrowing round, and rows of a cell that one task may put in order.
CELLS, CELL_ROWS = 4096, 1 << 20


def statistics(rows: DataFrame, value: str, keys: Sequence[str] = (), cells: int = CELLS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``n``, mean, population deviation, extremes, exact percentiles (linear between ranks) and their quartile range; nulls do not count.

    Percentiles are found by :func:`ranked_values`, so no task puts more than ``cell_rows`` values of a key in order, whatever its share of the rows.
    """
    v, own = F.col(value).cast("double"), [F.col(f"`{k}`") for k in keys]
    # Null keys are a key of their own; without keys all rows have the same.
    named = (F.struct(*own) if own else F.struct(F.lit(0).alias("all"))).alias("_key")
    known = rows.select(named, v.alias("_v"))
    usual = finite(F.col("_v"))
    base = known.groupBy("_key").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.min(usual).alias("_lo"), F.max(usual).alias("_hi"))
    base = Written(base, "base").rows
    places = [(F.col("n") - 1) * F.lit(p) for p in PERCENTILES.values()]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]))
    found = ranked_values(known.where("_v is not null"), base.where("n > 0").select("_key", ranks.alias("ranks"), "_lo", "_hi"), cells, cell_rows)
    found = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("_at"))  # two ranks a percentile

    def between(place):
        lo, hi = (F.col("_at")[f(place).cast("long")] for f in (F.floor, F.ceil))
        return F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi)

    out = base.join(found, "_key", "left")
    out = out.select(*[F.col("_key")[k].alias(k) for k in keys], "n", "mean", "std", "min", "max", *[between(p).alias(name) for name, p in zip(PERCENTILES, places, strict=True)])
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def ranked_values(rows: DataFrame, wanted: DataFrame, cells: int = CELLS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``_key, rank, _v``: the value of each rank, from 0, of ``wanted(_key, ranks, _lo, _hi)`` among the ``rows(_key, _v)`` of its key.

    ``_lo`` and ``_hi`` are the least and largest finite value.  By repeated narrowing: the rows of a part of a key are counted in cells of
    its range, which tells in which cell a rank lies.  A cell of one value answers at once, one of at most ``cell_rows`` rows is put in
    order, and a larger one is the next round's part, with its own range.  Cells are of equal width, but in the second round of equal
    exponent, after which a range is within a factor of two: a number's 52 further bits bound the rounds, whatever the values are.
    Only rows in wanted cells go on, and each round writes them.  Infinite values and NaN, the largest, have cells of their own.
    """
    on, v = ["_key", "_part"], F.col("_v")
    parts, asked = rows.withColumn("_part", F.lit("")), wanted.select("_key", F.lit("").alias("_part"), F.lit(0).cast("long").alias("_base"), "ranks", "_lo", "_hi")
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    even = F.least(F.floor((v / 2 - F.col("_lo") / 2) / width * cells), F.lit(cells - 1))
    even = F.when(width > 0, even).otherwise(0)
    exponent = F.when(v == 0, 0).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v))) + 1100)).cast("long")  # the least number has -1074
    answers, turn = [], 0
    while True:
        inner, edge = exponent if turn == 1 else even, 1 << 20
        cell = F.when(F.isnan(v), edge + 1).when(v == float("inf"), edge).when(v == float("-inf"), -edge).otherwise(inner)
        filed = parts.join(asked.select(*on, "_lo", "_hi"), on).select(*on, cell.alias("_cell"), "_v")
        order = Window.partitionBy(*on).orderBy("_cell")  # at most so many rows a part
        counted = filed.groupBy(*on, "_cell").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        counted = counted.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).join(asked.drop("_lo", "_hi"), on).withColumn("_before", F.col("_before") + F.col("_base"))
        counted = counted.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))).where(F.size("ranks") > 0)
        held = Written(counted.select(*on, "_cell", "_n", "_lo", "_hi", "_before", "ranks"), "cells").rows
        answers.append(held.where("_lo = _hi").select("_key", F.explode("ranks").alias("rank"), F.col("_lo").alias("_v")))
        small = held.where(f"_lo < _hi and _n <= {cell_rows}")
        inside = filed.join(small.select(*on, "_cell", "_before", "ranks"), [*on, "_cell"])
        at = F.col("_before") + F.row_number().over(Window.partitionBy(*on, "_cell").orderBy("_v")) - 1
        answers.append(inside.withColumn("rank", at.cast("long")).where(F.array_contains("ranks", F.col("rank"))).select("_key", "rank", "_v"))
        large = held.where(f"_lo < _hi and _n > {cell_rows}")
        if large.isEmpty():
            break
        below = F.concat("_part", F.lit("/"), F.col("_cell").cast("string")).alias("_part")
        parts = Written(filed.join(large.select(*on, "_cell"), [*on, "_cell"]).select("_key", below, "_v"), "parts").rows
        asked, turn = large.select("_key", below, F.col("_before").alias("_base"), "ranks", "_lo", "_hi"), turn + 1
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def error_histogram(rows: DataFrame, value: str = "relative_error_pct", edges: Sequence[float] = ERROR_EDGES) -> DataFrame:
    """``bin, low, high, n`` for every bin, also empty ones; a bin holds its lower edge, the last has no upper one.

    The value is rounded to 9 places first, so that one on an edge does not depend on the last bit.
    """
    spark = rows.sparkSession
    table = [(k, float(lo), float(hi) if hi is not None else None) for k, (lo, hi) in enumerate(zip(edges, [*edges[1:], None], strict=True))]
    bins = spark.createDataFrame(table, "bin int, low double, high double")
    at = F.round(F.col(value), 9)
    case = None
    for k, lo, _ in reversed(table):  # the highest edge that the value reaches
        case = F.when(at >= lo, k) if case is None else case.when(at >= lo, k)
    found = rows.where(F.col(value).isNotNull()).groupBy(case.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(found, "bin", "left").select(F.col("bin").cast("bigint").alias("bin"), "low", "high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
