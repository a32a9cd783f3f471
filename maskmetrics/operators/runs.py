"""Masks as runs: all features, set operations and overlaps without a row for a pixel.

A run ``(*keys, x, y1, y2)`` is a stretch of set pixels of one column, from row ``y1`` up to but without ``y2``; the runs of a mask
neither overlap nor touch within a column.  That is what a run-length code by columns holds, the usual exchange form of masks.
Everything is a relation over runs: neighbouring columns and boxes meet by key and column, and what happens along a column is
found by its starts and ends in order.  A mask of ten thousand by ten thousand pixels is a few times ten thousand rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import compactness, gray
from .shape import LEVELS

#: Rows of one band of a column, in which runs of two masks are compared.
BAND = 1 << 10


def _merged(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs with overlapping and touching ones of a column put together."""
    order = Window.partitionBy(*keys, "x").orderBy("y1", "y2")
    reach = F.max("y2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("y1") > F.col("reach"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = runs.select(*keys, "x", "y1", "y2").where("y2 > y1").withColumn("reach", reach).withColumn("island", island)
    return found.groupBy(*keys, "x", "island").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2")).select(*keys, "x", "y1", "y2")


def runs_of_pixels(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The runs of masks given as pixel rows ``(*keys, x, y)``; repeated pixels count once."""
    own = pixels.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y1"), (F.col("y").cast("long") + 1).alias("y2"))
    return _merged(own, keys)


def pixels_of_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for every pixel, for masks that are small enough."""
    return runs.select(*keys, "x", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"))


def runs_of_counts(coded: DataFrame, keys: Sequence[str], counts: str = "counts", height: str = "height") -> DataFrame:
    """The runs of run-length codes ``(*keys, height, counts array<long>)``: lengths of unset and set stretches in turn, column by column.

    A stretch may go on from one column to the next.  Null codes and codes without a set pixel give no rows; a negative length, a null
    length and a height under 1 are errors when the row is read.
    """
    bad = F.exists(counts, lambda n: n.isNull() | (n < 0)) | (F.col(height) < 1)
    checked = coded.withColumn("_n", F.when(bad, F.raise_error(F.lit("a run-length code needs lengths from 0 on and a height"))).otherwise(F.col(counts).cast("array<bigint>")))
    steps = F.posexplode("_n").alias("_place", "_length")
    numbered = checked.select(*keys, F.col(height).cast("long").alias("_h"), steps)
    order = Window.partitionBy(*keys).orderBy("_place")
    ended = numbered.withColumn("_end", F.sum("_length").over(order)).where("_place % 2 = 1 and _length > 0").withColumn("_start", F.col("_end") - F.col("_length"))
    column = F.explode(F.sequence(F.expr("_start div _h"), F.expr("(_end - 1) div _h"))).alias("x")
    split = ended.select(*keys, "_h", "_start", "_end", column)
    return _merged(split.select(*keys, "x", F.greatest(F.col("_start") - F.col("x") * F.col("_h"), F.lit(0)).alias("y1"), F.least(F.col("_end") - F.col("x") * F.col("_h"), F.col("_h")).alias("y2")), keys)


def counts_of_runs(runs: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """``*keys, height, width, counts``: the run-length code of each mask in a frame that holds it; a code is one row, as its form asks."""
    at = runs.select(*keys, F.struct((F.col("x") * height + F.col("y1")).alias("a"), (F.col("x") * height + F.col("y2")).alias("b")).alias("run"))
    gathered = at.groupBy(*keys).agg(F.array_sort(F.collect_list("run")).alias("runs"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("counts"))

    def add(state: Column, run: Column) -> Column:
        touching = (run["a"] == state["end"]) & (F.size(state["counts"]) > 0)  # goes on from the column before
        longer = F.concat(F.slice(state["counts"], F.lit(1), F.size(state["counts"]) - 1), F.array(F.element_at(state["counts"], -1) + run["b"] - run["a"]))
        return F.struct(run["b"].alias("end"), F.when(touching, longer).otherwise(F.concat(state["counts"], F.array(run["a"] - state["end"], run["b"] - run["a"]))).alias("counts"))

    def close(state: Column) -> Column:
        rest = F.lit(height * width).cast("long") - state["end"]
        return F.when(rest > 0, F.concat(state["counts"], F.array(rest))).otherwise(state["counts"])

    return gathered.select(*keys, F.lit(height).alias("height"), F.lit(width).alias("width"), F.aggregate("runs", start, add, close).alias("counts"))


def _from_text(text: str | None) -> list[int] | None:
    if text is None:
        return None
    counts: list[int] = []
    value = shift = 0
    for char in text.encode("latin-1"):
        bits = char - 48
        if not 0 <= bits < 64:
            raise ValueError(f"not a run-length text: {text[:40]!r}")
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            value -= (bits >> 4 & 1) << shift
            counts.append(value + (counts[-2] if len(counts) > 2 else 0))
            value = shift = 0
    return counts


def _to_text(counts: list[int] | None) -> str | None:
    if counts is None:
        return None
    out = []
    for k, n in enumerate(counts):
        rest = n - counts[k - 2] if k > 2 else n
        while not -16 <= rest < 16:
            out.append((rest & 31) | 32)
            rest >>= 5
        out.append(rest & 31)
    return bytes(x + 48 for x in out).decode("latin-1")


def counts_of_text(text: Column) -> Column:
    """The lengths in the compact text form of a run-length code: 5 bits and a mark of more to come a character, signed, from the fourth on
    as the difference to the one before the last.  Null stays null; another text is an error when the row is read."""
    return F.udf(_from_text, "array<bigint>", useArrow=True)(text)


def text_of_counts(counts: Column) -> Column:
    """The compact text form of a run-length code."""
    return F.udf(_to_text, "string", useArrow=True)(counts)


def combine(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """The runs of ``left`` ``and``, ``or``, ``minus`` or ``xor`` ``right``, mask by mask of the same keys.

    Along a column the starts and ends of both say at each row which of them are set until the next.
    """
    wanted = {"and": "l > 0 and r > 0", "or": "l > 0 or r > 0", "minus": "l > 0 and r <= 0", "xor": "(l > 0) <> (r > 0)"}[how]

    def ends(runs: DataFrame, own: str, other: str) -> DataFrame:
        step = F.explode(F.array(F.struct(F.col("y1").alias("y"), F.lit(1).alias("d")), F.struct(F.col("y2").alias("y"), F.lit(-1).alias("d")))).alias("e")
        return runs.select(*keys, "x", step).select(*keys, "x", "e.y", F.col("e.d").alias(own), F.lit(0).alias(other))

    steps = ends(left, "dl", "dr").unionByName(ends(right, "dr", "dl")).groupBy(*keys, "x", "y").agg(F.sum("dl").alias("dl"), F.sum("dr").alias("dr"))
    order = Window.partitionBy(*keys, "x").orderBy("y")
    state = [F.sum(d).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for d, n in (("dl", "l"), ("dr", "r"))]
    spans = steps.select(*keys, "x", F.col("y").alias("y1"), F.lead("y").over(order).alias("y2"), *state).where(f"y2 is not null and ({wanted})")
    return _merged(spans, keys)


def resized(runs: DataFrame, keys: Sequence[str], size: tuple[str | int, str | int], to: tuple[str | int, str | int]) -> DataFrame:
    """Runs of masks of ``size`` (rows, columns) brought to another size by nearest neighbour, as :func:`kernel.binary_mask` does.

    Sizes are numbers or names of columns.  Row ``y`` of the new mask shows row ``floor(y * old / new)``, so a stretch of old rows or columns
    is shown by one stretch of new ones, found from its ends; one that no new row or column shows goes.
    """
    (old_h, old_w), (new_h, new_w) = (tuple(F.lit(n).cast("long") if isinstance(n, int) else F.col(n).cast("long") for n in pair) for pair in (size, to))

    def first(at: Column, old: Column, new: Column) -> Column:
        """The first new place that shows old ``at`` or a later one."""
        return F.call_function("div", at * new + old - 1, old)

    ends = [first(F.col(y), old_h, new_h).alias(y) for y in ("y1", "y2")]
    shown = runs.select(*keys, *ends, first(F.col("x"), old_w, new_w).alias("_from"), first(F.col("x") + 1, old_w, new_w).alias("_to")).where("y2 > y1 and _to > _from")
    return _merged(shown.select(*keys, F.explode(F.sequence("_from", F.col("_to") - 1)).alias("x"), "y1", "y2"), keys)


def extent(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``area, x0, y0, w, h`` of each mask."""
    sides = [F.min("x").alias("x0"), F.min("y1").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y2") - F.min("y1")).alias("h")]
    return runs.groupBy(*keys).agg(F.sum(F.col("y2") - F.col("y1")).alias("area"), *sides)


def perimeter(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``perimeter`` by the corner rule of :func:`shape.perimeter`.

    Between two columns a corner is told by the runs that start or end there and by the one that goes on beside it; corners where
    nothing starts or ends count where just one of the columns is set, and are counted by stretches.
    """
    sides = F.explode(F.array(*[F.struct((F.col("x") + s).alias("c"), F.lit(s).alias("s")) for s in (0, 1)])).alias("at")  # the mask is right of the first, left of the second
    steps = F.explode(F.array(F.struct(F.col("y1").alias("y"), F.lit(1).alias("d")), F.struct(F.col("y2").alias("y"), F.lit(-1).alias("d")))).alias("e")
    events = runs.select(*keys, "y1", "y2", sides).select(*keys, "at", steps)
    changes = events.groupBy(*keys, F.col("at.c").alias("c"), F.col("e.y").alias("y")).agg(*[F.sum(F.when(F.col("at.s") == s, F.col("e.d")).otherwise(0)).alias(n) for s, n in ((0, "dr"), (1, "dl"))])
    order = Window.partitionBy(*keys, "c").orderBy("y")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = changes.select(*keys, "dl", "dr", "y", F.lead("y").over(order).alias("next"), *[F.sum(d).over(so_far).alias(n) for d, n in (("dl", "l"), ("dr", "r"))])
    between = F.when(F.col("l") != F.col("r"), F.col("next") - F.col("y") - 1).otherwise(0)
    both = (F.col("dl") != 0) & (F.col("dr") != 0)
    beside = F.when(F.col("dl") == 0, F.col("l")).otherwise(F.col("r"))  # the column without a change
    straight = F.when(both & (F.col("dl") == F.col("dr")), 1).otherwise(0)
    slanted = F.when(both, 0).otherwise(beside)
    crossed = F.when(both & (F.col("dl") != F.col("dr")), 1).otherwise(0)
    total = F.sum(between + straight) + sqrt(2) * F.sum(slanted) + 2 * sqrt(2) * F.sum(crossed)
    return rows.groupBy(*keys).agg(total.alias("perimeter"))


def box_counts(runs: DataFrame, keys: Sequence[str], box: DataFrame | None = None) -> DataFrame:
    """``scale, boxes`` as :func:`shape.box_counts`: in each column of boxes, the rows of boxes that any run meets, counted by stretches."""
    box = (extent(runs, keys) if box is None else box).where("area >= 8").select(*keys, "x0", "y0", F.least("w", "h").cast("long").alias("side"))
    placed = runs.join(box, list(keys)).select(*keys, "side", (F.col("x") - F.col("x0")).alias("bx"), (F.col("y1") - F.col("y0")).alias("a"), (F.col("y2") - 1 - F.col("y0")).alias("b"))
    top = F.least(F.lit(LEVELS - 1), F.length(F.bin("side")) - 1)
    at = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    filed = placed.select(*keys, "side", "bx", "a", "b", F.explode(F.sequence(F.lit(0), top)).alias("level"))
    filed = filed.select(*keys, "side", "level", at("bx").alias("x"), at("a").alias("y1"), (at("b") + 1).alias("y2")).distinct()
    counted = _merged(filed, [*keys, "side", "level"]).groupBy(*keys, "level").agg(F.sum(F.col("y2") - F.col("y1")).alias("boxes"))
    return counted.select(*keys, F.call_function("shiftleft", F.lit(1), F.col("level")).alias("scale"), "boxes")


def column_sums(image_pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Running sums down the columns of ``image_pixels(key, x, y, b, g, r)``: what a run sums up is the difference of two rows.

    ``y`` names the row after the last one that is summed, so each column also has a row 0.  The images must have every pixel that a
    mask covers.
    """
    rows = image_pixels.select(key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *[F.col(c).cast("long").alias(c) for c in "bgr"])
    rows = rows.withColumn("v", gray(F.col("b"), F.col("g"), F.col("r")).cast("long")).withColumn("vv", F.col("v") * F.col("v"))
    so_far = Window.partitionBy(key, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    names = ("b", "g", "r", "v", "vv")
    sums = rows.select(key, "x", (F.col("y") + 1).alias("y"), *[F.sum(c).over(so_far).alias(f"s_{c}") for c in names])
    first = rows.select(key, "x").distinct().select(key, "x", F.lit(0).cast("long").alias("y"), *[F.lit(0).cast("long").alias(f"s_{c}") for c in names])
    return sums.unionByName(first)


def colour(runs: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``mean_brightness, std_brightness, mean_r, mean_g, mean_b`` under each mask from :func:`column_sums`; the first key names the image.

    Each run looks up two rows; sums are whole numbers, so nothing is lost by the differences.
    """
    key, names = keys[0], ("b", "g", "r", "v", "vv")
    ends = F.explode(F.array(F.struct(F.col("y1").alias("y"), F.lit(-1).alias("sign")), F.struct(F.col("y2").alias("y"), F.lit(1).alias("sign")))).alias("e")
    looked = runs.select(*keys, F.col("x").cast("long").alias("x"), ends).select(*keys, "x", "e.y", "e.sign").join(sums, [key, "x", "y"])
    total = looked.groupBy(*keys).agg(F.sum(F.col("sign") * F.col("y")).alias("n"), *[F.sum(F.col("sign") * F.col(f"s_{c}")).alias(c) for c in names])
    n = F.col("n")
    spread = (n.cast("decimal(19,0)") * F.col("vv") - F.col("v").cast("decimal(19,0)") * F.col("v")).cast("double")  # exact before the root
    return total.select(*keys, (F.col("v") / n).alias("mean_brightness"), (F.sqrt(spread) / n).alias("std_brightness"), *[(F.col(c) / n).alias(f"mean_{c}") for c in "rgb"])


def features(runs: DataFrame, sums: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """All ten features of masks as runs, as :func:`shape.features` of their pixels; ``sums`` are the images' :func:`column_sums`."""
    on = list(keys)
    box = extent(runs, keys)
    slope = F.regr_slope(F.log("boxes"), -F.log("scale"))
    fitted = box_counts(runs, keys, box).where("boxes >= 2").groupBy(*keys)
    dimension = fitted.agg(F.when(F.count("*") >= 3, F.greatest(F.lit(0.0), F.least(F.lit(2.0), slope))).alias("fractal_dimension"))
    joined = box.join(perimeter(runs, keys), on).join(dimension, on, "left").join(colour(runs, sums, keys), on)
    return joined.select(
        *keys, F.col("area").cast("double").alias("area_px"), (F.col("w") / F.col("h")).alias("elongation"), (F.col("area") / (height * width)).alias("area_fraction"),
        compactness(F.col("area").cast("double"), F.col("perimeter")).alias("compactness"), "fractal_dimension", "mean_brightness", "std_brightness", "mean_r", "mean_g", "mean_b",
    )


def run_pairs(reference: DataFrame, predicted: DataFrame, threshold: float, key: str = "image_id") -> DataFrame:
    """``key, r_id, p_id, iou`` of all pairs of masks that overlap by ``threshold`` at least, from runs ``(key, id, x, y1, y2)``.

    Runs meet by image, column and band of rows; what two runs share is the part of their overlap that lies in the band.
    """
    def banded(runs: DataFrame, p: str) -> DataFrame:
        band = F.explode(F.sequence(F.expr(f"y1 div {BAND}"), F.expr(f"(y2 - 1) div {BAND}"))).alias("band")
        return runs.select(key, F.col("id").alias(p + "id"), "x", band, F.col("y1").alias(p + "y1"), F.col("y2").alias(p + "y2"))

    start = F.greatest("r_y1", "p_y1", F.col("band") * BAND)
    end = F.least("r_y2", "p_y2", (F.col("band") + 1) * BAND)
    shared = banded(reference, "r_").join(banded(predicted, "p_"), [key, "x", "band"]).where((F.col("r_y1") < F.col("p_y2")) & (F.col("p_y1") < F.col("r_y2")) & (end > start))
    common = shared.groupBy(key, "r_id", "p_id").agg(F.sum(end - start).alias("common"))
    sizes = [df.groupBy(key, F.col("id").alias(n)).agg(F.sum(F.col("y2") - F.col("y1")).alias(size)) for df, n, size in ((reference, "r_id", "r_size"), (predicted, "p_id", "p_size"))]
    iou = F.col("common") / (F.col("r_size") + F.col("p_size") - F.col("common"))
    scored = common.join(sizes[0], [key, "r_id"]).join(sizes[1], [key, "p_id"]).withColumn("iou", iou)
    return scored.where(F.col("iou") >= threshold).select(key, "r_id", "p_id", "iou")
