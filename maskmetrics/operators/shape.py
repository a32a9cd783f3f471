"""Shape and colour features as relations over pixel rows.

Every function takes rows of set pixels ``(*keys, x, y)``, one row per pixel and mask, and
returns one row per mask.  All of it is built-in expressions; a mask's pixels are never
gathered, so masks of any size work.  ``kernel`` computes the same values from arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import compactness, gray

#: The four levels of boxes within one tile of 8 by 8 pixels, and all that are counted; the largest box has a side of 2 ** 30.
TILE_LEVELS, LEVELS = 3, 31


def _tiles(places: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys.., tx, ty, bits``: pixels ``(keys.., tx, ty, ix, iy)`` of a tile of 8 by 8 as the digits ``ix + 8 iy`` of one number, combined before the shuffle."""
    digit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("ix") + 8 * F.col("iy")).cast("int"))
    return places.groupBy(*keys, "tx", "ty").agg(F.bit_or(digit).alias("bits"))


def _shifted(bits: Column, by: int, kept: int) -> Column:
    return F.shiftrightunsigned(bits, by).bitwiseAND(F.lit(kept))


def perimeter(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``perimeter``: closed length of all borders of a mask, holes included.

    A border passes a corner between pixels where one to three of the four around it are set: two neighbours give 1, three give the
    diagonal of a pixel, two opposite ones two diagonals, and one gives nothing, as the border runs through pixel centres.
    Tiles of 8 by 8 pixels overlap by one, so that each corner lies within one tile, where all 49 are compared at once by bits.
    """

    def tiles(c: str) -> Column:
        own = F.floor(F.col(c) / 7)
        here = F.struct(own.alias("t"), (F.col(c) - 7 * own).alias("i"))
        return F.explode(F.when(F.col(c) == 7 * own, F.array(here, F.struct((own - 1).alias("t"), F.lit(7).cast("long").alias("i")))).otherwise(F.array(here)))

    placed = pixels.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    placed = placed.select(*keys, "y", tiles("x").alias("_x")).select(*keys, "_x", tiles("y").alias("_y"))
    found = _tiles(placed.select(*keys, F.col("_x.t").alias("tx"), F.col("_y.t").alias("ty"), F.col("_x.i").alias("ix"), F.col("_y.i").alias("iy")), keys)

    corners = sum(0x7F << 8 * k for k in range(7))
    around = found.select(*keys, *[_shifted(F.col("bits"), by, corners).alias(n) for n, by in (("a", 0), ("b", 1), ("c", 8), ("d", 9))])
    a, b, c, d = (F.col(n) for n in "abcd")
    both = lambda p, q: p.bitwiseAND(q)
    either = lambda p, q: p.bitwiseOR(q)
    odd = a.bitwiseXOR(b).bitwiseXOR(c).bitwiseXOR(d)
    three = both(odd, either(both(a, b), both(c, d)))
    opposite = both(both(a.bitwiseXOR(b), a.bitwiseXOR(c)), both(F.bitwise_not(a.bitwiseXOR(d)), F.bitwise_not(b.bitwiseXOR(c))))
    two = both(both(F.bitwise_not(odd), either(either(a, b), either(c, d))), F.bitwise_not(both(both(a, b), both(c, d))))
    beside = both(two, F.bitwise_not(opposite))
    counts = [F.sum(F.bit_count(x)) for x in (beside, three, opposite)]
    return around.groupBy(*keys).agg((counts[0] + sqrt(2) * counts[1] + 2 * sqrt(2) * counts[2]).alias("perimeter"))


def _extent() -> list[Column]:
    return [F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")]


def extent(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``area``, ``x0``, ``y0``, ``w`` and ``h``: pixel count and bounding box."""
    return pixels.groupBy(*keys).agg(*_extent())


def _shape(height: int, width: int) -> list[Column]:
    return [F.col("area").cast("double").alias("area_px"), (F.col("w") / F.col("h")).alias("elongation"), (F.col("area") / (height * width)).alias("area_fraction")]


def shape(pixels: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """``area_px, elongation, area_fraction`` with the box; the frame is ``height`` by ``width``."""
    return extent(pixels, keys).select(*keys, "w", "h", *_shape(height, width))


def mask_compactness(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``compactness`` from area and perimeter; null for a mask whose border has no length."""
    return extent(pixels, keys).join(perimeter(pixels, keys), list(keys)).select(*keys, compactness(F.col("area").cast("double"), F.col("perimeter")).alias("compactness"))


def box_counts(pixels: DataFrame, keys: Sequence[str], box: DataFrame | None = None) -> DataFrame:
    """``scale, boxes``: occupied boxes of side 1, 2, 4, .. up to the shorter side of the bounding box, whose corner anchors the grid.

    Masks under 8 pixels are left out.  Boxes of side 1, 2, 4 and 8 are counted by bits within tiles of 8 by 8 pixels; larger ones are put together from the
    occupied tiles.  ``box`` is the masks' :func:`extent`, if known.
    """
    box = (extent(pixels, keys) if box is None else box).where("area >= 8").select(*keys, "x0", "y0", F.least("w", "h").cast("long").alias("side"))
    places = pixels.join(box, list(keys)).select(*keys, "side", *[(F.col(c) - F.col(c + "0")).cast("long").alias("b" + c) for c in "xy"])
    inside = [F.col("b" + c).bitwiseAND(F.lit(7)).alias("i" + c) for c in "xy"]
    tiles = _tiles(places.select(*keys, "side", *[F.shiftright("b" + c, TILE_LEVELS).alias("t" + c) for c in "xy"], *inside), [*keys, "side"])
    # pairs of columns and rows are folded into their first
    bits = F.col("bits")
    twos = _shifted(bits.bitwiseOR(F.shiftrightunsigned(bits, 1)), 0, 0x5555555555555555)
    twos = twos.bitwiseOR(F.shiftrightunsigned(twos, 8)).bitwiseAND(F.lit(0x0055005500550055))
    fours = twos.bitwiseOR(F.shiftrightunsigned(twos, 2)).bitwiseAND(F.lit(0x0011001100110011))
    fours = fours.bitwiseOR(F.shiftrightunsigned(fours, 16)).bitwiseAND(F.lit(0x0000001100000011))
    small = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.bit_count(n).cast("long").alias("n")) for k, n in enumerate((bits, twos, fours))])
    top = F.least(F.lit(LEVELS - 1), F.length(F.bin("side")) - 1)
    large = F.when(top >= TILE_LEVELS, F.transform(F.sequence(F.lit(TILE_LEVELS), top), lambda k: F.struct(
        k.alias("level"), *[F.call_function("shiftright", F.col("t" + c), k - TILE_LEVELS).alias(c) for c in "xy"], F.lit(None).cast("long").alias("n")
    )))
    levels = tiles.select(*keys, "side", F.explode(F.concat(small, F.coalesce(large, F.array().cast(tiles.select(small).schema[0].dataType)))).alias("at"))
    occupied = levels.groupBy(*keys, "side", "at.level", "at.x", "at.y").agg(F.sum("at.n").alias("n"))  # without a number: one box
    counted = occupied.groupBy(*keys, "side", "level").agg(F.sum(F.coalesce("n", F.lit(1))).alias("boxes"))
    return counted.where(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) <= F.col("side")).select(*keys, F.call_function("shiftleft", F.lit(1), F.col("level")).alias("scale"), "boxes")


def _dimension(pixels: DataFrame, keys: Sequence[str], box: DataFrame) -> DataFrame:
    slope = F.regr_slope(F.log("boxes"), -F.log("scale"))
    fitted = box_counts(pixels, keys, box).where("boxes >= 2").groupBy(*keys)
    return fitted.agg(F.when(F.count("*") >= 3, F.greatest(F.lit(0.0), F.least(F.lit(2.0), slope))).alias("fractal_dimension"))


def box_dimension(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``fractal_dimension``: slope of the logarithm of boxes on that of 1 / scale over scales with at least 2 boxes, between 0 and 2.

    Null with fewer than 3 such scales, or under 8 pixels.
    """
    box = extent(pixels, keys)
    return box.select(*keys).join(_dimension(pixels, keys, box), list(keys), "left")


def _colour() -> list[Column]:
    level = gray(F.col("b"), F.col("g"), F.col("r"))
    means = [F.avg(c).alias(f"mean_{c}") for c in ("r", "g", "b")]
    return [F.avg(level).alias("mean_brightness"), F.stddev_pop(level).alias("std_brightness"), *means]


def colour(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``mean_brightness, std_brightness`` (population) and channel means of rows with ``b, g, r``."""
    return pixels.groupBy(*keys).agg(*_colour())


def features(pixels: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """All ten features of masks over coloured pixel rows ``(*keys, x, y, b, g, r)``.

    Box and colours come from one aggregation; border and box counts need the places of the pixels and have their own.
    """
    on = list(keys)
    base = pixels.groupBy(*keys).agg(*_extent(), *_colour())
    around, boxes = perimeter(pixels, keys), _dimension(pixels, keys, extent(pixels, keys))
    round_ = compactness(F.col("area").cast("double"), F.col("perimeter")).alias("compactness")
    colours = ["mean_brightness", "std_brightness", "mean_r", "mean_g", "mean_b"]
    return base.join(around, on).join(boxes, on, "left").select(*keys, *_shape(height, width), round_, "fractal_dimension", *colours)


def masked_pixels(image_pixels: DataFrame, mask_pixels: DataFrame, keys: Sequence[str] = ("image_id", "ann")) -> DataFrame:
    """``keys.., x, y, b, g, r``: the colours of ``image_pixels(image, x, y, b, g, r)`` under each mask of ``mask_pixels(keys.., x, y)``, the first key naming the image.

    One equi-join by image and place; a mask's pixels outside its image are dropped.
    """
    return mask_pixels.select(*keys, "x", "y").distinct().join(image_pixels, [keys[0], "x", "y"]).select(*keys, "x", "y", "b", "g", "r")
