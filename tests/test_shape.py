import math

import numpy as np
import pytest
from helpers import block_mask, solid

from maskmetrics.operators import kernel, shape
from maskmetrics.schemas import FEATURES

PIXEL = "image_id int, ann int, x int, y int, b int, g int, r int"


def pixel_rows(spark, masks, image):
    rows = []
    for k, mask in enumerate(masks):
        for y, x in zip(*np.nonzero(mask)):
            rows.append((0, k, int(x), int(y), *map(int, image[y, x])))
    return spark.createDataFrame(rows, PIXEL)


def test_block_on_a_solid_image():
    got = kernel.mask_features(solid(), block_mask())
    assert (got["area_px"], got["elongation"], got["area_fraction"]) == (32, 2.0, 0.16)
    assert (got["mean_r"], got["mean_g"], got["mean_b"]) == (30, 20, 10)
    assert (got["mean_brightness"], got["std_brightness"]) == (22, 0)
    assert got["compactness"] == 1.0 and got["fractal_dimension"] == pytest.approx(2.0)


@pytest.mark.parametrize(
    ("rows", "length"),
    [
        (["1"], 0),
        (["111", "101", "111"], 8 + 4 * math.sqrt(2)),
        (["10", "01"], 2 * math.sqrt(2)),
        (["1100", "1100", "0000", "0011", "0011"], 8),
        (["1111"], 6),
    ],
)
def test_border_length(rows, length):
    mask = np.array([[c == "1" for c in r] for r in rows])
    assert kernel.border_length(mask) == pytest.approx(length)


def test_features_that_are_not_defined():
    one = np.zeros((4, 4), bool)
    one[1, 1] = True
    got = kernel.mask_features(solid(4, 4), one)
    assert got["compactness"] is None and got["fractal_dimension"] is None
    strip = np.ones((3, 9), bool)  # only scales 1 and 2 fit
    assert kernel.dimension(strip) is None
    seven = np.zeros((8, 8), bool)
    seven[0, :7] = True
    assert kernel.dimension(seven) is None
    with pytest.raises(ValueError):
        kernel.mask_features(solid(4, 4), np.zeros((4, 4), bool))
    with pytest.raises(ValueError):
        kernel.mask_features(solid(4, 4), np.ones((4, 5), bool))


def test_relations_and_arrays_agree(spark):
    rng = np.random.default_rng(0)
    height, width = 21, 26
    image = rng.integers(0, 256, (height, width, 3), dtype=np.uint8)
    masks = [rng.random((height, width)) < p for p in (0.02, 0.1, 0.3, 0.6, 0.95)] + [block_mask(height, width), block_mask(height, width, (0, 1), (0, 1))]
    got = {r["ann"]: r for r in shape.features(pixel_rows(spark, masks, image), ["image_id", "ann"], height, width).collect()}
    assert len(got) == len(masks)
    for k, mask in enumerate(masks):
        want = kernel.mask_features(image, mask)
        for name in FEATURES:
            assert got[k][name] == (pytest.approx(want[name], abs=1e-9) if want[name] is not None else None), (k, name)


def test_no_pixels(spark):
    none = spark.createDataFrame([], PIXEL)
    assert shape.features(none, ["image_id", "ann"], 4, 4).count() == 0


def test_mask_is_brought_to_the_image():
    small = np.array([[0.5, 0.6], [0.0, 1.0]])
    assert kernel.binary_mask(small, 4, 4).tolist() == [[False, False, True, True]] * 2 + [[False, False, True, True]] * 2
    assert kernel.pixels_of(bytes(range(4)), 2, 2, 1)[1, 1].tolist() == [3, 3, 3]
    assert kernel.pixels_of(bytes(range(16)), 2, 2, 4).shape == (2, 2, 3)


def test_masks_of_many_tiles(spark):
    rng = np.random.default_rng(1)
    height, width = 150, 210
    image = rng.integers(0, 256, (height, width, 3), dtype=np.uint8)
    y, x = np.mgrid[:height, :width]
    disc = (y - 70) ** 2 + (x - 101) ** 2 < 61**2
    masks = [disc, disc & (rng.random((height, width)) < 0.9), ~disc, rng.random((height, width)) < 0.01, (y + x) % 2 == 0, (y % 16 == 5) | (x % 8 == 7)]
    rows = pixel_rows(spark, masks, image)
    got = {r["ann"]: r for r in shape.features(rows, ["image_id", "ann"], height, width).collect()}
    for k, mask in enumerate(masks):
        want = kernel.mask_features(image, mask)
        for name in FEATURES:
            assert got[k][name] == pytest.approx(want[name], abs=1e-9), (k, name)
    lengths = {r["ann"]: r["perimeter"] for r in shape.perimeter(rows, ["image_id", "ann"]).collect()}
    assert [lengths[k] for k in range(len(masks))] == pytest.approx([kernel.border_length(m) for m in masks])
    # repeated pixels are no further ones
    again = rows.unionByName(rows)
    assert shape.perimeter(again, ["image_id", "ann"]).where("ann = 0").first()["perimeter"] == pytest.approx(lengths[0])
