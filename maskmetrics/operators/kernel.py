"""The mask features from arrays, for images too large to be turned into pixel rows."""

from __future__ import annotations

import math

import numpy as np

from ..functions.expressions import GRAY

_SIDE, _DIAGONAL = {3, 5, 10, 12}, {7, 11, 13, 14}
#: Border length of a corner by its code, as in ``shape.perimeter``.
CORNER_LENGTH = np.array([1.0 if c in _SIDE else math.sqrt(2) if c in _DIAGONAL else 2 * math.sqrt(2) if c in {6, 9} else 0.0 for c in range(16)])


def crop(mask: np.ndarray) -> np.ndarray:
    """The mask inside its bounding box."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return mask[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]


def border_length(mask: np.ndarray) -> float:
    m = np.pad(mask.astype(np.uint8), 1)
    codes = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, :-1] + 8 * m[1:, 1:]
    return float(CORNER_LENGTH @ np.bincount(codes.ravel(), minlength=16))


def dimension(mask: np.ndarray) -> float | None:
    """Box-counting dimension of a mask; None where it is not defined."""
    mask = np.asarray(mask, bool)
    if mask.ndim != 2 or np.count_nonzero(mask) < 8:
        return None
    box = crop(mask)
    points = []
    for level in range(min(box.shape).bit_length()):
        side = 1 << level
        occupied = np.logical_or.reduceat(np.logical_or.reduceat(box, np.arange(0, box.shape[0], side), axis=0), np.arange(0, box.shape[1], side), axis=1)
        if (n := int(np.count_nonzero(occupied))) >= 2:
            points.append((-math.log(side), math.log(n)))
    if len(points) < 3:
        return None
    x, y = np.array(points).T
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    return float(min(2.0, max(0.0, slope)))


def mask_features(image: np.ndarray, mask: np.ndarray) -> dict[str, float | None]:
    """The ten features of one mask over an image (rows, columns, blue-green-red); None where one is not defined.

    An empty mask and a mask of another size than the image are errors.
    """
    mask = np.asarray(mask, bool)
    if mask.shape != image.shape[:2]:
        raise ValueError(f"the mask is {mask.shape}, the image {image.shape[:2]}")
    area = int(np.count_nonzero(mask))
    if not area:
        raise ValueError("a mask without pixels has no features")
    height, width = crop(mask).shape
    around = border_length(mask)
    b, g, r = (image[..., c][mask].astype(np.int64) for c in range(3))
    level = (b * GRAY["b"] + g * GRAY["g"] + r * GRAY["r"] + (1 << 14)) >> 15
    return {
        "area_px": float(area),
        "compactness": min(1.0, 4 * math.pi * area / around**2) if around else None,
        "fractal_dimension": dimension(mask),
        "mean_brightness": float(level.mean()),
        "std_brightness": float(level.std()),
        "mean_r": float(r.mean()),
        "mean_g": float(g.mean()),
        "mean_b": float(b.mean()),
        "elongation": width / height,
        "area_fraction": area / mask.size,
    }


def binary_mask(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """A mask from probabilities over 0.5, brought to the image's size by nearest neighbour if it has another."""
    mask = np.asarray(values) > 0.5
    if mask.shape != (height, width):
        rows = np.minimum(np.arange(height) * mask.shape[0] // height, mask.shape[0] - 1)
        columns = np.minimum(np.arange(width) * mask.shape[1] // width, mask.shape[1] - 1)
        mask = mask[np.ix_(rows, columns)]
    return mask


def pixels_of(data: bytes, height: int, width: int, channels: int, orientation: int = 1) -> np.ndarray:
    """Image bytes as rows, columns and three channels: gray is repeated, a fourth channel dropped, and what a camera's mark asks for is turned."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return upright(np.repeat(image, 3, axis=2) if channels == 1 else image[..., :3], orientation)


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """An image as its orientation mark, from 1 to 8, says it is to be seen: 5 to 8 change rows and columns, the others of each four mirror one or both."""
    if orientation > 4:
        image, orientation = image.swapaxes(0, 1), {5: 1, 6: 2, 7: 3, 8: 4}[orientation]
    if orientation in (3, 4):
        image = image[::-1]
    if orientation in (2, 3):
        image = image[:, ::-1]
    return np.ascontiguousarray(image)


def orientation_mark(head: bytes) -> int:
    """The orientation mark in the first bytes of a JPEG file; 1, upright, without a valid one."""
    at = 2 if head[:2] == b"\xff\xd8" else len(head)
    while at + 4 <= len(head) and head[at] == 0xFF:
        kind, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if kind == 0xFF:  # a fill byte
            at += 1
        elif kind == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            return _tag(head[at + 10 : at + 2 + size])
        elif kind in (0xD9, 0xDA):  # the picture itself
            break
        else:
            at += 2 + size
    return 1


def _tag(tiff: bytes) -> int:
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None:
        return 1
    number = lambda at, n: int.from_bytes(tiff[at : at + n], order)
    start = number(4, 4)
    for at in range(start + 2, min(start + 2 + 12 * number(start, 2), len(tiff) - 11), 12):
        if (number(at, 2), number(at + 2, 2)) == (0x0112, 3) and 1 <= number(at + 8, 2) <= 8:
            return number(at + 8, 2)
    return 1
