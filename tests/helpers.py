"""Images without an image library, and plain readings of rows."""

import struct

import numpy as np


def write_bmp(path, image):
    """A 24-bit BMP from rows, columns and blue-green-red bytes."""
    height, width, _ = image.shape
    pad = -3 * width % 4
    rows = b"".join(image[y].tobytes() + b"\0" * pad for y in range(height - 1, -1, -1))
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, width, height, 1, 24, 0, len(rows), 2835, 2835, 0, 0)
    path.write_bytes(head + rows)


def solid(height=10, width=20, bgr=(10, 20, 30)):
    return np.tile(np.array(bgr, np.uint8), (height, width, 1))


def block_mask(height=10, width=20, rows=(2, 6), columns=(3, 11)):
    mask = np.zeros((height, width), bool)
    mask[rows[0] : rows[1], columns[0] : columns[1]] = True
    return mask


def values(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
