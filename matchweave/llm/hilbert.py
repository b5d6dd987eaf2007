"""Places of points along a Hilbert curve through a grid of any number of axes."""

from __future__ import annotations

import numpy as np


def places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each grid cell (rows of unsigned coordinates below ``2 ** bits``) along the curve.

    Neighbours along the curve are neighbours in the grid. A place needs axes x bits <= 63 bits.
    The coordinates are turned level by level into the frame of the part of the curve they lie
    in (J. Skilling, Programming the Hilbert curve, 2004), all points at once.
    """
    axes = cells.shape[1]
    if axes * bits > 63:
        raise ValueError("a place along the curve has at most 63 bits")
    x = [cells[:, i].astype(np.int64) for i in range(axes)]
    top = 1 << (bits - 1)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(axes):
            flip = (x[i] >> level) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[i] = x[i] ^ swap
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap if i else x[0])
    for i in range(1, axes):
        x[i] = x[i] ^ x[i - 1]
    turn, level = np.zeros(len(cells), np.int64), top
    while level > 1:
        turn = np.where(x[-1] & level, turn ^ (level - 1), turn)
        level >>= 1
    place = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            place = (place << 1) | (((x[i] ^ turn) >> bit) & 1)
    return place
