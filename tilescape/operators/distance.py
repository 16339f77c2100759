"""Exact Euclidean distance transform of one tile's raster: the nearest known cell of every cell."""

from __future__ import annotations

import numpy as np

FAR = 1 << 40


def nearest_known(known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(row, column, squared distance) of the nearest known cell for each cell of a mask; None if nothing is known.

    Ties go to the lowest row, then column. Two passes: along the columns the nearest known
    cell above or below, along the rows the lower envelope of the parabolas that the columns
    send. The envelopes of all rows grow together, one column at a time: a column leaves each
    row's stack at most once, so the work is linear in the cells, however far gaps are from what is known.
    """
    ny, nx = known.shape
    columns = np.flatnonzero(known.any(axis=0))
    if not len(columns):
        return None
    at = np.arange(ny)[:, None]
    above = np.maximum.accumulate(np.where(known, at, -FAR), axis=0)
    below = np.minimum.accumulate(np.where(known, at, FAR)[::-1], axis=0)[::-1]
    nearest = np.where(at - above <= below - at, above, below)
    # Squared distance first, then row, then column in one number, so that no two parabolas are ever equal.
    scale = np.int64(nx) * ny + 1
    height = np.where(np.abs(nearest) < FAR // 2, scale * (at - nearest) ** 2 + nearest * nx + np.arange(nx), 0)

    rows = np.arange(ny)
    stack, start = np.zeros((ny, len(columns)), dtype=np.int64), np.zeros((ny, len(columns)), dtype=np.int64)
    top = np.full(ny, -1)
    for s in columns:
        begin, open_rows = np.zeros(ny, dtype=np.int64), rows[top >= 0]
        while len(open_rows):
            k = stack[open_rows, top[open_rows]]
            rise = scale * (s * s - k * k) + height[open_rows, s] - height[open_rows, k]
            begin[open_rows] = rise // (2 * scale * (s - k)) + 1  # the first cell where column s is nearer than column k
            beaten = begin[open_rows] <= start[open_rows, top[open_rows]]
            open_rows = open_rows[beaten]
            top[open_rows] -= 1
            begin[open_rows] = 0
            open_rows = open_rows[top[open_rows] >= 0]
        seen = rows[begin < nx]
        top[seen] += 1
        stack[seen, top[seen]], start[seen, top[seen]] = s, begin[seen]
    place = np.zeros((ny, nx), dtype=np.int64)
    for t in range(1, int(top.max()) + 1):
        here = rows[top >= t]
        place[here, start[here, t]] = t
    column = np.take_along_axis(stack, np.maximum.accumulate(place, axis=1), axis=1)
    row = np.take_along_axis(nearest, column, axis=1)
    return row, column, (at - row) ** 2 + (np.arange(nx) - column) ** 2
