"""Distances of many points to many shapes at once: numpy over the flat buffers of Arrow list columns, no object a point."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _parts(shapes: pa.Array, closed: bool) -> tuple[np.ndarray, ...]:
    """Flat x and y of all points; starts of each shape's points; for each segment its shape and the places of its ends. A shape of one point has one segment of no length."""
    if isinstance(shapes, pa.ChunkedArray):
        shapes = shapes.combine_chunks()
    sizes = np.diff(shapes.offsets.to_numpy()).astype(np.int64)
    if shapes.null_count:
        sizes[np.asarray(shapes.is_null())] = 0
    flat = shapes.flatten()
    x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y"))
    first = np.concatenate([[0], np.cumsum(sizes)])
    count = sizes if closed else np.where(sizes == 1, 1, np.maximum(sizes - 1, 0))
    own = np.repeat(np.arange(len(sizes)), count)
    a = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]
    b = a + 1
    end = b == first[own + 1]
    b[end] = first[own[end]]
    return x, y, sizes, own, a, b


def _near(x, y, own, a, b, px, py) -> np.ndarray:
    dx, dy = x[b] - x[a], y[b] - y[a]
    wx, wy = px[own] - x[a], py[own] - y[a]
    size = dx * dx + dy * dy
    t = np.clip((wx * dx + wy * dy) / np.where(size > 0, size, 1.0), 0, 1)
    return np.hypot(wx - t * dx, wy - t * dy)


def _least(d: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.inf)
    if len(own):
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[at]] = np.minimum.reduceat(d, at)
    return out


def _floats(v: pa.Array) -> np.ndarray:
    return v.to_numpy(zero_copy_only=False).astype(np.float64)


@F.arrow_udf(DoubleType())
def line_distance(pts: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
    """From a point to a polyline; infinite for a line without points."""
    x, y, sizes, own, a, b = _parts(pts, False)
    return pa.array(_least(_near(x, y, own, a, b, _floats(px), _floats(py)), own, len(sizes)))


@F.arrow_udf(DoubleType())
def ring_distance(ring: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
    """From a point to a filled ring: 0 inside; infinite for a ring without points."""
    x, y, sizes, own, a, b = _parts(ring, True)
    qx, qy = _floats(px), _floats(py)
    out = _least(_near(x, y, own, a, b, qx, qy), own, len(sizes))
    up = (y[a] > qy[own]) != (y[b] > qy[own])
    rise = np.where(y[b] == y[a], 1.0, y[b] - y[a])
    hit = up & (qx[own] < (x[b] - x[a]) * (qy[own] - y[a]) / rise + x[a])
    odd = np.bincount(own, hit, len(sizes)).astype(np.int64) % 2 == 1
    return pa.array(np.where(odd, 0.0, out))
