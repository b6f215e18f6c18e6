"""Shape kernels as columns: what higher-order functions can't say, in Arrow batches; the rest as plain expressions.

Lines and rings are arrays of (id, x, y, z) structs, as in functions.polylines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from ..errors import GeometryError
from . import polylines as P
from . import shapes as S

POINT = StructType([StructField(c, DoubleType()) for c in ("x", "y", "z")])
LINE = ArrayType(POINT)
PAIR = StructType([StructField("a", POINT), StructField("b", POINT), StructField("distance", DoubleType())])
_PA_POINT = pa.struct([(c, pa.float64()) for c in ("x", "y", "z")])
_PA_LINE = pa.list_(_PA_POINT)


def _flat(pts) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in pts]


def _deep(pts) -> list[tuple[float, float, float]]:
    return [(p["x"], p["y"], p["z"] or 0.0) for p in pts]


def _out(p) -> dict:
    return {"x": p[0], "y": p[1], "z": p[2] if len(p) > 2 else 0.0}


def _each(kind: pa.DataType, fn: Callable, *cols: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in cols), strict=True)
    return pa.array([None if any(x is None for x in r) else fn(*r) for r in rows], kind)


# ---- of one shape -----------------------------------------------------------------------------------------------


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def triangulate(ring: pa.Array) -> pa.Array:
    """Triples of places in the ring, counter-clockwise; an error for fewer than three points."""
    return _each(pa.list_(pa.list_(pa.int32())), lambda r: [list(t) for t in S.triangulate(_flat(r))], ring)


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def convex_partition(ring: pa.Array) -> pa.Array:
    """Convex parts of a ring as lists of places in it."""
    return _each(pa.list_(pa.list_(pa.int32())), lambda r: S.convex_partition(_flat(r)), ring)


@F.arrow_udf(LINE)
def offset(line: pa.Array, d: pa.Array) -> pa.Array:
    """Parallel line at d to the left; an error where it runs against the line. z is 0."""
    return _each(_PA_LINE, lambda l, x: [_out(p) for p in S.offset(_flat(l), x)], line, d)


@F.arrow_udf(LINE)
def shifted(line: pa.Array, d: pa.Array) -> pa.Array:
    """As offset, without the error."""
    return _each(_PA_LINE, lambda l, x: [_out(p) for p in S.shift(_flat(l), x)] if len(l) > 1 else [], line, d)


@F.arrow_udf(LINE)
def centreline(left: pa.Array, right: pa.Array) -> pa.Array:
    """Middle line of two bounds; empty where a bound is."""
    return _each(_PA_LINE, lambda a, b: [_out(p) for p in S.centreline(_deep(a), _deep(b))], left, right)


# ---- of two shapes ----------------------------------------------------------------------------------------------


@F.arrow_udf(ArrayType(POINT))
def crossings(a: pa.Array, b: pa.Array) -> pa.Array:
    """Points where two lines meet, in the first's order. z is 0."""
    return _each(_PA_LINE, lambda x, y: [_out(p) for p in S.crossings(_flat(x), _flat(y))], a, b)


@F.arrow_udf(BooleanType())
def lines_meet(a: pa.Array, b: pa.Array) -> pa.Array:
    return _each(pa.bool_(), lambda x, y: S.lines_meet(_flat(x), _flat(y)), a, b)


@F.arrow_udf(BooleanType())
def lines_meet_3d(a: pa.Array, b: pa.Array, height: pa.Array) -> pa.Array:
    """Whether two lines cross seen from above, and there lie less than height apart."""
    return _each(pa.bool_(), lambda x, y, h: any(gap < h for gap in S.gaps(_deep(x), _deep(y))), a, b, height)


@F.arrow_udf(PAIR)
def closest_points(a: pa.Array, b: pa.Array) -> pa.Array:
    """Nearest points of two lines seen from above, and their distance. z is 0."""

    def one(x, y) -> dict:
        p, q = S.closest_pair(_flat(x), _flat(y))
        return {"a": _out(p), "b": _out(q), "distance": math.dist(p, q)}

    return _each(pa.struct([("a", _PA_POINT), ("b", _PA_POINT), ("distance", pa.float64())]), one, a, b)


@F.arrow_udf(PAIR)
def closest_points_3d(a: pa.Array, b: pa.Array) -> pa.Array:
    """Nearest points of two lines in space, and their distance."""

    def one(x, y) -> dict:
        p, q = S.closest_pair(_deep(x), _deep(y))
        return {"a": _out(p), "b": _out(q), "distance": math.dist(p, q)}

    return _each(pa.struct([("a", _PA_POINT), ("b", _PA_POINT), ("distance", pa.float64())]), one, a, b)


@F.arrow_udf(BooleanType())
def rings_meet(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two filled rings share a point, their borders included."""
    return _each(pa.bool_(), lambda x, y: S.meet(_flat(x), _flat(y)), a, b)


@F.arrow_udf(BooleanType())
def rings_overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether the interiors of two rings meet."""
    return _each(pa.bool_(), lambda x, y: S.overlaps(_flat(x), _flat(y)), a, b)


@F.arrow_udf(DoubleType())
def border_gap(a: pa.Array, b: pa.Array) -> pa.Array:
    """How far apart in height two rings' borders are where they are nearest seen from above."""
    return _each(pa.float64(), lambda x, y: S.height_gap(_deep(x), _deep(y)), a, b)


@F.arrow_udf(DoubleType())
def ring_to_ring(a: pa.Array, b: pa.Array) -> pa.Array:
    """Between two filled rings; 0 where they overlap."""
    return _each(pa.float64(), lambda x, y: S.ring_distance(_flat(x), _flat(y)), a, b)


@F.arrow_udf(LINE)
def outline(rings: pa.Array) -> pa.Array:
    """The ring around rings that touch in turn: their segments but for those that two of them share. An error where they don't touch."""
    return _each(_PA_LINE, lambda r: [_out(p) for p in S.outline([_deep(x) for x in r])], rings)


def overlaps_3d(a: Column, b: Column, height) -> Column:
    """Overlap seen from above, and the borders less than height apart where they are nearest."""
    return rings_overlap(a, b) & (border_gap(a, b) < height)


def touches(a: Column, b: Column) -> Column:
    """Whether a ring has a segment that the other has backwards, by the points' ids."""
    key = lambda s, x, y: F.concat_ws(">", s[x]["id"].cast("string"), s[y]["id"].cast("string"))
    return F.arrays_overlap(F.transform(P.ring_segments(a), lambda s: key(s, "a", "b")), F.transform(P.ring_segments(b), lambda s: key(s, "b", "a")))


def crossing_distances(a: Column, b: Column) -> Column:
    """Where two (centre) lines cross: (x, y, and the length along each, measured on its own line)."""
    return F.transform(crossings(a, b), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), P.to_arc(a, p)["length"].alias("along_a"), P.to_arc(b, p)["length"].alias("along_b")))


def border_distance_3d(ring: Column, p: Column) -> Column:
    """From p to the ring's border in space; the ring is closed."""
    return P.distance_to(_closed(ring), p, z=True)


def border_point_3d(ring: Column, p: Column) -> Column:
    """The border's point nearest to p in space."""
    return P.project(_closed(ring), p, z=True)


def _closed(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def distance_to_lines(lines: Column, p: Column) -> Column:
    """From p to the nearest of an array of lines; infinite for none."""
    return F.coalesce(F.array_min(F.transform(lines, lambda l: P.distance_to(l, p))), F.lit(float("inf")))


def sorted_along(line: Column, points: Column) -> Column:
    """Points in the order of their places along the line, ties as they came."""
    rated = F.transform(points, lambda p, i: F.struct(P.to_arc(line, p)["length"].alias("at"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(rated), lambda r: r["p"])


def max_curve_speed(*_) -> Column:
    """Not defined: there is no model of what a vehicle can do in a bend. Always an error."""
    raise GeometryError("the speed in a curve is not defined")


# ---- compounds and sequences ------------------------------------------------------------------------------------


def joined(lines: Column) -> Column:
    """Several lines as one: of points equal in id that follow each other, the first."""
    return P.without_repeats(F.flatten(lines))


def turned(lines: Column) -> Column:
    """Several lines seen backwards: the last first, each reversed."""
    return F.reverse(F.transform(lines, lambda l: F.reverse(l)))


def segment_at(pts: Column, i: Column) -> Column:
    """The i-th segment (from 0) as (a, b); null beyond the last."""
    return F.try_element_at(P.segments(pts), i + 1)


def point_at(pts: Column, i: Column) -> Column:
    return F.try_element_at(pts, i + 1)


def sequence_ring(lefts: Column, rights: Column) -> Column:
    """Outline of lanes in a row: their left bounds as one line, their right bounds backwards."""
    return P.lane_ring(joined(lefts), joined(rights))


# ---- points and vectors -----------------------------------------------------------------------------------------


def to_2d(p: Column) -> Column:
    return F.struct(p["x"].alias("x"), p["y"].alias("y"))


def to_3d(p: Column, z: Column | float = 0.0) -> Column:
    return F.struct(p["x"].alias("x"), p["y"].alias("y"), (F.lit(z) if isinstance(z, float) else z).alias("z"))


def bare(p: Column) -> Column:
    """A point without its id."""
    return F.struct(*[p[c].alias(c) for c in ("x", "y", "z")])


def _by_axis(op: Callable, p: Column) -> Column:
    return F.struct(*[op(c).alias(c) for c in ("x", "y", "z")])


def add(p: Column, q: Column) -> Column:
    return _by_axis(lambda c: p[c] + q[c], p)


def subtract(p: Column, q: Column) -> Column:
    return _by_axis(lambda c: p[c] - q[c], p)


def scale(p: Column, k: Column | float) -> Column:
    return _by_axis(lambda c: p[c] * k, p)


def divide(p: Column, k: Column | float) -> Column:
    return _by_axis(lambda c: p[c] / k, p)


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def equal(a: Column, b: Column) -> Column:
    """Whether two lines (or rings) have the same coordinates in the same order."""
    return F.transform(a, bare) == F.transform(b, bare)


def near_zero(x: Column, eps: float = 1e-9) -> Column:
    return F.abs(x) < eps
