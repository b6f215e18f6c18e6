"""Polylines as arrays of (x, y, z) structs: lengths, interpolation, arc coordinates, boxes, rings. Higher-order array functions, so all stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 1e-8


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def distance(a: Column, b: Column, z: bool = False) -> Column:
    d = (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])
    if z:
        d = d + (a["z"] - b["z"]) * (a["z"] - b["z"])
    return F.sqrt(d)


def segments(pts: Column) -> Column:
    """(a, b) of neighbours; none for fewer than two points."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_segments(pts: Column) -> Column:
    """As segments, and the one that closes the ring."""
    turned = F.concat(F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))
    return F.zip_with(pts, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segment_lengths(pts: Column, z: bool = False) -> Column:
    return F.transform(segments(pts), lambda s: distance(s["a"], s["b"], z))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def length(pts: Column, z: bool = False) -> Column:
    return total(segment_lengths(pts, z))


def ranged_length(pts: Column, first: int, last: int, z: bool = False) -> Column:
    """Length from the point at `first` to the one before `last`."""
    return length(F.slice(pts, first + 1, max(0, last - first)), z)


def length_ratios(pts: Column, z: bool = False) -> Column:
    """Each segment's share of the length; one segment is 1, less than two points give none."""
    s = segment_lengths(pts, z)
    return F.when(F.size(s) == 1, F.array(F.lit(1.0))).otherwise(F.transform(s, lambda v: v / total(s)))


def running(values: Column) -> Column:
    return F.aggregate(values, F.expr("cast(array() as array<double>)"), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v)))


def accumulated_length_ratios(pts: Column, z: bool = False) -> Column:
    return running(length_ratios(pts, z))


def _mix(a: Column, b: Column, t: Column) -> Column:
    return F.struct(*[(a[c] + (b[c] - a[c]) * t).alias(c) for c in ("x", "y", "z")])


def _bare(p: Column) -> Column:
    return F.struct(*[p[c].cast("double").alias(c) for c in ("x", "y", "z")])


def interpolate(pts: Column, d: Column, z: bool = False) -> Column:
    """Point at distance d along the line, from its end where d is negative; the last point beyond the end; points nearer than 1e-8 snap."""
    none = F.lit(None).cast("struct<x: double, y: double, z: double>")
    start = F.struct(F.lit(0.0).alias("run"), none.alias("p"))
    given = F.struct(F.when(d < 0, F.reverse(pts)).otherwise(pts).alias("way"), F.abs(d).alias("far"))

    def body(v: Column) -> Column:
        sized = F.transform(segments(v["way"]), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), distance(s["a"], s["b"], z).alias("l"), v["far"].alias("far")))

        def step(acc: Column, s: Column) -> Column:
            end, rest = acc["run"] + s["l"], s["far"] - acc["run"]
            here = F.when(F.abs(rest - s["l"]) < NEAR, _bare(s["b"])).when(s["l"] > rest, F.when(F.abs(rest) < NEAR, _bare(s["a"])).otherwise(_mix(s["a"], s["b"], rest / s["l"])))
            return F.struct(end.alias("run"), F.when(acc["p"].isNotNull(), acc["p"]).otherwise(here).alias("p"))

        return F.coalesce(F.aggregate(sized, start, step)["p"], F.when(F.size(v["way"]) > 0, _bare(F.try_element_at(v["way"], F.lit(-1)))))

    return _let(given, body)


def nearest_vertex(pts: Column, d: Column, z: bool = False) -> Column:
    """The vertex nearest to distance d along the line (from its end where negative); the earlier one of a tie."""
    given = F.struct(F.when(d < 0, F.reverse(pts)).otherwise(pts).alias("way"), F.abs(d).alias("far"))

    def body(v: Column) -> Column:
        runs = F.concat(F.array(F.lit(0.0)), running(segment_lengths(v["way"], z)))
        rated = F.zip_with(v["way"], runs, lambda p, r: F.struct(F.abs(r - v["far"]).alias("d"), p.alias("p")))
        return _let(rated, lambda x: F.aggregate(x, F.try_element_at(x, F.lit(1)), lambda acc, w: F.when(w["d"] < acc["d"], w).otherwise(acc))["p"])

    return _let(given, body)


def curvature(a: Column, b: Column, c: Column, signed: bool = False) -> Column:
    """1 / radius through three points; infinite where two of them meet."""
    cross = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    product = distance(a, b) * distance(b, c) * distance(c, a)
    k = F.when(product < 1e-20, F.lit(float("inf"))).otherwise(2 * cross / F.when(product < 1e-20, F.lit(1.0)).otherwise(product))
    return k if signed else F.abs(k)


def curvatures(pts: Column) -> Column:
    """At each inner point."""
    n = F.greatest(F.size(pts) - 2, F.lit(0))
    two = F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(two, F.slice(pts, F.lit(3), n), lambda ab, c: curvature(ab["a"], ab["b"], c))


def _feet(parts: Column, p: Column, z: bool = False) -> Column:
    """Of each segment: its length, the share along it of p's foot, the foot, the distance, and the cross product for the length. One array function a step, so nothing is computed twice."""
    names = ("x", "y", "z") if z else ("x", "y")
    one = F.transform(
        parts,
        lambda s: F.struct(
            s["a"].alias("a"),
            s["b"].alias("b"),
            distance(s["a"], s["b"], z).alias("l"),
            sum(((p[c] - s["a"][c]) * (s["b"][c] - s["a"][c]) for c in names), F.lit(0.0)).alias("dot"),
            ((s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])).alias("cross"),
        ),
    )
    two = F.transform(one, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["l"].alias("l"), F.when(s["l"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["dot"] / (s["l"] * s["l"])))).otherwise(0.0).alias("t"), (s["cross"] / F.greatest(s["l"], F.lit(1e-12))).alias("side")))
    three = F.transform(two, lambda s: F.struct(s["l"].alias("l"), s["t"].alias("t"), s["side"].alias("side"), _mix(s["a"], s["b"], s["t"]).alias("foot")))
    return F.transform(three, lambda s: F.struct(s["l"].alias("l"), s["t"].alias("t"), s["side"].alias("side"), s["foot"].alias("foot"), distance(s["foot"], p, z).alias("d")))


def _rated(pts: Column, p: Column, z: bool = False) -> Column:
    """The nearest segment, the first of equal ones: distance to p, foot, length up to it, and the side that p is on."""
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("run"), F.lit(0.0).alias("at"), F.lit(None).cast("struct<x: double, y: double, z: double>").alias("foot"), F.lit(0.0).alias("side"))

    def step(acc: Column, s: Column) -> Column:
        near = s["d"] < acc["d"] - NEAR
        # where the foot is a vertex, the segment that turns away more from p tells the side
        tie = (F.abs(s["d"] - acc["d"]) < NEAR) & (F.abs(s["side"]) > F.abs(acc["side"]))
        return F.struct(
            F.when(near, s["d"]).otherwise(acc["d"]).alias("d"),
            (acc["run"] + s["l"]).alias("run"),
            F.when(near, acc["run"] + s["t"] * s["l"]).otherwise(acc["at"]).alias("at"),
            F.when(near, s["foot"]).otherwise(acc["foot"]).alias("foot"),
            F.when(near | tie, s["side"]).otherwise(acc["side"]).alias("side"),
        )

    return F.aggregate(_feet(segments(pts), p, z), start, step)


def project(pts: Column, p: Column, z: bool = False) -> Column:
    """The line's point nearest to p."""
    return F.coalesce(_rated(pts, p, z)["foot"], F.when(F.size(pts) > 0, _bare(F.try_element_at(pts, F.lit(1)))))


def distance_to(pts: Column, p: Column, z: bool = False) -> Column:
    """From p to the line; infinite for a line without points."""
    return _let(_rated(pts, p, z), lambda r: F.when(F.size(pts) == 1, distance(F.try_element_at(pts, F.lit(1)), p, z)).otherwise(r["d"]))


def signed_distance(pts: Column, p: Column) -> Column:
    """Positive where p lies left of the line."""
    return _let(_rated(pts, p), lambda r: F.when(r["side"] < 0, -r["d"]).otherwise(r["d"]))


def to_arc(pts: Column, p: Column) -> Column:
    """(length along the line, signed distance from it)."""
    return _let(_rated(pts, p), lambda r: F.struct(r["at"].alias("length"), F.when(r["side"] < 0, -r["d"]).otherwise(r["d"]).alias("distance")))


def from_arc(pts: Column, along: Column, side: Column) -> Column:
    """Point at arc coordinates; beyond the end along the last segment, before the start along the first. Null for fewer than two points."""
    s = segments(pts)
    state = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("struct<x: double, y: double>").alias("p"))
    n = F.size(s)

    def step(acc: Column, si: Column) -> Column:
        v = si["s"]
        l = distance(v["a"], v["b"])
        ux, uy = (v["b"]["x"] - v["a"]["x"]) / l, (v["b"]["y"] - v["a"]["y"]) / l
        rest = along - acc["run"]
        hit = (l > 0) & ((rest <= l) | (si["i"] == n - 1))
        got = F.when(hit, F.struct((v["a"]["x"] + ux * rest - uy * side).alias("x"), (v["a"]["y"] + uy * rest + ux * side).alias("y")))
        return F.struct((acc["run"] + l).alias("run"), F.coalesce(acc["p"], got).alias("p"))

    return F.aggregate(F.transform(s, lambda v, i: F.struct(v.alias("s"), i.alias("i"))), state, step)["p"]


def box(pts: Column) -> Column:
    """(xmin, ymin, xmax, ymax), null for no points."""
    x, y = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.when(F.size(pts) > 0, F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax")))


def box3d(pts: Column) -> Column:
    b, z = box(pts), F.transform(pts, lambda p: p["z"])
    return F.when(F.size(pts) > 0, F.struct(*[b[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.array_min(z).alias("zmin"), F.array_max(z).alias("zmax")))


def ring_area(pts: Column) -> Column:
    """Shoelace; positive for clockwise rings."""
    return -0.5 * total(F.transform(ring_segments(pts), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]))


def perimeter(pts: Column, z: bool = False) -> Column:
    return total(F.transform(ring_segments(pts), lambda s: distance(s["a"], s["b"], z)))


def centroid(pts: Column) -> Column:
    """Of the surface; of the points where the ring has none."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    a = total(F.transform(ring_segments(pts), cross)) / 2
    mean = lambda c: total(F.transform(pts, lambda p: p[c])) / F.size(pts)
    part = lambda c: total(F.transform(ring_segments(pts), lambda s: (s["a"][c] + s["b"][c]) * cross(s)))
    flat = F.abs(a) < 1e-12
    safe = F.when(flat, F.lit(1.0)).otherwise(a)
    return F.struct(*[F.when(flat, mean(c)).otherwise(part(c) / (6 * safe)).alias(c) for c in ("x", "y")])


def _crossed(pts: Column, p: Column) -> Column:
    """Whether a ray from p meets the ring an odd number of times."""
    hit = F.filter(ring_segments(pts), lambda v: ((v["a"]["y"] > p["y"]) != (v["b"]["y"] > p["y"])) & (p["x"] < (v["b"]["x"] - v["a"]["x"]) * (p["y"] - v["a"]["y"]) / F.when(v["b"]["y"] == v["a"]["y"], F.lit(1.0)).otherwise(v["b"]["y"] - v["a"]["y"]) + v["a"]["x"]))
    return F.size(hit) % 2 == 1


def inside(pts: Column, p: Column) -> Column:
    """Whether p lies in the ring or on its border."""
    return _crossed(pts, p) | F.exists(_feet(ring_segments(pts), p), lambda s: s["d"] < NEAR)


def lane_ring(left: Column, right: Column) -> Column:
    """Outline of a lane: its left bound, then its right bound backwards."""
    return F.concat(left, F.reverse(right))


def distance_to_ring(pts: Column, p: Column) -> Column:
    """From p to the filled ring: 0 inside."""
    border = F.array_min(F.transform(_feet(ring_segments(pts), p), lambda s: s["d"]))
    return F.when(F.size(pts) == 0, F.lit(float("inf"))).when(_crossed(pts, p), F.lit(0.0)).otherwise(border)


def approximate_length(left: Column) -> Column:
    """Sum of chords over every max(1, n / 10)-th point of the left bound, and its last."""
    n = F.size(left)
    step = F.greatest(F.floor(n / 10).cast("int"), F.lit(1))
    some = F.filter(left, lambda _, i: (i % step == 0) | (i == n - 1))
    return length(some)


def without_repeats(pts: Column) -> Column:
    """Of points equal in id that follow each other, the first."""
    return F.filter(pts, lambda p, i: (i == 0) | ~p["id"].eqNullSafe(F.try_element_at(pts, i)["id"]))


def has_repeats(pts: Column) -> Column:
    return F.exists(segments(pts), lambda s: s["a"]["id"] == s["b"]["id"])
