"""Axis-parallel boxes as (xmin, ymin, xmax, ymax) structs; the empty box is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(x0, y0, x1, y1) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), (x0, y0, x1, y1), strict=True)])


def intersects(a: Column, b: Column) -> Column:
    """Closed: boxes that touch do."""
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def contains(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmin"]) & (a["ymin"] <= b["ymin"]) & (a["xmax"] >= b["xmax"]) & (a["ymax"] >= b["ymax"])


def extend(a: Column, b: Column) -> Column:
    """The least box that holds both; null stands for nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(make(F.least(a["xmin"], b["xmin"]), F.least(a["ymin"], b["ymin"]), F.greatest(a["xmax"], b["xmax"]), F.greatest(a["ymax"], b["ymax"])))


def intersection(a: Column, b: Column) -> Column:
    """Null where they don't meet."""
    return F.when(intersects(a, b), make(F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"]), F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"])))


def translate(a: Column, dx, dy) -> Column:
    return make(a["xmin"] + dx, a["ymin"] + dy, a["xmax"] + dx, a["ymax"] + dy)


def grow(a: Column, by) -> Column:
    return make(a["xmin"] - by, a["ymin"] - by, a["xmax"] + by, a["ymax"] + by)


def centre(a: Column) -> Column:
    return F.struct(((a["xmin"] + a["xmax"]) / 2).alias("x"), ((a["ymin"] + a["ymax"]) / 2).alias("y"))


def volume(a: Column) -> Column:
    return (a["xmax"] - a["xmin"]) * (a["ymax"] - a["ymin"])


def exterior_distance(a: Column, p: Column) -> Column:
    """From a point to the box; 0 inside."""
    dx = F.greatest(a["xmin"] - p["x"], p["x"] - a["xmax"], F.lit(0.0))
    dy = F.greatest(a["ymin"] - p["y"], p["y"] - a["ymax"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def cells(a: Column, size: float) -> Column:
    """Grid cells that a box touches, as an array of (cx, cy)."""
    span = lambda lo, hi: F.sequence(F.floor(a[lo] / size), F.floor(a[hi] / size))
    return F.flatten(F.transform(span("xmin", "xmax"), lambda cx: F.transform(span("ymin", "ymax"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
