"""Primitives as text, for logs and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import attributes as A


def tags(attrs: Column) -> Column:
    """{key: value, ...} in the keys' order."""
    each = F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}"))


def point(p: Column, decimals: int = 3) -> Column:
    n = lambda c: A.plain_number(p[c], decimals)
    return F.concat(F.lit("point "), p["id"].cast("string"), F.lit(" ("), n("x"), F.lit(", "), n("y"), F.lit(", "), n("z"), F.lit(")"))


def _turned(inv: Column) -> Column:
    return F.when(inv, " turned").otherwise("")


def line(ref: Column, point_ids: Column) -> Column:
    """A line seen in a direction, with the ids of its points in that direction."""
    ids = F.when(ref["inv"], F.reverse(point_ids)).otherwise(point_ids)
    return F.concat(F.lit("line "), ref["id"].cast("string"), _turned(ref["inv"]), F.lit(" ["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]"))


def lane(i: Column, inv: Column, left: Column, right: Column) -> Column:
    return F.concat(F.lit("lane "), i.cast("string"), _turned(inv), F.lit(" (left "), left["id"].cast("string"), F.lit(", right "), right["id"].cast("string"), F.lit(")"))


def area(i: Column, outer: Column, inner: Column) -> Column:
    ring = lambda r: F.array_join(F.transform(r, lambda x: x["id"].cast("string")), ", ")
    holes = F.array_join(F.transform(inner, lambda r: F.concat(F.lit("["), ring(r), F.lit("]"))), ", ")
    return F.concat(F.lit("area "), i.cast("string"), F.lit(" ["), ring(outer), F.lit("]"), F.when(F.size(inner) > 0, F.concat(F.lit(" without "), holes)).otherwise(""))


def regelem(i: Column, subtype: Column, parameters: Column) -> Column:
    """parameters: array of (role, kind, ref_id)."""
    each = F.transform(parameters, lambda p: F.concat(p["role"], F.lit(": "), p["kind"], F.lit(" "), p["ref_id"].cast("string")))
    return F.concat(F.coalesce(subtype, F.lit("rule")), F.lit(" "), i.cast("string"), F.lit(" ("), F.array_join(each, ", "), F.lit(")"))
