"""Who uses a primitive: equi-joins from references back to their owners. A reference to a line has a direction, and only owners that look at it in that direction use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RoadMap, directed, flip

OWNER = ["kind", "owner_id", "inv"]


def _owner(df: DataFrame, kind: str, inv: Column | None = None) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col("id").alias("owner_id"), (F.lit(False) if inv is None else inv).alias("inv"), "ref")


def line_owners(m: RoadMap) -> DataFrame:
    """(kind, owner_id, inv, ref): each lane in both directions, each area and each rule that names a line, and the line as it names it."""
    lanes = directed(m.lanelets).select("id", "inv", F.explode(F.array("left", "right")).alias("ref"))
    rings = m.areas.select("id", F.explode(F.flatten(F.concat(F.array("outer"), F.coalesce("inner", F.expr("array()"))))).alias("ref"))
    rules = m.regelem_params.where("kind = 'linestring'").select(F.col("regelem_id").alias("id"), F.struct(F.col("ref_id").alias("id"), F.coalesce("inv", F.lit(False)).alias("inv")).alias("ref"))
    out = lanes.select(F.lit("lanelet").alias("kind"), F.col("id").alias("owner_id"), "inv", "ref")
    return out.unionByName(_owner(rings, "area")).unionByName(_owner(rules, "regelem"))


def of_lines(m: RoadMap, lines: DataFrame) -> DataFrame:
    """(ref, kind, owner_id, inv) of lines (column ref: id, inv): owners that have the line in that direction."""
    return lines.select("ref").distinct().join(line_owners(m), "ref").select("ref", *OWNER).distinct()


def of_points(m: RoadMap, points: DataFrame) -> DataFrame:
    """(point_id, kind, owner_id) of points (column id): lines, polygons and rules that hold them."""
    asked = points.select(F.col("id").alias("point_id")).distinct()
    parts = [
        m.linestrings.select(F.lit("linestring").alias("kind"), F.col("id").alias("owner_id"), F.explode("point_ids").alias("point_id")),
        m.polygons.select(F.lit("polygon").alias("kind"), F.col("id").alias("owner_id"), F.explode("point_ids").alias("point_id")),
        m.regelem_params.where("kind = 'point'").select(F.lit("regelem").alias("kind"), F.col("regelem_id").alias("owner_id"), F.col("ref_id").alias("point_id")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return asked.join(every, "point_id").distinct()


def of_regelems(m: RoadMap) -> DataFrame:
    """(regelem_id, kind, owner_id): lanes and areas that name a rule."""
    lanes = m.lanelets.select(F.lit("lanelet").alias("kind"), F.col("id").alias("owner_id"), F.explode("regelem_ids").alias("regelem_id"))
    return lanes.unionByName(m.areas.select(F.lit("area").alias("kind"), F.col("id").alias("owner_id"), F.explode("regelem_ids").alias("regelem_id"))).distinct()


def lanes_with_points(m: RoadMap, points: DataFrame) -> DataFrame:
    """(point_id, lane_id): lanes one of whose bounds, in whatever direction, holds a point; each once."""
    return _with_points(m, points, m.lanelets.select(F.col("id").alias("lane_id"), F.explode(F.array("left.id", "right.id")).alias("id")))


def areas_with_points(m: RoadMap, points: DataFrame) -> DataFrame:
    """(point_id, area_id): areas one of whose rings holds a point; each once."""
    rings = m.areas.select(F.col("id").alias("area_id"), F.explode(F.flatten(F.concat(F.array("outer"), F.coalesce("inner", F.expr("array()"))))).alias("ref"))
    return _with_points(m, points, rings.select("area_id", F.col("ref.id").alias("id")))


def _with_points(m: RoadMap, points: DataFrame, owners: DataFrame) -> DataFrame:
    name = owners.columns[0]
    held = m.linestrings.select("id", F.explode("point_ids").alias("point_id")).join(points.select(F.col("id").alias("point_id")).distinct(), "point_id")
    return held.join(owners, "id").select("point_id", name).distinct()


def holds(point_ids: Column, i: Column | int) -> Column:
    """Whether a line (or polygon) has a point."""
    return F.array_contains(point_ids, i)


def lanes_that_hold(m: RoadMap, lines: DataFrame) -> DataFrame:
    """Lanes of which one of some lines (column id) is a bound or the centre line."""
    own = m.lanelets.select(F.col("id").alias("lane_id"), F.explode(F.array("left.id", "right.id", "centerline_id")).alias("id"))
    return m.lanelets.join(own.join(lines.select("id"), "id", "left_semi").select(F.col("lane_id").alias("id")).distinct(), "id", "left_semi")


def regelems_that_hold(m: RoadMap, primitives: DataFrame) -> DataFrame:
    """Rules one of whose parameters is among some primitives (kind, id)."""
    asked = primitives.select("kind", F.col("id").alias("ref_id"))
    return m.regelems.join(m.regelem_params.join(asked, ["kind", "ref_id"], "left_semi").select(F.col("regelem_id").alias("id")).distinct(), "id", "left_semi")


# ---- borders that two lanes share -------------------------------------------------------------------------------


def common_lines(a: DataFrame, b: DataFrame, *, either_way: bool = False) -> DataFrame:
    """(a, b, line, side): the border that lane views a and b (id, inv, left, right) share: b lies to the left of a or to its right. either_way also looks at b driven backwards, after both."""
    one = a.select(F.struct("id", "inv").alias("a"), F.col("left").alias("l"), F.col("right").alias("r"))
    two = b.select(F.struct("id", "inv").alias("b"), F.col("left").alias("l"), F.col("right").alias("r"))
    ways = [("left", F.col("l"), F.col("r"), 0), ("right", F.col("r"), F.col("l"), 1)]
    if either_way:  # turned around, b's left bound is its right one flipped
        ways += [("left", F.col("l"), flip(F.col("l")), 2), ("right", F.col("r"), flip(F.col("r")), 3)]
    out = None
    for side, mine, theirs, rank in ways:
        got = one.select("a", mine.alias("line")).join(two.select("b", theirs.alias("line")), "line").where("a <> b").select("a", "b", "line", F.lit(side).alias("side"), F.lit(rank).alias("rank"))
        out = got if out is None else out.unionByName(got)
    first = out.groupBy("a", "b").agg(F.min_by(F.struct("line", "side"), "rank").alias("x"))
    return first.select("a", "b", "x.line", "x.side")
