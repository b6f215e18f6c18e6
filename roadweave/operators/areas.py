"""Areas: their rings, the borders that they share with lanes and with each other, and who may pass over those.

An area's outer ring is a list of directed lines, clockwise: each line has the
area on its right. So a lane's left bound backwards, or its right bound as it is,
may be a line of the ring of an area beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as GE
from ..functions import polylines as P
from ..model import RoadMap, along, flip, with_points
from . import rules as R
from .spatial import box_pairs

NO_LINES = "cast(array() as array<struct<id: bigint, inv: boolean>>)"


def passable(m: RoadMap, rules: R.Rules) -> DataFrame:
    """Areas that the participant may use."""
    return m.areas.where(R.can_pass_area(F.col("attrs"), rules))


def ring_lines(areas: DataFrame, lines: DataFrame) -> DataFrame:
    """(area_id, ring, pos, line, first, last, line_attrs, pts) of each line of each ring, in the area's direction; ring 0 is the outer one, holes follow. lines: with_points."""
    rings = areas.select(F.col("id").alias("area_id"), F.posexplode(F.concat(F.array(F.coalesce("outer", F.expr(NO_LINES))), F.coalesce("inner", F.array(F.expr(NO_LINES))))).alias("ring", "lines"))
    each = rings.select("area_id", "ring", F.posexplode("lines").alias("pos", "line"))
    l = lines.select(F.col("id").alias("_l"), F.col("pts").alias("_p"), F.col("attrs").alias("line_attrs"))
    got = each.join(l, F.col("line.id") == F.col("_l")).withColumn("pts", along(F.col("_p"), F.col("line.inv"))).drop("_l", "_p")
    end = lambda i: F.try_element_at("pts", F.lit(i))["id"]
    return got.withColumn("first", end(1)).withColumn("last", end(-1))


def with_rings(areas: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds outer_pts, and holes as an array of rings: points of the rings' lines in turn, of repeated ones the first; a ring's last point may be its first."""
    each = ring_lines(areas, lines).groupBy("area_id", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "pts"))).alias("l"))
    each = each.select("area_id", "ring", GE.joined(F.transform("l", lambda x: x["pts"])).alias("pts"))
    got = each.groupBy("area_id").agg(F.max(F.when(F.col("ring") == 0, F.col("pts"))).alias("outer_pts"), F.array_sort(F.collect_list(F.when(F.col("ring") > 0, F.struct("ring", "pts")))).alias("h"))
    return areas.join(got.select(F.col("area_id").alias("id"), "outer_pts", F.transform("h", lambda x: x["pts"]).alias("holes")), "id", "left")


def inside(outer: Column, holes: Column, p: Column) -> Column:
    """In the outer ring, borders included, and in no hole; a hole's border is the area's."""
    return P.inside(outer, p) & ~F.exists(holes, lambda h: P.inside(h, p) & ~F.exists(P._feet(P.ring_segments(h), p), lambda s: s["d"] < P.NEAR))


def distance(outer: Column, holes: Column, p: Column) -> Column:
    """From p to the area: 0 inside, to the hole's border in a hole."""
    out = P.distance_to_ring(outer, p)
    border = lambda h: F.array_min(F.transform(P._feet(P.ring_segments(h), p), lambda s: s["d"]))
    in_hole = F.array_max(F.transform(holes, lambda h: F.when(P._crossed(h, p), border(h)).otherwise(0.0)))
    return F.when(out > 0, out).otherwise(F.coalesce(in_hole, F.lit(0.0)))


# ---- shared borders ---------------------------------------------------------------------------------------------


def lane_borders(views: DataFrame, bounds: DataFrame) -> DataFrame:
    """(lane, area, side, line, line_attrs): where a lane's view meets an area's outer ring: on its left or right (the ring's line is the bound), at its end or start (the ring's line runs from one bound's end point to the other's).

    views: graph.vertices; bounds: ring_lines of areas.
    """
    b = bounds.where("ring = 0").select(F.col("area_id").alias("area"), "line", "first", "last", "line_attrs")
    v = views.select(F.struct("id", "inv").alias("lane"), "left", "right", "left_first", "left_last", "right_first", "right_last")
    out = ["lane", "area", "side", "line", "line_attrs"]
    left = v.withColumn("line", flip(F.col("left"))).join(b, "line").withColumn("side", F.lit("left")).select(out)
    right = v.withColumn("line", F.col("right")).join(b, "line").withColumn("side", F.lit("right")).select(out)
    end = v.join(b, (F.col("last") == F.col("left_last")) & (F.col("first") == F.col("right_last"))).withColumn("side", F.lit("end")).select(out)
    start = v.join(b, (F.col("last") == F.col("right_first")) & (F.col("first") == F.col("left_first"))).withColumn("side", F.lit("start")).select(out)
    return left.unionByName(right).unionByName(end).unionByName(start)


def common_line(views: DataFrame, bounds: DataFrame) -> DataFrame:
    """(lane, area, line, side): the first border of lane and area: before or behind it, then left, then right."""
    rank = F.when(F.col("side").isin("start", "end"), 0).when(F.col("side") == "left", 1).otherwise(2)
    return lane_borders(views, bounds).groupBy("lane", "area").agg(F.min_by(F.struct("line", "side"), F.struct(rank, "line")).alias("x")).select("lane", "area", "x.line", "x.side")


def area_borders(bounds: DataFrame) -> DataFrame:
    """(a, b, line, line_attrs): lines of a's outer ring that b's has backwards."""
    one = bounds.where("ring = 0").select(F.col("area_id").alias("a"), "line", "line_attrs", "pos")
    two = bounds.where("ring = 0").select(F.col("area_id").alias("b"), flip(F.col("line")).alias("line"))
    first = one.join(two, "line").where("a <> b").groupBy("a", "b").agg(F.min_by(F.struct("line", "line_attrs"), "pos").alias("x"))
    return first.select("a", "b", "x.line", "x.line_attrs")


def left_of(borders: DataFrame) -> DataFrame:
    """(lane, area): the area lies on the lane's left."""
    return borders.where("side = 'left'").select("lane", "area").distinct()


def right_of(borders: DataFrame) -> DataFrame:
    return borders.where("side = 'right'").select("lane", "area").distinct()


def following(views: DataFrame, bounds: DataFrame) -> DataFrame:
    """(lane, area): a line of the area's ring, in either direction, joins the end points of the lane's bounds."""
    b = bounds.where("ring = 0").select(F.col("area_id").alias("area"), F.least("first", "last").alias("p"), F.greatest("first", "last").alias("q"))
    v = views.select(F.struct("id", "inv").alias("lane"), F.least("left_last", "right_last").alias("p"), F.greatest("left_last", "right_last").alias("q"))
    return v.join(b, ["p", "q"]).select("lane", "area").distinct()


def adjacent(areas: DataFrame) -> DataFrame:
    """(a, b): areas whose outer rings share a segment, backwards, by its points. areas: with_rings."""
    side = areas.select("id", F.explode(P.ring_segments(F.col("outer_pts"))).alias("s")).select("id", F.col("s.a.id").alias("p"), F.col("s.b.id").alias("q")).where("p <> q")
    return side.select(F.col("id").alias("a"), "p", "q").join(side.select(F.col("id").alias("b"), F.col("q").alias("p"), F.col("p").alias("q")), ["p", "q"]).where("a <> b").select("a", "b").distinct()


# ---- who may pass ------------------------------------------------------------------------------------------------


def _first_side(borders: DataFrame, last: str) -> DataFrame:
    """Of each lane and area the border that decides: left, else right, else the one across the lane."""
    rank = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    some = borders.where(F.col("side").isin("left", "right", last))
    return some.groupBy("lane", "area").agg(F.min_by(F.struct("side", "line", "line_attrs"), F.struct(rank, "line")).alias("x")).select("lane", "area", "x.*")


def onto_areas(borders: DataFrame, rules: R.Rules) -> DataFrame:
    """(lane, area) where the border lets one leave the lane for the area. Lanes and areas must be passable; virtual borders let all through."""
    b = _first_side(borders, "end")
    # the ring's line runs against a left bound, along a right one, and across the end with the area on its right
    change = R.lane_change(F.col("line_attrs"), F.when(F.col("side") == "left", ~F.col("line.inv")).otherwise(F.col("line.inv")), rules.participant, True)
    return b.where(F.when(F.col("side") == "left", R.to_left(change)).otherwise(R.to_right(change))).select("lane", "area")


def off_areas(borders: DataFrame, rules: R.Rules) -> DataFrame:
    """(area, lane) where the border lets one leave the area for the lane."""
    b = _first_side(borders, "start")
    change = R.lane_change(F.col("line_attrs"), F.when(F.col("side") == "left", ~F.col("line.inv")).otherwise(F.col("line.inv")), rules.participant, True)
    return b.where(F.when(F.col("side") == "left", R.to_right(change)).otherwise(R.to_left(change))).select("area", "lane")


def between_areas(bounds: DataFrame, rules: R.Rules) -> DataFrame:
    """(a, b): from one area to the next over the line that they share."""
    b = area_borders(bounds)
    return b.where(R.to_left(R.lane_change(F.col("line_attrs"), F.col("line.inv"), rules.participant, True))).select("a", "b")


def overlapping(rings: DataFrame, others: DataFrame, cell: float = 25.0) -> DataFrame:
    """(a, b) of rings and other rings (id, ring) whose interiors meet."""
    a = rings.select(F.col("id").alias("a"), F.col("ring").alias("ra"), P.box(F.col("ring")).alias("abox"))
    b = others.select(F.col("id").alias("b"), F.col("ring").alias("rb"), P.box(F.col("ring")).alias("bbox"))
    return box_pairs(a, b, cell).where(GE.rings_overlap("ra", "rb")).select("a", "b")


def edges(m: RoadMap, views: DataFrame, rules: R.Rules, cell: float = 25.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(src, dst) over which areas are entered, crossed and left; (src, dst) of overlaps where nobody passes; (id, perimeter, mps) of the passable areas. Vertices are (id, inv); an area has one direction."""
    lines = with_points(m.linestrings, m.points)
    some = passable(m, rules)
    bounds = ring_lines(some, lines)
    at = lambda c: F.struct(F.col(c).alias("id"), F.lit(False).alias("inv"))
    borders = lane_borders(views, bounds)
    on, off, over = onto_areas(borders, rules), off_areas(borders, rules), between_areas(bounds, rules)
    passes = on.select(F.col("lane").alias("src"), at("area").alias("dst")).unionByName(off.select(at("area").alias("src"), F.col("lane").alias("dst"))).unionByName(over.select(at("a").alias("src"), at("b").alias("dst")))

    shaped = with_rings(some, lines)
    ring = shaped.select("id", F.col("outer_pts").alias("ring"))
    lane_ring = views.where("not inv").select("id", P.lane_ring(F.col("left_pts"), F.col("right_pts")).alias("ring"))
    lane_area = overlapping(lane_ring, ring, cell)
    free = on.select(F.col("lane.id").alias("a"), F.col("area").alias("b")).unionByName(off.select(F.col("lane.id").alias("a"), F.col("area").alias("b"))).distinct()
    clash = lane_area.join(free, ["a", "b"], "left_anti").select(at("a").alias("src"), at("b").alias("dst"))
    # the edge runs from the other area to this one where this one can't be left for it
    area_area = overlapping(ring, ring, cell).where("a <> b").join(over, ["a", "b"], "left_anti").select(at("b").alias("src"), at("a").alias("dst"))
    sized = shaped.select("id", P.perimeter(F.col("outer_pts")).alias("length"), R.speed_limit(F.col("attrs"), rules)["mps"].alias("mps"))
    return passes.distinct(), clash.unionByName(area_area).distinct(), sized
