"""Registered queries: operators over the synthetic map, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import boxes as B
from ..functions import polylines as P
from ..functions.flat import line_distance
from ..model import directed, with_bounds
from ..operators import graph as G
from ..operators import matching as M
from ..operators import rules as R
from ..operators import search as S
from ..operators import spatial as SP
from ..operators import usages as U
from ..operators import validation as V
from . import synth

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CAR = R.Rules(R.VEHICLE)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH RECURSIVE {synth.SQL.strip()}{sql}" if sql.lstrip().startswith(",") or sql.lstrip().startswith("SELECT") else sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return synth.lines_with_points(synth.road_map(spark, sf))


def lanes(spark: SparkSession, sf: str) -> DataFrame:
    m = synth.road_map(spark, sf)
    return with_bounds(m.lanelets, synth.lines_with_points(m))


def car_views(spark: SparkSession, sf: str) -> DataFrame:
    return G.vertices(synth.road_map(spark, sf), CAR)


def car_graph(spark: SparkSession, sf: str, **options) -> G.Graph:
    return G.build(synth.road_map(spark, sf), CAR, **options)


# ---- layers, lookups, boxes -------------------------------------------------------------------------------------


@query("SELECT 'points' AS layer, count(*) AS n FROM (SELECT p0 FROM synth_line UNION SELECT p1 FROM synth_line) UNION ALL SELECT 'linestrings', count(*) FROM synth_line UNION ALL SELECT 'lanelets', count(*) FROM synth_lane")
def layer_sizes(spark: SparkSession, sf: str) -> DataFrame:
    m = synth.road_map(spark, sf)
    out = None
    for n in ("points", "linestrings", "lanelets"):
        one = getattr(m, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("layer"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT id, subtype, location, one_way FROM synth_lane WHERE id = 42")
def lookup_by_id(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("attrs")
    return SP.lookup(synth.road_map(spark, sf).lanelets, 42).select("id", a["subtype"].alias("subtype"), a["location"].alias("location"), A.as_bool(a["one_way"]).alias("one_way"))


@query("SELECT id, x0 AS xmin, least(y0, y1) AS ymin, x1 AS xmax, greatest(y0, y1) AS ymax FROM synth_line")
def line_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("id", P.box(F.col("pts")).alias("b")).select("id", "b.*")


@query("SELECT id FROM synth_line WHERE x0 <= 60 AND x1 >= 25 AND least(y0, y1) <= 9 AND greatest(y0, y1) >= 3")
def box_search(spark: SparkSession, sf: str) -> DataFrame:
    return SP.search(lines(spark, sf).withColumn("box", P.box(F.col("pts"))), B.make(25, 3, 60, 9)).select("id")


@query("SELECT id FROM synth_line WHERE x0 <= 60 AND x1 >= 25 AND least(y0, y1) <= 9 AND greatest(y0, y1) >= 3 AND subtype = 'dashed' ORDER BY id LIMIT 1")
def box_search_until(spark: SparkSession, sf: str) -> DataFrame:
    return SP.search_until(lines(spark, sf).withColumn("box", P.box(F.col("pts"))), B.make(25, 3, 60, 9), F.col("attrs")["subtype"] == "dashed").select("id")


_BOX_D = "sqrt(greatest(x0 - 33.0, 33.0 - x1, 0) ^ 2 + greatest(least(y0, y1) - 5.0, 5.0 - greatest(y0, y1), 0) ^ 2)"


@query(f"SELECT id, round({_BOX_D}, 6) AS distance FROM synth_line ORDER BY {_BOX_D}, id LIMIT 7")
def nearest_by_box(spark: SparkSession, sf: str) -> DataFrame:
    p = F.struct(F.lit(33.0).alias("x"), F.lit(5.0).alias("y"))
    return SP.nearest(lines(spark, sf).withColumn("box", P.box(F.col("pts"))), p, 7).select("id", r6(F.col("distance")).alias("distance"))


@query(f"SELECT id FROM synth_line WHERE subtype = 'dashed_solid' ORDER BY {_BOX_D}, id LIMIT 1")
def nearest_until(spark: SparkSession, sf: str) -> DataFrame:
    p = F.struct(F.lit(33.0).alias("x"), F.lit(5.0).alias("y"))
    return SP.nearest_until(lines(spark, sf).withColumn("box", P.box(F.col("pts"))), p, F.col("attrs")["subtype"] == "dashed_solid").select("id")


@query("SELECT id, subtype, coalesce(cast(speed_tag AS VARCHAR) || ' km/h', 'none') AS speed, speed_tag IS NOT NULL AS has_speed FROM synth_lane")
def attribute_access(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("attrs")
    return synth.road_map(spark, sf).lanelets.select("id", a["subtype"].alias("subtype"), A.attribute_or(a, "speed_limit", "none").alias("speed"), F.map_contains_key(a, "speed_limit").alias("has_speed"))


# ---- joins ------------------------------------------------------------------------------------------------------


@query(", p AS (SELECT id, p0 AS point_id, 0 AS pos, x0 AS x, y0 AS y FROM synth_line UNION ALL SELECT id, p1, 1, x1, y1 FROM synth_line) SELECT id, pos, point_id, x, y FROM p")
def points_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("id", F.posexplode("pts").alias("pos", "p")).select("id", "pos", F.col("p.id").alias("point_id"), "p.x", "p.y")


@query("SELECT l.id AS line_id, v.id AS lane_id, v.inv FROM synth_line l JOIN (SELECT id, false AS inv, left_id AS k, false AS ki FROM synth_lane UNION ALL SELECT id, false, right_id, false FROM synth_lane UNION ALL SELECT id, true, right_id, true FROM synth_lane UNION ALL SELECT id, true, left_id, true FROM synth_lane) v ON v.k = l.id AND NOT v.ki")
def line_usages(spark: SparkSession, sf: str) -> DataFrame:
    """Lanes, in either direction, that have a line as a bound in the line's own direction."""
    m = synth.road_map(spark, sf)
    asked = m.linestrings.select(F.struct("id", F.lit(False).alias("inv")).alias("ref"))
    return U.of_lines(m, asked).where("kind = 'lanelet'").select(F.col("ref.id").alias("line_id"), F.col("owner_id").alias("lane_id"), "inv")


@query("SELECT DISTINCT q.point_id, v.id AS lane_id FROM (SELECT id, p0 AS point_id FROM synth_line UNION ALL SELECT id, p1 FROM synth_line) q JOIN synth_lane v ON q.id = v.left_id OR q.id = v.right_id")
def point_usages(spark: SparkSession, sf: str) -> DataFrame:
    m = synth.road_map(spark, sf)
    return U.lanes_with_points(m, m.points)


@query("SELECT regelem_id, count(*) AS n, min(id) AS first_lane FROM synth_lane WHERE regelem_id IS NOT NULL GROUP BY regelem_id")
def regelem_usages(spark: SparkSession, sf: str) -> DataFrame:
    return U.of_regelems(synth.road_map(spark, sf)).groupBy("regelem_id").agg(F.count("*").alias("n"), F.min("owner_id").alias("first_lane"))


@query("SELECT a.id AS src, a.inv AS src_inv, b.id AS dst, b.inv AS dst_inv FROM synth_end a JOIN synth_end b ON a.ll = b.lf AND a.rl = b.rf")
def follows(spark: SparkSession, sf: str) -> DataFrame:
    f = G.following(car_views(spark, sf))
    return f.select(F.col("src.id").alias("src"), F.col("src.inv").alias("src_inv"), F.col("dst.id").alias("dst"), F.col("dst.inv").alias("dst_inv"))


_BESIDE = """
, synth_beside AS (
  SELECT a.id, a.inv, b.id AS bid, b.inv AS binv, 'left' AS side, a.len,
         CASE WHEN a.linv THEN a.lsub IN ('dashed', 'dashed_solid') ELSE a.lsub = 'dashed' END AS allowed
  FROM synth_end a JOIN synth_end b ON a.lid = b.rid AND a.linv = b.rinv
  UNION ALL
  SELECT a.id, a.inv, b.id, b.inv, 'right', a.len,
         CASE WHEN a.rinv THEN a.rsub = 'dashed' ELSE a.rsub IN ('dashed', 'dashed_solid') END
  FROM synth_end a JOIN synth_end b ON a.rid = b.lid AND a.rinv = b.linv)"""


@query(_BESIDE + " SELECT id AS src, inv AS src_inv, bid AS dst, binv AS dst_inv, side, allowed FROM synth_beside")
def left_and_right_of(spark: SparkSession, sf: str) -> DataFrame:
    b = G.beside(car_views(spark, sf))
    return b.select(F.col("src.id").alias("src"), F.col("src.inv").alias("src_inv"), F.col("dst.id").alias("dst"), F.col("dst.inv").alias("dst_inv"), "side", "allowed")


# ---- rules ------------------------------------------------------------------------------------------------------


def _who(participant: str, users: str, back: str) -> str:
    override = "for_vehicles" if participant == "vehicle" else "false"
    return f"SELECT id, inv, CASE WHEN inv AND {back} THEN false WHEN for_vehicles THEN {override} ELSE subtype IN ({users}) END AS passable, one_way FROM synth_lane, (VALUES (false), (true)) AS d(inv)"


def _passable(participant: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rules = R.create("de", participant)
        a = F.col("attrs")
        return directed(synth.road_map(spark, sf).lanelets).select("id", "inv", R.can_pass_lane(a, F.col("inv"), rules).alias("passable"), R.is_one_way(a, rules).alias("one_way"))

    run.__name__ = f"passable_{participant}"
    return run


query(_who("vehicle", "'road', 'highway', 'play_street'", "one_way"))(_passable("vehicle"))
query(_who("pedestrian", "'play_street', 'walkway'", "one_way"))(_passable("pedestrian"))
query(_who("bicycle", "'road', 'bicycle_lane', 'play_street'", "one_way"))(_passable("bicycle"))

_SPEED = "CASE WHEN speed_tag IS NOT NULL THEN speed_tag WHEN subtype = 'highway' THEN 130 WHEN subtype = 'play_street' THEN 7 WHEN subtype IN ('road', 'bus_lane') THEN CASE location WHEN 'urban' THEN 50 ELSE 100 END ELSE 0 END"


@query(f"SELECT id, round(({_SPEED}) / 3.6, 6) AS mps, NOT (speed_tag IS NULL AND subtype = 'highway') AS mandatory FROM synth_lane")
def speed_limits(spark: SparkSession, sf: str) -> DataFrame:
    s = R.speed_limit(F.col("attrs"), CAR)
    return synth.road_map(spark, sf).lanelets.select("id", r6(s["mps"]).alias("mps"), s["mandatory"].alias("mandatory"))


@query(f"SELECT id, round(CASE WHEN regelem_id IS NOT NULL THEN (regelem_id - 5000000) % 5 * 10 + 30 ELSE {_SPEED} END / 3.6, 6) AS mps FROM synth_lane LEFT JOIN supplier s ON s.s_suppkey < 10 AND s.s_suppkey + 5000000 = regelem_id")
def speed_limits_by_sign(spark: SparkSession, sf: str) -> DataFrame:
    m = synth.road_map(spark, sf)
    signs = m.regelems.where("subtype = 'speed_limit'").select(F.col("id").alias("_r"), F.col("attrs")["sign_type"].alias("sign"))
    first = m.lanelets.select("id", F.posexplode("regelem_ids").alias("pos", "_r")).join(signs, "_r").groupBy("id").agg(F.min_by("sign", "pos").alias("sign"))
    return m.lanelets.join(first, "id", "left").select("id", r6(R.speed_limit(F.col("attrs"), CAR, F.col("sign"))["mps"]).alias("mps"))


@query("SELECT id, CASE subtype WHEN 'dashed' THEN 3 WHEN 'dashed_solid' THEN 2 ELSE 0 END AS forward, CASE subtype WHEN 'dashed' THEN 3 WHEN 'dashed_solid' THEN 1 ELSE 0 END AS backward FROM synth_line")
def lane_change_types(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("attrs")
    return synth.road_map(spark, sf).linestrings.select("id", R.lane_change(a, F.lit(False), R.VEHICLE).alias("forward"), R.lane_change(a, F.lit(True), R.VEHICLE).alias("backward"))


@query(_BESIDE + " SELECT id, inv, bid AS other, side FROM synth_beside WHERE allowed")
def may_change_lane(spark: SparkSession, sf: str) -> DataFrame:
    return G.beside(car_views(spark, sf)).where("allowed").select(F.col("src.id").alias("id"), F.col("src.inv").alias("inv"), F.col("dst.id").alias("other"), "side")


@query("SELECT l.id FROM synth_lane l JOIN supplier s ON s.s_suppkey + 5000000 = l.regelem_id WHERE s.s_suppkey < 10 AND s.s_suppkey % 3 = 0")
def dynamic_rules(spark: SparkSession, sf: str) -> DataFrame:
    m = synth.road_map(spark, sf)
    return R.has_dynamic_rules(m.lanelets, m.regelems).select("id")


# ---- geometry ---------------------------------------------------------------------------------------------------

_MID = "SELECT id, round(x0 + (x1 - x0) * 4.0 / len, 6) AS x, round(y0 + (y1 - y0) * 4.0 / len, 6) AS y, round(x1 + (x0 - x1) * 1.5 / len, 6) AS bx, round(y1 + (y0 - y1) * 1.5 / len, 6) AS by FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM synth_line)"


@query("SELECT id, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) AS length, 1.0 AS last_ratio FROM synth_line")
def line_lengths(spark: SparkSession, sf: str) -> DataFrame:
    pts = F.col("pts")
    return lines(spark, sf).select("id", r6(P.length(pts)).alias("length"), F.try_element_at(P.accumulated_length_ratios(pts), F.lit(-1)).alias("last_ratio"))


@query(_MID)
def interpolated_points(spark: SparkSession, sf: str) -> DataFrame:
    a, b = P.interpolate(F.col("pts"), F.lit(4.0)), P.interpolate(F.col("pts"), F.lit(-1.5))
    return lines(spark, sf).select("id", r6(a["x"]).alias("x"), r6(a["y"]).alias("y"), r6(b["x"]).alias("bx"), r6(b["y"]).alias("by"))


@query("SELECT id, round(((x0 + 3 - x0) * (x1 - x0) + (y0 + 2 - y0) * (y1 - y0)) / len, 6) AS along, round(((x1 - x0) * 2 - (y1 - y0) * 3) / len, 6) AS side FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM synth_line)")
def arc_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    first = F.try_element_at(F.col("pts"), F.lit(1))
    arc = P.to_arc(F.col("pts"), F.struct((first["x"] + 3).alias("x"), (first["y"] + 2).alias("y"), F.lit(0.0).alias("z")))
    return lines(spark, sf).select("id", r6(arc["length"]).alias("along"), r6(arc["distance"]).alias("side"))


@query("SELECT id, round(x0 + ux * 12 - uy * 2, 6) AS x, round(y0 + uy * 12 + ux * 2, 6) AS y FROM (SELECT *, (x1 - x0) / len AS ux, (y1 - y0) / len AS uy FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM synth_line))")
def points_from_arc(spark: SparkSession, sf: str) -> DataFrame:
    p = P.from_arc(F.col("pts"), F.lit(12.0), F.lit(2.0))
    return lines(spark, sf).select("id", r6(p["x"]).alias("x"), r6(p["y"]).alias("y"))


_RING = "SELECT v.id, l.x0 AS ax, l.y0 AS ay, l.x1 AS bx, l.y1 AS b_y, r.x1 AS cx, r.y1 AS cy, r.x0 AS dx, r.y0 AS dy FROM synth_lane v JOIN synth_line l ON l.id = v.left_id JOIN synth_line r ON r.id = v.right_id"
_SHOE = "(ax * b_y - bx * ay + bx * cy - cx * b_y + cx * dy - dx * cy + dx * ay - ax * dy)"


@query(f"SELECT id, round(-0.5 * {_SHOE}, 6) AS area, round(sqrt((bx - ax) ^ 2 + (b_y - ay) ^ 2) + sqrt((cx - bx) ^ 2 + (cy - b_y) ^ 2) + sqrt((dx - cx) ^ 2 + (dy - cy) ^ 2) + sqrt((ax - dx) ^ 2 + (ay - dy) ^ 2), 6) AS perimeter, round(((ax + bx) * (ax * b_y - bx * ay) + (bx + cx) * (bx * cy - cx * b_y) + (cx + dx) * (cx * dy - dx * cy) + (dx + ax) * (dx * ay - ax * dy)) / (3 * {_SHOE}), 5) AS x FROM ({_RING})")
def lane_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    ring = P.lane_ring(F.col("left_pts"), F.col("right_pts"))
    return lanes(spark, sf).select("id", r6(P.ring_area(ring)).alias("area"), r6(P.perimeter(ring)).alias("perimeter"), F.round(P.centroid(ring)["x"], 5).alias("x"))


@query("SELECT id, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) AS length FROM (SELECT v.id, l.x0, l.y0, l.x1, l.y1 FROM synth_lane v JOIN synth_line l ON l.id = v.left_id)")
def lane_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return lanes(spark, sf).select("id", r6(P.approximate_length(F.col("left_pts"))).alias("length"))


@query(", bent AS (SELECT a.left_id AS l, a.id, x.x0 AS ax, x.y0 AS ay, x.x1 AS bx, x.y1 AS b_y, y.x1 AS cx, y.y1 AS cy FROM synth_lane a JOIN synth_line x ON x.id = a.left_id JOIN synth_line y ON y.p0 = x.p1) SELECT id, round(2 * abs((bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax)) / (sqrt((bx - ax) ^ 2 + (b_y - ay) ^ 2) * sqrt((cx - bx) ^ 2 + (cy - b_y) ^ 2) * sqrt((ax - cx) ^ 2 + (ay - cy) ^ 2)), 6) AS curvature FROM bent")
def curvature_at_joints(spark: SparkSession, sf: str) -> DataFrame:
    line = lines(spark, sf).select("id", "pts")
    nxt = line.select(F.try_element_at("pts", F.lit(1))["id"].alias("k"), F.try_element_at("pts", F.lit(2)).alias("c"))
    a, b = F.try_element_at("pts", F.lit(1)), F.try_element_at("pts", F.lit(2))
    bent = line.withColumn("k", b["id"]).join(nxt, "k").select("id", r6(P.curvature(a, b, F.col("c"))).alias("curvature"))
    return synth.road_map(spark, sf).lanelets.select(F.col("id").alias("lane"), F.col("left.id").alias("id")).join(bent, "id").select(F.col("lane").alias("id"), "curvature")


# ---- spatial joins and matching ---------------------------------------------------------------------------------

_OBJECTS = """
, obj AS (
  SELECT event_id AS object_id, 10.0 * (user_id % 50) + floor(value / 49) AS x,
         100.0 * (user_id % (SELECT greatest(1, count(*) // 200) FROM part)) + event_id % 14 + 0.125 AS y FROM events)"""
_SEG = "CASE WHEN t < 0 THEN 0 WHEN t > 1 THEN 1 ELSE t END"


def _line_distance() -> str:
    return """
, near AS (
  SELECT o.object_id, l.id, o.x, o.y, l.x0, l.y0, l.x1, l.y1,
         ((o.x - l.x0) * (l.x1 - l.x0) + (o.y - l.y0) * (l.y1 - l.y0)) / ((l.x1 - l.x0) ^ 2 + (l.y1 - l.y0) ^ 2) AS t
  FROM obj o JOIN synth_line l ON l.road = floor(o.y / 100) AND abs(l.x0 + 5 - o.x) <= 40),
dist AS (
  SELECT object_id, id, sqrt((x0 + (x1 - x0) * least(1, greatest(0, t)) - x) ^ 2 + (y0 + (y1 - y0) * least(1, greatest(0, t)) - y) ^ 2) AS d FROM near)"""


def objects(spark: SparkSession, sf: str) -> DataFrame:
    return synth.objects(spark, sf).withColumn("abox", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")))


@query(_OBJECTS + _line_distance() + " SELECT object_id, id, round(d, 6) AS distance FROM dist WHERE d <= 3")
def lines_within(spark: SparkSession, sf: str) -> DataFrame:
    """Range join of all objects and lines."""
    s = lines(spark, sf).select("id", "pts", P.box(F.col("pts")).alias("bbox"))
    d = line_distance("pts", "x", "y")
    return SP.within(objects(spark, sf), s, 3.0, d, 10.0).select("object_id", "id", r6(F.col("distance")).alias("distance"))


@query(_OBJECTS + _line_distance() + " SELECT object_id, id, n FROM (SELECT object_id, id, row_number() OVER (PARTITION BY object_id ORDER BY round(d, 9), id) AS n FROM dist) WHERE n <= 3")
def nearest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Three nearest lines of every object, by exact distance."""
    s = lines(spark, sf).select("id", "pts", P.box(F.col("pts")).alias("bbox"))
    d = F.round(line_distance("pts", "x", "y"), 9)
    return SP.knn(objects(spark, sf), s, 3, d, key="object_id", other="id", cell=10.0).select("object_id", "id", F.col("rank").alias("n"))


def match(spark: SparkSession, sf: str, radius: float = 0.5) -> DataFrame:
    return M.deterministic(synth.objects(spark, sf), M.lane_shapes(lanes(spark, sf)), radius)


@query(_OBJECTS + f""", ring AS ({_RING}), edge AS (
  SELECT id, ax AS px, ay AS py, bx AS qx, b_y AS qy FROM ring UNION ALL SELECT id, bx, b_y, cx, cy FROM ring
  UNION ALL SELECT id, cx, cy, dx, dy FROM ring UNION ALL SELECT id, dx, dy, ax, ay FROM ring),
cand AS (
  SELECT o.object_id, e.*, o.x, o.y, least(1, greatest(0, ((o.x - px) * (qx - px) + (o.y - py) * (qy - py)) / ((qx - px) ^ 2 + (qy - py) ^ 2))) AS t
  FROM obj o JOIN edge e ON e.id // 200 <= 1000000 AND floor((e.id - 1) / 200) = floor(o.y / 100) AND abs(floor((e.id - 1) / 4) % 50 * 10 + 5 - o.x) <= 12),
side AS (
  SELECT object_id, id, min(sqrt((px + (qx - px) * t - x) ^ 2 + (py + (qy - py) * t - y) ^ 2)) AS border,
         bool_and((qx - px) * (y - py) - (qy - py) * (x - px) <= 0) AS within FROM cand GROUP BY object_id, id)
SELECT object_id, id AS lane_id, inv, round(CASE WHEN within THEN 0 ELSE border END, 6) AS distance
FROM side, (VALUES (false), (true)) AS d(inv) WHERE within OR border <= 0.5""")
def matched_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return match(spark, sf).select("object_id", "lane_id", "inv", r6(F.col("distance")).alias("distance"))


# ---- graph ------------------------------------------------------------------------------------------------------

_EDGES = (
    _BESIDE
    + """
, synth_edge AS (
  SELECT a.id * 2 + a.inv::INT AS src, b.id * 2 + b.inv::INT AS dst, (a.len + b.len) / 2 AS cost, 1 AS relation
  FROM synth_end a JOIN synth_end b ON a.ll = b.lf AND a.rl = b.rf
  UNION ALL
  SELECT id * 2 + inv::INT, bid * 2 + binv::INT, CASE WHEN allowed THEN 10.0 ELSE 1.0 END,
         CASE WHEN allowed AND side = 'left' THEN 2 WHEN allowed THEN 4 WHEN side = 'left' THEN 8 ELSE 16 END FROM synth_beside)"""
)
DRIVE = G.SUCCESSOR | G.LEFT | G.RIGHT


def code(v: str) -> Column:
    return F.col(f"{v}.id") * 2 + F.col(f"{v}.inv").cast("int")


@query(_EDGES + " SELECT src, dst, round(cost, 6) AS cost, relation FROM synth_edge")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the car graph by distance, conflicts aside."""
    g = car_graph(spark, sf, costs=(G.Cost("distance", 10.0),), conflicts=False)
    return g.edges.select(code("src").alias("src"), code("dst").alias("dst"), r6(F.col("cost")).alias("cost"), F.col("relation").cast("int").alias("relation"))


@query("SELECT id * 2 AS src, id * 2 + 1 AS dst FROM synth_view WHERE inv UNION ALL SELECT id * 2 + 1, id * 2 FROM synth_view WHERE inv")
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring and successive lanes only touch, so what conflicts is a two-way lane with itself."""
    g = car_graph(spark, sf, costs=(G.Cost("distance", 10.0),))
    return g.view(G.CONFLICTING).select(code("src").alias("src"), code("dst").alias("dst"))


@query(_EDGES + " SELECT relation, count(*) AS n, round(sum(cost), 3) AS cost FROM synth_edge GROUP BY relation")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = car_graph(spark, sf, costs=(G.Cost("distance", 10.0),), conflicts=False)
    return g.edges.groupBy(F.col("relation").cast("int").alias("relation")).agg(F.count("*").alias("n"), F.round(F.sum("cost"), 3).alias("cost"))


def starts(spark: SparkSession, sf: str, every: int) -> DataFrame:
    v = car_views(spark, sf).where(~F.col("inv")).where((F.col("id") - 1) % every == 0)
    return v.select(F.col("id").alias("query"), F.struct("id", "inv").alias("v"))


_REACH = """
, drive AS (SELECT src, dst, cost FROM synth_edge WHERE relation IN (1, 2, 4)),
reach(query, v, cost) USING KEY (query, v) AS (
  SELECT id, id * 2, 0.0::DOUBLE FROM synth_view WHERE NOT inv AND (id - 1) % {every} = 0
  UNION
  SELECT query, v, min(cost) FROM (
    SELECT r.query, e.dst AS v, r.cost + e.cost AS cost FROM reach r JOIN drive e ON e.src = r.v
    LEFT JOIN recurring.reach k ON k.query = r.query AND k.v = e.dst
    WHERE r.cost + e.cost <= {most} AND (k.cost IS NULL OR r.cost + e.cost < k.cost - 1e-9)) GROUP BY query, v)"""


@query(_EDGES + _REACH.format(every=40, most=60) + " SELECT query, v, round(cost, 5) AS cost FROM reach")
def reachable_sets(spark: SparkSession, sf: str) -> DataFrame:
    g = car_graph(spark, sf, costs=(G.Cost("distance", 10.0),), conflicts=False)
    return S.reachable(g.view(DRIVE), starts(spark, sf, 40), 60.0).select("query", code("v").alias("v"), F.round("cost", 5).alias("cost"))


@query(_EDGES + _REACH.format(every=40, most=60) + " SELECT query, v, round(cost, 5) AS cost FROM reach")
def reachable_sets_by_joins(spark: SparkSession, sf: str) -> DataFrame:
    """The same by islands of the graph, the way for graphs of any size."""
    g = car_graph(spark, sf, costs=(G.Cost("distance", 10.0),), conflicts=False)
    edges = G.checkpointed(spark, g.view(DRIVE))
    return S.parted_trees(edges, starts(spark, sf, 40), max_cost=60.0).select("query", code("v").alias("v"), F.round("cost", 5).alias("cost"))


@query()
def possible_paths(spark: SparkSession, sf: str) -> DataFrame:
    g = car_graph(spark, sf, costs=(G.Cost("distance", 10.0),), conflicts=False)
    p = S.possible_paths(g.view(DRIVE), starts(spark, sf, 80), min_cost=45.0)
    return p.select("query", F.round("cost", 5).alias("cost"), F.size("path").alias("n"), F.transform("path", lambda v: v["id"] * 2 + v["inv"].cast("int")).alias("path"))


# ---- validation -------------------------------------------------------------------------------------------------


@query("SELECT id, 'lacks subtype' AS message FROM synth_lane WHERE p_size % 10 = 7")
def missing_tags(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the lanes without their subtype."""
    m = synth.road_map(spark, sf)
    cut = F.when((F.col("subtype_key") == 7), A.drop_attributes(F.col("attrs"), "subtype")).otherwise(F.col("attrs"))
    part = synth.table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("id"), (F.col("p_size") % 10).alias("subtype_key"))
    lost = m.with_(lanelets=m.lanelets.join(part, "id").withColumn("attrs", cut).drop("subtype_key"))
    return V.validate(lost, checks="mapping.mandatory_tags").select("id", "message")


from . import route_queries, shape_queries  # noqa: E402, F401  they add theirs
