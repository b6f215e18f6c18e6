"""A road map made from the driver's tables by arithmetic on their keys, and the same in SQL for the oracle.

Part p is lane p % 4 at station (p / 4) % 50 of road p / 200. Lines run along x,
ten metres a station; roads are 100 m apart in y. Neighbouring lanes share a
border and successive ones its end points, so joins by id mean something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS, RoadMap, with_points

SUBTYPES = {0: "highway", 1: "walkway", 2: "bicycle_lane", 3: "bus_lane", 4: "play_street"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, road, station, b) of every line: five a station."""
    s = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 4).cast("long").alias("k")).distinct()
    s = s.select(F.floor(F.col("k") / 50).cast("long").alias("road"), (F.col("k") % 50).alias("station"))
    return s.select("road", "station", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("b")).select((1000000 + (F.col("road") * 50 + F.col("station")) * 5 + F.col("b")).alias("id"), "road", "station", "b")


def road_map(spark: SparkSession, sf_dir: str) -> RoadMap:
    part = table(spark, sf_dir, "part")
    lines = borders(spark, sf_dir)
    point = lambda j: (F.col("road") * 51 + j) * 5 + F.col("b") + 1
    inner = F.col("b").between(1, 3)
    sub = F.when(inner & ((F.col("b") + F.col("station")) % 3 == 0), "solid").when(inner & ((F.col("b") + F.col("station")) % 7 == 0), "dashed_solid").when(inner, "dashed").otherwise("solid")
    linestrings = lines.select("id", F.array(point(F.col("station")), point(F.col("station") + 1)).alias("point_ids"), F.create_map(F.lit("type"), F.lit("line_thin"), F.lit("subtype"), sub).alias("attrs"))
    ends = lines.select("road", F.explode(F.array("station", F.col("station") + 1)).alias("j"), "b").distinct()
    points = ends.select(point(F.col("j")).alias("id"), (10.0 * F.col("j")).alias("x"), (100.0 * F.col("road") + 3.5 * F.col("b") + 0.25 * (F.col("j") % 5)).alias("y"), F.lit(0.0).alias("z"), F.create_map().cast("map<string,string>").alias("attrs"))
    p = F.col("p_partkey")
    border = lambda d: 1000000 + F.floor(p / 4) * 5 + p % 4 + d
    ref = lambda i: F.struct(i.cast("long").alias("id"), F.lit(False).alias("inv"))
    kind = F.lit("road")
    for k, v in SUBTYPES.items():
        kind = F.when(F.col("p_size") % 10 == k, v).otherwise(kind)
    attrs = F.create_map(
        F.lit("subtype"), kind, F.lit("location"), F.when(F.col("p_size") % 2 == 0, "urban").otherwise("nonurban"), F.lit("one_way"), F.when(F.col("p_size") % 7 == 0, "no").otherwise("yes")
    )
    attrs = F.when(F.col("p_size") % 11 == 0, F.map_concat(attrs, F.create_map(F.lit("speed_limit"), F.concat((F.col("p_size") + 10).cast("string"), F.lit(" km/h"))))).otherwise(attrs)
    attrs = F.when(F.col("p_size") % 13 == 0, F.map_concat(attrs, F.create_map(F.lit("participant:vehicle"), F.lit("yes")))).otherwise(attrs)
    lanelets = part.select((p + 1).alias("id"), ref(border(1)).alias("left"), ref(border(0)).alias("right"), F.lit(None).cast("long").alias("centerline_id"), F.when(p % 5 == 0, F.array(5_000_000 + p % 10)).otherwise(F.array().cast("array<bigint>")).alias("regelem_ids"), attrs.alias("attrs"))
    supplier = table(spark, sf_dir, "supplier").where("s_suppkey < 10")
    regelems = supplier.select((5_000_000 + F.col("s_suppkey")).alias("id"), F.lit("speed_limit").alias("subtype"), F.create_map(F.lit("sign_type"), F.concat(F.lit("de274-"), (F.col("s_suppkey") % 5 * 10 + 30).cast("string")), F.lit("dynamic"), F.when(F.col("s_suppkey") % 3 == 0, "yes").otherwise("no")).alias("attrs"))
    params = regelems.where("false").select(F.col("id").alias("regelem_id"), F.lit("").alias("role"), F.lit(0).alias("pos"), F.lit("").alias("kind"), F.col("id").alias("ref_id"), F.lit(False).alias("inv"))
    empty = lambda n: spark.createDataFrame([], SCHEMAS[n])
    return RoadMap(points, linestrings, empty("polygons"), lanelets, empty("areas"), regelems, params)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving objects from events: object_id, x, y, yaw, ts."""
    roads = F.lit(max(1, table(spark, sf_dir, "part").count() // 200))
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("object_id"), (10.0 * (F.col("user_id") % 50) + F.floor(F.col("value") / 49)).alias("x"), (100.0 * (F.col("user_id") % roads) + F.col("event_id") % 14 + 0.125).alias("y"), F.lit(0.0).alias("yaw"), "ts")


def lines_with_points(m: RoadMap) -> DataFrame:
    return with_points(m.linestrings, m.points)


#: the same map as common table expressions
SQL = """
synth_station AS (SELECT DISTINCT p_partkey // 4 AS k FROM part),
synth_border AS (
  SELECT 1000000 + k * 5 + b AS id, k // 50 AS road, k % 50 AS station, b
  FROM synth_station, range(0, 5) AS r(b)),
synth_line AS (
  SELECT id, road, station, b,
         (road * 51 + station) * 5 + b + 1 AS p0, (road * 51 + station + 1) * 5 + b + 1 AS p1,
         10.0 * station AS x0, 100.0 * road + 3.5 * b + 0.25 * (station % 5) AS y0,
         10.0 * (station + 1) AS x1, 100.0 * road + 3.5 * b + 0.25 * ((station + 1) % 5) AS y1,
         CASE WHEN b BETWEEN 1 AND 3 AND (b + station) % 3 = 0 THEN 'solid'
              WHEN b BETWEEN 1 AND 3 AND (b + station) % 7 = 0 THEN 'dashed_solid'
              WHEN b BETWEEN 1 AND 3 THEN 'dashed' ELSE 'solid' END AS subtype
  FROM synth_border),
synth_lane AS (
  SELECT p_partkey + 1 AS id, 1000000 + (p_partkey // 4) * 5 + p_partkey % 4 + 1 AS left_id,
         1000000 + (p_partkey // 4) * 5 + p_partkey % 4 AS right_id, p_partkey AS p, p_size,
         CASE p_size % 10 WHEN 0 THEN 'highway' WHEN 1 THEN 'walkway' WHEN 2 THEN 'bicycle_lane'
              WHEN 3 THEN 'bus_lane' WHEN 4 THEN 'play_street' ELSE 'road' END AS subtype,
         CASE WHEN p_size % 2 = 0 THEN 'urban' ELSE 'nonurban' END AS location,
         p_size % 7 <> 0 AS one_way,
         CASE WHEN p_size % 11 = 0 THEN p_size + 10 END AS speed_tag,
         p_size % 13 = 0 AS for_vehicles,
         CASE WHEN p_partkey % 5 = 0 THEN 5000000 + p_partkey % 10 END AS regelem_id
  FROM part),
synth_passable AS (
  SELECT * FROM synth_lane WHERE CASE WHEN for_vehicles THEN true ELSE subtype IN ('road', 'highway', 'play_street') END),
synth_view AS (
  SELECT id, false AS inv, left_id AS lid, false AS linv, right_id AS rid, false AS rinv, * EXCLUDE (id) FROM synth_passable
  UNION ALL
  SELECT id, true AS inv, right_id AS lid, true AS linv, left_id AS rid, true AS rinv, * EXCLUDE (id) FROM synth_passable WHERE NOT one_way),
synth_end AS (
  SELECT v.*, CASE WHEN v.inv THEN l.p1 ELSE l.p0 END AS lf, CASE WHEN v.inv THEN l.p0 ELSE l.p1 END AS ll,
         CASE WHEN v.inv THEN r.p1 ELSE r.p0 END AS rf, CASE WHEN v.inv THEN r.p0 ELSE r.p1 END AS rl,
         sqrt((l.x1 - l.x0) * (l.x1 - l.x0) + (l.y1 - l.y0) * (l.y1 - l.y0)) AS len,
         l.subtype AS lsub, r.subtype AS rsub
  FROM synth_view v JOIN synth_line l ON l.id = v.lid JOIN synth_line r ON r.id = v.rid)
"""
