"""More synthetic maps from the driver's tables, each with its SQL: bent lines in space, crossing streets, a square beside a walkway, a highway, and a map with faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RoadMap
from .synth import road_map, table

TAGS = "map<string,string>"


def tags(*kv) -> F.Column:
    return F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv]).cast(TAGS)


def _ref(i: F.Column, inv: bool = False) -> F.Column:
    return F.struct(i.cast("long").alias("id"), F.lit(inv).alias("inv"))


# ---- bent lines: 3 to 20 points in space for each customer, on whole metres ------------------------------------


def bent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pts)."""
    c, i = F.col("id"), F.col("i")
    each = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select("id", F.explode(F.sequence(F.lit(0), (c % 18 + 2).cast("int"))).alias("i"))
    p = F.struct(i.alias("i"), (c * 32 + i).cast("long").alias("id"), (10 * i + (c * i) % 3).cast("double").alias("x"), ((c * 7 + i * i * 3) % 11).cast("double").alias("y"), ((c + i) % 5).cast("double").alias("z"))
    got = each.groupBy("id").agg(F.array_sort(F.collect_list(p)).alias("p"))
    return got.select("id", F.transform("p", lambda q: F.struct(q["id"].alias("id"), q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"))).alias("pts"))


BENT = """
WITH bp AS (
  SELECT c_custkey AS id, i::INT AS i, (10 * i + (c_custkey * i) % 3)::DOUBLE AS x, ((c_custkey * 7 + i * i * 3) % 11)::DOUBLE AS y, ((c_custkey + i) % 5)::DOUBLE AS z
  FROM customer, range(0, 20) AS r(i) WHERE i < c_custkey % 18 + 3),
bs AS (
  SELECT a.id, a.i, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz,
         sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2) AS l, sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2 + (b.z - a.z) ^ 2) AS l3
  FROM bp a JOIN bp b ON b.id = a.id AND b.i = a.i + 1),
br AS (SELECT *, sum(l) OVER (PARTITION BY id ORDER BY i) - l AS run, sum(l) OVER (PARTITION BY id) AS total FROM bs)
"""


# ---- L-shaped rings ---------------------------------------------------------------------------------------------


def corner_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ring, w, h): six corners, one of them turned inwards."""
    w, h = F.col("w"), F.col("h")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z"))
    z = F.lit(0)
    sized = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (2 + F.col("c_custkey") % 5).alias("w"), (2 + F.col("c_custkey") % 7).alias("h"))
    return sized.withColumn("ring", F.array(p(z, z), p(2 * w, z), p(2 * w, h), p(w, h), p(w, 2 * h), p(z, 2 * h)))


# ---- crossing streets: ten along x and ten along y in each town, some of them bridges --------------------------


def crossing_map(spark: SparkSession, sf_dir: str) -> RoadMap:
    s = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(s / 20).cast("long").alias("town"), (s % 20).cast("int").alias("k"))
    t = t.withColumn("flat", F.col("k") < 10).withColumn("lane", F.col("k") % 10).withColumn("z", F.when((F.col("k") >= 10) & (s % 3 == 0), 6.0).otherwise(0.0))
    # a lane's right bound has the lower points of a street along x, the greater of one along y: left is left
    each = t.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    across = F.col("lane") * 10 + F.when(F.col("flat"), 4 * (1 - F.col("side"))).otherwise(4 * F.col("side"))
    point = each.select((s * 6 + F.col("side") * 3 + F.col("j") + 1).cast("long").alias("id"), (1000 * F.col("town") + F.when(F.col("flat"), 50 * F.col("j")).otherwise(across)).cast("double").alias("x"), F.when(F.col("flat"), across).otherwise(50 * F.col("j")).cast("double").alias("y"), "z", tags().alias("attrs"))
    first = lambda side: s * 6 + side * 3 + 1
    lines = t.select(F.explode(F.array(*[F.struct((100_000 + 2 * s + side).alias("id"), F.array(*[(first(side) + j).cast("long") for j in range(3)]).alias("point_ids"))for side in (0, 1)])).alias("l")).select("l.id", "l.point_ids", tags("type", "line_thin", "subtype", "solid").alias("attrs"))
    lanes = t.select((s + 1).alias("id"), _ref(100_000 + 2 * s).alias("left"), _ref(100_001 + 2 * s).alias("right"), F.lit(None).cast("long").alias("centerline_id"), F.array().cast("array<bigint>").alias("regelem_ids"), tags("subtype", F.when(s % 5 == 0, "play_street").otherwise("road"), "location", "urban", "one_way", F.when(s % 4 == 0, "no").otherwise("yes")).alias("attrs"))
    return RoadMap.of(spark, points=point, linestrings=lines, lanelets=lanes)


# ---- squares in a row beside a walkway, and a place at its end -------------------------------------------------


def square_map(spark: SparkSession, sf_dir: str) -> RoadMap:
    """Square k of a town lies at x 10k..10k+10, y 0..10; the walkway runs along its upper side. The town's place lies across the walkway's end."""
    s = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(s / 20).cast("long").alias("town"), (s % 20).cast("long").alias("k"))
    last = t.groupBy("town").agg(F.max("k").alias("k"))
    ends = t.select("town", "k").union(last.select("town", F.col("k") + 1))
    # three rows of points: 0 at y 0, 1 at y 10, 2 at y 14
    pid = lambda town, k, row: (town * 100 + k * 3 + row + 1).cast("long")
    points = ends.select("town", "k", F.explode(F.array(*map(F.lit, range(3)))).alias("row")).select(pid(F.col("town"), F.col("k"), F.col("row")).alias("id"), (1000 * F.col("town") + 10 * F.col("k")).cast("double").alias("x"), F.when(F.col("row") == 0, 0.0).when(F.col("row") == 1, 10.0).otherwise(14.0).alias("y"), F.lit(0.0).alias("z"), tags().alias("attrs"))
    far = last.select(F.explode(F.array(F.struct(pid(F.col("town"), F.lit(30), F.lit(0)).alias("id"), (1000 * F.col("town") + 10 * F.col("k") + 30).cast("double").alias("x"), F.lit(10.0).alias("y")), F.struct(pid(F.col("town"), F.lit(30), F.lit(1)).alias("id"), (1000 * F.col("town") + 10 * F.col("k") + 30).cast("double").alias("x"), F.lit(14.0).alias("y")))).alias("p")).select("p.id", "p.x", "p.y", F.lit(0.0).alias("z"), tags().alias("attrs"))
    town, k = F.col("town"), F.col("k")
    lid = lambda kind, town, k: (10_000_000 * kind + town * 100 + k).cast("long")
    line = lambda df, kind, a, b, attrs: df.select(lid(kind, town, k).alias("id"), F.array(a, b).alias("point_ids"), attrs.alias("attrs"))
    up = line(ends, 1, pid(town, k, F.lit(0)), pid(town, k, F.lit(1)), tags("type", F.when(k % 3 == 0, "wall").otherwise("virtual")))
    top = line(t, 2, pid(town, k, F.lit(1)), pid(town, k + 1, F.lit(1)), tags("type", "curbstone", "subtype", F.when(k % 2 == 0, "low").otherwise("high")))
    bottom = line(t, 3, pid(town, k, F.lit(0)), pid(town, k + 1, F.lit(0)), tags("type", "wall"))
    outer = line(t, 4, pid(town, k, F.lit(2)), pid(town, k + 1, F.lit(2)), tags("type", "wall"))
    gate = line(last, 5, pid(town, k + 1, F.lit(1)), pid(town, k + 1, F.lit(2)), tags("type", "virtual"))
    wall = last.select(lid(6, town, k).alias("id"), F.array(pid(town, k + 1, F.lit(2)), pid(town, F.lit(30), F.lit(1)), pid(town, F.lit(30), F.lit(0)), pid(town, k + 1, F.lit(1))).alias("point_ids"), tags("type", "wall").alias("attrs"))
    lines = up.union(top).union(bottom).union(outer).union(gate).union(wall)
    none = F.array().cast("array<bigint>").alias("regelem_ids")
    lanes = t.select((s + 1).alias("id"), _ref(lid(4, town, k)).alias("left"), _ref(lid(2, town, k)).alias("right"), F.lit(None).cast("long").alias("centerline_id"), none, tags("subtype", "walkway").alias("attrs"))
    ring = F.array(_ref(lid(1, town, k)), _ref(lid(2, town, k)), _ref(lid(1, town, k + 1), True), _ref(lid(3, town, k), True))
    holes = F.array().cast("array<array<struct<id:bigint,inv:boolean>>>").alias("inner")
    areas = t.select((700_000 + s).alias("id"), ring.alias("outer"), holes, none, tags("subtype", "walkway").alias("attrs"))
    places = last.select((800_000 + town).alias("id"), F.array(_ref(lid(5, town, k)), _ref(lid(6, town, k))).alias("outer"), holes, none, tags("subtype", "walkway").alias("attrs"))
    return RoadMap.of(spark, points=points.union(far), linestrings=lines, lanelets=lanes, areas=areas.union(places))


# ---- a highway: the lanes of synth, all for cars and one way ---------------------------------------------------


def highway_map(spark: SparkSession, sf_dir: str) -> RoadMap:
    m = road_map(spark, sf_dir)
    return m.with_(lanelets=m.lanelets.withColumn("attrs", tags("subtype", "road", "location", "nonurban", "one_way", "yes")))


HIGHWAY = """
, hw AS (
  SELECT p + 1 AS id, p // 200 AS road, (p // 4) % 50 AS st, p % 4 AS lane, l.subtype AS lsub, r.subtype AS rsub,
         sqrt((l.x1 - l.x0) ^ 2 + (l.y1 - l.y0) ^ 2) AS len
  FROM synth_lane JOIN synth_line l ON l.id = left_id JOIN synth_line r ON r.id = right_id),
hw_step AS (
  SELECT a.id AS src, b.id AS dst, (a.len + b.len) / 2 AS cost, 1 AS relation FROM hw a JOIN hw b ON a.road = b.road AND a.lane = b.lane AND b.st = a.st + 1
  UNION ALL
  SELECT a.id, b.id, CASE WHEN a.lsub = 'dashed' THEN 10.0 ELSE 1.0 END, CASE WHEN a.lsub = 'dashed' THEN 2 ELSE 8 END FROM hw a JOIN hw b ON a.road = b.road AND b.lane = a.lane + 1 AND b.st = a.st
  UNION ALL
  SELECT a.id, b.id, CASE WHEN a.rsub IN ('dashed', 'dashed_solid') THEN 10.0 ELSE 1.0 END, CASE WHEN a.rsub IN ('dashed', 'dashed_solid') THEN 4 ELSE 16 END FROM hw a JOIN hw b ON a.road = b.road AND b.lane = a.lane - 1 AND b.st = a.st)
"""


# ---- a map with faults ------------------------------------------------------------------------------------------


def faulty_map(spark: SparkSession, sf_dir: str) -> RoadMap:
    """The map of synth with tags that aren't known or no yes or no, lines that repeat a point or bend too much, and points that lie on each other."""
    m = road_map(spark, sf_dir)
    p = F.col("id") - 1
    size = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("id"), "p_size")
    a = F.col("attrs")
    a = F.when(F.col("p_size") % 10 == 7, F.map_filter(a, lambda k, _: k != "subtype")).otherwise(a)
    a = F.when(p % 17 == 0, F.map_concat(F.map_filter(a, lambda k, _: k != "one_way"), tags("one_way", "maybe"))).otherwise(a)
    a = F.when(p % 19 == 0, F.map_concat(a, tags("mystery", "1"))).otherwise(a)
    a = F.when(p % 23 == 0, F.map_concat(F.map_filter(a, lambda k, _: k != "location"), tags("location", "mars"))).otherwise(a)
    lanes = m.lanelets.join(size, "id").withColumn("attrs", a).drop("p_size")
    i = F.col("id")
    first = F.try_element_at("point_ids", F.lit(1))
    extra = lambda n: (10_000_000 + 10 * i + n).cast("long")
    bent = F.concat(F.slice("point_ids", 1, 1), F.array(extra(1), extra(2), extra(3)), F.slice("point_ids", 2, 1))
    lines = m.linestrings.withColumn("point_ids", F.when(i % 31 == 0, bent).when(i % 29 == 0, F.concat(F.array(first), F.col("point_ids"))).otherwise(F.col("point_ids")))
    start = m.linestrings.where(i % 31 == 0).select("id", first.alias("p")).join(m.points.select(F.col("id").alias("p"), "x", "y"), "p")
    knots = start.select(F.explode(F.array(*[F.struct(extra(n).alias("id"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for n, dx, dy in ((1, 5.0, 0.0), (2, 5.5, 0.5), (3, 5.0, 1.0))])).alias("q")).select("q.*", F.lit(0.0).alias("z"), tags().alias("attrs"))
    twins = m.points.where(i % 37 == 0).select((i + 5_000_000).alias("id"), (F.col("x") + 0.03).alias("x"), "y", "z", "attrs")
    return m.with_(lanelets=lanes.select(*m.lanelets.columns), linestrings=lines, points=m.points.unionByName(knots).unionByName(twins))
