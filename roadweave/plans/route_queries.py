"""Queries over the graph of a highway: long paths, runs of lane changes, routes; and matches, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import with_bounds, with_points
from ..operators import graph as G
from ..operators import matching as M
from ..operators import routes as RT
from ..operators import search as S
from . import shapes_synth as Y
from . import synth
from .queries import _OBJECTS, _RING, CAR, DRIVE, code, lanes, match, query, r6


def highway(spark: SparkSession, sf: str, *costs: G.Cost) -> G.Graph:
    return G.build(Y.highway_map(spark, sf), CAR, costs or (G.Cost("distance", 10.0),), conflicts=False)


def v(i: Column) -> Column:
    return F.struct(i.cast("long").alias("id"), F.lit(False).alias("inv"))


def ahead(spark: SparkSession, sf: str, stations: int, shift: int, most: int) -> DataFrame:
    """(query, v, target): from every lane of a road's first `most` stations to the lane `shift` to its left (in the round of four), so many stations on."""
    p = F.col("p_partkey")
    lane = p % 4
    part = synth.table(spark, sf, "part").where((F.floor(p / 4) % 50 < most) & (p + 4 * stations < F.lit(synth.table(spark, sf, "part").count())))
    return part.select((p + 1).alias("query"), v(p + 1).alias("v"), v(p - lane + (lane + shift) % 4 + 4 * stations + 1).alias("target"))


_WAYS = (
    Y.HIGHWAY
    + """
, n_part AS (SELECT count(*) AS n FROM part),
req AS (SELECT id AS query, id AS v, id - lane + (lane + {shift}) % 4 + 4 * {stations} AS target, road, st FROM hw, n_part WHERE st < {most} AND id - 1 + 4 * {stations} < n),
way(query, v, cost) USING KEY (query, v) AS (
  SELECT query, v, 0.0::DOUBLE FROM req
  UNION
  SELECT query, v, min(cost) FROM (
    SELECT w.query, e.dst AS v, w.cost + e.cost AS cost FROM way w JOIN hw_step e ON e.src = w.v AND e.relation IN (1, 2, 4) JOIN hw t ON t.id = e.dst JOIN req q ON q.query = w.query AND t.st <= q.st + {stations}
    LEFT JOIN recurring.way k ON k.query = w.query AND k.v = e.dst WHERE k.cost IS NULL OR w.cost + e.cost < k.cost - 1e-9) GROUP BY query, v)"""
)


@query(
    _WAYS.format(stations=40, shift=2, most=10)
    + """, along AS (SELECT q.query, sum(s.cost) AS a FROM req q JOIN hw_step s ON s.relation = 1 JOIN hw f ON f.id = s.src AND f.lane = 0 AND f.road = q.road AND f.st >= q.st AND f.st < q.st + 40 GROUP BY q.query)
SELECT q.query, round(w.cost, 4) AS cost, (41 + round((w.cost - a) / 10))::INT AS n FROM req q JOIN way w ON w.query = q.query AND w.v = q.target JOIN along a ON a.query = q.query"""
)
def shortest_path_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Forty stations on, to another lane: costs, and how many lanes the path has."""
    q = ahead(spark, sf, 40, 2, 10)
    return S.shortest_paths(highway(spark, sf).view(DRIVE), q).select("query", F.round("cost", 4).alias("cost"), F.size("path").alias("n"))


@query(
    _WAYS.format(stations=12, shift=1, most=2)
    + """, along AS (SELECT q.query, sum(s.cost) AS a FROM req q JOIN hw_step s ON s.relation = 1 JOIN hw f ON f.id = s.src AND f.lane = 0 AND f.road = q.road AND f.st >= q.st AND f.st < q.st + 12 GROUP BY q.query)
SELECT q.query, round(w.cost, 4) AS cost, (13 + round((w.cost - a) / 10))::INT AS n FROM req q JOIN way w ON w.query = q.query AND w.v = q.target JOIN along a ON a.query = q.query"""
)
def shortest_paths_by_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Paths by islands of the graph, the way for graphs of any size."""
    q = ahead(spark, sf, 12, 1, 2)
    edges = G.checkpointed(spark, highway(spark, sf).view(DRIVE))
    near = F.col("src.id") <= (F.floor((F.col("src.id") - 1) / 200) * 200 + 60)  # the first stations of each road: the searches have no end otherwise
    return S.parted_paths(edges.where(near), q).select("query", F.round("cost", 4).alias("cost"), F.size("path").alias("n"))


@query(
    _WAYS.format(stations=6, shift=1, most=4)
    + """, via AS (SELECT q.query, w.cost AS c1, q.target FROM req q JOIN way w ON w.query = q.query AND w.v = q.target),
leg AS (SELECT v.query, v.c1, s.cost AS c2 FROM via v JOIN hw_step s ON s.src = v.target AND s.relation = 1)
SELECT query, round(c1 + c2, 4) AS cost FROM leg"""
)
def shortest_paths_via(spark: SparkSession, sf: str) -> DataFrame:
    """By a stop six stations on to the lane behind it."""
    q = ahead(spark, sf, 6, 1, 4)
    q = q.select("query", F.array("v", "target", v(F.col("target.id") + 4)).alias("stops"))
    return S.shortest_paths_via(highway(spark, sf).view(DRIVE), q).select("query", F.round("cost", 4).alias("cost"))


@query(
    Y.HIGHWAY
    + """
, ch AS (SELECT src, dst, relation, h.road, h.st, h.lane, h.len FROM hw_step JOIN hw h ON h.id = src WHERE relation IN (2, 4)),
isl AS (SELECT *, st - row_number() OVER (PARTITION BY road, lane, relation ORDER BY st) AS g FROM ch),
suf AS (SELECT *, sum(len) OVER (PARTITION BY road, lane, relation, g ORDER BY st ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM isl)
SELECT src * 2 AS src, dst * 2 AS dst, CASE WHEN rest >= 15 THEN relation ELSE relation * 4 END AS relation, (CASE WHEN rest >= 15 THEN 10.0 ELSE 1.0 END)::DOUBLE AS cost FROM suf"""
)
def lane_change_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Lane changes where at least 15 m of borders that allow them lie ahead; where less does, lanes are only beside each other."""
    g = highway(spark, sf, G.Cost("distance", 10.0, 15.0))
    side = g.edges.where(F.col("relation") != G.SUCCESSOR)
    may = G.beside(G.vertices(Y.highway_map(spark, sf), CAR)).where("allowed").select("src", "dst")
    return side.join(may, ["src", "dst"], "left_semi").select(code("src").alias("src"), code("dst").alias("dst"), F.col("relation").cast("int").alias("relation"), "cost")


def routes(spark: SparkSession, sf: str) -> tuple[G.Graph, RT.Routes]:
    g = highway(spark, sf)
    return g, RT.build(g, ahead(spark, sf, 10, 1, 1))


_ROUTE = (
    _WAYS.format(stations=10, shift=1, most=1)
    + """
, fwd(query, v) USING KEY (query, v) AS (SELECT query, v FROM req UNION SELECT f.query, e.dst FROM fwd f JOIN hw_step e ON e.src = f.v AND e.relation IN (1, 2, 4) JOIN hw t ON t.id = e.dst JOIN req q ON q.query = f.query AND t.st <= q.st + 10),
bwd(query, v) USING KEY (query, v) AS (SELECT query, target FROM req UNION SELECT b.query, e.src FROM bwd b JOIN hw_step e ON e.dst = b.v AND e.relation IN (1, 2, 4) JOIN hw t ON t.id = e.src JOIN req q ON q.query = b.query AND t.st >= q.st),
rt AS (SELECT f.query, f.v, h.road, h.lane, h.st FROM fwd f JOIN bwd b ON b.query = f.query AND b.v = f.v JOIN hw h ON h.id = f.v WHERE EXISTS (SELECT 1 FROM way w JOIN req q ON q.query = w.query AND q.target = w.v WHERE w.query = f.query)),
isl AS (SELECT *, st - row_number() OVER (PARTITION BY query, lane ORDER BY st) AS g FROM rt)
"""
)


@query(_ROUTE + "SELECT query, v, (st - min(st) OVER (PARTITION BY query, lane, g))::INT AS pos FROM isl")
def route_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """All lanes of the routes ten stations on, and their places in their lane."""
    _, r = routes(spark, sf)
    return r.lanes.select("query", F.col("v.id").alias("v"), "pos")


@query(_ROUTE + "SELECT query, count(DISTINCT (lane, g)) AS lanes, count(*) AS size FROM isl GROUP BY query")
def route_sizes(spark: SparkSession, sf: str) -> DataFrame:
    _, r = routes(spark, sf)
    return RT.lane_counts(r)


@query(_ROUTE + "SELECT a.query, a.v, count(*) AS n, max(b.v) AS last FROM isl a JOIN isl b ON b.query = a.query AND b.lane = a.lane AND b.g = a.g AND b.st >= a.st GROUP BY a.query, a.v")
def route_remaining_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of its lane from every element of a route on."""
    _, r = routes(spark, sf)
    got = RT.remaining_lane(r, r.lanes.select("query", "v"))
    return got.select("query", F.col("v.id").alias("v"), F.size("lane").cast("long").alias("n"), F.try_element_at("lane", F.lit(-1))["id"].alias("last"))


@query(_ROUTE + "SELECT a.query, a.v * 2 AS v, e.dst * 2 AS other, e.relation FROM rt a JOIN hw_step e ON e.src = a.v JOIN rt b ON b.query = a.query AND b.v = e.dst")
def route_relations(spark: SparkSession, sf: str) -> DataFrame:
    """What follows and what is beside every element, within its route."""
    _, r = routes(spark, sf)
    return RT.relations(r, 127).select("query", code("v").alias("v"), code("other").alias("other"), F.col("relation").cast("int").alias("relation"))


@query(_ROUTE + "SELECT count(*) AS n FROM rt WHERE false")
def route_problems(spark: SparkSession, sf: str) -> DataFrame:
    """A route's own check finds nothing on routes made here."""
    _, r = routes(spark, sf)
    return RT.problems(r).agg(F.count("*").alias("n"))


@query(Y.HIGHWAY + ", l AS (SELECT a.id, count(*) AS n FROM hw a JOIN hw b ON b.road = a.road AND b.st = a.st AND b.lane > a.lane GROUP BY a.id) SELECT h.id, coalesce(l.n, 0) AS lefts, 3 - coalesce(l.n, 0) AS rights FROM hw h LEFT JOIN l ON l.id = h.id")
def lanes_beside(spark: SparkSession, sf: str) -> DataFrame:
    """How many lanes lie to the left and to the right of each, by a change or not."""
    g = highway(spark, sf)
    b = G.besides(g, mask=G.LEFT | G.RIGHT | G.ADJACENT_LEFT | G.ADJACENT_RIGHT)
    return b.groupBy(F.col("v.id").alias("id")).agg(F.count(F.when(F.col("place") < 0, 1)).alias("lefts"), F.count(F.when(F.col("place") > 0, 1)).alias("rights"))


# ---- matches ----------------------------------------------------------------------------------------------------

_NEAR = f""", ring AS ({_RING}), edge AS (
  SELECT id, ax AS px, ay AS py, bx AS qx, b_y AS qy FROM ring UNION ALL SELECT id, bx, b_y, cx, cy FROM ring
  UNION ALL SELECT id, cx, cy, dx, dy FROM ring UNION ALL SELECT id, dx, dy, ax, ay FROM ring),
cand AS (
  SELECT o.object_id, e.*, o.x, o.y, least(1, greatest(0, ((o.x - px) * (qx - px) + (o.y - py) * (qy - py)) / ((qx - px) ^ 2 + (qy - py) ^ 2))) AS t
  FROM obj o JOIN edge e ON floor((e.id - 1) / 200) = floor(o.y / 100) AND abs(floor((e.id - 1) / 4) % 50 * 10 + 5 - o.x) <= 12),
side AS (
  SELECT object_id, id, min(sqrt((px + (qx - px) * t - x) ^ 2 + (py + (qy - py) * t - y) ^ 2)) AS border,
         bool_and((qx - px) * (y - py) - (qy - py) * (x - px) <= 0) AS within FROM cand GROUP BY object_id, id),
hit AS (SELECT object_id, id, round(CASE WHEN within THEN 0 ELSE border END, 6) AS distance FROM side WHERE within OR border <= 0.5)"""


@query(_OBJECTS + _NEAR + " SELECT h.object_id, h.id AS lane_id, v.inv, h.distance FROM hit h JOIN synth_view v ON v.id = h.id")
def lawful_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matches in directions that a car may drive; lanes it may never use are left out before the search."""
    m = synth.road_map(spark, sf)
    allowed = G.checkpointed(spark, G.passable(m, CAR).select("id", "inv"))
    shapes = M.only(M.lane_shapes(lanes(spark, sf)), allowed)
    return M.compliant(M.deterministic(synth.objects(spark, sf), shapes, 0.5), allowed).select("object_id", "lane_id", "inv", r6(F.col("distance")).alias("distance"))


@query(
    _OBJECTS
    + _NEAR
    + f""", mid AS (SELECT id, (ax + dx) / 2 AS mx, (ay + dy) / 2 AS my, (bx + cx) / 2 AS nx, (b_y + cy) / 2 AS ny FROM ({_RING})),
f AS (SELECT h.object_id, h.id, o.x, o.y, m.*, least(1, greatest(0, ((o.x - mx) * (nx - mx) + (o.y - my) * (ny - my)) / ((nx - mx) ^ 2 + (ny - my) ^ 2))) AS t FROM hit h JOIN obj o ON o.object_id = h.object_id JOIN mid m ON m.id = h.id)
SELECT object_id, id AS lane_id, inv, round((2 * CASE WHEN inv THEN pi() - abs(atan2(ny - my, nx - mx)) ELSE abs(atan2(ny - my, nx - mx)) END) ^ 2 + (x - mx - (nx - mx) * t) ^ 2 / 0.5 + (y - my - (ny - my) * t) ^ 2 / 0.25, 4) AS mahalanobis
FROM f, (VALUES (false), (true)) AS d(inv)"""
)
def likely_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Squared Mahalanobis distances of objects to the lanes near them, in both directions."""
    one = lambda x: F.lit(float(x))
    o = synth.objects(spark, sf).withColumn("cov", F.struct(one(0.5).alias("xx"), one(0).alias("xy"), one(0).alias("yx"), one(0.25).alias("yy"))).withColumn("kappa", one(2))
    return M.probabilistic(o, M.lane_shapes(lanes(spark, sf)), 0.5).select("object_id", "lane_id", "inv", F.round("mahalanobis", 4).alias("mahalanobis"))
