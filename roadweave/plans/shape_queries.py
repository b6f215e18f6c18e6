"""Queries over bent lines, crossing streets, squares and a faulty map, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as GE
from ..functions import polylines as P
from ..model import directed, with_bounds, with_points
from ..operators import areas as AR
from ..operators import graph as G
from ..operators import rules as R
from ..operators import search as S
from ..operators import spatial as SP
from ..operators import usages as U
from ..operators import validation as V
from . import shapes_synth as Y
from .queries import _EDGES, CAR, car_graph, code, lanes, lines, query, r6

bent = Y.bent_lines


def _xyz(x: float, y: float, z: float = 0.0) -> F.Column:
    return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))


# ---- bent lines -------------------------------------------------------------------------------------------------


@query(Y.BENT + "SELECT id, round(sum(l), 6) AS length, round(sum(l3), 6) AS length_3d, round(sum(l) FILTER (WHERE i < 2), 6) AS first_two, round(max(CASE WHEN i = 0 THEN l / total END), 6) AS first_share, round(max(CASE WHEN i = 1 THEN (run + l) / total END), 6) AS second_upto FROM br GROUP BY id")
def bent_lengths(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda c, i: F.try_element_at(c, F.lit(i))
    return bent(spark, sf).select("id", r6(P.length(F.col("pts"))).alias("length"), r6(P.length(F.col("pts"), z=True)).alias("length_3d"), r6(P.ranged_length(F.col("pts"), 0, 3)).alias("first_two"), r6(at(P.length_ratios(F.col("pts")), 1)).alias("first_share"), r6(at(P.accumulated_length_ratios(F.col("pts")), 2)).alias("second_upto"))


@query(
    Y.BENT
    + """, f AS (SELECT id, max(CASE WHEN run <= 17 AND 17 < run + l THEN ax + (bx - ax) * (17 - run) / l END) AS x, max(CASE WHEN run <= 17 AND 17 < run + l THEN ay + (b_y - ay) * (17 - run) / l END) AS y,
    max(CASE WHEN run < total - 9 AND total - 9 <= run + l THEN bx + (ax - bx) * (9 - (total - run - l)) / l END) AS back_x, max(CASE WHEN run < total - 9 AND total - 9 <= run + l THEN b_y + (ay - b_y) * (9 - (total - run - l)) / l END) AS back_y,
    max_by(bx, i) AS end_x, max_by(b_y, i) AS end_y FROM br GROUP BY id)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(back_x, 6) AS back_x, round(back_y, 6) AS back_y, end_x, end_y FROM f"""
)
def bent_interpolated(spark: SparkSession, sf: str) -> DataFrame:
    """Points 17 m from the start, 9 m from the end, and beyond the end."""
    a, b, e = P.interpolate(F.col("pts"), F.lit(17.0)), P.interpolate(F.col("pts"), F.lit(-9.0)), P.interpolate(F.col("pts"), F.lit(9000.0))
    got = bent(spark, sf).select("id", a.alias("a"), b.alias("b"), e.alias("e"))
    return got.select("id", r6(F.col("a.x")).alias("x"), r6(F.col("a.y")).alias("y"), r6(F.col("b.x")).alias("back_x"), r6(F.col("b.y")).alias("back_y"), F.col("e.x").alias("end_x"), F.col("e.y").alias("end_y"))


@query(Y.BENT + ", v AS (SELECT id, i, ax AS x, ay AS y, run AS r FROM br UNION ALL SELECT id, i + 1, bx, b_y, run + l FROM br WHERE i = (SELECT max(b.i) FROM bs b WHERE b.id = br.id)) SELECT id, min_by(x, (round(abs(r - 17), 9), i)) AS x, min_by(y, (round(abs(r - 17), 9), i)) AS y FROM v GROUP BY id")
def bent_nearest_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """The vertex nearest to 17 m along each line."""
    return bent(spark, sf).select("id", P.nearest_vertex(F.col("pts"), F.lit(17.0)).alias("p")).select("id", "p.x", "p.y")


_FOOT = """
, ft AS (SELECT br.*, q.n AS n, q.x AS qx, q.y AS qy, greatest(0, least(1, ((q.x - ax) * (bx - ax) + (q.y - ay) * (b_y - ay)) / (l * l))) AS t FROM br, (VALUES (0, 25.5, 4.25), (1, 7.25, -3.5), (2, 61.0, 12.75)) AS q(n, x, y)),
fd AS (SELECT *, ax + (bx - ax) * t AS fx, ay + (b_y - ay) * t AS fy, sqrt((ax + (bx - ax) * t - qx) ^ 2 + (ay + (b_y - ay) * t - qy) ^ 2) AS d FROM ft),
fm AS (SELECT *, row_number() OVER (PARTITION BY id, n ORDER BY round(d, 7), i) AS k FROM fd)
"""


@query(Y.BENT + _FOOT + "SELECT id, n, round(fx, 5) AS x, round(fy, 5) AS y, round(run + t * l, 5) AS along, round(d, 5) AS distance FROM fm WHERE k = 1")
def bent_projections(spark: SparkSession, sf: str) -> DataFrame:
    """Feet, arc lengths and distances of three points on every line."""
    at = F.array(*[F.struct(F.lit(n).alias("n"), _xyz(x, y).alias("p")) for n, x, y in ((0, 25.5, 4.25), (1, 7.25, -3.5), (2, 61.0, 12.75))])
    got = bent(spark, sf).select("id", "pts", F.explode(at).alias("q")).select("id", "q.n", P.project(F.col("pts"), F.col("q.p")).alias("f"), P.to_arc(F.col("pts"), F.col("q.p")).alias("arc"))
    r5 = lambda c: F.round(F.col(c), 5)
    return got.select("id", "n", r5("f.x").alias("x"), r5("f.y").alias("y"), r5("arc.length").alias("along"), F.round(F.abs("arc.distance"), 5).alias("distance"))


@query(Y.BENT + _FOOT + "SELECT id, list(n ORDER BY round(run + t * l, 7), n)[1]::INT AS first, list(n ORDER BY round(run + t * l, 7), n)[3]::INT AS last FROM fm WHERE k = 1 GROUP BY id")
def bent_sorted_points(spark: SparkSession, sf: str) -> DataFrame:
    """Three points in their order along every line."""
    pts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("x"), F.lit(y).alias("y")) for n, x, y in ((0, 25.5, 4.25), (1, 7.25, -3.5), (2, 61.0, 12.75))])
    got = bent(spark, sf).select("id", GE.sorted_along(F.col("pts"), pts).alias("s"))
    return got.select("id", F.try_element_at("s", F.lit(1))["n"].alias("first"), F.try_element_at("s", F.lit(3))["n"].alias("last"))


@query(
    Y.BENT
    + """, tri AS (SELECT a.id, a.i, 2 * abs((a.bx - a.ax) * (b.b_y - a.ay) - (a.b_y - a.ay) * (b.bx - a.ax)) / (a.l * b.l * sqrt((b.bx - a.ax) ^ 2 + (b.b_y - a.ay) ^ 2)) AS k FROM bs a JOIN bs b ON b.id = a.id AND b.i = a.i + 1)
SELECT id, count(*) AS n, round(max(k), 6) AS most FROM tri GROUP BY id"""
)
def bent_curvatures(spark: SparkSession, sf: str) -> DataFrame:
    k = P.curvatures(F.col("pts"))
    return bent(spark, sf).select("id", F.size(k).cast("long").alias("n"), r6(F.array_max(k)).alias("most"))


@query(Y.BENT + "SELECT id, min(x) AS xmin, min(y) AS ymin, min(z) AS zmin, max(x) AS xmax, max(y) AS ymax, max(z) AS zmax FROM bp GROUP BY id")
def bent_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return bent(spark, sf).select("id", P.box3d(F.col("pts")).alias("b")).select("id", "b.*")


@query(Y.BENT + "SELECT a.id, a.x + b.x AS sx, a.z + b.z AS sz, b.x - a.x AS dx, 2.5 * a.y AS scaled, b.x / 4 AS part, a.x * b.x + a.y * b.y + a.z * b.z AS dot, a.x = b.x AND a.y = b.y AND a.z = b.z AS same FROM bp a JOIN bp b ON b.id = a.id AND a.i = 0 AND b.i = 2")
def bent_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Arithmetic on the first and the third point."""
    p, q = F.col("p"), F.col("q")
    got = bent(spark, sf).select("id", F.try_element_at(F.col("pts"), F.lit(1)).alias("p"), F.try_element_at(F.col("pts"), F.lit(3)).alias("q"))
    return got.select("id", GE.add(p, q)["x"].alias("sx"), GE.add(p, q)["z"].alias("sz"), GE.subtract(q, p)["x"].alias("dx"), GE.scale(p, 2.5)["y"].alias("scaled"), GE.divide(q, 4)["x"].alias("part"), GE.dot(p, q).alias("dot"), GE.equal(F.array(p), F.array(q)).alias("same"))


@query(Y.BENT + "SELECT id, id % 3 = 0 AS held, count(*) AS n, round(sum(l), 6) AS length FROM bs GROUP BY id")
def bent_compounds(spark: SparkSession, sf: str) -> DataFrame:
    """A line cut in two at its second point and joined again, and its points by id."""
    two = F.array(F.slice(F.col("pts"), 1, 2), F.slice(F.col("pts"), F.lit(2), F.size(F.col("pts"))))
    whole = GE.joined(two)
    back = GE.joined(GE.turned(two))
    held = U.holds(F.transform(whole, lambda p: p["id"]), F.when(F.col("id") % 3 == 0, F.col("id") * 32 + 1).otherwise(F.lit(-1)))
    return bent(spark, sf).select("id", held.alias("held"), F.size(P.segments(back)).cast("long").alias("n"), r6(P.length(whole)).alias("length"))


_PAIRS = """
, pq AS (SELECT a.id, a.ax, a.ay, a.bx, a.b_y, a.l, c.ax AS cx, c.ay AS cy, c.bx AS dx, c.b_y AS dy, c.l AS m FROM bs a JOIN bs c ON c.id = a.id + 1 WHERE a.id % 2 = 0),
po AS (SELECT *, (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) AS o1, (bx - ax) * (dy - ay) - (b_y - ay) * (dx - ax) AS o2, (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx) AS o3, (dx - cx) * (b_y - cy) - (dy - cy) * (bx - cx) AS o4,
  greatest(0, least(1, ((cx - ax) * (bx - ax) + (cy - ay) * (b_y - ay)) / (l * l))) AS tc, greatest(0, least(1, ((dx - ax) * (bx - ax) + (dy - ay) * (b_y - ay)) / (l * l))) AS td,
  greatest(0, least(1, ((ax - cx) * (dx - cx) + (ay - cy) * (dy - cy)) / (m * m))) AS ta, greatest(0, least(1, ((bx - cx) * (dx - cx) + (b_y - cy) * (dy - cy)) / (m * m))) AS tb FROM pq),
pd AS (SELECT id, o1 * o2 < 0 AND o3 * o4 < 0 AS x, least(
  sqrt((ax + (bx - ax) * tc - cx) ^ 2 + (ay + (b_y - ay) * tc - cy) ^ 2), sqrt((ax + (bx - ax) * td - dx) ^ 2 + (ay + (b_y - ay) * td - dy) ^ 2),
  sqrt((cx + (dx - cx) * ta - ax) ^ 2 + (cy + (dy - cy) * ta - ay) ^ 2), sqrt((cx + (dx - cx) * tb - bx) ^ 2 + (cy + (dy - cy) * tb - b_y) ^ 2)) AS d FROM po)
"""


@query(Y.BENT + _PAIRS + "SELECT id, bool_or(x OR d < 1e-9) AS meet, round(CASE WHEN bool_or(x) THEN 0 ELSE min(d) END, 6) AS distance FROM pd GROUP BY id")
def bent_closest_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Whether neighbouring lines meet, and how near they come."""
    b = bent(spark, sf)
    two = b.where("id % 2 = 0").join(b.select((F.col("id") - 1).alias("id"), F.col("pts").alias("other")), "id")
    return SP.spread(two).select("id", GE.lines_meet("pts", "other").alias("meet"), r6(F.abs(GE.closest_points("pts", "other")["distance"])).alias("distance"))


@query("WITH c AS (SELECT c_custkey AS id, 2 + c_custkey % 5 AS w, 2 + c_custkey % 7 AS h FROM customer) SELECT id, 4 AS triangles, 2 AS parts, (3.0 * w * h)::DOUBLE AS area, (4.0 * w + 4.0 * h)::DOUBLE AS around, (2.0 * w)::DOUBLE AS xmax FROM c")
def corner_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """L-shaped rings cut into triangles (with their areas added up) and convex parts."""
    ring = F.col("ring")
    got = SP.spread(Y.corner_rings(spark, sf)).select("id", "ring", GE.triangulate("ring").alias("t"), GE.convex_partition("ring").alias("c"))
    corners = F.transform("t", lambda t: F.transform(t, lambda i: F.try_element_at(ring, i + 1)))
    area = F.aggregate(F.transform(corners, lambda r: F.abs(P.ring_area(r))), F.lit(0.0), lambda a, x: a + x)
    return got.select("id", F.size("t").alias("triangles"), F.size("c").alias("parts"), r6(area).alias("area"), r6(P.perimeter(ring)).alias("around"), P.box(ring)["xmax"].alias("xmax"))


@query("SELECT id, round(x0 - (y1 - y0) / len * 1.5, 6) AS x, round(y0 + (x1 - x0) / len * 1.5, 6) AS y, round(x1 - (y1 - y0) / len * 1.5, 6) AS end_x FROM (SELECT *, sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2) AS len FROM synth_line)")
def offset_lines(spark: SparkSession, sf: str) -> DataFrame:
    got = lines(spark, sf).select("id", GE.offset("pts", F.lit(1.5)).alias("o"))
    return got.select("id", r6(F.try_element_at("o", F.lit(1))["x"]).alias("x"), r6(F.try_element_at("o", F.lit(1))["y"]).alias("y"), r6(F.try_element_at("o", F.lit(-1))["x"]).alias("end_x"))


_LR = "SELECT v.id, l.x0 AS lx0, l.y0 AS ly0, l.x1 AS lx1, l.y1 AS ly1, r.x0 AS rx0, r.y0 AS ry0, r.x1 AS rx1, r.y1 AS ry1 FROM synth_lane v JOIN synth_line l ON l.id = v.left_id JOIN synth_line r ON r.id = v.right_id"


@query(f"SELECT id, (lx0 + rx0) / 2 AS x, round((ly0 + ry0) / 2, 6) AS y, round((ly1 + ry1) / 2, 6) AS end_y, round(sqrt((lx1 + rx1 - lx0 - rx0) ^ 2 + (ly1 + ry1 - ly0 - ry0) ^ 2) / 2, 6) AS length, round(abs(((lx1 + rx1 - lx0 - rx0) / 2) * (ly0 + 1 - (ly0 + ry0) / 2) - ((ly1 + ry1 - ly0 - ry0) / 2) * (lx0 + 5 - (lx0 + rx0) / 2)) / (sqrt((lx1 + rx1 - lx0 - rx0) ^ 2 + (ly1 + ry1 - ly0 - ry0) ^ 2) / 2), 6) AS distance FROM ({_LR})")
def lane_centrelines(spark: SparkSession, sf: str) -> DataFrame:
    """Middle lines: their ends, lengths, and how far a point beside the left bound is from them. Ends may come twice where the rungs do."""
    got = lanes(spark, sf).select("id", GE.centreline("left_pts", "right_pts").alias("c"), F.try_element_at("left_pts", F.lit(1)).alias("p"))
    at = lambda i: F.try_element_at("c", F.lit(i))
    straight = F.array(at(1), at(-1))
    p = F.struct((F.col("p.x") + 5).alias("x"), (F.col("p.y") + 1).alias("y"), F.lit(0.0).alias("z"))
    return got.select("id", at(1)["x"].alias("x"), r6(at(1)["y"]).alias("y"), r6(at(-1)["y"]).alias("end_y"), r6(P.length(straight)).alias("length"), r6(P.distance_to(straight, p)).alias("distance"))


@query(f", lr AS ({_LR}) SELECT a.id, round(abs(a.lx0 * a.ly1 - a.lx1 * a.ly0 + a.lx1 * a.ry1 - a.rx1 * a.ly1 + a.rx1 * a.ry0 - a.rx0 * a.ry1 + a.rx0 * a.ly0 - a.lx0 * a.ry0) / 2 + abs(b.lx0 * b.ly1 - b.lx1 * b.ly0 + b.lx1 * b.ry1 - b.rx1 * b.ly1 + b.rx1 * b.ry0 - b.rx0 * b.ry1 + b.rx0 * b.ly0 - b.lx0 * b.ry0) / 2, 6) AS area, (a.lx1 - a.lx0 + b.lx1 - b.lx0)::DOUBLE AS along FROM lr a JOIN lr b ON b.id = a.id + 4 WHERE ((a.id - 1) // 4) % 50 < 49")
def lane_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """The ring around each lane and the one ahead of it, made from the bounds of both, and by leaving out the border that they share."""
    v = lanes(spark, sf).select("id", "left_pts", "right_pts", P.lane_ring(F.col("left_pts"), F.col("right_pts")).alias("ring"))
    two = v.join(v.select((F.col("id") - 4).alias("id"), F.col("left_pts").alias("l2"), F.col("right_pts").alias("r2"), F.col("ring").alias("ring2")), "id").where("floor((id - 1) / 4) % 50 < 49")
    got = two.select("id", GE.outline(F.array("ring", "ring2")).alias("o"), GE.sequence_ring(F.array("left_pts", "l2"), F.array("right_pts", "r2")).alias("s"))
    x = lambda c: F.transform(c, lambda p: p["x"])
    return got.select("id", F.when(F.abs(F.abs(P.ring_area(F.col("o"))) - F.abs(P.ring_area(F.col("s")))) < 1e-9, r6(F.abs(P.ring_area(F.col("o"))))).alias("area"), r6(F.array_max(x(F.col("o"))) - F.array_min(x(F.col("o")))).alias("along"))


# ---- usages and shared borders ----------------------------------------------------------------------------------


@query("SELECT regelem_id, 'lanelet' AS kind, id AS owner_id FROM synth_lane WHERE regelem_id IS NOT NULL")
def regelem_owners(spark: SparkSession, sf: str) -> DataFrame:
    from . import synth

    return U.of_regelems(synth.road_map(spark, sf)).select("regelem_id", "kind", "owner_id")


@query("SELECT p0 AS point_id, 'linestring' AS kind, id AS owner_id FROM synth_line UNION SELECT p1, 'linestring', id FROM synth_line")
def point_owners(spark: SparkSession, sf: str) -> DataFrame:
    from . import synth

    m = synth.road_map(spark, sf)
    return U.of_points(m, m.points).select("point_id", "kind", "owner_id")


@query(", v AS (SELECT id, false AS inv, left_id AS l, false AS li, right_id AS r, false AS ri FROM synth_lane UNION ALL SELECT id, true, right_id, true, left_id, true FROM synth_lane) SELECT a.id AS a, a.inv AS a_inv, b.id AS b, b.inv AS b_inv, a.l AS line, 'left' AS side FROM v a JOIN v b ON a.l = b.r AND a.li = b.ri AND a.id <> b.id UNION ALL SELECT a.id, a.inv, b.id, b.inv, a.r, 'right' FROM v a JOIN v b ON a.r = b.l AND a.ri = b.li AND a.id <> b.id")
def shared_borders(spark: SparkSession, sf: str) -> DataFrame:
    """Borders of neighbouring lanes, in both directions."""
    from . import synth

    v = directed(synth.road_map(spark, sf).lanelets)
    return U.common_lines(v, v).select(F.col("a.id").alias("a"), F.col("a.inv").alias("a_inv"), F.col("b.id").alias("b"), F.col("b.inv").alias("b_inv"), F.col("line.id").alias("line"), "side")


# ---- crossing streets -------------------------------------------------------------------------------------------

_STREET = "WITH st AS (SELECT s_suppkey AS s, s_suppkey // 20 AS town, s_suppkey % 20 AS k, s_suppkey % 4 = 0 AS two_way, s_suppkey % 5 = 0 AS slow, s_suppkey % 20 >= 10 AND s_suppkey % 3 = 0 AS bridge FROM supplier), x AS (SELECT a.s AS a, b.s AS b, a.two_way AS a_both, b.two_way AS b_both, a.slow AS a_slow, b.slow AS b_slow, a.bridge OR b.bridge AS over FROM st a JOIN st b ON a.town = b.town AND (a.k < 10) <> (b.k < 10)) "


def _streets(spark: SparkSession, sf: str) -> DataFrame:
    m = Y.crossing_map(spark, sf)
    return with_bounds(m.lanelets, with_points(m.linestrings, m.points))


@query(_STREET + "SELECT (a + 1) * 2 + i AS src, (b + 1) * 2 + j AS dst FROM x, range(0, 2) AS p(i), range(0, 2) AS q(j) WHERE (i = 0 OR a_both) AND (j = 0 OR b_both) UNION ALL SELECT (s + 1) * 2 + i, (s + 1) * 2 + 1 - i FROM st, range(0, 2) AS p(i) WHERE two_way")
def crossing_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between streets that cross, in all directions that they may be driven, and of two-way streets with themselves."""
    g = G.build(Y.crossing_map(spark, sf), CAR, (G.Cost("distance", 10.0),))
    return g.view(G.CONFLICTING).select(code("src").alias("src"), code("dst").alias("dst"))


@query(_STREET + "SELECT a + 1 AS a, b + 1 AS b, NOT over AS level FROM x WHERE a < b")
def crossing_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Streets that cross, and whether on one level (less than three metres apart in height)."""
    ring = _streets(spark, sf).select("id", P.lane_ring(F.col("left_pts"), F.col("right_pts")).alias("ring"))
    pairs = AR.overlapping(ring, ring).where("a < b")
    both = pairs.join(ring.select(F.col("id").alias("a"), F.col("ring").alias("ra")), "a").join(ring.select(F.col("id").alias("b"), F.col("ring").alias("rb")), "b")
    return both.select("a", "b", GE.overlaps_3d(F.col("ra"), F.col("rb"), F.lit(3.0)).alias("level"))


@query(_STREET + "SELECT a + 1 AS a, b + 1 AS b, (1000 * (a // 20) + 10 * (CASE WHEN b % 20 >= 10 THEN b ELSE a END % 10) + 2)::DOUBLE AS x, (10 * (CASE WHEN a % 20 < 10 THEN a ELSE b END % 10) + 2)::DOUBLE AS y FROM x WHERE a < b")
def crossing_centrelines(spark: SparkSession, sf: str) -> DataFrame:
    """Where the middle lines of crossing streets meet."""
    mid = _streets(spark, sf).select("id", GE.centreline("left_pts", "right_pts").alias("c"), P.lane_ring(F.col("left_pts"), F.col("right_pts")).alias("ring"))
    pairs = AR.overlapping(mid.select("id", "ring"), mid.select("id", "ring")).where("a < b")
    j = pairs.join(mid.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(mid.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
    return j.select("a", "b", F.explode(GE.crossing_distances(F.col("ca"), F.col("cb"))).alias("x")).select("a", "b", r6(F.col("x.x")).alias("x"), r6(F.col("x.y")).alias("y"))


@query(_STREET + "SELECT 'bicycle' AS graph, a + 1 AS id, 'vehicle' AS other_graph, b + 1 AS other FROM x UNION ALL SELECT 'vehicle', a + 1, 'bicycle', b + 1 FROM x")
def conflicts_of_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Lanes of cars that cross lanes of bicycles, and the other way round."""
    m = Y.crossing_map(spark, sf)
    graphs = {p: G.build(m, R.create("de", p), (G.Cost("distance", 10.0),), conflicts=False) for p in ("vehicle", "bicycle")}
    return G.conflicts_across(graphs, _streets(spark, sf)).select("graph", "id", "other_graph", "other")


# ---- squares beside a walkway -----------------------------------------------------------------------------------

WALK = R.create("de", R.PEDESTRIAN)
_SQ = "WITH sq AS (SELECT s_suppkey AS s, s_suppkey // 20 AS town, s_suppkey % 20 AS k FROM supplier), la AS (SELECT town, max(k) AS k FROM sq GROUP BY town), ends AS (SELECT sq.* FROM sq JOIN la USING (town, k)) "


def _squares(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = Y.square_map(spark, sf)
    return G.vertices(m, WALK), AR.ring_lines(AR.passable(m, WALK), with_points(m.linestrings, m.points))


@query(
    _SQ
    + """SELECT s + 1 AS lane, false AS inv, 700000 + s AS area, 'right' AS side FROM sq UNION ALL SELECT s + 1, true, 700000 + s, 'left' FROM sq
UNION ALL SELECT s + 1, false, 800000 + town, 'end' FROM ends UNION ALL SELECT s + 1, true, 800000 + town, 'start' FROM ends"""
)
def area_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Where walkways, in both directions, meet squares and places."""
    v, bounds = _squares(spark, sf)
    return AR.lane_borders(v, bounds).select(F.col("lane.id").alias("lane"), F.col("lane.inv").alias("inv"), "area", "side")


@query(_SQ + "SELECT a.s + 700000 AS a, b.s + 700000 AS b FROM sq a JOIN sq b ON a.town = b.town AND abs(a.k - b.k) = 1")
def adjacent_areas(spark: SparkSession, sf: str) -> DataFrame:
    m = Y.square_map(spark, sf)
    return AR.adjacent(AR.with_rings(m.areas, with_points(m.linestrings, m.points)))


_ON = """
, e AS (SELECT (s + 1) * 2 + i AS src, (700000 + s) * 2 AS dst FROM sq, range(0, 2) AS d(i) WHERE k % 2 = 0
UNION ALL SELECT (700000 + s) * 2, (s + 1) * 2 + i FROM sq, range(0, 2) AS d(i) WHERE k % 2 = 0
UNION ALL SELECT (s + 1) * 2, (800000 + town) * 2 FROM ends UNION ALL SELECT (800000 + town) * 2, (s + 1) * 2 + 1 FROM ends
UNION ALL SELECT (700000 + a.s) * 2, (700000 + b.s) * 2 FROM sq a JOIN sq b ON a.town = b.town AND abs(a.k - b.k) = 1 AND greatest(a.k, b.k) % 3 <> 0)"""


@query(_SQ + _ON + " SELECT src, dst, (CASE WHEN src >= 1600000 OR dst >= 1600000 THEN 29.0 ELSE CASE WHEN src >= 1400000 AND dst >= 1400000 THEN 40.0 ELSE 25.0 END END)::DOUBLE AS cost FROM e")
def area_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Ways for people on foot onto, over and off areas; a way costs the mean of both sides' lengths, of areas their outlines."""
    g = G.build(Y.square_map(spark, sf), WALK, (G.Cost("distance", 10.0),), areas=True)
    return g.view(G.AREA).select(code("src").alias("src"), code("dst").alias("dst"), r6(F.col("cost")).alias("cost"))


@query(_SQ + ", t AS (SELECT town, k FROM la WHERE k >= 2) SELECT town * 20 + 1 AS query, (10.0 * k + 29.0)::DOUBLE AS cost, (k + 2)::INT AS n FROM t")
def paths_over_areas(spark: SparkSession, sf: str) -> DataFrame:
    """From each town's first piece of walkway to the place at its end, along the walkway and onto it."""
    g = G.build(Y.square_map(spark, sf), WALK, (G.Cost("distance", 10.0),), areas=True, conflicts=False)
    s = Y.table(spark, sf, "supplier")
    towns = s.groupBy(F.floor(F.col("s_suppkey") / 20).cast("long").alias("town")).agg(F.max(F.col("s_suppkey") % 20).alias("k")).where("k >= 2")
    v = lambda i: F.struct(i.cast("long").alias("id"), F.lit(False).alias("inv"))
    q = towns.select((F.col("town") * 20 + 1).alias("query"), v(F.col("town") * 20 + 1).alias("v"), v(800_000 + F.col("town")).alias("target"))
    return S.shortest_paths(g.view(G.SUCCESSOR | G.AREA), q).select("query", r6(F.col("cost")).alias("cost"), F.size("path").alias("n"))


@query(_SQ + "SELECT 700000 + s AS id, 100.0::DOUBLE AS area, 40.0::DOUBLE AS around, (1000.0 * town + 10 * k + 5)::DOUBLE AS x, 5.0::DOUBLE AS y, k % 2 = 0 AS near, (CASE WHEN k % 2 = 0 THEN 0 ELSE 2 END)::DOUBLE AS distance FROM sq")
def area_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Squares' outlines, and whether (and how far from) a point is in them: in the middle of every second one, two metres above the others."""
    m = Y.square_map(spark, sf)
    a = AR.with_rings(m.areas.where("id < 800000"), with_points(m.linestrings, m.points))
    o = F.col("outer_pts")
    k = (F.col("id") - 700_000) % 20
    town = F.floor((F.col("id") - 700_000) / 20)
    p = F.struct((1000 * town + 10 * k + 5).cast("double").alias("x"), F.when(k % 2 == 0, 5.0).otherwise(12.0).alias("y"), F.lit(0.0).alias("z"))
    none = F.coalesce("holes", F.array(F.slice(o, 1, 0)))
    return a.select("id", r6(F.abs(P.ring_area(o))).alias("area"), r6(P.perimeter(F.slice(o, 1, 4))).alias("around"), r6(P.centroid(F.slice(o, 1, 4))["x"]).alias("x"), r6(P.centroid(F.slice(o, 1, 4))["y"]).alias("y"), AR.inside(o, none, p).alias("near"), r6(AR.distance(o, none, p)).alias("distance"))


# ---- faults -----------------------------------------------------------------------------------------------------


@query(
    """SELECT check_name, n::INT AS n FROM (
  SELECT 'mapping.bool_tags' AS check_name, count(*) AS n FROM synth_lane WHERE p % 17 = 0
  UNION ALL SELECT 'mapping.unknown_tags', count(*) FROM synth_lane WHERE p % 19 = 0
  UNION ALL SELECT 'mapping.unknown_tag_value', count(*) FROM synth_lane WHERE p % 23 = 0
  UNION ALL SELECT 'mapping.mandatory_tags', count(*) FROM synth_lane WHERE p_size % 10 = 7
  UNION ALL SELECT 'mapping.curvature_too_big', count(*) FROM synth_lane WHERE left_id % 31 = 0 OR right_id % 31 = 0 OR left_id % 29 = 0 OR right_id % 29 = 0
  UNION ALL SELECT 'mapping.duplicated_points', count(*) FROM synth_line WHERE id % 29 = 0 AND id % 31 <> 0
  UNION ALL SELECT 'mapping.points_too_close', 2 * count(*) FROM (SELECT p0 AS p FROM synth_line UNION SELECT p1 FROM synth_line) WHERE p % 37 = 0) WHERE n > 0"""
)
def map_issues(spark: SparkSession, sf: str) -> DataFrame:
    """What the checks of a map find on one with faults of each kind."""
    return V.report(V.validate(Y.faulty_map(spark, sf), checks="mapping.*")).select("check_name", F.col("n").cast("int").alias("n"))


@query(_EDGES + ", kept AS (SELECT * FROM synth_edge WHERE NOT (relation IN (4, 16) AND src % 26 = 0)) SELECT a.src // 2 AS id, 'isn''t seen back from its left neighbour' AS message FROM kept a WHERE a.relation IN (2, 8) AND NOT EXISTS (SELECT 1 FROM kept b WHERE b.src = a.dst AND b.dst = a.src AND b.relation IN (4, 16))")
def graph_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What the graph's check finds where some lanes have lost their right neighbour."""
    g = car_graph(spark, sf, costs=(G.Cost("distance", 10.0),), conflicts=False)
    lost = F.col("relation").isin(G.RIGHT, G.ADJACENT_RIGHT) & (code("src") % 26 == 0)
    return G.problems(G.Graph(g.vertices, g.edges.where(~lost), 1)).select("id", "message")
