"""Expressions, rules, graph, search, matching, validation and files on small maps with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from roadweave import model
from roadweave.errors import GeometryError, InvalidInputError, MapFormatError, NoSuchPrimitiveError
from roadweave.functions import attributes as A
from roadweave.functions import boxes as B
from roadweave.functions import polylines as P
from roadweave.functions import projections as J
from roadweave.functions import shapes as S
from roadweave.functions.flat import line_distance
from roadweave.operators import graph as G
from roadweave.operators import matching as M
from roadweave.operators import rules as R
from roadweave.operators import search as Q
from roadweave.operators import spatial as SP
from roadweave.operators import validation as V
from roadweave.sources import osm


def one(spark, **cols):
    r = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return r[0] if len(cols) == 1 else tuple(r)


def line(*pts):
    return F.array(*[F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"), F.lit(float(p[2] if len(p) > 2 else 0)).alias("z")) for p in pts])


def pt(x, y, z=0.0):
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(z)).alias("z"))


def test_attributes(spark):
    rows = spark.createDataFrame([(v,) for v in ("0a", "0.1", " 0", "7", "true", "Yes", "0", "no", "maybe", "0.1 mps", "36 km/h", "10 mph", "3 parsec", "")], "v string")
    got = {r.v: r for r in rows.select("v", A.as_bool(F.col("v")).alias("b"), A.as_double(F.col("v")).alias("d"), A.as_id(F.col("v")).alias("i"), A.as_velocity(F.col("v")).alias("s")).collect()}
    assert [got[v].i for v in ("0a", "0.1", " 0", "7")] == [None, None, None, 7]
    assert got["0.1"].d == 0.1 and got[" 0"].d is None
    assert [got[v].b for v in ("true", "Yes", "0", "no", "maybe")] == [True, True, False, False, None]
    assert got["0.1 mps"].s == pytest.approx(0.1) and got["36 km/h"].s == pytest.approx(10) and got["10 mph"].s == pytest.approx(4.4704) and got["7"].s == pytest.approx(7 / 3.6)
    assert got["3 parsec"].s is None and got[""].s is None
    tags = F.create_map(*[F.lit(x) for x in ("participant:vehicle", "yes", "participant:vehicle:bus", "no")])
    assert one(spark, v=A.override_for(tags, "participant", "vehicle:bus")) == "yes"
    assert one(spark, v=A.override_for(tags, "participant", "bicycle")) is None
    assert one(spark, v=A.set_attributes(tags, **{"participant:vehicle": "no"})["participant:vehicle"]) == "no"
    assert one(spark, v=A.plain_number(F.lit(9.0100), 2)) == "9.01"


def test_polylines(spark):
    v = line((0, 0), (1, 0), (1, 1))
    assert one(spark, v=P.length(v)) == 2
    assert one(spark, v=P.length_ratios(v)) == [0.5, 0.5]
    assert one(spark, v=P.accumulated_length_ratios(line((0, 0, 0), (1, 0, 0), (1, 1, 1)), z=True))[0] == pytest.approx(1 / (1 + math.sqrt(2)))
    assert one(spark, v=P.length_ratios(line((0, 0)))) == [] and one(spark, v=P.length_ratios(line((0, 0), (2, 0)))) == [1]
    assert tuple(one(spark, v=P.interpolate(v, F.lit(1.5))))[:2] == (1, 0.5)
    assert tuple(one(spark, v=P.interpolate(v, F.lit(-1.5))))[:2] == (0.5, 0)
    assert tuple(one(spark, v=P.interpolate(v, F.lit(9.0))))[:2] == (1, 1)
    assert tuple(one(spark, v=P.nearest_vertex(v, F.lit(0.4))))[:2] == (0, 0)
    assert one(spark, v=P.curvature(pt(-1, 0), pt(0, 1), pt(1, 0))) == pytest.approx(1)
    assert one(spark, v=P.curvature(pt(-1, 0), pt(0, 1), pt(1, 0), signed=True)) == pytest.approx(-1)
    assert one(spark, v=P.curvature(pt(0, 0), pt(0, 0), pt(1, 0))) == math.inf
    assert tuple(one(spark, v=P.to_arc(line((0, 0), (1, 0), (2, 0)), pt(1.5, 1)))) == (1.5, 1)
    assert tuple(one(spark, v=P.from_arc(line((0, 0), (0, 10)), F.lit(5.0), F.lit(2.0)))) == (-2, 5)
    assert one(spark, v=P.signed_distance(v, pt(2, 0.5))) == -1 and one(spark, v=P.signed_distance(v, pt(0.5, 0.5))) == 0.5
    assert one(spark, v=P.distance_to(v, pt(2, 2))) == pytest.approx(math.sqrt(2))
    ring = line((0, 0), (0, 2), (2, 2), (2, 0))
    assert one(spark, v=P.ring_area(ring)) == 4 and one(spark, v=P.perimeter(ring)) == 8 and tuple(one(spark, v=P.centroid(ring))) == (1, 1)
    assert one(spark, v=P.inside(ring, pt(2, 1))) and one(spark, v=P.inside(ring, pt(1, 1))) and not one(spark, v=P.inside(ring, pt(3, 1)))
    assert one(spark, v=P.distance_to_ring(ring, pt(5, 1))) == 3 and one(spark, v=P.distance_to_ring(ring, pt(1, 1))) == 0


def test_boxes(spark):
    a, b = B.make(0, 0, 2, 2), B.make(2, 1, 3, 5)
    assert one(spark, v=B.intersects(a, b)) and not one(spark, v=B.intersects(a, B.make(2.1, 0, 3, 3)))
    assert tuple(one(spark, v=B.extend(a, b))) == (0, 0, 3, 5) and tuple(one(spark, v=B.intersection(a, b))) == (2, 1, 2, 2)
    assert one(spark, v=B.exterior_distance(a, pt(5, 6))) == 5 and one(spark, v=B.volume(a)) == 4 and tuple(one(spark, v=B.centre(a))) == (1, 1)
    assert len(one(spark, v=B.cells(B.make(0, 0, 25, 5), 10.0))) == 3


def test_shapes():
    l = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    tri = S.triangulate(l)
    assert len(tri) == 4 and sum(abs(S.signed_area([l[i] for i in t])) for t in tri) == pytest.approx(7)
    parts = S.convex_partition(l)
    assert len(parts) < 4 and sum(abs(S.signed_area([l[i] for i in p])) for p in parts) == pytest.approx(7)
    with pytest.raises(GeometryError):
        S.triangulate([(0, 0), (1, 1)])
    sq = lambda x, y, s=1: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    assert not S.overlaps(sq(0, 0), sq(1, 0)) and S.overlaps(sq(0, 0), sq(0.9, 0)) and S.overlaps(sq(0, 0, 3), sq(1, 1)) and not S.overlaps(l, sq(2, 2))
    assert S.crossings([(0, 0), (2, 2)], [(0, 2), (2, 0)]) == [(1, 1)]
    a, b = S.closest_pair([(0, 0, 0), (1, 0, 0)], [(0.5, 1, 2), (0.5, -1, 2)])
    assert math.dist(a, b) == pytest.approx(2)
    assert S.ring_distance(sq(0, 0), sq(3, 0)) == 2
    assert S.offset([(0, 0), (10, 0)], 1) == [(0, 1), (10, 1)]
    with pytest.raises(GeometryError):
        S.offset([(0, 0)], 1)
    mid = S.centreline([(0, 2), (5, 2), (10, 2)], [(0, 0), (10, 0)])
    assert mid[0] == (0, 1) and mid[-1] == (10, 1) and all(y == 1 for _, y in mid)


def test_projections(spark):
    lat, lon = F.lit(49.01439), F.lit(8.41722)
    e = J.Geocentric()
    g = one(spark, v=e.forward(lat, lon, F.lit(123.0)))
    assert tuple(g) == pytest.approx((4146160.550580083, 613525.0621995202, 4791701.343249619), abs=1e-6)
    u = J.Utm(J.Origin(49, 8.4), use_offset=False)
    assert tuple(one(spark, v=u.forward(lat, lon, F.lit(0.0))))[:2] == pytest.approx((457386.38238563854, 5429219.051147663), abs=1e-3)
    for p in (J.SphericalMercator(J.Origin(49)), J.EllipsoidalMercator(J.Origin(49, 8.4)), e, J.LocalCartesian(J.Origin(49, 8.4, 100)), J.Utm(J.Origin(49, 8.4))):
        f = p.forward(lat, lon, F.lit(2.0))
        back = one(spark, v=p.reverse(f["x"], f["y"], f["z"]))
        assert tuple(back) == pytest.approx((49.01439, 8.41722, 2), abs=1e-7)
    o = J.LocalCartesian(J.Origin(49.01439, 8.41722, 123))
    assert tuple(one(spark, v=o.forward(lat, lon, F.lit(123.0)))) == pytest.approx((0, 0, 0), abs=1e-6)
    strict = J.Utm(J.Origin(49, 8.4), throw_in_padding=True)
    assert one(spark, v=strict.forward(lat, F.lit(13.0), F.lit(0.0))) is None
    assert J.zone_of(60, 5) == 32 and J.zone_of(49, 8.4) == 32 and J.zone_of(-33, 151) == 56


@pytest.fixture(scope="module")
def small(spark):
    """Two lanes after each other and one beside the first, dashed between; a walkway."""
    pts = [(i * 10 + j + 1, float(i * 10), float(j * 3), 0.0, {}) for i in range(3) for j in range(4)]
    pid = lambda i, j: i * 10 + j + 1
    lines, lid = [], {}
    for i in range(2):
        for j in range(4):
            lid[i, j] = 100 + i * 10 + j
            lines.append((lid[i, j], [pid(i, j), pid(i + 1, j)], {"type": "line_thin", "subtype": "dashed" if j == 1 else "solid"}))
    ref = lambda i: (i, False)
    road = {"subtype": "road", "location": "urban", "one_way": "yes"}
    lanes = [(1, ref(lid[0, 1]), ref(lid[0, 0]), None, [], road), (2, ref(lid[1, 1]), ref(lid[1, 0]), None, [900], {**road, "speed_limit": "30 km/h"}), (3, ref(lid[0, 2]), ref(lid[0, 1]), None, [], {**road, "one_way": "no"}), (4, ref(lid[0, 3]), ref(lid[0, 2]), None, [], {"subtype": "walkway"})]
    regs = [(900, "speed_limit", {"sign_type": "de274-60", "dynamic": "yes"})]
    params = [(900, "ref_line", 0, "linestring", lid[1, 0], False)]
    return model.RoadMap.of(spark, points=pts, linestrings=lines, lanelets=lanes, regelems=regs, regelem_params=params)


def test_rules(small):
    car, foot = R.create("de", "vehicle"), R.create("de", "pedestrian")
    got = {(r.id, r.inv) for r in G.passable(small, car).collect()}
    assert got == {(1, False), (2, False), (3, False), (3, True)}
    assert {(r.id, r.inv) for r in G.passable(small, foot).collect()} == {(4, False), (4, True)}
    s = {r.id: r.v for r in small.lanelets.select("id", R.speed_limit(F.col("attrs"), car)["mps"].alias("v")).collect()}
    assert s[1] == pytest.approx(50 / 3.6) and s[2] == pytest.approx(30 / 3.6) and s[4] == 0
    sign = small.lanelets.limit(1).select(R.sign_velocity(F.lit("de274-60"), car).alias("a"), R.sign_velocity(F.lit("80 km/h"), car).alias("b")).first()
    assert tuple(sign) == pytest.approx((60 / 3.6, 80 / 3.6))
    assert [r.id for r in R.has_dynamic_rules(small.lanelets, small.regelems).collect()] == [2]
    assert R.create("de", "vehicle:taxi").participant == "vehicle:taxi"
    with pytest.raises(InvalidInputError):
        R.create("nowhere", "vehicle")


def test_graph(spark, small):
    g = G.build(small, R.create("de", "vehicle"), (G.Cost("distance", 2.0), G.Cost("time", 1.0)))
    e = {((r.src.id, r.src.inv), (r.dst.id, r.dst.inv)): (r.cost, r.relation) for r in g.view(127).collect()}
    assert e[(1, False), (2, False)] == (10, G.SUCCESSOR)
    assert e[(1, False), (3, False)] == (2, G.LEFT) and e[(3, False), (1, False)] == (2, G.RIGHT)
    assert e[(3, False), (3, True)] == (1, G.CONFLICTING) and e[(3, True), (3, False)] == (1, G.CONFLICTING)
    assert ((1, False), (3, True)) not in e
    assert G.build(small, R.create("de", "vehicle"), (G.Cost("distance", 2.0, 50.0),)).view(G.LEFT | G.RIGHT).isEmpty()
    assert G.problems(g).isEmpty()
    with pytest.raises(InvalidInputError):
        g.view(1, 5)
    with pytest.raises(InvalidInputError):
        G.Cost("distance", -1)
    starts = spark.createDataFrame([(1, (3, False))], "query bigint, v struct<id: bigint, inv: boolean>")
    drive = g.view(G.SUCCESSOR | G.LEFT | G.RIGHT)
    reach = {(r.v.id, r.v.inv): r.cost for r in Q.reachable(drive, starts, 12.0).collect()}
    assert reach == {(3, False): 0, (1, False): 2, (2, False): 12}
    towards = {r.v.id for r in Q.reachable_towards(drive, spark.createDataFrame([(1, (2, False))], starts.schema), 100).collect()}
    assert towards == {1, 2, 3}


def test_search_on_six_vertices(spark, monkeypatch):
    raw = [(0, 1, 1), (0, 2, 2), (1, 3, 3), (1, 4, 1), (2, 3, 1), (2, 4, 3), (3, 5, 3), (4, 5, 1)]
    schema = "src struct<id: bigint, inv: boolean>, dst struct<id: bigint, inv: boolean>, cost double, relation int"
    edges = spark.createDataFrame([((a, False), (b, False), float(c), 1) for a, b, c in raw], schema)
    starts = spark.createDataFrame([(7, (0, False))], "query bigint, v struct<id: bigint, inv: boolean>")
    open_ = edges.where("src.id <> 4")  # vertex 4 is reached and not passed
    for limit in (500_000, 0):
        monkeypatch.setattr(Q, "BROADCAST_EDGES", limit)
        t = {r.v.id: r for r in Q.trees(open_, starts).collect()}
        assert [t[i].cost for i in range(6)] == [0, 1, 2, 3, 2, 6] and [t[i].hops for i in range(6)] == [1, 2, 2, 3, 3, 4]
        assert [t[i].pred.id for i in range(1, 6)] == [0, 0, 2, 1, 3] and {i for i in t if t[i].leaf} == {4, 5}
        p = Q.shortest_paths(edges, starts.withColumn("target", F.struct(F.lit(5).cast("long").alias("id"), F.lit(False).alias("inv")))).first()
        assert p.cost == 3 and [v.id for v in p.path] == [0, 1, 4, 5]
        none = Q.shortest_paths(edges, starts.selectExpr("query", "named_struct('id', 5L, 'inv', false) AS v", "v AS target"))
        assert none.count() == 0
        via = Q.shortest_paths_via(edges, spark.createDataFrame([(3, [(0, False), (2, False), (5, False)])], "query bigint, stops array<struct<id: bigint, inv: boolean>>")).first()
        assert via.cost == 6 and [v.id for v in via.path] == [0, 2, 3, 5]
        ways = Q.possible_paths(open_, starts, min_cost=2.0).collect()
        assert sorted(tuple(v.id for v in r.path) for r in ways) == [(0, 1, 3), (0, 1, 4), (0, 2)]
    with pytest.raises(InvalidInputError):
        Q.possible_paths(edges, starts)


def test_spatial(spark, small):
    lines = model.with_points(small.linestrings, small.points).withColumn("box", P.box(F.col("pts")))
    assert [r.id for r in SP.search(lines, B.make(0, 0, 1, 1)).collect()] == [100]
    with pytest.raises(NoSuchPrimitiveError):
        SP.lookup(lines, 12345)
    import random

    g = random.Random(1)
    objs = [(i, g.uniform(-5, 25), g.uniform(-5, 15)) for i in range(60)]
    o = spark.createDataFrame(objs, "oid long, x double, y double").withColumn("abox", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")))
    s = lines.select("id", "pts", F.col("box").alias("bbox"))
    d = P.distance_to(F.col("pts"), F.struct("x", "y", F.lit(0.0).alias("z")))
    got = {(r.oid, r.id) for r in SP.knn(o, s, 3, d, key="oid", other="id", cell=4.0).collect()}
    shape = {r.id: [(p.x, p.y) for p in r.pts] for r in lines.collect()}
    dist = lambda p, l: math.dist(p, S._nearest_on(p, *l))
    want = {(i, k) for i, x, y in objs for k in sorted(shape, key=lambda k: (dist((x, y), shape[k]), k))[:3]}
    assert got == want
    near = {(r.oid, r.id) for r in SP.within(o, s, 2.5, d, 4.0).collect()}
    assert near == {(i, k) for i, x, y in objs for k in shape if dist((x, y), shape[k]) <= 2.5}


def test_matching(spark, small):
    lanes = model.with_bounds(small.lanelets, model.with_points(small.linestrings, small.points))
    shapes = M.lane_shapes(lanes)
    o = spark.createDataFrame([(1, 5.0, 1.5, 0.0, (1.0, 0.0, 0.0, 1.0), 1.0)], "object_id long, x double, y double, yaw double, cov struct<xx: double, xy: double, yx: double, yy: double>, kappa double")
    got = M.deterministic(o, shapes, 1.0).orderBy("rank").collect()
    assert [(r.lane_id, r.inv, r.distance) for r in got] == [(1, False, 0), (1, True, 0)]
    p = M.probabilistic(o, shapes, 2.0).orderBy("rank").collect()
    assert (p[0].lane_id, p[0].inv) == (1, False) and p[0].mahalanobis == pytest.approx(0) and p[1].lane_id == 3
    kept = M.compliant(M.deterministic(o, shapes, 2.0), G.passable(small, R.create("de", "vehicle"))).collect()
    assert {(r.lane_id, r.inv) for r in kept} == {(1, False), (3, False), (3, True)}
    with pytest.raises(Exception, match="singular"):
        M.probabilistic(o.withColumn("cov", F.expr("named_struct('xx', 0D, 'xy', 0D, 'yx', 0D, 'yy', 0D)")), shapes, 2.0).collect()
    assert M.close_to(o, shapes, 0.0).count() == 1


def test_validation(spark, small):
    assert V.validate(small, checks="mapping.*", participants=("vehicle",)).isEmpty()
    bad = small.with_(
        points=small.points.union(spark.createDataFrame([(99, 0.01, 0.0, 0.0, {})], model.SCHEMAS["points"])),
        linestrings=small.linestrings.union(spark.createDataFrame([(500, [1, 1, 2], {"typo": "x"})], model.SCHEMAS["linestrings"])),
        lanelets=small.lanelets.withColumn("attrs", A.set_attributes(F.col("attrs"), one_way="perhaps", location="moon")),
    )
    found = {r.check_name for r in V.validate(bad).collect()}
    assert found == {"mapping.points_too_close", "mapping.duplicated_points", "mapping.unknown_tags", "mapping.mandatory_tags", "mapping.bool_tags", "mapping.unknown_tag_value"}
    assert V.available("MAPPING.bool_tags,routing.*") == ["mapping.bool_tags", "routing.graph_is_valid"]
    assert {(r.check_name, r.severity, r.n) for r in V.report(V.points_too_close(bad)).collect()} == {("mapping.points_too_close", "Warning", 2)}


def test_files(spark, small, tmp_path):
    pj = J.LocalCartesian(J.Origin(49, 8.4))
    path = str(tmp_path / "map.osm")
    osm.save(small, path, pj)
    got = osm.load(spark, path, pj)
    assert got.errors.isEmpty()
    back = got.map
    for n in ("linestrings", "regelems", "regelem_params"):
        assert sorted(map(str, getattr(back, n).collect())) == sorted(map(str, getattr(small, n).collect()))
    assert {r.id: (r.left, r.right, r.attrs) for r in back.lanelets.collect()} == {r.id: (r.left, r.right, r.attrs) for r in small.lanelets.collect()}
    a, b = ({r.id: (r.x, r.y) for r in m.points.collect()} for m in (back, small))
    assert all(a[i] == pytest.approx(b[i], abs=1e-4) for i in b)
    osm.save(small, str(tmp_path / "map.bin"))
    assert sorted(map(str, osm.load(spark, str(tmp_path / "map.bin")).map.lanelets.collect())) == sorted(map(str, small.lanelets.collect()))
    with pytest.raises(InvalidInputError):
        osm.load(spark, "map.xyz")
    assert osm.supported() == {"readers": [".bin", ".osm"], "writers": [".bin", ".osm"]}


def test_broken_file(spark, tmp_path):
    path = tmp_path / "broken.osm"
    path.write_text('<osm><node id="1" lat="49" lon="8"/><node id="9" lat="1" lon="1" action="delete"/><way id="2"><nd ref="1"/><nd ref="5"/></way><relation id="3"><member type="node" ref="1" role=""/><member type="way" ref="77" role=""/><tag k="type" v="lanelet"/></relation><relation id="4"><tag k="type" v="regulatory_element"/></relation></osm>')
    got = osm.read(spark, str(path))
    found = {(r.kind, r.id) for r in got.errors.collect()}
    assert {("way", 2), ("relation", 3), ("lanelet", 3), ("regulatory_element", 4)} <= found
    assert [r.id for r in got.map.points.collect()] == [1] and got.map.linestrings.first().point_ids == []
    with pytest.raises(MapFormatError):
        osm.load(spark, str(path))
    assert osm.chain([(1, 10, 11), (2, 12, 11), (3, 12, 10)]) == [[(1, False), (2, True), (3, False)]] and osm.chain([(1, 1, 2)]) is None


def test_stream(spark, small, tmp_path):
    from roadweave.streaming.matching import match_stream

    lanes = model.with_bounds(small.lanelets, model.with_points(small.linestrings, small.points))
    rows = spark.createDataFrame([(1, 5.0, 1.5), (1, 5.0, 1.5), (2, 15.0, 1.0)], "object_id long, x double, y double").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/poses")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/poses")
    q = match_stream(stream, M.lane_shapes(lanes), 0.5).writeStream.format("memory").queryName("matched").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.object_id, r.lane_id, r.inv) for r in spark.table("matched").collect()}
    assert got == {(1, 1, False), (1, 1, True), (2, 2, False), (2, 2, True)}


def test_new_ids(spark):
    df = spark.createDataFrame([(5, "a"), (None, "c"), (None, "b")], "id bigint, name string")
    got = {r.name: r.id for r in model.next_ids(df, 1000, ["name"]).collect()}
    assert got == {"a": 5, "b": 1001, "c": 1002}


def test_the_smaller_side_of_a_range_join_is_listed_in_more_cells(spark, monkeypatch):
    """Either side's boxes may be grown: the pairs are the same; nearest shapes grow those of the fewer rows."""
    o = spark.range(60).selectExpr("id AS object_id", "(id * 37 % 101) / 8D AS x", "(id * 53 % 97) / 8D AS y").selectExpr("*", "struct(x AS xmin, y AS ymin, x AS xmax, y AS ymax) AS abox")
    s = spark.range(9).selectExpr("id", "array(struct(id * 1.5D AS x, 2D AS y, 0D AS z), struct(id * 1.5D + 1 AS x, 7D AS y, 0D AS z)) AS pts").selectExpr("*", "struct(pts[0].x AS xmin, 2D AS ymin, pts[1].x AS xmax, 7D AS ymax) AS bbox")
    near = lambda grown: sorted((x.object_id, x.id, x.distance) for x in SP.within(o, s, 2.5, line_distance("pts", "x", "y"), 2.0, grown=grown).collect())
    assert near("a") == near("b") and len(near("a")) > 50
    sides = []
    monkeypatch.setattr(SP, "box_pairs", lambda *a, f=SP.box_pairs, **k: sides.append(k.get("grown")) or f(*a, **k))
    got = {(x.object_id, x["rank"]): x.distance for x in SP.knn(o, s, 2, line_distance("pts", "x", "y"), key="object_id", other="id", cell=2.0).collect()}
    assert sides[0] == "b" and len(got) == 120
    all_ = {}
    for q, d in sorted((x.object_id, x.distance) for x in SP.within(o, s, 99.0, line_distance("pts", "x", "y"), 99.0).collect()):
        all_.setdefault(q, []).append(d)
    assert got == {(q, i + 1): d[i] for q, d in all_.items() for i in range(2)}
