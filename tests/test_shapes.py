"""Shape kernels and the operators that change maps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave import __main__ as cli
from roadweave.errors import GeometryError, InvalidInputError
from roadweave.functions import geometry as GE
from roadweave.functions import polylines as P
from roadweave.functions import shapes as S
from roadweave.functions import text as T
from roadweave.functions.flat import line_distance, ring_distance
from roadweave.model import SCHEMAS, RoadMap
from roadweave.operators import areas as AR
from roadweave.operators import editing as E
from roadweave.operators import regelems as RE
from roadweave.operators import spatial as SP
from roadweave.operators import usages as U
from roadweave.operators import validation as V

LINE = "array<struct<id: long, x: double, y: double, z: double>>"


def line(*xy, z=0.0):
    return [(i, float(x), float(y), z) for i, (x, y) in enumerate(xy)]


def test_outline_of_touching_rings():
    a = [(0, 0, 0), (0, 2, 0), (2, 2, 0), (2, 0, 0)]
    b = [(2, 0, 0), (2, 2, 0), (4, 2, 0), (4, 0, 0)]
    c = [(2, 2, 0), (2, 4, 0), (4, 4, 0), (4, 2, 0)]
    got = S.outline([a, b, c])
    assert abs(S.signed_area([p[:2] for p in got])) == 12 and len(got) == len(set(got))
    assert S.outline([a[::-1], b]) == S.outline([a, b]) and S.outline([]) == []
    with pytest.raises(GeometryError):
        S.outline([a, c])


def test_heights():
    flat, bridge = [(0, 0, 0.0), (10, 0, 0.0)], [(5, -5, 4.0), (5, 5, 6.0)]
    assert S.gaps(flat, bridge) == [5.0]
    assert S.height_gap([(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0)], [(3, 0, 2.5), (3, 1, 2.5), (4, 1, 2.5)]) == 1.5
    sq = lambda x: [(x, 0), (x, 2), (x + 2, 2), (x + 2, 0)]
    assert S.meet(sq(0), sq(1)) and S.meet(sq(0), sq(2)) and not S.meet(sq(0), sq(3)) and S.meet([(0, 0), (0, 9), (9, 9), (9, 0)], [(4, 4), (4, 5), (5, 5)])


def test_flat_kernels_match_expressions(spark):
    g = np.random.default_rng(3)
    rows = [(i, line(*g.uniform(0, 20, (int(n), 2)).round(3)), float(x), float(y)) for i, (n, x, y) in enumerate(zip(g.integers(0, 7, 200), g.uniform(-5, 25, 200), g.uniform(-5, 25, 200)))]
    rows[0] = (0, None, 1.0, 1.0)
    df = spark.createDataFrame(rows, f"i int, pts {LINE}, x double, y double")
    p = F.struct("x", "y", F.lit(0.0).alias("z"))
    got = df.select("i", line_distance("pts", "x", "y").alias("a"), P.distance_to(F.col("pts"), p).alias("b"), ring_distance("pts", "x", "y").alias("c"), P.distance_to_ring(F.col("pts"), p).alias("d")).where("i > 0").collect()
    for r in got:
        assert r.a == pytest.approx(r.b, abs=1e-9) and r.c == pytest.approx(r.d, abs=1e-9)


def test_columns_of_kernels(spark):
    df = spark.createDataFrame([(line((0, 0), (10, 0)), line((5, -5), (5, 5), z=5.0), line((0, 0), (0, 4), (4, 4), (4, 0)))], f"a {LINE}, b {LINE}, r {LINE}")
    r = df.select(
        GE.crossings("a", "b").alias("x"), GE.lines_meet_3d("a", "b", F.lit(3.0)).alias("low"), GE.lines_meet_3d("a", "b", F.lit(6.0)).alias("high"), GE.closest_points_3d("a", "b").alias("c"),
        GE.border_distance_3d(F.col("r"), F.struct(F.lit(2.0).alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"))).alias("d"), GE.touches(F.col("r"), F.reverse("r")).alias("t"), GE.ring_to_ring("r", "r").alias("zero"),
        GE.near_zero(F.lit(1e-12)).alias("nil"), GE.to_3d(GE.to_2d(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))), 3.0).alias("p"), GE.segment_at(F.col("r"), F.lit(3)).alias("none"),
        GE.distance_to_lines(F.array("a", "b"), F.struct(F.lit(5.0).alias("x"), F.lit(7.0).alias("y"), F.lit(0.0).alias("z"))).alias("near"),
    ).first()
    assert [(p.x, p.y) for p in r.x] == [(5, 0)] and (r.low, r.high, r.c.distance, r.d, r.t, r.zero, r.nil, r.p.z, r.none, r.near) == (False, True, 5.0, 1.0, True, 0.0, True, 3.0, None, 2.0)
    with pytest.raises(GeometryError):
        GE.max_curve_speed()


def test_areas_with_holes(spark):
    outer, hole = line((0, 0), (0, 10), (10, 10), (10, 0)), line((4, 4), (4, 6), (6, 6), (6, 4))
    df = spark.createDataFrame([(outer, [hole], float(x), float(y)) for x, y in ((1, 1), (5, 5), (4, 5), (12, 5), (4.5, 5))], f"o {LINE}, h array<{LINE}>, x double, y double")
    p = F.struct("x", "y", F.lit(0.0).alias("z"))
    got = [tuple(r) for r in df.select(AR.inside(F.col("o"), F.col("h"), p), AR.distance(F.col("o"), F.col("h"), p)).collect()]
    assert got == [(True, 0.0), (False, 1.0), (True, 0.0), (False, 2.0), (False, 0.5)]


@pytest.fixture(scope="module")
def small(spark):
    ref = lambda i, inv=False: (i, inv)
    return RoadMap.of(
        spark,
        points=[(i, float(i % 3), float(i // 3), 0.0, {}) for i in range(1, 10)],
        linestrings=[(11, [1, 2, 3], {"type": "line_thin"}), (12, [4, 5, 6], {"type": "line_thin"}), (13, [7, 8, 9], {"type": "stop_line"})],
        polygons=[(21, [1, 2, 5, 4], {"type": "traffic_sign", "subtype": "de274-50"})],
        lanelets=[(31, ref(12), ref(11), None, [41], {"subtype": "road"}), (32, ref(13), ref(12), None, [42], {"subtype": "road"}), (33, ref(13), ref(12), None, [], {})],
        regelems=[(41, "right_of_way", {}), (42, "traffic_sign", {}), (43, "speed_limit", {"sign_type": "de274-30"})],
        regelem_params=[(41, "right_of_way", 0, "lanelet", 31, False), (41, "yield", 0, "lanelet", 32, False), (42, "refers", 0, "polygon", 21, False), (42, "refers", 1, "point", 99, False), (42, "ref_line", 0, "lanelet", 33, False)],
    )


def test_closure_follows_rules_to_the_end(small, spark):
    """Lane 31 names rule 41, that lane 32, that rule 42, that lane 33."""
    got = E.closure(small, lanelets=spark.createDataFrame([(31,)], "id long"))
    assert {r.id for r in got.lanelets.collect()} == {31, 32, 33} and {r.id for r in got.regelems.collect()} == {41, 42}


def test_rules_are_made_changed_and_measured(small, spark):
    assert RE.available() == ["all_way_stop", "right_of_way", "speed_limit", "traffic_light", "traffic_sign"]
    for kind, params in (("traffic_light", {}), ("right_of_way", {"yield": [("lanelet", 1)]}), ("all_way_stop", {"ref_line": [("linestring", 1)], "yield": []}), ("nothing", {})):
        with pytest.raises(InvalidInputError):
            RE.create(spark, kind, 50, params)
    m = RE.create(spark, "traffic_light", 50, {"refers": [("polygon", 21), ("linestring", 13)]}, {"dynamic": "yes"}).onto(small)
    m = RE.add(m, "refers", spark.createDataFrame([(50, "linestring", 12), (50, "linestring", 13)], "regelem_id long, kind string, ref_id long"))
    m = RE.set_stop_line(m, spark.createDataFrame([(50, 11)], "regelem_id long, ref_id long"))
    m = RE.remove(m, "refers", spark.createDataFrame([(50, 21)], "regelem_id long, ref_id long"))
    one = RE.traffic_lights(m).first()
    assert (one.id, one.lights, one.stop_line) == (50, [13, 12], 11)
    d = {r.regelem_id: r.distance for r in RE.distances(m, spark.createDataFrame([(50, 1.0, 3.0), (43, 0.0, 0.0), (42, 1.0, 0.5)], "regelem_id long, x double, y double")).collect()}
    assert d[50] == pytest.approx(1 / math.sqrt(5)) and math.isinf(d[43]) and d[42] < 1
    assert [tuple(r) for r in E.expired(m).collect()] == [(42, "refers", "point", 99)]
    assert {r.id: (r.signs, r.cancelling) for r in RE.signs(m).collect()}[42] == ([21], [])
    assert {r.id for r in U.regelems_that_hold(m, spark.createDataFrame([("polygon", 21)], "kind string, id long")).collect()} == {42}
    assert {r.id for r in U.lanes_that_hold(m, spark.createDataFrame([(11,)], "id long")).collect()} == {31}
    RE.register("gate", lambda roles: None if roles.get("refers") else "needs a gate")
    assert RE.of_kind(RE.create(spark, "gate", 51, {"refers": [("linestring", 13)]}).onto(m), "gate").count() == 1
    RE._FACTORY.pop("gate")


def test_lanes_are_changed(small, spark):
    one = spark.createDataFrame([(31,)], "id long")
    new = F.struct(F.lit(13).cast("long").alias("id"), F.lit(True).alias("inv"))
    got = E.set_bounds(small, one, left=new).lanelets.where("id = 31").first()
    assert (got.left.id, got.left.inv, got.right.id) == (13, True, 11)
    got = E.set_bounds(small, one, left=new, inv=True).lanelets.where("id = 31").first()  # seen backwards, the left bound is the right one
    assert (got.right.id, got.right.inv, got.left.id, got.left.inv) == (13, False, 12, False)
    pairs = spark.createDataFrame([(31, 43), (31, 41)], "id long, regelem_id long")
    more = E.add_rules(small, "lanelets", pairs)
    assert more.lanelets.where("id = 31").first().regelem_ids == [41, 43]
    assert E.remove_rules(more, "lanelets", pairs).lanelets.where("id = 31").first().regelem_ids == []
    assert E.set_centreline(small, one, F.lit(12)).lanelets.where("id = 31").first().centerline_id == 12


def test_primitives_as_text(small, spark):
    t = small.lanelets.where("id = 31").select(T.lane(F.col("id"), F.lit(True), F.col("left"), F.col("right")), T.tags(F.col("attrs"))).first()
    assert tuple(t) == ("lane 31 turned (left 12, right 11)", "{subtype: road}")
    p = small.points.where("id = 4").select(T.point(F.struct("id", "x", "y", "z"))).first()[0]
    assert p == "point 4 (1, 1, 0)"
    l = small.linestrings.where("id = 11").select(T.line(F.struct("id", F.lit(True).alias("inv")), F.col("point_ids"))).first()[0]
    assert l == "line 11 turned [3, 2, 1]"


def test_own_checks_and_the_command_line(spark, tmp_path, capsys):
    f = tmp_path / "map.osm"
    f.write_text("""<?xml version="1.0"?><osm version="0.6"><node id="1" lat="49" lon="8.4"/><node id="2" lat="49.0001" lon="8.4"/><way id="3"><nd ref="1"/><nd ref="2"/><tag k="type" v="line_thin"/><tag k="mystery" v="1"/></way></osm>""")
    assert cli.main(["--print", "--filter", "mapping.b.*"]) == 0 and capsys.readouterr().out.split() == ["mapping.bool_tags"]
    assert cli.main([str(f), "--filter", "mapping.unknown_tags", "--participants", ""], spark) == 1
    assert "unknown tag mystery" in capsys.readouterr().out
    assert cli.main([str(f), "--filter", "mapping.bool_tags", "--participants", ""], spark) == 0
    V.register("mine.lines", lambda m: V.issue(m.linestrings, "mine.lines", "Warning", "LineString", "is a line"))
    try:
        assert "mine.lines" in V.available() and V.validate(RoadMap.of(spark, linestrings=[(1, [], {})]), checks="mine.*").count() == 1
        with pytest.raises(InvalidInputError):
            V.register("mine.lines", lambda m: m)
        with pytest.raises(InvalidInputError):
            V.register("other", lambda m: m, kind="what")
    finally:
        V.unregister("mine.lines")


def test_schemas_are_kept(small):
    for n, df in small.layers().items():
        assert len(df.columns) == len(SCHEMAS[n].split(", ")) or "struct" in SCHEMAS[n] or "map" in SCHEMAS[n]


def test_segments_that_are_far_apart_are_not_tried(monkeypatch):
    """Work along two lines grows with their length, not with its square; what comes out is that of all pairs."""
    g = random.Random(3)
    for n in (2, 3, 9, 30):
        for dims in (2, 3):
            a, b = ([tuple(x * 10.0 + g.choice([0, g.random()]) if k == 0 else g.choice([0.0, 1.0, g.uniform(-3, 3)]) for k in range(dims)) for x in range(n)] for _ in range(2))
            fast = S.closest_pair(a, b), S.crossings([p[:2] for p in a], [p[:2] for p in b]), S.lines_meet([p[:2] for p in a], [p[:2] for p in b])
            with monkeypatch.context() as m:
                m.setattr(S, "_gap", lambda *_: 0.0)
                slow = S.closest_pair(a, b), S.crossings([p[:2] for p in a], [p[:2] for p in b]), bool(fast[1])
            assert fast == slow
    tried = []
    monkeypatch.setattr(S, "_line_pair", lambda *x, f=S._line_pair: tried.append(1) or f(*x))
    monkeypatch.setattr(S, "crossing", lambda *x, f=S.crossing: tried.append(1) or f(*x))
    a, b = ([(10.0 * i, y) for i in range(100)] for y in (0.0, 2.0))
    assert S.closest_pair(a, b)[0] == (0.0, 0.0) and S.crossings(a, b) == [] and not S.lines_meet(a, b)
    assert len(tried) < 1000


def test_long_kernels_are_spread(spark):
    got = SP.spread(spark.range(100).coalesce(1))
    assert got.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism and got.count() == 100
