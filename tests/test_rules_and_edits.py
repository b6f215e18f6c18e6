"""Regulatory elements, map edits, graph files."""

import pytest
from pyspark.sql import functions as F

from roadweave import model
from roadweave.errors import InvalidInputError
from roadweave.operators import editing as D
from roadweave.operators import graph as G
from roadweave.operators import regelems as E
from roadweave.operators import rules as R
from roadweave.sources import graphs


@pytest.fixture(scope="module")
def m(spark):
    pts = [(i, float(i), float(i % 2), 0.0, {}) for i in range(1, 7)]
    lines = [(11, [1, 3], {"type": "line_thin", "subtype": "solid"}), (12, [2, 4], {"type": "line_thin", "subtype": "solid"}), (13, [3, 5], {"type": "line_thin", "subtype": "solid"}), (14, [4, 6], {"type": "line_thin", "subtype": "solid"}), (15, [5, 6], {"type": "stop_line"}), (16, [1, 2], {"type": "traffic_sign", "subtype": "de274-50"})]
    lanes = [(21, (11, False), (12, False), None, [31, 34], {"subtype": "road"}), (22, (13, False), (14, False), None, [32], {"subtype": "road"})]
    regs = [(31, "traffic_light", {}), (32, "right_of_way", {}), (33, "all_way_stop", {}), (34, "speed_limit", {}), (35, "traffic_sign", {"sign_type": "de310"}), (36, "right_of_way", {})]
    p = [(31, "refers", 0, "linestring", 16, False), (31, "ref_line", 0, "linestring", 15, False), (32, "right_of_way", 0, "lanelet", 21, False), (32, "yield", 0, "lanelet", 22, False), (33, "yield", 0, "lanelet", 21, False), (33, "yield", 1, "lanelet", 22, False), (33, "ref_line", 0, "linestring", 15, False), (33, "ref_line", 1, "linestring", 16, False), (34, "refers", 0, "linestring", 16, False), (31, "refers", 1, "linestring", 999, False)]
    return model.RoadMap.of(spark, points=pts, linestrings=lines, lanelets=lanes, regelems=regs, regelem_params=p)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_regulatory_elements(m):
    assert rows(E.parameters(m, "refers").select("regelem_id", "ref_id")) == [(31, 16), (34, 16)]
    assert rows(E.roles(m).select("regelem_id", "size")) == [(31, 3), (32, 2), (33, 4), (34, 1)]
    assert rows(E.traffic_lights(m)) == [(31, [16], 15)]
    assert rows(E.manoeuvres(m)) == [(32, 21, "RightOfWay"), (32, 22, "Yield")]
    assert rows(E.stop_lines(m)) == [(33, 21, 15), (33, 22, 16)]
    assert rows(E.sign_types(m)) == [(34, "de274-50"), (35, "de310")]
    assert rows(E.problems(m)) == [(36, "needs lanes that go and lanes that yield")]
    assert rows(E.on_lanes(m, "traffic_light")) == [(31, 21, 0)] or rows(E.on_lanes(m, "traffic_light").select("lane_id", "regelem_id")) == [(21, 31)]
    box = {r.id: tuple(r.box) for r in E.boxes(m).collect()}
    assert box[34] == (1, 0, 2, 1)
    with pytest.raises(InvalidInputError):
        E.of_kind(m, "levitation")


def test_edits(spark, m):
    more = D.add(m, points=spark.createDataFrame([(1, 9.0, 9.0, 9.0, {}), (7, 0.0, 0.0, 0.0, {})], model.SCHEMAS["points"]))
    assert {(r.id, r.x) for r in more.points.where("id in (1, 7)").collect()} == {(1, 1.0), (7, 0.0)}
    part = D.closure(m, lanelets=spark.createDataFrame([(22,)], "id bigint"))
    assert rows(part.lanelets.select("id")) == [(21,), (22,)]  # its rule names the other lane
    assert {r.id for r in part.regelems.collect()} == {31, 32, 34}
    assert {r.id for r in part.linestrings.collect()} == {11, 12, 13, 14, 15, 16}
    one = lambda c: spark.range(1).select(c).first()[0]
    a = F.array(*map(F.lit, (1, 2, 3)))
    assert one(D.insert_at(a, 1, F.lit(9), F.lit(False))) == [1, 9, 2, 3] and one(D.insert_at(a, 1, F.lit(9), F.lit(True))) == [1, 2, 9, 3]
    assert one(D.erase_at(a, 0, F.lit(True))) == [1, 2] and one(D.erase_at(a, 0, F.lit(False))) == [2, 3]
    neg = model.RoadMap.of(spark, points=[(-1, 0.0, 0.0, 0.0, {}), (-2, 1.0, 0.0, 0.0, {})], linestrings=[(-3, [-1, -2], {})])
    assert D.positive_ids(neg).linestrings.first().point_ids == [1, 2]


def test_graph_files(m, tmp_path):
    g = G.build(m, R.create("de", "vehicle"), conflicts=False)
    graphs.graphml(g, str(tmp_path / "g.graphml"))
    graphs.graphviz(g, str(tmp_path / "g.dot"))
    assert '<edge source="n21" target="n22">' in (tmp_path / "g.graphml").read_text()
    assert 'n21 -> n22 [label="Successor", color="green"' in (tmp_path / "g.dot").read_text()
    with pytest.raises(InvalidInputError):
        graphs.graphml(g, "")
