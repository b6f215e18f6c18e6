"""Which lanes join a route, on graphs small enough to see; and routes end to end."""

import pytest
from pyspark.sql import functions as F

from roadweave.operators import graph as G
from roadweave.operators import routes as RT
from roadweave.operators import search as S

NEXT, L, R_, AL, AR, X = G.SUCCESSOR, G.LEFT, G.RIGHT, G.ADJACENT_LEFT, G.ADJACENT_RIGHT, G.CONFLICTING


def local(path, extra, edges, final=()):
    v = lambda i: (i, False)
    nodes = [{"v": v(i), "on_route": i in path, "first": i == path[0], "last": i == path[-1], "final": i in final} for i in [*path, *extra]]
    return RT.Local(nodes, [(v(a), v(b), r) for a, b, r in edges])


def grown(*a, **k):
    return sorted(i for i, _ in local(*a, **k).grown())


def both(a, b):
    return [(a, b, L), (b, a, R_)]


def test_a_parallel_lane_joins_while_it_leads_back():
    edges = [(1, 2, NEXT), (2, 3, NEXT), (11, 12, NEXT), (12, 13, NEXT), *both(1, 11), *both(2, 12), *both(3, 13)]
    assert grown([1, 2, 3], [11, 12, 13], edges, final={3, 13}) == [11, 12, 13]
    # the other lane ends before the route does: its last part has no way but back
    assert grown([1, 2, 3], [11, 12], [e for e in edges if 13 not in e[:2]], final={3}) == [11, 12]


def test_a_dead_end_does_not_join():
    edges = [(1, 2, NEXT), (2, 3, NEXT), (2, 9, NEXT), (9, 3, X), (3, 9, X)]
    assert grown([1, 2, 3], [9], edges, final={3}) == []


def test_lanes_beside_the_end_are_not_driven_past_it():
    edges = [(1, 2, NEXT), *both(1, 11), *both(2, 12), (11, 12, NEXT), (12, 2, NEXT)]
    assert grown([1, 2], [11, 12], edges, final={2, 12}) == [11, 12]


def test_a_way_out_and_back_joins_only_if_the_route_conflicts_all_along():
    # 1 -> 2 -> 3 -> 4 is the route; 1 -> 8 -> 9 -> 4 leaves and comes back
    ways = [(1, 2, NEXT), (2, 3, NEXT), (3, 4, NEXT), (1, 8, NEXT), (8, 9, NEXT), (9, 4, NEXT)]
    clash = lambda a, b: [(a, b, X), (b, a, X)]
    assert grown([1, 2, 3, 4], [8, 9], [*ways, *clash(8, 2), *clash(9, 3)], final={4}) == [8, 9]
    assert grown([1, 2, 3, 4], [8, 9], [*ways, *clash(8, 2), (9, 2, X)], final={4}) == []


def test_lanes_split_where_the_road_does():
    edges = [(1, 2, NEXT), (2, 3, NEXT), (2, 4, NEXT), (3, 5, NEXT), (4, 6, NEXT), *both(1, 11), (11, 12, NEXT), *both(2, 12)]
    got = local([1, 2, 3, 5], [4, 6, 11, 12], edges).lanes()
    lane = {i: n for (i, _), n, _, _ in got}
    assert lane[1] == lane[2] and lane[3] == lane[5] and lane[4] == lane[6] and lane[11] == lane[12]
    assert len({lane[i] for i in (1, 3, 4, 11)}) == 4
    assert {i: p for (i, _), _, p, _ in got} == {1: 0, 2: 1, 3: 0, 5: 1, 4: 0, 6: 1, 11: 0, 12: 1}


def test_a_round_trip_is_one_lane():
    got = local([1, 2, 3, 1], [], [(1, 2, NEXT), (2, 3, NEXT), (3, 1, NEXT)]).lanes()
    assert {n for _, n, _, _ in got} == {0} and all(loop for *_, loop in got)


@pytest.fixture(scope="module")
def grid(spark):
    """Three lanes of six pieces; changes between neighbours but where the piece is the third."""
    v = lambda lane, k: (lane * 100 + k, False)
    rows = []
    for lane in range(3):
        for k in range(6):
            if k < 5:
                rows.append((v(lane, k), v(lane, k + 1), 0, 10.0, NEXT))
            for to, change, beside in ((lane + 1, L, AL), (lane - 1, R_, AR)):
                if 0 <= to < 3:
                    rows.append((v(lane, k), v(to, k), 0, 3.0, beside if k == 3 else change))
    return G.Graph(None, spark.createDataFrame(rows, f"src {S.V}, dst {S.V}, cost_id int, cost double, relation int"), 1)


def test_routes_from_end_to_end(grid, spark):
    req = spark.createDataFrame([(1, (0, False), (105, False)), (2, (0, False), (0, False)), (3, (5, False), (0, False))], f"query long, v {S.V}, target {S.V}")
    r = RT.build(grid, req)
    size = {x.query: (x.lanes, x.size) for x in RT.lane_counts(r).collect()}
    assert size[1] == (3, 18) and 3 not in size
    at = spark.createDataFrame([(1, (2, False)), (1, (203, False))], f"query long, v {S.V}")
    rest = {x.v.id: [y.id for y in x.lane] for x in RT.remaining_lane(r, at).collect()}
    assert rest == {2: [2, 3, 4, 5], 203: [203, 204, 205]}
    full = {x.v.id: [y.id for y in x.lane] for x in RT.full_lane(r, at).collect()}
    assert full == {2: list(range(6)), 203: list(range(200, 206))}
    path = r.paths.where("query = 1").first().path
    left = {x.v.id: [y.id for y in x.path] for x in RT.remaining_path(r, spark.createDataFrame([(1, (path[3].id, False)), (1, (999, False))], f"query long, v {S.V}")).collect()}
    assert left == {path[3].id: [p.id for p in path[3:]], 999: []}
    assert RT.problems(r).count() == 0
    assert {x.other.id for x in RT.beside(r, L | AL).where("query = 1 and v.id = 3").collect()} == {103, 203}
    seen = RT.visits(r, spark.createDataFrame([(1, (0, False))], f"query long, v {S.V}")).collect()
    assert len(seen) == 18 and [x.cost for x in seen] == sorted(x.cost for x in seen)


def test_both_searches_give_the_same_trees_and_paths(grid, spark):
    e = grid.edges
    starts = spark.createDataFrame([(7, (0, False)), (8, (203, False)), (9, (777, False))], f"query long, v {S.V}")
    key = lambda rows: sorted((x.query, x.v.id, round(x.cost, 6), x.hops, x.changes, x.pred and x.pred.id) for x in rows)
    assert key(S.heap_trees(e, starts).collect()) == key(S.relax(e, starts).collect())
    ask = spark.createDataFrame([("a", (0, False), (205, False)), ("b", (205, False), (0, False)), ("c", (1, False), (1, False))], f"query string, v {S.V}, target {S.V}")
    one = {x.query: (x.cost, [v.id for v in x.path]) for x in S.heap_paths(e, ask).collect()}
    two = {x.query: (x.cost, [v.id for v in x.path]) for x in S.joined_paths(e, ask).collect()}
    assert one == two and set(one) == {"a", "c"} and one["c"] == (0.0, [1]) and one["a"][0] == 56.0


@pytest.mark.parametrize("most", [500_000, 20, 1])
def test_islands_give_the_same_trees_and_paths(grid, spark, monkeypatch, most):
    """Islands are found and searched apart, those too large for a task (of more than `most` edges) by joins; a search never sees another island."""
    monkeypatch.setattr(S, "ISLAND_EDGES", most)
    monkeypatch.setattr(S, "CHUNK_EDGES", 7)
    monkeypatch.setattr(S, "ISLAND_SEARCHES", 2)
    v = lambda i: (i, False)
    far = [(v(-1000 + i), v(-1000 + (i + 1) % 9), 0, 2.0, NEXT) for i in range(9)] + [(v(5000), v(5001), 0, 1.0, NEXT)]
    e = grid.edges.unionByName(spark.createDataFrame(far, grid.edges.schema))
    low = {x.v >> 1: x.island >> 1 for x in S.islands(e.selectExpr("src.id * 2 AS a", "dst.id * 2 AS b")).collect()}
    assert {i: low[i] for i in (0, 205, -1000, -992, 5000, 5001)} == {0: 0, 205: 0, -1000: -1000, -992: -1000, 5000: 5000, 5001: 5000} and len(low) == 29
    starts = spark.createDataFrame([(1, v(0)), (2, v(1)), (3, v(203)), (4, v(-995)), (5, v(777)), (6, v(100)), (7, v(5001))], f"query long, v {S.V}")
    key = lambda rows: sorted((x.query, x.v.id, round(x.cost, 6), x.hops, x.changes, x.pred and x.pred.id, x.leaf) for x in rows)
    assert key(S.parted_trees(e, starts).collect()) == key(S.heap_trees(e, starts).collect())
    assert key(S.parted_trees(e, starts, max_cost=15.0, max_hops=3).collect()) == key(S.heap_trees(e, starts, max_cost=15.0, max_hops=3).collect())
    ask = spark.createDataFrame([("a", v(0), v(205)), ("b", v(205), v(0)), ("c", v(1), v(1)), ("d", v(-992), v(-993)), ("e", v(0), v(-1000)), ("f", v(777), v(777)), ("g", v(2), v(104)), ("h", v(2), v(777))], f"query string, v {S.V}, target {S.V}")
    way = lambda df: {x.query: (x.cost, [v.id for v in x.path]) for x in df.collect()}
    got = way(S.parted_paths(e, ask))
    assert got == way(S.heap_paths(e, ask)) and set(got) == {"a", "c", "d", "f", "g"} and len(got["d"][1]) == 9


def test_legs_of_different_requests_keep_apart(grid, spark):
    """Request 1 by many stops and request 2 by few: no leg of one is taken for one of the other."""
    v = lambda i: (i, False)
    stops = [v(i % 2 * 100) for i in range(1003)]
    ask = spark.createDataFrame([(1, stops), (2, [v(0), v(1)])], f"query long, stops array<{S.V}>")
    got = {x.query: (x.cost, len(x.path)) for x in S.shortest_paths_via(grid.edges, ask).collect()}
    assert got == {1: (1002 * 3.0, 1003), 2: (10.0, 2)}


def test_large_graphs_search_by_islands(grid, spark, monkeypatch):
    """No rounds of joins over the whole graph where what hangs together fits a task."""
    monkeypatch.setattr(S, "BROADCAST_EDGES", 3)
    monkeypatch.setattr(S, "relax", None)
    ask = spark.createDataFrame([(1, (0, False), (205, False))], f"query long, v {S.V}, target {S.V}")
    assert [x.cost for x in S.shortest_paths(grid.edges, ask).collect()] == [56.0]
    assert S.reachable(grid.edges, ask.select("query", "v"), 20.0).count() == 7


def test_a_worker_reads_many_routes_one_after_another(spark):
    """Routes whose rows come to one task keep apart, and each is answered by itself."""
    v = lambda i: (i, i % 2 == 1)
    nodes = [(q, v(i), i < 3, i == 0, i == 2, False) for q in range(50) for i in range(3 + q % 2)]
    edges = [(q, v(i), v(i + 1), NEXT) for q in range(50) for i in range(2 + q % 2)]
    n = spark.createDataFrame(nodes, f"query long, v {S.V}, on_route boolean, first boolean, last boolean, final boolean")
    e = spark.createDataFrame(edges, f"query long, src {S.V}, dst {S.V}, relation int")
    got = RT._by_query(n, e, RT.Local.lanes, ", lane int, pos int, loop boolean").collect()
    assert sorted((x["query"], x.v.id, x.v.inv, x.lane, x.pos, x.loop) for x in got) == [(q, *v(i), 0, i, False) for q in range(50) for i in range(3 + q % 2)]


def test_chains_and_loops(spark):
    members = [(i,) for i in range(40)]
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (32, 33), (33, 30)]
    got = {x.a: (x.up, x.steps) for x in G.chains(spark.createDataFrame(members, "a long"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == (0, i) for i in range(21)) and all(got[i] == (i, 0) for i in range(21, 30))
    assert [got[i] for i in range(30, 34)] == [(30, 0), (30, 1), (30, 2), (30, 3)]


def test_everything_beside_without_an_end(spark):
    v = lambda i: (i, False)
    rows = [(v(i), v(i + 1), 0, 1.0, L) for i in range(90)] + [(v(200), v(201), 0, 1.0, L), (v(201), v(202), 0, 1.0, L), (v(202), v(201), 0, 1.0, L)]
    g = G.Graph(None, spark.createDataFrame(rows, f"src {S.V}, dst {S.V}, cost_id int, cost double, relation int"), 1)
    got = G.all_beside(g, L)
    assert got.where("v.id = 0").count() == 90 and {x.other.id for x in got.where("v.id = 200").collect()} == {201, 202}
    assert G.relation_between(g, spark.createDataFrame([(v(0), v(1))], f"src {S.V}, dst {S.V}")).select(F.col("relation")).first().relation == L
