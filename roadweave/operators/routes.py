"""Routes: a shortest path and all lanes beside it from which one still reaches its end by lane changes and without leaving the route for long.

Many routes are built at once. In each round the candidates (lanes with an edge
into the route) are found by joins for all of them; which of them stay is decided
for each route by itself, among its own lanes and their neighbours. The rounds
end when no route has grown.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RoadMap
from . import graph as G
from . import search as S
from .graph import checkpointed

DRIVABLE = G.SUCCESSOR | G.LEFT | G.RIGHT
SIDEWAYS = G.LEFT | G.RIGHT | G.ADJACENT_LEFT | G.ADJACENT_RIGHT
CLASH = G.CONFLICTING | G.ADJACENT_LEFT | G.ADJACENT_RIGHT
V = S.V


@dataclass(frozen=True)
class Routes:
    """paths: query, cost, path; lanes: query, v, lane (a number), pos (in the lane), loop; edges: query, src, dst, cost, relation; graph: the edges of the whole graph."""

    paths: DataFrame
    lanes: DataFrame
    edges: DataFrame
    graph: DataFrame


class Local:
    """A route's lanes and candidates, with the edges among them."""

    def __init__(self, nodes: list[dict], edges: list[tuple]):
        self.on = {n["v"] for n in nodes if n["on_route"]}
        self.first = next(n["v"] for n in nodes if n["first"])
        self.last = next(n["v"] for n in nodes if n["last"])
        self.final = {n["v"] for n in nodes if n["final"]}
        self.out, self.into = defaultdict(list), defaultdict(list)
        for s, d, r in sorted(edges):
            self.out[s].append((d, r))
            self.into[d].append((s, r))

    def _way(self, s, r) -> bool:
        """Drivable, and not on beyond the route's end."""
        return bool(r & DRIVABLE) and not (r == G.SUCCESSOR and s in self.final)

    def _clashes(self, v) -> bool:
        """Off the route, in conflict with it or beside it, and no lane change leads there and back."""
        if v in self.on:
            return False
        clash = False
        for d, r in self.out[v]:
            if d in self.on:
                if r & (G.LEFT | G.RIGHT) and any(b == v and q & (G.LEFT | G.RIGHT) for b, q in self.out[d]):
                    return False
                clash = clash or bool(r & (CLASH | G.LEFT | G.RIGHT))
        return clash

    def grown(self) -> list:
        """Vertices that join the route now."""
        followers, changes, seen = {}, {}, {self.first}
        todo = deque([self.first])
        while todo:
            v = todo.popleft()
            ways = [(d, r) for d, r in self.out[v] if self._way(v, r)]
            followers[v] = sum(r == G.SUCCESSOR for _, r in ways)
            changes[v] = sum(r != G.SUCCESSOR and d in self.on for d, r in ways)
            for d, _ in ways:
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        live = set(followers)

        def drop(v) -> None:
            live.discard(v)
            for s, r in self.into[v]:
                if s in live and self._way(s, r):
                    if r == G.SUCCESSOR:
                        followers[s] -= 1
                    elif v in self.on:
                        changes[s] -= 1

        # what leads nowhere goes, and then what led only there
        leaves = [v for v in sorted(live) if v != self.last and not followers[v] and not changes[v]]
        while leaves:
            v = leaves.pop()
            if v not in live:
                continue
            before = [s for s, r in self.into[v] if s in live and self._way(s, r)]
            drop(v)
            leaves += [s for s in before if s != self.last and not followers[s] and not changes[s]]

        clashing = {v for v in live if (followers[v] or changes[v]) and self._clashes(v)}
        allowed: set = set()
        for v in sorted(clashing):
            if any(r & DRIVABLE and s in self.on for s, r in self.into[v]):
                for path in self._paths(v, self._clashes, DRIVABLE):
                    if self._beside(path) or self._parallel(path):
                        allowed.update(path)
        for v in sorted(clashing - allowed):
            drop(v)
        return [v for v in live if (followers[v] or changes[v]) and v not in self.on]

    def _paths(self, start, may, mask):
        """Ways from start, depth first, each vertex entered once, as far as they go."""
        seen, path, forward = {start}, [start], True
        stack = [iter(self.out[start])]
        while stack:
            for d, r in stack[-1]:
                if r & mask and d not in seen and may(d):
                    seen.add(d)
                    path.append(d)
                    stack.append(iter(self.out[d]))
                    forward = True
                    break
            else:
                if forward:
                    yield list(path)
                forward = False
                stack.pop()
                path.pop()

    def _beside(self, path) -> bool:
        """Every vertex of the path is next to the route, by a lane change or without."""
        return all(any(r & SIDEWAYS and d in self.on for d, r in [*self.out[v], *self.into[v]]) for v in path)

    def _parallel(self, path) -> bool:
        """The route runs from where the path leaves it to where it comes back in conflict with it all the way."""
        start = next((s for s, r in self.into[path[0]] if r & DRIVABLE and s in self.on), None)
        end = next((d for d, r in self.out[path[-1]] if r & DRIVABLE and d in self.on), None)
        if start is None or end is None:
            return False
        held = set(path)

        def along(v) -> bool:
            return v in self.on and any(w in (start, end) or any(r & CLASH and d in held for d, r in self.out[w]) for w in self._row(v))

        return along(start) and any(end in p for p in self._paths(start, along, 127 & ~G.CONFLICTING))

    def _row(self, v) -> list:
        """v and all beside it, first on the left, then on the right."""
        row = [v]
        for mask in (G.LEFT | G.ADJACENT_LEFT, G.RIGHT | G.ADJACENT_RIGHT):
            at = v
            while (at := next((d for d, r in self.out[at] if r & mask), None)) is not None and at not in row:
                row.append(at)
        return row

    def lanes(self) -> list[tuple]:
        """(vertex, lane, pos, loop) of all that the start reaches within the route. A lane goes on while there is one way ahead and no other comes in; they are numbered as a search from the start meets them."""
        order, seen, todo = [], {self.first}, deque([self.first])
        while todo:
            v = todo.popleft()
            order.append(v)
            for d, _ in self.out[v]:
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        ahead = {v: [d for d, r in self.out[v] if r == G.SUCCESSOR] for v in order}
        behind = {v: [s for s, r in self.into[v] if r == G.SUCCESSOR and s in seen] for v in order}
        plain = {v: a[0] for v, a in ahead.items() if len(a) == 1 and len(behind[a[0]]) == 1}
        back = {d: s for s, d in plain.items()}
        out, placed, number = [], set(), 0
        for v in order:
            if v in placed:
                continue
            head, loop = v, False
            while head in back:
                head = back[head]
                if head == v:
                    loop = True
                    break
            at, pos = head, 0
            while at is not None and at not in placed:
                placed.add(at)
                out.append((at, number, pos, loop))
                at, pos = plain.get(at), pos + 1
            number += 1
        return out


def _by_query(nodes: DataFrame, edges: DataFrame, answer, extra: str = "") -> DataFrame:
    """(query, v, ...) of each route by itself: answer takes a Local, whose vertices are codes 2 * id + inv, and gives tuples that begin with one. Rows of many routes come to a worker at once, sorted by route; it holds those of one, and what it has to give."""
    code = lambda v: F.col(f"{v}.id") * 2 + F.col(f"{v}.inv").cast("int")
    flags = F.lit(0)
    for k, name in enumerate(("on_route", "first", "last", "final")):
        flags += F.col(name).cast("int") * 2**k
    rows = nodes.select("query", F.lit(0).alias("kind"), code("v").alias("a"), F.lit(0).cast("long").alias("b"), flags.cast("int").alias("r")).unionByName(edges.select("query", F.lit(1).alias("kind"), code("src").alias("a"), code("dst").alias("b"), F.col("relation").alias("r")))
    kind = nodes.schema["query"].dataType.simpleString()

    def run(batches):
        key, held, out = None, ([], []), []

        def settled() -> None:
            if not held[0]:
                return
            of = Local([{"v": a, "on_route": bool(r & 1), "first": bool(r & 2), "last": bool(r & 4), "final": bool(r & 8)} for a, _, r in held[0]], held[1])
            out.extend((key, *x) for x in answer(of))
            held[0].clear(), held[1].clear()

        def batch(t: pa.DataType) -> pa.RecordBatch:
            query, v, *more = zip(*out, strict=True)
            cols = [pa.array(query, t), S._vertices(v), *(pa.array(x, y) for x, y in zip(more, _EXTRA, strict=False))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["query", "v", "lane", "pos", "loop"][: len(cols)])

        for b in batches:
            for query, kind, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if query != key:
                    settled()
                    key = query
                held[kind].append(tuple(row))
            if len(out) >= S.OUT_ROWS:
                yield batch(b.schema.field(0).type)
        settled()
        if out:
            yield batch(b.schema.field(0).type)

    # a number of its own: little data is much work, and would be gathered in few tasks
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // S.DEALT_ROWS))
    return rows.repartition(tasks, "query").sortWithinPartitions("query", "kind").mapInArrow(run, f"query {kind}, v {V}{extra}")


_EXTRA = (pa.int32(), pa.int32(), pa.bool_())


def build(g: G.Graph, requests: DataFrame, *, lane_changes: bool = True, cost_id: int = 0) -> Routes:
    """Routes of requests (query, v, target), or (query, stops) for ways by several stops in turn. A request without a way has no route. A way that ends where it began is a round trip: there the route has no end to stop at."""
    spark = g.edges.sparkSession
    drive = checkpointed(spark, g.view(DRIVABLE if lane_changes else G.SUCCESSOR, cost_id))
    every = checkpointed(spark, g.view(G.SUCCESSOR | G.CONFLICTING | (SIDEWAYS if lane_changes else 0), cost_id).select("src", "dst", "cost", F.col("relation").cast("int").alias("relation")))
    paths = S.shortest_paths_via(drive, requests) if "stops" in requests.columns else S.shortest_paths(drive, requests)
    paths = checkpointed(spark, paths)
    head, tail = F.try_element_at("path", F.lit(1)), F.try_element_at("path", F.lit(-1))
    ends = paths.select("query", head.alias("head"), tail.alias("tail"), ((F.size("path") > 1) & (head == tail)).alias("round"))
    # all that the end's lane changes reach: the route doesn't go on from there
    key = ends.where("not round").select(F.monotonically_increasing_id().alias("k"), "query", F.col("tail").alias("v"))
    key = checkpointed(spark, key)
    aside = S.relax(every.where(F.col("relation").bitwiseAND(G.LEFT | G.RIGHT) != 0).withColumn("cost", F.lit(0.0)), key.select(F.col("k").alias("query"), "v"))
    final = checkpointed(spark, aside.select(F.col("query").alias("k"), "v").join(key.select("k", "query"), "k").select("query", "v", F.lit(True).alias("final")))
    on = checkpointed(spark, paths.select("query", F.explode("path").alias("v")).distinct())
    open_ = paths.select("query")
    links = every.select("src", "dst", "relation")

    def marked(nodes: DataFrame) -> DataFrame:
        at = nodes.join(final, ["query", "v"], "left").join(ends, "query")
        return at.select("query", "v", "on_route", (F.col("v") == F.col("head")).alias("first"), (F.col("v") == F.col("tail")).alias("last"), F.coalesce("final", F.lit(False)).alias("final"))

    def among(nodes: DataFrame) -> DataFrame:
        n = nodes.select("query", "v")
        return n.withColumnRenamed("v", "src").join(links, "src").join(n.withColumnRenamed("v", "dst"), ["query", "dst"]).select("query", "src", "dst", "relation")

    while True:
        mine = on.join(open_, "query", "left_semi")
        near = mine.withColumnRenamed("v", "dst").join(links, "dst").select("query", F.col("src").alias("v"))
        nodes = checkpointed(spark, mine.withColumn("on_route", F.lit(True)).unionByName(near.withColumn("on_route", F.lit(False))).groupBy("query", "v").agg(F.max("on_route").alias("on_route")))
        new = checkpointed(spark, _by_query(marked(nodes), among(nodes), lambda x: [(v,) for v in x.grown()]))
        if new.isEmpty():
            break
        on = checkpointed(spark, on.unionByName(new).distinct())
        open_ = new.select("query").distinct()
    nodes = on.withColumn("on_route", F.lit(True))
    lanes = _by_query(marked(nodes), among(nodes), Local.lanes, ", lane int, pos int, loop boolean")
    lanes = checkpointed(spark, lanes)
    n = lanes.select("query", "v")
    edges = n.withColumnRenamed("v", "src").join(every, "src").join(n.withColumnRenamed("v", "dst"), ["query", "dst"]).select("query", "src", "dst", "cost", "relation")
    return Routes(paths, lanes, checkpointed(spark, edges), every)


# ---- questions to routes ----------------------------------------------------------------------------------------


def remaining_path(r: Routes, at: DataFrame) -> DataFrame:
    """(query, v, path): what is left of the shortest path from v (at: query, v) on; of a round trip all, turned so that it begins there. Empty where v isn't on it."""
    j = at.join(r.paths.select("query", "path"), "query")
    i = F.array_position("path", F.col("v")).cast("int")
    n = F.size("path")
    ring = (n > 1) & (F.try_element_at("path", F.lit(1)) == F.try_element_at("path", F.lit(-1)))
    whole = F.concat(F.slice("path", F.greatest(i, F.lit(1)), F.greatest(n - i, F.lit(0))), F.slice("path", F.lit(1), F.greatest(i - 1, F.lit(0))))
    none = F.slice("path", 1, 0)
    return j.select("query", "v", F.when(i == 0, none).when(ring, whole).otherwise(F.slice("path", F.greatest(i, F.lit(1)), F.greatest(n - i + 1, F.lit(0)))).alias("path"))


def full_lane(r: Routes, at: DataFrame) -> DataFrame:
    """(query, v, lane): the whole lane that v (at: query, v) lies on, in order; a loop begins with v."""
    return _lane(r, at, False)


def remaining_lane(r: Routes, at: DataFrame) -> DataFrame:
    """(query, v, lane): v's lane from v on."""
    return _lane(r, at, True)


def _lane(r: Routes, at: DataFrame, rest: bool) -> DataFrame:
    mine = at.join(r.lanes.select("query", "v", F.col("lane").alias("_l"), F.col("pos").alias("_p")), ["query", "v"])
    all_ = r.lanes.select("query", F.col("v").alias("w"), F.col("lane").alias("_l"), "pos", "loop")
    j = mine.join(all_, ["query", "_l"])
    turn = (F.col("loop") & (F.col("pos") < F.col("_p"))).cast("int")
    if rest:
        j = j.where("loop or pos >= _p")
    return j.groupBy("query", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct(turn.alias("turn"), "pos", "w"))), lambda x: x["w"]).alias("lane"))


def lane_counts(r: Routes) -> DataFrame:
    """(query, lanes, size): how many lanes and elements a route has."""
    return r.lanes.groupBy("query").agg(F.count_distinct("lane").alias("lanes"), F.count("*").alias("size"))


def lengths(r: Routes, lanes: DataFrame) -> DataFrame:
    """(query, length): of the shortest path, from the lengths of lanes (id, length)."""
    each = r.paths.select("query", F.explode("path").alias("v")).select("query", F.col("v.id").alias("id"))
    return each.join(lanes.select("id", "length"), "id").groupBy("query").agg(F.sum("length").alias("length"))


def contains(r: Routes, at: DataFrame) -> DataFrame:
    """Rows of at (query, v) that are on their route."""
    return at.join(r.lanes.select("query", "v"), ["query", "v"], "left_semi")


def submap(r: Routes, m: RoadMap, query) -> RoadMap:
    """The map of one route's lanes and all that they need."""
    from .editing import closure

    return closure(m, lanelets=r.lanes.where(F.col("query") == query).select(F.col("v.id").alias("id")).distinct())


def relations(r: Routes, mask: int, *, towards: bool = False) -> DataFrame:
    """(query, v, other, relation): one step out (or in) within the route along some relations: SUCCESSOR for what follows (or comes before), LEFT | ADJACENT_LEFT for what is on the left."""
    e = r.edges.where(F.col("relation").bitwiseAND(mask) != 0)
    return e.select("query", F.col("dst").alias("v"), F.col("src").alias("other"), "relation") if towards else e.select("query", F.col("src").alias("v"), F.col("dst").alias("other"), "relation")


def beside(r: Routes, mask: int) -> DataFrame:
    """(query, v, other, relation, steps): all that a vertex reaches sideways within its route along one side's relations, in order. A vertex that isn't on the route has none."""
    key = F.struct("query", F.col("src.id").alias("id"), F.col("src.inv").alias("inv"))
    to = F.struct("query", F.col("dst.id").alias("id"), F.col("dst.inv").alias("inv"))
    e = r.edges.select(key.alias("src"), to.alias("dst"), F.lit(0).alias("cost_id"), "cost", "relation")
    got = G.all_beside(G.Graph(None, e, 1), mask)
    v = lambda c: F.struct(F.col(f"{c}.id").alias("id"), F.col(f"{c}.inv").alias("inv")).alias(c)
    return got.select("v.query", v("v"), v("other"), "relation", "steps")


def visits(r: Routes, starts: DataFrame, *, backwards: bool = False, lane_changes: bool = True) -> DataFrame:
    """(query, v, cost, hops, changes, pred) of what a visitor meets within each route from (query, v) on, by cost; or back to what leads there."""
    e = r.edges.where(F.col("relation").bitwiseAND(DRIVABLE if lane_changes else G.SUCCESSOR) != 0)
    best = starts.select("query", "v", F.lit(0.0).alias("cost"), F.lit(1).alias("hops"), F.lit(0).alias("changes"), F.lit(None).cast(V).alias("pred"))
    spark = r.edges.sparkSession
    step = checkpointed(spark, e.select("query", F.col("dst" if backwards else "src").alias("pred"), F.col("src" if backwards else "dst").alias("v"), F.col("cost").alias("more"), (F.col("relation") != G.SUCCESSOR).cast("int").alias("change")))
    best = front = checkpointed(spark, best)
    while True:
        got = front.drop("pred").withColumnRenamed("v", "pred").join(step, ["query", "pred"]).select("query", "v", (F.col("cost") + F.col("more")).alias("cost"), (F.col("hops") + 1).alias("hops"), (F.col("changes") + F.col("change")).alias("changes"), "pred")
        got = got.groupBy("query", "v").agg(F.min(F.struct("cost", "hops", "changes", "pred")).alias("m")).select("query", "v", "m.*")
        front = checkpointed(spark, got.join(best.select("query", "v", F.col("cost").alias("was")), ["query", "v"], "left").where("was is null or cost < was").drop("was"))
        if front.isEmpty():
            return best.orderBy("query", "cost", "hops", "v")
        best = checkpointed(spark, best.join(front.select("query", "v"), ["query", "v"], "left_anti").unionByName(front))


def conflicts_in_route(r: Routes) -> DataFrame:
    """(query, v, other): lanes of a route in conflict with each other."""
    return r.edges.where(F.col("relation") == G.CONFLICTING).select("query", F.col("src").alias("v"), F.col("dst").alias("other"))


def conflicts_in_map(r: Routes) -> DataFrame:
    """(query, v, other): all that a route's lanes are in conflict with, on the route or off it; what two lanes clash with comes twice."""
    return r.lanes.select("query", F.col("v").alias("src")).join(r.graph.where(F.col("relation") == G.CONFLICTING), "src").select("query", F.col("src").alias("v"), F.col("dst").alias("other"))


def conflicts_of_route(r: Routes, across: DataFrame, graph: str) -> DataFrame:
    """(query, other_graph, other): lanes of other participants' graphs that a route of `graph` overlaps, each once. across: graph.conflicts_across."""
    return r.lanes.select("query", F.col("v.id").alias("id")).distinct().join(across.where(F.col("graph") == graph), "id").select("query", "other_graph", "other").distinct()


def problems(r: Routes) -> DataFrame:
    """(query, id, message): elements of the shortest path that aren't on the route; relations that aren't seen back, or not as they should be."""
    lost = r.paths.select("query", F.explode("path").alias("v")).join(r.lanes.select("query", "v"), ["query", "v"], "left_anti").select("query", F.col("v.id").alias("id"), F.lit("is on the shortest path, but not on the route").alias("message"))
    back = r.edges.groupBy("query", F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.min("relation").alias("back"))
    j = r.edges.join(back, ["query", "src", "dst"], "left")
    rel = F.col("relation")
    left, right = F.col("back").isin(G.LEFT, G.ADJACENT_LEFT), F.col("back").isin(G.RIGHT, G.ADJACENT_RIGHT)
    say = F.when(F.col("back").isNull() & (rel != G.SUCCESSOR), "has a neighbour without a relation back").when(rel.isin(G.LEFT, G.ADJACENT_LEFT) & ~right & (F.col("back") != G.CONFLICTING), "has a left neighbour that doesn't see it on its right").when(rel.isin(G.RIGHT, G.ADJACENT_RIGHT) & ~left & (F.col("back") != G.CONFLICTING), "has a right neighbour that doesn't see it on its left")
    return lost.unionByName(j.select("query", F.col("src.id").alias("id"), say.alias("message")).where("message is not null"))


def remaining_lane_of_path(paths: DataFrame, follows: DataFrame, at: DataFrame) -> DataFrame:
    """(query, pos, lane): of a path (query, path) the elements from place pos (at: query, pos from 0) on while each follows the one before. follows: (src, dst)."""
    each = paths.select("query", F.posexplode("path").alias("i", "v"))
    nxt = each.select("query", (F.col("i") - 1).alias("i"), F.col("v").alias("w"))
    breaks = each.join(nxt, ["query", "i"], "left").join(follows.select(F.col("src").alias("v"), F.col("dst").alias("w"), F.lit(True).alias("goes")), ["v", "w"], "left").where("goes is null").select("query", F.col("i").alias("stop"))
    j = at.join(breaks, "query").where("stop >= pos").groupBy("query", "pos").agg(F.min("stop").alias("stop"))
    return j.join(paths.select("query", "path"), "query").select("query", "pos", F.slice("path", F.col("pos") + 1, F.col("stop") - F.col("pos") + 1).alias("lane"))


# ---- maps to look at --------------------------------------------------------------------------------------------


def debug_map(vertices: DataFrame, edges: DataFrame) -> RoadMap:
    """A map with a point for each vertex (v, ring, and what else is to be a tag) at its centroid and a line for each pair of them that an edge (src, dst, cost, relation) joins; the way back, if there is one, is in tags of its own."""
    from ..functions import polylines as P

    spark = edges.sparkSession
    tags = [c for c in vertices.columns if c not in ("v", "ring")]
    at = P.centroid(F.col("ring"))
    code = lambda v: (F.col(f"{v}.id") * 2 + F.col(f"{v}.inv").cast("int"))
    points = vertices.select(code("v").alias("id"), at["x"].alias("x"), at["y"].alias("y"), F.lit(0.0).alias("z"), F.map_filter(F.create_map(F.lit("id"), F.col("v.id").cast("string"), F.lit("inverted"), F.col("v.inv").cast("string"), *[x for c in tags for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, x: x.isNotNull()).alias("attrs"))
    e = edges.select(code("src").alias("a"), code("dst").alias("b"), F.col("cost").cast("string").alias("cost"), G.relation_name(F.col("relation")).alias("relation"))
    e = e.withColumn("back", F.col("a") > F.col("b")).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    one = lambda c, back: F.min(F.when(F.col("back") == back, F.col(c)))
    pair = e.groupBy("lo", "hi").agg(one("relation", False).alias("relation"), one("cost", False).alias("routing_cost"), one("relation", True).alias("relation_reverse"), one("cost", True).alias("routing_cost_reverse"))
    names = ["relation", "routing_cost", "relation_reverse", "routing_cost_reverse"]
    lines = pair.select(F.abs(F.xxhash64("lo", "hi")).alias("id"), F.array("lo", "hi").alias("point_ids"), F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))]), lambda _, x: x.isNotNull()).alias("attrs"))
    return RoadMap.of(spark, points=points, linestrings=lines)


def graph_debug_map(g: G.Graph, cost_id: int = 0, mask: int = 127) -> RoadMap:
    from ..functions import polylines as P

    v = g.vertices.select(F.struct("id", "inv").alias("v"), P.lane_ring(F.col("left_pts"), F.col("right_pts")).alias("ring"))
    return debug_map(v, g.view(mask, cost_id))


def route_debug_map(r: Routes, g: G.Graph, query) -> RoadMap:
    """As graph_debug_map, of one route; points tell their lane and whether they are on the shortest path."""
    from ..functions import polylines as P

    mine = lambda df: df.where(F.col("query") == query).drop("query")
    shortest = mine(r.paths).select(F.explode("path").alias("v"), F.lit("true").alias("shortest_path")).distinct()
    ring = g.vertices.select(F.struct("id", "inv").alias("v"), P.lane_ring(F.col("left_pts"), F.col("right_pts")).alias("ring"))
    v = mine(r.lanes).select("v", F.col("lane").alias("lane_id")).join(ring, "v").join(shortest, "v", "left")
    return debug_map(v, mine(r.edges))
