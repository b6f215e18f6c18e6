"""Searches on a graph's edges: shortest paths, reachable sets, possible paths.

Many searches run at once, keyed by query. Three ways give the same trees: a heap
search in each task over the whole adjacency list, where that is small enough to
send to all workers; the same over the island that a search begins in (what hangs
together with it), islands being dealt out to tasks with their searches; and, for
islands too large for a task, rounds of relaxation with joins, which hold no more
than a shuffle does and so take any size. In all, of ways of equal cost that of
fewer steps counts, then that of fewer lane changes, then the lesser predecessor.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInputError
from .graph import checkpointed

#: edges that may be sent to workers, at 17 bytes each
BROADCAST_EDGES = 500_000
#: edges of the largest island that one task searches
ISLAND_EDGES = 500_000
#: searches in an island before its edges are sent to one more task
ISLAND_SEARCHES = 20_000
#: edges whose islands a task finds at once
CHUNK_EDGES = 500_000
#: rows that a task deals with, or gives away, at once
DEALT_ROWS, OUT_ROWS = 200_000, 100_000
V = "struct<id: bigint, inv: boolean>"
TREE = f"query bigint, v {V}, cost double, hops int, changes int, pred {V}, leaf boolean"


def relax(edges: DataFrame, starts: DataFrame, *, max_cost: float | None = None, max_hops: int | None = None, expand_below: float | None = None, goals: DataFrame | None = None, rounds: int = 100_000) -> DataFrame:
    """(query, v, cost, hops, changes, pred) of all that starts (query, v) reach. max_cost keeps what costs at most that; expand_below goes no further from what costs that or more; with goals (query, v) nothing is kept that is found when its query's goal is known for less."""
    spark = edges.sparkSession
    e = checkpointed(spark, edges.select("src", "dst", F.col("cost").alias("step"), (F.col("relation") != 1).cast("int").alias("change")))
    best = checkpointed(spark, starts.select(F.col("query").cast("long").alias("query"), "v", F.lit(0.0).alias("cost"), F.lit(1).alias("hops"), F.lit(0).alias("changes"), F.lit(None).cast(V).alias("pred")))
    front, bound = best, None
    if goals is not None:
        bound = best.join(goals.select("query", "v"), ["query", "v"]).select("query", F.col("cost").alias("bound"))
    for _ in range(rounds):
        go = front
        if expand_below is not None:
            go = go.where(F.col("cost") < expand_below)
        if max_hops is not None:
            go = go.where(F.col("hops") < max_hops)
        got = go.join(e, go["v"] == e["src"]).select("query", F.col("dst").alias("v"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + 1).alias("hops"), (F.col("changes") + F.col("change")).alias("changes"), F.col("src").alias("pred"))
        if max_cost is not None:
            got = got.where(F.col("cost") <= max_cost)
        got = got.groupBy("query", "v").agg(F.min(F.struct("cost", "hops", "changes", "pred")).alias("m")).select("query", "v", "m.*")
        known = best.select("query", "v", F.col("cost").alias("was"))
        front = got.join(known, ["query", "v"], "left").where("was is null or cost < was").drop("was")
        if bound is not None:
            front = front.join(bound, "query", "left").where("bound is null or cost <= bound").drop("bound")
        front = checkpointed(spark, front)
        if front.isEmpty():
            return best
        if goals is not None:
            there = front.join(goals.select("query", "v"), ["query", "v"]).select("query", F.col("cost").alias("bound"))
            bound = checkpointed(spark, bound.unionByName(there).groupBy("query").agg(F.min("bound").alias("bound")))
        best = checkpointed(spark, best.join(front.select("query", "v"), ["query", "v"], "left_anti").unionByName(front))
    raise InvalidInputError("the search did not end: an edge may cost less than nothing")


@dataclass(frozen=True)
class Adjacency:
    """Edges as flat arrays, by source: vertices as rising codes 2 * id + inv, and for each a stretch of targets, costs, and whether it's a change."""

    codes: np.ndarray
    first: np.ndarray
    to: np.ndarray
    cost: np.ndarray
    change: np.ndarray

    @classmethod
    def of(cls, edges: DataFrame) -> Adjacency:
        code = lambda v: F.col(f"{v}.id") * 2 + F.col(f"{v}.inv").cast("int")
        t = edges.select(code("src").alias("s"), code("dst").alias("d"), "cost", (F.col("relation") != 1).alias("change")).toArrow()
        return cls.made(*(t.column(i).to_numpy() for i in range(4)))

    @classmethod
    def made(cls, s: np.ndarray, d: np.ndarray, cost: np.ndarray, change: np.ndarray) -> Adjacency:
        codes = np.unique(np.concatenate([s, d]))
        s, d = np.searchsorted(codes, s), np.searchsorted(codes, d)
        order = np.lexsort((d, s))
        first = np.searchsorted(s[order], np.arange(len(codes) + 1))
        return cls(codes, first, d[order].astype(np.int32), cost[order].astype(np.float64), change[order].astype(bool))


class Searcher:
    """Heap searches over an adjacency; plain lists, which a loop reads faster than arrays."""

    def __init__(self, a: Adjacency):
        self.codes = a.codes.tolist()
        self.place = dict(zip(self.codes, range(len(self.codes)), strict=True))
        self.first, self.to, self.cost, self.change = a.first.tolist(), a.to.tolist(), a.cost.tolist(), a.change.tolist()

    def run(self, start: int, goal: int | None, max_cost: float | None, max_hops: int | None, expand_below: float | None):
        """best: vertex -> (cost, hops, changes, predecessor), and the vertices that are done, in the order of the visit."""
        first, to, costs, change = self.first, self.to, self.cost, self.change
        best = {start: (0.0, 1, 0, -1)}
        heap, done = [(0.0, 1, start)], {}
        while heap:
            cost, hops, v = heapq.heappop(heap)
            if v in done:
                continue
            done[v] = True
            if v == goal:
                break
            if (expand_below is not None and cost >= expand_below) or (max_hops is not None and hops >= max_hops):
                continue
            changes = best[v][2]
            for e in range(first[v], first[v + 1]):
                w = to[e]
                if w in done:
                    continue
                c = cost + costs[e]
                if max_cost is not None and c > max_cost:
                    continue
                new = (c, hops + 1, changes + change[e], v)
                old = best.get(w)
                if old is None or new < old:
                    best[w] = new
                    if old is None or new[:2] < old[:2]:
                        heapq.heappush(heap, (c, hops + 1, w))
        return best, done


_searchers: dict[int, Searcher] = {}


def _searcher(sent) -> Searcher:
    """One for each broadcast and worker."""
    if sent.id not in _searchers:
        _searchers.clear()
        _searchers[sent.id] = Searcher(sent.value)
    return _searchers[sent.id]


class _Sent:
    def __init__(self, spark, a: Adjacency):
        self.cast = spark.sparkContext.broadcast(a)
        self.id = int(self.cast._jbroadcast.id())

    @property
    def value(self) -> Adjacency:
        return self.cast.value


_VT = pa.struct([("id", pa.int64()), ("inv", pa.bool_())])


def _vertices(codes: list[int | None]) -> pa.Array:
    c = np.array([0 if x is None else x for x in codes], np.int64)
    return pa.StructArray.from_arrays([pa.array(c >> 1), pa.array((c & 1).astype(bool))], names=["id", "inv"], mask=pa.array([x is None for x in codes], pa.bool_()))


def _trees_of(s: Searcher, queries: list, starts: list[int], limits: tuple):
    """Batches of TREE for starts, each a search of its own."""
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        q, v, cost, hops, changes, pred, leaf = zip(*rows, strict=True)
        cols = [pa.array(q, pa.int64()), _vertices(v), pa.array(cost, pa.float64()), pa.array(hops, pa.int32()), pa.array(changes, pa.int32()), _vertices(pred), pa.array(leaf, pa.bool_())]
        rows.clear()
        return pa.RecordBatch.from_arrays(cols, names=["query", "v", "cost", "hops", "changes", "pred", "leaf"])

    for query, v in zip(queries, starts, strict=True):
        at = s.place.get(v)
        if at is None:  # no edge touches the start
            rows.append((query, v, 0.0, 1, 0, None, True))
        else:
            best, done = s.run(at, None, *limits)
            inner = {best[w][3] for w in done}
            for w in done:
                cost, hops, changes, pred = best[w]
                rows.append((query, s.codes[w], cost, hops, changes, None if pred < 0 else s.codes[pred], w not in inner))
        if len(rows) >= OUT_ROWS:
            yield batch()
    if rows:
        yield batch()


def _paths_of(s: Searcher, queries: pa.Array, starts: list[int], targets: list[int]):
    """Batches of (query, cost, path) for starts with a way to their targets: each search stops there."""
    keep, costs, paths, held = [], [], [], 0

    def batch() -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
        flat = _vertices([v for p in paths for v in p])
        return pa.RecordBatch.from_arrays([queries.take(pa.array(keep, pa.int64())), pa.array(costs, pa.float64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["query", "cost", "path"])

    for i, (v, t) in enumerate(zip(starts, targets, strict=True)):
        if v == t:
            keep.append(i), costs.append(0.0), paths.append([v])
        else:
            at, goal = s.place.get(v), s.place.get(t)
            if at is None or goal is None:
                continue
            best, done = s.run(at, goal, None, None, None)
            if goal not in done:
                continue
            way, w = [], goal
            while w >= 0:
                way.append(s.codes[w])
                w = best[w][3]
            keep.append(i), costs.append(best[goal][0]), paths.append(way[::-1])
        held += len(paths[-1])
        if held >= OUT_ROWS:
            yield batch()
            keep, costs, paths, held = [], [], [], 0
    if keep:
        yield batch()


def heap_trees(edges: DataFrame, starts: DataFrame, *, max_cost: float | None = None, max_hops: int | None = None, expand_below: float | None = None) -> DataFrame:
    """As relax, by a heap for each query."""
    sent = _Sent(edges.sparkSession, Adjacency.of(edges))
    shaped = starts.select(F.col("query").cast("long").alias("query"), (F.col("v.id") * 2 + F.col("v.inv").cast("int")).alias("v"))

    def run(batches):
        s = _searcher(sent)
        for b in batches:
            yield from _trees_of(s, b.column(0).to_pylist(), b.column(1).to_pylist(), (max_cost, max_hops, expand_below))

    return shaped.repartition("query").mapInArrow(run, TREE)


def heap_paths(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(query, cost, path) of requests (query, v, target): each search stops at its target and gives the way it knows."""
    sent = _Sent(edges.sparkSession, Adjacency.of(edges))
    code = lambda c: (F.col(f"{c}.id") * 2 + F.col(f"{c}.inv").cast("int")).alias(c)
    names = requests.select("query").schema["query"].dataType.simpleString()
    shaped = requests.select("query", code("v"), code("target"))

    def run(batches):
        s = _searcher(sent)
        for b in batches:
            yield from _paths_of(s, b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist())

    return shaped.repartition("query").mapInArrow(run, f"query {names}, cost double, path array<{V}>")


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the pairs (a, b), and for each the least that it hangs together with."""
    v = np.unique(np.concatenate([a, b]))
    i, j, low = np.searchsorted(v, a), np.searchsorted(v, b), np.arange(len(v))
    while len(i):
        x, y = low[i], low[j]
        m = np.minimum(x, y)
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        while not np.array_equal(up := low[low], low):
            low = up
        apart = low[i] != low[j]
        i, j = i[apart], j[apart]
    return v, v[low]


def _stars(batches):
    """(v, root) of the pairs (a, b), CHUNK_EDGES of them at a time, each time as if there were no others."""
    held, n = [], 0

    def star() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _least(t.column(0).to_numpy(), t.column(1).to_numpy())], names=["v", "root"])

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK_EDGES:
            yield star()
            held, n = [], 0
    if n:
        yield star()


def islands(pairs: DataFrame) -> DataFrame:
    """(v, island) of the vertices of pairs (a, b), both long: the least vertex that v hangs together with, whatever way the pairs point. Each task contracts its own pairs; what belongs together over several tasks makes the pairs of the next round, down to what one task can take."""
    spark, levels = pairs.sparkSession, []
    while n := pairs.count():
        tasks = -(-n // CHUNK_EDGES)
        dealt = pairs.repartitionByRange(tasks, "a") if tasks > 1 else pairs.coalesce(1)
        star = checkpointed(spark, dealt.mapInArrow(_stars, "v long, root long"))
        least = checkpointed(spark, star.groupBy("v").agg(F.min("root").alias("island")))
        levels.append(least)
        pairs = checkpointed(spark, star.join(least, "v").where("root <> island").select(F.col("root").alias("a"), F.col("island").alias("b")).distinct())
    if not levels:
        return pairs.select(F.col("a").alias("v"), F.col("b").alias("island"))
    out = levels[0]
    for up in levels[1:]:
        out = out.join(up.select(F.col("v").alias("island"), F.col("island").alias("_up")), "island", "left").select("v", F.coalesce("_up", "island").alias("island"))
    return out


def _by_islands(edges: DataFrame, asked: DataFrame, answer, schema: str) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Answers to what is asked (query, a, b: codes, b may be null) in islands that a task can take; the edges of the other islands, what is asked there, and whether there are none. answer: of a Searcher and a batch (query, a, b) the batches of results."""
    spark = edges.sparkSession
    code = lambda v: F.col(f"{v}.id") * 2 + F.col(f"{v}.inv").cast("int")
    e = checkpointed(spark, edges.select(code("src").alias("a"), code("dst").alias("b"), F.col("cost").cast("double").alias("cost"), F.col("relation").cast("int").alias("relation")))
    where = checkpointed(spark, islands(e.select("a", "b")))
    at = checkpointed(spark, asked.join(where.withColumnRenamed("v", "a"), "a", "left").withColumn("island", F.coalesce("island", "a")))
    wanted = at.groupBy("island").agg(F.count("*").alias("n"))
    e = checkpointed(spark, e.join(where.withColumnRenamed("v", "a"), "a").join(wanted, "island"))
    size = e.groupBy("island").agg(F.count("*").alias("size"))
    large = checkpointed(spark, size.where(F.col("size") > ISLAND_EDGES).select("island"))
    wanted = wanted.withColumn("slices", F.ceil(F.col("n") / ISLAND_SEARCHES)).drop("n")
    query = asked.schema["query"].dataType
    rows = e.withColumn("slices", F.ceil(F.col("n") / ISLAND_SEARCHES)).select("island", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), F.lit(None).cast(query).alias("query"), "a", "b", "cost", (F.col("relation") != 1).alias("change"))
    asks = at.join(wanted, "island").select("island", F.pmod(F.xxhash64("query"), F.col("slices")).alias("slice"), F.lit(1).alias("kind"), "query", "a", "b", F.lit(None).cast("double").alias("cost"), F.lit(None).cast("boolean").alias("change"))
    # a number of its own: little data may be much work, and would be gathered in few tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-e.count() // DEALT_ROWS))
    mixed = rows.unionByName(asks).join(large, "island", "left_anti").repartition(tasks, "island", "slice").sortWithinPartitions("island", "slice", "kind")

    def run(batches):
        key, held, s = None, [], None
        for b in batches:
            three = [b.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in three])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                if key != (key := (three[0][lo], three[1][lo])):
                    held, s = [], None
                if three[2][lo] == 0:
                    held.append([part.column(i).to_numpy(zero_copy_only=False) for i in range(4, 8)])
                    continue
                if s is None:
                    none = [np.zeros(0, np.int64)] * 2 + [np.zeros(0), np.zeros(0, bool)]
                    s = Searcher(Adjacency.made(*(np.concatenate(x) for x in zip(*held, strict=True)) if held else none))
                    held = []
                yield from answer(s, part.select(["query", "a", "b"]))

    vertex = lambda c: F.struct(F.shiftright(c, 1).alias("id"), (F.col(c).bitwiseAND(1) == 1).alias("inv"))
    far = e.join(large, "island", "left_semi").select(vertex("a").alias("src"), vertex("b").alias("dst"), "cost", "relation")
    rest = at.join(large, "island", "left_semi").select("query", vertex("a").alias("v"), F.when(F.col("b").isNotNull(), vertex("b")).alias("target"))
    return mixed.mapInArrow(run, schema), far, rest, large.isEmpty()


def parted_trees(edges: DataFrame, starts: DataFrame, *, max_cost: float | None = None, max_hops: int | None = None, expand_below: float | None = None) -> DataFrame:
    """As heap_trees, on graphs of any size: by islands, and by rounds of joins in those too large for a task."""
    asked = starts.select(F.col("query").cast("long").alias("query"), (F.col("v.id") * 2 + F.col("v.inv").cast("int")).alias("a"), F.lit(None).cast("long").alias("b"))
    limits = (max_cost, max_hops, expand_below)
    got, far, rest, all_ = _by_islands(edges, asked, lambda s, b: _trees_of(s, b.column(0).to_pylist(), b.column(1).to_pylist(), limits), TREE)
    return got if all_ else got.unionByName(joined_trees(far, rest.select("query", "v"), max_cost=max_cost, max_hops=max_hops, expand_below=expand_below))


def parted_paths(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """As heap_paths, on graphs of any size: by islands, and by rounds of joins in those too large for a task."""
    code = lambda c: F.col(f"{c}.id") * 2 + F.col(f"{c}.inv").cast("int")
    asked = requests.select("query", code("v").alias("a"), code("target").alias("b"))
    names = requests.select("query").schema["query"].dataType.simpleString()
    got, far, rest, all_ = _by_islands(edges, asked, lambda s, b: _paths_of(s, b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()), f"query {names}, cost double, path array<{V}>")
    return got if all_ else got.unionByName(joined_paths(far, rest))


def trees(edges: DataFrame, starts: DataFrame, **limits) -> DataFrame:
    """Shortest-path trees with a flag for leaves, by whichever way the number of edges allows."""
    if few(edges):
        return heap_trees(edges, starts, **limits)
    return parted_trees(edges, starts, **limits)


def joined_trees(edges: DataFrame, starts: DataFrame, **limits) -> DataFrame:
    """The same by rounds of joins."""
    t = relax(edges, starts, **limits)
    inner = t.where("pred is not null").select("query", F.col("pred").alias("v")).distinct().withColumn("inner", F.lit(True))
    return t.join(inner, ["query", "v"], "left").withColumn("leaf", F.col("inner").isNull()).drop("inner")


def reachable(edges: DataFrame, starts: DataFrame, max_cost: float) -> DataFrame:
    """(query, v, cost) within max_cost, the start included."""
    return trees(edges, starts, max_cost=max_cost).select("query", "v", "cost")


def reachable_towards(edges: DataFrame, ends: DataFrame, max_cost: float) -> DataFrame:
    """(query, v, cost): from where an end is reached within max_cost."""
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", "relation"), ends, max_cost)


def walk_back(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(query, path, pos, v): for each end (query, path, v) of a tree the vertices from the start to it; pos from 0. Doubling: round k adds what lies 2**k steps before all that is known, so a path of n vertices takes log2(n) rounds."""
    spark = tree.sparkSession
    path = checkpointed(spark, ends.select("query", "path", "v").join(tree.select("query", "v", "hops"), ["query", "v"]))
    jump = checkpointed(spark, tree.where("pred is not null").select("query", "v", F.col("pred").alias("to")))
    hops = tree.select("query", F.col("v").alias("to"), F.col("hops").alias("to_hops"))
    while not jump.isEmpty():
        more = path.join(jump, ["query", "v"]).join(hops, ["query", "to"]).select("query", F.col("to").alias("v"), "path", F.col("to_hops").alias("hops"))
        more = checkpointed(spark, more)
        if more.isEmpty():
            break
        path = path.unionByName(more)
        jump = checkpointed(spark, jump.join(jump.select("query", F.col("v").alias("to"), F.col("to").alias("to2")), ["query", "to"]).select("query", "v", F.col("to2").alias("to")))
    return path.select("query", "path", (F.col("hops") - 1).alias("pos"), "v")


def few(edges: DataFrame) -> bool:
    return edges.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES


def shortest_paths(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(query, cost, path) of requests (query, v, target): path is the array of vertices; requests without a way have no row, those whose target is the start have it alone. query is a key of any type."""
    if few(edges):
        return heap_paths(edges, requests)
    return parted_paths(edges, requests)


def joined_paths(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """The same by rounds of joins."""
    key = checkpointed(edges.sparkSession, requests.select(F.monotonically_increasing_id().alias("_k"), "query", "v", "target"))
    tree = checkpointed(edges.sparkSession, relax(edges, key.select(F.col("_k").alias("query"), "v"), goals=key.select(F.col("_k").alias("query"), F.col("target").alias("v"))))
    ends = key.select(F.col("_k").alias("query"), F.col("target").alias("v"), F.lit(0).alias("path"))
    steps = walk_back(tree, ends)
    found = steps.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("path"))
    cost = ends.join(tree, ["query", "v"]).select(F.col("query").alias("_k"), "cost")
    return key.select("_k", "query").join(cost, "_k").join(found.withColumnRenamed("query", "_k"), "_k").select("query", "cost", "path")


def shortest_paths_via(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(query, cost, path) of requests (query, stops: array of vertices): legs between stops in turn, joined; none where a leg has no way."""
    legs = requests.select("query", F.size("stops").alias("n"), F.posexplode(F.expr("arrays_zip(slice(stops, 1, size(stops) - 1), slice(stops, 2, size(stops) - 1))")).alias("leg", "ab"))
    legs = legs.select("query", "n", "leg", F.col("ab.0").alias("v"), F.col("ab.1").alias("target")).withColumn("key", F.struct("query", "leg"))
    got = shortest_paths(edges, legs.select(F.col("key").alias("query"), "v", "target")).withColumnRenamed("query", "key")
    j = legs.join(got, "key").groupBy("query", "n").agg(F.sum("cost").alias("cost"), F.count("*").alias("found"), F.array_sort(F.collect_list(F.struct("leg", "path"))).alias("parts"))
    joined = F.flatten(F.transform("parts", lambda p: F.when(p["leg"] == 0, p["path"]).otherwise(F.slice(p["path"], F.lit(2), F.size(p["path"])))))
    return j.where("found = n - 1").select("query", "cost", joined.alias("path"))


def possible_paths(edges: DataFrame, starts: DataFrame, *, min_cost: float | None = None, min_hops: int | None = None, include_shorter: bool = False) -> DataFrame:
    """(query, cost, path): the ways from a start to the leaves of its tree. A way ends where it costs min_cost or has min_hops vertices, whichever is first; include_shorter keeps those that end before."""
    if min_cost is None and min_hops is None:
        raise InvalidInputError("a cost or a number of elements must limit the paths")
    t = checkpointed(edges.sparkSession, trees(edges, starts, expand_below=min_cost, max_hops=min_hops))
    leaves = t.where("leaf")
    if not include_shorter:
        full = F.lit(False)
        if min_cost is not None:
            full |= F.col("cost") >= min_cost
        if min_hops is not None:
            full |= F.col("hops") >= min_hops
        leaves = leaves.where(full)
    ends = leaves.select("query", "v", F.xxhash64("v.id", "v.inv").alias("path"), "cost")
    steps = walk_back(t, ends.drop("cost"))
    found = steps.groupBy("query", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("way"))
    return found.join(ends, ["query", "path"]).select("query", "cost", F.col("way").alias("path"))


def visits(tree: DataFrame) -> DataFrame:
    """A tree in the order of a visitor: by cost, ties by fewer steps and id."""
    return tree.orderBy("query", "cost", "hops", "v")


def pruned_visits(edges: DataFrame, starts: DataFrame, go_on: Column, **limits) -> DataFrame:
    """As trees, but what fails the predicate (over v) is visited and not passed: its out-edges are left out."""
    stopped = edges.select(F.col("src").alias("v")).distinct().where(~go_on).select(F.col("v").alias("src"))
    return trees(edges.join(stopped, "src", "left_anti"), starts, **limits)
