"""Routing graph: vertices are directed views of lanes (and areas), edges relations with a cost.

The order of kinds matters: a pair that already has an edge gets no other of a
later kind. All joins are equi-joins, on end points, on shared borders, or on
grid cells for overlaps, so nothing is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import GraphError, InvalidInputError
from ..functions import polylines as P
from ..model import RoadMap, directed, with_bounds, with_points
from . import rules as R
from .spatial import overlapping_pairs

SUCCESSOR, LEFT, RIGHT, ADJACENT_LEFT, ADJACENT_RIGHT, CONFLICTING, AREA = 1, 2, 4, 8, 16, 32, 64
NAMES = {SUCCESSOR: "Successor", LEFT: "Left", RIGHT: "Right", ADJACENT_LEFT: "AdjacentLeft", ADJACENT_RIGHT: "AdjacentRight", CONFLICTING: "Conflicting", AREA: "Area"}
COLOURS = {SUCCESSOR: "green", LEFT: "blue", RIGHT: "magenta", ADJACENT_LEFT: "black", ADJACENT_RIGHT: "black", CONFLICTING: "red", AREA: "yellow"}


def relation_name(relation: Column) -> Column:
    out = F.lit("None")
    for k, v in NAMES.items():
        out = F.when(relation == k, v).otherwise(out)
    return out


@dataclass(frozen=True)
class Cost:
    """A cost module: by distance or by travel time, with what a lane change costs and from which length (or time) of a run it is possible."""

    kind: str = "distance"
    lane_change: float = 10.0
    least_run: float = 0.0

    def __post_init__(self):
        if self.lane_change < 0:
            raise InvalidInputError("a lane change can't cost less than nothing")

    def along(self, length: Column, mps: Column) -> Column:
        return length if self.kind == "distance" else F.when(mps > 0, length / mps).otherwise(F.lit(float("inf")))


@dataclass(frozen=True)
class OwnCost(Cost):
    """A cost of one's own: of_lane makes it from a lane's length and speed limit (both columns)."""

    of_lane: Callable[[Column, Column], Column] | None = None

    def along(self, length: Column, mps: Column) -> Column:
        if self.of_lane is None:
            raise InvalidInputError("a cost of one's own needs of_lane")
        return self.of_lane(length, mps)


DEFAULT_COSTS = (Cost("distance", 10.0), Cost("time", 5.0))


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame  # id, inv, length, mps, ends, borders
    edges: DataFrame  # src, dst (id, inv), cost_id, cost, relation
    n_costs: int
    areas: DataFrame | None = None  # id, length (of the outline), mps; where the graph has areas

    def view(self, mask: int, cost_id: int = 0) -> DataFrame:
        """Edges of some relations and one cost module."""
        if not 0 <= cost_id < self.n_costs:
            raise InvalidInputError(f"no cost module {cost_id}")
        return self.edges.where((F.col("cost_id") == cost_id) & (F.col("relation").bitwiseAND(mask) != 0))


def passable(m: RoadMap, rules: R.Rules) -> DataFrame:
    """Directed views of lanes that the participant may use in that direction."""
    return directed(m.lanelets).where(R.can_pass_lane(F.col("attrs"), F.col("inv"), rules))


def vertices(m: RoadMap, rules: R.Rules) -> DataFrame:
    lines = with_points(m.linestrings, m.points)
    v = with_bounds(passable(m, rules), lines)
    end = lambda c, i: F.try_element_at(F.col(c), F.lit(i))["id"]
    return v.select(
        "id",
        "inv",
        "left",
        "right",
        "attrs", "left_attrs", "right_attrs", "left_pts", "right_pts",
        P.approximate_length(F.col("left_pts")).alias("length"),
        R.speed_limit(F.col("attrs"), rules)["mps"].alias("mps"),
        end("left_pts", 1).alias("left_first"), end("left_pts", -1).alias("left_last"), end("right_pts", 1).alias("right_first"), end("right_pts", -1).alias("right_last"),
        R.lane_change(F.col("left_attrs"), F.col("left.inv"), rules.participant).alias("left_change"),
        R.lane_change(F.col("right_attrs"), F.col("right.inv"), rules.participant).alias("right_change"),
    )


def following(v: DataFrame) -> DataFrame:
    """(src, dst) where dst begins at the end points of src."""
    a = v.select(F.struct("id", "inv").alias("src"), F.col("left_last").alias("l"), F.col("right_last").alias("r"), F.col("length").alias("src_length"), F.col("mps").alias("src_mps"))
    b = v.select(F.struct("id", "inv").alias("dst"), F.col("left_first").alias("l"), F.col("right_first").alias("r"), F.col("length").alias("dst_length"), F.col("mps").alias("dst_mps"))
    return a.join(b, ["l", "r"]).drop("l", "r")


def beside(v: DataFrame) -> DataFrame:
    """(src, dst, side, allowed): dst shares src's left (or right) border, directed the same way."""
    one = v.select(F.struct("id", "inv").alias("v"), "left", "right", "left_change", "right_change", "length", "mps")
    a = one.select(F.col("v").alias("src"), F.col("left").alias("k"), R.to_left(F.col("left_change")).alias("allowed"), "length", "mps")
    left = a.join(one.select(F.col("v").alias("dst"), F.col("right").alias("k")), "k").select("src", "dst", F.lit("left").alias("side"), "allowed", "length", "mps")
    a = one.select(F.col("v").alias("src"), F.col("right").alias("k"), R.to_right(F.col("right_change")).alias("allowed"), "length", "mps")
    right = a.join(one.select(F.col("v").alias("dst"), F.col("left").alias("k")), "k").select("src", "dst", F.lit("right").alias("side"), "allowed", "length", "mps")
    return left.unionByName(right).where("src <> dst")


def change_runs(changes: DataFrame, follow: DataFrame) -> DataFrame:
    """Runs of lane changes: (src, dst, side, run, pos, length, mps). Pairs chain while source and target each have one successor and the next pair lies between those. Found by pointer jumping: log2 of the longest run joins."""
    out_degree = follow.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("next")).where("n = 1").select("src", "next")
    in_degree = follow.groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select("dst")
    single = out_degree.join(in_degree, out_degree["next"] == in_degree["dst"]).select("src", "next")
    c = changes.select("src", "dst", "side", "length", "mps")
    nxt = checkpointed(
        changes.sparkSession,
        c.join(single.withColumnsRenamed({"next": "src_next"}), "src")
        .join(single.select(F.col("src").alias("dst"), F.col("next").alias("dst_next")), "dst")
        .join(c.select(F.col("src").alias("src_next"), F.col("dst").alias("dst_next"), "side"), ["src_next", "dst_next", "side"], "left_semi")
        .select(F.struct("src", "dst", "side").alias("a"), F.struct(F.col("src_next").alias("src"), F.col("dst_next").alias("dst"), "side").alias("b")),
    )
    own = c.select(F.struct("src", "dst", "side").alias("a"))
    heads = chains(own, nxt)
    return checkpointed(changes.sparkSession, c.withColumn("a", F.struct("src", "dst", "side")).join(heads, "a").select("src", "dst", "side", F.col("up").alias("run"), F.col("steps").alias("pos"), "length", "mps"))


def chains(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, up, steps) of every member a: the head of its chain and how far it is. links: (a, b), each a and each b once. A loop's head is its least member. Doubling: chains of n members take log2(n) joins; what still moves after as many rounds as all members could need runs in a loop, is cut before its least member, and done again."""
    spark = members.sparkSession
    most = max(1, members.count()).bit_length() + 1
    up = links.select(F.col("b").alias("a"), F.col("a").alias("up"))

    def run(who: DataFrame, up: DataFrame) -> DataFrame:
        state = who.join(up, "a", "left").withColumn("steps", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long")).withColumn("up", F.coalesce("up", "a")).withColumn("low", F.least("a", "up")).withColumn("more", F.col("steps"))
        for _ in range(most):
            state = checkpointed(spark, state)
            if state.where("more > 0").isEmpty():
                break
            step = state.select(F.col("a").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("by"), F.col("low").alias("low2"))
            state = state.join(step, "up").select("a", F.col("up2").alias("up"), (F.col("steps") + F.col("by")).alias("steps"), F.least("low", "low2").alias("low"), F.col("by").alias("more"))
        return state

    state = checkpointed(spark, run(members, up))
    loops = state.where("more > 0").select("a", "low")
    if loops.isEmpty():
        return state.select("a", "up", "steps")
    cut = up.join(loops.where("a = low").select("a"), "a", "left_anti")
    again = run(loops.select("a"), cut.join(loops.select("a"), "a", "left_semi"))
    return state.where("more = 0").select("a", "up", "steps").unionByName(again.select("a", "up", "steps"))


def checkpointed(spark, df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration, in the folder that the cluster shares (spark.checkpoint.dir); only local runs may do without one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise GraphError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(base or "file:///tmp/roadweave-checkpoints")
    return df.checkpoint()


def build(m: RoadMap, rules: R.Rules, costs: tuple[Cost, ...] = DEFAULT_COSTS, *, conflicts: bool = True, areas: bool = False, cell: float = 25.0) -> Graph:
    """The graph of a map for one rule set; with `areas`, ways over areas too."""
    spark = m.lanelets.sparkSession
    # each of these feeds several kinds of edges: computed once, in the shared folder
    v = checkpointed(spark, vertices(m, rules))
    follow = checkpointed(spark, following(v))
    side = checkpointed(spark, beside(v).join(follow.select("src", "dst"), ["src", "dst"], "left_anti"))
    runs = change_runs(side.where("allowed"), follow)
    after = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    runs = runs.withColumn("run_length", F.sum("length").over(after))
    edge = lambda df, i, cost, rel: df.select("src", "dst", F.lit(i).cast("smallint").alias("cost_id"), cost.cast("double").alias("cost"), rel.cast("tinyint").alias("relation"))
    left = F.col("side") == "left"
    out = None
    for i, c in enumerate(costs):
        if c.kind == "time":
            runs = runs.withColumn("run_size", F.sum(F.when(F.col("mps") > 0, F.col("length") / F.col("mps")).otherwise(float("inf"))).over(after))
        else:
            runs = runs.withColumn("run_size", F.col("run_length"))
        parts = [
            edge(follow, i, (c.along(F.col("src_length"), F.col("src_mps")) + c.along(F.col("dst_length"), F.col("dst_mps"))) / 2, F.lit(SUCCESSOR)),
            edge(side.where("not allowed"), i, F.lit(1.0), F.when(left, ADJACENT_LEFT).otherwise(ADJACENT_RIGHT)),
            edge(runs, i, F.when(F.col("run_size") >= c.least_run, c.lane_change).otherwise(1.0), F.when(F.col("run_size") >= c.least_run, F.when(left, LEFT).otherwise(RIGHT)).otherwise(F.when(left, ADJACENT_LEFT).otherwise(ADJACENT_RIGHT))),
        ]
        for p in parts:
            out = p if out is None else out.unionByName(p)
    if conflicts:
        ring = v.where("not inv").select("id", P.lane_ring(F.col("left_pts"), F.col("right_pts")).alias("ring"))
        pairs = overlapping_pairs(ring.unionByName(v.where("inv").select("id", P.lane_ring(F.reverse("right_pts"), F.reverse("left_pts")).alias("ring"))).dropDuplicates(["id"]), cell)
        views = v.select(F.struct("id", "inv").alias("v"), "id")
        both = pairs.join(views.select(F.col("id").alias("a"), F.col("v").alias("src")), "a").join(views.select(F.col("id").alias("b"), F.col("v").alias("dst")), "b").select("src", "dst")
        both = both.union(both.select("dst", "src"))
        own = v.where("inv").select(F.struct("id", F.lit(False).alias("inv")).alias("src"), F.struct("id", "inv").alias("dst")).join(v.where("not inv").select(F.struct("id", "inv").alias("src")), "src", "left_semi")
        both = both.union(own.select("src", "dst")).union(own.select("dst", "src")).distinct()
        taken = follow.select("src", "dst").union(side.select("src", "dst"))
        both = both.join(taken, ["src", "dst"], "left_anti").join(taken.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
        for i in range(len(costs)):
            out = out.unionByName(edge(both, i, F.lit(1.0), F.lit(CONFLICTING)))
    sized = None
    if areas:
        from . import areas as A  # it builds on this module's neighbours

        passes, clash, sized = A.edges(m, v, rules, cell)
        passes, sized = checkpointed(spark, passes), checkpointed(spark, sized)
        known = v.select(F.struct("id", "inv").alias("v"), "length", "mps").unionByName(sized.select(F.struct("id", F.lit(False).alias("inv")).alias("v"), "length", "mps"))
        ends = passes.join(known.select(F.col("v").alias("src"), F.col("length").alias("src_length"), F.col("mps").alias("src_mps")), "src").join(known.select(F.col("v").alias("dst"), F.col("length").alias("dst_length"), F.col("mps").alias("dst_mps")), "dst")
        for i, c in enumerate(costs):
            out = out.unionByName(edge(ends, i, (c.along(F.col("src_length"), F.col("src_mps")) + c.along(F.col("dst_length"), F.col("dst_mps"))) / 2, F.lit(AREA)))
            if conflicts:
                out = out.unionByName(edge(clash, i, F.lit(1.0), F.lit(CONFLICTING)))
    return Graph(v.drop("attrs", "left_attrs", "right_attrs"), out.where(F.col("cost") < float("inf")), len(costs), sized)


def check_costs(g: Graph) -> None:
    if not g.edges.where("cost < 0").isEmpty():
        raise GraphError("an edge costs less than nothing")


def neighbours(g: Graph, mask: int, cost_id: int = 0, towards: bool = False) -> DataFrame:
    """(v, other, relation): one step out (or in) along some relations."""
    e = g.view(mask, cost_id)
    return e.select(F.col("dst").alias("v"), F.col("src").alias("other"), "relation") if towards else e.select(F.col("src").alias("v"), F.col("dst").alias("other"), "relation")


def relation_between(g: Graph, pairs: DataFrame, cost_id: int = 0, conflicting: bool = False) -> DataFrame:
    """(src, dst, relation) of pairs (src, dst): the relation of the first edge between them, conflicts left out unless asked for."""
    mask = 127 if conflicting else 127 & ~CONFLICTING
    e = g.view(mask, cost_id).select("src", "dst", "relation")
    return pairs.select("src", "dst").distinct().join(e, ["src", "dst"]).groupBy("src", "dst").agg(F.min("relation").alias("relation"))


def all_beside(g: Graph, mask: int, cost_id: int = 0) -> DataFrame:
    """(v, other, relation, steps): everything reached sideways along the first matching edge of each vertex, in order; a vertex that comes again is not gone on from. Doubling: after k rounds all is known that lies 2**k steps off."""
    one = g.view(mask, cost_id).groupBy("src").agg(F.min(F.struct("dst", "relation")).alias("m")).select("src", F.col("m.dst").alias("to"), "m.relation")
    spark = one.sparkSession
    jump, far = checkpointed(spark, one), 1
    out = checkpointed(spark, jump.select(F.col("src").alias("v"), F.col("to").alias("other"), "relation", F.lit(1).alias("steps")).where("v <> other"))
    while True:
        more = out.select("v", F.col("other").alias("src"), "steps").join(jump, "src").where("to <> v").select("v", F.col("to").alias("other"), (F.col("steps") + far).alias("steps"), "relation")
        new = more.groupBy("v", "other").agg(F.min(F.struct("steps", "relation")).alias("m")).select("v", "other", "m.relation", "m.steps")
        new = checkpointed(spark, new.join(out.select("v", "other"), ["v", "other"], "left_anti"))
        if new.isEmpty():
            return out
        out = out.unionByName(new)
        jump = checkpointed(spark, jump.select("src", F.col("to").alias("mid")).join(jump.select(F.col("src").alias("mid"), "to", "relation"), "mid").select("src", "to", "relation"))
        far *= 2


def besides(g: Graph, cost_id: int = 0, mask: int = LEFT | RIGHT) -> DataFrame:
    """(v, other, place): from the leftmost to the rightmost of all that a vertex reaches by lane changes; its own place is 0, those on the left are below it."""
    left = all_beside(g, mask & (LEFT | ADJACENT_LEFT), cost_id).select("v", "other", (-F.col("steps")).alias("place"))
    right = all_beside(g, mask & (RIGHT | ADJACENT_RIGHT), cost_id).select("v", "other", F.col("steps").alias("place"))
    own = g.vertices.select(F.struct("id", "inv").alias("v")).select("v", F.col("v").alias("other"), F.lit(0).alias("place"))
    return left.unionByName(own).unionByName(right)


def passable_map(m: RoadMap, rules: R.Rules, areas: bool = True) -> RoadMap:
    """The part of a map that a participant may use: lanes passable in either direction, areas, and all that those need."""
    from .areas import passable as passable_areas
    from .editing import closure

    return closure(m, lanelets=passable(m, rules).select("id").distinct(), areas=passable_areas(m, rules).select("id") if areas else None)


def conflicts_across(graphs: dict[str, Graph], lanes: DataFrame, cell: float = 25.0, height: float | None = None) -> DataFrame:
    """(graph, id, other_graph, other): lanes of one participant's graph that overlap lanes of another's, themselves left out. lanes: id, left_pts, right_pts. With a height, only where they also lie less than it apart."""
    from .areas import overlapping
    from ..functions import geometry as GE

    used = None
    for name, g in graphs.items():
        one = g.vertices.select(F.lit(name).alias("graph"), "id").distinct()
        used = one if used is None else used.unionByName(one)
    used = checkpointed(lanes.sparkSession, used)
    ring = lanes.join(used.select("id").distinct(), "id", "left_semi").select("id", P.lane_ring(F.col("left_pts"), F.col("right_pts")).alias("ring"))
    pairs = overlapping_pairs(ring, cell)
    if height is not None:
        pairs = pairs.join(ring.select(F.col("id").alias("a"), F.col("ring").alias("ra")), "a").join(ring.select(F.col("id").alias("b"), F.col("ring").alias("rb")), "b").where(GE.border_gap("ra", "rb") < height).select("a", "b")
    both = pairs.union(pairs.select("b", "a"))
    return both.join(used.select(F.col("id").alias("a"), "graph"), "a").join(used.select(F.col("id").alias("b"), F.col("graph").alias("other_graph")), "b").where("graph <> other_graph").select("graph", F.col("a").alias("id"), "other_graph", F.col("b").alias("other"))


def problems(g: Graph) -> DataFrame:
    """(check_name, severity, primitive, id, message): vertices with two left (right) neighbours, with both a changeable and an adjacent one, or whose neighbour doesn't look back."""
    e = g.view(LEFT | RIGHT | ADJACENT_LEFT | ADJACENT_RIGHT)
    issue = lambda df, text: df.select(F.lit("routing.graph_is_valid").alias("check_name"), F.lit("Error").alias("severity"), F.lit("Lanelet").alias("primitive"), F.col("src.id").alias("id"), F.lit(text).alias("message"))
    out = None
    for name, mask in (("left", LEFT | ADJACENT_LEFT), ("right", RIGHT | ADJACENT_RIGHT)):
        many = e.where(F.col("relation").bitwiseAND(mask) != 0).groupBy("src").agg(F.count_distinct("dst").alias("n")).where("n > 1")
        got = issue(many, f"has several {name} neighbours")
        out = got if out is None else out.unionByName(got)
    back = {"left": (LEFT | ADJACENT_LEFT, RIGHT | ADJACENT_RIGHT), "right": (RIGHT | ADJACENT_RIGHT, LEFT | ADJACENT_LEFT)}
    for name, (there, here) in back.items():
        a = e.where(F.col("relation").bitwiseAND(there) != 0).select("src", "dst")
        b = e.where(F.col("relation").bitwiseAND(here) != 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        out = out.unionByName(issue(a.join(b, ["src", "dst"], "left_anti"), f"isn't seen back from its {name} neighbour"))
    return out
