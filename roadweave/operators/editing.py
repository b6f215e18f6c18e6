"""Changing maps: adding rows, closing submaps over what they refer to, edits of lines. Tables are immutable, so each gives a new map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RoadMap, flip
from .graph import checkpointed


def add(m: RoadMap, **layers: DataFrame) -> RoadMap:
    """Rows whose id a layer has already are left out."""
    out = {}
    for n, new in layers.items():
        old = getattr(m, n)
        out[n] = old.unionByName(new.join(old.select("id"), "id", "left_anti").select(*old.columns))
    return m.with_(**out)


def add_parameters(m: RoadMap, rows: DataFrame) -> RoadMap:
    return m.with_(regelem_params=m.regelem_params.unionByName(rows))


def closure(m: RoadMap, *, lanelets: DataFrame | None = None, areas: DataFrame | None = None, regelems: DataFrame | None = None, linestrings: DataFrame | None = None, polygons: DataFrame | None = None) -> RoadMap:
    """The part of a map that ids (column id) of some layers need: rules of lanes and areas, what those refer to, bounds, points. Rules name lanes and lanes rules, so those are followed until no more are found."""
    spark = m.points.sparkSession
    none = spark.createDataFrame([], "id bigint")
    pick = lambda df: none if df is None else df.select("id")
    ll, ar = pick(lanelets), pick(areas)
    rules = pick(regelems)

    def of_rules(rule_ids: DataFrame, kind: str) -> DataFrame:
        return m.regelem_params.where(F.col("kind") == kind).join(rule_ids.select(F.col("id").alias("regelem_id")), "regelem_id", "left_semi").select(F.col("ref_id").alias("id"))

    def rules_of(layer: DataFrame, ids: DataFrame) -> DataFrame:
        return layer.join(ids.distinct(), "id", "left_semi").select(F.explode("regelem_ids").alias("id"))

    found = -1
    while True:  # each round ends in the shared folder, so the plan stays as it is
        rules = checkpointed(spark, rules.union(rules_of(m.lanelets, ll)).union(rules_of(m.areas, ar)).distinct())
        ll = checkpointed(spark, ll.union(of_rules(rules, "lanelet")).distinct())
        ar = checkpointed(spark, ar.union(of_rules(rules, "area")).distinct())
        now = rules.count() + ll.count() + ar.count()
        if now == found:
            break
        found = now
    some_ll, some_ar = m.lanelets.join(ll, "id", "left_semi"), m.areas.join(ar, "id", "left_semi")
    ls = pick(linestrings).union(of_rules(rules, "linestring")).union(some_ll.select(F.explode(F.array("left.id", "right.id", "centerline_id")))).union(some_ar.select(F.explode(F.flatten(F.concat(F.array("outer"), "inner")))).select("col.id"))
    po = pick(polygons).union(of_rules(rules, "polygon"))
    some_ls, some_po = m.linestrings.join(ls.distinct(), "id", "left_semi"), m.polygons.join(po.distinct(), "id", "left_semi")
    pts = some_ls.select(F.explode("point_ids").alias("id")).union(some_po.select(F.explode("point_ids"))).union(of_rules(rules, "point")).distinct()
    return RoadMap(m.points.join(pts, "id", "left_semi"), some_ls, some_po, some_ll, some_ar, m.regelems.join(rules, "id", "left_semi"), m.regelem_params.join(rules.select(F.col("id").alias("regelem_id")), "regelem_id", "left_semi"))


def insert_at(points: Column, i: int, p: Column, inv: Column) -> Column:
    """p before the i-th point of a line seen in the direction of inv; the stored order is the line's own."""
    there = F.concat(F.slice(points, 1, i) if i else F.slice(points, 1, 0), F.array(p), F.slice(points, F.lit(i + 1), F.greatest(F.size(points) - i, F.lit(0))))
    n = F.size(points) - i
    back = F.concat(F.slice(points, F.lit(1), n), F.array(p), F.slice(points, n + 1, F.lit(i)))
    return F.when(inv, back).otherwise(there)


def erase_at(points: Column, i: int, inv: Column) -> Column:
    k = F.when(inv, F.size(points) - 1 - i).otherwise(F.lit(i))
    return F.filter(points, lambda _, n: n != k)


def positive_ids(m: RoadMap) -> RoadMap:
    """All negative ids turned into their absolute value in every layer; a clash is the caller's to rule out."""
    up = lambda c: F.abs(c)
    ref = lambda r: F.struct(up(r["id"]).alias("id"), r["inv"].alias("inv"))
    ids = lambda c: F.transform(c, up)
    line = lambda df: df.withColumn("id", up(F.col("id"))).withColumn("point_ids", ids(F.col("point_ids")))
    return RoadMap(
        m.points.withColumn("id", up(F.col("id"))),
        line(m.linestrings),
        line(m.polygons),
        m.lanelets.withColumn("id", up(F.col("id"))).withColumn("left", ref(F.col("left"))).withColumn("right", ref(F.col("right"))).withColumn("centerline_id", up(F.col("centerline_id"))).withColumn("regelem_ids", ids(F.col("regelem_ids"))),
        m.areas.withColumn("id", up(F.col("id"))).withColumn("outer", F.transform("outer", ref)).withColumn("inner", F.transform("inner", lambda r: F.transform(r, ref))).withColumn("regelem_ids", ids(F.col("regelem_ids"))),
        m.regelems.withColumn("id", up(F.col("id"))),
        m.regelem_params.withColumn("regelem_id", up(F.col("regelem_id"))).withColumn("ref_id", up(F.col("ref_id"))),
    )


# ---- lanes and areas --------------------------------------------------------------------------------------------


def _set(layer: DataFrame, ids: DataFrame, **new: Column) -> DataFrame:
    """Columns of the rows whose id is among ids; the others stay."""
    mine = ids.select(F.col("id").alias("_i")).distinct()
    j = layer.join(mine, F.col("id") == F.col("_i"), "left")
    for c, v in new.items():
        j = j.withColumn(c, F.when(F.col("_i").isNotNull(), v.cast(layer.schema[c].dataType)).otherwise(F.col(c)))
    return j.select(*layer.columns)


def set_bounds(m: RoadMap, ids: DataFrame, *, left: Column | None = None, right: Column | None = None, inv: Column | bool = False) -> RoadMap:
    """New bounds (id, inv) of lanes; a lane seen backwards (inv) has them flipped and swapped. A centre line made from the old bounds goes."""
    back = F.lit(inv) if isinstance(inv, bool) else inv
    l, r = left if left is not None else F.when(back, flip(F.col("right"))).otherwise(F.col("left")), right if right is not None else F.when(back, flip(F.col("left"))).otherwise(F.col("right"))
    return m.with_(lanelets=_set(m.lanelets, ids, left=F.when(back, flip(r)).otherwise(l), right=F.when(back, flip(l)).otherwise(r), centerline_id=F.lit(None)) if left is not None or right is not None else m.lanelets)


def set_centreline(m: RoadMap, ids: DataFrame, line: Column) -> RoadMap:
    """A centre line of one's own; null takes the lanes back to that between their bounds."""
    return m.with_(lanelets=_set(m.lanelets, ids, centerline_id=line))


def set_rings(m: RoadMap, ids: DataFrame, *, outer: Column | None = None, inner: Column | None = None) -> RoadMap:
    new = {k: v for k, v in (("outer", outer), ("inner", inner)) if v is not None}
    return m.with_(areas=_set(m.areas, ids, **new))


def add_rules(m: RoadMap, layer: str, pairs: DataFrame) -> RoadMap:
    """Rules named by lanes or areas (layer) of pairs (id, regelem_id); one that is there already is not named twice."""
    t = getattr(m, layer)
    more = pairs.groupBy(F.col("id").alias("_i")).agg(F.sort_array(F.collect_set("regelem_id")).alias("_r"))
    j = t.join(more, F.col("id") == F.col("_i"), "left")
    return m.with_(**{layer: j.withColumn("regelem_ids", F.when(F.col("_r").isNull(), F.col("regelem_ids")).otherwise(F.concat("regelem_ids", F.array_except("_r", "regelem_ids")))).select(*t.columns)})


def remove_rules(m: RoadMap, layer: str, pairs: DataFrame) -> RoadMap:
    t = getattr(m, layer)
    less = pairs.groupBy(F.col("id").alias("_i")).agg(F.collect_set("regelem_id").alias("_r"))
    j = t.join(less, F.col("id") == F.col("_i"), "left")
    return m.with_(**{layer: j.withColumn("regelem_ids", F.when(F.col("_r").isNull(), F.col("regelem_ids")).otherwise(F.filter("regelem_ids", lambda r: ~F.array_contains(F.col("_r"), r)))).select(*t.columns)})


def expired(m: RoadMap) -> DataFrame:
    """(regelem_id, role, kind, ref_id): parameters whose target is not in the map (any more)."""
    from .regelems import parameters

    return m.regelem_params.select("regelem_id", "role", "kind", "ref_id").exceptAll(parameters(m).select("regelem_id", "role", "kind", "ref_id"))
