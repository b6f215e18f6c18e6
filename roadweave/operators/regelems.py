"""Regulatory elements: parameters by role, and what the known kinds make of them. Tables are those of model.RoadMap."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInputError
from ..functions import attributes as A
from ..functions import polylines as P
from ..model import SCHEMAS, RoadMap, with_points

KINDS = ("traffic_light", "right_of_way", "all_way_stop", "traffic_sign", "speed_limit", "")
#: roles by kind
LIGHT, STOP, SIGN, CANCEL, LINE, CANCEL_LINE, FIRST, YIELD = "refers", "ref_line", "refers", "cancels", "ref_line", "cancel_line", "right_of_way", "yield"


def parameters(m: RoadMap, role: str | None = None) -> DataFrame:
    """regelem_id, role, pos, kind, ref_id, inv of parameters whose target exists."""
    there = None
    for kind, layer in (("point", m.points), ("linestring", m.linestrings), ("polygon", m.polygons), ("lanelet", m.lanelets), ("area", m.areas)):
        one = layer.select(F.lit(kind).alias("kind"), F.col("id").alias("ref_id"))
        there = one if there is None else there.unionByName(one)
    p = m.regelem_params if role is None else m.regelem_params.where(F.col("role") == role)
    return p.join(there, ["kind", "ref_id"], "left_semi")


def roles(m: RoadMap) -> DataFrame:
    """regelem_id and its roles in order."""
    return m.regelem_params.groupBy("regelem_id").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.count("*").alias("size"))


def of_kind(m: RoadMap, subtype: str) -> DataFrame:
    if subtype not in _FACTORY:
        raise InvalidInputError(f"no regulatory element of kind {subtype!r}; there are {', '.join(available())}")
    return m.regelems.where(F.col("subtype") == subtype)


def on_lanes(m: RoadMap, subtype: str) -> DataFrame:
    """(lane_id, regelem_id, pos): elements of a kind that lanes name, in the lanes' order."""
    each = m.lanelets.select(F.col("id").alias("lane_id"), F.posexplode("regelem_ids").alias("pos", "regelem_id"))
    return each.join(of_kind(m, subtype).select(F.col("id").alias("regelem_id")), "regelem_id", "left_semi")


def _first(m: RoadMap, role: str, name: str) -> DataFrame:
    return parameters(m, role).groupBy("regelem_id").agg(F.min_by("ref_id", "pos").alias(name))


def traffic_lights(m: RoadMap) -> DataFrame:
    """(id, lights, stop_line)."""
    lights = parameters(m, LIGHT).groupBy("regelem_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref_id"))).alias("_l"))
    got = of_kind(m, "traffic_light").join(lights, F.col("id") == F.col("regelem_id"), "left").drop("regelem_id").join(_first(m, STOP, "stop_line"), F.col("id") == F.col("regelem_id"), "left")
    return got.select("id", F.transform("_l", lambda x: x["ref_id"]).alias("lights"), "stop_line")


def manoeuvres(m: RoadMap) -> DataFrame:
    """(regelem_id, lane_id, manoeuvre) of right-of-way elements: RightOfWay for lanes that have it, else Yield."""
    mine = of_kind(m, "right_of_way").select(F.col("id").alias("regelem_id"))
    p = parameters(m).where(F.col("role").isin(FIRST, YIELD) & (F.col("kind") == "lanelet")).join(mine, "regelem_id", "left_semi")
    return p.groupBy("regelem_id", F.col("ref_id").alias("lane_id")).agg(F.when(F.bool_or(F.col("role") == FIRST), "RightOfWay").otherwise("Yield").alias("manoeuvre"))


def stop_lines(m: RoadMap) -> DataFrame:
    """(regelem_id, lane_id, stop_line) of all-way stops: the n-th line belongs to the n-th lane."""
    mine = of_kind(m, "all_way_stop").select(F.col("id").alias("regelem_id"))
    p = parameters(m).join(mine, "regelem_id", "left_semi")
    lanes = p.where((F.col("role") == YIELD) & (F.col("kind") == "lanelet")).select("regelem_id", "pos", F.col("ref_id").alias("lane_id"))
    lines = p.where(F.col("role") == STOP).select("regelem_id", "pos", F.col("ref_id").alias("stop_line"))
    return lanes.join(lines, ["regelem_id", "pos"], "left").drop("pos")


def sign_types(m: RoadMap) -> DataFrame:
    """(id, type): the subtype of an element's first sign, else its tag sign_type; null where neither is."""
    shapes = m.linestrings.select(F.lit("linestring").alias("kind"), F.col("id").alias("ref_id"), "attrs").unionByName(m.polygons.select(F.lit("polygon").alias("kind"), F.col("id").alias("ref_id"), "attrs"))
    own = m.regelem_params.where(F.col("role") == SIGN).join(shapes, ["kind", "ref_id"]).groupBy("regelem_id").agg(F.min_by(F.try_element_at("attrs", F.lit("subtype")), "pos").alias("by_sign"))
    signs = m.regelems.where(F.col("subtype").isin("traffic_sign", "speed_limit"))
    return signs.join(own, F.col("id") == F.col("regelem_id"), "left").select("id", F.coalesce("by_sign", F.try_element_at("attrs", F.lit("sign_type"))).alias("type"))


def problems(m: RoadMap) -> DataFrame:
    """(id, message) of elements that lack what their kind needs."""
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    n = m.regelem_params.groupBy(F.col("regelem_id").alias("id")).agg(count(LIGHT).alias("lights"), count(STOP).alias("stops"), count(FIRST).alias("first"), count(YIELD).alias("yields"))
    j = m.regelems.join(n, "id", "left").fillna(0, ["lights", "stops", "first", "yields"])
    say = (
        F.when((F.col("subtype") == "traffic_light") & (F.col("lights") == 0), "needs a light")
        .when((F.col("subtype") == "traffic_light") & (F.col("stops") > 1), "has several stop lines")
        .when((F.col("subtype") == "right_of_way") & ((F.col("first") == 0) | (F.col("yields") == 0)), "needs lanes that go and lanes that yield")
        .when((F.col("subtype") == "all_way_stop") & (F.col("stops") > 0) & (F.col("stops") != F.col("yields")), "needs as many stop lines as lanes")
    )
    return j.select("id", say.alias("message")).where("message is not null")


def boxes(m: RoadMap) -> DataFrame:
    """(id, box): what an element's points, lines and polygons span together."""
    lines = with_points(m.linestrings.select("id", "point_ids").unionByName(m.polygons.select("id", "point_ids")), m.points)
    parts = m.regelem_params.where(F.col("kind").isin("linestring", "polygon")).join(lines.select(F.col("id").alias("ref_id"), P.box(F.col("pts")).alias("b")), "ref_id").select("regelem_id", "b")
    dots = m.regelem_params.where("kind = 'point'").join(m.points.select(F.col("id").alias("ref_id"), F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")).alias("b")), "ref_id").select("regelem_id", "b")
    g = parts.unionByName(dots).groupBy(F.col("regelem_id").alias("id"))
    return g.agg(F.struct(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax")).alias("box"))


def is_dynamic(attrs) -> F.Column:
    return F.coalesce(A.as_bool(F.try_element_at(attrs, F.lit("dynamic"))), F.lit(False))


# ---- making and changing ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rows:
    """New elements as rows of the two tables."""

    regelems: DataFrame
    params: DataFrame

    def onto(self, m: RoadMap) -> RoadMap:
        return m.with_(regelems=m.regelems.unionByName(self.regelems), regelem_params=m.regelem_params.unionByName(self.params))


def _no_check(roles: dict[str, list]) -> str | None:
    return None


def _light(roles: dict[str, list]) -> str | None:
    return "needs a light" if not roles.get(LIGHT) else "has several stop lines" if len(roles.get(STOP, [])) > 1 else None


def _right_of_way(roles: dict[str, list]) -> str | None:
    return None if roles.get(FIRST) and roles.get(YIELD) else "needs lanes that go and lanes that yield"


def _all_way_stop(roles: dict[str, list]) -> str | None:
    stops, yields = len(roles.get(STOP, [])), len(roles.get(YIELD, []))
    return None if not stops or stops == yields else "needs as many stop lines as lanes"


_FACTORY: dict[str, Callable[[dict[str, list]], str | None]] = {"": _no_check, "traffic_light": _light, "right_of_way": _right_of_way, "all_way_stop": _all_way_stop, "traffic_sign": _no_check, "speed_limit": _no_check}


def available() -> list[str]:
    """Kinds that create knows, in order; the nameless generic one aside."""
    return sorted(k for k in _FACTORY if k)


def register(subtype: str, check: Callable[[dict[str, list]], str | None] = _no_check) -> None:
    """Adds a kind. check gets the parameters by role and says what is wrong with them, or None."""
    _FACTORY[subtype] = check


def create(spark: SparkSession, subtype: str, i: int, parameters: dict[str, list[tuple[str, int]]], attrs: dict[str, str] | None = None) -> Rows:
    """An element of a kind as rows; parameters: role -> (kind of primitive, id) in order. An unknown kind, or parameters that it can't have, are errors."""
    if subtype not in _FACTORY:
        raise InvalidInputError(f"no regulatory element of kind {subtype!r}; there are {', '.join(available())}")
    if wrong := _FACTORY[subtype](parameters):
        raise InvalidInputError(f"{subtype or 'generic'} {i} {wrong}")
    rows = [(i, role, pos, kind, ref, False) for role, refs in parameters.items() for pos, (kind, ref) in enumerate(refs)]
    return Rows(spark.createDataFrame([(i, subtype, {**(attrs or {}), "type": "regulatory_element", "subtype": subtype})], SCHEMAS["regelems"]), spark.createDataFrame(rows, SCHEMAS["regelem_params"]))


def add(m: RoadMap, role: str, refs: DataFrame) -> RoadMap:
    """Parameters (regelem_id, kind, ref_id) appended to a role, after those that are there; one that is there already is not added twice. The n-th all-way stop line so stays the n-th lane's."""
    old = m.regelem_params.where(F.col("role") == role)
    last = old.groupBy("regelem_id").agg((F.max("pos") + 1).alias("from"))
    new = refs.select("regelem_id", "kind", "ref_id").distinct().join(old.select("regelem_id", "kind", "ref_id"), ["regelem_id", "kind", "ref_id"], "left_anti")
    listed = new.groupBy("regelem_id").agg(F.sort_array(F.collect_list(F.struct("kind", "ref_id"))).alias("r")).join(last, "regelem_id", "left").select("regelem_id", "from", F.posexplode("r").alias("i", "r"))
    rows = listed.select("regelem_id", F.lit(role).alias("role"), (F.coalesce("from", F.lit(0)) + F.col("i")).cast("int").alias("pos"), "r.kind", "r.ref_id", F.lit(False).alias("inv"))
    return m.with_(regelem_params=m.regelem_params.unionByName(rows))


def remove(m: RoadMap, role: str, refs: DataFrame) -> RoadMap:
    """Parameters (regelem_id, ref_id) taken out of a role; those after them move up."""
    from pyspark.sql import Window

    mine = m.regelem_params.where(F.col("role") == role)
    left = mine.join(refs.select("regelem_id", "ref_id"), ["regelem_id", "ref_id"], "left_anti")
    left = left.withColumn("pos", (F.row_number().over(Window.partitionBy("regelem_id").orderBy("pos")) - 1).cast("int"))
    return m.with_(regelem_params=m.regelem_params.where(F.col("role") != role).unionByName(left.select(*m.regelem_params.columns)))


def set_stop_line(m: RoadMap, lines: DataFrame) -> RoadMap:
    """One stop line (regelem_id, ref_id) in place of any that an element had; a null ref_id takes it away."""
    others = m.regelem_params.join(lines.select("regelem_id", F.lit(STOP).alias("role")), ["regelem_id", "role"], "left_anti").select(*m.regelem_params.columns)
    new = lines.where("ref_id is not null").select("regelem_id", F.lit(STOP).alias("role"), F.lit(0).alias("pos"), F.lit("linestring").alias("kind"), "ref_id", F.lit(False).alias("inv"))
    return m.with_(regelem_params=others.unionByName(new))


def signs(m: RoadMap) -> DataFrame:
    """(id, signs, ref_lines, cancelling, cancel_lines, cancel_types) of traffic signs and speed limits."""
    mine = m.regelems.where(F.col("subtype").isin("traffic_sign", "speed_limit")).select("id")
    shapes = m.linestrings.select(F.lit("linestring").alias("kind"), F.col("id").alias("ref_id"), "attrs").unionByName(m.polygons.select(F.lit("polygon").alias("kind"), F.col("id").alias("ref_id"), "attrs"))
    p = m.regelem_params.join(shapes, ["kind", "ref_id"])
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "ref_id")))), lambda x: x["ref_id"])
    types = F.sort_array(F.collect_set(F.when(F.col("role") == CANCEL, F.try_element_at("attrs", F.lit("subtype")))))
    got = p.groupBy(F.col("regelem_id").alias("id")).agg(of(SIGN).alias("signs"), of(LINE).alias("ref_lines"), of(CANCEL).alias("cancelling"), of(CANCEL_LINE).alias("cancel_lines"), types.alias("cancel_types"))
    return mine.join(got, "id", "left")


def distances(m: RoadMap, at: DataFrame) -> DataFrame:
    """(regelem_id, x, y, distance) of points (regelem_id, x, y): to the nearest of an element's points, lines and filled polygons; infinite where it has none."""
    p = F.struct("x", "y")
    asked = at.select("regelem_id", "x", "y").distinct().join(m.regelem_params.select("regelem_id", "kind", "ref_id"), "regelem_id", "left")
    dots = m.points.select(F.lit("point").alias("kind"), F.col("id").alias("ref_id"), F.array(F.struct("id", "x", "y", "z")).alias("pts"))
    lines = with_points(m.linestrings, m.points).select(F.lit("linestring").alias("kind"), F.col("id").alias("ref_id"), "pts")
    rings = with_points(m.polygons, m.points).select(F.lit("polygon").alias("kind"), F.col("id").alias("ref_id"), "pts")
    j = asked.join(dots.unionByName(lines).unionByName(rings), ["kind", "ref_id"], "left")
    d = F.when(F.col("kind") == "polygon", P.distance_to_ring(F.col("pts"), p)).otherwise(P.distance_to(F.col("pts"), p))
    return j.groupBy("regelem_id", "x", "y").agg(F.coalesce(F.min(F.when(F.col("pts").isNotNull(), d)), F.lit(float("inf"))).alias("distance"))


def by_kind(**what: Column) -> Column:
    """What to make of a parameter by the kind of its primitive (point, linestring, polygon, lanelet, area); null for kinds that aren't named."""
    out = F.lit(None)
    for kind, v in what.items():
        out = F.when(F.col("kind") == kind, v).otherwise(out)
    return out
