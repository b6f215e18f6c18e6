"""Checks of a map's data: each gives (check_name, severity, primitive, id, message)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInputError, RoadMapError
from ..functions import attributes as A
from ..functions import polylines as P
from ..model import RoadMap, with_points
from . import graph as G
from . import rules as R
from .spatial import box_pairs

LAYERS = {"linestrings": "LineString", "lanelets": "Lanelet", "areas": "Area", "regelems": "RegulatoryElement"}
BOOL_TAGS = ["one_way", "participant", "lane_change", "fallback", "dynamic", "temporary", "area", "speed_limit_mandatory"]
KNOWN = ["type", "subtype", "one_way", "participant", "speed_limit", "location", "fallback", "dynamic", "region", "temporary", "lane_change", "width", "height", "sign_type", "color", "name", "ele", "area", "repeat", "virtual", "no_issue", "speed_limit_mandatory"]
REQUIRED = {"linestrings": ["type"], "lanelets": ["subtype"], "areas": ["subtype"], "regelems": []}
VALUES = {"location": ["urban", "nonurban", "private"], "subtype": sorted({*R.USERS, "dashed", "solid", "solid_solid", "solid_dashed", "dashed_solid", "low", "high", "parking", "freespace", "vegetation", "building", "traffic_light", "speed_limit", "traffic_sign", "right_of_way", "all_way_stop"} - {""}), "type": ["line_thin", "line_thick", "curbstone", "virtual", "road_border", "guard_rail", "wall", "fence", "zebra_marking", "stop_line", "traffic_sign", "traffic_light", "pedestrian_marking", "bike_marking", "keepout", "lanelet", "multipolygon", "regulatory_element", "jersey_barrier", "gate", "door", "trajectory", "rail", "symbol", "arrow"]}
ISSUES = "check_name string, severity string, primitive string, id bigint, message string"


def issue(df: DataFrame, check: str, severity: str, primitive: str, message: str | Column) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), F.lit(primitive).alias("primitive"), F.col("id").cast("long").alias("id"), text.alias("message"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tags(m: RoadMap) -> DataFrame:
    return _union([getattr(m, n).select("id", F.lit(name).alias("primitive"), F.explode("attrs").alias("key", "value")) for n, name in LAYERS.items()])


def _tag_issue(df: DataFrame, check: str, severity: str, text: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), "primitive", "id", text.alias("message"))


def _starts(key: Column, names: list[str]) -> Column:
    return key.rlike("^(" + "|".join(map(re.escape, names)) + ")")


def bool_tags(m: RoadMap) -> DataFrame:
    bad = _tags(m).where(_starts(F.col("key"), BOOL_TAGS) & A.as_bool(F.col("value")).isNull())
    return _tag_issue(bad, "mapping.bool_tags", "Error", F.concat(F.lit("no yes or no in "), "key", F.lit(": "), "value"))


def unknown_tags(m: RoadMap) -> DataFrame:
    return _tag_issue(_tags(m).where(~_starts(F.col("key"), KNOWN)), "mapping.unknown_tags", "Warning", F.concat(F.lit("unknown tag "), "key"))


def unknown_values(m: RoadMap) -> DataFrame:
    bad = F.lit(False)
    for k, v in VALUES.items():
        bad |= (F.col("key") == k) & ~F.col("value").isin(v)
    return _tag_issue(_tags(m).where(bad), "mapping.unknown_tag_value", "Warning", F.concat(F.lit("unknown value "), "value", F.lit(" of "), "key"))


def mandatory_tags(m: RoadMap) -> DataFrame:
    parts = []
    for n, name in LAYERS.items():
        need = F.array(*map(F.lit, REQUIRED[n])).cast("array<string>")
        lost = getattr(m, n).withColumn("lost", F.array_except(need, F.map_keys("attrs"))).where(F.size("lost") > 0)
        parts.append(issue(lost, "mapping.mandatory_tags", "Error", name, F.concat(F.lit("lacks "), F.array_join("lost", ", "))))
    return _union(parts)


def curvature_too_big(m: RoadMap, most: float = 0.5) -> DataFrame:
    lines = with_points(m.linestrings, m.points)
    bad = lines.where(F.exists(P.curvatures(F.col("pts")), lambda k: k > most)).select(F.col("id").alias("_l"))
    ends = m.lanelets.select("id", F.explode(F.array("left.id", "right.id")).alias("_l"))
    return issue(ends.join(bad, "_l").select("id").distinct(), "mapping.curvature_too_big", "Warning", "Lanelet", "a bound bends too much")


def duplicated_points(m: RoadMap) -> DataFrame:
    bad = F.exists(F.zip_with(F.slice("point_ids", F.lit(1), F.greatest(F.size("point_ids") - 1, F.lit(0))), F.slice("point_ids", F.lit(2), F.greatest(F.size("point_ids") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)
    return _union([issue(getattr(m, n).where(bad), "mapping.duplicated_points", "Error", name, "repeats a point") for n, name in (("linestrings", "LineString"), ("polygons", "Polygon"))])


def points_too_close(m: RoadMap, least: float = 0.05) -> DataFrame:
    p = m.points.select("id", "x", "y", "z", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")).alias("box"))
    a = p.select(F.col("id").alias("a"), "x", "y", "z", F.col("box").alias("abox"))
    b = p.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), F.col("box").alias("bbox"))
    d2 = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    near = box_pairs(a, b, 20 * least, least).where("a <> b").withColumn("d2", d2).withColumn("d3", F.sqrt(d2 * d2 + (F.col("z") - F.col("z2")) * (F.col("z") - F.col("z2"))))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("d2", "b"))).where((F.col("n") == 1) & (F.col("d3") < least))
    return issue(near.select(F.col("a").alias("id")), "mapping.points_too_close", "Warning", "Point", "another point is very near")


MAP_CHECKS: dict[str, Callable[[RoadMap], DataFrame]] = {
    "mapping.bool_tags": bool_tags,
    "mapping.unknown_tags": unknown_tags,
    "mapping.unknown_tag_value": unknown_values,
    "mapping.mandatory_tags": mandatory_tags,
    "mapping.curvature_too_big": curvature_too_big,
    "mapping.duplicated_points": duplicated_points,
    "mapping.points_too_close": points_too_close,
}
RULE_CHECKS: dict[str, Callable[[RoadMap, R.Rules], DataFrame]] = {}
GRAPH_CHECKS: dict[str, Callable[[G.Graph], DataFrame]] = {"routing.graph_is_valid": G.problems}
_KINDS = {"map": MAP_CHECKS, "rules": RULE_CHECKS, "graph": GRAPH_CHECKS}


def register(name: str, check: Callable[..., DataFrame], kind: str = "map") -> None:
    """Adds a check: of a map, of a map under a rule set (called for each participant), or of a graph. It gives the columns of ISSUES; a name that is taken is an error."""
    if kind not in _KINDS:
        raise InvalidInputError(f"no kind of check {kind!r}; there are {', '.join(_KINDS)}")
    if any(name in checks for checks in _KINDS.values()):
        raise InvalidInputError(f"there is a check {name} already")
    _KINDS[kind][name] = check


def unregister(name: str) -> None:
    for checks in _KINDS.values():
        checks.pop(name, None)


def available(pattern: str = "") -> list[str]:
    """Names of checks that a comma-separated list of patterns matches whole, in any case; all for an empty one."""
    names = sorted(n for checks in _KINDS.values() for n in checks)
    wanted = [p for p in pattern.split(",") if p]
    return [n for n in names if not wanted or any(re.fullmatch(p, n, re.IGNORECASE) for p in wanted)]


def validate(m: RoadMap, *, checks: str = "", location: str = "de", participants: tuple[str, ...] = ()) -> DataFrame:
    """All issues that the chosen checks find; checks of rules and of the graph run for each participant. A graph that can't be built is an issue itself."""
    names = available(checks)
    parts = [f(m) for n, f in MAP_CHECKS.items() if n in names]
    for who in participants:
        rules = R.create(location, who)
        parts += [f(m, rules) for n, f in RULE_CHECKS.items() if n in names]
        some = [f for n, f in GRAPH_CHECKS.items() if n in names]
        if some:
            try:
                g = G.build(m, rules)
            except RoadMapError as e:
                parts.append(m.points.sparkSession.createDataFrame([("general", "Error", "Map", 0, str(e))], ISSUES))
            else:
                parts += [f(g) for f in some]
    return _union(parts) if parts else m.points.sparkSession.createDataFrame([], ISSUES)


def validate_file(spark, path: str, *, projector=None, **options) -> DataFrame:
    """Issues of a map file: what its reading found wrong, as issues of the check "general", then those of validate."""
    from ..sources import osm

    got = osm.load(spark, path, projector, strict=False)
    broken = got.errors.select(F.lit("general").alias("check_name"), F.lit("Error").alias("severity"), F.col("kind").alias("primitive"), "id", "message")
    return broken.unionByName(validate(got.map, **options))


def report(issues: DataFrame) -> DataFrame:
    """(check_name, severity, n, messages) of errors and warnings; notes are left out."""
    text = F.concat_ws(" ", F.concat("severity", F.lit(":")), "primitive", F.col("id").cast("string"), "message")
    return issues.where("severity <> 'Info'").groupBy("check_name", "severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(text)).alias("messages"))
