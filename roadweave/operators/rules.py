"""Traffic rules as column expressions: who may use what, change where, and how fast.

A rule set is (location, participant). Lanes must come as views (see
model.directed): the flag inv says which way a lane is driven.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInputError
from ..functions import attributes as A

VEHICLE, PEDESTRIAN, BICYCLE = "vehicle", "pedestrian", "bicycle"
NONE, TO_LEFT, TO_RIGHT, BOTH = 0, 1, 2, 3

#: subtype of a lane or area -> who may use it; a participant matches by its name's beginning
USERS = {
    "": [VEHICLE],
    "road": [VEHICLE, BICYCLE],
    "highway": [VEHICLE],
    "bicycle_lane": [BICYCLE],
    "play_street": [PEDESTRIAN, BICYCLE, VEHICLE],
    "emergency_lane": ["vehicle:emergency"],
    "bus_lane": ["vehicle:bus", "vehicle:emergency", "vehicle:taxi"],
    "exit": [PEDESTRIAN, BICYCLE, VEHICLE],
    "walkway": [PEDESTRIAN],
    "crosswalk": [PEDESTRIAN],
    "stairs": [PEDESTRIAN],
    "shared_walkway": [PEDESTRIAN, BICYCLE],
}
#: (location, subtype) -> km/h and whether that is binding
GERMAN_SPEEDS = {
    ("urban", "road"): (50, True),
    ("nonurban", "road"): (100, True),
    ("urban", "highway"): (130, False),
    ("nonurban", "highway"): (130, False),
    ("urban", "play_street"): (7, True),
    ("nonurban", "play_street"): (7, True),
    ("urban", "bus_lane"): (50, True),
    ("nonurban", "bus_lane"): (100, True),
    ("urban", "exit"): (50, True),
}
GERMAN_SIGNS = {"de274": 30, "de274_1": 30, "de274_1-20": 20, "de310": 50} | {f"de274-{v}": v for v in (5, 10, 15, 20, *range(30, 140, 10))}


@dataclass(frozen=True)
class Rules:
    """Rules of one kind of participant at one location."""

    participant: str = VEHICLE
    location: str = "de"
    speeds: dict = field(default_factory=lambda: dict(GERMAN_SPEEDS))
    signs: dict = field(default_factory=lambda: dict(GERMAN_SIGNS))
    pedestrian_kmh: float = 5
    bicycle_kmh: float = 20


def _of(participant: str, kind: str) -> bool:
    return participant.startswith(kind)


def driving_direction(attrs: Column, inv: Column, participant: str) -> Column:
    """Forward always; backwards where one_way is no, or by one_way:<participant>, else only on foot."""
    one_way = A.as_bool(F.try_element_at(attrs, F.lit("one_way")))
    by_kind = F.coalesce(A.as_bool(A.override_for(attrs, "one_way", participant)), F.lit(True))
    back = F.when(one_way.isNotNull(), ~one_way).when(A.has_override(attrs, "one_way"), ~by_kind).otherwise(F.lit(participant == PEDESTRIAN))
    return ~inv | back


def allowed_by_type(attrs: Column, participant: str) -> Column:
    fit = [s for s, who in USERS.items() if any(participant.startswith(w) for w in who)]
    return A.attribute_or(attrs, "subtype", "").isin(fit)


def may_use(attrs: Column, participant: str) -> Column:
    """An override of participant:... decides where any exists, else the subtype."""
    by_tag = F.coalesce(A.as_bool(A.override_for(attrs, "participant", participant)), F.lit(False))
    return F.when(A.has_override(attrs, "participant"), by_tag).otherwise(allowed_by_type(attrs, participant))


def can_pass_lane(attrs: Column, inv: Column, rules: Rules) -> Column:
    return driving_direction(attrs, inv, rules.participant) & may_use(attrs, rules.participant)


def can_pass_area(attrs: Column, rules: Rules) -> Column:
    """Vehicles never drive on areas."""
    return F.lit(False) if _of(rules.participant, VEHICLE) else may_use(attrs, rules.participant)


def is_one_way(attrs: Column, rules: Rules) -> Column:
    return ~driving_direction(attrs, F.lit(True), rules.participant)


def lane_change(attrs: Column, inv: Column, participant: str, virtual_passable: bool = False) -> Column:
    """Which sides of a border may be changed to, as bits (TO_LEFT, TO_RIGHT), seen in the border's own direction turned by inv."""
    tag = lambda k: A.as_bool(F.try_element_at(attrs, F.lit(k)))
    has = lambda k: F.map_contains_key(attrs, F.lit(k))
    kind, sub = A.attribute_or(attrs, "type", ""), A.attribute_or(attrs, "subtype", "")
    line = kind.isin("line_thin", "line_thick")
    as_vehicle = F.when(line & (sub == "dashed"), BOTH).when(line & (sub == "dashed_solid"), TO_RIGHT).when(line & (sub == "solid_dashed"), TO_LEFT).otherwise(NONE)
    on_foot = F.when((kind == "curbstone") & (sub == "low"), BOTH).otherwise(NONE)
    if _of(participant, VEHICLE):
        table = as_vehicle
    elif participant == PEDESTRIAN:
        table = on_foot
    elif participant == BICYCLE:
        table = F.when(as_vehicle != NONE, as_vehicle).otherwise(on_foot)
    else:
        table = F.lit(NONE)
    yes = lambda k: F.coalesce(tag(k), F.lit(False))
    fixed = (
        F.when(has("lane_change"), F.when(yes("lane_change"), BOTH).otherwise(NONE))
        .when(has("lane_change:left") & yes("lane_change:left"), F.when(yes("lane_change:right"), BOTH).otherwise(TO_LEFT))
        .when(has("lane_change:right"), F.when(yes("lane_change:right"), TO_RIGHT).otherwise(NONE))
    )
    turned = F.when(fixed.isNotNull(), fixed).otherwise(table)
    seen = F.when(inv & (turned == TO_LEFT), TO_RIGHT).when(inv & (turned == TO_RIGHT), TO_LEFT).otherwise(turned)
    if virtual_passable:
        return F.when(fixed.isNull() & (kind == "virtual"), BOTH).otherwise(seen)
    return seen


def to_left(change: Column) -> Column:
    return change.bitwiseAND(TO_LEFT) != 0


def to_right(change: Column) -> Column:
    return change.bitwiseAND(TO_RIGHT) != 0


def sign_velocity(sign: Column, rules: Rules) -> Column:
    """Metres a second of a sign's code, or of a velocity written as one; null if neither."""
    table = F.create_map(*[F.lit(x) for k, v in rules.signs.items() for x in (k, v * A.KMH)])
    return F.coalesce(F.try_element_at(table, sign), A.as_velocity(sign))


def speed_limit(attrs: Column, rules: Rules, sign: Column | None = None) -> Column:
    """(mps, mandatory): a sign's limit for vehicles, else tags, else the location's table; 0 where none applies."""
    info = lambda v, m: F.struct(v.cast("double").alias("mps"), m.alias("mandatory"))
    if rules.participant == PEDESTRIAN:
        table = info(F.lit(rules.pedestrian_kmh * A.KMH), F.lit(True))
    elif rules.participant == BICYCLE:
        table = info(F.lit(rules.bicycle_kmh * A.KMH), F.lit(True))
    elif _of(rules.participant, VEHICLE):
        where, kind = A.attribute_or(attrs, "location", "urban"), A.attribute_or(attrs, "subtype", "road")
        table = info(F.lit(0.0), F.lit(True))
        for (loc, sub), (kmh, must) in reversed(rules.speeds.items()):
            table = F.when((where == loc) & (kind == sub), info(F.lit(kmh * A.KMH), F.lit(must))).otherwise(table)
    else:
        table = info(F.lit(0.0), F.lit(True))
    own = F.coalesce(A.as_velocity(F.try_element_at(attrs, F.lit("speed_limit"))), F.lit(0.0))
    by_tag = F.coalesce(A.as_velocity(_speed_override(attrs, rules.participant)), own)
    must = F.coalesce(A.as_bool(A.override_for(attrs, "speed_limit_mandatory", rules.participant)), F.lit(True))
    tagged = A.has_override(attrs, "speed_limit")
    out = F.when(tagged, info(by_tag, must)).otherwise(table)
    if sign is not None and _of(rules.participant, VEHICLE):
        out = F.when(sign.isNotNull(), info(F.coalesce(sign_velocity(sign, rules), F.raise_error(F.concat(F.lit("no velocity in sign "), sign)).cast("double")), F.lit(True))).otherwise(out)
    return out


def _speed_override(attrs: Column, participant: str) -> Column:
    """First speed_limit:... tag, in key order, that holds for the participant."""
    target = f"speed_limit:{participant}"
    keys = F.filter(F.array_sort(F.map_keys(attrs)), lambda k: (F.length(k) >= len("speed_limit:")) & F.startswith(F.lit(target), k))
    return F.try_element_at(attrs, F.try_element_at(keys, F.lit(1)))


_REGISTRY: dict[tuple[str, str], type | object] = {("de", p): Rules for p in (VEHICLE, PEDESTRIAN, BICYCLE)}


def register(location: str, participant: str, make) -> None:
    """Adds a rule set; make(participant, location) builds it."""
    _REGISTRY[location, participant] = make


def create(location: str, participant: str):
    """The rule set registered for (location, participant); vehicle:... falls back to vehicle."""
    make = _REGISTRY.get((location, participant)) or (_REGISTRY.get((location, VEHICLE)) if participant.startswith(VEHICLE) else None)
    if make is None:
        raise InvalidInputError(f"no traffic rules for {participant!r} at {location!r}")
    return make(participant, location)


def available() -> list[tuple[str, str]]:
    return sorted(_REGISTRY)


def has_dynamic_rules(lanelets: DataFrame, regelems: DataFrame) -> DataFrame:
    """Lanes one of whose rules has dynamic = true."""
    moving = regelems.where(F.coalesce(A.as_bool(F.try_element_at("attrs", F.lit("dynamic"))), F.lit(False))).select(F.col("id").alias("_r"))
    each = lanelets.select("id", F.explode("regelem_ids").alias("_r")).join(moving, "_r").select("id").distinct()
    return lanelets.join(each, "id", "left_semi")
