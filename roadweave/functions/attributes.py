"""Tags: typed reading, prefixes, overrides. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KMH = 1 / 3.6
MPH = 0.44704
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def as_bool(v: Column) -> Column:
    """true, yes, 1 and false, no, 0 in any case; else null."""
    low = F.lower(v)
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def as_double(v: Column) -> Column:
    """Null unless the whole string is a number."""
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


def as_int(v: Column, kind: str = "int") -> Column:
    """Null unless the whole string is an integer; blanks around it don't pass."""
    return F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast(kind))


def as_id(v: Column) -> Column:
    return as_int(v, "bigint")


def as_velocity(v: Column) -> Column:
    """Metres a second: a bare number is in km/h; known units are m/s, mps, km/h, kmh, kmph, mph, m/h (miles); else null."""
    number = F.regexp_extract(v, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    unit = F.lower(F.trim(F.regexp_replace(v, r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", "")))
    n = number.try_cast("double")
    return F.when(number == "", None).when(unit.isin("", "km/h", "kmh", "kmph"), n * KMH).when(unit.isin("m/s", "mps"), n).when(unit.isin("mph", "m/h"), n * MPH)


def velocity_text(mps: Column) -> Column:
    """A velocity as it is stored: km/h with six decimals."""
    return F.format_string("%.6f", mps / KMH)


def attribute_or(attrs: Column, key: str, default) -> Column:
    return F.coalesce(F.try_element_at(attrs, F.lit(key)), F.lit(default))


def override_for(attrs: Column, prefix: str, participant: str) -> Column:
    """Value of the first tag, in key order, whose name is prefix or is prefix:... with ... at the start of the participant's name. A coarse tag so wins over a finer one."""
    target = f"{prefix}:{participant}"
    keys = F.filter(F.array_sort(F.map_keys(attrs)), lambda k: (F.length(k) >= len(prefix)) & F.startswith(F.lit(target), k))
    return F.try_element_at(attrs, F.try_element_at(keys, F.lit(1)))


def has_override(attrs: Column, prefix: str) -> Column:
    return F.exists(F.map_keys(attrs), lambda k: F.startswith(k, F.lit(prefix)))


def set_attributes(attrs: Column, **new: str) -> Column:
    """Upsert of tags."""
    keep = F.map_filter(attrs, lambda k, _: ~k.isin(*new)) if new else attrs
    return F.map_concat(keep, F.create_map(*[F.lit(x) for kv in new.items() for x in kv])) if new else attrs


def drop_attributes(attrs: Column, *names: str) -> Column:
    return F.map_filter(attrs, lambda k, _: ~k.isin(*names))


def plain_number(v: Column, decimals: int) -> Column:
    """Fixed decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{decimals}f", v), r"(\.\d*?)0+$", "$1"), r"\.$", "")
