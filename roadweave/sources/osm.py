"""OSM XML: reading into layers with a report of what is broken, and writing back.

Three scans of the file, one for each kind of element, and equi-joins for the
references; what does not resolve becomes a row of errors instead of an exception,
unless strict is asked for.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInputError, MapFormatError
from ..functions import attributes as A
from ..functions import polylines as P
from ..functions.projections import Projector, SphericalMercator
from ..model import SCHEMAS, RoadMap, along, flip, with_points

TAG = "tag array<struct<_k: string, _v: string>>"
NODE = f"_id bigint, _lat double, _lon double, _action string, {TAG}"
WAY = f"_id bigint, _action string, nd array<struct<_ref: bigint>>, {TAG}"
RELATION = f"_id bigint, _action string, member array<struct<_type: string, _ref: bigint, _role: string>>, {TAG}"
ERRORS = "kind string, id bigint, message string"


@dataclass(frozen=True)
class Loaded:
    map: RoadMap
    errors: DataFrame


def _attrs(col: str = "tag"):
    # of tags named twice the last counts
    last = F.aggregate(F.coalesce(F.col(col), F.expr("cast(array() as array<struct<_k: string, _v: string>>)")), F.expr("map()").cast("map<string,string>"), lambda acc, t: F.map_concat(F.map_filter(acc, lambda k, _: k != t["_k"]), F.create_map(t["_k"], t["_v"])))
    return last


def _scan(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).where("_id is not null").where("_action is null or _action <> 'delete'")


def _last(df: DataFrame) -> DataFrame:
    """Of elements with the same id the one that comes last in the file."""
    return df.withColumn("_n", F.monotonically_increasing_id()).groupBy("_id").agg(F.max_by(F.struct(*[c for c in df.columns if c != "_id"]), "_n").alias("v")).select("_id", "v.*")


def _error(df: DataFrame, kind: str, message) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), message.alias("message") if not isinstance(message, str) else F.lit(message).alias("message"))


def read(spark: SparkSession, path: str, projector: Projector | None = None, *, strict: bool = False) -> Loaded:
    """Layers of a file. A way that lacks a node is kept without points; members that lead nowhere are dropped; both are errors."""
    projector = projector or SphericalMercator()
    nodes, ways, relations = _last(_scan(spark, path, "node", NODE)), _last(_scan(spark, path, "way", WAY)), _scan(spark, path, "relation", RELATION)
    errors = []

    tags = _attrs()
    ele = F.coalesce(A.as_double(F.try_element_at(F.col("attrs"), F.lit("ele"))), F.lit(0.0))
    raw = nodes.select(F.col("_id").alias("id"), tags.alias("attrs"), F.coalesce("_lat", F.lit(0.0)).alias("lat"), F.coalesce("_lon", F.lit(0.0)).alias("lon")).withColumn("ele", ele)
    raw = raw.withColumn("p", projector.forward(F.col("lat"), F.col("lon"), F.col("ele"))).withColumn("attrs", A.drop_attributes(F.col("attrs"), "ele"))
    points = raw.where("p is not null").select("id", "p.x", "p.y", "p.z", "attrs")
    errors.append(_error(raw.where("p is null"), "node", "cannot be projected"))

    way = ways.select(F.col("_id").alias("id"), _attrs().alias("attrs"), F.transform(F.coalesce("nd", F.expr("cast(array() as array<struct<_ref: bigint>>)")), lambda n: n["_ref"]).alias("point_ids"))
    refs = way.select("id", F.explode("point_ids").alias("ref")).distinct()
    lost = refs.join(points.select(F.col("id").alias("ref")), "ref", "left_anti")
    broken = lost.groupBy("id").agg(F.sort_array(F.collect_set("ref")).alias("refs"))
    errors.append(_error(broken, "way", F.concat(F.lit("lacks nodes "), F.array_join(F.transform("refs", lambda r: r.cast("string")), ", "))))
    way = way.join(broken.select("id", F.lit(True).alias("_bad")), "id", "left").withColumn("point_ids", F.when(F.col("_bad"), F.expr("cast(array() as array<bigint>)")).otherwise(F.col("point_ids"))).drop("_bad")
    errors.append(_error(way.join(broken, "id", "left_anti").where(F.size("point_ids") == 0), "way", "has no points"))
    ring = F.coalesce(A.as_bool(F.try_element_at(F.col("attrs"), F.lit("area"))), F.lit(False))
    linestrings, polygons = way.where(~ring), way.where(ring)

    # relations: the first of an id gives the tags, members of all add up
    rel = relations.withColumn("_n", F.monotonically_increasing_id())
    heads = rel.groupBy("_id").agg(F.min_by("tag", "_n").alias("tag")).select(F.col("_id").alias("id"), _attrs().alias("attrs"))
    members = rel.select(F.col("_id").alias("id"), "_n", F.posexplode("member").alias("_p", "m")).select("id", (F.col("_n") * 100_000 + F.col("_p")).alias("pos"), F.col("m._type").alias("type"), F.col("m._ref").alias("ref"), F.coalesce("m._role", F.lit("")).alias("role"))
    known = points.select(F.lit("node").alias("type"), F.col("id").alias("ref")).union(way.select(F.lit("way"), "id")).union(heads.select(F.lit("relation"), "id"))
    dangling = members.join(known, ["type", "ref"], "left_anti")
    errors.append(_error(dangling, "relation", F.concat(F.lit("member "), "type", F.lit(" "), F.col("ref").cast("string"), F.lit(" is missing"))))
    members = members.join(known, ["type", "ref"], "left_semi")
    kind = F.try_element_at(F.col("attrs"), F.lit("type"))
    keyed = members.join(heads.select("id", kind.alias("kind")), "id")
    rules = keyed.where("role = 'regulatory_element'").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("regelem_ids"))
    none = F.expr("cast(array() as array<bigint>)")

    # lanes: one left, one right; aligned so that left is left
    sides = keyed.where("kind = 'lanelet' and type = 'way'").groupBy("id").agg(*[F.collect_list(F.when(F.col("role") == r, F.col("ref"))).alias(r) for r in ("left", "right", "centerline")])
    lanes = heads.where(kind == "lanelet").join(sides, "id", "left").join(rules, "id", "left")
    for r in ("left", "right"):
        errors.append(_error(lanes.where(F.coalesce(F.size(r), F.lit(0)) != 1), "lanelet", f"needs one {r} bound"))
    first = lambda r: F.when(F.size(r) == 1, F.try_element_at(F.col(r), F.lit(1)))
    drop_type = A.drop_attributes(F.col("attrs"), "type")
    lanes = lanes.select("id", first("left").alias("l"), first("right").alias("r"), F.try_element_at(F.col("centerline"), F.lit(1)).alias("centerline_id"), F.coalesce("regelem_ids", none).alias("regelem_ids"), drop_type.alias("attrs"))
    pts = with_points(linestrings, points).select("id", "pts")
    shaped = lanes.join(pts.select(F.col("id").alias("l"), F.col("pts").alias("lp")), "l", "left").join(pts.select(F.col("id").alias("r"), F.col("pts").alias("rp")), "r", "left")
    turn_l, turn_r = aligned(F.col("lp"), F.col("rp"))
    ref = lambda c, inv: F.struct(F.coalesce(F.col(c), F.col("id")).alias("id"), F.coalesce(inv, F.lit(False)).alias("inv"))
    lanelets = shaped.select("id", ref("l", turn_l).alias("left"), ref("r", turn_r).alias("right"), "centerline_id", "regelem_ids", "attrs")

    rings = keyed.where("kind = 'multipolygon' and type = 'way' and role in ('outer', 'inner')").join(linestrings.select(F.col("id").alias("ref"), F.try_element_at("point_ids", F.lit(1)).alias("a"), F.try_element_at("point_ids", F.lit(-1)).alias("b")), "ref")
    got = rings.select("id", "pos", "role", "ref", "a", "b").groupBy("id").applyInArrow(_assemble, "id bigint, outer array<struct<id: bigint, inv: boolean>>, inner array<array<struct<id: bigint, inv: boolean>>>, message string")
    heads_area = heads.where(kind == "multipolygon").join(got, "id", "left").join(rules, "id", "left")
    errors.append(_error(heads_area.where("message is not null or outer is null"), "area", F.coalesce("message", F.lit("has no outer bound"))))
    areas = heads_area.where("message is null and outer is not null").select("id", "outer", "inner", F.coalesce("regelem_ids", none).alias("regelem_ids"), drop_type.alias("attrs"))

    regs = heads.where(kind == "regulatory_element")
    sub = F.try_element_at(F.col("attrs"), F.lit("subtype"))
    errors.append(_error(regs.where(sub.isNull()), "regulatory_element", "has no subtype"))
    regelems = regs.where(sub.isNotNull()).select("id", sub.alias("subtype"), A.drop_attributes(F.col("attrs"), "type", "subtype").alias("attrs"))
    of_rule = keyed.where("kind = 'regulatory_element'").join(regelems.select("id"), "id", "left_semi")
    target = linestrings.select(F.lit("way").alias("type"), F.col("id").alias("ref"), F.lit("linestring").alias("to")).union(polygons.select(F.lit("way"), "id", F.lit("polygon"))).union(points.select(F.lit("node"), "id", F.lit("point"))).union(lanelets.select(F.lit("relation"), "id", F.lit("lanelet"))).union(areas.select(F.lit("relation"), "id", F.lit("area")))
    params = of_rule.join(target, ["type", "ref"], "left")
    errors.append(_error(params.where("to is null"), "regulatory_element", F.concat(F.lit("cannot refer to "), "type", F.lit(" "), F.col("ref").cast("string"))))
    params = params.where("to is not null").select(F.col("id").alias("regelem_id"), "role", (F.row_number().over(_by_role()) - 1).alias("pos"), F.col("to").alias("kind"), F.col("ref").alias("ref_id"), F.lit(False).alias("inv"))

    out = errors[0]
    for e in errors[1:]:
        out = out.unionByName(e)
    if strict:
        found = out.limit(100).collect()
        if found:
            raise MapFormatError([f"{r.kind} {r.id}: {r.message}" for r in found])
    fit = lambda df, n: df.select(*[F.col(c).cast(t.dataType) for c, t in ((f.name, f) for f in spark.createDataFrame([], SCHEMAS[n]).schema)])
    return Loaded(RoadMap(fit(points, "points"), fit(linestrings, "linestrings"), fit(polygons, "polygons"), fit(lanelets, "lanelets"), fit(areas, "areas"), fit(regelems, "regelems"), fit(params, "regelem_params")), out)


def _by_role():
    from pyspark.sql import Window

    return Window.partitionBy("id", "role").orderBy("pos")


def aligned(left, right):
    """Whether each bound must be turned so that left lies left of right, judged by the other's middle."""
    mid = lambda p: F.when(F.size(p) <= 2, F.struct(*[((F.try_element_at(p, F.lit(1))[c] + F.try_element_at(p, F.lit(-1))[c]) / 2).alias(c) for c in ("x", "y", "z")])).otherwise(F.try_element_at(p, F.floor(F.size(p) / 2).cast("int") + 1).cast("struct<id: bigint, x: double, y: double, z: double>").dropFields("id"))
    ok = (F.size(left) > 1) & (F.size(right) > 1)
    return F.when(ok, P.signed_distance(left, mid(right)) > 0), F.when(ok, P.signed_distance(right, mid(left)) < 0)


def chain(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, bool]]] | None:
    """Rings of (id, inv) from lines (id, first point, last point), in order, each joined to the first that goes on; None if one does not close."""
    left, out = list(parts), []
    while left:
        i, a, b = left.pop(0)
        ring, start, end = [(i, False)], a, b
        while end != start:
            for n, (j, c, d) in enumerate(left):
                if c == end or d == end:
                    ring.append((j, c != end))
                    end = d if c == end else c
                    left.pop(n)
                    break
            else:
                return None
        out.append(ring)
    return out


def _assemble(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["pos"])
    rings = {role: chain([(r["ref"], r["a"], r["b"]) for r in rows if r["role"] == role]) for role in ("outer", "inner")}
    message = None
    if not rings["outer"] or len(rings["outer"]) != 1:
        message = "the outer bounds don't make one ring"
    elif rings["inner"] is None:
        message = "the inner bounds don't make rings"
    refs = lambda r: [{"id": i, "inv": v} for i, v in r]
    outer = refs(rings["outer"][0]) if message is None else None
    inner = [refs(r) for r in rings["inner"]] if message is None else None
    s = pa.struct([("id", pa.int64()), ("inv", pa.bool_())])
    return pa.table([pa.array([rows[0]["id"]], pa.int64()), pa.array([outer], pa.list_(s)), pa.array([inner], pa.list_(pa.list_(s))), pa.array([message], pa.string())], names=["id", "outer", "inner", "message"])


def lines_of(m: RoadMap, projector: Projector | None = None, *, josm_elevation: bool = False) -> DataFrame:
    """(rank, id, line): XML of every element; nodes, then ways, then relations, each by id."""
    projector = projector or SphericalMercator()
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tags = lambda a: F.array_join(F.transform(F.array_sort(F.map_entries(a)), lambda e: F.concat(F.lit('<tag k="'), esc(e["key"]), F.lit('" v="'), esc(e["value"]), F.lit('"/>'))), "")
    head = lambda kind: F.concat(F.lit(f'<{kind} id="'), F.col("id").cast("string"), F.when(F.col("id") > 0, '" visible="true" version="1"').otherwise('"'))
    gps = m.points.withColumn("g", projector.reverse(F.col("x"), F.col("y"), F.col("z")))
    ele = A.plain_number(F.col("g.ele"), 2 if josm_elevation else 6)
    # what rounds to nothing is no elevation
    tagged = F.when(F.abs(F.col("g.ele")) > 1e-9, A.set_attributes(F.col("attrs"))).otherwise(F.col("attrs"))
    with_ele = F.when(F.abs(F.col("g.ele")) > 1e-9, F.map_concat(A.drop_attributes(tagged, "ele"), F.create_map(F.lit("ele"), ele))).otherwise(F.col("attrs"))
    nodes = gps.select(F.lit(0).alias("rank"), "id", F.concat(head("node"), F.lit(' lat="'), A.plain_number(F.col("g.lat"), 11), F.lit('" lon="'), A.plain_number(F.col("g.lon"), 11), F.lit('">'), tags(with_ele), F.lit("</node>")).alias("line"))

    def way(df: DataFrame, a) -> DataFrame:
        nds = F.array_join(F.transform("point_ids", lambda i: F.concat(F.lit('<nd ref="'), i.cast("string"), F.lit('"/>'))), "")
        return df.select(F.lit(1).alias("rank"), "id", F.concat(head("way"), F.lit(">"), nds, tags(a), F.lit("</way>")).alias("line"))

    add = lambda **kv: F.map_concat(A.drop_attributes(F.col("attrs"), *kv), F.create_map(*[F.lit(x) for p in kv.items() for x in p]))
    member = lambda kind, i, role: F.concat(F.lit(f'<member type="{kind}" ref="'), i.cast("string"), F.lit('" role="'), (F.lit(role) if isinstance(role, str) else esc(role)), F.lit('"/>'))
    regs = F.array_join(F.transform("regelem_ids", lambda i: member("relation", i, "regulatory_element")), "")
    relation = lambda df, body, a: df.select(F.lit(2).alias("rank"), "id", F.concat(head("relation"), F.lit(">"), body, tags(a), F.lit("</relation>")).alias("line"))
    lanes = relation(m.lanelets, F.concat(member("way", F.col("left.id"), "left"), member("way", F.col("right.id"), "right"), F.coalesce(member("way", F.col("centerline_id"), "centerline"), F.lit("")), regs), add(type="lanelet"))
    rings = lambda c, role: F.array_join(F.transform(c, lambda r: member("way", r["id"], role)), "")
    areas = relation(m.areas, F.concat(rings(F.col("outer"), "outer"), rings(F.flatten("inner"), "inner"), regs), add(type="multipolygon"))
    kinds = F.when(F.col("kind") == "point", "node").when(F.col("kind").isin("linestring", "polygon"), "way").otherwise("relation")
    params = m.regelem_params.select(F.col("regelem_id").alias("id"), F.struct("role", "pos", F.concat(F.lit('<member type="'), kinds, F.lit('" ref="'), F.col("ref_id").cast("string"), F.lit('" role="'), esc(F.col("role")), F.lit('"/>')).alias("line")).alias("p"))
    body = params.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["line"]), "").alias("body"))
    rules = relation(m.regelems.join(body, "id", "left").withColumn("attrs", F.map_concat(A.drop_attributes(F.col("attrs"), "type", "subtype"), F.create_map(F.lit("type"), F.lit("regulatory_element"), F.lit("subtype"), F.coalesce("subtype", F.lit(""))))), F.coalesce("body", F.lit("")), F.col("attrs"))
    out = nodes.unionByName(way(m.linestrings, F.col("attrs"))).unionByName(way(m.polygons, add(area="true")))
    return out.unionByName(lanes).unionByName(areas).unionByName(rules)


def write(m: RoadMap, path: str, projector: Projector | None = None, *, josm_upload: bool | None = None, josm_elevation: bool = False) -> None:
    """One XML file, streamed through the driver in order, an element at a time."""
    up = "" if josm_upload is None else f' upload="{str(josm_upload).lower()}"'
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6" generator="roadweave"{up}>\n')
        for r in lines_of(m, projector, josm_elevation=josm_elevation).orderBy("rank", "id").toLocalIterator():
            f.write(f"  {r.line}\n")
        f.write("</osm>\n")


def write_layers(m: RoadMap, path: str) -> None:
    """The lossless form: a Parquet table for each layer."""
    for n, df in m.layers().items():
        df.write.mode("overwrite").parquet(f"{path}/{n}")


def read_layers(spark: SparkSession, path: str) -> RoadMap:
    return RoadMap(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in SCHEMAS.items()})


_READERS = {".osm": lambda spark, path, **o: read(spark, path, **o), ".bin": lambda spark, path, **o: Loaded(read_layers(spark, path), spark.createDataFrame([], ERRORS))}
_WRITERS = {".osm": write, ".bin": lambda m, path, projector=None, **o: write_layers(m, path)}


_NAMES = {"osm_handler": ".osm", "bin_handler": ".bin"}


def supported() -> dict[str, list[str]]:
    return {"readers": sorted(_READERS), "writers": sorted(_WRITERS)}


def register(extension: str, *, reader=None, writer=None, name: str | None = None) -> None:
    """Adds a reader or a writer by the files' extension, and by a name where one is given."""
    if name:
        _NAMES[name] = extension
    if reader:
        _READERS[extension] = reader
    if writer:
        _WRITERS[extension] = writer


def _kind(path: str, name: str | None, known: dict, what: str) -> str:
    if name is not None and name not in _NAMES:
        raise InvalidInputError(f"no {what} {name!r}; there are {', '.join(sorted(_NAMES))}")
    ext = _NAMES[name] if name is not None else os.path.splitext(path)[1]
    if ext not in known:
        raise InvalidInputError(f"no {what} for {ext!r}; there are {', '.join(sorted(known))}")
    return ext


def load(spark: SparkSession, path: str, projector: Projector | None = None, *, strict: bool = True, parser: str | None = None) -> Loaded:
    """By the file's extension, or by a parser's name; strict raises what it finds broken, else it is in errors."""
    ext = _kind(path, parser, _READERS, "reader")
    return _READERS[ext](spark, path, **({"projector": projector, "strict": strict} if ext == ".osm" else {}))


def save(m: RoadMap, path: str, projector: Projector | None = None, *, writer: str | None = None, **options) -> None:
    _WRITERS[_kind(path, writer, _WRITERS, "writer")](m, path, projector, **options)


__all__ = ["Loaded", "aligned", "along", "chain", "flip", "load", "read", "read_layers", "register", "save", "supported", "write", "write_layers"]
