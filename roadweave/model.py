"""Tables of a road map.

A primitive is a row; a reference to one is its id, and for the two kinds that
have a direction (lines and lanes) a flag that says the reference looks at it
backwards. Tags are an open map of strings.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REF = "struct<id: bigint, inv: boolean>"
TAGS = "map<string, string>"
SCHEMAS = {
    "points": f"id bigint, x double, y double, z double, attrs {TAGS}",
    "linestrings": f"id bigint, point_ids array<bigint>, attrs {TAGS}",
    "polygons": f"id bigint, point_ids array<bigint>, attrs {TAGS}",
    "lanelets": f"id bigint, left {REF}, right {REF}, centerline_id bigint, regelem_ids array<bigint>, attrs {TAGS}",
    "areas": f"id bigint, outer array<{REF}>, inner array<array<{REF}>>, regelem_ids array<bigint>, attrs {TAGS}",
    "regelems": f"id bigint, subtype string, attrs {TAGS}",
    "regelem_params": "regelem_id bigint, role string, pos int, kind string, ref_id bigint, inv boolean",
}


@dataclass(frozen=True)
class RoadMap:
    """Six layers, and the parameters of the rules' layer."""

    points: DataFrame
    linestrings: DataFrame
    polygons: DataFrame
    lanelets: DataFrame
    areas: DataFrame
    regelems: DataFrame
    regelem_params: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **layers) -> RoadMap:
        """From DataFrames or lists of rows; layers left out are empty."""
        made = {}
        for f in fields(cls):
            x = layers.get(f.name, [])
            made[f.name] = x if isinstance(x, DataFrame) else spark.createDataFrame(x, SCHEMAS[f.name])
        return cls(**made)

    def with_(self, **layers) -> RoadMap:
        return replace(self, **layers)

    def layers(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def ref(i: Column | str, inv: bool | Column = False) -> Column:
    return F.struct(F.col(i).alias("id") if isinstance(i, str) else i.alias("id"), (F.lit(inv) if isinstance(inv, bool) else inv).alias("inv"))


def flip(r: Column) -> Column:
    """The same primitive seen backwards."""
    return F.struct(r["id"].alias("id"), (~r["inv"]).alias("inv"))


def with_points(lines: DataFrame, points: DataFrame) -> DataFrame:
    """Adds pts, the points of each line in order, as (id, x, y, z). Lines are exploded and gathered again, so a point joins by its id alone."""
    each = lines.select("id", F.posexplode("point_ids").alias("pos", "point_id"))
    p = points.select(F.col("id").alias("point_id"), "x", "y", "z")
    got = each.join(p, "point_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "point_id", "x", "y", "z"))).alias("_p"))
    pts = F.transform("_p", lambda q: F.struct(q["point_id"].alias("id"), q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z")))
    return lines.join(got.select("id", pts.alias("pts")), "id", "left").withColumn("pts", F.coalesce("pts", F.expr("array()").cast("array<struct<id: bigint, x: double, y: double, z: double>>")))


def along(pts: Column, inv: Column) -> Column:
    """Points in the order of a reference's direction."""
    return F.when(inv, F.reverse(pts)).otherwise(pts)


def directed(lanelets: DataFrame) -> DataFrame:
    """Each lane as it is and seen backwards, where its bounds swap sides and flip: column inv tells which."""
    there = lanelets.withColumn("inv", F.lit(False))
    back = lanelets.withColumn("inv", F.lit(True)).withColumn("_l", F.col("left")).withColumn("left", flip(F.col("right"))).withColumn("right", flip(F.col("_l"))).drop("_l")
    return there.unionByName(back)


def with_bounds(lanes: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds left_pts and right_pts in each bound's direction, and the bounds' tags. lines: with_points."""
    for side in ("left", "right"):
        b = lines.select(F.col("id").alias("_b"), F.col("pts").alias("_p"), F.col("attrs").alias(f"{side}_attrs"))
        lanes = lanes.join(b, F.col(f"{side}.id") == F.col("_b"), "left").withColumn(f"{side}_pts", along(F.col("_p"), F.col(f"{side}.inv"))).drop("_b", "_p")
    return lanes


def next_ids(df: DataFrame, high_water: int, order: list[str], name: str = "id") -> DataFrame:
    """Gives rows of null id the ids after high_water, dense and in the given order. Numbers follow from counts of sorted ranges, so no single task sees all rows."""
    from pyspark.sql import Window

    has, new = df.where(F.col(name).isNotNull()), df.where(F.col(name).isNull())
    ranged = new.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ranged.groupBy("_part").count()
    start = counts.withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    got = ranged.join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.col("_n") + high_water)
    return has.unionByName(got.select(*df.columns))
