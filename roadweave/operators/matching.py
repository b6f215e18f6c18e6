"""Matching of moving objects to lanes, in both directions, by distance or by likelihood."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polylines as P
from ..functions.flat import ring_distance
from .spatial import within


def lane_shapes(lanes: DataFrame) -> DataFrame:
    """(lane_id, ring, bbox, middle) of lanes with left_pts and right_pts; middle joins the bounds' points pairwise, where both have as many, else their ends."""
    pair = F.when(F.size("left_pts") == F.size("right_pts"), F.zip_with("left_pts", "right_pts", _mid)).otherwise(F.array(_mid(F.try_element_at(F.col("left_pts"), F.lit(1)), F.try_element_at(F.col("right_pts"), F.lit(1))), _mid(F.try_element_at(F.col("left_pts"), F.lit(-1)), F.try_element_at(F.col("right_pts"), F.lit(-1)))))
    ring = P.lane_ring(F.col("left_pts"), F.col("right_pts"))
    return lanes.select(F.col("id").alias("lane_id"), ring.alias("ring"), P.box(ring).alias("bbox"), pair.alias("middle"))


def _mid(a: Column, b: Column) -> Column:
    return F.struct(*[((a[c] + b[c]) / 2).alias(c) for c in ("x", "y", "z")])


def candidates(objects: DataFrame, shapes: DataFrame, radius: float, cell: float = 20.0) -> DataFrame:
    """Pairs of objects (object_id, x, y) and lanes within radius of the lane's surface."""
    o = objects.withColumn("abox", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")))
    return within(o, shapes, radius, ring_distance("ring", "x", "y"), cell).drop("abox", "bbox")


def deterministic(objects: DataFrame, shapes: DataFrame, radius: float, cell: float = 20.0) -> DataFrame:
    """(object_id, lane_id, inv, distance, rank): each lane within radius in both directions, by distance, then id."""
    got = candidates(objects, shapes, radius, cell).withColumn("inv", F.explode(F.array(F.lit(False), F.lit(True))))
    rank = Window.partitionBy("object_id").orderBy("distance", "lane_id", "inv")
    return got.withColumn("rank", F.row_number().over(rank)).drop("ring")


def angle_difference(a: Column, b: Column) -> Column:
    """In (-pi, pi]."""
    d = F.pmod(a - b, F.lit(2 * math.pi))
    return F.when(d > math.pi, d - 2 * math.pi).otherwise(d)


def probabilistic(objects: DataFrame, shapes: DataFrame, radius: float, cell: float = 20.0) -> DataFrame:
    """As deterministic, ordered by the squared Mahalanobis distance. objects also has yaw, cov (xx, xy, yx, yy) and kappa; a singular covariance is an error."""
    got = deterministic(objects, shapes, radius, cell).drop("rank")
    # a column for each step, so that no step's expression is written out twice
    got = got.withColumn("_at", P.to_arc(F.col("middle"), F.struct("x", "y"))["length"]).withColumn("_foot", P.project(F.col("middle"), F.struct("x", "y")))
    got = got.withColumn("_a", P.interpolate(F.col("middle"), F.greatest(F.col("_at") - 0.5, F.lit(0.0)))).withColumn("_b", P.interpolate(F.col("middle"), F.col("_at") + 0.5))
    yaw = F.atan2(F.col("_b.y") - F.col("_a.y"), F.col("_b.x") - F.col("_a.x")) + F.when(F.col("inv"), math.pi).otherwise(0.0)
    det = F.col("cov.xx") * F.col("cov.yy") - F.col("cov.xy") * F.col("cov.yx")
    got = got.withColumn("_turn", angle_difference(F.col("yaw"), yaw) * F.col("kappa")).withColumn("_dx", F.col("x") - F.col("_foot.x")).withColumn("_dy", F.col("y") - F.col("_foot.y")).withColumn("_det", det)
    safe = F.when(F.abs("_det") < 1e-8, F.raise_error(F.lit("the covariance is singular")).cast("double")).otherwise(F.col("_det"))
    dx, dy = F.col("_dx"), F.col("_dy")
    m = F.col("_turn") * F.col("_turn") + (dx * dx * F.col("cov.yy") - dx * dy * (F.col("cov.xy") + F.col("cov.yx")) + dy * dy * F.col("cov.xx")) / safe
    rank = Window.partitionBy("object_id").orderBy("mahalanobis", "lane_id", "inv")
    return got.withColumn("mahalanobis", m).withColumn("rank", F.row_number().over(rank)).drop("middle", "_at", "_foot", "_a", "_b", "_turn", "_dx", "_dy", "_det")


def only(shapes: DataFrame, passable: DataFrame) -> DataFrame:
    """Shapes of lanes that may be used in some direction: what compliant would drop in both need not be matched first."""
    return shapes.join(passable.select(F.col("id").alias("lane_id")).distinct(), "lane_id", "left_semi")


def compliant(matches: DataFrame, passable: DataFrame) -> DataFrame:
    """Matches whose lane may be used in their direction. passable: id, inv."""
    return matches.join(passable.select(F.col("id").alias("lane_id"), "inv"), ["lane_id", "inv"], "left_semi")


def close_to(objects: DataFrame, shapes: DataFrame, radius: float, cell: float = 20.0) -> DataFrame:
    """Objects with a lane within radius (0: on one)."""
    return objects.join(candidates(objects, shapes, radius, cell).select("object_id").distinct(), "object_id", "left_semi")
