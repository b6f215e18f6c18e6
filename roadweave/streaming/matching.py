"""Continuous map matching: a stream of object poses against a map that stands still. An extension; the semantics are those of operators.matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import polylines as P
from ..operators.matching import candidates


def match_stream(poses: DataFrame, shapes: DataFrame, radius: float, *, cell: float = 20.0, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(object_id, ts, lane_id, inv, distance) of a stream of (object_id, ts, x, y): repeated poses are dropped within the watermark, and each pose meets the lanes of its cells by a stream-static equi-join."""
    once = poses.withWatermark(ts, late).dropDuplicatesWithinWatermark(["object_id", ts])
    got = candidates(once, shapes, radius, cell)
    return got.select("object_id", ts, "lane_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("inv"), "distance")


def occupancy(matches: DataFrame, *, ts: str = "ts", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Objects on each lane in tumbling windows of event time."""
    return matches.where("not inv").withWatermark(ts, late).groupBy(F.window(ts, window), "lane_id").agg(F.approx_count_distinct("object_id").alias("objects"), F.min("distance").alias("nearest"))


def path_progress(poses: DataFrame, path) -> DataFrame:
    """Adds along, the arc length of each pose on a path (a column of points): what remains is the path's length less it."""
    return poses.withColumn("along", P.to_arc(path, F.struct("x", "y", F.lit(0.0).alias("z")))["length"])
