"""Spatial joins: shapes meet in grid cells by an equi-join, boxes filter, exact tests decide.

A shape is listed in each cell that its box touches, so the work of a pair is
done where both are; of the cells that a pair shares only the one that holds the
lower corner of the boxes' intersection counts it, so no distinct is needed.
Crowded cells are what AQE splits: both sides come from plain exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NoSuchPrimitiveError
from ..functions import boxes as B
from ..functions import polylines as P
from ..functions.geometry import rings_overlap


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many tasks as keep all cores busy, for kernels that take long: by its size alone a small file, or a small shuffle, would be a task or two."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def lookup(layer: DataFrame, i: int) -> DataFrame:
    """The row of an id; an error if there is none (0 never is one)."""
    got = layer.where(F.col("id") == i)
    if i == 0 or got.isEmpty():
        raise NoSuchPrimitiveError(f"no primitive {i}")
    return got


def search(layer: DataFrame, box: Column, on: str = "box") -> DataFrame:
    """Rows whose box meets a box; rows without one never do."""
    return layer.where(B.intersects(F.col(on), box))


def search_until(layer: DataFrame, box: Column, predicate: Column, on: str = "box") -> DataFrame:
    """The first row, by id, that meets the box and the predicate."""
    return search(layer, box, on).where(predicate).orderBy("id").limit(1)


def nearest(layer: DataFrame, p: Column, n: int, on: str = "box") -> DataFrame:
    """n rows by distance of their boxes, ties by id."""
    return layer.withColumn("distance", B.exterior_distance(F.col(on), p)).where(F.col("distance").isNotNull()).orderBy("distance", "id").limit(n)


def nearest_until(layer: DataFrame, p: Column, predicate: Column, on: str = "box") -> DataFrame:
    """The row nearest by its box among those that meet the predicate."""
    return nearest(layer.where(predicate), p, 1, on)


def box_pairs(a: DataFrame, b: DataFrame, cell: float, by: float = 0.0, *, grown: str = "a") -> DataFrame:
    """Rows of a (columns a, abox) and b (b, bbox) whose boxes meet, one of them grown by `by`: that of the side with fewer rows had better be, as it is listed in more cells."""
    grow = lambda df, side: df.withColumn(f"_{side}", B.grow(F.col(f"{side}box"), by) if side == grown else F.col(f"{side}box")).withColumn("_c", F.explode(B.cells(F.col(f"_{side}"), cell)))
    first = F.struct(F.floor(F.greatest(F.col("_a.xmin"), F.col("_b.xmin")) / cell).alias("cx"), F.floor(F.greatest(F.col("_a.ymin"), F.col("_b.ymin")) / cell).alias("cy"))
    return grow(a, "a").join(grow(b, "b"), "_c").where(B.intersects(F.col("_a"), F.col("_b"))).where(F.col("_c") == first).drop("_a", "_b", "_c")


def within(objects: DataFrame, shapes: DataFrame, radius: float, distance: Column, cell: float, *, grown: str = "a") -> DataFrame:
    """Range join: pairs of objects (box abox) and shapes (box bbox) with distance <= radius; the expression may use both sides' columns. grown="b" where objects are more than shapes."""
    return box_pairs(objects, shapes, cell, radius, grown=grown).withColumn("distance", distance).where(F.col("distance") <= radius)


def knn(objects: DataFrame, shapes: DataFrame, n: int, distance: Column, *, key: str, other: str, cell: float) -> DataFrame:
    """For each object the n nearest shapes by exact distance, ties by their id.

    The search radius starts at one cell and grows fourfold; an object is done
    once n shapes lie within its radius, or once the radius covers all there is.
    So the grid only bounds how many are tried at a time, never the answer. What
    a round has found and who is still open is written out, so no round is
    computed twice.
    """
    from .graph import checkpointed

    spark = objects.sparkSession
    objects, shapes = checkpointed(spark, objects), checkpointed(spark, shapes)
    o, s = objects.agg(*_extent("abox")).first(), shapes.agg(*_extent("bbox")).first()
    if o[0] is None or s[0] is None:
        return within(objects, shapes, 0.0, distance, cell).limit(0).withColumn("rank", F.lit(0))
    span = max(max(o[2], s[2]) - min(o[0], s[0]), max(o[3], s[3]) - min(o[1], s[1])) + cell
    many = shapes.count()
    rank = Window.partitionBy(key).orderBy("distance", other)
    radius, open_, out = cell, objects, None
    while True:
        last = radius >= 2 * span
        got = within(open_, shapes, radius, distance, max(cell, radius), grown="b" if open_.count() > many else "a").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)
        got = checkpointed(spark, got.withColumn("_n", F.count("*").over(Window.partitionBy(key))))
        done = (got if last else got.where(F.col("_n") >= n)).drop("_n")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        open_ = checkpointed(spark, open_.join(done.where("rank = 1").select(key), key, "left_anti"))
        if open_.isEmpty():
            return out
        radius *= 4


def _extent(box: str) -> list[Column]:
    return [F.min(f"{box}.xmin"), F.min(f"{box}.ymin"), F.max(f"{box}.xmax"), F.max(f"{box}.ymax")]


def overlapping_pairs(rings: DataFrame, cell: float = 25.0) -> DataFrame:
    """(a, b), a < b, of rings (id, ring) that overlap. Pairs that share a border only are sorted out by the exact test; rings that are parted along an axis never reach it."""
    flat = rings.select("id", "ring", P.box(F.col("ring")).alias("box"))
    a = flat.select(F.col("id").alias("a"), F.col("ring").alias("ra"), F.col("box").alias("abox"))
    b = flat.select(F.col("id").alias("b"), F.col("ring").alias("rb"), F.col("box").alias("bbox"))
    near = box_pairs(a, b, cell).where("a < b").where(B.volume(B.intersection(F.col("abox"), F.col("bbox"))) > 0)
    # rings parted by one of their own edges: cheap and exact for convex ones, never wrong for others
    near = near.where(~_parted(F.col("ra"), F.col("rb")) & ~_parted(F.col("rb"), F.col("ra")))
    return near.where(rings_overlap("ra", "rb")).select("a", "b")


def _parted(r: Column, q: Column) -> Column:
    """Whether an edge's line of r has all of r on one side and all of q on the other (or on it)."""
    side = lambda s, p: (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])
    eps = 1e-9
    span = lambda s, pts: F.transform(pts, lambda p: side(s, p))
    ends = F.transform(P.ring_segments(r), lambda s: F.struct(span(s, r).alias("r"), span(s, q).alias("q")))
    ends = F.transform(ends, lambda e: F.struct(F.array_min(e["r"]).alias("r0"), F.array_max(e["r"]).alias("r1"), F.array_min(e["q"]).alias("q0"), F.array_max(e["q"]).alias("q1")))
    return F.exists(ends, lambda e: ((e["r0"] >= -eps) & (e["q1"] <= eps)) | ((e["r1"] <= eps) & (e["q0"] >= -eps)))
