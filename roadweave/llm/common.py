"""Session settings, shared storage and input handling that the operators have in common."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import release, trim


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them; they should follow the input's size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, which is set here only where it is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = "file:///tmp/roadweave-shared"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, where: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends at files that outlive executors."""
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def local_path(uri: str) -> str | None:
    """The plain path of a file: or bare URI, else None."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def put_file(uri: str, parts: list[bytes]) -> None:
    """Writes a file whole or not at all: under another name first, then renamed, so that a repeated task does no harm."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            for x in parts:
                f.write(x)
        os.replace(tmp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(tmp) as f:
        for x in parts:
            f.write(x)
    store.move(tmp, path)


def map_file(uri: str):
    """A buffer over a file: memory-mapped where the folder is mounted, else read through the store's client."""
    path = local_path(uri)
    if path is not None:
        with pa.memory_map(path) as f:
            return f.read_buffer()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read_buffer()


BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Whole texts are long rows: Arrow batches of Spark's default number of them would take tens of megabytes on both sides of each worker's pipe. A number that the session has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> F.Column:
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> F.Column:
    """All of a row as one struct `row`, so that no name of the caller's meets one of an operator's; select("row.*") unpacks it."""
    return F.struct(*[quoted(c) for c in docs.columns]).alias("row")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, text string, and nothing else: other columns never reach an operator, so their names can't clash."""
    lean(docs.sparkSession)
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], owner: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: fn of each batch; batches of no rows are passed over. A worker that is used again first drops what it keeps for others than owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield from out if isinstance(out, list) else [out]
                out = None
        trim()

    return run


def learn_split(id_col: str, mod: int) -> F.Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(id_col).cast("string")) % mod


NARROW_BITS = (16, 26)


def narrow(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose doc_id may be among ids, before any shuffle: by a hashed bitmap of eight places an id, within 2**16 and 2**26 places (its broadcast has at most 2**20 rows of 16 bytes at any scale; a fuller bitmap lets more rows through). Keeps every row asked for, and some others; null ids never match."""
    ids = ids.where("id is not null")
    bits = min(max((8 * ids.count()).bit_length(), NARROW_BITS[0]), NARROW_BITS[1])
    place = lambda c: F.xxhash64(c).bitwiseAND(2**bits - 1)
    words = (
        ids.select(place(F.col("id")).alias("p"))
        .distinct()
        .groupBy(F.shiftright("p", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_bits"))
    )
    at = F.struct(place(F.col("doc_id")).alias("p"))
    row = df.select(packed(df), at.alias("_at")).withColumn("_word", F.shiftright("_at.p", 6))
    return row.join(F.broadcast(words), "_word").where("(shiftrightunsigned(_bits, cast(_at.p & 63 as int)) & 1) = 1").select("row.*")


def numbered(df: DataFrame, order: F.Column, where: str) -> DataFrame:
    """df with `k`, the place of each row in the order, from 0, and `range`, the sorted range that it lies in. No task sees all rows: ranges are sorted each by itself, and only their numbers of rows are added up together."""
    ranged = df.repartitionByRange(shuffle_parts(df.sparkSession), order).withColumn("range", F.spark_partition_id())
    ranged = settle(ranged, where).withColumn("_n", F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1)
    return before_ranges(ranged, F.lit(1), "_base").withColumn("k", F.col("_base") + F.col("_n")).drop("_base", "_n")


def before_ranges(ranged: DataFrame, value: F.Column, name: str) -> DataFrame:
    """Adds the sum of value over all ranges before a row's own."""
    per = ranged.groupBy(F.col("range").alias("_r")).agg(F.sum(value).cast("long").alias("_v"))  # a row for each range
    per = per.select("_r", F.coalesce(F.sum("_v").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias(name))
    return ranged.join(F.broadcast(per), F.col("range") == F.col("_r")).drop("_r")
