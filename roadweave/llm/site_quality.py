"""Quality by hierarchical empirical Bayes over documents, hosts and paths.

Evidence of a document: the log odds of a logistic classifier over its hashed
words and over how the text is made (bins of the quality rules' measures),
fitted on a bounded sample of labelled rows. Evidence of a place: the labelled rows of each host and of each
path of a host, in grouped aggregates over all labels. Shares of good rows are
shrunk, a host's towards the global share and a path's towards its host's, as
beta priors whose strengths come from the spread of the shares themselves
(method of moments): a sparse site keeps its parent's share, a rich one its own.
The posterior's log odds are the document's plus what its path adds to the
global share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import quality_rules as Q
from . import toxicity as X
from .common import per_batch, quoted, settle, shared_dir

MAX_ROWS = 20_000
KEEP_AT = 0.5
WORD_BITS = 18
MEASURES = ["n_words", *Q.RULES]


def bins(x: np.ndarray) -> np.ndarray:
    """Fine bins of a count or share: up to 8 its own, then four for each doubling."""
    v = np.maximum(x.astype(np.float64), 0)
    return np.where(v < 8, v, 8 + np.floor(4 * np.log2(np.maximum(v, 8) / 8))).astype(np.int64).clip(0, 79)


def features(column: pa.Array):
    """For each chunk of texts: each text's terms (hashed words and their beginnings, then one bin of each measure), and the texts' bounds."""
    for c, (idx, bounds) in zip(K.chunks(column), X.terms(column, WORD_BITS), strict=True):
        m = Q.measure(c)
        shape = np.stack([(1 << WORD_BITS) + 80 * i + bins(m[x]) for i, x in enumerate(MEASURES)], 1)
        sizes = np.diff(bounds)
        ends = np.cumsum(sizes + len(MEASURES))
        out = np.empty(len(idx) + shape.size, np.int64)
        own = np.repeat(np.arange(c.n), sizes)
        out[np.arange(len(idx)) + own * len(MEASURES)] = idx
        out[(ends[:, None] - len(MEASURES) + np.arange(len(MEASURES))).ravel()] = shape.ravel()
        yield out, np.concatenate([[0], ends])


def fit(idx: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> X.Machine:
    """Logistic regression: the machine of toxicity without pairs; words that few rows hold or that say nothing of the label are left out."""
    return X.fit(idx, bounds, y, bits=WORD_BITS + 1, factors=0, least_z=4.0, positive=1.0, passes=24)


def held_out(mod: int = 5, out: int = 1) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == out, F.lit(False))


def _strength(df: DataFrame, n: str, good: str, mean: str) -> float:
    """Rows that a prior is worth, from the spread of shares around their means beyond what chance gives; 5 to 5000."""
    share = F.col(good) / F.col(n)
    r = df.where(F.col(n) >= 2).agg(F.sum(F.col(n) * (share - F.col(mean)) ** 2), F.sum(F.col(mean) * (1 - F.col(mean))), F.sum(F.col(mean) * (1 - F.col(mean)) * (F.col(n) - 1)), F.count("*")).first()
    if not r[3] or not r[2]:
        return 50.0
    over = (r[0] - r[1]) / r[2]  # the share of variance that isn't chance
    return float(min(5000.0, max(5.0, 1 / over - 1 if over > 0 else 5000.0)))


def posteriors(labelled: DataFrame, where: str) -> tuple[DataFrame, float]:
    """(host, path, host_n, path_n, host_rate, path_rate) of every labelled path, and the global share. labelled: host, path, good (0 or 1)."""
    paths = settle(labelled.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("good").alias("path_good")), f"{where}/paths")
    total = paths.agg(F.sum("path_n"), F.sum("path_good")).first()
    rate = float(((total[1] or 0) + 1) / ((total[0] or 0) + 2))
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_good").alias("host_good")).withColumn("prior", F.lit(rate))
    a = _strength(hosts, "host_n", "host_good", "prior")
    hosts = hosts.select(F.col("host").alias("_h"), "host_n", ((F.col("host_good") + a * rate) / (F.col("host_n") + a)).alias("host_rate"))
    j = settle(paths.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).drop("_h"), f"{where}/hosts")
    b = _strength(j, "path_n", "path_good", "host_rate")
    return j.select("host", "path", "host_n", "path_n", "host_rate", ((F.col("path_good") + b * F.col("host_rate")) / (F.col("path_n") + b)).alias("path_rate")), rate


def classify(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", label: str = "quality", max_rows: int = MAX_ROWS, where: str | None = None) -> DataFrame:
    """doc_id, held_out, evidence, host_n, path_n, host_rate, path_rate, score, kept of every row.

    Learns from labelled rows that aren't held out. Null hosts and paths are a
    site like others; places without a label take their host's share, then the
    global one; null texts are as empty ones; very long texts count with all
    their words; repeated rows repeat; an empty table gives none; without labels
    all shares are one half; other columns of docs are not looked at. host and
    path name the columns that say where a document comes from.
    """
    spark: SparkSession = docs.sparkSession
    where = where or shared_dir(spark, "site-quality")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), quoted(host).cast("string").alias("host"), quoted(path).cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("good")).where("doc_id is not null and good is not null").where(~held_out()).groupBy("doc_id").agg(F.max("good").alias("good"))
    places = posteriors(base.select("doc_id", "host", "path").join(known, "doc_id"), where)
    table, rate = settle(places[0], f"{where}/posteriors"), places[1]

    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [np.split(i.astype(np.int32), n[1:-1]) for i, n in features(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for g in got for x in g], pa.binary())], names=["good", "x"])

    got = base.join(F.broadcast(some), "doc_id").select("good", "text").mapInArrow(per_batch(rows), "good int, x binary").orderBy(F.xxhash64("x")).toArrow()
    sets = [np.frombuffer(x, np.int32) for x in got.column(1).to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    sent = spark.sparkContext.broadcast(fit(np.concatenate(sets) if sets else np.zeros(0, np.int32), bounds, np.array(got.column(0).to_pylist(), np.float64)))

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        e = np.concatenate([sent.value.odds(i, n) for i, n in features(b.column(3))])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(e)], names=["doc_id", "host", "path", "evidence"])

    scored = base.mapInArrow(per_batch(judge), "doc_id long, host string, path string, evidence double")
    hosts = table.groupBy(F.col("host").alias("_h1")).agg(F.max("host_n").alias("host_n"), F.max("host_rate").alias("host_rate"))
    paths = table.select(F.col("host").alias("_h2"), F.col("path").alias("_p2"), "path_n", "path_rate")
    j = scored.join(hosts, F.col("host").eqNullSafe(F.col("_h1")), "left").join(paths, F.col("host").eqNullSafe(F.col("_h2")) & F.col("path").eqNullSafe(F.col("_p2")), "left")
    j = j.withColumn("host_rate", F.coalesce("host_rate", F.lit(rate))).withColumn("path_rate", F.coalesce("path_rate", "host_rate"))
    odds = lambda c: F.log(c / (1 - c))
    j = j.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + odds(F.col("path_rate")) - float(np.log(rate / (1 - rate)))))))
    return j.select("doc_id", held_out().alias("held_out"), "evidence", F.coalesce("host_n", F.lit(0)).alias("host_n"), F.coalesce("path_n", F.lit(0)).alias("path_n"), "host_rate", "path_rate", "score", (F.col("score") >= KEEP_AT).alias("kept"))
