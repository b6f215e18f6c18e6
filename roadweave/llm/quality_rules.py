"""Quality rules with thresholds that adapt to language and source.

One pass measures every text. The measures that rules look at are integers (in
hundredths or ten-thousandths), and each cell of language and source gets a
quantile sketch of each: counts of buckets whose width is at most a 32nd of
their values. Such sketches merge by adding counts, so Spark combines them
within tasks before any shuffle, a cell that holds a third of all rows is no
hotter than others, and languages' and the corpus's sketches are sums of cells'.
Sparse cells use their language's sketch, sparse languages the corpus's.

A measure fails beyond its cell's fence: the median, plus FENCE times its
distance from the first quartile, plus a slack that keeps ordinary texts in cells
where that distance is nothing. Junk pulls measures up, so the lower half stays
sound while less than half of a cell is junk. (Mirrored where a measure may also
be too low.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import lean, per_batch, settle, shared_dir

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
PUNCT = np.zeros(256, bool)
PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
WINDOW = 5
FENCE = 8
LEAST_CELL = 50

#: measure -> (slack above, slack below or None: never too low)
RULES = {"word_length": (400, 200), "symbol_share": (600, None), "upper_share": (1500, None), "punct_share": (1200, None), "dup_line_share": (6000, None), "repeat_share": (2000, None)}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Flags of keys that occur twice or more."""
    o = np.argsort(keys)
    s = keys[o]
    eq = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[o[1:][eq]] = True
    out[o[:-1][eq]] = True
    return out


def measure(c: K.Chunk) -> dict[str, np.ndarray]:
    """Counts and rule measures of each text of a chunk."""
    data, n = c.data, c.n
    s, e, first = c.words()
    solid = ~K.SPACE[data]
    lead = (data & 0xC0) != 0x80
    words = np.diff(first)
    chars = c.count(solid & lead)
    out = {"n_words": words, "word_chars": chars, "n_symbols": c.count(SYMBOLS[data])}
    # lines: bounded by line ends and by the text's own ends
    end = np.flatnonzero(data == 10)
    ls = np.unique(np.concatenate([c.off[:-1], end + 1]))
    own = np.searchsorted(c.off, ls, "right") - 1
    real = ls < c.off[np.minimum(own + 1, n)] if len(ls) else np.zeros(0, bool)
    own, ls = own[real], ls[real]
    le = np.minimum(np.append(np.append(end, len(data)), len(data))[np.searchsorted(end, ls)], c.off[own + 1])
    some = np.concatenate([[0], np.cumsum(solid)])
    full = some[le] > some[ls]
    own, ls, le = own[full], ls[full], le[full]
    salt = K.mix64(np.arange(n, dtype=np.uint64) + np.uint64(1))
    keys = c.hash_ranges(ls, le) + salt[own]
    order = np.argsort(keys)
    lines = np.bincount(own, minlength=n)
    again = keys[order][1:] == keys[order][:-1]
    out["n_dup_lines"] = np.bincount(own[order[1:]][again], minlength=n)
    # windows of five words
    h = c.hash_ranges(s, e)
    m = max(0, len(h) - WINDOW + 1)
    doc = K.owner(first, len(h))
    acc = np.zeros(m, np.uint64)
    for j in range(WINDOW):
        acc *= K._Q
        acc += h[j : j + m]
    inside = doc[:m] == doc[WINDOW - 1 : WINDOW - 1 + m]
    at = np.flatnonzero(inside)
    rep = at[_repeats(K.mix64(acc[at]) + salt[doc[at]])]
    step = np.zeros(len(h) + 1, np.int32)
    step[rep] += 1
    np.subtract.at(step, rep + WINDOW, 1)
    covered = np.cumsum(step)[:-1] > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    some = np.maximum(chars, 1)
    out["word_length"] = 100 * chars // np.maximum(words, 1)
    out["symbol_share"] = 10_000 * out["n_symbols"] // some
    out["upper_share"] = 10_000 * c.count(UPPER[data]) // some
    out["punct_share"] = 10_000 * c.count(PUNCT[data]) // some
    out["dup_line_share"] = 10_000 * out["n_dup_lines"] // np.maximum(lines, 1)
    out["repeat_share"] = 10_000 * out["n_repeat_words"] // np.maximum(words, 1)
    return out


def annotate(df: DataFrame, text: F.Column, carry: list[str]) -> DataFrame:
    """Struct column `carried` (the columns named), `lang`, `source`, and the measures of text in columns of their own."""
    lean(df.sparkSession)
    names = [*COUNTS, *RULES]
    shaped = df.select(text.cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    schema = T.StructType([shaped.schema["carried"], shaped.schema["lang"], shaped.schema["source"], *[T.StructField(x, T.LongType()) for x in names]])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [measure(c) for c in K.chunks(b.column(0))]
        cols = [pa.array(np.concatenate([g[x] for g in got]).astype(np.int64)) for x in names]
        return pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), *cols], names=["carried", "lang", "source", *names])

    return shaped.mapInArrow(per_batch(run), schema)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the cells' quantile sketches."""

    def bucket(c: str) -> F.Column:
        # values under 64 are their own bucket, others keep their six leading bits
        return F.expr(f"shiftleft(shiftright({c}, greatest(length(bin({c})) - 6, 0)), greatest(length(bin({c})) - 6, 0))")

    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(r).alias("bucket")) for r in RULES]))
    return measured.select("lang", "source", each.alias("x")).groupBy("lang", "source", F.col("x.rule").alias("rule"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(cells: DataFrame) -> DataFrame:
    """(lang, source, then low_ and high_ of each rule) of every cell."""

    def fences(hist: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by, "rule")
        run = hist.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        q = run.groupBy(*by, "rule").agg(F.max("total").alias("total"), F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"), F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("bucket"))).alias("q2"), F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"))
        return q.select(*by, "rule", "total", (F.col("q2") + FENCE * (F.col("q2") - F.col("q1"))).alias("high"), (F.col("q2") - FENCE * (F.col("q3") - F.col("q2"))).alias("low"))

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.withColumnsRenamed({"total": f"total_{tag}", "high": f"high_{tag}", "low": f"low_{tag}"})

    own = named(fences(cells, ["lang", "source"]), "c")
    lang = named(fences(cells.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n")), ["lang"]), "l").withColumnsRenamed({"lang": "lang_l", "rule": "rule_l"})
    every = named(fences(cells.groupBy("rule", "bucket").agg(F.sum("n").alias("n")), []), "g").withColumnRenamed("rule", "rule_g")
    j = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_l")) & (F.col("rule") == F.col("rule_l"))).join(every, F.col("rule") == F.col("rule_g"))
    pick = lambda x: F.when(F.col("total_c") >= LEAST_CELL, F.col(f"{x}_c")).when(F.col("total_l") >= LEAST_CELL, F.col(f"{x}_l")).otherwise(F.col(f"{x}_g"))
    j = j.select("lang", "source", "rule", pick("high").alias("high"), pick("low").alias("low"))
    one = lambda r, x: F.max(F.when(F.col("rule") == r, F.col(x)))
    return j.groupBy("lang", "source").agg(*[(one(r, "high") + up).alias(f"high_{r}") for r, (up, _) in RULES.items()], *[(one(r, "low") - down).alias(f"low_{r}") for r, (_, down) in RULES.items() if down is not None])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept, by a join with the cells' thresholds (null-safe: null languages and sources are cells too)."""
    t = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    j = measured.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fine = F.lit(True)
    for r, (_, down) in RULES.items():
        fine &= F.col(r) <= F.col(f"high_{r}")
        if down is not None:
            fine &= F.col(r) >= F.col(f"low_{r}")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return j.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(fine, F.lit(True)))


def rules(docs: DataFrame, where: str | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the measures of every row.

    Null texts have no words and so fail; null languages or sources are a value
    like others; very long texts are measured whole; repeated rows count as often
    as they occur; an empty table gives an empty result; other columns of docs
    are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    where = where or shared_dir(spark, "quality")
    measured = settle(annotate(docs, F.col("text"), ["doc_id"]), f"{where}/measures")
    limits = settle(thresholds(sketches(measured)), f"{where}/limits")
    return judge(measured, limits).select(F.col("carried.doc_id").cast("long").alias("doc_id"), *COUNTS, "base_failed", "kept", *RULES)


def keep(docs: DataFrame, where: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that pass. Texts are measured twice, once for the sketches and once beside the rows, and never shuffled. Nulls, repeated rows and empty tables as in rules; columns may have any name."""
    spark: SparkSession = docs.sparkSession
    where = where or shared_dir(spark, "quality")
    limits = settle(thresholds(sketches(annotate(docs, F.col("text"), ["doc_id"]))), f"{where}/limits")
    return judge(annotate(docs, F.col("text"), docs.columns), limits).where("kept").select(*[F.col("carried").getField(c).alias(c) for c in docs.columns])
