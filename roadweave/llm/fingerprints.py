"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least distinct hashes of a text's word shingles. Sketches
merge by keeping the k least of their union, so parts of a document, or tasks
and then sites of a corpus, can be sketched apart. Two sketches estimate
resemblance and containment of the shingle sets; one its distinct count.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import keyed, per_batch, shuffle_parts

SIZE, SHINGLE = 128, 5
BITS = 48


def sketches_of(column: pa.Array, k: int = SHINGLE, size: int = SIZE):
    """For each text: its `size` least distinct shingle hashes (BITS bits), rising. No words: none."""
    for c in K.chunks(column):
        low = c.lower()
        s, e, first = low.words()
        sh, bounds = K.shingles(low.hash_ranges(s, e), first, k)
        sh >>= K.U64(64 - BITS)
        for d in range(c.n):
            u = sh[bounds[d] : bounds[d + 1]]
            if len(u) > 8 * size:  # the least 4 * size hold the least `size` distinct ones, but for texts that repeat a lot
                v = np.sort(np.partition(u, 4 * size)[: 4 * size])
                v = v[np.concatenate([[True], v[1:] != v[:-1]])]
                if len(v) >= size:
                    yield v[:size]
                    continue
            u = np.sort(u)
            if len(u) > 1:
                u = u[np.concatenate([[True], u[1:] != u[:-1]])]
            yield u[:size]


def pack(sketch: np.ndarray) -> str:
    """Six bytes a hash, in base 64."""
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
    return base64.b64encode(raw.tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - BITS // 8 :] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.union1d(a, b)[:size]


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact while there are under `size`."""
    return float(len(a)) if len(a) < size else (size - 1) / ((float(a[size - 1]) + 1) / 2**BITS)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimate of |A & B| / |A | B|; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    new = np.concatenate([[True], ~twice])
    least = int(min(size, new.sum()))
    last = both[new][least - 1]
    return float((twice & (both[1:] <= last)).sum()) / least


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimate of |A & B| / |A|; 1 for an empty A."""
    if not len(a):
        return 1.0
    r, union = resemblance(a, b, size), distinct(merge(a, b, size), size)
    return min(1.0, r * union / max(distinct(a, size), 1.0))


def sketch(docs: DataFrame, *, k: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint, shingles) of every row; null texts are as empty ones, whose fingerprint is ''."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = list(sketches_of(b.column(1), k, size))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(x) for x in s]), pa.array([distinct(x, size) for x in s], pa.float64())], names=["doc_id", "fingerprint", "shingles"])

    return keyed(docs).mapInArrow(per_batch(run), "doc_id long, fingerprint string, shingles double")


def merged(sketches: DataFrame, by: str, column: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """(by, column): sketches of whole groups. Each task first keeps one sketch for each of its groups, so a hot group sends one row a task."""

    def fold(batches):
        held: dict = {}
        for b in batches:
            for g, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = unpack(f or "")
                held[g] = merge(held[g], x, size) if g in held else x
                if len(held) >= 50_000:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([pack(x) for x in held.values()])], names=[by, column])

    field = sketches.schema[by]
    kind = pa.int64() if field.dataType.simpleString() == "bigint" else pa.string()
    part = sketches.select(by, column) if kind == pa.int64() else sketches.select(F.col(by).cast("string").alias(by), column)
    schema = f"`{by}` {'long' if kind == pa.int64() else 'string'}, `{column}` string"
    return part.mapInArrow(fold, schema).repartition(shuffle_parts(sketches.sparkSession), by).sortWithinPartitions(by).mapInArrow(fold, schema)


_DEALT = "bucket int, tail boolean, doc_id long, known boolean, text string, tie long"


def with_successors(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt out by ranges of doc_id, in order within each range. A range ends with copies (tail) of the rows that open the next one, so each row's successor comes after it; the last range ends with the corpus's first rows. Null ids come first."""
    base = keyed(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("text", F.lit("")).alias("text"))
    probes = [i / parts for i in range(parts)]
    got = base.agg(F.percentile_approx("doc_id", probes, 100 * parts).alias("q"), F.min("doc_id").alias("least")).first()
    cuts = np.array(sorted({got.least, *got.q}) if got.q else [], np.int64)  # each opens a range and is the id of a row

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column(0).to_numpy()
        at = np.searchsorted(cuts, ids, "right") - 1
        opens = np.flatnonzero(cuts[at] == ids)
        take = pa.array(np.concatenate([np.arange(len(ids)), opens]))
        bucket = np.concatenate([at, (at[opens] - 1) % len(cuts)]).astype(np.int32)
        tail = np.concatenate([np.zeros(len(ids), bool), np.ones(len(opens), bool)])
        rest = b.take(take)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(tail), rest.column(0), rest.column(1), rest.column(2), rest.column(3)], names=[x.split()[0] for x in _DEALT.split(", ")])

    dealt = base.withColumn("tie", F.xxhash64("text")).mapInArrow(per_batch(run), _DEALT)
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "tie")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shingles double"


def compare(docs: DataFrame, *, k: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter (in code points) is the start of the next document.

    The order is that of doc_id, null ids first, rows of one id by a hash of
    their text; the last document's next is the first, also where it is the only
    one. Null texts are as empty ones; very long texts are fingerprinted whole;
    an empty table gives an empty result; other columns of docs are not looked at.
    """
    spark: SparkSession = docs.sparkSession

    def run(batches):
        held = None  # the last row seen: (bucket, tail, id, known, text, sketch)
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_pylist() for i in range(5)]
            rows = [*([held] if held else []), *zip(*cols, sketches_of(b.column(4), k, size), strict=True)]
            done, edits = [], []
            for x, y in zip(rows, rows[1:], strict=False):
                if x[0] == y[0] and not x[1]:
                    n = len(x[4])
                    done.append((x, y))
                    edits.append(x[4][: n - n // 4] + y[4][: n // 4])
            held = rows[-1]
            if not done:
                continue
            edited = pa.array(edits, pa.large_string())
            out = []
            for (x, y), e, s in zip(done, edits, sketches_of(edited, k, size), strict=True):
                out.append((x[2] if x[3] else None, len(x[4]), hashlib.sha256(e.encode()).hexdigest(), pack(x[5]), pack(s), resemblance(x[5], s, size), resemblance(x[5], y[5], size), distinct(x[5], size)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return with_successors(docs, shuffle_parts(spark)).mapInArrow(run, OUT)
