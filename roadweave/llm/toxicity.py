"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words, lower-cased and without punctuation at their
ends, and the words' beginnings (compounds and inflections of a stem share
them), hashed to buckets. Besides a weight, each bucket has a short vector, and
the score adds the dot products of all pairs of a text's vectors, so that two
terms can say together what neither says alone: an insult beside the mention of
a group. The pairs cost no more than the terms: half of the square of the
vectors' sum less the sum of their squares.

The machine is fitted on a bounded sample: `max_rows` labelled rows, those with
the least hash of their ids. A bucket that fewer than `least_rows` of them hold
is left out, and so is one that is neither common (a share of COMMON of the
rows), nor tied to the label by itself (`least_z` standard deviations from
chance), nor tied to it together with another: pairs of buckets that rows of
label 1 (PAIR_ROWS at least) hold together more often than apart are counted, and stay
where the label is `pair_z` deviations likelier beside both than beside either.
Everything else reads all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import keyed, per_batch

BUCKET_BITS = 20
MAX_ROWS = 24_000
LEAST_ROWS = 6
LEAST_Z = 7.0
PAIR_Z = 10.0
PAIR_ROWS = 20
COMMON = 0.2
POSITIVE = 3.0
FACTORS = 4
THRESHOLD = 0.7
PREFIXES = (None, 4, 5)
_EDGE = np.zeros(256, bool)
_EDGE[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def terms(column: pa.Array, bits: int = BUCKET_BITS):
    """For each chunk of texts: distinct buckets of each text, and the texts' bounds."""
    for c in K.chunks(column):
        low = c.lower()
        s, e, first = low.words()
        doc = K.owner(first, len(s))
        while True:
            cut = (s < e) & _EDGE[low.data[np.minimum(s, len(low.data) - 1)]] if len(s) else np.zeros(0, bool)
            if not cut.any():
                break
            s = s + cut
        while True:
            cut = (s < e) & _EDGE[low.data[e - 1]] if len(s) else np.zeros(0, bool)
            if not cut.any():
                break
            e = e - cut
        some = s < e
        s, e, doc = s[some], e[some], doc[some]
        keys = []
        for most in (PREFIXES if len(s) else ()):
            end = e if most is None else np.minimum(e, s + most)
            keys.append(doc << bits | (low.hash_ranges(s, end) >> K.U64(64 - bits)).astype(np.int64))
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(c.n + 1))


class Machine:
    """bias, and of the buckets in `known` (rising) a weight and a vector."""

    def __init__(self, known: np.ndarray, bias: float, weight: np.ndarray, vector: np.ndarray, bits: int):
        self.bias, self.bits = bias, bits
        self.slot = np.full(1 << bits, len(known), np.int32)
        self.slot[known] = np.arange(len(known))
        self.weight = np.append(weight, 0).astype(np.float32)
        self.vector = np.concatenate([vector, np.zeros((1, vector.shape[1]))]).astype(np.float32)

    def odds(self, idx: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log odds of texts."""
        slot = self.slot[idx]
        keep = slot < len(self.weight) - 1
        before = np.concatenate([[0], np.cumsum(keep)])
        slot, bounds = slot[keep], before[bounds]
        return _raw(self.bias, self.weight, self.vector, slot, bounds)[0]

    def score(self, idx: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(idx, bounds), -30, 30)))


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows bounds[i]..bounds[i+1], empty ones too."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _raw(bias: float, weight: np.ndarray, vector: np.ndarray, slot: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = vector[slot]
    s = _sums(v, bounds)
    return bias + _sums(weight[slot], bounds) + 0.5 * (s**2 - _sums(v**2, bounds)).sum(1), s


def paired(idx: np.ndarray, bounds: np.ndarray, y: np.ndarray, least_rows: int, pair_z: float, bits: int) -> np.ndarray:
    """Buckets that are tied to label 1 together with another bucket: neither needs to say anything alone."""
    size, n, ones = 1 << bits, len(y), int(y.sum())
    none = np.zeros(0, np.int64)
    if not ones or ones == n:
        return none
    doc = np.repeat(np.arange(n), np.diff(bounds))
    held, with_1 = np.bincount(idx, minlength=size), np.bincount(idx, y[doc], size).astype(np.int64)
    names = np.flatnonzero((held <= COMMON * n) & (with_1 >= max(PAIR_ROWS, least_rows)))
    if len(names) < 2:
        return none
    slot = np.full(size, -1)
    slot[names] = np.arange(len(names))
    t = slot[idx]
    doc, t = doc[t >= 0], t[t >= 0]

    def bitmaps(rows: np.ndarray) -> np.ndarray:
        """For each term the rows that hold it, a bit a row: len(names) * rows / 8 bytes, and rows are at most those of the sample."""
        place = np.cumsum(rows) - 1
        mine = rows[doc]
        bits = np.zeros((len(names), -(-int(rows.sum()) // 64)), np.uint64)
        at = place[doc[mine]]
        np.bitwise_or.at(bits, (t[mine], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        return bits

    ones_held, n1 = bitmaps(y > 0), with_1[names]
    all_held = bitmaps(np.ones(n, bool))
    keep = set()
    rate, mean = n1 / held[names], ones / n
    for i in range(len(names) - 1):
        both = np.bitwise_count(ones_held[i] & ones_held[i + 1 :]).sum(1, dtype=np.int64)
        apart = n1[i] * n1[i + 1 :] / ones  # what chance gives among rows of label 1
        j = np.flatnonzero((both >= PAIR_ROWS) & (both > apart + pair_z / 2 * np.sqrt(apart) + 1))
        if len(j):
            both, j = both[j], j + i + 1
            total = np.bitwise_count(all_held[i] & all_held[j]).sum(1, dtype=np.int64)
            expect = np.clip(np.maximum(np.maximum(rate[i], rate[j]), mean), 0, 1 - 1e-9)
            found = j[both - expect * total > pair_z * np.sqrt(total * expect * (1 - expect))]
            if len(found):
                keep.update([i, *found.tolist()])
    return names[sorted(keep)]


def fit(idx: np.ndarray, bounds: np.ndarray, y: np.ndarray, *, bits: int = BUCKET_BITS, factors: int = FACTORS, least_rows: int = LEAST_ROWS, least_z: float = LEAST_Z, pair_z: float = PAIR_Z, positive: float = POSITIVE, passes: int = 16, rate: float = 0.25, decay: float = 2e-5, batch: int = 256, seed: int = 3) -> Machine:
    """Logistic loss, minibatches, steps scaled by each parameter's own past gradients."""
    g = np.random.Generator(np.random.PCG64(seed))
    held = np.bincount(idx, minlength=1 << bits)
    with_1 = np.bincount(idx, np.repeat(y, np.diff(bounds)), 1 << bits)
    mean = float(y.mean()) if len(y) else 0.5
    z = np.abs(with_1 - mean * held) / np.sqrt(np.maximum(held * mean * (1 - mean), 1e-9))
    known = (held >= least_rows) & (z >= least_z) | (held >= max(least_rows, COMMON * len(y)))
    if factors:
        known[paired(idx, bounds, y, least_rows, pair_z, bits)] = True
    known = np.flatnonzero(known)
    slot = np.full(1 << bits, -1)
    slot[known] = np.arange(len(known))
    s = slot[idx]
    keep = s >= 0
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    s = s[keep]
    m = len(known)
    w, v = np.zeros(m), g.normal(0, 0.01, (m, factors))
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(m, 1e-6), np.full((m, factors), 1e-6), 1e-6
    for _ in range(passes if m and len(y) else 0):
        order = g.permutation(len(y))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            n = bounds[rows + 1] - bounds[rows]
            own = np.repeat(np.arange(len(rows)), n)
            at = np.repeat(bounds[rows], n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            t = s[at]
            raw, total = _raw(bias, w, v, t, np.concatenate([[0], np.cumsum(n)]))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) * np.where(y[rows] > 0, positive, 1) / len(rows)
            used, inv = np.unique(t, return_inverse=True)
            e = err[own]
            dw = np.bincount(inv, e, len(used)) + decay * w[used]
            dv = np.stack([np.bincount(inv, e * (total[own, f] - v[t, f]), len(used)) for f in range(factors)], 1) + decay * v[used] if factors else v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * 0.2 * dv / np.sqrt(gv[used])
            bias -= rate * 0.2 * err.sum() / np.sqrt(gb)
    return Machine(known, bias, w, v, bits)


def held_out(mod: int = 3, out: int = 1) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == out, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(label, text) of the max_rows labelled rows that may be learned from, by least hash of the id; only their ids, of bounded number, are broadcast."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out())
    some = some.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return keyed(docs).join(F.broadcast(some), "doc_id").select("label", "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, **options) -> Machine:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [np.split(i.astype(np.int32), n[1:-1]) for i, n in terms(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for g in got for x in g], pa.binary())], names=["label", "terms"])

    rows = sample(docs, labels, label, max_rows).mapInArrow(per_batch(run), "label int, terms binary").orderBy(F.xxhash64("terms")).toArrow()
    sets = [np.frombuffer(x, np.int32) for x in rows.column(1).to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return fit(np.concatenate(sets) if sets else np.zeros(0, np.int32), bounds, np.array(rows.column(0).to_pylist(), np.float64), **options)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts are as empty ones: they get the score of the bias. Very long texts
    count with all their terms. Repeated rows repeat; an empty table gives none;
    without a label all texts score alike; other columns of docs are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(machine)  # 2**bits slots and at most as many weights

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = np.concatenate([sent.value.score(i, n) for i, n in terms(b.column(1), sent.value.bits)])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    got = keyed(docs).mapInArrow(per_batch(run), "doc_id long, score double, predicted int")
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")
