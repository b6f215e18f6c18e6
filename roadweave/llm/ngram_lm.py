"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting: each task folds its texts into distinct pairs and words with counts;
pairs travel to the range of their first word's hash, packed as arrays. There
they are summed, and with them each context's total and its numbers of
followers seen once, twice, and more often. How many contexts a word follows is
counted on the way, summed by the word's own range, and stored with the word's
count. Each range is a set of sorted hash arrays in a file of the shared folder.

Scoring: workers map the files into memory; a chunk's distinct words and pairs
are looked up by bisection, range by range, and each text sums its tokens.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) q(w)
    q(w)     = max(k(w) - E(k(w)), 0) / k + g / (V + 1)

with k(w) the number of contexts of w, discounts D and E from counts of counts,
and g the mass that they free; V + 1 leaves a share to unknown words.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import keyed, map_file, per_batch, put_file, settle, shared_dir, shuffle_parts

END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
FOLD_TOKENS = 6_000_000
SCORE_BYTES = 8 << 20


def tokens(c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens (words, then one end each) and each text's bounds."""
    low = c.lower()
    s, e, first = low.words()
    h = low.hash_ranges(s, e)
    bounds = first + np.arange(c.n + 1)
    out = np.full(len(h) + c.n, END, np.uint64)
    own = K.owner(first, len(h))
    out[np.arange(len(h)) + own] = h
    return out, bounds


def before(tok: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each token's forerunner; the start mark for a text's first."""
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[bounds[:-1]] = START
    return prev


def _tally(x: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts (or sums of weights)."""
    if weight is None:
        return np.unique(x, return_counts=True)
    o = np.argsort(x, kind="stable")
    x, weight = x[o], weight[o]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.add.reduceat(weight, at) if len(x) else weight


def _pairs(v: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted by v and then w, with counts."""
    o = np.lexsort((w, v))
    v, w = v[o], w[o]
    n = np.ones(len(v), np.int64) if n is None else n[o]
    at = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.zeros(0, np.int64)
    return v[at], w[at], np.add.reduceat(n, at) if len(v) else n


def _bucket(x: np.ndarray, parts: int) -> np.ndarray:
    """Range of a hash's leading 32 bits."""
    return ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of rising bucket numbers."""
    if not len(bucket):
        return []
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True))


_PAIRS = "bucket int, v binary, runs binary, wlow binary, whigh binary, n binary"
_WORDS = "bucket int, kind byte, w binary, n binary"


def _count_pairs(parts: int):
    def emit(vs: list, ws: list) -> pa.RecordBatch:
        v, w, n = _pairs(np.concatenate(vs), np.concatenate(ws) >> np.uint64(16))
        rows = []
        for b, i, j in _cuts(_bucket(v, parts)):
            x, y = v[i:j], w[i:j]
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            rows.append((b, x[at].tobytes(), np.diff(np.append(at, j - i)).astype(np.uint32).tobytes(), y.astype(np.uint32).tobytes(), (y >> np.uint64(32)).astype(np.uint16).tobytes(), n[i:j].astype(np.uint32).tobytes()))
        kinds = [pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PAIRS.split(", ")])

    def run(batches):
        vs, ws, held = [], [], 0
        for b in batches:
            for c in K.chunks(b.column(0)):
                tok, bounds = tokens(c)
                vs.append(before(tok, bounds))
                ws.append(tok)
                held += len(tok)
                if held >= FOLD_TOKENS:
                    yield emit(vs, ws)
                    vs, ws, held = [], [], 0
        if held:
            yield emit(vs, ws)

    return run


def _count_words(parts: int):
    def run(batches):
        words, counts, held = [], [], 0

        def emit() -> pa.RecordBatch:
            w, n = _tally(np.concatenate(words), np.concatenate(counts))
            rows = [(b, 0, w[i:j].tobytes(), n[i:j].astype(np.uint64).tobytes()) for b, i, j in _cuts(_bucket(w, parts))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int8(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "kind", "w", "n"])

        for b in batches:
            for c in K.chunks(b.column(0)):
                w, n = _tally(tokens(c)[0])
                words.append(w)
                counts.append(n.astype(np.int64))
                held += len(w)
            if held >= FOLD_TOKENS:
                yield emit()
                words, counts, held = [], [], 0
        if held:
            yield emit()

    return run


def _key(v: np.ndarray, w48: np.ndarray) -> np.ndarray:
    return K.mix64(v * K._Q + w48)


def _small(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as bytes, with places and values of those that don't fit."""
    big = np.flatnonzero(n >= 255)
    return np.minimum(n, 255).astype(np.uint8), big.astype(np.uint32), n[big].astype(np.uint64)


def _file(arrays: list[np.ndarray]) -> list[bytes]:
    """Header of dtype codes and lengths, then the arrays, each at a multiple of eight bytes."""
    head = struct.pack("<Q", len(arrays)) + b"".join(struct.pack("<8sQ", a.dtype.str.encode().ljust(8, b" "), len(a)) for a in arrays)
    return [head, *(x for a in arrays for x in (a.tobytes(), b"\0" * (-a.nbytes % 8)))]


def _arrays(uri: str) -> list[np.ndarray]:
    buf = np.frombuffer(map_file(uri), np.uint8)
    n = int(buf[:8].view("<u8")[0])
    at, out = 8 + 16 * n, []
    for i in range(n):
        kind, size = struct.unpack("<8sQ", buf[8 + 16 * i : 24 + 16 * i].tobytes())
        dtype = np.dtype(kind.decode().strip())
        out.append(buf[at : at + size * dtype.itemsize].view(dtype))
        at += size * dtype.itemsize + (-size * dtype.itemsize % 8)
    return out


def _store_pairs(where: str, parts: int):
    """Reduce of a range of contexts: writes its file; gives words' numbers of contexts (kind 1) and counts of counts (kind 2)."""

    def run(t: pa.Table) -> pa.Table:
        col = lambda n, k: np.frombuffer(b"".join(t.column(n).to_pylist()), k)
        bucket = t.column("bucket")[0].as_py()
        v = np.repeat(col("v", np.uint64), col("runs", np.uint32))
        w = col("wlow", np.uint32).astype(np.uint64) | col("whigh", np.uint16).astype(np.uint64) << np.uint64(32)
        v, w, n = _pairs(v, w, col("n", np.uint32).astype(np.int64))
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        total = np.add.reduceat(n, at)
        seen = [np.add.reduceat((n == k).astype(np.int64), at) for k in (1, 2)] + [np.add.reduceat((n > 2).astype(np.int64), at)]
        key = _key(v, w)
        o = np.argsort(key)
        small, big, large = _small(n[o])
        put_file(f"{where}/pairs-{bucket:06d}.lm", _file([key[o], small, big, large, v[at], total.astype(np.uint64), *(x.astype(np.uint32) for x in seen)]))
        words, k = _tally(w)
        rows = [(b, 1, (words[i:j] << np.uint64(16)).tobytes(), k[i:j].astype(np.uint64).tobytes()) for b, i, j in _cuts(_bucket(words << np.uint64(16), parts))]
        rows.append((bucket, 2, b"", np.array([(n == c).sum() for c in (1, 2, 3, 4)] + [len(n)], np.uint64).tobytes()))
        kinds = (pa.int32(), pa.int8(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "w", "n"])

    return run


def _store_words(where: str):
    """Reduce of a range of words: writes its file; gives its totals."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        kind = np.array(t.column("kind").to_pylist())

        def col(k: int) -> tuple[np.ndarray, np.ndarray]:
            some = [i for i in np.flatnonzero(kind == k).tolist()]
            ws, ns = t.column("w"), t.column("n")
            w = np.frombuffer(b"".join(ws[i].as_py() for i in some), np.uint64)
            return _tally(w, np.frombuffer(b"".join(ns[i].as_py() for i in some), np.uint64).astype(np.int64))

        w, n = col(0)
        c, k = col(1)
        put_file(f"{where}/words-{bucket:06d}.lm", _file([w, n.astype(np.uint64), c, k.astype(np.uint64)]))
        row = [int(n.sum()), len(w), int(k.sum()), *(int((k == x).sum()) for x in (1, 2, 3, 4)), len(k)]
        return pa.table([pa.array([x], pa.int64()) for x in row], names=["tokens", "words", "k", "k1", "k2", "k3", "k4", "kinds"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's three discounts from counts of counts; where some are missing, the plain ones of one half, one, and one and a half."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))  # type: ignore[return-value]


def train(texts: DataFrame, where: str) -> dict:
    """Counts the texts of the only column of texts, writes the model below `where`, and returns its figures: a few numbers."""
    spark: SparkSession = texts.sparkSession
    parts = shuffle_parts(spark)
    pairs = texts.mapInArrow(_count_pairs(parts), _PAIRS)
    follow = settle(pairs.groupBy("bucket").applyInArrow(_store_pairs(where, parts), _WORDS), f"{where}/contexts")
    words = texts.mapInArrow(_count_words(parts), _WORDS).union(follow.where("kind = 1"))
    totals = settle(words.groupBy("bucket").applyInArrow(_store_words(where), "tokens long, words long, k long, k1 long, k2 long, k3 long, k4 long, kinds long"), f"{where}/totals")
    s = totals.agg(*[F.sum(c).alias(c) for c in totals.columns]).first().asDict()
    s = {k: v or 0 for k, v in s.items()}
    counts = follow.where("kind = 2").select("n").mapInArrow(per_batch(_sum_counts), "c1 long, c2 long, c3 long, c4 long, pairs long")
    c = {k: v or 0 for k, v in counts.agg(*[F.sum(x).alias(x) for x in counts.columns]).first().asDict().items()}
    d, e = discounts(c["c1"], c["c2"], c["c3"], c["c4"]), discounts(s["k1"], s["k2"], s["k3"], s["k4"])
    return {"where": where, "parts": parts, "tokens": s["tokens"], "words": s["words"], "k": s["k"], "kinds": [s["k1"], s["k2"], s["kinds"] - s["k1"] - s["k2"]], "d": d, "e": e, "pairs": c["pairs"]}


def _sum_counts(b: pa.RecordBatch) -> pa.RecordBatch:
    x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, 5).sum(0).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in x], names=["c1", "c2", "c3", "c4", "pairs"])


class Model:
    """A trained model, its files mapped as they are asked for."""

    def __init__(self, info: dict):
        self.info = info
        self.pair_files: dict[int, list[np.ndarray] | None] = {}
        self.word_files: dict[int, list[np.ndarray] | None] = {}

    def _get(self, cache: dict, name: str, b: int) -> list[np.ndarray] | None:
        if b not in cache:
            try:
                cache[b] = _arrays(f"{self.info['where']}/{name}-{b:06d}.lm")
            except FileNotFoundError:  # a range without a word
                cache[b] = None
        return cache[b]

    @staticmethod
    def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, want)
        at[at == len(keys)] = 0
        return at, keys[at] == want if len(keys) else np.zeros(len(want), bool)

    def words(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted words: counts in training, and q(w)."""
        i = self.info
        n, k = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for b, lo, hi in _cuts(_bucket(w, i["parts"])):
            f = self._get(self.word_files, "words", b)
            if f is None:
                continue
            for out, keys, values, want in ((n, f[0], f[1], w[lo:hi]), (k, f[2], f[3], w[lo:hi] >> np.uint64(16) << np.uint64(16))):
                at, ok = self._find(keys, want)
                if len(keys):
                    out[lo:hi] = np.where(ok, values[at], 0)
        if not i["k"]:
            return n, np.full(len(w), 1 / (i["words"] + 1))
        e = np.array([0.0, *i["e"]])
        free = sum(x * y for x, y in zip(i["e"], i["kinds"], strict=True)) / i["k"]
        return n, np.maximum(k - e[np.minimum(k, 3)], 0) / i["k"] + free / (i["words"] + 1)

    def pairs(self, v: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
        """p(w | v) of pairs sorted by v; q: of w."""
        i = self.info
        p = q.copy()
        d = np.array([0.0, *i["d"]])
        for b, lo, hi in _cuts(_bucket(v, i["parts"])):
            f = self._get(self.pair_files, "pairs", b)
            if f is None:
                continue
            key, small, big, large, ctx, total, n1, n2, n3 = f
            cat, known = self._find(ctx, v[lo:hi])
            at, hit = self._find(key, _key(v[lo:hi], w[lo:hi] >> np.uint64(16)))
            c = np.where(hit, small[at], 0).astype(np.int64)
            if (c == 255).any():
                j = np.flatnonzero(c == 255)
                c[j] = large[np.searchsorted(big, at[j])]
            t = total[cat].astype(np.float64)
            free = (i["d"][0] * n1[cat] + i["d"][1] * n2[cat] + i["d"][2] * n3[cat]) / t
            got = np.maximum(c - d[np.minimum(c, 3)], 0) / t + free * q[lo:hi]
            p[lo:hi] = np.where(known, got, q[lo:hi])
        return p


@lru_cache(4)
def _model(where: str, items: tuple) -> Model:
    return Model(dict(items))


def score(docs: DataFrame, info: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) of every text; null texts are as empty ones (one end)."""
    frozen = tuple((k, tuple(v) if isinstance(v, (list, tuple)) else v) for k, v in info.items())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = _model(info["where"], frozen)
        base_of = float(info["tokens"] + info["words"] + 1)
        out = []
        for c in K.chunks(b.column(1), SCORE_BYTES):
            tok, bounds = tokens(c)
            prev = before(tok, bounds)
            words, inv = np.unique(tok, return_inverse=True)
            n, q = m.words(words)
            o = np.lexsort((tok, prev))
            v, w = prev[o], inv[o]
            new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
            at = np.flatnonzero(new)
            p = m.pairs(v[at], words[w[at]], q[w[at]])
            lp = np.empty(len(tok))
            lp[o] = np.log10(p)[np.cumsum(new) - 1]
            base = (np.log10(n + 1) - np.log10(base_of))[inv]
            s = bounds[:-1]
            out.append((np.diff(bounds), np.add.reduceat((n[inv] > 0).astype(np.int64), s), np.add.reduceat(base, s), np.add.reduceat(lp, s)))
        n, known, base, lp = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(known), pa.array(base), pa.array(lp), pa.array(10 ** np.minimum(-lp / n, 300))], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return keyed(docs).mapInArrow(per_batch(run), "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out(mod: int = 7, out: int = 2) -> F.Column:
    """Rows kept from training; a row of null id is one to learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == out, F.lit(False))


def train_and_score(docs: DataFrame, where: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    Without any row to learn from, all tokens are as likely. Repeated rows are
    learned from and scored as often as they occur; very long texts count whole.
    An empty table gives none; other columns of docs are not looked at.
    """
    where = where or shared_dir(docs.sparkSession, "ngram-lm")
    base = keyed(docs)
    info = train(base.where(~held_out()).select("text"), where)
    got = score(base, info)
    return got.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(info["tokens"])).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
