"""Exact removal of repeated byte strings with a sparse, distributed suffix array.

A window is a string of `length` bytes of a text. Every byte of a window that
also starts anywhere else is removed, its first occurrence included.

Sorting a suffix for each byte would shuffle many times the input. Instead
each window picks an anchor from its own content: of its grams of GRAM bytes the
one with the least hash. Equal windows so pick equal anchors at equal places,
neighbouring windows mostly share one, and there is one anchor for some 80
bytes. A run is an anchor with the windows that picked it.

1.  Runs, as hash tokens (leading token: the anchor's gram; next: the whole
    run), are dealt out by ranges of their leading token and sorted there.
    A run whose leading token is unique is done: no window of it repeats.
    Runs equal in both tokens repeat as a whole. The rest stay open.
2.  Open runs, and one witness of each set of equal runs among them, become
    real suffixes: bytes from the anchor on. Spark samples splitters and range
    partitions them by their leading bytes; each bucket sorts its suffixes by
    multikey quicksort, eight bytes a key. A splitter never parts suffixes of
    equal leading GRAM bytes, so groups never straddle a boundary between
    buckets. Within a group the suffixes that start at each window are sorted in
    the same way, and those whose neighbour shares `length` bytes repeat. A hash
    of each window spares the sort those that have no equal; it decides nothing.
3.  Intervals are gathered by document and cut out.

An anchor that a great many differing runs share is dealt out in slices, by the
place of the anchor within the window: windows of different slices can't match.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import keyed, per_batch, shuffle_parts

GRAM = 48
HOT_GROUP = 4096
CHUNK = 1 << 18
#: bytes of suffixes that are made, or whose windows are hashed, at once
PIECE = 1 << 19
#: bytes of text for each of the buckets and ranges that a worker holds whole
PART_BYTES = 32_000_000
_TOP = np.uint64(2**64 - 1)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by prefix and suffix minima of blocks of w."""
    m = len(h) - w + 1
    if m <= 0:
        return np.zeros(0, h.dtype)
    x = np.concatenate([h, np.full(-len(h) % w, _TOP)]).reshape(-1, w)
    pre = np.minimum.accumulate(x, 1).ravel()
    suf = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(suf[:m], pre[w - 1 : w - 1 + m])


def runs(c: K.Chunk, length: int) -> tuple[np.ndarray, ...]:
    """Of a chunk's windows: each run's first window, number of windows, anchor place, anchor hash and whole-run hash."""
    n = len(c.data)
    w = length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at = np.arange(n - GRAM + 1)
    end = np.repeat(c.off[1:], np.diff(c.off))
    h = c.hash_ranges(at, at + GRAM)
    h[at + GRAM > end[: len(at)]] = _TOP
    low = _sliding_min(h, w)
    m = len(low)
    ok = at[:m] + length <= end[:m]
    # the anchor of a window is the leftmost place with the least hash: runs end where that place changes
    if not ok.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    cand = np.flatnonzero(_candidates(h, low, ok, w))
    order = np.lexsort((cand, h[cand]))
    sorted_h, sorted_at = h[cand][order], cand[order]
    cut = np.ones(m, bool)
    cut[1:] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1]) | (end[1:m] != end[: m - 1])
    # within a stretch of equal minima the leftmost place may still move on, where the gram repeats inside it
    start = np.flatnonzero(cut)
    start = start[ok[start]]
    stop = np.append(np.flatnonzero(cut), m)
    stop = stop[np.searchsorted(stop, start, "right")]
    out_s, out_n, out_p = [start], [], []
    first = _next_place(sorted_h, sorted_at, low[start], start)
    until = np.minimum(stop, first + 1)  # windows start at or before their anchor
    out_n.append(until - start)
    out_p.append(first)
    rest = until < stop
    while rest.any():
        start, stop = until[rest], stop[rest]
        first = _next_place(sorted_h, sorted_at, low[start], start)
        until = np.minimum(stop, first + 1)
        out_s.append(start)
        out_n.append(until - start)
        out_p.append(first)
        rest = until < stop
    s, cnt, place = np.concatenate(out_s), np.concatenate(out_n), np.concatenate(out_p)
    # an anchor's hash is the least of many, so it is mixed again: ranges of it shall be equally full
    return s, cnt, place, K.mix64(h[place]), c.hash_ranges(s, s + cnt - 1 + length)


def _candidates(h: np.ndarray, low: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Places that may be an anchor: those whose hash is the minimum of a window that holds them."""
    n, m = len(h), len(low)
    # the largest of the minima of the windows that hold place i: windows i-w+1 .. i
    top = np.where(ok, low, np.uint64(0))
    pad = np.concatenate([np.zeros(w - 1, np.uint64), top, np.zeros(max(0, n - m), np.uint64)])
    return h == ~_sliding_min(~pad, w)[:n]


def _next_place(sorted_h: np.ndarray, sorted_at: np.ndarray, want: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each (hash, start) the first place at or after start that has the hash."""
    lo, hi = np.searchsorted(sorted_h, want), np.searchsorted(sorted_h, want, "right")
    live = lo < hi
    while live.any():  # bisection within each hash's places
        mid = (lo + hi) // 2
        right = live & (sorted_at[np.minimum(mid, len(sorted_at) - 1)] < start)
        lo = np.where(right, mid + 1, lo)
        hi = np.where(live & ~right, mid, hi)
        live = lo < hi
    return sorted_at[lo]


_RUNS = "bucket int, doc binary, content binary, start binary, n binary, place binary, gram binary, whole binary"
_OPEN = "doc_id long, content long, start long, n long, place long, gram long, slices int, kind byte"


def _tokens(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """Runs as packed arrays, dealt out by ranges of the leading token."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column(0)
        null = np.asarray(ids.is_null())
        ids = np.where(null, np.iinfo(np.int64).min, ids.fill_null(0).to_numpy(zero_copy_only=False))
        content = b.column(2).to_numpy()
        rows: list[tuple] = []
        for c in K.chunks(b.column(1), CHUNK):
            s, n, p, g, whole = runs(c, length)
            doc = np.searchsorted(c.off, s, "right") - 1
            rows.append((ids[c.lo + doc], content[c.lo + doc], s - c.off[doc], n, p - s, g, whole))
        cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
        bucket = (cols[5] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        kinds = (np.int64, np.int64, np.uint32, np.uint8, np.uint8, np.uint64, np.uint64) if length <= 255 else (np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint64, np.uint64)
        cols = [x[order].astype(k) for x, k in zip(cols, kinds, strict=True)]
        names, first = np.unique(bucket, return_index=True)
        ends = np.append(first[1:], len(bucket))
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()) for x in cols]
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *packed], names=[x.split()[0] for x in _RUNS.split(", ")])

    keys = keyed(docs).withColumn("content", F.xxhash64("text"))
    return keys.mapInArrow(per_batch(run), _RUNS)


def _settled(length: int):
    """Reduce of the tokens of a range: runs that repeat (kind 0), open ones (1) and witnesses (2)."""
    small = np.uint8 if length <= 255 else np.uint32

    def run(t: pa.Table) -> pa.Table:
        K.release()
        K.trim()

        def col(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)

        gram, whole = col("gram", np.uint64), col("whole", np.uint64)
        doc, content, start, n, place = col("doc", np.int64), col("content", np.int64), col("start", np.uint32), col("n", small), col("place", small)
        order = np.lexsort((start, doc, whole, gram))
        g, r = gram[order], whole[order]
        new_g = np.concatenate([[True], g[1:] != g[:-1]])
        new_r = new_g | np.concatenate([[True], r[1:] != r[:-1]])
        group, same = np.cumsum(new_g) - 1, np.cumsum(new_r) - 1
        repeats = np.bincount(same)[same] > 1
        kinds_in = np.bincount(group, weights=new_r)[group]  # differing runs of an anchor
        several = kinds_in > 1
        kind = np.where(repeats, 0, 1).astype(np.int8)
        take = repeats | several
        witness = repeats & several & new_r
        at = np.concatenate([order[take], order[witness]])
        kind = np.concatenate([kind[take], np.full(witness.sum(), 2, np.int8)])
        slices = np.minimum(length - GRAM + 1, np.ceil(kinds_in / HOT_GROUP)).astype(np.int32)
        slices = np.concatenate([slices[take], slices[witness]])
        cols = [doc[at], content[at], start[at].astype(np.int64), n[at].astype(np.int64), place[at].astype(np.int64), gram[at].view(np.int64), slices, kind]
        return pa.table([pa.array(x) for x in cols], names=[x.split()[0] for x in _OPEN.split(", ")])

    return run


_SUFFIX = "doc_id long, content long, start long, n long, place long, part int, slices int, kind byte, bytes binary, lead binary"


def _suffixes(length: int):
    """For documents with open runs: each run's bytes, and the leading bytes of its suffix."""

    names = [x.split()[0] for x in _SUFFIX.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int8()] + [pa.binary()] * 2

    def run(batches):
        K.release()
        for b in batches:
            out, held = [], 0
            data = b.column(2)
            for i in range(b.num_rows):
                raw = data[i].as_buffer()
                view = memoryview(raw)
                for x in b.column(3)[i].as_py():
                    s, n, p = x["start"], x["n"], x["place"]
                    whole = bytes(view[s : s + n - 1 + length])
                    for part in range(x["slices"]):
                        out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), s, n, p, part, x["slices"], x["kind"], whole, whole[p : p + GRAM]))
                    held += x["slices"] * len(whole)
                    if held >= PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        K.trim()

    return run


def multikey_sort(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[s:s+depth] and, for each in that order, whether it equals its forerunner in all of them. Multikey quicksort with eight bytes as a character: only ties go on to the next character, and of those only sets that differ in it are sorted."""
    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in the order that are still tied with a neighbour
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for lo in range(0, depth, 8):
        if not len(open_):
            break
        own = order[open_]
        key = words[starts[own] + lo].view(">u8").ravel().astype(np.uint64)
        if depth - lo < 8:
            key >>= np.uint64(8 * (8 - depth + lo))
        g = group[open_]
        head = np.concatenate([[True], g[1:] != g[:-1]])
        at = np.flatnonzero(head)
        number = np.cumsum(head) - 1
        mixed = np.logical_or.reduceat(key != key[at][number], at)[number]
        some = np.flatnonzero(mixed)
        inner = some[np.lexsort((key[some], g[some]))]
        order[open_[some]] = own[inner]
        key[some] = key[inner]
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]
        # a tie's number is the place in the order of its first member
        group[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_ = open_[tied]
    same = np.zeros(n, bool)
    same[1:] = group[1:] == group[:-1]
    return order, same


def _windows(c: K.Chunk, num: dict[str, np.ndarray], r: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of the runs r those of their slice: run, step in it, and hash."""
    k = num["n"][r]
    slot = np.repeat(np.arange(len(r)), k)
    step = np.arange(len(slot)) - np.repeat(np.cumsum(k) - k, k)
    keep = (num["place"][r][slot] - step) % num["slices"][r][slot] == num["part"][r][slot]
    slot, step = slot[keep], step[keep]
    # their own bytes, so that hashing holds no more than it needs
    sizes = c.off[r + 1] - c.off[r]
    base = np.cumsum(sizes) - sizes
    piece = K.Chunk(np.concatenate([c.data[c.off[i] : c.off[i + 1]] for i in r]), np.append(base, sizes.sum()), 0)
    at = base[slot] + step
    return r[slot], step, piece.hash_ranges(at, at + length)


def _resolve(length: int, window_limit: int = 200_000):
    """Of a bucket's suffixes: the windows of open runs that some other run of the group also has, as intervals."""

    def finish(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        num = {k: t.column(k).to_numpy() for k in ("doc_id", "content", "start", "n", "place", "part", "slices", "kind")}
        c = next(K.chunks(t.column("bytes").combine_chunks().cast(pa.large_binary()), 1 << 62))
        order, same = multikey_sort(c.data, c.off[:-1] + num["place"], GRAM)
        group = np.cumsum(~same) - 1
        sizes = np.bincount(group)
        live = sizes[group] > 1
        order, group = order[live], group[live]
        if not len(order):
            return None
        windows = num["n"][order]
        # whole groups at a time, about window_limit windows
        total = np.cumsum(windows)
        ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
        out: list[tuple] = []
        lo = 0
        while lo < len(order):
            base = total[lo - 1] if lo else 0
            hi = ends[max(np.searchsorted(ends, lo, "right"), np.searchsorted(total[ends - 1], base + window_limit, "right") - 1)]
            r = order[lo:hi]
            # a hot group has its runs' bytes in each of its slices, but only the slice's share of their windows: those are picked and hashed a piece of the runs at a time
            stops = np.unique(np.append(np.searchsorted(np.cumsum(c.off[r + 1] - c.off[r]), np.arange(PIECE, int((c.off[r + 1] - c.off[r]).sum()) + PIECE, PIECE), "right"), len(r)))
            found = [_windows(c, num, r[i:j], length) for i, j in zip(np.append(0, stops[:-1]), stops, strict=True) if i < j]
            own, step, h = (np.concatenate(x) for x in zip(*found, strict=True))
            # equal windows have their anchor at the same place: (group, place) is implied by the bytes.
            # Hashes only spare the sort windows that have no equal; neighbours in the sorted order decide
            o = np.argsort(h)
            eq = np.concatenate([[False], h[o][1:] == h[o][:-1]])[: len(o)]
            eq[:-1] |= eq[1:]
            o = o[eq]
            sorted_, same_window = multikey_sort(c.data, c.off[own[o]] + step[o], length)
            same_window[:-1] |= same_window[1:]
            rep = np.zeros(len(h), bool)
            rep[o[sorted_[same_window]]] = True
            rep &= num["kind"][own] == 1
            own, step = own[rep], step[rep]
            if len(own):
                new = np.concatenate([[True], (own[1:] != own[:-1]) | (step[1:] != step[:-1] + 1)])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(own)) - 1
                s = num["start"][own[first]] + step[first]
                e = num["start"][own[last]] + step[last] + length
                out.append((num["doc_id"][own[first]], num["content"][own[first]], s, e))
            lo = int(hi)
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["doc_id", "content", "start", "end"])

    def run(batches):
        K.release()
        K.trim()
        rows = [b for b in batches if b.num_rows]
        if rows and (got := finish(rows)) is not None:
            yield got
        K.trim()

    return run


def _cut(keep_text: bool):
    """Cuts intervals out of texts."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, spans, sha, kept, where = [], [], [], [], [], []
        for i in range(b.num_rows):
            raw = b.column(1)[i].as_buffer().to_pybytes() if b.column(1)[i].is_valid else b""
            got = sorted((x["start"], x["end"]) for x in b.column(2)[i].as_py() or ())
            merged: list[list[int]] = []
            for s, e in got:
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            parts, at = [], 0
            for s, e in merged:
                parts.append(raw[at:s])
                at = e
            parts.append(raw[at:])
            left = b"".join(parts)
            n.append(len(raw))
            gone.append(len(raw) - len(left))
            spans.append(len(merged))
            sha.append(hashlib.sha256(left).hexdigest())
            if keep_text:
                kept.append(left.decode("utf-8", "ignore"))  # a cut may split a character: its remaining bytes go
                where.append([{"start": s, "end": e} for s, e in merged])
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            cols += [pa.array(kept), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), b.column(3)]
            names += ["kept_text", "removed", "carried"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(docs: DataFrame, *, length: int = 200, keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; keep_text adds the remaining text, the removed spans, and the struct `carried` of the columns named in carry.

    Null texts are as empty ones; null ids are ids like others. Repeated rows
    repeat each other's strings, so their windows all go. Windows never cross
    documents; texts under `length` bytes stay whole, and very long ones are
    searched whole. An empty table gives an empty result; other columns of docs
    are not looked at but to be carried, and may have any name.
    """
    if not GRAM < length < 2**31:
        raise ValueError(f"length must be over {GRAM}")
    # a worker holds a bucket of tokens or a range of suffixes whole: there are as many as the texts' size asks for, whatever the session sets
    few = shuffle_parts(docs.sparkSession)
    parts = max(few, -(-(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // PART_BYTES))
    by_text = (lambda df: df.repartition(parts, "doc_id", "content")) if parts > few else (lambda df: df)
    named = _settled(length)
    found = _tokens(docs, length, parts)
    found = (found.repartition(parts, "bucket") if parts > few else found).groupBy("bucket").applyInArrow(named, _OPEN)
    null = F.when(F.col("doc_id") == -(2**63), None).otherwise(F.col("doc_id"))
    open_ = by_text(found.where("kind > 0")).groupBy("doc_id", "content").agg(F.collect_list(F.struct("start", "n", "place", "slices", "kind")).alias("open"))
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("_"))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("content"), F.col("text").cast("string").alias("text"), *([carried.alias("carried")] if keep_text else []))
    base = by_text(base)
    texts = base.select("doc_id", "content", F.col("text").cast("binary").alias("text"))
    suffixes = texts.join(open_, ["doc_id", "content"]).select("doc_id", "content", "text", "open").mapInArrow(_suffixes(length), _SUFFIX)
    dealt = suffixes.repartitionByRange(parts, "lead", "part")
    fine = dealt.mapInArrow(_resolve(length), "doc_id long, content long, start long, end long")
    spans = found.where("kind = 0").select("doc_id", "content", "start", (F.col("start") + F.col("n") - 1 + length).alias("end")).union(fine)
    spans = by_text(spans).groupBy("doc_id", "content").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    shaped = (base.withColumn("text", F.col("text").cast("binary")) if keep_text else texts).join(spans, ["doc_id", "content"], "left").select(null.alias("doc_id"), "text", "spans", *(["carried"] if keep_text else []))
    # fields, not text: a carried column may have any name
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")]).add("kept_sha256", "string")
    if keep_text:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        schema = schema.add("kept_text", "string").add("removed", T.ArrayType(span)).add("carried", shaped.schema["carried"].dataType)
    return shaped.mapInArrow(per_batch(_cut(keep_text)), schema)
