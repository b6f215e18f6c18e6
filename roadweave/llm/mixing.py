"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's words, its documents in a hashed order, are cut into blocks of
equal length. A source's quota is an exact number of blocks (and a part of one
more): whole passes over its blocks where the target is above its size. The
quotas of all sources, one after the other, are the deck that is dealt to the
output shards. A node of the tree holds a range of that deck and how many of
each shard's places are in it; it draws how many of them go to its left half
from the multivariate hypergeometric law, as if the deck had been shuffled, and
the rest go right. A worker follows the tree to a source's two ends only: what
lies between them is that source's quota in each shard, so no table of sources
by shards is ever made, and the driver sees sums alone. A shard so knows which
places of each source's permuted block order are its own: disjoint, exact, and
computed alone from the seed. Within a shard, pieces are shuffled by a hash.

The generator draws exactly up to 10**9 blocks, so a block is BLOCK_WORDS words
or, beyond 4 * 10**11 words, as many as keep the deck at 4 * 10**8 blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import before_ranges, lean, numbered, packed, per_batch, settle, shared_dir, shuffle_parts

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 1024
MOST_BLOCKS = 400_000_000
LEAF = 4096


def sizes(docs: DataFrame, at: F.Column | None = None, mark: F.Column | None = None) -> DataFrame:
    """doc_id, source, tie (a hash of the text), size in words, and at and mark (0 unless given) of every row."""
    names = ["doc_id", "source", "tie", "at", "mark", "size"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = np.concatenate([np.diff(c.words()[2]) for c in K.chunks(b.column(5))])
        return pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(n.astype(np.int64))], names=names)

    lean(docs.sparkSession)
    zero = F.lit(0).cast("long")
    text = F.col("text").cast("string")
    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("tie"), (zero if at is None else at).alias("at"), (zero if mark is None else mark).alias("mark"), text.alias("text"))
    return shaped.mapInArrow(per_batch(run), "doc_id long, source string, tie long, at long, mark long, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, where: str | None = None) -> DataFrame:
    """(k, range, source, weight, source_size, target): sources in code point order, null last, take turns at the weights; no target is above `most` times its source's size, and what is over goes to the others by weight."""
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = numbered(own, F.col("source").asc_nulls_last(), f"{where or shared_dir(sized.sparkSession, 'mixing')}/sources")
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")))
    # all sources whose cap is under level * weight are capped; the level rises until no more are: only sums come to the driver
    ratio = F.col("source_size") * most / F.col("weight")
    level = -1.0
    while True:
        full = ratio <= level
        r = own.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        now = ((r[0] or 0) - (r[1] or 0)) / r[2] if r[2] else level
        if now <= level:
            break
        level = now
    return own.select("k", "range", "source", "weight", "source_size", F.least(F.col("source_size") * float(most), F.col("weight") * level).cast("double").alias("target"))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0..n-1 at x, elementwise: a Feistel network on the least even number of bits, walked until it falls below n."""
    half = np.maximum((np.frexp(np.maximum(n - 1, 1).astype(np.float64))[1] + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = x.astype(np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            left, right = right, left ^ (K.mix64(right * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r)) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


class Deck:
    """A deck of `total` blocks, shuffled and dealt to shards of equal size (within one): how many of its first x go to each shard. Places asked for in rising order share most of their way down the tree."""

    def __init__(self, total: int, shards: int, seed: int):
        edges = np.array([total * i // shards for i in range(shards + 1)], np.int64)
        self.seed, self.path = seed, [(0, total, np.diff(edges), np.zeros(shards, np.int64))]

    def _draw(self, lo: int, hi: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox([self.seed, lo << 64 | hi]))

    def before(self, x: int) -> np.ndarray:
        while not self.path[-1][0] <= x <= self.path[-1][1]:
            self.path.pop()
        while True:
            lo, hi, rooms, first = self.path[-1]
            if x == lo:
                return first
            if x == hi:
                return first + rooms
            if hi - lo <= LEAF:
                dealt = np.repeat(np.arange(len(rooms)), rooms)
                self._draw(lo, hi).shuffle(dealt)
                return first + np.bincount(dealt[: x - lo], minlength=len(rooms))
            mid = (lo + hi) // 2
            left = self._draw(lo, hi).multivariate_hypergeometric(rooms, mid - lo, method="marginals")
            self.path.append((lo, mid, left, first) if x <= mid else (mid, hi, rooms - left, first + left))


def quotas(table: DataFrame, words: int, most: int, block_words: int) -> DataFrame:
    """Adds to targets: blocks of each source, `full` blocks that the mix takes, words of one more (`part`), and `base`, the places of the deck before it."""
    length = max(block_words, -(-words // MOST_BLOCKS))
    some, size = F.col("source_size") > 0, F.greatest("source_size", F.lit(1))
    t = table.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / length)).cast("long"))
    t = t.withColumn("passes", F.when(some, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    t = t.withColumn("over", F.least(F.floor(F.col("rest") * F.col("blocks") / size).cast("long"), F.col("blocks") - 1))
    t = t.withColumn("full", F.when(some, F.col("passes") * F.col("blocks") + F.col("over")).otherwise(0).cast("long"))
    part = F.rint(F.col("rest") - F.col("over") * F.col("source_size") / F.col("blocks")).cast("long")
    t = t.withColumn("part", F.when(some & (F.col("full") < most * F.col("blocks")), F.greatest(part, F.lit(0))).otherwise(0).cast("long"))
    t = t.withColumn("places", F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0))
    own = F.coalesce(F.sum("places").over(Window.partitionBy("range").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = before_ranges(t, F.col("places"), "earlier").withColumn("base", F.col("earlier") + own)
    return t.select("k", "source", "source_size", "target", "blocks", "full", "part", "places", "base")


_PLAN = "doc_id long, source string, tie long, at long, size long, source_size long, target double, taken long, pieces array<struct<shard: int, place: long, pass: int, start: long, end: long>>"


def _plan(sized: DataFrame, where: str, *, weights: tuple[int, ...], most: int, block_words: int, shards: int | None, seed: int, whole: bool) -> DataFrame:
    spark: SparkSession = sized.sparkSession
    parts = shuffle_parts(spark)
    shards = shards or parts
    sized = settle(sized, f"{where}/sizes")
    table = settle(targets(sized, weights, most, where), f"{where}/targets")
    words = table.agg(F.sum("source_size")).first()[0] or 0
    quota = settle(quotas(table, words, most, block_words), f"{where}/quotas")
    total = quota.agg(F.sum("places")).first()[0] or 0

    # each document's place in its source's hashed order: sums within (source, slice), slices' sums before them
    h = F.xxhash64("doc_id", "tie", F.lit(seed))
    slices = max(64, parts)
    placed = sized.withColumn("h", h).withColumn("slice", F.pmod("h", F.lit(slices)))
    inner = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "tie", "size", "mark", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    per = placed.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    outer = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # `slices` rows a source
    per = per.withColumn("earlier", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    q = quota.withColumnRenamed("source", "_s")
    per = per.join(q, F.col("source").eqNullSafe(F.col("_s"))).drop("source").withColumnRenamed("slice", "_b")
    ready = placed.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_b")))
    own = ["k", "blocks", "full", "part", "places", "base"]
    ready = ready.select("doc_id", "source", "tie", "at", "size", "source_size", "target", (F.col("earlier") + F.col("before")).alias("offset"), *own).sortWithinPartitions("k")

    def deal(b: pa.RecordBatch, deck: Deck) -> pa.RecordBatch:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        n, o, size, k, blocks, full, part = (col[x].to_numpy() for x in ("size", "offset", "source_size", "k", "blocks", "full", "part"))
        s, m = np.maximum(size, 1), blocks
        first = np.minimum(((o + 1) * m - 1) // s, m - 1)
        last = first if whole else np.where(n > 0, ((o + n) * m - 1) // s, first)
        count = np.where(n > 0, last - first + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        blk = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        m = blocks[row]
        at = permute(blk, m, K.mix64((k[row] + seed * 1_000_003).astype(np.uint64)))
        lo, hi = blk * size[row] // m, (blk + 1) * size[row] // m
        if whole:
            lo, hi = o[row], o[row] + n[row]
        out_row, out_pos, out_a, out_b = [], [], [], []
        for p in range(most):
            pos = at + p * m
            some = pos < full[row]
            end = hi
            if not whole:
                cut = (pos == full[row]) & (part[row] > 0)
                some |= cut
                end = np.where(cut, np.minimum(hi, lo + part[row]), hi)
            a, e = np.maximum(lo, o[row]), np.minimum(end, o[row] + n[row])
            i = np.flatnonzero(some & (a < e))
            out_row.append(row[i])
            out_pos.append(pos[i])
            out_a.append(a[i] - o[row[i]])
            out_b.append(e[i] - o[row[i]])
        r, pos, a, e = (np.concatenate(x) for x in (out_row, out_pos, out_a, out_b))
        order = np.lexsort((a, pos // blocks[r], r))
        r, pos, a, e = r[order], pos[order], a[order], e[order]
        shard = np.zeros(len(r), np.int32)
        heads, where_k = np.unique(k, return_index=True)
        base, places = col["base"].to_numpy(), col["places"].to_numpy()
        mine = np.searchsorted(heads, k[r])
        by = np.argsort(mine, kind="stable")
        edges = np.searchsorted(mine[by], np.arange(len(heads) + 1))
        for j, w in enumerate(where_k):
            i = by[edges[j] : edges[j + 1]]
            if len(i):
                starts = np.cumsum(deck.before(int(base[w] + places[w])) - deck.before(int(base[w])))
                shard[i] = np.searchsorted(starts, pos[i], "right")
        place = K.mix64((pos.astype(np.uint64) << np.uint64(20)) + k[r].astype(np.uint64) + np.uint64(seed)).view(np.int64)
        taken = np.bincount(r, weights=e - a, minlength=len(n)).astype(np.int64)
        off = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(n)))]).astype(np.int32)
        piece = pa.StructArray.from_arrays([pa.array(shard), pa.array(place), pa.array((pos // blocks[r]).astype(np.int32)), pa.array(a), pa.array(e)], names=["shard", "place", "pass", "start", "end"])
        names = ["doc_id", "source", "tie", "at", "size", "source_size", "target"]
        return pa.RecordBatch.from_arrays([*(col[x] for x in names), pa.array(taken), pa.ListArray.from_arrays(pa.array(off), piece)], names=[*names, "taken", "pieces"])

    def run(batches):
        deck = Deck(total, shards, seed)
        yield from per_batch(lambda b: deal(b, deck))(batches)

    return ready.mapInArrow(run, _PLAN)


def plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int | None = None, seed: int = 1, whole: bool = False, where: str | None = None) -> DataFrame:
    """doc_id, source, tie, size, source_size, target, taken, pieces of every row of docs.

    pieces: (shard, place, pass, start, end): words start..end of the document go
    to the shard, in the order of place. Their lengths add up to taken. With
    `whole`, a document goes with the block that holds its first word, as often
    as that block is drawn, so pieces are whole documents and the targets are met
    within some documents' lengths instead of a word or two.

    Null texts have no words, like empty ones; null sources are a source; very
    long texts are cut by blocks like others; no document is taken more than
    `most` times; rows of equal doc_id and text are taken each on their own; an
    empty table gives an empty result; other columns of docs are not looked at.
    Reruns agree.
    """
    where = where or shared_dir(docs.sparkSession, "mixing")
    return _plan(sizes(docs), where, weights=weights, most=most, block_words=block_words, shards=shards, seed=seed, whole=whole).drop("at")


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shards: int | None = None, seed: int = 1, where: str | None = None) -> DataFrame:
    """The mix as rows with docs's own columns, whatever their names: whole documents, each as often as its block is drawn, gathered by shard and shuffled within it.

    Every row of docs takes what the plan gives to that very row, repeated rows
    too, so quotas are met as in plan. Rows without a word are not taken. An
    empty table gives an empty result.
    """
    where = where or shared_dir(docs.sparkSession, "mix")
    rows = settle(docs.select(F.monotonically_increasing_id().alias("at"), packed(docs)), f"{where}/rows")
    plain = [F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    named = rows.select("at", F.xxhash64(*plain).alias("mark"), *[F.col("row").getField(c).alias(c) for c in ("doc_id", "source", "text")])
    p = _plan(sizes(named, F.col("at"), F.col("mark")), where, weights=weights, most=most, block_words=block_words, shards=shards, seed=seed, whole=True)
    p = p.where("taken > 0").select("at", F.transform("pieces", lambda x: F.struct(x["shard"].alias("shard"), x["place"].alias("place"))).alias("pieces"))
    each = rows.join(p, "at").select("at", "row", F.explode("pieces").alias("piece")).select("at", "row", "piece.shard", "piece.place")
    return each.repartition(shuffle_parts(docs.sparkSession), "shard").sortWithinPartitions("shard", "place", "at").select("row.*")
