"""MinHash near-duplicates with odd sketches.

A document's set is its distinct word shingles. Documents are linked where
100 * |A & B| >= percent * |A | B|; the result has every document's connected
component. The steps:

1.  One pass gives each document a fingerprint of its set, MinHash samples
    folded into band keys, and an odd sketch: the parity bitmap of its bottom
    MinHash sample (the SAMPLE least hashes), so that the population count of
    two sketches' XOR tells how much their samples differ. Sets of up to SAMPLE
    shingles are their own sample, and the count can't exceed their symmetric
    difference: there the sketch loses no link at all, and parts similarities
    of 0.85 and 0.83. For longer ones its limit is missed with about 1e-7.
2.  Equal sets become one node (a grouped aggregate with map-side combining),
    so groups of exact copies cost nothing later on.
3.  Nodes that share a band key meet in a bucket. Each bucket draws a centre;
    a node is tried against the nearest (by sketch) of its buckets' centres.
    So a bucket of m nodes gives m pairs, not m * m. Links found so make
    components (large-star / small-star rounds), and buckets that still hold
    several draw again, a few times.
4.  In buckets that hold several components even then, sketches of nodes of
    different components are compared; only pairs that they allow go on. So no
    pair within a bucket goes untried but those already connected. Buckets of up
    to CROWD nodes do that inside a join's condition. Larger ones are cut into
    tiles of some TILE nodes, and each pair of tiles is a group of its own, where
    blocks of sketches are compared at once. Their first pass gives each node's
    nearest of each other component only; the second gives all that are allowed
    between components which that has left apart.
5.  Each pair is confirmed on the full sets. A node's set is made once, from the
    whole text of a document that has it, and joined by node.

With 32 bands of 5 samples, a pair at similarity 0.85 shares no bucket with
probability 7e-9.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import keyed, narrow, packed, per_batch, settle, shared_dir

BANDS, ROWS, SAMPLE, SKETCH_BITS = 32, 5, 1024, 1024
STAR_ROUNDS = 3
CROWD, TILE = 64, 512
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)

SIGNATURES = "doc_id long, tie long, n_shingles long, fp long, bands array<long>, odd array<long>"


def sets_of(column: pa.Array, k: int):
    """For each text of the column, its sorted distinct shingle hashes."""
    for c in K.chunks(column):
        low = c.lower()
        s, e, first = low.words()
        sh, bounds = K.shingles(low.hash_ranges(s, e), first, k)
        for d in range(c.n):
            u = np.sort(sh[bounds[d] : bounds[d + 1]])
            if len(u) > 1:
                u = u[np.concatenate([[True], u[1:] != u[:-1]])]
            yield u


def set_print(u: np.ndarray) -> int:
    """One signed 64-bit print of a set of hashes."""
    x = K.mix64(u ^ K.U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ K.U64(len(u))
    return int(K.mix64(np.array([x], np.uint64)).view(np.int64)[0])


def minhash(u: np.ndarray) -> np.ndarray:
    x = (u >> K.U64(32)).astype(np.uint32)
    best = np.full(len(_A), 2**32 - 1, np.uint32)
    for lo in range(0, len(x), 2048):
        m = _A[:, None] * x[None, lo : lo + 2048]
        m += _B[:, None]
        np.minimum(best, m.min(1), out=best)
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    """Rows of samples -> rows of band keys; a key holds its band's number."""
    x = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), BANDS)).copy()
    for r in range(ROWS):
        acc *= K._Q
        acc += x[:, :, r]
        acc = K.mix64(acc)
    return acc.view(np.int64)


def odd_sketch(u: np.ndarray) -> np.ndarray:
    """Of a sorted set: 64-bit words of the parity bitmap of its SAMPLE least hashes, each at the place that its low bits name."""
    at = (u[:SAMPLE] & K.U64(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def sketch_limit(percent: int) -> int:
    """XOR population count beyond which two sets longer than SAMPLE lie at `percent` with a probability of about 1e-7: the samples' difference at `percent`, and 5.3 deviations of sampling and of parity."""
    miss = 1 - percent / 100
    differ = 2 * SAMPLE * miss
    stay = np.exp(-2 * differ / SKETCH_BITS)
    odd = (1 - stay) / 2
    spread = np.sqrt((2 * stay) ** 2 * SAMPLE * miss * (1 - miss) + SKETCH_BITS * odd * (1 - odd))
    return int(np.ceil(SKETCH_BITS * odd + 5.3 * spread))


def near(percent: int, far: str) -> str:
    """SQL condition on x.n, y.n and the XOR population count far: the pair may be linked."""
    whole = f"{far} * {100 + percent} <= {100 - percent} * (x.n + y.n)"
    return f"case when greatest(x.n, y.n) <= {SAMPLE} then {whole} else {far} <= {sketch_limit(percent)} end"


TRIES = "a long, label_a long, b long, label_b long, root_b long, far long"


def tile_pairs(percent: int, nearest: bool):
    """For applyInArrow, of the nodes of a left and a right tile of a bucket (side 0 and 1): the pairs of different roots that their sketches allow, of two that are both outside the main root only in the order of their numbers; nearest: of a left node and each other root only the first by sketch."""
    limit = sketch_limit(percent)

    def run(t: pa.Table) -> pa.Table:
        K.release()
        node, root, label, n, side, main = (t.column(c).to_numpy() for c in ("node", "root", "label", "n", "side", "main"))
        odd = np.ascontiguousarray(t.column("odd").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1).T)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        bits, in_main = odd[:, right], root[right] == main[right]
        out = [(np.zeros(0, np.int64),) * 3]
        for lo in range(0, len(left), 64):
            x = left[lo : lo + 64]
            far = np.zeros((len(x), len(right)), np.int64)
            for word in range(len(odd)):
                far += np.bitwise_count(odd[word, x][:, None] ^ bits[word])
            nx, ny = n[x][:, None], n[right]
            may = np.where(np.maximum(nx, ny) <= SAMPLE, far * (100 + percent) <= (100 - percent) * (nx + ny), far <= limit)
            may &= 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
            may &= (root[x][:, None] != root[right]) & (in_main | (node[x][:, None] < node[right]))
            i, j = np.nonzero(may)
            f, i, j = far[i, j], x[i], right[j]
            if nearest and len(i):
                o = np.lexsort((node[j], f, root[j], i))
                o = o[np.concatenate([[True], (i[o][1:] != i[o][:-1]) | (root[j][o][1:] != root[j][o][:-1])])]
                f, i, j = f[o], i[o], j[o]
            out.append((i, j, f))
        i, j, far = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([pa.array(c) for c in (node[i], label[i], node[j], label[j], root[j], far)], names=[c.split()[0] for c in TRIES.split(", ")])

    return run


def tiled(crowds: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (TRIES) of the nodes of crowds (key, main, node, root, label, n, odd). Left tiles hold a bucket's nodes outside its main root, right tiles all: a left node is copied for each right tile, and the other way round."""
    count = lambda c: F.greatest(F.lit(1), F.ceil(F.count(c) / TILE)).cast("int")
    tiles = crowds.groupBy("key").agg(count(F.when(F.col("root") != F.col("main"), 1)).alias("_left"), count(F.lit(1)).alias("_right"))
    own = crowds.join(tiles, "key")

    def dealt(side: int, name: str, other: str) -> DataFrame:
        tile = F.pmod(F.xxhash64("node", F.lit("tile")), F.col(name)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return own.select("key", tile.alias(name), each.alias(other), F.lit(side).alias("side"), "main", "node", "root", "label", "n", "odd")

    left = dealt(0, "_left", "_right").where("root <> main")
    both = left.unionByName(dealt(1, "_right", "_left"))
    return both.groupBy("key", "_left", "_right").applyInArrow(tile_pairs(percent, nearest), TRIES)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, and of texts with a word the set's print, band keys and odd sketch."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, fp, rows, odd, at = [], [], [], [], []
        for i, u in enumerate(sets_of(b.column(1), k)):
            n.append(len(u))
            fp.append(set_print(u) if len(u) else None)
            if len(u):
                rows.append(minhash(u))
                odd.append(odd_sketch(u))
                at.append(i)
        m = np.array(rows, np.uint32).reshape(len(rows), len(_A))
        full = np.zeros(b.num_rows, bool)
        full[at] = True

        def lists(x: np.ndarray) -> pa.Array:
            off = np.concatenate([[0], np.cumsum(full * x.shape[1])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(off), pa.array(x.ravel()))

        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), lists(band_keys(m)), lists(np.array(odd, np.int64).reshape(len(odd), SKETCH_BITS // 64))], names=["doc_id", "tie", "n_shingles", "fp", "bands", "odd"])

    return keyed(docs).withColumn("tie", F.xxhash64("text")).mapInArrow(per_batch(run), SIGNATURES)


def node_sets(docs: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(node, hashes) of the sets of documents whose ids are among labels (and of some others): one row a node, made where the texts lie and combined before the shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [u for u in sets_of(b.column(1), k) if len(u)]
        return pa.RecordBatch.from_arrays([pa.array([set_print(u) for u in got], pa.int64()), pa.array([u.tobytes() for u in got], pa.binary())], names=["node", "hashes"])

    return narrow(keyed(docs), labels).mapInArrow(per_batch(run), "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


class Sets:
    """The hash sets of nodes, made when a pair first asks for them and kept in the shared folder."""

    def __init__(self, docs: DataFrame, k: int, percent: int, where: str):
        self.docs, self.k, self.percent, self.where, self.made = docs, k, percent, where, []

    def _fetch(self, pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("node"), F.col("label_a").alias("id")).union(pairs.select("b", "label_b")).distinct()
        for have in self.made:
            asked = asked.join(have.select("node"), "node", "left_anti")
        at = f"{self.where}/sets-{len(self.made)}"
        asked = settle(asked, f"{at}-asked")
        if not asked.isEmpty():
            self.made.append(settle(node_sets(self.docs, asked.select("id"), self.k).join(asked.select("node"), "node", "left_semi"), at))
        out = None
        for have in self.made:
            out = have if out is None else out.unionByName(have)
        return out

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, label_a, b, label_b) of nodes those linked on the full sets; a label is the id of a document that has the set."""
        sets, percent = self._fetch(pairs), self.percent
        if sets is None:
            return pairs.select("a", "b").limit(0)
        found = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            return b.select([0, 1]).take(pa.array(keep, pa.int64()))

        return found.mapInArrow(per_batch(run), "a long, b long").distinct()


SMALL_ROWS = 500_000


def components(edges: DataFrame, where: str) -> DataFrame:
    """(node, root) of all nodes that an edge (a, b) touches; root: the component's smallest node. Alternates large-star and small-star until nothing changes, each round written to the shared folder. Nodes' minima are sent to all workers where there are few edges (SMALL_ROWS of them at most: 8 MB); beyond that they are written first and joined, so that a node of very many edges is a plain skewed side, which adaptive execution splits."""
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{where}/0")

    def state(x: DataFrame) -> tuple:
        r = x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    last = state(e)
    for i in itertools.count(1):
        few = last[0] <= SMALL_ROWS

        def side(df: DataFrame, name: str) -> DataFrame:
            return F.broadcast(df) if few else settle(df, f"{where}/{i}-{name}")  # noqa: B023

        both = e.select("u", "v").union(e.select("v", "u"))
        low = side(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large, f"{where}/{i}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least, "least"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = settle(small.distinct(), f"{where}/{i}")
        now = state(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


_FAR = " + ".join(f"bit_count(x.odd[{i}] ^ y.odd[{i}])" for i in range(SKETCH_BITS // 64))


def groups(docs: DataFrame, *, k: int = 3, percent: int = 85, where: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Texts without a word (null, empty, white space) have n_shingles 0 and are
    linked with nothing. Very long texts are taken whole. Rows with equal sets
    are one component. Rows that share a doc_id keep one row each. A null id
    never names a component: its row's component_id is the smallest other id, or
    null if there is none. An empty table gives an empty result; other columns
    of docs are not looked at.
    """
    return _grouped(docs, k, percent, where or shared_dir(docs.sparkSession, "neardup")).drop("tie")


def _grouped(docs: DataFrame, k: int, percent: int, where: str) -> DataFrame:
    """As groups, with tie, a hash of the text."""
    ratio = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    sig = settle(signatures(docs, k), f"{where}/signatures")
    reps = settle(
        sig.where("fp is not null").groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("label"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")),
        f"{where}/nodes",
    )
    members = reps.select("node", F.explode("bands").alias("key"))
    crowded = members.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node", "key").alias("r"), "node")).alias("c")).where("m > 1").select("key", F.col("c.node").alias("centre"))
    buckets = settle(members.join(crowded, "key"), f"{where}/buckets")
    short = reps.select("node", "label", "n", "odd")

    sets = Sets(docs, k, percent, where)
    comp = None
    for turn in range(STAR_ROUNDS):
        # buckets that hold several components draw a centre anew; the first draw is over all
        if turn == 0:
            tries = buckets.where("node <> centre").select("node", "centre").distinct()
        else:
            placed = buckets.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
            draw = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("r"), "node", "root")).alias("c")).where("lo <> hi").select("key", F.col("c.node").alias("centre"), F.col("c.root").alias("centre_root"))
            tries = placed.drop("centre").join(draw, "key").where("root <> centre_root").select("node", "centre").distinct()
        close = (
            tries.join(short.alias("x"), "node")
            .select("node", "centre", F.struct("x.label", "x.n", "x.odd").alias("x"))
            .join(short.select(F.col("node").alias("centre"), F.struct("label", "n", "odd").alias("y")), "centre")
            .where(ratio)
            .select("node", "centre", F.col("x.label").alias("label_a"), F.col("y.label").alias("label_b"), F.expr(_FAR).alias("far"), "x", "y")
            .where(near(percent, "far"))
            .groupBy("node", "label_a")
            .agg(F.min(F.struct("far", "centre", "label_b")).alias("best"))
            .select(F.col("node").alias("a"), "label_a", F.col("best.centre").alias("b"), F.col("best.label_b").alias("label_b"))
        )
        links = settle(sets.confirm(settle(close, f"{where}/tries-{turn}")), f"{where}/links-{turn}")
        if turn and links.isEmpty():
            break
        known = links if comp is None else comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)
        comp = components(known, f"{where}/components-{turn}")

    def still_open(name: str) -> DataFrame:
        placed = buckets.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.when(F.col("node") == F.col("centre"), F.col("root"))).alias("main")).where("lo <> hi").select("key", "m", "main")
        return settle(placed.join(mixed, "key").select("key", "m", "node", "root", "main").join(short, "node"), f"{where}/{name}")

    open_ = still_open("open")
    if not open_.where(F.col("m") > CROWD).isEmpty():
        best = F.min(F.struct("far", "b", "label_b")).alias("best")
        first = tiled(open_.where(F.col("m") > CROWD), percent, True).groupBy("a", "label_a", "root_b").agg(best).select("a", "label_a", F.col("best.b").alias("b"), F.col("best.label_b").alias("label_b"))
        links = settle(sets.confirm(settle(first, f"{where}/crowd-tries")), f"{where}/crowd-links")
        if not links.isEmpty():
            comp = components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links), f"{where}/components-crowd")
            open_ = still_open("open-again")
    few = open_.where(F.col("m") <= CROWD)
    left = few.where("root <> main").select("key", "main", F.struct("node", "root", "label", "n", "odd").alias("x"))
    right = few.select("key", F.struct("node", "root", "label", "n", "odd").alias("y"))
    more = (
        left.join(right, "key")
        .where("x.root <> y.root")
        .where("y.root = main or x.root < y.root")
        .where(ratio)
        .where(near(percent, f"({_FAR})"))
        .select(F.col("x.node").alias("a"), F.col("x.label").alias("label_a"), F.col("y.node").alias("b"), F.col("y.label").alias("label_b"))
    )
    crowded_tries = settle(tiled(open_.where(F.col("m") > CROWD), percent, False).select("a", "label_a", "b", "label_b"), f"{where}/more-crowd-tries")
    more = settle(more.union(crowded_tries).distinct(), f"{where}/more-tries")
    if not more.isEmpty():
        links = settle(sets.confirm(more), f"{where}/more-links")
        comp = components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links), f"{where}/components-last")

    named = reps.select("node", "label").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written first: a root of very many nodes then is a plain skewed side of the join
    least = settle(named.groupBy("root").agg(F.min("label").alias("component_id")), f"{where}/names")
    named = named.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    return (
        sig.select("doc_id", "tie", "n_shingles", "fp")
        .join(named, "fp", "left")
        .select("doc_id", "tie", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep(docs: DataFrame, *, k: int = 5, percent: int = 80, where: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, but for those in a group with a smaller id. Of rows alike in id and group all stay, and so do texts without a word; a row of null id stays unless its group has an id; an empty table gives none."""
    gone = _grouped(docs, k, percent, where or shared_dir(docs.sparkSession, "neardup")).where("not kept").select(F.col("doc_id").alias("gone"), F.col("tie").alias("gone_tie")).distinct()
    one = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), packed(docs))
    return one.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("tie") == F.col("gone_tie")), "left_anti").select("row.*")
