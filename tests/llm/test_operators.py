"""Each operator against a brute-force form or its library, on awkward rows and on none."""

import collections
import hashlib
import itertools
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadweave.llm import fingerprints, kernels, mixing, neardup, ngram_lm, quality_rules, sentencepieces, site_quality, suffix_dedup, token_files, toxicity
from roadweave.llm.common import keyed, per_batch
from tests.llm import corpus as C

DATA = C.rows()
key = lambda r: str(r[0])


@pytest.fixture(scope="module")
def docs(spark):
    return C.clashing(C.frame(spark, DATA)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return C.frame(spark, [])


def test_kernels_match_python():
    texts = [t for _, t, *_ in DATA]
    for limit in (1, 200, 1 << 20):
        got = []
        for c in kernels.chunks(pa.array(texts, pa.string()), limit):
            s, e, first = c.lower().words()
            got += [[c.lower().data[i:j].tobytes() for i, j in zip(s[a:b], e[a:b])] for a, b in zip(first, first[1:])]
        assert got == [(t or "").encode().lower().split() for t in texts]


def test_sentencepiece(docs, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t, *_ in DATA:
        ids = sp.encode(t or "") + [sp.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in sentencepieces.encode(docs, path, digests_only=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    full = sentencepieces.encode(docs, path).where("doc_id = 8").first()
    assert full.ids == sp.encode(DATA[8][1]) + [2] and full.decoded == DATA[8][1]
    assert sentencepieces.encode(none, path).count() == 0


def test_sentencepiece_agenda():
    e = sentencepieces.Encoder(P.path("piece_bpe_32k.model"))
    sp = e.model.sp
    g = random.Random(1)
    odd = ["", " ", "  ", "a  b", "\n", " \n ", "▁", "a▁ b", "▁▁a", "日本語 テスト", "\x00a", "x" * 700, "ab " * 50 + "  " + "q" * 300, "</s> <s>", "😀 é̂"]
    odd += ["".join(g.choice(" \nab▁é日1.,\t ") for _ in range(g.randint(0, 40))) for _ in range(400)]
    for t, ids in zip(odd, e.batch(odd)):
        want = sp.encode(t)
        assert ids == " ".join(map(str, want))
        assert e.model.decode(ids.split(" ") if ids else []).decode() == sp.decode(want)
    e.model.bare = sentencepieces._without_prefix(P.path("piece_bpe_32k.model"))
    e.model.pairs.clear()
    e.model.score[:] = -np.inf  # a broken agenda is an error, not mended
    with pytest.raises(RuntimeError, match="library"):
        e.batch(["a word that is new here"]).__next__()


def test_sentencepiece_long_segments():
    e, g = sentencepieces.Encoder(P.path("piece_bpe_32k.model")), random.Random(2)
    long = "".join(g.choice("abcdefgh") for _ in range(150))
    assert e.model.encode_long("▁" + long) == e.model.encode_segments(["▁" + long])[0]


def test_ngram_lm(docs, none):
    want, total = C.bigram_scores(DATA, ngram_lm.discounts)
    got = [tuple(r)[:7] for r in ngram_lm.train_and_score(docs).collect()]
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    assert total(b"changed") == pytest.approx(1)
    assert ngram_lm.train_and_score(none).collect() == []


def test_toxicity(spark, docs, none):
    g = random.Random(4)
    data, labels = [], []
    for i in range(900):
        w = [g.choice(["tree", "sky", "road", "lamp", "cup", "door"]) for _ in range(12)]
        # neither word alone is toxic, both together are
        a, b = g.random() < 0.5, g.random() < 0.5
        w += ["foul,"] * a + ["Group."] * b
        g.shuffle(w)
        data.append((i, " ".join(w)))
        labels.append((i, int(a and b)))
    texts, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score(texts, toxicity.train(texts, marks)).collect()
    out = [(r.predicted, labels[r.doc_id][1]) for r in rows if r.held_out]
    assert len(out) > 200 and sum(p == y for p, y in out) / len(out) > 0.97
    assert all(r.held_out == C.held_out(r.doc_id, 3, 1) for r in rows)
    m = toxicity.train(docs, marks.limit(0))
    assert toxicity.score(none, m).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, m).collect())


def test_fingerprints(docs, none, spark):
    got = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    assert len(got) == len(DATA)
    order = sorted(DATA, key=lambda r: (r[0] is not None, r[0] or 0))
    for n, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = (C.shingles(x, 5) for x in (t, edited, after))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(near(a, b), abs=0.2) and r.near_next == pytest.approx(near(a, c), abs=0.2)
    assert got[120].fingerprint == got[121].fingerprint and got[2].fingerprint == got[1].fingerprint == ""
    assert fingerprints.compare(none).count() == 0
    s = fingerprints.sketch(docs)
    whole = fingerprints.merged(s.selectExpr("1 AS g", "fingerprint").selectExpr("cast(g AS bigint) AS g", "fingerprint"), "g").first().fingerprint
    every = frozenset().union(*[C.shingles(t, 5) for _, t, *_ in DATA])
    assert fingerprints.distinct(fingerprints.unpack(whole)) == pytest.approx(len(every), rel=0.3)
    a = np.arange(10, dtype=np.uint64)
    assert fingerprints.containment(a[:4], a) == 1 and fingerprints.resemblance(a[:5], a) == 0.5


def test_quality_rules(docs, none):
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules.rules(docs).collect()}
    assert got == {i: C.rules(t) for i, t, *_ in DATA}
    kept = {r.doc_id for r in quality_rules.rules(docs).where("kept").collect()}
    out = quality_rules.keep(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert quality_rules.rules(none).count() == 0 and quality_rules.keep(none).count() == 0


def test_quality_rules_reject_outliers(spark):
    g = random.Random(2)
    clean = [(i, " ".join(g.choice(["stone", "river", "cloud,", "meadow."]) + str(g.randint(0, 99)) for _ in range(60)), "en", "s", 0) for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{g.randint(0, 999)}$$$%%%" for _ in range(60)), "en", "s", 0) for i in range(40)]
    kept = {r.doc_id for r in quality_rules.rules(C.frame(spark, clean + junk)).where("kept").collect()}
    assert kept == {i for i, *_ in clean}


@pytest.mark.parametrize("whole", [False, True])
def test_mixing(docs, none, whole):
    p = mixing.plan(docs, whole=whole, block_words=16, shards=5)
    got = p.collect()
    assert len(got) == len(DATA)
    words = {}
    for _, t, _, s, _ in DATA:
        words[s] = words.get(s, 0) + len((t or "").encode().split())
    names = sorted((s for s in words if s is not None)) + ([None] if None in words else [])
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(words.values()) - sum(3 * words[s] for s in full)
        over = {s for s in names if s not in full and left * weight[s] / sum(weight[x] for x in names if x not in full) > 3 * words[s]}
        if not over:
            break
        full |= over
    for s in names:
        target[s] = 3.0 * words[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full)
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == words[s] and r.target == pytest.approx(target[s]) for r in mine)
        taken = sum(r.taken for r in mine)
        if not whole:
            assert abs(taken - target[s]) <= 2
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == sum(x["end"] - x["start"] for x in r.pieces)
        at = [(x["pass"], k) for x in r.pieces for k in range(x["start"], x["end"])]
        assert len(at) == len(set(at))
    again = sorted((key(r), r.taken, str(r.pieces)) for r in mixing.plan(docs, whole=whole, block_words=16, shards=5).collect())
    assert again == sorted((key(r), r.taken, str(r.pieces)) for r in got)
    assert mixing.plan(none).count() == 0


def test_splitting_tree_is_exact():
    q = np.array([7, 0, 1000, 13, 90_000, 1])
    ends = np.concatenate([[0], np.cumsum(q)])
    for shards in (1, 6, 100):
        deck = mixing.Deck(int(ends[-1]), shards, 3)
        at = [deck.before(int(x)) for x in ends]
        assert (np.diff(at, axis=0) >= 0).all() and (np.diff(at, axis=0).sum(1) == q).all()
        assert at[-1].max() - at[-1].min() <= 1
        again = mixing.Deck(int(ends[-1]), shards, 3)  # in any order of asking
        assert all((again.before(int(x)) == y).all() for x, y in list(zip(ends, at, strict=True))[::-1])
    # the law: mean and variance of what one source gives to one shard
    n, k, m = 20_000, 5_000, 4
    got = np.array([mixing.Deck(n, m, seed).before(k)[1] for seed in range(400)])
    room = n // m
    assert got.mean() == pytest.approx(k / m, abs=6) and got.var() == pytest.approx(room * (k / n) * (1 - k / n) * (n - room) / (n - 1), rel=0.3)
    for m in (1, 2, 3, 17, 1000):
        x = np.arange(m)
        assert sorted(mixing.permute(x, np.full(m, m), np.full(m, 9, np.uint64))) == x.tolist()


def test_mixing_of_many_sources(spark):
    """Sources by the hundred, of few words each: no table of sources by shards is made anywhere."""
    data = [(i, "w " * (i % 7), "en", f"s{i % 900:04d}", 0) for i in range(3000)]
    got = mixing.plan(C.frame(spark, data), block_words=2, shards=50).collect()
    size, taken = {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert all(0 <= x.shard < 50 for x in r.pieces)
    assert all(r.source_size == size[r.source] and abs(taken[r.source] - r.target) <= 8 for r in got)  # blocks of a source differ by a word
    held = np.bincount([x.shard for r in got for x in r.pieces], minlength=50)
    assert held.min() > 0.5 * held.mean()


def test_mixed_rows(docs, none):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    plan = mixing.plan(docs, whole=True).collect()
    assert out.count() == sum(len(r.pieces) for r in plan)
    assert set(C.content(out.collect())) <= set(C.content(docs.collect()))
    assert mixing.mixed(none).count() == 0


def test_mixed_rows_alike(spark):
    """Rows alike in id, source and text take what the plan gives them, each its own part."""
    data = [(1, "a b c", "en", "s1", 3)] * 80 + [(i, "d e f g", "de", "s2", 4) for i in range(2, 42)] + [(1, "a b c", "fr", "s1", 3)] * 20
    docs = C.frame(spark, data)
    plan = mixing.plan(docs, whole=True, block_words=4).collect()
    want = {s: sum(len(r.pieces) for r in plan if r.source == s) for s in ("s1", "s2")}
    rows = mixing.mixed(docs, block_words=4).collect()
    assert {s: sum(r.source == s for r in rows) for s in ("s1", "s2")} == want
    again = mixing.mixed(docs.repartition(3), block_words=4).collect()
    assert C.content(rows) == C.content(again)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, none, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs, k=k, percent=percent).collect()}
    assert got == C.components(DATA, k, percent)
    gone = {i for i, (_, c) in got.items() if i != c}
    kept = neardup.keep(docs, k=k, percent=percent)
    assert kept.columns == docs.columns and C.content(kept.collect()) == C.content(r for r in docs.collect() if r.doc_id not in gone)
    assert neardup.groups(none).count() == 0 and neardup.keep(none).count() == 0


def test_near_duplicates_keep_rows_of_shared_ids(spark):
    """Rows that share an id, null too, are judged by their own texts."""
    t = "one two three four five six seven"
    data = [(1, t), (2, t), (2, "other words stand here and nowhere else"), (None, t), (None, "a text of its own that has no copy"), (None, None), (3, "")]
    got = neardup.keep(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert C.content(got) == C.content(spark.createDataFrame([x for i, x in enumerate(data) if i not in (1, 3)], "doc_id long, text string").collect())


def test_odd_sketches_lose_no_link():
    g = np.random.default_rng(4)
    for n in (3, 40, 600, 1024, 3000, 9000):
        for percent in (80, 85):
            for _ in range(30):
                both = int(np.ceil(n * percent / 100))
                x = g.permutation(np.unique(g.integers(0, 2**64, n, dtype=np.uint64)))
                a, b = np.sort(x[: (len(x) + both) // 2]), np.sort(np.concatenate([x[:both], x[(len(x) + both) // 2 :]]))
                far = int(np.bitwise_count((neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).view(np.uint64)).sum())
                if max(len(a), len(b)) <= neardup.SAMPLE:
                    assert far * (100 + percent) <= (100 - percent) * (len(a) + len(b))
                else:
                    assert far <= neardup.sketch_limit(percent)


def test_components_of_long_chains_and_stars(spark, tmp_path):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(1499, 5000), (7, 7)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(500)} | {5000: 1000}


def test_near_duplicates_in_a_hot_group(spark):
    """A large group of near copies, of which only neighbours are alike enough."""
    g = random.Random(3)
    w = [f"w{i}" for i in range(120)]
    data = []
    for i in range(60):
        w[g.randrange(len(w))] = f"new{i}"
        data.append((i, " ".join(w), "en", "s", 0))
    data += [(100 + i, data[7][1], "en", "s", 0) for i in range(50)]
    g.shuffle(data)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(C.frame(spark, data)).collect()}
    assert got == C.components(data, 3, 85)


def test_workers_drop_the_vocabulary(spark, docs):
    """A worker that has encoded texts keeps nothing of it while it runs tasks of other kinds."""

    def held(b: pa.RecordBatch) -> pa.RecordBatch:
        from roadweave.llm import sentencepieces as S

        return pa.RecordBatch.from_arrays([pa.array([len(S._encoders)] * b.num_rows, pa.int64())], names=["n"])

    for owner, want in (("sentencepieces", 1), (None, 0)):
        for _ in range(2):
            assert sentencepieces.encode(docs, P.path("piece_bpe_32k.model")).select("n_tokens").collect()
        got = {r.n for r in keyed(docs).repartition(4).mapInArrow(per_batch(held, owner) if owner else per_batch(held), "n long").collect()}
        assert max(got) == want


def test_near_duplicates_in_tiles(spark, monkeypatch):
    """A bucket of hundreds, most of them connected, is compared by pairs of tiles, and no join sees its pairs."""
    monkeypatch.setattr(neardup, "CROWD", 8)
    monkeypatch.setattr(neardup, "TILE", 50)
    seen = []
    tiled = neardup.tiled
    monkeypatch.setattr(neardup, "tiled", lambda crowds, *a: (seen.append(crowds.agg({"m": "max"}).first()[0]), tiled(crowds, *a))[1])
    g = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    data = []
    for i in range(240):
        w = list(base)
        for _ in range(g.randrange(8)):
            w[g.randrange(len(w))] = f"new{g.randrange(40)}"
        data.append((i, " ".join(w), "en", "s", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(C.frame(spark, data)).collect()}
    assert got == C.components(data, 3, 85)
    assert 10 < len({c for _, c in got.values()}) < 200 and max(x or 0 for x in seen) > 100


def test_tile_pairs_match_all_pairs():
    g = np.random.default_rng(5)
    base = g.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[g.random(300) > cut], g.integers(0, 2**64, int(300 * cut), dtype=np.uint64)])) for cut in g.random(150) * 0.2]
    root = np.where(np.arange(150) % 3 > 0, 7, g.integers(0, 12, 150))
    odd = [neardup.odd_sketch(u) for u in sets]
    rows = [{"side": side, "main": 7, "node": i, "root": int(root[i]), "label": i + 1000, "n": len(sets[i]), "odd": odd[i].tolist()} for side in (0, 1) for i in range(150) if side or root[i] != 7]
    t = pa.Table.from_pylist(rows)
    want = {}
    for i, j in itertools.combinations(range(150), 2):
        far = int(np.bitwise_count((odd[i] ^ odd[j]).view(np.uint64)).sum())
        n = [len(sets[i]), len(sets[j])]
        if root[i] != root[j] and 185 * far <= 15 * sum(n) and 100 * min(n) >= 85 * max(n):
            want[i, j] = far
    got = neardup.tile_pairs(85, False)(t).to_pylist()
    assert want and sorted((*sorted((r["a"], r["b"])), r["far"]) for r in got) == sorted((*k, f) for k, f in want.items())
    assert all((r["label_a"], r["label_b"], r["root_b"]) == (r["a"] + 1000, r["b"] + 1000, root[r["b"]]) for r in got)
    near = {}
    for r in got:
        near[r["a"], r["root_b"]] = min(near.get((r["a"], r["root_b"]), (9999,)), (r["far"], r["b"]))
    assert {(r["a"], r["root_b"]): (r["far"], r["b"]) for r in neardup.tile_pairs(85, True)(t).to_pylist()} == near


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(docs, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_GROUP", hot)
    got = sorted([tuple(r) for r in suffix_dedup.remove_repeats(docs, length=200).collect()], key=str)
    assert got == C.repeats(DATA, 200)
    full = suffix_dedup.remove_repeats(docs, length=120, keep_text=True, carry=["lang", "bucket"]).collect()
    want = C.repeats(DATA, 120)
    assert sorted([tuple(r)[:5] for r in full], key=str) == want
    assert all(sum(x["end"] - x["start"] for x in r.removed) == r.n_removed for r in full)
    assert suffix_dedup.remove_repeats(none).count() == 0


def _crowd(n, slices):
    """Suffixes of n differing runs that share an anchor, in the first of its slices; every third's bytes from place 40 on are the same."""
    g = np.random.default_rng(7)
    raw = g.integers(97, 123, (n, 278), dtype=np.uint8)
    raw[:, 100:148] = 99
    raw[::3, 40:100] = raw[::3, 148:] = 100
    raw = [x.tobytes() for x in raw]
    num = lambda x, t: pa.array(np.full(n, x), t)
    cols = [pa.array(np.arange(n)), num(1, pa.int64()), num(0, pa.int64()), num(79, pa.int64()), num(100, pa.int64()), num(0, pa.int32()), num(slices, pa.int32()), num(1, pa.int8()), pa.array(raw, pa.binary()), pa.array([x[100:148] for x in raw], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in suffix_dedup._SUFFIX.split(", ")]), raw


def test_a_hot_anchor_is_hashed_in_pieces():
    """Its slices each have all of its runs: a worker holds their bytes, not many times that."""
    batch, raw = _crowd(24_000, 6)
    list(suffix_dedup._resolve(200)(iter([_crowd(100, 6)[0]])))
    tracemalloc.start()
    list(suffix_dedup._resolve(200)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(raw) * len(raw[0])


def test_pieces_of_a_hot_anchor_find_all(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    batch, raw = _crowd(60, 2)
    got = pa.Table.from_batches(suffix_dedup._resolve(200)(iter([batch])))
    seen = collections.Counter(x[s : s + 200] for x in raw for s in range(0, 79, 2))
    want = {(i, s) for i, x in enumerate(raw) for s in range(0, 79, 2) if seen[x[s : s + 200]] > 1}
    assert {(x["doc_id"], s) for x in got.to_pylist() for s in range(x["start"], x["end"] - 199)} == want and len(want) == 20 * 20


def test_larger_texts_are_dealt_to_more_tasks(spark, docs, monkeypatch):
    """However few partitions the session sets, a bucket's texts are bounded."""
    few = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs, length=200).where("doc_id is not null").collect())
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 20_000)
    asked = []
    monkeypatch.setattr(suffix_dedup, "_tokens", lambda d, n, parts, f=suffix_dedup._tokens: asked.append(parts) or f(d, n, parts))
    got = suffix_dedup.remove_repeats(docs, length=200)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert asked == [-(-size // 20_000)] and asked[0] > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(tuple(r) for r in got.where("doc_id is not null").collect()) == few


def test_multikey_sort():
    g = random.Random(6)
    raw = bytes(g.choice(b"ab") for _ in range(600))
    data = np.frombuffer(raw, np.uint8)
    starts = np.array([g.randrange(500) for _ in range(200)])
    order, same = suffix_dedup.multikey_sort(data, starts, 13)
    cut = [raw[starts[i] : starts[i] + 13] for i in order]
    assert cut == sorted(cut) and same.tolist() == [False, *(a == b for a, b in zip(cut, cut[1:]))]


def test_token_files(docs, none, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    data = sorted(DATA, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, t, *_ in data:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.write_and_read(docs, P.path("byte_bpe_50k.json"), end_id=2)
    assert sorted([tuple(r) for r in got.collect()], key=lambda r: r[1]) == want
    assert token_files.write_and_read(none, P.path("byte_bpe_50k.json")).count() == 0
    manifest = token_files.write(docs, f"file://{tmp_path}/x", P.path("byte_bpe_50k.json"), end_id=2).collect()
    f = token_files.TokenFile(manifest[0].path)
    assert zlib.crc32(f.document(1).astype("<u4").tobytes()) == want[1][3]


def test_byte_encoder_segments():
    e = token_files.byte_encoder(P.path("byte_bpe_50k.json"))
    g = random.Random(3)
    odd = ["", " ", "a  b", "\n\n", "it's 's\n's", "<|endoftext|> x", "a\xa0 b", "　\n c", "a\x1c b \x1f\n", "\0a b", "a \0b   c d", "x   y z\n\n\n'll we've"]
    odd += ["".join(g.choice(" \nab\té日1.,\t \r\xa0's") for _ in range(g.randint(0, 30))) for _ in range(2000)]
    for t, raw in zip(odd, e.batch(odd)):
        assert np.frombuffer(raw, "<u2").tolist() == e.lib.encode(t, add_special_tokens=False).ids, t


def test_byte_encoder_words_and_signs(monkeypatch):
    """Signs after a known word cost the library nothing, and a full store loses what came last, not what came first."""
    e = token_files.ByteEncoder(P.path("byte_bpe_50k.json"))
    asked = []
    learn = e._learn_whole
    monkeypatch.setattr(e, "_learn_whole", lambda keys: asked.extend(keys) or learn(keys))
    texts = ["a word and Été", "a word, and Été!! word. don't 'word' x's a_b A1, naïve... 1.000, ½, Ⅷ! ǅ ɐ, ʰ! e\u0301, #", "word,' Été'' and'"]
    for t in texts:
        assert np.frombuffer(e.batch([t])[0], "<u2").tolist() == e.lib.encode(t, add_special_tokens=False).ids
    assert not {"word", "word,", "Été!!", "word.", "naïve...", "word,'", "Été''", "and'"} & set(asked)
    monkeypatch.setattr(token_files, "CACHE_SEGMENTS", 60)
    first = list(e.kept)[:30]
    g = random.Random(4)
    for _ in range(30):
        t = " ".join("".join(g.choice("abcdeéñß") for _ in range(5)) + g.choice(["", ",", "!?", "'s"]) for _ in range(20))
        assert np.frombuffer(e.batch([t])[0], "<u2").tolist() == e.lib.encode(t, add_special_tokens=False).ids
        assert set(first) <= e.kept.keys() and len(e.kept) < 200


def test_elias_fano():
    g = np.random.default_rng(1)
    for top in (1, 5, 1000, 10**9):
        for n in (1, 2, 255, 256, 257, 1500):
            v = np.sort(g.integers(0, top, n))
            e, _ = token_files.EliasFano.read(np.frombuffer(b"".join(token_files.EliasFano.of(v).parts()), np.uint8), 0)
            assert (e.all() == v).all() and all(e.select(int(i)) == v[i] for i in g.integers(0, n, 20))
    v = np.sort(g.integers(0, 10**6, 10_000))
    assert len(b"".join(token_files.EliasFano.of(v).parts())) * 8 < 10_000 * 10


def test_site_quality(spark, none):
    g = random.Random(8)
    data, labels = [], []
    for i in range(800):
        site = g.choice(["good", "good", "bad", "rare"]) if i % 40 else "rare"
        fine = g.random() < {"good": 0.95, "bad": 0.2, "rare": 0.6}[site]
        words = [g.choice(["river", "stone", "cloud"]) + str(g.randint(0, 99)) for _ in range(50)]
        data.append((i, " ".join(words if fine else [w + "$$%%" for w in words]), "en", site, 0))
        labels.append((i, int(fine)))
    docs, marks = C.frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = site_quality.classify(docs, marks).collect()
    assert len(rows) == 800 and all(r.kept == bool(labels[r.doc_id][1]) for r in rows if r.held_out)
    rate = {d[3]: r.path_rate for r in rows for d in [data[r.doc_id]]}
    assert rate["bad"] < rate["rare"] < rate["good"]
    assert site_quality.classify(none, marks).count() == 0
    bare = site_quality.classify(docs.limit(5), marks.limit(0)).collect()
    assert len(bare) == 5 and all(r.path_rate == 0.5 for r in bare)


def test_site_quality_handles_awkward_rows(docs, spark):
    marks = spark.createDataFrame([(i, i % 2) for i in range(10, 60)], "doc_id long, quality int")
    assert site_quality.classify(docs, marks).count() == len(DATA)


def test_toxicity_learns_rare_pairs(spark):
    """Two words in a quarter of the texts each: with both the label is 1, with one it is as likely as without."""
    g = random.Random(9)
    data, labels = [], []
    for i in range(6000):
        w = [f"word{g.randint(0, 400)}" for _ in range(25)]
        a, b = g.random() < 0.15, g.random() < 0.15
        w += ["foul"] * a + ["folk"] * b
        g.shuffle(w)
        y = 1 if a and b else int(g.random() < (0.25 if a or b else 0.36))
        data.append((i, " ".join(w)))
        labels.append((i, y))
    texts, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = [r for r in toxicity.score(texts, toxicity.train(texts, marks)).collect() if r.held_out]
    both = [r.score for r in rows if {"foul", "folk"} <= set(data[r.doc_id][1].split())]
    one = [r.score for r in rows if len({"foul", "folk"} & set(data[r.doc_id][1].split())) == 1]
    assert len(both) > 20 and sum(both) / len(both) > 0.85 and sum(one) / len(one) < 0.6


def test_toxicity_score_matches_the_formula():
    """The machine's log odds against the sum over all pairs, written out."""
    g = np.random.default_rng(2)
    known = np.array([1, 5, 9, 12])
    m = toxicity.Machine(known, 0.3, g.normal(size=4), g.normal(size=(4, 3)), 4)
    sets = [[1, 5, 9], [], [2, 3], [12], [1, 2, 5, 9, 12]]
    idx = np.array([x for s in sets for x in s])
    got = m.odds(idx, np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    for s, odds in zip(sets, got, strict=True):
        at = [int(np.flatnonzero(known == x)[0]) for x in s if x in known]
        want = 0.3 + sum(m.weight[i] for i in at) + sum(float(m.vector[i] @ m.vector[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        assert odds == pytest.approx(want, abs=1e-5)


def test_quality_rules_kept_matches_brute_force(docs, spark):
    """Verdicts against quantiles of plain sorted lists of each cell."""
    data = DATA + [(1000 + i, *r[1:]) for i, r in enumerate(C.rows(seed=8, n=260))]
    frame = C.frame(spark, data)
    rows = [r.asDict() for r in quality_rules.rules(frame).collect()]
    place = {i: (lang, source) for i, _, lang, source, _ in data}
    from roadweave.llm.quality_rules import FENCE, LEAST_CELL, RULES

    def bucket(x):
        k = max(x.bit_length() - 6, 0)
        return x >> k << k

    def fences(values):
        v = sorted(map(bucket, values))
        q1, q2, q3 = (next(x for i, x in enumerate(v) if (i + 1) * 4 >= len(v) * part) for part in (1, 2, 3))
        return q2 + FENCE * (q2 - q1), q2 - FENCE * (q3 - q2)

    for r in rows:
        fine = not r["base_failed"]
        lang, source = place[r["doc_id"]]
        for rule, (up, down) in RULES.items():
            cell = [x[rule] for x in rows if place[x["doc_id"]] == (lang, source)]
            group = cell if len(cell) >= LEAST_CELL else [x[rule] for x in rows if place[x["doc_id"]][0] == lang]
            group = group if len(group) >= LEAST_CELL else [x[rule] for x in rows]
            high, low = fences(group)
            fine &= r[rule] <= high + up and (down is None or r[rule] >= low - down)
        assert r["kept"] == fine, r


def test_site_quality_reads_words(spark):
    """Good and bad texts of one site and one shape, told apart by their words."""
    g = random.Random(12)
    data, labels = [], []
    for i in range(900):
        fine = g.random() < 0.5
        words = [g.choice(["river", "stone", "cloud", "field", "grass"] if fine else ["click", "bonus", "offer", "prize", "deals"]) for _ in range(6)] + [f"w{g.randint(0, 300):03d}" for _ in range(30)]
        g.shuffle(words)
        data.append((i, " ".join(words), "en", "one", 0))
        labels.append((i, int(fine)))
    rows = site_quality.classify(C.frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    right = [r.kept == bool(labels[r.doc_id][1]) for r in rows if r.held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
