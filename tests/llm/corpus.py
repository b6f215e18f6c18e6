"""Small awkward corpora, and brute-force forms of the operators."""

import collections
import hashlib
import math
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=5, n=120):
    """Nulls, empty and long texts, ties, copies, near copies, shared passages."""
    g = random.Random(seed)
    words = ["".join(g.choice("abcdeé") for _ in range(g.randint(2, 6))) for _ in range(200)]

    def text(k):
        return " ".join(g.choice(words) for _ in range(k))

    passages = [text(80) for _ in range(4)]
    out = [(None, text(20)), (1, None), (2, ""), (3, "a" * 900), (4, "ab" * 300), (5, " \t\n "), (6, "One two"), (7, "one TWO"), (8, "x\n\ny  z\n x\n x\n")]
    for i in range(10, n):
        t = text(g.randint(1, 90))
        if i % 3 == 0:
            p = g.choice(passages)
            a = g.randint(0, 100)
            t = t + " " + p[a : g.randint(a, len(p))] + text(g.randint(0, 30))
        if i % 7 == 0 and out[-1][1]:
            w = out[-1][1].split(" ")
            w[g.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append((i, t))
    out += [(n, out[20][1]), (n + 1, out[20][1]), (n + 2, text(4000))]
    return [(i, t, g.choice(["en", "de", None]), g.choice(["s1", "s1", "s2", "s3", None]), len(t or "")) for i, t in out]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


CLASHES = ("node", "fp", "bands", "size", "start", "content", "bucket", "score", "carried", "shard", "_id", "_gone", "gone", "id", "row", "_tie", "tie", "_shard", "_place", "place", "_d", "_s", "_t", "at", "mark", "piece", "pieces", "k", "range", "base", "_word", "_at", "_bits", "kept", "label", "root", "a.b", "host", "path", "x", "odd")


def clashing(df):
    """The same rows with more columns, whose names operators use or have used inside, and one with a dot."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(n).alias(c) for n, c in enumerate(CLASHES)])


def content(rows):
    """Rows as a multiset, each with its columns' names."""
    return collections.Counter(str(sorted(r.asDict().items())) for r in rows)


def held_out(i, mod, out):
    return i is not None and zlib.crc32(str(i).encode()) % mod == out


def rules(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    cov = set()
    for i in range(len(ws) - 4):
        if c[tuple(ws[i : i + 5])] > 1:
            cov.update(range(i, i + 5))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov), len(ws) < 10 or 100 * len(cov) > 20 * len(ws)


def shingles(t, k):
    ws = (t or "").encode().lower().split()
    return frozenset(tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)) if len(ws) >= k else (frozenset([tuple(ws)]) if ws else frozenset())


def components(data, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in data}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets, key=lambda i: (i is None, i))
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)), key=lambda i: (i is None, i))
                up[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(data, length):
    seen = collections.Counter()
    for _, t, *_ in data:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = []
    for i, t, *_ in data:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cov[k : k + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cov) if not c)
        out.append((i, len(b), sum(cov), sum(1 for k in range(len(b)) if cov[k] and (not k or not cov[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def bigram_scores(data, discounts):
    def tokens(t):
        return [*(t or "").encode().lower().split(), "</s>"]

    uni, bi = collections.Counter(), collections.Counter()
    for i, t, *_ in data:
        if not held_out(i, 7, 2):
            x = tokens(t)
            uni.update(x)
            bi.update(zip(["<s>", *x], x))
    n, v = sum(uni.values()), len(uni)
    cont = collections.Counter(w for _, w in bi)
    k = sum(cont.values())
    of = lambda c: discounts(*[collections.Counter(c.values())[j] for j in (1, 2, 3, 4)])
    d, e = of(bi), of(cont)
    ctx, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), c in bi.items():
        ctx[a] += c
        kinds[a][min(c, 3) - 1] += 1
    free = sum(e[min(c, 3) - 1] for c in cont.values()) / k

    def q(w):
        return (max(cont[w] - e[min(cont[w], 3) - 1], 0) if cont[w] else 0) / k + free / (v + 1)

    def p(a, w):
        if a not in ctx:
            return q(w)
        c = bi[a, w]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / ctx[a] + sum(x * y for x, y in zip(d, kinds[a])) / ctx[a] * q(w)

    out = []
    for i, t, *_ in data:
        x = tokens(t)
        out.append((i, held_out(i, 7, 2), len(x), sum(uni[w] > 0 for w in x), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in x), sum(math.log10(p(a, w)) for a, w in zip(["<s>", *x], x))))
    return out, lambda a: sum(p(a, w) for w in uni) + p(a, "never seen")
