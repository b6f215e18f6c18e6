"""Token-id files: concatenated ids with Elias-Fano coded document bounds.

A file holds the documents of one range of ids, in ascending order. Bounds are
not a table of 64-bit offsets: n + 1 rising numbers up to u take about
2 + log2(u / n) bits each (low bits packed, high bits in unary), and a select
structure finds the i-th from a sampled one bit without reading the others.
Document ids are coded in the same way. Files are memory-mapped for reading.

Layout (little endian): magic, 8 words of header, then ids, bounds, document ids.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, map_file, per_batch, put_file, shared_dir, shuffle_parts

MAGIC = b"RWTOKEN1"
SAMPLE = 256
CACHE_SEGMENTS = 700_000


class EliasFano:
    """n rising numbers (equal ones allowed) in [0, u]."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.width, self.low, self.high, self.marks = n, width, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        u = int(v[-1]) if n else 0
        width = max(0, (u // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if width else np.zeros((n, 0), np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, width, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sampled place on."""
        at = int(self.marks[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        for k in range(self.width):
            b = i * self.width + k
            low |= (int(self.low[b >> 3]) >> (b & 7) & 1) << k
        return (one - i) << self.width | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high.astype(np.int64)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.width).reshape(self.n, self.width)
        return (high | (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)).astype(np.int64)

    def parts(self) -> list[bytes]:
        head = np.array([self.n, self.width, len(self.low), len(self.high), len(self.marks)], "<u8")
        pad = b"\0" * (-(len(self.low) + len(self.high)) % 8)
        return [head.tobytes(), self.marks.astype("<u8").tobytes(), self.low.tobytes(), self.high.tobytes(), pad]

    @classmethod
    def read(cls, buf: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, width, lows, highs, marks = (int(x) for x in buf[at : at + 40].view("<u8"))
        at += 40
        m = buf[at : at + 8 * marks].view("<u8")
        at += 8 * marks
        low, high = buf[at : at + lows], buf[at + lows : at + lows + highs]
        at += lows + highs
        return cls(n, width, low, high, m), at + (-(lows + highs) % 8)


def file_parts(ids: list[bytes], width: int, docs: list[int | None]) -> list[bytes]:
    """A file's bytes; ids: each document's, as packed integers of `width` bytes. Null document ids come first."""
    ends = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])]).astype(np.int64)
    nulls = sum(d is None for d in docs)
    known = np.array([d for d in docs if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    pad = b"\0" * (-int(ends[-1]) * width % 8)
    head = np.array([width, len(docs), int(ends[-1]), nulls, least & (2**64 - 1), 0, 0, 0], "<u8").tobytes()
    rel = known.astype(np.uint64) - np.uint64(least & (2**64 - 1))
    return [MAGIC, head, *ids, pad, *EliasFano.of(ends).parts(), *EliasFano.of(rel).parts()]


class TokenFile:
    """A file that has been written, mapped into memory."""

    def __init__(self, uri: str):
        self.buf = np.frombuffer(map_file(uri), np.uint8)
        if self.buf[:8].tobytes() != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        width, self.n, total, self.nulls, self.least = (int(x) for x in self.buf[8:48].view("<u8"))
        self.kind = {2: "<u2", 4: "<u4"}[width]
        at = 72
        self.ids = self.buf[at : at + total * width].view(self.kind)
        at += total * width + (-total * width % 8)
        self.bounds, at = EliasFano.read(self.buf, at)
        self.docs, at = EliasFano.read(self.buf, at)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        known = (self.docs.all().astype(np.uint64) + np.uint64(self.least)).astype(np.int64)
        return [None] * self.nulls + known.tolist()


_UNSAFE = re.compile(r"\s\s(?:\s|\Z)")
_PLAIN = re.compile(r"\n?[^\s\0]+")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: letters by any version of Unicode, and signs that are neither letters, numbers nor spaces: the vocabulary's pattern always parts them
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class ByteEncoder:
    """Ids as the tokenizers library gives them, from ids of segments that a worker keeps.

    A byte-level vocabulary first cuts a text into words by a pattern; every
    space or line end that is not inside a longer stretch of white space starts
    a new word, so what lies between can be encoded by itself. A text's new
    segments go through the library, once for each worker, and signs after a
    word by themselves. When too many are kept, the later half goes: what is
    frequent came early. Texts with longer stretches are cut at single spaces
    between other signs only; texts that hold a special token go through the
    library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made["pre_tokenizer"] or {}
        self.cuts = made["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and made["post_processor"] is None
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.code = "H" if self.width == 2 else "I"
        self.kept: dict[str, bytes] = {}
        # ids of pieces that open with a space or a line end
        self.opens = np.zeros(self.lib.get_vocab_size(), bool)
        for piece, i in self.lib.get_vocab().items():
            self.opens[i] = piece[:1] in ("\u0120", "\u010a")
        # the same model, fed with bytes that already have their signs
        self.words = Tokenizer(self.lib.model)
        self.words.pre_tokenizer = pre_tokenizers.Split("\u0120", "merged_with_next")
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        others = (b for b in range(256) if b not in plain)
        self.signs = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}

    def _learn(self, keys: list[str]) -> None:
        """Ids of segments; those of a word and signs after it are put together."""
        if not self.cuts:
            return self._learn_whole(keys)
        whole, made = [], []
        heads, tails = set(), set()
        for k in keys:
            word = k.rstrip(_SIGNS)
            if word.isalpha() and (word.isascii() or _LATIN(word)):
                heads.add(word)
                if len(word) < len(k):
                    signs = "\0" + k[len(word) :]
                    tails.add(signs)
                    made.append((k, word, signs))
            else:
                whole.append(k)
        words = list(heads.difference(self.kept))
        if words:
            text = " ".join(["", *words]).encode().decode("latin-1").translate(self.signs)
            if not self._keep(words, self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids):
                whole += words
        self._learn_whole(list(tails.difference(self.kept).union(whole)))
        kept = self.kept
        for k, word, signs in made:
            kept[k] = kept[word] + kept[signs]

    def _keep(self, keys: list[str], ids: list[int]) -> bool:
        """Deals ids out to joined segments, by the pieces that open one; False, and nothing is kept, where they don't add up."""
        ids = np.array(ids, self.kind)
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(keys) or at[0] != 0:
            return False
        raw, cut = ids.tobytes(), [*(at * self.width).tolist(), len(ids) * self.width]
        self.kept.update(zip(keys, map(raw.__getitem__, map(slice, cut, cut[1:])), strict=True))
        return True

    def _learn_whole(self, keys: list[str]) -> None:
        """Ids of segments. Those with one space or line end, at their start, go through the library joined, a call for many: each begins a new word there and nowhere else, so its first piece tells where it starts. Should the pieces not add up, and for all others, each goes by itself."""
        plain = [k for k in keys if k and _PLAIN.fullmatch(k)]
        if len(plain) > 1:
            if self._keep(plain, self.lib.encode_batch_fast(["".join(map(self._text, plain))], add_special_tokens=False)[0].ids):
                keys = [k for k in keys if k not in self.kept]
        if keys:
            self.kept.update(zip(keys, self._raw([self._text(k) for k in keys]), strict=True))

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> list[str] | None:
        """Segments as they are kept: the text's first as it stands, the others by what follows their space."""
        if not self.cuts or not text or "\0" in text or any(s in text for s in self.special):
            return None
        got = _CUT.split(text) if _UNSAFE.search(text) else text.replace("\n", " \n").split(" ")
        # a first segment has no space before it: kept under a name that no other has (texts with a zero byte go whole)
        got[0] = "\0" + got[0]
        return got

    @staticmethod
    def _text(key: str) -> str:
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Nothing here refers back to itself, so the collector need not walk millions of segments meanwhile."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._batch(texts)
        finally:
            if was:
                gc.enable()

    def _batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            size, hi = 0, lo
            while hi < len(texts) and (hi == lo or size < 4_000_000):
                size += len(texts[hi])
                hi += 1
            parts = [self._parts(t) for t in texts[lo:hi]]
            got = [list(map(self.kept.get, p)) if p is not None else [self._raw([t])[0] if t else b""] for t, p in zip(texts[lo:hi], parts, strict=True)]
            gaps = [[i for i, x in enumerate(g) if x is None] for g in got]
            new = list({p[i] for p, at in zip(parts, gaps, strict=True) for i in at})
            if len(self.kept) + len(new) > CACHE_SEGMENTS:
                self.kept = dict(islice(self.kept.items(), CACHE_SEGMENTS // 2))
            for i in range(0, len(new), 20_000):
                self._learn(new[i : i + 20_000])
            for p, g, at in zip(parts, got, gaps, strict=True):
                for i in at:
                    g[i] = self.kept[p[i]]
                out.append(b"".join(g))
            lo = hi
        return out


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One for each worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, where: str, tokenizer: str, *, end_id: int | None = None) -> DataFrame:
    """Encodes every whole text and writes one file for each range of document ids below `where`.

    Returns the manifest (shard, path, docs, tokens), sorted by shard: shard order
    is document order. Null texts have no ids but the end id; very long texts are
    encoded whole; null ids come first; rows of equal ids are ordered by text.
    An empty table writes nothing; other columns of docs are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    parts = shuffle_parts(spark)
    dealt = keyed(docs).repartitionByRange(parts, "doc_id", F.xxhash64("text")).withColumn("shard", F.spark_partition_id()).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        enc = byte_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.kind).tobytes()
        ids, names, shard = [], [], None
        for b in batches:
            if b.num_rows:
                shard = b.column(2)[0].as_py()
                ids += [x + end for x in enc.batch(b.column(1).fill_null("").to_pylist())]
                names += b.column(0).to_pylist()
        if shard is not None:
            path = f"{where}/shard-{shard:06d}.tok"
            put_file(path, file_parts(ids, enc.width, names))
            total = sum(map(len, ids)) // enc.width
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(names)], pa.int64()), pa.array([total], pa.int64())], names=["shard", "path", "docs", "tokens"])

    manifest = dealt.mapInArrow(run, "shard int, path string, docs long, tokens long")
    manifest.write.parquet(f"{where}/manifest")
    return spark.read.parquet(f"{where}/manifest").orderBy("shard")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, read back; start: ids of all documents before it. The manifest has one row a shard, so its running totals are small."""
    spark: SparkSession = manifest.sparkSession
    rows, base = [], 0
    for r in manifest.collect():
        rows.append((r.path, base))
        base += r.tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(rows, "path string, base long").repartition(len(rows))

    def run(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f = TokenFile(path)
            bounds = f.bounds.all()
            crc = [zlib.crc32(f.ids[bounds[i] : bounds[i + 1]].astype("<u4").tobytes()) for i in range(f.n)]
            out.append(pa.RecordBatch.from_arrays([pa.array(f.doc_ids(), pa.int64()), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]))
        return out

    return files.mapInArrow(per_batch(run), schema)


def write_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    where = options.pop("where", None) or shared_dir(docs.sparkSession, "token-files")
    return read(write(docs, where, tokenizer, **options))
