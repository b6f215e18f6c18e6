"""SentencePiece encoding and decoding (merge-type vocabularies).

The encoder keeps, for each segment of text, an agenda of its adjacent symbol
pairs ordered by the score of the piece that they would make (leftmost first
among equals), pops the best, joins the two symbols and enters the new pairs,
until no pair makes a piece. Characters that are no piece fall back to bytes.

Segments: no piece of such a vocabulary holds a space after another character
or a line end, so no merge crosses those places and the texts fall apart into
segments that repeat a great deal. A worker runs the agenda once for each
distinct segment, a whole Arrow batch of new ones at a time, as arrays; long
segments use a heap. Each batch of new segments is checked against the
sentencepiece library; a difference is an error, never mended in silence.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import keyed, per_batch

MARK = "▁"
CACHE_SEGMENTS = 1_000_000
LONG_SEGMENT = 200
_SLOW = re.compile(r" *[^ \n]+| +|\n[^ \n]*")


def _without_prefix(path: str):
    """The library's processor, but for the space that it puts before a text."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.normalization_rule_tsv or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("a vocabulary whose normaliser changes texts isn't supported")
    if proto.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
        raise ValueError("only merge-type vocabularies are supported")
    spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


class PieceModel:
    """Vocabulary and pair table of a .model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bare = _without_prefix(path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        if len(self.pieces) != len(plain) or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("a vocabulary with unused or repeated pieces isn't supported")
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.has_bytes = bool(self.byte_ids.max() > sp.unk_id()) and all(sp.is_byte(int(i)) for i in self.byte_ids)
        self.unk = sp.unk_id()
        self.surface = ["" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        self.odd_bytes = self.has_bytes
        self.text_of = {str(i): x for i, x in enumerate(self.surface)}
        self.text_of[str(self.unk)] = " ⁇ "
        if self.has_bytes:  # bytes above 7F as lone surrogates, which surrogateescape turns back into bytes
            self.text_of |= {str(i): bytes([b]).decode("ascii", "surrogateescape") for b, i in enumerate(self.byte_ids.tolist())}
        self.decimal = list(map(str, range(n)))
        if any(MARK in s.lstrip(MARK) or "\n" in s for s in self.pieces):
            raise ValueError("pieces with inner spaces or line ends aren't supported")
        # symbols: pieces by their id; then characters that only occur inside pieces; then one for all others
        self.symbols = dict(self.pieces)
        for s in self.pieces:
            for c in s:
                self.symbols.setdefault(c, len(self.symbols) + n)
        ids = list(self.symbols.values())
        self.none = max(ids, default=0) + 1
        self.base = self.none + 1
        pairs = {}
        for s, i in self.pieces.items():
            for k in range(1, len(s)):
                a, b = self.symbols.get(s[:k]), self.symbols.get(s[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (sp.get_score(i), i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.score = np.array([pairs[k][0] for k in self.keys.tolist()] + [-np.inf], np.float32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int32)
        self.pairs = pairs
        self.char_ids = {c: i for c, i in self.symbols.items() if len(c) == 1}
        self._table()

    def _table(self) -> None:
        """The pair table as an open-addressed hash table: slots hold a row of score and made, the last row means no pair."""
        size = 1 << max(4, (4 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        slot_key = np.full(size + 64, -1, np.int64)
        slot_row = np.full(size + 64, len(self.keys), np.int64)
        home = self._home(self.keys)
        for row, (h, key) in enumerate(zip(home.tolist(), self.keys.tolist(), strict=True)):
            while slot_key[h] >= 0:
                h += 1
            slot_key[h], slot_row[h] = key, row
        self.slot_key, self.slot_row = slot_key, slot_row

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of the pair table; the last row stands for no pair."""
        key = a.astype(np.int64) * self.base + b
        at = self._home(key)
        found = self.slot_key[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self.slot_key[at[open_]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        return np.where(self.slot_key[at] == key, self.slot_row[at], len(self.keys))

    def _finish(self, symbols: list[int], chars: list[str]) -> list[int]:
        """Ids of final symbols; chars: the characters that each stands for (only looked at for those that are no piece)."""
        out: list[int] = []
        for s, c in zip(symbols, chars, strict=True):
            if s < len(self.surface):
                out.append(s)
            elif self.has_bytes:
                out.extend(self.byte_ids[list(c.encode())].tolist())
            else:
                out.append(self.unk)
        return out

    def encode_long(self, text: str) -> list[int]:
        """The agenda as a heap, for one segment of any length."""
        sym = [self.char_ids.get(c, self.none) for c in text]
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if got := self.pairs.get(sym[i] * self.base + sym[j]):
                heap.append((-got[0], i, sym[i], sym[j], got[1])) if not ready else heapq.heappush(heap, (-got[0], i, sym[i], sym[j], got[1]))

        ready = False
        for i in range(n - 1):
            push(i, i + 1)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been joined meanwhile
            sym[i], sym[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                push(i, nxt[i])
            if prv[i] >= 0:
                push(prv[i], i)
        at = [i for i in range(n) if sym[i] >= 0]
        return self._finish([sym[i] for i in at], [text[i] for i in at])

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment (spaces as the mark): all agendas advance together, one pop each a round."""
        out: list[list[int] | None] = [None] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        lo = 0
        while lo < len(order):
            if len(segments[order[lo]]) > LONG_SEGMENT:
                for i in order[lo:]:
                    out[i] = self.encode_long(segments[i])
                break
            hi = min(lo + 16384, len(order))
            top = min(LONG_SEGMENT, max(8, len(segments[order[lo]]) * 3 // 2))
            while len(segments[order[hi - 1]]) > top:
                hi -= 1
            self._block([segments[i] for i in order[lo:hi]], order[lo:hi], out)
            lo = hi
        return out  # type: ignore[return-value]

    def _block(self, segs: list[str], at: list[int], out: list) -> None:
        n, width = len(segs), max(1, max(map(len, segs)))
        lens = np.array([len(s) for s in segs])
        get = self.char_ids.get
        inside = np.arange(width)[None, :] < lens[:, None]
        # flat arrays of n rows of width + 1 columns; the last column stands for the end
        step = width + 1
        sym = np.full((n, step), -1, np.int32)
        sym[:, :width][inside] = [get(c, self.none) for c in "".join(segs)]
        nxt = np.broadcast_to(np.arange(1, step + 1, dtype=np.int32), (n, step)).copy()
        nxt[nxt >= lens[:, None]] = width
        prv = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, step)).copy()
        score = np.full((n, width), -np.inf, np.float32)
        made = np.full((n, step), -1, np.int32)
        pair = inside.copy()
        pair[:, :-1] &= inside[:, 1:]
        pair[:, -1] = False
        got = self._pair(sym[:, :width][pair], sym[:, 1:][pair])
        score[pair], made[:, :width][pair] = self.score[got], self.made[got]
        sym, nxt, prv, made = sym.ravel(), nxt.ravel(), prv.ravel(), made.ravel()
        rows = np.arange(n)
        while len(rows):
            j = score.argmax(1)
            live = score[np.arange(len(rows)), j] > -np.inf
            if not live.all():
                rows, j, score = rows[live], j[live], score[live]
                if not len(rows):
                    break
            flat = score.ravel()
            own, base = np.arange(len(rows)) * width, rows * step
            bj = base + j
            k = nxt[bj]
            after = nxt[base + k]
            sym[bj] = made[bj]
            sym[base + k] = -1
            flat[own + k] = -np.inf
            nxt[bj] = after
            prv[base + after] = j
            flat[own + j] = -np.inf
            i = np.flatnonzero(after < width)
            got = self._pair(sym[bj[i]], sym[base[i] + after[i]])
            flat[own[i] + j[i]], made[bj[i]] = self.score[got], self.made[got]
            before = prv[bj]
            i = np.flatnonzero(before >= 0)
            left = base[i] + before[i]
            got = self._pair(sym[left], sym[bj[i]])
            flat[own[i] + before[i]], made[left] = self.score[got], self.made[got]
            score = flat.reshape(len(rows), width)
        final = sym.reshape(n, step)
        kept = final >= 0
        ids = final[kept].tolist()
        ends = np.cumsum(kept.sum(1)).tolist()
        plain = (final < len(self.surface)).all(1).tolist()
        lo = 0
        for r, hi in enumerate(ends):
            if plain[r]:
                out[at[r]] = ids[lo:hi]
            else:
                out[at[r]] = self._finish(ids[lo:hi], [segs[r][p] for p in np.flatnonzero(kept[r])])
            lo = hi

    def decode(self, ids: list[str]) -> bytes:
        """UTF-8 text of ids in decimal: pieces' texts, the mark as a space, byte pieces as their bytes; the first space, which encoding put there, goes."""
        text = "".join(map(self.text_of.__getitem__, ids))
        if text[:1] == " ":
            text = text[1:]
        raw = text.encode("utf-8", "surrogateescape")
        if self.odd_bytes:
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = self.sp.decode(list(map(int, ids))).encode()
        return raw


def segment(text: str) -> list[str]:
    """Keys of the text's segments; the segment is the key itself if that starts with a line end, else a space and the key."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[0] == " ":
        return [s if s[0] == "\n" else s[1:] for s in _slow_parts(" " + text)]
    return text.replace("\n", " \n").split(" ")


def _slow_parts(text: str) -> list[str]:
    return _SLOW.findall(text)


class Encoder:
    """Ids of whole texts, from ids of segments that a worker keeps."""

    def __init__(self, path: str, check: bool = True):
        self.model, self.check = PieceModel(path), check
        self.ids: dict[str, str] = {}

    def learn(self, keys: set[str]) -> None:
        if len(self.ids) + len(keys) > CACHE_SEGMENTS:
            self.ids.clear()
        new = [k for k in keys if k not in self.ids]
        full = [(k if k[:1] == "\n" else " " + k).replace(" ", MARK) for k in new]
        got = self.model.encode_segments(full)
        if self.check and full and got != (want := self.model.bare.encode(full, num_threads=1)):
            odd = next(i for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b)
            raise RuntimeError(f"the agenda gives {got[odd]} for {full[odd]!r}, the library {want[odd]}")
        dec, put = self.model.decimal.__getitem__, self.ids
        for k, ids in zip(new, got, strict=True):
            put[k] = " ".join(map(dec, ids))

    def batch(self, texts: list[str]):
        """For each text: its ids in decimal joined by spaces (no end id)."""
        lo = 0
        while lo < len(texts):
            size, hi = 0, lo
            while hi < len(texts) and (hi == lo or size < 4_000_000):
                size += len(texts[hi])
                hi += 1
            parts = [segment(t) for t in texts[lo:hi]]
            known, need = self.ids, set()
            for p in parts:
                need.update(p)
            need.difference_update(known)
            if need:
                if len(known) + len(need) > CACHE_SEGMENTS:
                    need.update(*parts)
                self.learn(need)
            ids = self.ids.__getitem__
            for p in parts:
                yield " ".join(map(ids, p))
            lo = hi


_encoders: dict[tuple[str, bool], Encoder] = K.kept("sentencepieces")


def encoder(path: str, check: bool = True) -> Encoder:
    """One for each worker and vocabulary file."""
    if (path, check) not in _encoders:
        _encoders[path, check] = Encoder(path, check)
    return _encoders[path, check]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


def encode(docs: DataFrame, model_path: str, *, end_id: bool = True, digests_only: bool = False, check: bool = True) -> DataFrame:
    """Ids and decoded text of every whole text.

    Null text: as an empty one (only the end id). Very long texts are encoded
    whole, like others. Null ids stay; repeated rows give repeated rows; an empty
    table gives none; other columns of docs are not looked at. digests_only leaves out the
    ids and the text themselves. The library's end id must exist if end_id.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(model_path, check)
        end = enc.model.sp.eos_id()
        texts = b.column(1).fill_null("").to_pylist()
        n, h, dh, ids_out, text_out = [], [], [], [], []
        for ids in enc.batch(texts):
            if end_id:
                ids = f"{ids} {end}" if ids else str(end)
            each = ids.split(" ") if ids else []
            text = enc.model.decode(each)
            n.append(len(each))
            h.append(hashlib.sha256(ids.encode()).hexdigest())
            dh.append(hashlib.sha256(text).hexdigest())
            if not digests_only:
                ids_out.append(list(map(int, each)))
                text_out.append(text.decode())
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array(h), pa.array(dh)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if not digests_only:
            cols += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out)]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    schema = SCHEMA if not digests_only else SCHEMA.split(", ids array")[0]
    return keyed(docs).mapInArrow(per_batch(run, "sentencepieces"), schema)
