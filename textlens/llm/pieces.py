"""SentencePiece BPE encoding and decoding by suffix-array matching.

A text falls into units (mostly a word with the space mark before it), cut only where
no piece crosses. The units of a batch
that weren't met before are concatenated and indexed by a suffix array; every piece
is binary-searched for its range of occurrences; the occurrences are edges, sorted
by where they end; and edges are relaxed from left to right: of the pieces that end
at a place, the one that merging would leave there is the one whose neighbour to the
left is compatible with it. Two neighbours are compatible when, replaying their
merges in rank order, no merge across their border ever comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

SPACE = "\u2581"
_NONE = -2
#: Bytes of text taken at once, units solved at once, and units and pairs that a worker remembers.
SIZE, SOLVED, UNITS, PAIRS = 1_000_000, 15_000, 250_000, 1_000_000
_FAR = np.int64(2**40)


def read_model(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, kind one of normal, byte and other."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "normal"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


class _Codes(dict):
    """Numbers texts as they come."""

    def __missing__(self, text: str) -> int:
        code = self[text] = len(self)
        return code


class Codec:
    """Encoder and decoder; plain tables, so the driver builds it and executors receive it."""

    def __init__(self, model: list[tuple[str, float, str]]):
        normal = [(i, p, s) for i, (p, s, k) in enumerate(model) if k == "normal"]
        runs = {p: (i, s) for i, p, s in normal if len(p) > 1 and not p.strip(SPACE)}
        words = [(i, p, s) for i, p, s in normal if p not in runs]
        if any(SPACE in p[1:] for _, p, _ in words) or runs and max(s for _, s in runs.values()) >= min((s for _, p, s in words if len(p) > 1), default=0):
            raise ValueError("pieces that cross words, or runs of spaces that merge before words, aren't supported")
        self.byte = [next(i for i, (p, _, k) in enumerate(model) if k == "byte" and p == f"<0x{b:02X}>") for b in range(256)]
        self.text = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "normal" else b"" for p, _, k in model]
        self.ids = {p: i for i, p, _ in normal}
        self.run = [(i, p) for p, (i, _) in runs.items()]
        order = sorted(words, key=lambda w: (-w[2], w[0]))
        self.pieces = [p for _, p, _ in order]  # by rank
        self.rank = {p: r for r, p in enumerate(self.pieces)}
        self.id_of = np.array([i for i, _, _ in order] + [-1], np.int64)
        self.length = np.array([len(p) for p in self.pieces] + [1], np.int32)
        # ASCII marks that no piece has after a Latin letter: no merge crosses that border
        after = {b for p in self.pieces for a, b in zip(p, p[1:], strict=False) if a.isalpha() and a < "\u0250"}
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalpha() and c not in after)
        self.unit = re.compile(f"{SPACE}*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?=[{SPACE}\n{marks}]|$)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self._tables()
        self._forget()
        self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces that merging leaves of a text, and the last pair merged."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = min(((self.rank.get(a + b, len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == len(self.rank):
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [self.pieces[best]]
        return parts, last

    def _tables(self) -> None:
        n = len(self.pieces)
        left, right = np.full(n, -1), np.full(n, -1)
        self.reached = np.ones(n, bool)
        for r, p in enumerate(self.pieces):
            if len(p) > 1:
                parts, last = self.merge(p)
                self.reached[r] = len(parts) == 1
                if len(parts) == 1:
                    left[r], right[r] = self.rank.get(last[0], -1), self.rank.get(last[1], -1)
        # how a piece's first (last) part grows to the whole piece, as ranks from small to large
        depth = 1 + max(map(len, self.pieces))

        def spine(part: np.ndarray) -> np.ndarray:
            out = np.full((n + 1, depth + 1), _FAR)
            for r in range(n):
                chain, x = [r], r
                while part[x] >= 0:
                    x = int(part[x])
                    chain.append(x)
                out[r, : len(chain)] = chain[::-1]
            out[n, 0] = n
            return out

        self.heads, self.tails = spine(left), spine(right)
        pairs = sorted((self.rank[p[:i]] * (n + 1) + self.rank[p[i:]], r) for r, p in enumerate(self.pieces) for i in range(1, len(p)) if p[:i] in self.rank and p[i:] in self.rank)
        self.pair = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.joined = np.array([r for _, r in pairs] or [0], np.int64)
        # characters as small numbers: 0 between units, 1 for those without a piece
        self.alphabet = {c: i + 2 for i, c in enumerate(sorted({c for p in self.pieces for c in p}))}
        if len(self.alphabet) > 65_000:
            raise ValueError("more than 65,000 characters in the pieces")
        self.lut = np.ones(0x110000, np.uint16)
        self.lut[[ord(c) for c in self.alphabet]] = list(self.alphabet.values())
        self.lut[0] = 0
        own = np.flatnonzero(self.reached).astype(np.int32)
        self.width = -(-int(self.length[:n].max()) // 4)
        low, high = np.zeros((len(own), self.width * 4), np.uint16), np.full((len(own), self.width * 4), 0xFFFF, np.uint16)
        for k, r in enumerate(own):
            low[k, : self.length[r]] = high[k, : self.length[r]] = [self.alphabet[c] for c in self.pieces[r]]
        self.own, self.low, self.high = own, self._packed(low), self._packed(high)

    def _packed(self, x: np.ndarray) -> np.ndarray:
        """Four 16-bit characters a word, so that words compare like texts."""
        x = x.reshape(len(x), -1, 4).astype(np.uint64)
        return (x[:, :, 0] << np.uint64(48)) | (x[:, :, 1] << np.uint64(32)) | (x[:, :, 2] << np.uint64(16)) | x[:, :, 3]

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging leaves x and y as neighbours."""
        n = len(self.pieces)
        codes, back = np.unique(x.astype(np.int64) * (n + 1) + y, return_inverse=True)
        at = np.searchsorted(self.known, codes)
        new = (at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != codes) if len(self.known) else np.ones(len(codes), bool)
        if new.any():
            fresh = codes[new]
            ok = self._replayed(fresh // (n + 1), fresh % (n + 1))
            if len(self.known) > PAIRS:
                self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)
                new[:] = True
                fresh, ok = codes, self._replayed(codes // (n + 1), codes % (n + 1))
            merged = np.concatenate([self.known, fresh])
            order = np.argsort(merged, kind="stable")
            self.known, self.fits = merged[order], np.concatenate([self.fits, ok])[order]
            at = np.searchsorted(self.known, codes)
        return self.fits[at][back]

    def _replayed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = len(self.pieces)
        ok = np.ones(len(x), bool)
        i, j = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            a, b = self.tails[x[live], i[live]], self.heads[y[live], j[live]]
            code = a * (n + 1) + b
            at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
            across = np.where(self.pair[at] == code, self.joined[at], _FAR)
            next_x, next_y = self.tails[x[live], i[live] + 1], self.heads[y[live], j[live] + 1]
            wrong = (across < next_x) & (across <= next_y) & (across < _FAR)
            ok[live[wrong]] = False
            goes_on = ~wrong & ((next_x < _FAR) | (next_y < _FAR))
            first = next_x <= next_y
            i[live] += first
            j[live] += ~first
            live = live[goes_on]
        return ok

    def _occurrences(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, rank) of every piece in x, by suffix array and binary search."""
        padded = np.concatenate([x, np.zeros(self.width * 4, np.uint16)])
        words = self._packed(np.lib.stride_tricks.sliding_window_view(padded, self.width * 4)[: len(x)])
        suffixes = np.lexsort(words.T[::-1])
        words = words[suffixes]

        def bound(target: np.ndarray, after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(target), np.int64), np.full(len(target), len(words))
            while (open_ := lo < hi).any():
                mid = np.minimum((lo + hi) // 2, len(words) - 1)
                less, equal = np.zeros(len(target), bool), np.ones(len(target), bool)
                for w in range(self.width):
                    here = words[mid, w]
                    less |= equal & (here < target[:, w])
                    equal &= here == target[:, w]
                goes = less | (equal & after)
                lo, hi = np.where(open_ & goes, mid + 1, lo), np.where(open_ & ~goes, mid, hi)
            return lo

        start, end = bound(self.low, False), bound(self.high, True)
        count = end - start
        rank = np.repeat(self.own, count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return suffixes[np.repeat(start, count) + within].astype(np.int32), rank.astype(np.int32)

    def _solve(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units, none of which holds a run of spaces or is one."""
        joined = np.frombuffer(("\0" + "\0".join(u.replace("\0", "\ufffe\ufffe") for u in units) + "\0").encode("utf-32-le", "replace"), np.uint32)
        x = self.lut[np.minimum(joined, 0x10FFFF)]
        borders = np.flatnonzero(joined == 0)
        begin, end = borders[:-1] + 1, borders[1:]
        home = np.zeros(len(x) + 1, np.int32)
        home[begin] = begin
        home = np.maximum.accumulate(home)
        start, rank = self._occurrences(x)
        stray = np.flatnonzero(x == 1).astype(np.int32)
        start = np.concatenate([start, stray])
        rank = np.concatenate([rank, np.full(len(stray), len(self.pieces), np.int32)])
        stop = start + self.length[rank]
        step = stop - home[start]
        order = np.argsort(step, kind="stable")
        start, rank, stop, step = start[order], rank[order], stop[order], step[order]
        last = np.full(len(x) + 1, _NONE, np.int32)
        cuts = np.flatnonzero(np.diff(step)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(step)], strict=True):
            if lo == hi:
                continue
            s, r, e = start[lo:hi], rank[lo:hi], stop[lo:hi]
            at_begin = s == home[s]
            last[e[at_begin]] = r[at_begin]
            s, r, e = s[~at_begin], r[~at_begin], e[~at_begin]
            before = last[s]
            some = before >= 0
            s, r, e, before = s[some], r[some], e[some], before[some]
            if len(s):
                fits = self.compatible(before, r)
                last[e[fits]] = r[fits]
        # read the chosen pieces backwards, all units at once
        where, place = np.arange(len(units)), end.copy()
        unit, piece = [], []
        while len(where):
            r = last[place]
            good = r >= 0
            unit.append(where)
            piece.append(np.where(good, r, _NONE))
            place = place - np.where(good, self.length[np.maximum(r, 0)], 1)
            more = good & (place > begin[where])
            where, place = where[more], place[more]
        unit, piece = np.concatenate(unit)[::-1], np.concatenate(piece)[::-1]
        order = np.argsort(unit, kind="stable")
        unit, piece = unit[order], piece[order]
        edges = np.searchsorted(unit, np.arange(len(units) + 1))
        odd = np.zeros(len(units), bool)
        odd[unit[(piece == _NONE) | (piece == len(self.pieces))]] = True
        ids = self.id_of[piece].astype(np.int32)
        out = {}
        for k, u in enumerate(units):
            lo, hi = edges[k], edges[k + 1]
            out[u] = self._spelled(u, piece[lo:hi]) if odd[k] else ids[lo:hi].tobytes()
        return out

    def _spelled(self, unit: str, ranks: np.ndarray) -> bytes:
        """Ids where characters without a piece become bytes."""
        if (ranks == _NONE).any():
            parts = self.merge(unit)[0]
        else:
            parts, at = [], 0
            for r in ranks:
                parts.append(unit[at : at + self.length[r]])
                at += self.length[r]
        ids: list[int] = []
        for p in parts:
            ids.extend([self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode("utf-8", "replace")])
        return np.array(ids, np.int32).tobytes()

    def _run(self, n: int) -> bytes:
        """Ids of n spaces. All their merges rank alike, so the leftmost possible one comes first."""
        sizes = {len(p): i for i, p in self.run} | {1: self.ids.get(SPACE, -1)}
        left: list[int] = []
        for _ in range(n):
            left.append(1)
            while len(left) > 1 and left[-2] + left[-1] in sizes:
                left[-2:] = [left[-2] + left[-1]]
        return np.array([sizes[k] for k in left], np.int32).tobytes()

    def _forget(self) -> None:
        self.units = _Codes()
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.units) > UNITS:
            self._forget()
        coded = []
        for t in texts:
            units = self.unit.findall((SPACE + t).replace(" ", SPACE)) if t else []
            coded.append(np.fromiter(map(self.units.__getitem__, units), np.int64, len(units)))
        new = list(self.units)[len(self.size) :]
        if new:
            plain = sorted({u if u[:2] != SPACE * 2 else SPACE + u.lstrip(SPACE) for u in new if u.strip(SPACE)})
            found: dict[str, bytes] = {}
            for lo in range(0, len(plain), SOLVED):  # units don't depend on each other
                found |= self._solve(plain[lo : lo + SOLVED])
            ids = [found[u] if u in found else self._spaced(u, found) for u in new]
            size = np.array([len(x) // 4 for x in ids], np.int64)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.int32)])
        codes = np.concatenate(coded) if coded else np.empty(0, np.int64)
        size = self.size[codes]
        ends = np.cumsum(size)
        tokens = self.flat[np.repeat(self.start[codes] - ends + size, size) + np.arange(size.sum())]
        at = np.concatenate([[0], ends])[np.cumsum([0] + [len(c) for c in coded])]
        return [tokens[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _spaced(self, unit: str, found: dict[str, bytes]) -> bytes:
        """Ids of a run of spaces and what follows it."""
        body = unit.lstrip(SPACE)
        if not body:
            return self._run(len(unit))
        ids, spaces = found[SPACE + body], len(unit) - len(body)
        alone = int.from_bytes(ids[:4], "little") == self.ids.get(SPACE, -1)
        return self._run(spaces) + ids[4:] if alone else self._run(spaces - 1) + ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, as do unknown ids nothing."""
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode_texts(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, round_trip) of every row.

    ids are the model's, with a space mark before the text and bytes for characters
    without a piece; round_trip says that decoding them gives the text back (it does
    for any text without U+2581, which stands for a space in the model). A null text
    has null ids, 0 tokens and round_trip true; an empty one has no ids. Repeated rows
    are rows; other columns aren't read. Memory is bounded by a slice of ``SIZE``
    bytes or one text, and by the remembered units.
    """
    codec = Codec(read_model(model_path))
    shared = docs.sparkSession.sparkContext.broadcast(codec)  # the tables of one vocabulary: a few MB
    source = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), SIZE):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                ids = codec.encode(texts)
                back = [t is None or codec.decode(x) == t for t, x in zip(texts, ids, strict=True)]
                lengths = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lengths), lists, pa.array(back)], [key, "n_tokens", "ids", "round_trip"])

    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the decoded text as ``decoded`` (null ids: null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Codec(read_model(model_path)))

    @F.pandas_udf("string")
    def back(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.decode(np.asarray(x)) for x in batch])

    return encoded.withColumn("decoded", back(F.col(ids)))
