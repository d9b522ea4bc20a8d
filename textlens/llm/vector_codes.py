"""Vector compression into product codes over integers, by partial-distance search.

A component x becomes floor(scale * x). Vectors are cut into equal parts; each part's
codebook starts as that part of the smallest keys and is refined in rounds: parts go to
their nearest entry, entries become the componentwise floor of their parts' mean.
Everything is whole numbers, so results don't depend on how rows are dealt out.

The nearest entry is found by partial distances: components are added in descending
variance of the codebook, and an entry is dropped as soon as its sum strictly exceeds
the best complete distance so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sizes

#: Integers beyond this aren't coded; below it sums of 2^38 rows and distances of 2^13 components fit 64 bits.
MOST = 2**24
#: Vectors that are compared with a codebook at once.
BLOCK = 512


@dataclass
class Codebooks:
    """``books[p]`` has a row for each entry of part p; all vectors have ``length`` components."""

    books: list[np.ndarray]
    length: int
    scale: int

    def sha256(self) -> str:
        """Of all components as decimal numbers, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(c) for b in self.books for c in b.ravel().tolist()).encode()).hexdigest()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each row of x; ties go to the lower entry."""
    entry, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    span = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.int32 if 4 * span * span * x.shape[1] < 2**31 else np.int64
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    book = np.ascontiguousarray(book[:, order].T, kind)
    for lo in range(0, len(x), BLOCK):
        entry[lo : lo + BLOCK], error[lo : lo + BLOCK] = _nearest(np.ascontiguousarray(x[lo : lo + BLOCK, order].T, kind), book)
    return entry, error


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components are rows, in the order in which they are added."""
    width, n = x.shape
    head = max(1, width // 2)
    partial = np.zeros((n, book.shape[1]), x.dtype)
    for d in range(head):
        partial += np.square(x[d][:, None] - book[d])
    every = np.arange(n)
    # the first complete distance: of the entry that is best so far
    guess = partial.argmin(1)
    best = partial[every, guess] + np.square(x[head:] - book[head:, guess]).sum(0, dtype=x.dtype)
    row, entry = np.nonzero(partial <= best[:, None])
    sums = partial[row, entry]
    for d in range(head, width):
        sums += np.square(x[d][row] - book[d][entry])
        live = sums <= best[row]
        row, entry, sums = row[live], entry[live], sums[live]
        if d == (head + width) // 2:  # every row still has an entry: its best one is completed, and bounds the others
            first = np.searchsorted(row, every)
            least = np.flatnonzero(sums == np.minimum.reduceat(sums, first)[row])
            least = least[np.searchsorted(row[least], every)]
            best = np.minimum(best, sums[least] + np.square(x[d + 1 :] - book[d + 1 :, entry[least]]).sum(0, dtype=x.dtype))
    first = np.searchsorted(row, every)
    least = np.flatnonzero(sums == np.minimum.reduceat(sums, first)[row])
    least = least[np.searchsorted(row[least], every)]  # entries of a row ascend, so the first is the lowest
    return entry[least], sums[least]


def _integers(column: pa.Array, parts: int, scale: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Rows that are kept, and (length, rows, integers) of those that can be coded."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    kept, coded = [np.flatnonzero(lengths == 0)], []
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        x = flat[starts[rows][:, None] + np.arange(length)]
        good = np.isfinite(x).all(1)
        rows, x = rows[good], x[good]
        kept.append(rows)
        if length % parts == 0:
            fits = (np.abs(x) <= MOST / scale).all(1)
            coded.append((int(length), rows[fits], np.floor(scale * x[fits]).astype(np.int64)))
    return np.sort(np.concatenate(kept)), coded


def _source(vectors: DataFrame, columns: list[str], vector: str) -> DataFrame:
    single = dict(vectors.dtypes)[vector] == "array<float>"
    return vectors.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{vector}`").cast("array<float>" if single else "array<double>").alias("_vector"))


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> Codebooks:
    """Codebooks of all vectors that can be coded (see ``compress``).

    A round is one scan: every task adds up its own vectors, the sums are merged by
    part and entry, and parts x entries rows reach the driver, whatever the table holds.
    The scans read key and vector alone and nothing is written; an input that gives
    other rows each time it is read has to be written down first.
    """
    source = _source(vectors, [key], vector)
    kinds = dict(source.dtypes)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, q in _integers(batch.column(1), parts, scale)[1]:
                values = pa.array([v.tobytes() for v in q.astype(">i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), length, np.int32)), values], ["k", "length", "q"])

    usable = source.mapInArrow(parsed, f"k {kinds[key]}, length int, q binary")
    found = usable.groupBy("length").count().orderBy(F.desc("count"), "length").limit(1).collect()
    if not found:
        return Codebooks([np.empty((0, 0), np.int64)] * parts, 0, scale)
    length = found[0]["length"]
    width = length // parts
    first = usable.where(F.col("length") == length).orderBy(F.col("k").asc_nulls_last(), "q").limit(entries).select("q").collect()
    start = np.stack([np.frombuffer(r["q"], ">i4") for r in first]).astype(np.int64)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        totals = _sums(source.select("_vector"), books, length, scale).collect()
        books = [b.copy() for b in books]
        for r in totals:
            books[r["part"]][r["entry"]] = np.array(r[3:], np.int64) // r["n"]  # floors, below zero too
    return Codebooks(books, length, scale)


def _sums(source: DataFrame, books: list[np.ndarray], length: int, scale: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): sums of the parts that are nearest to each used entry."""
    parts, size, width = len(books), len(books[0]), length // len(books)
    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            for own, _, q in _integers(batch.column(0), parts, scale)[1]:
                for p in range(parts) if own == length else ():
                    x = q[:, p * width : (p + 1) * width]
                    entry, _ = nearest(x, books[p])
                    counts[p] += np.bincount(entry, minlength=size)
                    order = np.argsort(entry, kind="stable")
                    used, at = np.unique(entry[order], return_index=True)
                    if len(used):
                        sums[p][used] += np.add.reduceat(x[order], at)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), *[pa.array(sums[part, entry, i]) for i in range(width)]], names)

    found = source.mapInArrow(run, "part int, entry int, " + ", ".join(f"{c} long" for c in names[2:]))
    return found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])


def encode(vectors: DataFrame, codebooks: Codebooks, keep: list[str], vector: str = "embedding") -> DataFrame:
    """``keep``, code and error of every kept row (see ``compress``): one pass, no exchange."""
    source = _source(vectors, keep, vector)
    kinds, length, books = dict(source.dtypes), codebooks.length, codebooks.books
    parts, scale = len(books), codebooks.scale
    own = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, coded = _integers(batch.column(len(keep)), parts, scale)
            text, error = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64)
            for n, rows, q in coded:
                if n != length or not len(rows):
                    continue
                w, codes = length // parts, np.empty((len(rows), parts), np.uint8)
                for p in range(parts):
                    codes[:, p], far = nearest(q[:, p * w : (p + 1) * w], books[p])
                    error[rows] += far
                text[rows] = [c.tobytes().hex() for c in codes]
            at = pa.array(kept)
            missing = np.array([t is None for t in text[kept]], bool)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keep))], pa.array(text[kept].tolist(), pa.string()), pa.array(error[kept], mask=missing)], [*own, "_code", "_error"])

    schema = ", ".join([*[f"{o} {kinds[c]}" for o, c in zip(own, keep, strict=True)], "_code string, _error long"])
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, keep, strict=True)], F.col("_code").alias("code"), F.col("_error").alias("error"))


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Key, code, error, label_error and codebooks_sha256 of every row that is kept.

    Rows whose vector is null or holds null or non-finite components are dropped. Vectors
    can be coded if they have the commonest length that ``parts`` divides (ties: the
    shorter one) and components within +-2^24 / scale; the others stay with null code and
    error, and teach nothing. A code has two hex digits for each part's entry, at most
    256. Repeated keys are rows of their own; null keys start no codebook before all
    others do. Ties between equal keys go by their components. label_error sums the
    errors of equal labels, null ones together, salted by their measured number; null
    where it is beyond 64 bits. An empty table gives no row; no other column is read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    codebooks = fit(vectors, parts, entries, rounds, scale, key, vector)
    coded = encode(vectors, codebooks, [key, label], vector)
    named = coded.select(F.col(f"`{key}`").alias("k"), "code", "error", F.col(f"`{label}`").isNull().alias("none"), F.coalesce(F.col(f"`{label}`").cast("string"), F.lit("")).alias("label"))
    sums = named.groupBy("none", "label").agg(F.expr("try_sum(error)").alias("label_error"), F.count(F.lit(1)).alias("size"))
    total = vectors.select(F.lit(1)).count()
    out = join_sizes(named, sums, ["none", "label"], total, spread="k")
    return out.select(F.col("k").alias(key), "code", "error", "label_error", F.lit(codebooks.sha256()).alias("codebooks_sha256"))
