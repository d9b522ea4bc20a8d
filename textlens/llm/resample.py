"""Importance resampling of documents towards a target's distribution of hashed word runs.

Every task keeps a trie of the word runs it meets: an edge is a word, a node is a run
and holds its count and the CRC state of its bytes, so the CRC of a longer run goes on
from its parent's. Counts are merged by bucket (a run's CRC modulo the number of
buckets); the logarithm of target share over corpus share is a bucket's gain. Documents
are scored by walking the same tries with the gains attached, and drawn without
replacement by adding Gumbel noise that depends on their key alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut

#: Nodes that a task's trie may have before it is emptied into its bucket totals.
NODES = 300_000
#: Bytes of a text whose words are held at once.
SLICE = 1_000_000

#: Bytes as they count: letters A to Z in lower case, digits, a to z and all beyond ASCII as they are, the rest as spaces.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size."""
    text = text.translate(_BYTES)
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + SLICE)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


class Trie:
    """Runs of 1 to ``order`` words; level 1 is keyed by word, deeper ones by (parent, word)."""

    def __init__(self, order: int, buckets: int, gains: np.ndarray | None = None):
        self.order, self.buckets, self.gains = order, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.levels: list[dict] = [{} for _ in range(self.order)]
        self.crc: list[int] = []
        self.value: list[int] = []  # counts, or gains where there are any

    def _grow(self, level: int, key) -> int:
        """A new node; its CRC goes on from its parent's state."""
        crc = zlib.crc32(key) if level == 0 else zlib.crc32(b" " + key[1], self.crc[key[0]])
        node = self.levels[level][key] = len(self.crc)
        self.crc.append(crc)
        self.value.append(0 if self.gains is None else int(self.gains[crc % self.buckets]))
        return node

    def full(self) -> bool:
        return len(self.crc) > NODES

    def walk(self, text: bytes) -> Iterator[tuple[list[int], int]]:
        """(nodes of the runs that end in a piece of the text, words of that piece); between pieces the trie may be emptied."""
        tail: list[bytes] = []  # the last words of the piece before
        for piece in words(text):
            run, nodes, below = tail + piece, [], []
            for level in range(self.order):
                keys = run if level == 0 else list(zip(below, run[level:], strict=False))
                get, grow = self.levels[level].get, self._grow
                below = [n if (n := get(k)) is not None else grow(level, k) for k in keys]
                nodes += below[max(0, len(tail) - level) :]
            yield nodes, len(piece)
            tail = run[max(0, len(run) - self.order + 1) :]

    def count(self, text: bytes, totals: np.ndarray) -> None:
        for nodes, _ in self.walk(text):
            value = self.value
            for n in nodes:
                value[n] += 1
            if self.full():
                self.flush(totals)

    def flush(self, totals: np.ndarray) -> None:
        """Adds the counts to the bucket totals and empties the trie."""
        if self.crc:
            np.add.at(totals, np.array(self.crc, np.int64) % self.buckets, np.array(self.value, np.int64))
        self.clear()

    def score(self, text: bytes) -> tuple[int, int, int]:
        """(words, runs, sum of the gains of all runs)."""
        n, runs, weight = 0, 0, 0
        for nodes, size in self.walk(text):
            n, runs = n + size, runs + len(nodes)
            weight += sum(map(self.value.__getitem__, nodes))
            if self.full():
                self.clear()
        return n, runs, weight


def _texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; none for null."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else []
    data = column.buffers()[2] if len(column) else None
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
    view = memoryview(data) if data is not None else memoryview(b"")
    for i in range(len(column)):
        yield bytes(view[offsets[i] : offsets[i + 1]]) if valid[i] else b""


def bucket_counts(docs: DataFrame, text: str = "text", order: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many word runs of all texts fall into each bucket; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(order, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in _texts(batch.column(0)):
                trie.count(t, totals)
        trie.flush(totals)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], ["bucket", "n"])

    found = docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(buckets, np.int64)
    totals[[r["bucket"] for r in found]] = [r["n"] for r in found]
    return totals


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over corpus share, with one run more in each bucket."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    order: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (the key alone unless given), n_features, weight, score and rank of every document.

    Of the documents with ``min_words`` words at least, ``percent`` in a hundred are drawn
    (rounded down): those of the highest scores, ties to the smaller key. rank numbers
    them from 1; it is null for all others. Null texts have no words, as have empty ones:
    weight 0. Null keys are hashed as ``null`` and come last among ties. Repeated rows
    are drawn each on its own. An empty table gives no row, an empty target gives gains
    all the same. Columns of ``keep`` that are called like an own one give way to it.

    Two passes over the texts: counts, then scores, which are written once. Ranks come
    from a range exchange of the rows above a bound that lies safely under the last one
    drawn, so about a tenth of the rows is exchanged and no task numbers them all.
    """
    gains = bucket_gains(bucket_counts(docs, text, order, buckets), bucket_counts(target, text, order, buckets))
    keep = [key] if keep is None else keep
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([key, *keep])]).alias("r"), F.col(f"`{text}`").alias("t"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(order, buckets, gains)
        for batch in batches:
            found = np.array([trie.score(t) for t in _texts(batch.column(1))], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i]) for i in range(3)]], ["r", "words", "runs", "weight"])

    schema = StructType([source.schema["r"], *[StructField(c, LongType()) for c in ("words", "runs", "weight")]])
    rows = source.mapInArrow(scored, schema)
    rows = cut(rows.withColumn("score", F.col("weight") + noise(F.col("r").getField(key), seed)))

    able = F.col("words") >= min_words
    bound = rows.where(able).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", max(0.0, 1 - percent / 100 - 0.01), 10_000).alias("low")).collect()[0]
    draw = percent * bound["n"] // 100
    low = F.lit(bound["low"])
    high = able & (F.col("score") >= low) if draw else F.lit(False)
    if draw and rows.where(high).count() < draw:  # the bound is approximate
        high = able
    ranked = _ranked(rows.where(high), key)
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    out = drawn.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("long")))
    own = ("n_features", "weight", "score", "rank")
    kept = [F.col("r").getField(c).alias(c) for c in keep if c not in own]
    return out.select(*kept, F.col("runs").alias("n_features"), "weight", "score", "rank")


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with rank, from 1, by score downwards and key."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.col("_key").asc_nulls_last(), F.col("_nth")]  # equal rows part by their place
    dealt = rows.withColumn("_key", F.col("r").getField(key)).withColumn("_nth", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_key", "_nth")
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(2**33 - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition of the exchange: bounded by that setting, not by the data
    offsets = sizes.withColumn("_before", F.expr("sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")).drop("_n")
    found = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return found.withColumn("rank", place + 1 + F.coalesce("_before", F.lit(0))).drop("_part", "_at", "_before")
