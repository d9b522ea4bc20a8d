"""Benchmark decontamination by size-partitioned MinHash containment search.

Native: DataFrame functions only. A test item of n shingles is contained in a
document when at least ``threshold`` of its shingles occur there. Items are
partitioned by size; in each partition an item is described by its r smallest
shingle hashes (a bottom-r MinHash sketch) and a document is a candidate when it
holds one of them. An item that qualifies lacks at most floor((1 - t) n) shingles,
so r = floor((1 - t) n) + 1 finds every one; r depends on the partition's upper
size only, and stays at ``SKETCH`` for sizes where the chance of missing all of
them, (1 - t)^r, is below 1e-8. Candidates are verified with the shingles themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, exploded

#: Largest sketch: (1 - 0.8) ** 12 = 4e-9.
SKETCH = 12
#: Index entries (16 bytes each) that are broadcast; beyond it the join shuffles by hash.
BROADCAST_ROWS = 400_000
#: Candidate document keys (8 bytes each) that are broadcast; beyond it texts are shuffled.
BROADCAST_KEYS = 1_000_000
WIDTH = 5


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _starts(w: Column, width: int | Column = WIDTH) -> Column:
    return F.when((F.size(w) >= width) & (F.size(w) > 0), F.sequence(F.lit(1), F.size(w) - (width - 1))).otherwise(F.array().cast("array<int>"))


def shingles(w: Column, width: int | Column = WIDTH) -> Column:
    return F.array_distinct(F.transform(_starts(w, width), lambda i: F.array_join(F.slice(w, i, width), " ")))


def short_widths(items: DataFrame) -> list[int]:
    """Word counts, under WIDTH, of the items that are one shingle of their own width."""
    n = F.size(words(F.col("text")))
    return sorted(r["n"] for r in items.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < WIDTH)).distinct().collect())


def _sketch_size(n: Column, threshold: float) -> Column:
    """r for the partition of n: sizes up to 2^k share a partition."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))
    exact = F.floor(upper * F.lit(1 - threshold) + F.lit(1e-9)) + 1
    most = max(1, math.ceil(math.log(1e-8) / math.log(max(1e-6, 1 - threshold)))) if threshold < 1 else 1
    return F.least(exact, F.lit(most)).cast("int")


def _with_words(df: DataFrame, key: str) -> DataFrame:
    """Words as a column of their own: inside a lambda an expression would be
    evaluated again for every element."""
    return df.select(key, words(F.col("text")).alias("_w"))


def _spelled(df: DataFrame, key: str, widths: list[int]) -> DataFrame:
    return exploded(_with_words(df, key), [key], F.concat(*[shingles(F.col("_w"), k) for k in [*widths, WIDTH]]), "s")


def _item_shingles(items: DataFrame, key: str) -> DataFrame:
    """An item under WIDTH words is one shingle."""
    w = F.col("_w")
    return exploded(_with_words(items, key), [key], F.when(F.size(w) < WIDTH, F.filter(F.array(F.array_join(w, " ")), lambda s: s != "")).otherwise(shingles(w)), "s")


def _hashed(df: DataFrame, key: str, widths: list[int], words_column: str | None = None, outputs: tuple[str, ...] = ()) -> DataFrame:
    """(key, h): a hash for each five words, built from hashes of one, two and four,
    and for each run of ``widths`` words; with ``words_column`` for the whole row only.

    Every step hashes two neighbours of the array before, which costs a third of
    hashing five strings for each place.
    """

    def joined(x: str, y: str, shift: int, left: int) -> Column:
        length = F.greatest(F.size(x) - left, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), length), F.slice(y, F.lit(1 + shift), length), lambda a, b: F.xxhash64(a, b)).alias("_next")

    keep = [key, *outputs]
    df = (df if words_column else _with_words(df, key)).select(*keep, F.transform(words_column or "_w", lambda x: F.xxhash64(x)).alias("_1"))
    df = df.select(*keep, "_1", joined("_1", "_1", 1, 1)).withColumnRenamed("_next", "_2")
    df = df.select(*keep, "_1", "_2", joined("_2", "_2", 2, 2)).withColumnRenamed("_next", "_4")
    if 3 in widths:
        df = df.select("*", joined("_2", "_1", 2, 1)).withColumnRenamed("_next", "_3")
    df = df.select(*keep, *[f"_{k}" for k in sorted({1, *widths})], joined("_4", "_1", 4, 1))
    runs = {k: F.col(f"_{k}") for k in widths}
    if words_column:
        runs = {k: F.when(F.size("_1") == k, h).otherwise(F.array().cast("array<bigint>")) for k, h in runs.items()}
    else:
        runs = {k: F.array_distinct(h) for k, h in runs.items()}
    return exploded(df, keep, F.concat(*runs.values(), F.col("_next")) if runs else F.col("_next"), "h")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    key: str = "doc_id",
    item_key: str = "item_id",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item found in a document.

    Words are lower-case runs of letters and digits, shingles five words, sets of
    them: repetition does not count. An item under five words is one shingle of its
    own width, sought in documents of any length. Texts without words match nothing;
    so do rows with null keys. Rows that repeat a key count as one text, the union.
    Only keys and texts are read.
    """
    named_items = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item_id"), "text")
    widths = short_widths(named_items)
    item_sets = _item_shingles(named_items, "item_id").distinct()
    item_sets = item_sets.withColumn("n_item", F.count(F.lit(1)).over(_by_item()))
    ranked = _hashed(item_sets.withColumn("w", F.split("s", " ")), "item_id", widths, "w", ("n_item",))
    ranked = ranked.withColumn("rank", F.row_number().over(_by_item().orderBy("h")))
    index = ranked.where(F.col("rank") <= _sketch_size(F.col("n_item"), threshold)).select("h", "item_id")
    small = ranked.limit(broadcast_rows + 1).count() <= broadcast_rows

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    keyed = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), "text")
    probes = _hashed(keyed, "doc_id", widths)
    candidates = cut(probes.join(sized(index), "h").select("doc_id", "item_id").distinct())
    # exact step: only the candidates' documents, with the shingles spelled out
    named = cut(candidates.select("doc_id").distinct())
    named = F.broadcast(named) if named.count() <= BROADCAST_KEYS else named
    held = keyed.join(named, "doc_id", "left_semi")
    spelled = _spelled(held, "doc_id", widths)
    # a document's repeats of a shingle meet in the distinct count
    shared = spelled.join(sized(item_sets), "s").join(candidates, ["doc_id", "item_id"], "left_semi")
    found = shared.groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("n_shared"), F.max("n_item").alias("n_item"))
    return (
        found.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - F.lit(1e-9))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .withColumnsRenamed({"doc_id": key, "item_id": item_key})
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """``docs`` without those that contain a test item; all their columns stay, whatever their names.

    Null texts and rows with a null key contain none; rows that repeat a key go together.
    """
    found = contained_items(docs, items, threshold, key)
    gone = found.select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def _by_item():
    from pyspark.sql import Window

    return Window.partitionBy("item_id")
