"""Sharding by rendezvous hashing of stable record keys over weighted shards.

The law is ``key``: a record's shard depends on its key, the shards and their
weights alone. With one more shard, a record either stays or moves into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one numbering window holds at most, on average.
ROWS_PER_WINDOW = 200_000


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard with the highest weight / -ln(u), u a hash of (key, shard) in (0, 1).

    u has 52 bits and a half, so that it never rounds to 0 or 1. Ties go to the lower
    shard. A null key is a key like any other.
    """
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("shards need positive weights")
    contests = []
    for shard, weight in sorted(weights.items()):
        bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(shard)), 12)
        u = (bits.cast("double") + 0.5) / F.lit(float(2**52))
        contests.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return -(F.array_max(F.array(*contests))["shard"])


def assign_shards(
    docs: DataFrame,
    weights: dict[int, float] | int = 16,
    key: str = "doc_id",
    text: str = "text",
    grown: bool = True,
) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row.

    Size is the UTF-8 length of the text plus 1 (null: 1; text_crc32 null text: 0,
    as of no bytes). Slots number a shard's rows from 0 without gaps: each shard is
    dealt into windows by a hash of the row, the windows' counts are summed into
    offsets (shards x windows small rows), and rows are numbered inside windows, so
    no task sorts a whole shard. Repeated rows get slots of their own; an empty
    table gives an empty result; only ``key`` and ``text`` are read.
    """
    shards = dict.fromkeys(range(weights), 1.0) if isinstance(weights, int) else dict(weights)
    more = shards | {max(shards) + 1: sum(shards.values()) / len(shards)}
    total = docs.select(F.lit(1)).count()
    windows = max(4, -(-total // (len(shards) * ROWS_PER_WINDOW)))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        rendezvous(F.col(key), shards).alias("shard"),
        (rendezvous(F.col(key), more) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(1), key, "text_crc32", "size"), F.lit(windows)).cast("int").alias("w"),
    )
    # shards x windows rows: bounded by rows / ROWS_PER_WINDOW, kept as a joinable table
    counts = rows.groupBy("shard", "w").agg(F.count(F.lit(1)).alias("n"))
    spans = counts.withColumn("at", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    spans = spans.select("shard", "w", F.coalesce("at", F.lit(0)).alias("at"))
    numbered = rows.withColumn("i", F.expr(f"row_number() OVER (PARTITION BY shard, w ORDER BY `{key}`, text_crc32, size)"))
    return numbered.join(spans, ["shard", "w"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("i") - 1).alias("slot"), "grown_shard"
    )


def write_shards(assigned: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per shard; a shard of any size is split into files of about ``rows_per_file`` slots, in slot order.

    Files of a shard follow each other by slot: file k of a folder holds the slots from
    k times ``rows_per_file`` on. An empty table writes no folder; other columns stay.
    """
    part = F.floor(F.col("slot") / F.lit(rows_per_file))
    dealt = assigned.withColumn("_part", part).repartition("shard", "_part").sortWithinPartitions("shard", "slot")
    dealt.drop("_part").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
