"""Cross-site boilerplate: lines that are spread over many distinct sites.

Native: DataFrame functions only. One aggregation a line hash counts its occurrences,
finds its first document and merges HyperLogLog sketches of its sites; each task
merges its own part first, so a line that is everywhere costs a row a task. Estimates
well away from the threshold decide at once, lines near it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, exploded

#: Estimates within this share of the threshold are counted exactly. A sketch of
#: 2^12 registers errs by 1.6 % (one standard error), so 25 % is fifteen of them.
BAND = 0.25
#: Line hashes (16 bytes each) that are broadcast; beyond it the join is salted.
BROADCAST_LINES = 1_000_000
#: Documents with lines to remove, and positions of those, that are broadcast; beyond it texts are shuffled.
BROADCAST_DOCS, BROADCAST_PLACES = 500_000, 4_000_000
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column) -> Column:
    """Hash of each trimmed line; a blank line has none."""
    return F.transform(_lines(text), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def line_spread(docs: DataFrame, min_sites: int, site: str = "source", key: str = "doc_id", text: str = "text", lg_k: int = 12, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(h, first) of the line hashes found on ``min_sites`` distinct sites or more."""
    hashed = exploded(docs, [F.col(key).alias("id"), F.col(site).alias("site")], _hashes(F.col(text)), "h")
    sketched = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    # occurrences bound the number of sites from above
    likely = cut(sketched.where((F.col("n") >= min_sites) & (F.col("sites") >= int(min_sites * (1 - BAND)))))
    sure = F.col("sites") >= int(min_sites * (1 + BAND)) + 1
    near = likely.where(~sure).select("h")
    if near.limit(broadcast_lines + 1).count() <= broadcast_lines:
        pairs = hashed.join(F.broadcast(near), "h", "left_semi").select("h", "site").distinct()
    else:  # pairs of line and site first, so that no line brings more rows than sites
        pairs = hashed.select("h", "site").distinct().join(near, "h", "left_semi")
    exact = pairs.where("site IS NOT NULL").groupBy("h").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites)
    return likely.where(sure).select("h", "first").unionByName(likely.join(exact.select("h"), "h").select("h", "first"))


def dedup_lines(
    docs: DataFrame,
    min_sites: int = 8,
    site: str = "source",
    key: str = "doc_id",
    text: str = "text",
    keep_first: bool = True,
    counts: bool = True,
    broadcast_lines: int = BROADCAST_LINES,
    broadcast_docs: int = BROADCAST_DOCS,
) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus n_lines and n_removed (long) with ``counts``.

    A line (compared trimmed) on ``min_sites`` distinct sites or more is removed;
    with ``keep_first`` it stays in the document of the smallest key, so that no
    text vanishes from the corpus when whole documents are copied across sites.
    Blank lines are never removed. A null text stays null with 0 lines; an empty
    one has one line. A null site counts for no site; a row with a null key is
    left as it is. Rows that repeat a key are told apart by their text; equal rows are
    cleaned alike. Other columns, whatever their names, pass through; with ``counts``
    an input column called n_lines or n_removed gives way to the operator's. An empty
    table stays empty. Line hashes have 64 bits.
    """
    spread = cut(line_spread(docs, min_sites, site, key, text, broadcast_lines=broadcast_lines))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("r"), F.col(key).alias("id"), F.col(text).alias("x"))
    marked = rows.select("id", F.xxhash64("x").alias("t"), F.posexplode_outer(_hashes(F.col("x"))).alias("pos", "h")).where("h IS NOT NULL AND id IS NOT NULL")
    if spread.limit(broadcast_lines + 1).count() <= broadcast_lines:
        gone = marked.join(F.broadcast(spread), "h")
    else:
        salted = marked.withColumn("s", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int"))
        gone = salted.join(spread.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "s"])
    if keep_first:
        gone = gone.where(F.col("id") != F.col("first"))
    gone = cut(gone.groupBy("id", "t").agg(F.collect_list("pos").alias("gone")))
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("places")).first()
    named = gone.withColumnsRenamed({"id": "gid", "t": "gt"})
    if size["n"] <= broadcast_docs and size["places"] <= BROADCAST_PLACES:
        named = F.broadcast(named)
    joined = rows.join(named, (F.col("id") == F.col("gid")) & (F.xxhash64("x") == F.col("gt")), "left")
    # lines and kept positions are columns of their own: inside a lambda an expression
    # would be evaluated again for every element
    split = joined.select("r", F.when(F.col("x").isNotNull(), F.col("gone")).alias("gone"), "x", _lines(F.col("x")).alias("lines"))
    pos = F.sequence(F.lit(0), F.size("lines") - 1)
    split = split.select("r", "x", "lines", F.when(F.col("gone").isNotNull(), F.array_except(pos, F.col("gone"))).alias("kept"))
    cleaned = F.when(F.col("kept").isNotNull(), F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")).otherwise(F.col("x"))
    added = {
        "n_lines": F.when(F.col("x").isNull(), 0).otherwise(F.size("lines")).cast("long"),
        "n_removed": F.when(F.col("kept").isNotNull(), F.size("lines") - F.size("kept")).otherwise(0).cast("long"),
    }
    added = added if counts else {}
    kept = [c for c in docs.columns if c not in added]
    return split.select(*[(cleaned if c == text else F.col("r").getField(c)).alias(c) for c in kept], *[v.alias(k) for k, v in added.items()])
