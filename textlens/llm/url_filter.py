"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule accepts teach one variable-order Markov model, those that a rule
rejects another. Both interpolate all orders (a longer context counts by how often it
has been seen). A URL that no rule decides is judged by the difference of its two
log-likelihoods over its length, against a threshold calibrated on rule-decided URLs
that taught nothing.

Characters are UTF-8 bytes, so a run of up to seven is one exact 64-bit number. The
difference of the longest run known at a place is a telescoping sum over all runs that
end there: each run stores its gain over the run without its first character, and a
URL's score is the plain sum of the gains of all its runs. Gains are whole millionths,
so that sum doesn't depend on how it is added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_sizes

#: Longest context, in characters.
ORDER = 5
#: How many observations the shorter context's distribution counts as.
STRENGTH = 20.0
#: Runs of a model that are sent to every task (16 bytes each); a larger one is joined.
BROADCAST = 2_000_000
#: Places of a batch that are looked up at once.
WINDOW = 500_000
#: One part in so many of the decided URLs calibrates.
HELD_OUT = 5
#: Bins of the calibration to one unit of score, and the score where they end.
BINS, REACH = 400, 10
BEGIN, END = 2, 3
_LOW = 2**56 - 1


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains and a prefix of the path."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z in lower case; path: then up to ? or #; both empty without ://."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)([^?#]*+)", i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; among equally long ones of the longest host, then block; null where none fits."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def _windows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, codes by length) of bounded stretches of places; every character and the end of a text is a place."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    size = np.diff(offsets) + ORDER + 1
    ends = np.cumsum(size)
    flat = np.full(ends[-1], BEGIN, np.uint8)
    flat[ends - 1] = END
    shift = np.arange(n) * (ORDER + 1) + ORDER
    flat[np.arange(len(raw)) + np.repeat(shift, np.diff(offsets))] = raw
    for lo in range(0, len(flat), WINDOW):
        at = np.arange(lo, min(lo + WINDOW, len(flat)))
        row = np.searchsorted(ends, at, "right")
        place = at - (ends[row] - size[row]) >= ORDER
        at, row = at[place], row[place]
        code, codes = np.zeros(len(at), np.int64), np.empty((ORDER + 1, len(at)), np.int64)
        for k in range(ORDER + 1):
            code |= flat[at - k].astype(np.int64) << (8 * k)
            codes[k] = code | ((k + 1) << 56)
        yield row, codes


def run_counts(decided: DataFrame) -> DataFrame:
    """(code, a, r): how often each run of 1 to ORDER + 1 characters occurs in the accepted and rejected ``url`` of ``accepted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << 60
            for row, codes in _windows(batch.column(0)):
                codes, n = np.unique((codes | side[row]).ravel(), return_counts=True)
                yes = codes >> 60
                yield pa.RecordBatch.from_arrays([pa.array(codes & ~(1 << 60)), pa.array(n * yes), pa.array(n * (1 - yes))], ["code", "a", "r"])

    found = decided.select(F.coalesce("url", F.lit("")).alias("url"), "accepted").mapInArrow(run, "code long, a long, r long")
    return found.groupBy("code").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))


def gains(counts: DataFrame) -> DataFrame:
    """(code, gain) of every run that has one, from its counts in both classes.

    P(c | context) = (n + S * P(c | context without its first character)) / (N + S), with N
    how often the context was seen in the class and S = ``STRENGTH``, so an unseen context
    leaves the shorter one's; 1/256 below all. A level is joined with the level before; a
    run has at most 256 neighbours there, so no key is hot.
    """
    size = F.shiftright("code", 56)
    keyed = counts.withColumn("size", size.cast("int")).withColumn("before", F.shiftleft(size - 1, 56).bitwiseOR(F.shiftright(F.col("code").bitwiseAND(_LOW), 8)))
    seen = keyed.groupBy("before").agg(*[F.sum(c).alias(f"N{c}") for c in "ar"])
    keyed = cut(keyed.join(seen, "before"))
    found = None
    for k in range(1, ORDER + 2):
        level = keyed.where(F.col("size") == k)
        if k == 1:
            level = level.select("*", *[F.lit(1 / 256).alias(f"q{c}") for c in "ar"], F.lit(0).cast("long").alias("shorter"))
        else:
            last = found.where(F.shiftright("code", 56) == k - 1).select(F.col("code").alias("suffix"), F.col("pa").alias("qa"), F.col("pr").alias("qr"), F.col("d").alias("shorter"))
            level = level.withColumn("suffix", F.lit((k - 1) << 56).bitwiseOR(F.col("code").bitwiseAND((1 << (8 * (k - 1))) - 1))).join(last, "suffix")
        level = level.select("code", *[((F.col(c) + STRENGTH * F.col(f"q{c}")) / (F.col(f"N{c}") + STRENGTH)).alias(f"p{c}") for c in "ar"], "shorter")
        level = cut(level.select("code", "pa", "pr", F.floor(F.lit(1e6) * F.log(F.col("pa") / F.col("pr"))).alias("d"), "shorter"))
        found = level if found is None else found.unionByName(level)
    return found.select("code", (F.col("d") - F.col("shorter")).alias("gain")).where("gain <> 0")


def _by_lookup(model: DataFrame):
    """A column function: the sum of the gains of a text's runs, from a model that every task holds."""
    table = model.toArrow().combine_chunks()
    order = np.argsort(table["code"].to_numpy())
    sent = model.sparkSession.sparkContext.broadcast((table["code"].to_numpy()[order], table["gain"].to_numpy()[order]))

    @F.pandas_udf("long")
    def total(urls: pd.Series) -> pd.Series:
        codes, gain = sent.value
        out = np.zeros(len(urls), np.int64)
        for row, runs in _windows(pa.array(urls, pa.string(), from_pandas=True)):
            sums = np.zeros(runs.shape[1], np.int64)
            for c in runs if len(codes) else ():
                at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
                sums += np.where(codes[at] == c, gain[at], 0)
            np.add.at(out, row, sums)
        return pd.Series(out)

    return total


def _by_join(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(h1, h2, total) of the urls of ``urls(h1, h2, url)``, all different, that have a known run; for a model of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy() for i in range(2))
            for row, codes in _windows(batch.column(2)):
                rows = np.tile(row, len(codes))
                yield pa.RecordBatch.from_arrays([pa.array(h1[rows]), pa.array(h2[rows]), pa.array(codes.ravel())], ["h1", "h2", "code"])

    runs = urls.select("h1", "h2", "url").mapInArrow(run, "h1 long, h2 long, code long").groupBy("h1", "h2", "code").agg(F.count(F.lit(1)).alias("n"))
    runs = cut(runs)
    sizes = runs.groupBy("code").agg(F.count(F.lit(1)).alias("size")).join(model, "code")
    return join_sizes(runs, sizes, ["code"], runs.count(), spread="h1").groupBy("h1", "h2").agg(F.sum(F.col("n") * F.col("gain")).alias("total"))


def with_scores(rows: DataFrame, model: DataFrame, broadcast_rows: int = BROADCAST) -> DataFrame:
    """``rows`` with _score: millionths of the log-likelihood difference a character of ``url``."""
    length = F.octet_length("url") + 1
    if model.count() <= broadcast_rows:
        return rows.withColumn("_score", F.floor(_by_lookup(model)(F.col("url")) / length))
    rows = rows.withColumn("h1", F.xxhash64("url")).withColumn("h2", F.xxhash64(F.lit(1), "url"))
    urls = rows.groupBy("h1", "h2").agg(F.first("url").alias("url"), F.count(F.lit(1)).alias("size"))
    urls = cut(urls)
    totals = urls.select("h1", "h2", "size").join(_by_join(urls, model), ["h1", "h2"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    out = join_sizes(rows, totals, ["h1", "h2"], rows.count(), spread="_nth")
    return out.withColumn("_score", F.floor(F.col("total") / length)).drop("h1", "h2", "total", "size")


def threshold(scored: DataFrame) -> int:
    """The score from which a URL is accepted, in millionths, by _score and accepted of held-out URLs.

    A histogram of both classes reaches the driver, and the edge wins that keeps the
    largest share of the accepted and drops the largest share of the rejected (both count
    alike; ties: the edge nearest to 0, then the lower). Without URLs of both classes it is 0.
    """
    step = 1_000_000 // BINS
    most = BINS * REACH
    bins = scored.groupBy(F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.col("_score") / step))).alias("bin"), "accepted").count().collect()
    n = np.zeros((2, 2 * most + 1), np.int64)
    for r in bins:
        n[int(r["accepted"]), r["bin"] + most] += r["count"]
    if not n.sum(1).all():
        return 0
    kept = n[1][::-1].cumsum()[::-1] / n[1].sum()
    dropped = (n[0].cumsum() - n[0]) / n[0].sum()
    edges = np.arange(-most, most + 1)
    best = min(range(len(edges)), key=lambda i: (-round(kept[i] + dropped[i], 12), abs(edges[i]), edges[i]))
    return int(edges[best]) * step


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", keep: list[str] | None = None, broadcast_rows: int = BROADCAST) -> DataFrame:
    """``keep`` (all columns unless given), host, path, rule, verdict and score of every row.

    verdict is allow or block: the rule's, else the models'. score is the models' (log-
    likelihood difference a character, null where a rule decides). All decided URLs but
    the held-out ones are counted, as often as they occur. A null URL has no host and is
    scored as an empty one; one without :// has no host and is scored whole; repeated rows
    are judged alike. If rules decide URLs of one class alone, or none, the score is 0 and
    the verdict of the others is allow. An empty table stays empty. Columns called host,
    path, rule, verdict or score give way to the operator's.

    ``rules`` travel in the plan, so they are tens, not millions. A model of at most
    ``broadcast_rows`` runs is sent to all tasks, which judge row by row without an
    exchange; a larger one is joined with the runs of all different URLs, salted by size.
    """
    keep = pages.columns if keep is None else keep
    text = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    host, path = host_and_path(text)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"), text.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"), F.monotonically_increasing_id().alias("_nth"))
    decided = rows.where("verdict IS NOT NULL").select("url", (F.col("verdict") == "allow").alias("accepted"), "_nth")
    test = F.pmod(F.crc32(F.encode("url", "UTF-8")), F.lit(HELD_OUT)) == 0
    classes = decided.where(~test).select("accepted").distinct().count()
    if classes < 2:
        judged = rows.where("verdict IS NULL").withColumn("_score", F.lit(0).cast("long"))
        least = 0
    else:
        model = cut(gains(run_counts(decided.where(~test))))
        least = threshold(with_scores(decided.where(test), model, broadcast_rows))
        judged = with_scores(rows.where("verdict IS NULL"), model, broadcast_rows)
    judged = judged.withColumn("verdict", F.when(F.col("_score") >= least, "allow").otherwise("block"))
    out = rows.where("verdict IS NOT NULL").withColumn("_score", F.lit(None).cast("long")).unionByName(judged)
    own = ("host", "path", "rule", "verdict", "score")
    kept = [F.col("r").getField(c).alias(c) for c in keep if c not in own]
    return out.select(*kept, "host", "path", "rule", "verdict", (F.col("_score") / F.lit(1e6)).alias("score"))


def keep_allowed(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """The rows of ``pages``, as they are, whose URL is allowed."""
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{url}`").alias("address"))
    kept = judge_urls(whole, rules, "address").where("verdict = 'allow'")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in pages.columns])
