"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

A document is reduced to statistics; random Fourier features approximate a
Gaussian kernel over them; ridge weights come from normal equations summed over
partitions; pooled adjacent violators turn ridge scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labelled rows that the model is fitted on, at most about.
TRAIN_ROWS = 20_000
FEATURES = 256
RIDGE = 1e-2
_DOTS = np.isin(np.arange(128), [ord(c) for c in ",.!?:;'\"-()"])
STATS = ["log_chars", "log_words", "word_length", "word_length_sd", "letters", "digits", "upper", "space", "symbols", "other_punct", "unique_words", "top_word", "repeat_pairs", "line_words", "unique_lines", "sentence_words", "short_words", "long_words", "symbol_words", "end_marks"]


def statistics(text: str | None) -> list[float]:
    """The features of one text; all zero for a null or empty one."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    n, m = len(text), len(words)
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter = (((x | 32) >= 97) & ((x | 32) <= 122)) | (x >= 0xC0)
    digit = (x >= 48) & (x <= 57)
    blank = x <= 32
    letters, digits, space = letter.sum(), digit.sum(), blank.sum()
    upper = ((x >= 65) & (x <= 90)).sum()
    dots = _DOTS[np.minimum(x, 127)].sum()
    symbols = n - letters - digits - space - dots
    # word edges by ASCII white space, which is what the shares below need
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1) - 1
    lengths = last - first + 1 if len(first) else np.ones(1)
    plain = letter | digit
    counts = Counter(words)
    pairs = sum(map(eq, words, islice(words, 1, None)))
    lines = [s for s in text.split("\n") if s.strip()]
    marked = (~(plain[first] & plain[last])).sum()
    closing = x[last]
    ends = ((closing == 46) | (closing == 33) | (closing == 63)).sum()
    return [
        np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), letters / n, digits / n, upper / n, space / n, symbols / n, dots / n,
        len(counts) / m, max(counts.values()) / m, pairs / m, np.log1p(m / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        np.log1p(m / max(1, ends)), (lengths <= 2).mean(), (lengths >= 12).mean(), marked / m, ends / m,
    ]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        if blocks and blocks[-1][4] == a:  # equal scores pool at once
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1, a, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3], blocks[-1][4] = hi, last
    knots = [(p[2], p[0] / p[1]) for p in blocks] + [(p[3], p[0] / p[1]) for p in blocks]
    knots = sorted(set(knots))
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    """Standardise, lift, weigh, calibrate."""

    def __init__(self, mean, scale, omega, phase, weights=None, knots=None):
        self.mean, self.scale, self.omega, self.phase, self.weights, self.knots = mean, scale, omega, phase, weights, knots

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        lifted = np.sqrt(2 / self.omega.shape[1]) * np.cos(z @ self.omega + self.phase)
        return np.hstack([lifted, z / np.sqrt(z.shape[1]), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


def with_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, stats array<double>): one pass over whole texts; the texts go no further.

    Null and empty texts have statistics of zero; every row gives a row, repeated ones
    too; no column but the two named is read, so others can't clash.
    """

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch])

    return docs.select(F.col(key), stats(F.col(text)).alias("stats"))


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES, ridge: float = RIDGE, seed: int = 3) -> Model:
    """The model for (doc_id, stats, y in {0, 1}).

    At most about ``rows`` rows, chosen by a hash of the key; a fifth of them are
    set aside for calibration. A repeated row or label counts as often as it occurs; equal
    scores are calibrated together; one class alone, or no row, gives a model that scores
    0.5 everywhere. The driver gets one sum of ``features``^2 numbers a
    partition (few: the sample is bounded) and the set-aside scores.
    """
    total = labelled.count()
    share = min(1.0, rows / max(1, total))
    mixed = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1_000_000))
    sample = labelled.withColumn("m", mixed).where(F.col("m") < int(1_000_000 * share))
    sample = cut(sample.select("stats", "y", "m")).coalesce(8)  # few rows by now: the scan stays wide
    rng = np.random.default_rng(seed)
    k = len(STATS)
    blank = Model(np.zeros(k), np.ones(k), rng.standard_normal((k, features)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, features))
    # in a pass: counts, sums and squares of each statistic
    moments = sample.select("y", F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("s"), F.min("y").alias("lo"), F.max("y").alias("hi")).orderBy("i").collect()
    if not moments or moments[0]["lo"] == moments[0]["hi"]:
        return blank  # no labels, or one class alone: nothing to tell apart
    model = Model(np.array([m["a"] for m in moments]), np.array([m["s"] if m["s"] > 1e-9 else 1.0 for m in moments]), blank.omega, blank.phase)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = features + k + 1
        gram, moment, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            if len(batch):
                z = model.lift(np.stack(batch["stats"].to_numpy()))
                gram += z.T @ z
                moment += z.T @ batch["y"].to_numpy(float)
                n += len(batch)
        if n:
            yield pd.DataFrame({"n": [n], "gram": [gram.ravel().tolist()], "moment": [moment.tolist()]})

    calibrate = F.pmod(F.col("m"), F.lit(5)) == 4
    parts = sample.where(~calibrate).select("stats", "y").mapInPandas(sums, "n long, gram array<double>, moment array<double>").collect()
    if not parts:
        return blank
    moment = np.sum([p["moment"] for p in parts], 0)
    gram = np.sum([p["gram"] for p in parts], 0).reshape(len(moment), -1)
    n = sum(p["n"] for p in parts)
    model.weights = np.linalg.solve(gram + ridge * n / len(moment) * np.eye(len(moment)), moment)
    held = sample.where(calibrate).select("stats", "y").toPandas()
    if not len(held):
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        return model
    model.knots = isotonic(model.raw(np.stack(held["stats"].to_numpy())), held["y"].to_numpy(float))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` rows with a score in 0 to 1 (a column of that name gives way); 0.5 everywhere without a fitted model."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(np.stack(batch.to_numpy())) if len(batch) else [], dtype=float)

    return stats.withColumn("score", scored(F.col("stats")))
