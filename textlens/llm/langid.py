"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1 drawn from its code point; a trigram binds
its letters' vectors, each permuted by its place (multiplied after rolling by 2, 1
and 0); a text bundles (adds) its trigrams; a language's prototype bundles the unit
vectors of its training texts. A text gets the language of the nearest prototype.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
#: Labelled rows per language that the prototypes are bundled from, about.
TRAIN_ROWS = 4000
#: Values of the language column that are learned, the most frequent first.
LANGUAGES = 500
#: Columns of a batch's trigram matrix that are held at once.
CHUNK = 4096
#: Documents whose vectors are summed at once.
ROWS = 512
#: Characters, about, that are taken at once.
CHARS = 1_500_000


class Encoder:
    """Texts to hypervectors. Letter vectors depend on the code point and ``seed`` alone."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def trigrams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, count) of the trigrams around every letter; words stand between spaces."""
        x = np.frombuffer(("\0" + "\0".join((t or "").replace("\0", " ") for t in texts) + "\0").lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[x]
        row = np.cumsum(x == 0) - 1
        y = np.where(letter, x, 32)
        at = np.flatnonzero(letter)
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        present = np.zeros(len(_letters()), bool)
        present[y] = True
        own = np.flatnonzero(present)
        short = np.zeros(len(present), np.int64)
        short[own] = np.arange(len(own))
        y, a = short[y], len(own)
        keys, counts = np.unique(((row[at] * a + y[at - 1]) * a + y[at]) * a + y[at + 1], return_counts=True)
        codes = (own[keys // a**2 % a] << 42) | (own[keys // a % a] << 21) | own[keys % a]
        return keys // a**3, codes, counts.astype(np.float32)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of trigram codes."""
        out = np.ones((len(codes), self.dimensions), np.float32)
        for shift, roll in ((42, 2), (21, 1), (0, 0)):
            own, at = np.unique((codes >> shift) & 0x1FFFFF, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), roll) for c in own])[at]
        return out

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """A bundled vector for each text; zero where it has no letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and hi - lo < ROWS and (hi == lo or size < CHARS):
                size += len(texts[hi] or "")
                hi += 1
            row, code, count = self.trigrams(texts[lo:hi])
            codes, at = np.unique(code, return_inverse=True)
            for c in range(0, len(codes), CHUNK):
                part = (at >= c) & (at < c + CHUNK)
                dense = np.zeros((hi - lo, min(CHUNK, len(codes) - c)), np.float32)
                dense[row[part], at[part] - c] = count[part]
                out[lo:hi] += dense @ self.vectors(codes[c : c + CHUNK])
            lo = hi
        return out


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _sample(labelled: DataFrame, lang: str, text: str, rows: int, seed: int) -> DataFrame:
    """(lang, text) of about ``rows`` texts of each learned language."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    return known.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) * F.col("n") < 1_000_000 * rows)


def known_trigrams(labelled: DataFrame, lang: str = "lang", text: str = "text", rows: int = TRAIN_ROWS, seed: int = 7, most: int = 500_000) -> np.ndarray:
    """Sorted codes of the trigrams in the texts that the prototypes are bundled from.

    The ``most`` frequent ones at most (by texts that have them, then by code): 4 MB.
    """

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(seed=seed)
        for batch in batches:
            texts = list(batch["text"])
            for lo in range(0, len(texts), ROWS):
                _, code, _ = encoder.trigrams(texts[lo : lo + ROWS])
                code, n = np.unique(code, return_counts=True)
                yield pd.DataFrame({"code": code, "n": n})

    found = _sample(labelled, lang, text, rows, seed).mapInPandas(codes, "code long, n long")
    top = found.groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(most).select("code").toPandas()
    return np.sort(top["code"].to_numpy(np.int64))


def train_prototypes(labelled: DataFrame, lang: str = "lang", text: str = "text", rows: int = TRAIN_ROWS, seed: int = 7) -> dict[str, np.ndarray]:
    """Prototype by language, from about ``rows`` texts of each.

    The texts of a language with more are chosen by a hash of the text, so the fit
    costs the same at any size. What reaches the driver is one vector a language, for
    the ``LANGUAGES`` most frequent values at most (ties: the first by name). Null
    languages and texts teach nothing; repeated rows count as often as they occur; an
    empty table teaches no language.
    """
    chosen = _sample(labelled, lang, text, rows, seed)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = Encoder(seed=seed), {}
        for batch in batches:
            unit = _unit(encoder.encode(list(batch["text"]))).astype(np.float64)
            for name, group in batch.groupby("lang").indices.items():
                sums[name] = sums.get(name, 0) + unit[group].sum(0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    def total(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "v": [np.sum(np.stack(group["v"]), 0).tolist()]})

    parts = chosen.mapInPandas(partial, "lang string, v array<double>")
    found = parts.groupBy("lang").applyInPandas(total, "lang string, v array<double>").collect()
    return {r["lang"]: _unit(np.array(r["v"])) for r in sorted(found, key=lambda r: r["lang"]) if np.any(r["v"])}


def _scored(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str, seed: int, known: np.ndarray | None) -> DataFrame:
    """(r, l): the row as a struct, and lang_pred, score and known of its text."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    encoder = Encoder(seed=seed)

    @F.pandas_udf("lang_pred string, score double, known double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if t is None or t is pd.NA else t for t in batch]
            vectors = encoder.encode(texts)
            some = np.abs(vectors).any(1)
            share = _known_share(encoder, texts, known) if known is not None else np.where(some, 1.0, 0.0)
            if not len(names):
                yield pd.DataFrame({"lang_pred": ["und"] * len(batch), "score": [0.0] * len(batch), "known": share})
                continue
            cosines = (_unit(vectors) @ matrix.T).astype(np.float64)
            best = cosines.argmax(1) if len(batch) else np.empty(0, int)
            score = np.clip(cosines[np.arange(len(batch)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": [names[b] if s else "und" for b, s in zip(best, some, strict=True)], "score": np.where(some, score, 0.0), "known": share})

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), predict(F.col(text)).alias("l"))


def _known_share(encoder: Encoder, texts: list[str | None], known: np.ndarray) -> np.ndarray:
    """The share of each text's trigrams that are known; 0 without any."""
    out = np.zeros(len(texts))
    for lo in range(0, len(texts), ROWS):
        row, code, count = encoder.trigrams(texts[lo : lo + ROWS])
        n = len(texts[lo : lo + ROWS])
        at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
        hit = known[at] == code if len(known) else np.zeros(len(code), bool)
        total = np.bincount(row, count, n)
        out[lo : lo + n] = np.bincount(row, count * hit, n) / np.maximum(total, 1)
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", seed: int = 7) -> DataFrame:
    """``docs`` with lang_pred and score (cosine with the nearest prototype, 0 at least).

    A null text, one without a letter, and every text when there is no prototype, is
    ``und`` with score 0. Ties go to the first language by name. The text column is
    read whole; rows need no key and equal rows are answered alike; an empty table stays
    empty. All columns pass through, whatever their names; columns called lang_pred or
    score give way to the operator's.
    """
    out = _scored(docs, prototypes, text, seed, None)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return out.select(*[F.col("r").getField(c).alias(c) for c in kept], F.col("l.lang_pred").alias("lang_pred"), F.col("l.score").alias("score"))


def in_learned_language(docs: DataFrame, prototypes: dict[str, np.ndarray], known: np.ndarray, min_known: float, text: str = "text", seed: int = 7) -> DataFrame:
    """The rows of ``docs``, as they are, whose text is in a learned language.

    Null texts and those without a letter go, and those of which less than ``min_known``
    of the trigrams is known: other scripts, other languages' spelling, noise.
    """
    out = _scored(docs, prototypes, text, seed, known).where((F.col("l.lang_pred") != "und") & (F.col("l.known") >= min_known))
    return out.select(*[F.col("r").getField(c).alias(c) for c in docs.columns])


def held_out(key: str, parts: int, part: int):
    """Whether crc32 of the key as text leaves ``part``; a null key is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(parts)) == part, F.lit(False))

