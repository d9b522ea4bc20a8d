"""N-gram Jaccard self-join by chosen paths.

Documents are sets of five-word shingles. In every run a set follows one path: at
each level the path goes on with a sampled token of the set (the minimum of a hash
function of that run and level, so two sets take the same step with a probability
equal to their Jaccard similarity). A bucket splits only while it is larger than
``LIMIT``; small buckets are compared by brute force; runs repeat until a pair at
the threshold is missed with less than 1 - ``RECALL`` even if all its buckets split
to the last level. Compared means: sketches admit a pair, whole shingle sets decide,
both in the bucket of the first run that the pair shares, so every link counts once
and work grows with the buckets and not with the components of links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, cut, fixed_binary, forest, join_sizes, ragged_binary

WIDTH = 5
#: Buckets up to this size are not split.
LIMIT = 64
LEVELS = 4
RECALL = 0.9999
#: Sets in a block of sketches, about; shingles in a block of whole sets, about.
BLOCK = 400
BLOCK_SHINGLES = 1_000_000
#: Keys (two longs each) of texts to verify that are broadcast; beyond it texts are shuffled.
BROADCAST_KEYS = 500_000
_WORD = re.compile(r"[^\W_]+")
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def runs_needed(threshold: float, levels: int = LEVELS, recall: float = RECALL) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**levels)))


def admitted(threshold: float, width: int, errors: float = 5.0) -> float:
    """Sketch similarity below which a pair of a bucket isn't verified: the threshold less five standard errors."""
    return max(0.0, threshold - errors * math.sqrt(threshold * (1 - threshold) / width))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of a word; emptied when large, so memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    def __init__(self):
        self.words = _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit shingles; a text of one to four words is one shingle."""
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - WIDTH + 1)
        acc = np.full(n, len(h) if len(h) < WIDTH else WIDTH, np.uint64)
        for i in range(min(WIDTH, len(h))):
            acc = _mix(acc * _A + h[i : i + n])
        return np.unique(acc)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles, as two longs."""
    whole = xxhash.xxh128_intdigest(s.tobytes())
    return (whole >> 64) - 2**63, (whole & (2**64 - 1)) - 2**63


def _sketches(width: int, runs: int, levels: int):
    rng = np.random.default_rng(5)
    mult = rng.integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, width, dtype=np.uint64)

    def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(16-bit values of all minima, path of each level and run)."""
        least = np.full(width, ~np.uint64(0))
        for lo in range(0, len(s), 4096):
            least = np.minimum(least, (s[lo : lo + 4096, None] * mult + plus).min(0))
        token = _mix(least * _A)
        steps = token[: runs * levels].reshape(levels, runs)
        path, paths = np.arange(runs, dtype=np.uint64), []
        for level in range(levels):
            path = _mix(path * _A + steps[level])
            paths.append(path)
        return (token >> np.uint64(48)).astype(np.uint16), np.stack(paths).view(np.int64)

    return sketch


def jaccard_links(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_shingles of every row.

    n_links counts the other documents at ``threshold`` or more, class_id is the
    smallest key reachable over links. Words are lower-case runs of letters and
    digits; a text of one to four words is one shingle of its own length; null texts
    and those without a word link with nothing, nor do rows with a null key. Texts
    with equal sets are collapsed first and count as links of each other. Keys
    are whole numbers (a text that isn't one is refused) and should be unique: rows that
    repeat one are counted like copies and answered alike for alike texts. No pair reaches a shuffle: blocks report counts and
    spanning edges. Other columns are not read.
    """
    runs = runs_needed(threshold, recall=recall)
    width = max(64, runs * LEVELS) if threshold >= 0.7 else max(256, runs * LEVELS)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch = Shingler(), _sketches(width, runs, LEVELS)
        for batch in batches:
            h1, h2, n, sig, paths = [], [], [], [], []
            for body in batch.column(1).to_pylist():
                s = shingler(body)
                n.append(len(s))
                if not len(s):
                    for column in (h1, h2, sig, paths):
                        column.append(None)
                    continue
                for column, half in zip((h1, h2), digest(s), strict=True):
                    column.append(half)
                a, b = sketch(s)
                sig.append(a.tobytes())
                paths.append(b.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(paths, pa.binary())],
                ["id", "h1", "h2", "n", "sig", "paths"],
            )

    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = cut(source.mapInArrow(described, "id long, h1 long, h2 long, n long, sig binary, paths binary"))
    usable = rows.where("n > 0 AND id IS NOT NULL")
    # a class of equal sets is known by its hash, since a key may repeat over different texts
    classes = usable.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("paths").alias("paths"))
    classes = cut(classes.withColumn("id", F.col("h1")))

    # split buckets: level by level, only those that are still large
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                paths = fixed_binary(batch.column(1), "i8").reshape(-1, LEVELS, runs)
                ids = np.repeat(batch.column(0).to_numpy(), runs)
                run = np.tile(np.arange(runs, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(run), *(pa.array(paths[:, i].ravel()) for i in range(LEVELS))], ["id", "run", *(f"p{i}" for i in range(LEVELS))])

    schema = "id long, run int, " + ", ".join(f"p{i} long" for i in range(LEVELS))
    active = classes.select("id", "paths").mapInArrow(opened, schema)
    places = classes.count() * runs
    leaves = None
    for level in range(LEVELS):
        path = f"p{level}"
        sizes = active.groupBy(path).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        active = join_sizes(active, sizes, [path], places)
        active = cut(active)
        done = active if level == LEVELS - 1 else active.where(F.col("size") <= LIMIT)
        done = done.select("id", "run", F.col(path).alias("gid"), "size")
        leaves = done if leaves is None else leaves.unionByName(done)
        active = active.where(F.col("size") > LIMIT).drop("size")
    placed = leaves.groupBy("id").agg(F.collect_list(F.struct("run", "gid", "size")).alias("l"))
    placed = cut(placed.join(classes.select("id", "least", "m", "n", "sig"), "id").select("id", "least", "m", "n", "sig", "l", F.col("l.run").alias("in_run"), F.col("l.gid").alias("in_gid")))
    members = placed.select("id", "sig", "in_run", "in_gid", F.explode("l").alias("x")).select("x.gid", "x.size", "id", "sig", "in_run", "in_gid")

    def buckets(t: pa.Table) -> np.ndarray:
        """The bucket of each row in each run; 0 where it is alone."""
        run, gid = (t.column(c).combine_chunks() for c in ("in_run", "in_gid"))
        found = np.zeros((len(t), runs), np.int64)
        found[np.repeat(np.arange(len(t)), run.value_lengths().to_numpy(zero_copy_only=False)), run.flatten().to_numpy()] = gid.flatten().to_numpy()
        return found

    def met(gid: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of bucket ``gid`` that share one of an earlier run, where they are compared instead."""
        earlier = np.zeros((len(x), len(y)), bool)
        for i in range(int(np.flatnonzero(x[0] == gid)[0])):
            earlier |= (x[:, i, None] == y[None, :, i]) & (x[:, i, None] != 0)
        return earlier

    def load(t: pa.Table) -> dict:
        return {"id": t.column("id").to_numpy(), "sig": fixed_binary(t.column("sig"), "u2"), "at": buckets(t)}

    def alike(gid: int, a: dict, left: tuple, right: tuple | None) -> Iterator[dict]:
        right = right or left
        x, y = a["sig"][slice(*left)], a["sig"][slice(*right)]
        same = np.zeros((len(x), len(y)), np.uint16)
        for i in range(x.shape[1]):
            same += x[:, i, None] == y[None, :, i]
        near = same >= admitted(threshold, x.shape[1]) * x.shape[1]
        if left == right:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        near &= ~met(gid, a["at"][slice(*left)], a["at"][slice(*right)])
        ids = np.concatenate([a["id"][slice(*left)][near.any(1)], a["id"][slice(*right)][near.any(0)]])
        if len(ids):
            yield {"gid": np.full(len(ids), gid), "id": ids}

    seat = pa.schema([("gid", pa.int64()), ("id", pa.int64())])
    near = cut(block_pairs(members, F.ceil(F.col("size") / F.lit(BLOCK)), load, alike, "gid long, id long", seat).distinct())

    # verify: in each bucket the whole sets of those admitted there, dealt into blocks
    weights = near.join(placed.select("id", "n"), "id")
    totals = weights.groupBy("gid").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    seats = join_sizes(weights, totals, ["gid"], places, "k").groupBy("id").agg(F.collect_list(F.struct("gid", "k", "total")).alias("seats"))
    wanted = cut(seats.join(placed, "id").select("least", "id", "m", "in_run", "in_gid", "seats"))
    named = wanted.select("least", "id")
    named = F.broadcast(named) if wanted.count() <= BROADCAST_KEYS else named

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler(t) for t in batch.column(1).to_pylist()]
            own = np.fromiter((digest(s)[0] for s in sets), np.int64, len(sets)) == batch.column(0).to_numpy()
            found = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "s"]).filter(pa.array(own))

    texts = source.withColumnRenamed("id", "least").join(named, "least").select("id", "text").mapInArrow(spelled, "id long, s binary")
    sets = texts.join(wanted, "id").select(F.explode("seats").alias("x"), "id", "m", "in_run", "in_gid", "s").select("x.gid", "x.k", "x.total", "id", "m", "in_run", "in_gid", "s")
    blocks = F.ceil(F.greatest(F.col("k") / F.lit(BLOCK), F.col("total") / F.lit(BLOCK_SHINGLES)))

    def load_sets(t: pa.Table) -> dict:
        values, offsets = ragged_binary(t.column("s"), "u8")
        return {"id": t.column("id").to_numpy(), "m": t.column("m").to_numpy(), "s": values, "o": offsets, "at": buckets(t)}

    def verified(gid: int, a: dict, left: tuple, right: tuple | None) -> Iterator[dict]:
        s, e = left[0], (left if right is None else right)[1]
        offsets = a["o"][s : e + 1]
        sizes = np.diff(offsets)
        _, column = np.unique(a["s"][offsets[0] : offsets[-1]], return_inverse=True)
        row = np.repeat(np.arange(e - s), sizes)
        k = left[1] - left[0]
        shared = np.zeros((k, k if right is None else e - s - k), np.float32)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        step = max(256, 16_000_000 // (e - s))
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            lo, hi = np.searchsorted(column, (c, c + step))
            dense = np.zeros((e - s, min(step, int(column[-1]) + 1 - c)), np.float32)
            dense[row[lo:hi], column[lo:hi] - c] = 1
            shared += dense[:k] @ (dense[:k] if right is None else dense[k:]).T
        x = sizes[:k]
        y = x if right is None else sizes[k:]
        shared = shared.astype(np.float64)
        linked = shared >= threshold * (x[:, None] + y[None, :] - shared) - 1e-9
        ids, m = a["id"][s:e], a["m"][s:e]
        linked &= ids[:k, None] != (ids[:k] if right is None else ids[k:])[None, :]
        again = np.r_[False, ids[1:] == ids[:-1]]  # a row that repeats its key and text
        linked[again[:k]] = False
        linked[:, again[:k] if right is None else again[k:]] = False
        if not linked.any():
            return
        linked &= ~met(gid, a["at"][s:e][:k], a["at"][s:e][:k] if right is None else a["at"][s:e][k:])
        if not linked.any():
            return
        if right is None:
            counts = linked @ m
            node, root = forest(linked, ids, None)
        else:
            counts = np.concatenate([linked @ m[k:], linked.T @ m[:k]])
            node, root = forest(linked, ids[:k], ids[k:])
        some = counts > 0
        yield {"id": np.concatenate([ids[some], node]), "links": np.concatenate([counts[some], np.zeros(len(node), np.int64)]), "root": np.concatenate([ids[some], root])}

    out = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    found = cut(block_pairs(sets, blocks, load_sets, verified, "id long, links long, root long", out))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    grouped = cut(classes.join(component, classes["id"] == component["node"], "left").select("h1", "h2", "id", "least", "m", F.coalesce("component", "id").alias("root")))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("k"))
    answer = join_sizes(grouped, smallest, ["root"], places, "k").join(links, "id", "left")
    answer = answer.select("h1", "h2", "m", "class_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    alone = F.col("id").isNull() | (F.col("n") == 0)
    linking = join_sizes(rows.where(~alone).select("id", "h1", "h2", "n"), answer, ["h1", "h2"], rows.count(), "m").select("id", "class_id", "n_links", "n")
    single = rows.where(alone).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n")
    return linking.unionByName(single).select(F.col("id").alias(key), "class_id", "n_links", F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class, that of the smallest key; columns stay.

    Rows that repeat a key stay together: they are one document.
    """
    links = jaccard_links(docs, threshold, key)
    gone = links.where(F.col("class_id") != F.col(key)).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
