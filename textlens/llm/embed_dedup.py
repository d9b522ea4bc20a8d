"""Near-duplicate embeddings through a pivot-permutation index.

Reference vectors (pivots) are a bounded, spread-out sample. A vector is described
by its ``PREFIX`` nearest pivots. Inverted lists are kept per set of ``SHARED``
pivots, so two vectors meet exactly when their descriptions share that many; the
pair is counted in the list of its smallest shared pivots alone, and verified by
cosine in double precision. Pairs that share fewer are missed: measured recall is in
the README. Four times the vectors get twice the pivots and one more in each prefix,
so that lists keep their length and recall its level. Vectors of a length that the sample doesn't have, and all of them when it
is too alike to give pivots, are described by random pivots instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, cut, fixed_binary, forest, join_sizes

#: Pivots and length of a prefix for up to ``VECTORS`` vectors, and the most pivots.
PIVOTS = 512
PREFIX = 6
VECTORS = 100_000
MOST_PIVOTS = 4096
SHARED = 2
#: Rows that the pivots are picked from (chosen by a hash of their vector), or four a pivot if that is more.
SAMPLE = 4096
#: Vectors in a block, about.
BLOCK = 400


def setting(vectors: int) -> tuple[int, int]:
    """(pivots, length of a prefix) for a number of distinct vectors."""
    pivots, prefix, room = PIVOTS, PREFIX, VECTORS
    while room < vectors and pivots < MOST_PIVOTS:
        pivots, prefix, room = 2 * pivots, prefix + 1, 4 * room
    return pivots, prefix


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in doubles; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, u, v): u the numbers as they are, v the unit vector as doubles; null where it can't link."""
    for batch in batches:
        arrays = batch.column(1)
        kind = np.float32 if pa.types.is_float32(arrays.type.value_type) else np.float64
        n = len(arrays)
        lengths = np.nan_to_num(arrays.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out: list[bytes | None] = [None] * n
        plain: list[bytes | None] = [None] * n
        for d in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == d)
            x = flat[starts[rows][:, None] + np.arange(d)]
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x = x[good] + 0.0  # -0.0 becomes 0.0
            for row, raw, v in zip(rows[good], x.astype(kind), _unit(x), strict=True):
                plain[row], out[row] = raw.tobytes(), v.tobytes()
        dim = pa.array([None if v is None else len(v) // 8 for v in out], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), dim, pa.array(plain, pa.binary()), pa.array(out, pa.binary())], ["vec_id", "dim", "u", "v"])


def pick_pivots(vectors: np.ndarray, count: int = PIVOTS, apart: float = 0.8) -> np.ndarray:
    """The first vectors that are not within cosine ``apart`` of one chosen before."""
    chosen, k = np.empty((count, vectors.shape[1])), 0
    for v in vectors:
        if k == count:
            break
        if not k or (chosen[:k] @ v).max() < apart:
            chosen[k] = v
            k += 1
    return chosen[:k]


def _random_pivots(d: int, count: int = PIVOTS) -> np.ndarray:
    x = np.random.default_rng([11, d]).standard_normal((count, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Identical vectors are collapsed first and count as links of each other. Vectors
    that are null, empty, zero or hold null or non-finite numbers link with nothing,
    as do rows with a null key (component_id null, kept false); vectors of different
    lengths never link. Repeated keys count as rows of their own. Blocks bound the
    memory of a task; no pair reaches a shuffle, only per-block counts and spanning
    edges do. Other columns are not read.
    """
    single = dict(vectors.dtypes)[vector] == "array<float>"
    real = np.float32 if single else np.float64
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("e"))
    parsed = rows.mapInArrow(_parsed, "vec_id long, dim int, u binary, v binary")
    parsed = cut(parsed.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")))
    usable = parsed.where("v IS NOT NULL AND vec_id IS NOT NULL")
    # a class of equal vectors is known by its hash, since a key may repeat over different vectors
    classes = usable.groupBy("h1", "h2", "dim").agg(F.count(F.lit(1)).alias("m"), F.first("u").alias("u"), F.first("v").alias("v")).withColumn("id", F.col("h1"))

    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    pivots: dict[int, np.ndarray] = {}
    count, length = setting(common[0]["count"] if common else 0)
    if common:
        d = common[0]["dim"]
        sample = classes.where(F.col("dim") == d).orderBy(F.xxhash64("h1"), "id").limit(max(SAMPLE, 4 * count)).select("v").toPandas()
        pivots[d] = pick_pivots(np.stack([np.frombuffer(v) for v in sample["v"]]), count)
    sets = np.array(list(combinations(range(length), SHARED)))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            raw = batch.column(batch.schema.get_field_index("v")).to_pylist()
            prefix = np.empty((len(raw), length), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                p = pivots.get(d)
                p = p if p is not None and len(p) >= 4 * length else _random_pivots(int(d), count)  # too few, or a rarer length
                near = np.stack([np.frombuffer(raw[i]) for i in at]) @ p.T
                prefix[at] = np.argpartition(-near, length - 1, axis=1)[:, :length]
            prefix.sort(1)
            picked = prefix[:, sets]
            keys = (dims[:, None].astype(np.int64) * count + picked[:, :, 0]) * count + picked[:, :, 1]
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
            narrow = pa.array([row.tobytes() for row in prefix.astype(np.uint16)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(batch.schema.get_field_index("u")), narrow, lists], ["id", "m", "u", "p", "gids"])

    index = cut(classes.select("id", "m", "u", "v", "dim").mapInArrow(described, "id long, m long, u binary, p binary, gids array<long>"))
    postings = index.select("id", F.explode("gids").alias("gid"))
    sizes = postings.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = postings.join(sizes, "gid").join(index.select("id", "m", "u", "p"), "id").select("gid", "n", "id", "m", "u", "p")

    def load(t: pa.Table) -> dict:
        dims = t.column("gid").to_numpy() // count**SHARED
        u = t.column("u").combine_chunks()
        if len(np.unique(dims)) == 1:
            vectors = _unit(fixed_binary(u, np.dtype(real).str[1:]))
        else:
            vectors = [_unit(np.frombuffer(x, real)[None])[0] for x in u.to_pylist()]
        return {"id": t.column("id").to_numpy(), "m": t.column("m").to_numpy(), "v": vectors, "p": fixed_binary(t.column("p"), "u2")}

    def kernel(gid: int, a: dict, left: tuple, right: tuple | None) -> Iterator[dict]:
        first, second = gid // count % count, gid % count
        right, alone = right or left, right is None
        (v, p, ids, m), (v2, p2, ids2, m2) = ([a[c][slice(*side)] for c in ("v", "p", "id", "m")] for side in (left, right))
        linked = np.stack(v) @ np.stack(v2).T >= threshold
        if alone:
            np.fill_diagonal(linked, False)
        x, y = np.nonzero(linked)
        for lo in range(0, len(x), 50_000):  # not here, if they share a pivot below the list's second besides its first
            i, j = x[lo : lo + 50_000], y[lo : lo + 50_000]
            earlier = (p[i] < second) & (p[i] != first)
            linked[i, j] = ~((p[i][:, :, None] == p2[j][:, None, :]).any(2) & earlier).any(1)
        if not linked.any():
            return
        if alone:
            counts, who = linked @ m, ids
            node, root = forest(linked, ids, None)
        else:
            counts, who = np.concatenate([linked @ m2, linked.T @ m]), np.concatenate([ids, ids2])
            node, root = forest(linked, ids, ids2)
        some = counts > 0
        zero = np.zeros(len(node), np.int64)
        yield {"id": np.concatenate([who[some], node]), "links": np.concatenate([counts[some], zero]), "root": np.concatenate([who[some], root])}

    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    found = cut(block_pairs(members, F.ceil(F.col("n") / F.lit(BLOCK)), load, kernel, "id long, links long, root long", schema))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    classes = usable.groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m")).withColumn("id", F.col("h1"))
    total = parsed.count()
    grouped = cut(classes.join(component, classes["id"] == component["node"], "left").select(classes["*"], F.coalesce("component", "id").alias("root")))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    answer = join_sizes(grouped, smallest, ["root"], total, "k").join(links, "id", "left")
    answer = answer.select("h1", "h2", "dim", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    alone = F.col("v").isNull() | F.col("vec_id").isNull()
    linking = join_sizes(parsed.where(~alone).select("vec_id", "h1", "h2", "dim"), answer, ["h1", "h2", "dim"], total, "m", "vec_id").select("vec_id", "n_links", "component_id")
    single = parsed.where(alone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linking.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
