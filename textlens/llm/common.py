"""Shared building blocks: lineage cuts, connected components, blocked pair work."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder that the whole cluster shares.

    The folder is the session's ``spark.checkpoint.dir``; only a local session
    without that setting gets a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="textlens-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def exploded(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """``keep`` and a row for each non-null element of ``array``.

    The outer form, since for the plain one the optimizer adds a filter on the
    array's size, which evaluates the whole array a second time.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges(u, v)``; component is its smallest node.

    Alternating large-star and small-star rounds: every round is two aggregates
    and two equi-joins, no group is ever collected, and only one scalar (how many
    edges changed) reaches the driver. The fixed point is a round that changes none.
    A component's smallest node is the hub of its edges; the join on it is left to AQE.
    """
    hi, lo = F.greatest("u", "v"), F.least("u", "v")
    e = cut(edges.where("u <> v").select(hi.alias("u"), lo.alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        changed = new.join(e, ["u", "v"], "left_anti").limit(1).count() + e.join(new, ["u", "v"], "left_anti").limit(1).count()
        e = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def join_sizes(rows: DataFrame, sizes: DataFrame, keys: list[str], n: int, size: str = "size", spread: str = "id", least: int = 64) -> DataFrame:
    """``rows`` inner-joined on ``keys`` with ``sizes``, which has one row a key and how many of at most ``n`` rows hold it.

    A key of more rows than a 100,000th of all (and than ``least``) is dealt over
    several tasks by a hash of ``spread``, so none gets a whole hot key. There are at
    most 100,000 such keys at any ``n``, which bounds what is broadcast.
    """
    most = max(least, n // 100_000)
    parts = F.ceil(F.col(size) / F.lit(most)).cast("int")
    hot = sizes.where(F.col(size) > most).select(*keys, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread, F.lit(23)), F.col("_parts")).cast("int"), F.lit(0)))
    salted = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > most, parts - 1).otherwise(0))))
    return dealt.drop("_parts").join(salted, [*keys, "_salt"]).drop("_salt")


def text_slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``size`` bytes, one row at least."""
    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, "right")))
        yield lo, hi
        lo = hi


def fixed_binary(column: pa.Array, dtype: str) -> np.ndarray:
    """A binary column whose values all have one length, as a matrix; no copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0), dtype)
    offsets, data = _offsets(column)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(column), -1)


def ragged_binary(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a binary column holding arrays of ``dtype``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, dtype), np.zeros(1, np.int64)
    offsets, data = _offsets(column)
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(dtype) if data is not None else np.empty(0, dtype)
    return values, (offsets - offsets[0]) // np.dtype(dtype).itemsize


def _offsets(column: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, buffers[2]


def forest(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (node, root) of a block's links: each node with the smallest id it reaches here."""
    most = np.iinfo(np.int64).max
    if right is None:
        label = left.copy()
        while True:
            new = np.minimum(label, np.where(adjacent, label[None, :], most).min(1, initial=most))
            if (new == label).all():
                break
            label = new
        changed = label != left
        return left[changed], label[changed]
    a, b = left.copy(), right.copy()
    while True:
        a2 = np.minimum(a, np.where(adjacent, b[None, :], most).min(1, initial=most))
        b2 = np.minimum(b, np.where(adjacent, a2[:, None], most).min(0, initial=most))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    node, root = np.concatenate([left, right]), np.concatenate([a, b])
    changed = node != root
    return node[changed], root[changed]


Kernel = Callable[[int, dict, np.ndarray, np.ndarray], Iterator[dict]]


def block_pairs(
    rows: DataFrame,
    blocks: Column,
    load: Callable[[pa.Table], dict],
    kernel: Callable,
    schema: str,
    out: pa.Schema,
) -> DataFrame:
    """Compare the members of every group ``gid`` in bounded blocks.

    ``rows`` has gid and id; ``blocks`` is how many blocks a group is dealt into,
    by a hash of id. Every pair of blocks becomes a unit of its own, so a group of
    any size is spread over many tasks and no task holds more than two blocks.
    ``load`` turns a batch into arrays; ``kernel(gid, arrays, left, right)`` gets
    row ranges (right None: the block with itself) and yields result columns.
    """
    dealt = (
        rows.withColumn("nb", blocks.cast("int"))
        .withColumn("blk", F.pmod(F.xxhash64("id", F.lit(17)), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("ba", F.least("blk", "other"))
        .withColumn("bb", F.greatest("blk", "other"))
        .withColumn("side", F.when(F.col("blk") == F.col("ba"), 0).otherwise(1))
        .drop("nb", "blk", "other")
        .repartition("gid", "ba", "bb")
        .sortWithinPartitions("gid", "ba", "bb", "side", "id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, ("gid", "ba", "bb")):
            arrays = load(whole)
            gid, ba, bb, side = (whole.column(c).to_numpy() for c in ("gid", "ba", "bb", "side"))
            edge = np.flatnonzero((np.diff(gid) != 0) | (np.diff(ba) != 0) | (np.diff(bb) != 0)) + 1
            found = []
            for s, e in zip(np.r_[0, edge], np.r_[edge, len(gid)], strict=True):
                if e - s < 2:
                    continue
                if ba[s] == bb[s]:
                    found.extend(kernel(int(gid[s]), arrays, (s, e), None))
                else:
                    mid = s + int(np.searchsorted(side[s:e], 1))
                    if s < mid < e:
                        found.extend(kernel(int(gid[s]), arrays, (s, mid), (mid, e)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c.name] for f in found]), c.type) for c in out], schema=out)

    return dealt.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole consecutive groups; the last group of a batch waits for the next."""
    carry: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        whole = pa.concat_tables([carry, new]).combine_chunks() if carry is not None and len(carry) else new
        if not len(whole):
            continue
        last = np.ones(len(whole), bool)
        for k in keys:
            v = whole.column(k).to_numpy()
            last &= v == v[-1]
        cutoff = len(whole) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cutoff:
            yield whole.slice(0, cutoff).combine_chunks()
        carry = whole.slice(cutoff)
    if carry is not None and len(carry):
        yield carry.combine_chunks()
