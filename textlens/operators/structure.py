"""Outlines as edge tables: repeated ids, broken edges and cycles, for documents of any size.

Nodes are rows: row number, i (place in the document), node_id, start, end, children. An
edge is a row for each child; an id means the first node that has it. Nodes are packed
small in files and large in memory, so no side of a join is ever broadcast by its size.
Outlines that stand in one row are ``validate.outline_errors``'.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .annotate import ROW


def _error(i: Column, code: str | Column, path: Column, message: Column) -> list[Column]:
    return [i.alias("i"), (F.lit(code) if isinstance(code, str) else code).alias("code"), path.alias("path"), F.concat(F.lit("at "), path, F.lit(": "), message).alias("message")]


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def edges(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Row number, ``keep``, i, node_id, start, end of the parent, j and child; target (i, start, end) is null for a missing child."""
    found = nodes.select(ROW, *keep, "i", "node_id", "start", "end", F.posexplode("children").alias("j", "child"))
    firsts = nodes.groupBy(F.col(ROW).alias("_of"), F.col("node_id").alias("_id")).agg(F.min(F.struct("i", "start", "end")).alias("target"))
    return found.join(firsts.hint("merge"), (F.col(ROW) == F.col("_of")) & (F.col("child") == F.col("_id")), "left").drop("_of", "_id")


def repeated_nodes(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Row number, ``keep``, i, code, path, message of every node whose id came before."""
    nth = F.row_number().over(Window.partitionBy(ROW, "node_id").orderBy("i"))
    again = nodes.withColumn("_nth", nth).where("_nth > 1")
    return again.select(ROW, *keep, *_error(F.col("i"), "DuplicateNodeId", _text("structure[", F.col("i"), "]"), _text("duplicate nodeId ", F.col("node_id"))))


def broken_edges(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Row number, ``keep``, i, j, code, path, message: missing children, children of two parents or outside their parent's range."""
    e = edges(nodes, keep)
    owner = F.first(F.when(F.col("target").isNotNull(), F.col("node_id")), ignorenulls=True).over(Window.partitionBy(ROW, "child").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    e = e.withColumn("_owner", owner)
    path, child, parent = _text("structure[", F.col("i"), "].childNodeIds[", F.col("j"), "]"), F.col("child"), F.col("node_id")
    known = F.col("target").isNotNull()
    rules = [
        (~known, "DanglingChildRef", _text("references missing child ", child)),
        (known & (F.col("_owner") != parent), "MultipleStructureParents", _text("child ", child, " already belongs to parent ", F.col("_owner"), ", not ", parent)),
        (known & ((F.col("target.start") < F.col("start")) | (F.col("target.end") > F.col("end"))), "ChildRangeOutsideParent", _text("child ", child, " falls outside parent ", parent)),
    ]
    found = F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), text.alias("text"))) for when, code, text in rules])
    e = e.select(ROW, *keep, "i", "j", path.alias("_path"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_e"))
    return e.select(ROW, *keep, "j", *_error(F.col("i"), F.col("_e.code"), F.col("_path"), F.col("_e.text")))


def _walk(edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The edges (i, j) that close a cycle, of edges (i, j, target) walked in their order."""
    kids: dict[int, list[tuple[int, int]]] = {}
    for i, j, to in sorted(edges):
        kids.setdefault(i, []).append((j, to))
    closing, done, above = [], set(), set()
    for root in sorted(kids):
        if root in done:
            continue
        path = [(root, iter(kids[root]))]
        above.add(root)
        while path:
            node, rest = path[-1]
            step = next(((j, to) for j, to in rest if to not in done), None)
            if step is None:
                path.pop()
                above.discard(node)
                done.add(node)
            elif step[1] in above:
                closing.append((node, step[0]))
            else:
                above.add(step[1])
                path.append((step[1], iter(kids.get(step[1], []))))
    return closing


@F.pandas_udf(ArrayType(StructType().add("i", "integer").add("j", "integer")))
def _closing(found: pd.Series) -> pd.Series:
    return pd.Series([[{"i": i, "j": j} for i, j in _walk([(e["i"], e["j"], e["to"]) for e in own])] for own in found])


def closing_edges(nodes: DataFrame, keep: list[str], rounds: int = 2) -> DataFrame:
    """Row number, ``keep``, i, j, code, path, message of the edges that close a cycle in a walk by nodes and children in their order.

    An edge to a node without children can't lie on a cycle. ``rounds`` frontier rounds
    drop those edges by anti joins, over all documents at once: nothing is left of an
    outline as deep as that or less (a sound one is two levels deep). What is left of
    the others, cycles and what leads to them, is walked document by document.
    """
    e = edges(nodes, []).where("target IS NOT NULL").select(ROW, "i", "j", F.col("target.i").alias("to"))
    for _ in range(rounds):
        inner = e.select(F.col(ROW).alias("_of"), F.col("i").alias("_i")).distinct()
        e = e.join(inner.hint("merge"), (F.col(ROW) == F.col("_of")) & (F.col("to") == F.col("_i")), "left_semi")
    left = e.groupBy(ROW).agg(F.collect_list(F.struct("i", "j", "to")).alias("edges"))
    closing = left.select(ROW, F.inline(_closing("edges")))
    parents = nodes.select(F.col(ROW).alias("_of"), F.col("i").alias("_i"), *keep, "node_id", "children")
    closing = closing.join(parents.hint("merge"), (F.col(ROW) == F.col("_of")) & (F.col("i") == F.col("_i")))
    path = _text("structure[", F.col("i"), "].childNodeIds[", F.col("j"), "]")
    text = _text("edge ", F.col("node_id"), " -> ", F.get("children", F.col("j")), " closes a structure cycle")
    return closing.select(ROW, *keep, "j", *_error(F.col("i"), "StructureCycle", path, text))
