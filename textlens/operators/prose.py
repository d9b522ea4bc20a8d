"""Markdown as prose: the column ``prose`` that every analysis reads instead of ``text``.

The scanner yields ranges alone, in bytes. They become rows, a window merges those that
overlap or touch, and the text is blanked by column expressions over its merged ranges;
no text comes back from Python. Documents are read twice and meet their ranges by their
row number (see ``annotate`` on inputs that change their order).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import markdown
from . import annotate
from .annotate import ROW, numbered


@F.pandas_udf(StringType())
def mask_markdown(texts: pd.Series) -> pd.Series:
    """One text's mask, for use as a function in SQL; ``prose`` is the plan for whole tables."""
    return pd.Series([None if t is None else markdown.mask(t) for t in texts])


def _bytes_of_chars(text: str) -> np.ndarray | range:
    """The byte at which each character (and the end) stands."""
    if text.isascii():
        return range(len(text) + 1)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(sizes)])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the last, the text, for each range that is found in it; a batch for each slice of texts."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for lo, hi in annotate.slices(texts, annotate.SIZE):
            of, start, end, parts = [], [], [], []
            for i in range(lo, hi):
                text = texts[i].as_py()
                masks = markdown.found(text) if text else []
                at = _bytes_of_chars(text) if masks else []
                for s, e, p in masks:
                    of.append(i)
                    start.append(int(at[s]))
                    end.append(int(at[e]))
                    parts.append(p)
            if of:
                kept = [batch.column(k).take(pa.array(of)) for k in range(batch.num_columns - 1)]
                found = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(parts, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*kept, *found], [*batch.schema.names[:-1], "start", "end", "parts"])


def merged(ranges: DataFrame, keep: list[str]) -> DataFrame:
    """Row number, ``keep``, start, end and parts of the union of a document's ``ranges``; parts where any of them parts.

    A range begins a piece of the union where it starts behind the furthest end so far.
    One exchange by the row number; a document of any number of ranges is a sorted stream.
    """
    order = Window.partitionBy(ROW).orderBy("start", "end")
    furthest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = ranges.select("*", F.coalesce(F.col("start") > furthest, F.lit(True)).alias("_apart"))
    pieces = apart.select("*", F.count_if("_apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_piece"))
    union = pieces.groupBy(ROW, "_piece").agg(*[F.first(c).alias(c) for c in keep], F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("parts").alias("parts"))
    return union.drop("_piece")


def mask_ranges(docs: DataFrame, keep: list[str] | None = None, format: str = "format") -> DataFrame:
    """Row number, ``keep`` (doc_id unless given), start, end (UTF-8 bytes) and parts of what isn't prose in ``text``.

    A range that parts stands for a block: what is before it and behind it is no one
    sentence. Ranges of a document neither overlap nor touch. Null, empty and plain texts
    have none; a text that isn't UTF-8 counts as null; an empty table gives no row.
    """
    keep = ["doc_id"] if keep is None else keep
    docs = numbered(docs).where(F.col(format) == "markdown").select(ROW, *keep, F.when(F.is_valid_utf8("text"), F.col("text")).alias("_text"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in docs.columns[:-1]], "start int, end int, parts boolean"])
    return merged(docs.mapInArrow(_scanned, schema), keep)


def _blanked(part: Column, parts: Column) -> Column:
    """``part`` in blanks of as many bytes and UTF-16 units, line breaks as they are; if it parts, its first ASCII place is a full stop."""
    blank = F.regexp_replace(part, r"[\x00-\x7f&&[^\r\n]]", " ")
    for wide, by in ((r"[\x{10000}-\x{10ffff}]", "\u00a0\u00a0"), (r"[\x{80}-\x{7ff}]", "\u00a0"), (r"[\x{800}-\x{ffff}]", "\u3000")):
        blank = F.regexp_replace(blank, wide, by)
    return F.when(parts, F.regexp_replace(blank, r"^([^ ]*+) ", "$1.")).otherwise(blank)


def _masked(raw: Column, ranges: str) -> Column:
    """The text of the bytes ``raw`` with its merged, sorted ``ranges`` blanked."""
    text = lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8")

    def piece(r: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(ranges, i - 1)["end"]).otherwise(0)
        return F.concat(text(before, r["start"]), _blanked(text(r["start"], r["end"]), r["parts"]))

    behind = text(F.coalesce(F.try_element_at(ranges, F.lit(-1))["end"], F.lit(0)), F.octet_length(raw))
    return F.concat(F.array_join(F.transform(ranges, piece), ""), behind)


def prose(docs: DataFrame, format: str = "format") -> DataFrame:
    """docs (numbered) with ``prose``: the text, masked where ``format`` is markdown.

    Offsets, lines and columns of a masked text are those of its source: the lengths in
    bytes and UTF-16 units are checked for every text, and a mask that broke them
    would leave ``prose`` null. Plain rows reach neither Python nor an exchange;
    Markdown texts meet their ranges in a join by the row number.
    """
    docs = numbered(docs)
    plain = F.coalesce(F.col(format) != "markdown", F.lit(True))
    ranges = annotate.grouped(mask_ranges(docs, [], format), ["start", "end", "parts"], "_ranges").withColumnRenamed(ROW, "_ranges_of")
    marked = docs.where(~plain).join(ranges, F.col(ROW) == F.col("_ranges_of"), "left")
    marked = marked.withColumn("_masked", F.when(F.col("_ranges").isNull(), F.col("text")).otherwise(_masked(F.encode("text", "UTF-8"), "_ranges")))
    units = lambda c: F.octet_length(F.encode(c, "UTF-16BE"))
    kept = (F.octet_length("_masked") == F.octet_length("text")) & (units(F.col("_masked")) == units(F.col("text")))
    marked = marked.select(*docs.columns, F.when(kept, F.col("_masked")).alias("prose"))
    return docs.where(plain).withColumn("prose", F.col("text")).unionByName(marked)
