"""Places of offsets: what byte a UTF-16 position is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .annotate import ROW


def positions(edited: DataFrame, keep: list[str]) -> DataFrame:
    """Row number, ``keep``, n, row, col16, length, type of editor tokens (five numbers each in ``data``): deltas undone.

    A row is the running sum of the line deltas; a column that of the start deltas since
    the line changed last.
    """
    whole = F.filter(F.sequence(F.lit(0), F.greatest(F.floor(F.size("data") / 5).cast("int") - 1, F.lit(0))), lambda i: i < F.floor(F.size("data") / 5))
    five = F.transform(whole, lambda i: F.struct(i.cast("int").alias("n"), *[F.get("data", i * 5 + k).alias(c) for k, c in enumerate(("down", "right", "length", "type"))]))
    rows = edited.select(ROW, *keep, F.inline(five))
    so_far = Window.partitionBy(ROW).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.sum("down").over(so_far).alias("row"), F.sum("right").over(so_far).alias("_right"))
    jumped = F.when((F.col("down") != 0) | (F.col("n") == 0), F.col("_right") - F.col("right"))
    rows = rows.select("*", F.last(jumped, ignorenulls=True).over(so_far).alias("_base"))
    return rows.select(ROW, *keep, "n", F.col("row").cast("int").alias("row"), (F.col("_right") - F.col("_base")).cast("int").alias("col16"), "length", "type")


def lines_in_units(docs: DataFrame) -> DataFrame:
    """Row number, row, unit and room of each line of ``text``: its first UTF-16 unit, and how many it has without its break."""
    pieces = F.split(F.coalesce("text", F.lit("")), r"(?<=\n)|(?<=\r)(?!\n)", -1)
    line = F.transform(pieces, lambda x: F.struct(T.utf16_length(x).alias("size"), T.utf16_length(F.regexp_replace(x, r"[\r\n]+$", "")).alias("room")))
    rows = docs.select(ROW, F.posexplode_outer(line).alias("row", "_x"))
    before = F.sum("_x.size").over(Window.partitionBy(ROW).orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(ROW, "row", F.coalesce(before, F.lit(0)).cast("int").alias("unit"), F.col("_x.room").alias("room"))


def bytes_of_units(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """``spans`` (row, col16, length) with start and end, their UTF-8 bytes in ``text``; null beyond a line or inside a character.

    Positions become units of the whole text by a join on their line. A document's
    positions are then sorted once, the bytes between neighbours are measured slice by
    slice, and a running sum of those is the byte of each position: linear in the text.
    """
    kept = [c for c in spans.columns if c != ROW]
    lines = lines_in_units(docs).select(F.col(ROW).alias("_of"), F.col("row").alias("_line"), "unit", "room")
    found = spans.join(lines, (F.col(ROW) == F.col("_of")) & (F.col("row") == F.col("_line")), "left").drop("_of", "_line")
    fits = lambda c: F.when((F.col("col16") >= 0) & (c <= F.col("room")) & (c >= 0), F.col("unit") + c)
    found = found.withColumns({"_a": fits(F.col("col16")), "_b": fits(F.col("col16") + F.col("length"))})
    points = found.select(ROW, F.explode(F.array("_a", "_b")).alias("_p")).where("_p IS NOT NULL")
    points = points.groupBy(ROW).agg(F.sort_array(F.collect_set("_p")).alias("_points"))
    wide = docs.select(ROW, F.encode(F.coalesce("text", F.lit("")), "UTF-16BE").alias("_wide")).join(points.withColumnRenamed(ROW, "_of"), F.col(ROW) == F.col("_of")).drop("_of")
    low = lambda p: F.hex(F.substring("_wide", 2 * p + 1, F.lit(1))).between("DC", "DF")
    wide = wide.withColumn("_points", F.filter("_points", lambda p: ~low(p)))  # the second half of a pair is no place
    step = lambda p, i: F.struct(p.alias("_p"), F.octet_length(F.decode(F.substring("_wide", 2 * F.when(i > 0, F.get("_points", i - 1)).otherwise(0) + 1, 2 * (p - F.when(i > 0, F.get("_points", i - 1)).otherwise(0))), "UTF-16BE")).alias("_size"))
    sized = wide.select(ROW, F.inline(F.transform("_points", step)))
    byte = F.sum("_size").over(Window.partitionBy(ROW).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    sized = sized.select(F.col(ROW).alias("_of"), "_p", byte.alias("_byte"))
    for at, name in (("_a", "start"), ("_b", "end")):
        own = sized.select(F.col("_of"), F.col("_p"), F.col("_byte").alias(name))
        found = found.join(own, (F.col(ROW) == F.col("_of")) & (F.col(at) == F.col("_p")), "left").drop("_of", "_p")
    return found.select(ROW, *kept, "start", "end")
