"""Presentation: roles, ANSI, editor tokens and diagnostics, highlight spans, outline, reports.

All of it follows from token rows by windows and groups; results of a whole document are
grouped by its row number and put together by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexer as L
from ..functions import text as T
from ..functions import vocabulary as V
from . import annotate
from .annotate import ROW, analysed, grouped, numbered, with_rows


def role_table(spark) -> DataFrame:
    return spark.createDataFrame(V.ROLES, "role string, ansi string, token_type string, highlight string")


def with_roles(tokens: DataFrame) -> DataFrame:
    """Tokens with the three presentations of their role (a fixed table of ten rows, broadcast)."""
    return tokens.join(F.broadcast(role_table(tokens.sparkSession)), "role", "left")


def roles_of_axes(tokens: DataFrame) -> DataFrame:
    """``role`` from token_kind, lexical_class and open_axis alone; null where no rule covers them."""
    rules = tokens.sparkSession.createDataFrame(V.AXES, "_kind string, _class string, _open string, role string")
    same = F.col("token_kind").eqNullSafe(F.col("_kind")) & F.col("lexical_class").eqNullSafe(F.col("_class")) & F.col("open_axis").eqNullSafe(F.col("_open"))
    return tokens.drop("role").join(F.broadcast(rules), same, "left").drop("_kind", "_class", "_open")


def shown(t: L.Texts) -> np.ndarray:
    """Tokens that may have a role which editors style: numbers, quotes, capitals of names and words of the two lexicons. No other leaves the lexer."""
    words = [w for w, _ in [*V.CLOSED_ROWS, *V.OPEN_ROWS]]
    return (t.kind == L.NUMBER) | (t.kind == L.QUOTED) | t.guarded | t.among(words, straight=True)


def shown_or_muted(t: L.Texts) -> np.ndarray:
    """``shown`` and marks."""
    return shown(t) | (t.kind == L.PUNCT) | (t.kind == L.STOP)


def role_counts(tokens: DataFrame) -> DataFrame:
    return with_roles(tokens.groupBy("role").agg(F.count(F.lit(1)).alias("n"))).select("role", "n", "ansi", "token_type", "highlight")


def per_row(df: DataFrame, keep: list[str], read: list[str], schema: str, rows: Callable[..., list[tuple]]) -> DataFrame:
    """``keep`` with each tuple that ``rows`` gives for the ``read`` values of a row."""
    source = df.select(*keep, *[F.col(c).alias(f"_{i}") for i, c in enumerate(read)])
    kinds = dict(source.dtypes)
    whole = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], schema])
    fields = [f.strip() for f in schema.split(",")]
    types = pa.schema([(f.split()[0], {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]]) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(len(keep) + i) for i in range(len(read))]
            for i in range(batch.num_rows):
                found = rows(*(c[i].as_py() for c in columns))
                if found:
                    kept = [batch.column(k).take(pa.array([i] * len(found))) for k in range(len(keep))]
                    own = [pa.array([f[j] for f in found], t.type) for j, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([*kept, *own], [*keep, *types.names])

    return source.mapInArrow(run, whole)


def _of_documents(docs: DataFrame, rows: DataFrame, keep: list[str], name: str, empty: str) -> DataFrame:
    """``keep`` and the column ``name`` of ``rows`` (one a document) for all documents; those without one get an empty ``empty``."""
    return docs.join(rows, ROW, "left").select(*keep, F.coalesce(name, F.array().cast(empty)).alias(name))


def ansi(docs: DataFrame, color: bool = True, key: str = "doc_id") -> DataFrame:
    """key, colored: styled tokens between escape codes, gaps verbatim; null stays null.

    Without ``color`` the text is returned as it is and nothing is analysed. Tokens
    that stand in masked Markdown are never styled.
    """
    if not color:
        return docs.select(key, F.col("text").alias("colored"))
    docs = numbered(docs)
    styled = with_roles(with_rows(docs, [], ["start", "end", "lexeme", "role"], only=shown_or_muted)).where("ansi IS NOT NULL")
    # a token is styled where it is a row, in compiled code; what is left for the whole document are the gaps
    styled = styled.withColumn("styled", F.concat(F.lit("\x1b["), "ansi", F.lit("m"), "lexeme", F.lit("\x1b[0m")))
    spans = grouped(styled, ["start", "end", "styled"], "spans")
    raw = docs.select(ROW, key, F.encode("text", "UTF-8").alias("_raw"), F.encode(analysed(docs), "UTF-8").alias("_seen"))
    found = _of_documents(raw, spans, [key, "_raw", "_seen"], "spans", "array<struct<start:int,end:int,styled:string>>")
    cut = lambda bytes_, a, b: F.substring(bytes_, a + 1, b - a)
    own = F.filter("spans", lambda s: cut(F.col("_raw"), s["start"], s["end"]) == cut(F.col("_seen"), s["start"], s["end"])) if "prose" in docs.columns else F.col("spans")
    plain = lambda a, b: cut(F.col("_raw"), a, b).cast("string")

    def piece(s: Column, i: Column) -> Column:
        return F.concat(plain(F.when(i > 0, F.get("_own", i - 1)["end"]).otherwise(0), s["start"]), s["styled"])

    rest = plain(F.coalesce(F.try_element_at("_own", F.lit(-1))["end"], F.lit(0)), F.octet_length("_raw"))
    return found.withColumn("_own", own).select(key, F.concat(F.array_join(F.transform("_own", piece), ""), rest).alias("colored"))


#: A styled token, or what stands between two.
_STYLED = r"\x1b\[[0-9;]+m[^\x1b]*+\x1b\[0m|[^\x1b]++|\x1b"


def ansi_spans(colored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, end (UTF-8 bytes of the plain text), ansi, lexeme: ``ansi`` undone.

    Pieces become rows, and a piece starts where a running sum of the plain bytes before
    it stands. Texts with escape characters of their own can't be told apart.
    """
    part = lambda i: F.regexp_extract("_piece", r"^\x1b\[([0-9;]+)m([^\x1b]*+)\x1b\[0m$", i)
    pieces = numbered(colored).select(ROW, key, F.posexplode(F.regexp_extract_all("colored", F.lit(_STYLED), F.lit(0))).alias("_n", "_piece"))
    pieces = pieces.select(ROW, key, "_n", part(1).alias("ansi"), F.when(part(1) != "", part(2)).otherwise(F.col("_piece")).alias("lexeme"))
    before = F.sum(F.octet_length("lexeme")).over(Window.partitionBy(ROW).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("start", F.coalesce(before, F.lit(0)).cast("int")).where("ansi <> ''")
    return pieces.select(key, "start", (F.col("start") + F.octet_length("lexeme")).alias("end"), "ansi", "lexeme")


def code(text: Column) -> Column:
    """Markdown code of a text within a table cell: a fence longer than its own backticks."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    pad = F.when(text.startswith("`") | text.endswith("`"), " ").otherwise("")
    return F.replace(F.when(text.contains("`"), F.concat(fence, pad, text, pad, fence)).otherwise(F.concat(F.lit("`"), text, F.lit("`"))), F.lit("|"), F.lit("\\|"))


# Fixed value: the head of a span report.
REPORT_HEAD = "# Highlight spans\n\n| UTF-8 bytes | Text | Role |\n| --- | --- | --- |\n"


def report_line(x: Callable[[str], Column]) -> Column:
    """The line of a span report; ``x`` gives a span's start, end, lexeme and role."""
    place = F.concat(x("start").cast("string"), F.lit(".."), x("end").cast("string"))
    return F.concat(F.lit("| `"), place, F.lit("` | "), code(x("lexeme")), F.lit(" | `"), x("role"), F.lit("` |\n"))


def report_of(spans: Column) -> Column:
    """The Markdown table of spans (start, end, lexeme, role), in their order."""
    return F.concat(F.lit(REPORT_HEAD), F.array_join(F.transform(spans, lambda x: report_line(lambda c: x[c])), ""))


#: Roles that editors style.
EDITED = [r for r, _, t, _ in V.ROLES if t]


def span_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, report: the spans that editors style, one text a document."""
    docs = numbered(docs)
    # lines are written where tokens are rows, in compiled code
    rows = with_rows(docs, [], ["start", "end", "lexeme", "role"], only=shown).where(F.col("role").isin(EDITED)).withColumn("line", report_line(F.col))
    found = _of_documents(docs, grouped(rows, ["start", "line"], "spans"), [key], "spans", "array<struct<start:int,line:string>>")
    return found.select(key, F.concat(F.lit(REPORT_HEAD), F.array_join("spans.line", "")).alias("report"))


def highlight_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, class, row, col and end_col (scalars); unstyled tokens dropped."""
    out = with_roles(with_rows(docs, [key], ["pos", "role", "row", "col", "end_col"], only=shown)).where("highlight IS NOT NULL")
    return out.select(key, "pos", F.col("highlight").alias("class"), "row", "col", "end_col")


def highlight_bundles(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, bundle: one JSON text a document with its class spans, pretty-printed."""
    docs = numbered(docs)
    columns = ["start", "highlight", "row", "col", "end_col"]
    rows = with_roles(with_rows(docs, [], ["start", "role", "row", "col", "end_col"], only=shown)).where("highlight IS NOT NULL")
    found = _of_documents(docs, grouped(rows, columns, "spans"), [key], "spans", "array<struct<start:int,highlight:string,row:int,col:int,end_col:int>>")
    point = lambda row, column: F.format_string('{\n            "row": %d,\n            "column": %d\n          }', row, column)
    span = lambda s: F.concat(
        F.lit('\n      {\n        "className": "'), s["highlight"], F.lit('",\n        "range": {\n          "start": '), point(s["row"], s["col"]), F.lit(',\n          "end": '), point(s["row"], s["end_col"]), F.lit("\n        }\n      }")
    )
    body = F.when(F.size("spans") == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(F.transform("spans", span), ","), F.lit("\n    ]")))
    return found.select(key, F.concat(F.lit('{\n  "syntax": {\n    "partial": false,\n    "spans": '), body, F.lit("\n  }\n}\n")).alias("bundle"))


def _deltas(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Row number, ``keep``, pos, delta_line, delta_start, length, type, modifiers of the tokens that editors style."""
    rows = with_roles(with_rows(docs, keep, ["pos", "role", "row", "col16", "len16"], only=shown)).where("token_type IS NOT NULL")
    last = lambda c: F.coalesce(F.lag(c).over(Window.partitionBy(ROW).orderBy("pos")), F.lit(0))
    rows = rows.select("*", last("row").alias("_row_before"), last("col16").alias("_col_before"))
    line = F.col("row") - F.col("_row_before")
    start = F.col("col16") - F.when(line == 0, F.col("_col_before")).otherwise(0)
    kind = F.array_position(F.array(*[F.lit(t) for t in V.LEGEND]), F.col("token_type")) - 1
    return rows.select(ROW, *keep, "pos", line.alias("delta_line"), start.alias("delta_start"), F.col("len16").alias("length"), kind.cast("int").alias("type"), F.lit(0).alias("modifiers"))


def token_deltas(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Editor tokens as (delta line, delta start, UTF-16 length, type, modifiers), a row each."""
    return _deltas(docs, [key]).drop(ROW)


def editor_tokens(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and data: all deltas of a document in one array, five numbers a token."""
    docs = numbered(docs)
    five = ["delta_line", "delta_start", "length", "type", "modifiers"]
    rows = grouped(_deltas(docs, []).select(ROW, "pos", F.array(*five).alias("five")), ["pos", "five"], "all")
    return _of_documents(docs, rows.select(ROW, F.flatten("all.five").alias("data")), keep, "data", "array<int>")


def delta_spans(edited: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, start, end, row, col16, length, type: ``data`` over ``text`` undone to UTF-8 bytes.

    A place that the text doesn't have gives a row with null start and end.
    """
    from .places import bytes_of_units, positions

    edited = numbered(edited)
    tokens = positions(edited, [key])
    found = bytes_of_units(tokens, edited)
    return found.select(key, "n", "start", "end", "row", "col16", "length", "type")


def editor_diagnostics(docs: DataFrame, key: str = "doc_id", name: str = "textlens") -> DataFrame:
    """Findings as an editor shows them: ranges in UTF-16 units, WARNING or INFORMATION, code and source."""
    from .lint import placed_findings

    found = placed_findings(docs, keep=(key,))
    severity = F.when(F.col("severity") == "warning", "WARNING").otherwise("INFORMATION")
    return found.select(
        key, F.col("row").alias("start_line"), F.col("col16").alias("start_char"), F.col("end_row").alias("end_line"), F.col("end_col16").alias("end_char"),
        severity.alias("severity"), F.col("rule").alias("code"), F.lit(name).alias("source"), "message",
    )


def failure(code: str, message: str | Column, severity: str = "ERROR", name: str = "textlens") -> list[Column]:
    """One stable diagnostic at the start of a document, for results that can't be trusted.

    Codes: invalid-classification, invalid-source-view, document-too-large, analysis-failed.
    """
    zero = [F.lit(0).alias(c) for c in ("start_line", "start_char", "end_line", "end_char")]
    text = message if isinstance(message, Column) else F.lit(message)
    return [*zero, F.lit(severity).alias("severity"), F.lit(f"{name}/{code}").alias("code"), F.lit(name).alias("source"), text.alias("message")]


NODE = "node_id int, kind string, depth int, start int, end int, children array<int>"


def outline(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the nodes of the outline; sentences part at a gap of two line breaks or more."""
    return outline_rows(docs, [key]).drop(ROW)


def outline_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Row number, ``keep`` and the outline: paragraphs are numbered first, then sentences.

    A paragraph number is a running count of the gaps that part paragraphs.
    """
    s = annotate.sentences(docs, keep, breaks=True)
    order = Window.partitionBy(ROW).orderBy("sent_id")
    parted = ((F.col("breaks") >= 2) & (F.col("sent_id") > 0)).cast("int")
    s = s.select("*", F.sum(parted).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int").alias("_par"))
    s = s.select("*", (F.max("_par").over(Window.partitionBy(ROW)) + 1 + F.col("sent_id")).alias("node_id"))
    own = ["node_id", "kind", "depth", "start", "end", "children"]
    lower = s.select(ROW, *keep, "node_id", F.lit("SENTENCE").alias("kind"), F.lit(1).alias("depth"), "start", "end", F.array().cast("array<int>").alias("children"))
    upper = s.groupBy(ROW, F.col("_par").alias("node_id")).agg(*[F.first(c).alias(c) for c in keep], F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list("node_id")).alias("children"))
    return lower.unionByName(upper.withColumns({"kind": F.lit("PARAGRAPH"), "depth": F.lit(0)}).select(ROW, *keep, *own))


def with_outline(docs: DataFrame, keep: list[str], contextual: bool = True, once: bool = False) -> DataFrame:
    """``keep``, tokens and outline as the interchange format has them, a row for each document, without an exchange.

    Texts are cut once; the outline is read off a document's sentences, whose number is a
    twelfth of its tokens'.
    """
    return _outlined(annotate.whole(docs, keep, contextual, once), [*keep, "tokens"])


def outlines(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``with_outline`` without tokens."""
    return _outlined(annotate.sentence_lists(docs, keep), keep)


def _outlined(sents: DataFrame, keep: list[str]) -> DataFrame:
    sents = sents.withColumnRenamed("sentences", "_s")
    # places of the sentences that begin a paragraph
    heads = F.filter(F.transform("_s", lambda s, i: F.when((i == 0) | (s["breaks"] >= 2), i)), lambda i: i.isNotNull())
    sents = sents.withColumn("_heads", heads).withColumn("_pars", F.size("_heads"))

    def node(node_id: Column, kind: str, depth: int, start: Column, end: Column, children: Column) -> Column:
        span = F.struct(end.alias("endUtf8"), start.alias("startUtf8"))
        return F.struct(span.alias("byteRange"), children.cast("array<int>").alias("childNodeIds"), F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), node_id.cast("int").alias("nodeId"))

    def paragraph(first: Column, p: Column) -> Column:
        last = F.coalesce(F.get("_heads", p + 1), F.size("_s")) - 1
        return node(p, "PARAGRAPH", 0, F.get("_s", first)["start"], F.get("_s", last)["end"], F.sequence(first + F.col("_pars"), last + F.col("_pars")))

    sentence = lambda s, i: node(i + F.col("_pars"), "SENTENCE", 1, s["start"], s["end"], F.array())
    return sents.select(*keep, F.concat(F.transform("_heads", paragraph), F.transform("_s", sentence)).alias("outline"))


def content_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, content_hash, bytes, fits (whether byte offsets fit 32 bits)."""
    size = F.octet_length("text")
    return docs.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), size.cast("long").alias("bytes"), (size <= 2147483647).alias("fits"))
