"""Editing sessions: open, change and close events of documents, in batch and as a stream.

An event has uri, seq, kind ('open', 'change', 'close'), format, start_line,
start_char, end_line, end_char and text. Lines end at LF, CRLF or CR; characters are
UTF-16 units. A change without start_line replaces the whole text; positions beyond a
line or the text are clamped. Changes and closes of a document that isn't open are
ignored. Every open starts at generation 1 and every change adds one; what a session
shows is always its newest generation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import prose, render
from ..operators.annotate import ROW

EVENT = "uri string, seq long, kind string, format string, start_line int, start_char int, end_line int, end_char int, text string"
OUT = "uri string, generation int, format string, text string, open boolean"
STATE = "generation int, format string, text string"
#: Texts beyond this many UTF-8 bytes are kept but not analysed.
MAX_BYTES = 5 * 1024 * 1024
_BREAK = re.compile(r"\r\n|\r|\n")


def offset_of(text: str, line: int, character: int) -> int:
    """Index into ``text`` of a line and UTF-16 column, clamped to the line's end."""
    start, at = 0, 0
    for found in _BREAK.finditer(text):
        if at == line:
            break
        start, at = found.end(), at + 1
    end = _BREAK.search(text, start)
    content = text[start : end.start() if end else len(text)]
    units = 0
    for i, c in enumerate(content):
        if units >= character:
            return start + i
        units += 2 if ord(c) > 0xFFFF else 1
    return start + len(content)


def apply_change(text: str, span: tuple[int, int, int, int] | None, new: str) -> str:
    if span is None:
        return new
    start = offset_of(text, span[0], span[1])
    end = max(start, offset_of(text, span[2], span[3]))
    return text[:start] + new + text[end:]


def _step(state: tuple | None, e) -> tuple | None:
    """(generation, format, text) after an event; None where nothing is open."""
    new = e.text if isinstance(e.text, str) else ""
    if e.kind == "open":
        return 1, e.format if isinstance(e.format, str) else "plain", new
    if state is None or e.kind == "close":
        return None
    if e.kind != "change":
        return state
    places = (e.start_line, e.start_char, e.end_line, e.end_char)
    span = None if pd.isna(e.start_line) else tuple(0 if pd.isna(p) else int(p) for p in places)
    return state[0] + 1, state[1], apply_change(state[2], span, new)


def replay(events: DataFrame) -> DataFrame:
    """uri, generation, format, text of every document that is open in the end.

    Events are dealt out by uri and sorted; a task streams through them and holds one
    document at a time, however long its session is. Events without a uri are ignored.
    """
    names = [f.split()[0] for f in EVENT.split(", ")]
    dealt = events.where("uri IS NOT NULL").select(*names).repartition("uri").sortWithinPartitions("uri", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, state = None, None

        def row() -> list:
            return [] if state is None else [(uri, *state)]

        for frame in frames:
            done = []
            for e in frame.itertuples(index=False):
                if e.uri != uri:
                    done += row()
                    uri, state = e.uri, None
                state = _step(state, e)
            yield pd.DataFrame(done, columns=["uri", "generation", "format", "text"])
        yield pd.DataFrame(row(), columns=["uri", "generation", "format", "text"])

    return dealt.mapInPandas(run, "uri string, generation int, format string, text string")


def sessions(events: DataFrame) -> DataFrame:
    """The same over a stream of events, in update mode: a micro-batch gives each document
    it touches once, at its newest generation; a close gives a row with open false."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        was = now is not None
        for e in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            now = _step(now, e)
            was = was or now is not None
        if now is not None:
            state.update(now)
            yield pd.DataFrame([(key[0], *now, True)], columns=["uri", "generation", "format", "text", "open"])
        elif was:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], 0, None, None, False)], columns=["uri", "generation", "format", "text", "open"])

    return events.where("uri IS NOT NULL").groupBy("uri").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def analysable(text: Column) -> Column:
    return F.octet_length(text) <= MAX_BYTES


_DIAGNOSTIC = ("start_line", "start_char", "end_line", "end_char", "severity", "code", "source", "message")


def _shown(docs: DataFrame) -> DataFrame:
    """Row number, data and diagnostics of documents (uri, format, text), by the plans of ``render``."""
    read = prose.prose(docs.withColumn("_of", F.col(ROW)))
    whole = read.where("prose IS NOT NULL")
    data = render.editor_tokens(whole, ["_of"])
    notes = render.editor_diagnostics(whole, "_of").select("_of", F.struct(*_DIAGNOSTIC).alias("d")).groupBy("_of").agg(F.sort_array(F.collect_list("d")).alias("diagnostics"))
    good = data.join(notes, "_of", "left").select("_of", "data", F.coalesce("diagnostics", _notes()).alias("diagnostics"))
    bad = read.where("prose IS NULL").select("_of", F.array().cast("array<int>").alias("data"), _notes("ERROR", "invalid-source-view", F.lit("analysis view does not preserve source coordinates")).alias("diagnostics"))
    return good.unionByName(bad)


def _notes(severity: str = "", code: str = "", message: Column | None = None) -> Column:
    """One diagnostic at the start of a document, or none."""
    none = F.array().cast("array<struct<start_line:int,start_char:int,end_line:int,end_char:int,severity:string,code:string,source:string,message:string>>")
    return none if message is None else F.array(F.struct(*render.failure(code, message, severity)))


def results(opened: DataFrame, max_bytes: int = MAX_BYTES, failed: Column | None = None) -> DataFrame:
    """What a session shows of each document (uri, generation, format, text): tokens and diagnostics.

    result_id is the generation. status is accepted, oversized (a text beyond
    ``max_bytes`` isn't analysed and gets one warning), failed (where ``failed`` says
    that a document can't be analysed: one error, no tokens) or closed (nothing to show).
    Works on ``replay``, and on the micro-batches of ``sessions`` in a foreachBatch; only
    the newest generation of a document gets here, so a superseded one is never shown.
    A uri occurs once, and rows meet again by it.
    """
    is_open = F.coalesce(F.col("open"), F.lit(False)) if "open" in opened.columns else F.lit(True)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    status = F.when(~is_open, "closed").when(size > max_bytes, "oversized").when(F.coalesce(F.lit(False) if failed is None else failed, F.lit(False)), "failed").otherwise("accepted")
    rows = opened.withColumn(ROW, F.col("uri")).select(ROW, "uri", "generation", "format", F.coalesce("text", F.lit("")).alias("text"), status.alias("status"), size.alias("_size"))
    seen = _shown(rows.where("status = 'accepted'").drop("status", "_size"))
    large = F.concat(F.lit("document is "), F.col("_size").cast("string"), F.lit(f" bytes; the analysis limit is {max_bytes} bytes"))
    own = F.when(F.col("status") == "oversized", _notes("WARNING", "document-too-large", large)).when(F.col("status") == "failed", _notes("ERROR", "analysis-failed", F.lit("document analysis failed"))).otherwise(_notes())
    out = rows.join(seen, F.col(ROW) == F.col("_of"), "left")
    shown = F.when(F.col("status") == "accepted", F.col("diagnostics")).otherwise(own)
    return out.select("uri", "generation", F.when(F.col("status") != "closed", F.col("generation").cast("string")).alias("result_id"), "status", F.coalesce("data", F.array().cast("array<int>")).alias("data"), shown.alias("diagnostics"))


def metrics(events: DataFrame, shown: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row of ten counters over a replayed log and its ``results``.

    Generations that a later event of their document overtook count as cancelled before
    they were computed; a batch has no stale results and no queue.
    """
    w = Window.partitionBy("uri").orderBy("seq")
    kept = events.where("uri IS NOT NULL AND kind IN ('open', 'change', 'close')")
    lives = kept.withColumn("since", F.last(F.when(F.col("kind") != "change", F.col("kind")), True).over(w))
    made = lives.where("since = 'open'").agg(F.count(F.lit(1)).alias("made"))
    done = shown.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "oversized", "failed", "closed")])
    both = made.withColumn("one", F.lit(1)).join(done.withColumn("one", F.lit(1)), "one")
    open_ = F.col("accepted") + F.col("oversized") + F.col("failed")
    zero = F.lit(0).cast("long")
    return both.select(
        F.lit("textlens.session.metrics/v1").alias("schema_version"), F.lit(max_bytes).cast("long").alias("analysis_limit_bytes"), open_.alias("active_documents"),
        (F.col("accepted") + F.col("failed")).alias("computations_started"), (F.col("accepted") + F.col("oversized")).alias("accepted_results"), (F.col("made") - open_).alias("cancelled_before_compute"),
        zero.alias("stale_results"), F.col("oversized").alias("oversized_results"), F.col("failed").alias("analysis_failures"), zero.alias("max_queue_delay_micros"),
    )


def events_of_messages(messages: DataFrame) -> DataFrame:
    """Events of editor messages (seq, json): open, change (one event for each edit) and close notifications.

    Other messages, and those that can't be read, give no event.
    """
    point = "struct<line:int,character:int>"
    edit = f"struct<range:struct<start:{point},end:{point}>,text:string>"
    params = f"struct<textDocument:struct<uri:string,languageId:string,version:int,text:string>,contentChanges:array<{edit}>>"
    m = messages.select("seq", F.from_json("json", f"method string, params {params}").alias("m")).select("seq", "m.method", "m.params.*")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("textDocument/didOpen", "open", "textDocument/didChange", "change", "textDocument/didClose", "close")]), F.col("method"))
    one = F.array(F.struct(F.lit(None).cast("struct<start:" + point + ",end:" + point + ">").alias("range"), F.col("textDocument.text").alias("text")))
    edits = F.when(F.col("method") == "textDocument/didChange", F.col("contentChanges")).otherwise(one)
    rows = m.where(kind.isNotNull()).select("seq", "textDocument", kind.alias("kind"), F.posexplode(edits).alias("k", "e"))
    form = F.when(F.lower("textDocument.languageId") == "markdown", "markdown").otherwise("plain")
    return rows.select(
        F.col("textDocument.uri").alias("uri"), (F.col("seq") * 1000 + F.col("k")).cast("long").alias("seq"), "kind", F.when(F.col("kind") == "open", form).alias("format"),
        F.col("e.range.start.line").alias("start_line"), F.col("e.range.start.character").alias("start_char"), F.col("e.range.end.line").alias("end_line"), F.col("e.range.end.character").alias("end_char"),
        F.col("e.text").alias("text"),
    )


def messages_of_results(shown: DataFrame) -> DataFrame:
    """uri, json: the notification that publishes a document's diagnostics, as an editor reads it."""
    severity = F.create_map(*[F.lit(x) for x in ("ERROR", 1, "WARNING", 2, "INFORMATION", 3)])

    def note(d: Column) -> Column:
        at = lambda line, char: F.struct(d[line].alias("line"), d[char].alias("character"))
        return F.struct(F.struct(at("start_line", "start_char").alias("start"), at("end_line", "end_char").alias("end")).alias("range"), F.element_at(severity, d["severity"]).alias("severity"), d["code"].alias("code"), d["source"].alias("source"), d["message"].alias("message"))

    params = F.struct("uri", F.transform("diagnostics", note).alias("diagnostics"))
    return shown.select("uri", F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.lit("textDocument/publishDiagnostics").alias("method"), params.alias("params"))).alias("json"))
