"""Readers of interchange documents and editor tokens that trust nothing: first fault, or a report.

Both orders of checking are projections over the error list of ``validate``: a
consumer renames the codes and asks for the smallest in its own order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from . import render, validate
from .contract import Contract

_BREAK = re.compile(r"\r\n|\r|\n")
#: (version, schema hash, vocabulary hash) tuples that a consumer knows.
Profile = tuple[str, str, str]


def lines_of(text: str) -> list[tuple[str, int]]:
    """Each line's text and first UTF-8 byte."""
    out, start, byte = [], 0, 0
    for m in [*_BREAK.finditer(text), None]:
        line = text[start : m.start() if m else len(text)]
        out.append((line, byte))
        byte += len(line.encode()) + (m.end() - m.start() if m else 0)
        start = m.end() if m else start
    return out


def place(lines: list[tuple[str, int]], row: int, col16: int) -> int | None:
    """The UTF-8 byte of a UTF-16 position; None beyond the line or inside a character."""
    if not 0 <= row < len(lines) or col16 < 0:
        return None
    units = lines[row][0].encode("utf-16-le")
    if 2 * col16 > len(units):
        return None
    try:
        return lines[row][1] + len(units[: 2 * col16].decode("utf-16-le").encode())
    except UnicodeDecodeError:
        return None


# An admission's codes and their order of checking, by rule of the validator.
ADMISSION = {
    "NegativeByteLength": (1, "E_ARTIFACT_SHAPE"), "NegativeOffset": (1, "E_ARTIFACT_SHAPE"), "UnsupportedContractVersion": (2, "E_CONTRACT_VERSION"), "ByteLengthMismatch": (3, "E_BYTE_LENGTH"),
    "SourceNotUtf8": (4, "E_SOURCE_UTF8"), "RangeOutOfOrder": (5, "E_BYTE_RANGE_ORDER"), "RangeOutOfBounds": (5, "E_BYTE_RANGE_BOUNDS"), "RangeNotOnCharBoundary": (5, "E_BYTE_RANGE_BOUNDARY"),
    "EmptyTokenRange": (5, "E_TOKEN_EMPTY"), "UnsortedTokenRange": (5, "E_TOKEN_UNSORTED"), "OverlappingTokenRange": (5, "E_TOKEN_OVERLAP"), "DuplicateTokenId": (6, "E_DUPLICATE_OCCURRENCE_ID"),
    "IllegalTokenAxes": (7, "E_TOKEN_AXES"), "DuplicateNodeId": (8, "E_DUPLICATE_NODE_ID"), "InvalidOutlineDepth": (8, "E_OUTLINE_DEPTH"), "DanglingChildRef": (9, "E_DANGLING_CHILD_REF"),
    "MultipleStructureParents": (9, "E_MULTIPLE_STRUCTURE_PARENTS"), "ChildRangeOutsideParent": (9, "E_CHILD_RANGE"), "StructureCycle": (10, "E_STRUCTURE_CYCLE"), "EmptyDerivation": (12, "E_EMPTY_DERIVATION"),
    "MissingDerivationIdentity": (13, "E_MISSING_DERIVATION_IDENTITY"), "DuplicateDerivationPassId": (13, "E_DUPLICATE_DERIVATION_PASS_ID"), "SchemaHashMismatch": (14, "E_SCHEMA_HASH"),
    "VocabularyHashMismatch": (15, "E_VOCABULARY_HASH"), "ContentHashMismatch": (16, "E_CONTENT_HASH"),
}
# The same for the report consumer; the contract is settled before by its profiles.
REPORTING = {
    "ByteLengthMismatch": (2, "E_SOURCE_LENGTH"), "NegativeByteLength": (2, "E_SOURCE_LENGTH"), "SourceNotUtf8": (1, "E_SOURCE_UTF8"), "ContentHashMismatch": (3, "E_SOURCE_HASH"),
    **dict.fromkeys(("NegativeOffset", "RangeOutOfOrder", "RangeOutOfBounds", "RangeNotOnCharBoundary", "EmptyTokenRange", "UnsortedTokenRange", "OverlappingTokenRange"), (4, "E_RANGE")),
    "DuplicateTokenId": (4, "E_SHAPE"), "IllegalTokenAxes": (4, "E_AXES"), **dict.fromkeys(("DuplicateNodeId", "InvalidOutlineDepth"), (5, "E_SHAPE")),
    **dict.fromkeys(("DanglingChildRef", "MultipleStructureParents", "ChildRangeOutsideParent"), (6, "E_SHAPE")), "StructureCycle": (7, "E_SHAPE"),
    "EmptyDerivation": (9, "E_SHAPE"), **dict.fromkeys(("MissingDerivationIdentity", "DuplicateDerivationPassId"), (9, "E_SHAPE")),
}
#: Stages of ranges outside tokens, by the validator's stage: (admission, report).
_LATER = {5: (8, 5), 8: (11, 8), 9: (13, 9)}


def _first(errors: Column, order: dict, which: int) -> Column:
    """The first error (code, path, message) in a consumer's order; rules it doesn't know are skipped."""
    stage = F.create_map(*[F.lit(x) for k, (n, _) in order.items() for x in (k, n)])
    code = F.create_map(*[F.lit(x) for k, (_, c) in order.items() for x in (k, c)])

    def ranked(e: Column) -> Column:
        own = F.try_element_at(stage, e["code"])
        bounds = e["code"].isin("RangeOutOfOrder", "RangeOutOfBounds", "RangeNotOnCharBoundary") | ((e["code"] == "NegativeOffset") & F.lit(bool(which)))
        later = F.when(e["stage"] == 5, _LATER[5][which]).when(e["stage"] == 8, _LATER[8][which]).when(e["stage"] == 9, _LATER[9][which])
        # an admission wants negative offsets in document order; ids of a token come before its range in a report
        k = F.when((e["code"] == "DuplicateTokenId") & F.lit(bool(which)), -1).when((e["code"] == "IllegalTokenAxes"), 20).otherwise(e["k"])
        k = F.when(F.lit(bool(which)) & (e["code"] == "DuplicateNodeId"), -2).when(F.lit(bool(which)) & (e["code"] == "InvalidOutlineDepth"), -1).otherwise(k)
        # of a derivation step an admission reads the ranges first, a report the names
        step = F.when((e["stage"] == 9) & (e["j"] >= 0), F.lit(-1 if which == 0 else 1)).otherwise(0)
        stage_of = F.when(bounds & later.isNotNull(), later).otherwise(own)
        return F.struct(stage_of.alias("stage"), F.when(own == 1, e["stage"]).otherwise(0).alias("part"), e["i"].alias("i"), step.alias("step"), e["j"].alias("j"), k.alias("k"), F.try_element_at(code, e["code"]).alias("code"), e["path"].alias("path"), e["message"].alias("message"))

    known = F.filter(errors, lambda e: F.map_contains_key(stage, e["code"]))
    return F.array_min(F.transform(known, ranked))


def admission(found: DataFrame, contract: Contract = Contract()) -> DataFrame:
    """doc_id, code, path, message: the first fault of each document in admission order; code null: admitted.

    found: doc_id, analysis (null: not readable, E_ARTIFACT_SHAPE), bytes.
    """
    rows = validate.with_errors(found.select("doc_id", "analysis", "bytes"), contract).withColumn("first", _first(F.col("errors"), ADMISSION, 0))
    shapeless = F.col("analysis").isNull()
    return rows.select("doc_id", F.when(shapeless, "E_ARTIFACT_SHAPE").otherwise(F.col("first.code")).alias("code"), F.when(~shapeless, F.col("first.path")).alias("path"), F.when(~shapeless, F.col("first.message")).alias("message"))


def _profile_fault(profiles: list[Profile]) -> Column:
    """E_CONTRACT_VERSION, E_SCHEMA_HASH, E_VOCABULARY_HASH or null: how far a profile fits."""
    values = [F.col("analysis." + c) for c in ("contractVersion", "schemaHash", "vocabularyHash")]

    def some(n: int) -> Column:
        fits = F.lit(False)
        for p in profiles:
            one = F.lit(True)
            for value, wanted in zip(values[:n], p[:n], strict=True):
                one = one & value.eqNullSafe(F.lit(wanted))
            fits = fits | one
        return fits

    return F.when(~some(1), "E_CONTRACT_VERSION").when(~some(2), "E_SCHEMA_HASH").when(~some(3), "E_VOCABULARY_HASH")


def consume(found: DataFrame, profiles: list[Profile] | None = None) -> DataFrame:
    """doc_id, code, report: a span report, or the first fault of each document.

    found: doc_id, analysis (null: not readable, E_JSON), bytes. Profiles are the
    contracts that the consumer knows (the library's own unless given).
    """
    c = Contract()
    profiles = profiles or [(c.version, c.schema_hash, c.vocabulary_hash)]
    rows = validate.with_errors(found.select("doc_id", "analysis", "bytes"), c).withColumn("first", _first(F.col("errors"), REPORTING, 1))
    code = F.when(F.col("analysis").isNull(), "E_JSON").otherwise(F.coalesce(_profile_fault(profiles), F.col("first.code")))

    def role(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, lexical, open_, name in V.AXES:
            out = F.when(t["tokenKind"].eqNullSafe(F.lit(kind)) & t["lexicalClass"].eqNullSafe(F.lit(lexical)) & t["openClassKind"].eqNullSafe(F.lit(open_)), name).otherwise(out)
        return out

    def span(t: Column) -> Column:
        s, e = t["byteRange"]["startUtf8"], t["byteRange"]["endUtf8"]
        return F.struct(s.alias("start"), e.alias("end"), F.substring(F.col("bytes"), s + 1, e - s).cast("string").alias("lexeme"), role(t).alias("role"))

    def unstyled(t: Column) -> Column:
        out = F.lit(False)
        for kind, lexical, open_, name in V.AXES:
            if name not in render.EDITED:
                out = out | (t["openClassKind"].eqNullSafe(F.lit(open_)) & t["lexicalClass"].eqNullSafe(F.lit(lexical)) & t["tokenKind"].eqNullSafe(F.lit(kind)))
        return out

    # most tokens have no style: they go before texts are cut and roles looked up
    spans = F.filter(F.transform(F.filter("analysis.tokens", lambda t: ~unstyled(t)), span), lambda x: x["role"].isin(render.EDITED))
    rows = rows.withColumn("code", code)
    return rows.select("doc_id", "code", F.when(F.col("code").isNull(), render.report_of(spans)).alias("report"))


def consume_editor(edited: DataFrame, legend: list[str] | None = None) -> DataFrame:
    """doc_id, code, report of editor tokens (doc_id, text, data): E_LSP_LEGEND, E_LSP_SHAPE, E_LSP_POSITION or a report."""
    legend = V.LEGEND if legend is None else legend
    roles = {t: r for r, _, t, _ in V.ROLES if t}

    def read(text: str | None, data: list | None) -> list[tuple]:
        text, data = text or "", data or []
        if legend != V.LEGEND:
            return [("E_LSP_LEGEND", None)]
        if len(data) % 5 or any(v is None or v < 0 for v in data):
            return [("E_LSP_SHAPE", None)]
        lines, raw, row, col, last, out = lines_of(text), text.encode(), 0, 0, 0, []
        for n in range(0, len(data), 5):
            down, right, length, kind = data[n : n + 4]
            row, col = (row + down, right) if down else (row, col + right)
            if kind >= len(legend) or not length:
                return [("E_LSP_SHAPE", None)]
            start, end = place(lines, row, col), place(lines, row, col + length)
            if start is None or end is None or start < last or start >= end:
                return [("E_LSP_POSITION", None)]
            out.append((start, end, raw[start:end].decode(), roles[legend[kind]]))
            last = end
        return [(None, "".join(["\0".join(map(str, s)) + "\1" for s in out]))]

    rows = render.per_row(edited, ["doc_id"], ["text", "data"], "code string, packed string", read)
    parts = F.transform(F.filter(F.split("packed", "\1"), lambda x: x != ""), lambda x: F.split(x, "\0"))
    spans = F.transform(parts, lambda p: F.struct(p[0].cast("int").alias("start"), p[1].cast("int").alias("end"), p[2].alias("lexeme"), p[3].alias("role")))
    return rows.select("doc_id", "code", F.when(F.col("code").isNull(), render.report_of(spans)).alias("report"))


def same_coordinates(source: str, view: str) -> bool:
    """Whether a view of a source keeps its bytes, its line starts and its UTF-16 columns at every shared border."""

    def borders(text: str) -> dict[int, int]:
        at, units, out = 0, 0, {0: 0}
        for c in text:
            at += len(c.encode())
            units += 2 if ord(c) > 0xFFFF else 1
            out[at] = units
        return out

    if [b for _, b in lines_of(source)] != [b for _, b in lines_of(view)]:
        return False
    own, other = borders(source), borders(view)
    return max(own) == max(other) and all(other.get(at, units) == units for at, units in own.items())
