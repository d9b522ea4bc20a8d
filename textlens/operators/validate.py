"""Checks of interchange documents and of classifications that others made.

The rules of an interchange document are projections over its own arrays and need no
exchange. Three read them as Arrow batches, each once and in linear time: byte ranges,
repeated ids, and the edges of the outline. A batch is looked through as a whole, and only
what may be broken is spelled out as errors, by expressions over these few items.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions import text as T
from .contract import Contract


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many items each list has (null: none), and all of them with nulls as 0."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)


#: List items of a batch that are looked through at once.
PART = 200_000


def _in_parts(check: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``check`` over runs of rows whose last column, of lists, holds about PART items (a row at least), so that its arrays stay small whatever a batch holds."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(columns[-1]), 0).to_numpy(zero_copy_only=False))
    parts, lo = [], 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, "right")))
        parts.append(check(*[c.slice(lo, hi - lo) for c in columns]))
        lo = hi
    return pa.concat_arrays(parts) if parts else check(*columns)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _splitter(source: pa.Array) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether offsets ``x`` of the rows ``doc`` lie inside a character of the UTF-8 source."""
    raw = pc.fill_null(source, b"").cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)

    def splits(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        inside = np.flatnonzero((x > 0) & (x < np.diff(at)[doc]))
        out[inside] = (data[at[doc[inside]] + x[inside].astype(np.int64)] & 0xC0) == 0x80
        return out

    return splits


#: A range that may break a rule: its place, and whether an end of it splits a character.
_SUSPECT = StructType().add("i", "integer").add("s_splits", "boolean").add("e_splits", "boolean")


def _suspected(source: pa.Array, length: pa.Array, starts: pa.Array, ends: pa.Array, in_order: bool) -> pa.Array:
    """Of each list, the ranges that break a rule of ranges or, with ``in_order``, one of empty or unordered tokens; few beside them."""
    sizes, s = _flat(starts)
    e = _flat(ends)[1]
    most = pc.fill_null(length, 2**31 - 1).to_numpy(zero_copy_only=False)
    doc, first = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), _starts(sizes)
    splits = _splitter(source)
    s_splits, e_splits = splits(doc, s), splits(doc, e)
    bad = (s < 0) | (e < 0) | (s > e) | (e > most[doc]) | s_splits | e_splits
    if in_order:
        bad |= s == e
        behind = (s[1:] < s[:-1]) | (s[1:] < e[:-1])
        bad[1:] |= behind & (doc[1:] == doc[:-1])
    found = np.flatnonzero(bad)
    items = pa.StructArray.from_arrays([pa.array((found - first[doc[found]]).astype(np.int32)), pa.array(s_splits[found]), pa.array(e_splits[found])], ["i", "s_splits", "e_splits"])
    return pa.ListArray.from_arrays(pa.array(_starts(np.bincount(doc[found], minlength=len(sizes))).astype(np.int32)), items)


@F.arrow_udf(ArrayType(_SUSPECT))
def _suspects(source: pa.Array, length: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    return _in_parts(lambda *x: _suspected(*x, False), source, length, starts, ends)


@F.arrow_udf(ArrayType(_SUSPECT))
def _token_suspects(source: pa.Array, length: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    return _in_parts(lambda *x: _suspected(*x, True), source, length, starts, ends)


def _repeats(values: pa.Array) -> pa.Array:
    """Places of the values that occurred before in their list; numbers are sorted by list and value for that, and those of rising lists not even that."""
    if pa.types.is_integer(values.type.value_type) and not values.flatten().null_count:
        sizes, flat = _flat(values)
        doc, first = np.repeat(np.arange(len(sizes)), sizes), _starts(sizes)
        at = np.flatnonzero((flat[1:] <= flat[:-1]) & (doc[1:] == doc[:-1])) + 1
        walked = np.zeros(len(sizes), bool)
        walked[doc[at]] = True
        if (flat[at] < flat[at - 1]).any():
            mine = np.flatnonzero(walked[doc])
            order = mine[np.lexsort((flat[mine], doc[mine]))]  # stable: of equal values, the first stands first
            at = np.sort(order[1:][(flat[order][1:] == flat[order][:-1]) & (doc[order][1:] == doc[order][:-1])])
        return pa.ListArray.from_arrays(pa.array(_starts(np.bincount(doc[at], minlength=len(sizes))).astype(np.int32)), pa.array((at - first[doc[at]]).astype(np.int32)))
    out: list[list[int]] = [[]] * len(values)
    numbers = pa.types.is_integer(values.type.value_type)
    for n in range(len(values)):
        seen: set = set()
        out[n] = [i for i, v in enumerate(values[n].as_py() or []) if (not numbers or v is not None) and (v in seen or seen.add(v))]
    return pa.array(out, pa.list_(pa.int32()))


@F.arrow_udf(ArrayType(IntegerType()))
def _again(values: pa.Array) -> pa.Array:
    return _in_parts(_repeats, values)


def _sound(ids: pa.Array, children: pa.Array, starts: pa.Array, ends: pa.Array) -> np.ndarray:
    """Outlines whose nodes are numbered by their places, whose edges lead on to later nodes within them, and to each once at most: none of their edges is broken."""
    sizes, own = _flat(ids)
    doc, first = np.repeat(np.arange(len(sizes)), sizes), _starts(sizes)
    place = np.arange(len(own)) - first[doc]
    bad = [doc[own != place]]
    kids, child = _flat(children.flatten())
    node = np.repeat(np.arange(len(kids)), kids)
    s, e = _flat(starts)[1], _flat(ends)[1]
    of = doc[node]
    wrong = (child <= place[node]) | (child >= sizes[of])
    to = np.where(wrong, 0, first[of] + child)
    wrong |= (s[to] < s[node]) | (e[to] > e[node]) | (np.bincount(to, minlength=len(own))[to] > 1)
    return np.bincount(np.concatenate([*bad, of[wrong]]), minlength=len(sizes)) == 0


_EDGE = StructType().add("i", "integer").add("j", "integer").add("code", "string").add("detail", "string")


def _broken(ids: pa.Array, children: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Broken edges (node, place, code) of each outline; an id means its first node. Sound outlines are not walked."""
    out: list[list[dict]] = [[]] * len(ids)
    number = lambda values: [np.nan if v is None else v for v in values]
    for n in np.flatnonzero(~_sound(ids, children, starts, ends)):
        own, kids, s, e = ids[n].as_py(), children[n].as_py(), number(starts[n].as_py()), number(ends[n].as_py())
        at: dict[int, int] = {}
        for i, node in enumerate(own):
            at.setdefault(node, i)
        bad: list[dict] = []
        owner: dict[int, int] = {}
        for i, node in enumerate(own):
            for j, child in enumerate(kids[i]):
                c = at.get(child)
                first = node if c is None else owner.setdefault(child, node)
                checks = {
                    "DanglingChildRef": (c is None, f"references missing child {child}"),
                    "MultipleStructureParents": (first != node, f"child {child} already belongs to parent {first}, not {node}"),
                    "ChildRangeOutsideParent": (c is not None and (s[c] < s[i] or e[c] > e[i]), f"child {child} falls outside parent {node}"),
                }
                bad += [{"i": i, "j": j, "code": code, "detail": detail} for code, (broken, detail) in checks.items() if broken]
        out[n] = bad + [{"i": i, "j": j, "code": "StructureCycle", "detail": f"edge {own[i]} -> {kids[i][j]} closes a structure cycle"} for i, j in _closing(kids, at)]
    return pa.array(out, pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("code", pa.string()), ("detail", pa.string())])))


@F.arrow_udf(ArrayType(_EDGE))
def _edges(ids: pa.Array, children: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    return _in_parts(_broken, ids, children, starts, ends)


def _closing(kids: list, at: dict[int, int]) -> list[tuple[int, int]]:
    """Edges that close a cycle, walking nodes and edges in their order."""
    closing, done, open_ = [], set(), set()
    for root in range(len(kids)):
        path = [] if root in done else [(root, iter(enumerate(kids[root])))]
        open_.update(i for i, _ in path)
        while path:
            i, edges = path[-1]
            step = next(((j, at[c]) for j, c in edges if c in at and at[c] not in done), None)
            if step is None:
                path.pop()
                open_.discard(i)
                done.add(i)
            elif step[1] in open_:
                closing.append((i, step[0]))
            else:
                open_.add(step[1])
                path.append((step[1], iter(enumerate(kids[step[1]]))))
    return closing


# not deterministic by name only: so that the optimizer leaves each as a column of its
# own, and never repeats it inside the lambdas that read it
_again, _edges = _again.asNondeterministic(), _edges.asNondeterministic()
_suspects, _token_suspects = _suspects.asNondeterministic(), _token_suspects.asNondeterministic()


ERRORS = "array<struct<stage:int,i:int,j:int,k:int,code:string,path:string,message:string>>"


def _error(stage, i, j, k, code, path: Column, *detail) -> Column:
    """An error at its place in the report's order; its text names the path and what is wrong there."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    numbers = [lit(v).cast("int").alias(n) for v, n in ((stage, "stage"), (i, "i"), (j, "j"), (k, "k"))]
    return F.struct(*numbers, lit(code).alias("code"), path.alias("path"), _path("at ", path, ": ", *detail).alias("message"))


def _path(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _each(array: str | Column, check) -> Column:
    """check(x, i), or check(x), lists errors (null: none) of each item."""
    numbered = len(inspect.signature(check).parameters) == 2
    errors = lambda *x: F.array_compact(F.array(*check(*x)))
    return F.flatten(F.transform(array, (lambda x, i: errors(x, i)) if numbered else lambda x: errors(x)))


def _where(array: str | Column, broken, check) -> Column:
    """``_each`` for the documents that have an item which is ``broken``; the rules of all others are not spelled out."""
    return F.when(F.exists(array, broken), _each(array, check)).otherwise(F.array().cast(ERRORS))


def _list(array: str) -> Column:
    return F.col("given.analysis.tokens" if array == "tokens" else array)


#: Stage of the byte ranges of each list.
_STAGES = {"tokens": 3, "structure": 5, "diagnostics": 8}


def _ranges() -> Column:
    """The byte ranges of a document that may break a rule (``_suspects``): their stage, place, ends, and whether an end splits a character."""

    def item(stage: int, i: Column, j: Column, r: Column, x: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), i.cast("int").alias("i"), j.cast("int").alias("j"), r["startUtf8"].alias("s"), r["endUtf8"].alias("e"), x["s_splits"].alias("s_splits"), x["e_splits"].alias("e_splits"))

    def own(array: str, stage: int) -> Column:
        return F.transform(f"bad_{array}", lambda x: item(stage, x["i"], F.lit(-1), F.get(_list(array), x["i"])["byteRange"], x))

    nested = F.transform("bad_sources", lambda x: item(9, F.get("sources", x["i"])["i"], F.get("sources", x["i"])["j"], F.get("sources", x["i"])["r"], x))
    return F.concat(*[own(a, n) for a, n in _STAGES.items()], nested)


def _range_path(r: Column) -> Column:
    """Where a byte range stands; made for the broken ones alone."""
    own = F.when(r["stage"] == 3, "tokens").when(r["stage"] == 5, "structure").when(r["stage"] == 8, "diagnostics")
    return F.when(r["stage"] == 9, _path("derivation[", r["i"], "].sourceRanges[", r["j"], "]")).otherwise(_path(own, "[", r["i"], "].byteRange"))


def axes_violation(t: Column) -> Column:
    """What is wrong with a token's axes; null where they are legal."""
    function, open_, lexical = t["functionKind"].isNotNull(), t["openClassKind"].isNotNull(), t["lexicalClass"]
    # The seven texts.
    other = F.when(lexical.isNotNull(), "a non-word token must not carry a lexicalClass").when(function, "a non-word token must not carry a functionKind").when(open_, "a non-word token must not carry an openClassKind")
    word = (
        F.when(lexical.isNull(), "a WORD token must carry a lexicalClass")
        .when((lexical == "FUNCTION") & ~function, "a FUNCTION word must carry a functionKind")
        .when((lexical != "FUNCTION") & function, "only a FUNCTION word may carry a functionKind")
        .when((lexical != "CONTENT") & open_, "only a CONTENT word may carry an openClassKind")
    )
    return F.when(t["tokenKind"] == "WORD", word).otherwise(other)


def _broken_edges(structure: Column) -> Column:
    children = F.transform(structure, lambda n: F.coalesce(n["childNodeIds"], F.array().cast("array<int>")))
    return _edges(structure["nodeId"], children, structure["byteRange"]["startUtf8"], structure["byteRange"]["endUtf8"])


def outline_errors(found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, code, path, message: repeated ids, broken edges and cycles of ``found``'s outlines, a row each.

    outline is a list of nodes as the interchange format has them. All that a rule reads
    stands in one row, so that nothing is exchanged, joined or broadcast.
    """
    docs = found.withColumns({"_edges": _broken_edges(F.col("outline")), "_again": _again(F.col("outline.nodeId"))})
    error = lambda i, j, code, detail: F.struct(i.alias("i"), j.alias("j"), code.alias("code"), detail.alias("detail"))
    edges = F.transform("_edges", lambda e: error(e["i"], e["j"], e["code"], e["detail"]))
    again = F.transform("_again", lambda i: error(i, F.lit(None).cast("int"), F.lit("DuplicateNodeId"), _path("duplicate nodeId ", F.get("outline", i)["nodeId"])))
    rows = docs.select(*keep, F.inline(F.concat(edges, again)))
    node = _path("structure[", F.col("i"), "]")
    rows = rows.withColumn("path", F.when(F.col("j").isNull(), node).otherwise(_path(node, ".childNodeIds[", F.col("j"), "]")))
    return rows.select(*keep, "code", "path", _path("at ", F.col("path"), ": ", F.col("detail")).alias("message"))


def with_errors(found: DataFrame, contract: Contract = Contract()) -> DataFrame:
    """found(doc_id, analysis, bytes and others) with errors: an array of every broken rule, in report order.

    bytes (null: not at hand) is the source. Null lists of a document count as empty; a null
    document has no errors (its reader has refused it). No row meets another one, so ids may repeat.
    """
    docs, errors = _checked(found, contract)
    return docs.select("given.*", F.array_sort(errors).alias("errors"))


def error_codes(found: DataFrame, keep: list[str], contract: Contract = Contract()) -> DataFrame:
    """``keep``, stage, i, j, k, code, path of every broken rule, a row each, unsorted: ``with_errors`` for readers who want no messages, so that none is made."""
    docs, errors = _checked(found, contract, told=False)
    return docs.select(*[F.col("given")[c].alias(c) for c in keep], F.inline(errors)).drop("message")


def _checked(found: DataFrame, contract: Contract, told: bool = True) -> tuple[DataFrame, Column]:
    """The documents with what their checks read, and the broken rules as an array; without ``told``, their messages are null."""

    def error(stage, i, j, k, code, path: Column, *detail) -> Column:
        whole = _error(stage, i, j, k, code, path, *(detail if told else ("",)))
        return whole if told else whole.withField("message", F.lit(None).cast("string"))

    a = "analysis."
    # tokens are read where they were given: a second copy of them would be most of what is written
    lists = [F.coalesce(a + c, F.array()).alias(c) for c in ("structure", "diagnostics", "derivation")]
    docs = found.select(F.struct(*found.columns).alias("given"), a + "contractVersion", a + "schemaHash", a + "vocabularyHash", a + "source", *lists, "bytes")
    given = F.col("bytes").isNotNull()
    utf8 = F.is_valid_utf8(F.col("bytes").cast("string"))
    declared, root = F.col("source.utf8ByteLength"), F.lit("source")
    actual = F.concat(F.lit("sha256:"), F.sha2("bytes", 256))

    def other(expected, value: str) -> tuple:
        return "expected `", expected, "`, found `", T.escaped(F.col(value)), "`"

    head = F.array_compact(
        F.array(
            F.when(F.col("contractVersion") != contract.version, error(1, 0, -1, 0, "UnsupportedContractVersion", F.lit("contractVersion"), "unsupported contract version `", T.escaped(F.col("contractVersion")), "`")),
            F.when(F.col("schemaHash") != contract.schema_hash, error(1, 0, -1, 1, "SchemaHashMismatch", F.lit("schemaHash"), *other(contract.schema_hash, "schemaHash"))),
            F.when(F.col("vocabularyHash") != contract.vocabulary_hash, error(1, 0, -1, 2, "VocabularyHashMismatch", F.lit("vocabularyHash"), *other(contract.vocabulary_hash, "vocabularyHash"))),
            F.when(declared < 0, error(2, 0, -1, 0, "NegativeByteLength", _path(root, ".utf8ByteLength"), declared, " is negative")),
            F.when(given & (declared != F.octet_length("bytes")), error(2, 0, -1, 1, "ByteLengthMismatch", _path(root, ".utf8ByteLength"), "declared ", declared, ", actual ", F.octet_length("bytes"))),
            F.when(given & (F.col("source.contentHash") != actual), error(2, 0, -1, 2, "ContentHashMismatch", _path(root, ".contentHash"), *other(actual, "source.contentHash"))),
            F.when(given & ~utf8, error(2, 0, -1, 3, "SourceNotUtf8", root, "not valid UTF-8")),
            F.when(F.size("derivation") == 0, error(9, -1, -1, 0, "EmptyDerivation", F.lit("derivation"), "must not be empty")),
        )
    )

    def layout(x: Column) -> list[Column]:
        i, t = x["i"], F.get(_list("tokens"), x["i"])
        r, before, path = t["byteRange"], F.get(_list("tokens"), i - 1)["byteRange"], _path("tokens[", i, "].byteRange")
        unsorted = r["startUtf8"] < before["startUtf8"]
        start = ("start ", r["startUtf8"])
        return [
            F.when(r["startUtf8"] == r["endUtf8"], error(3, i, -1, 6, "EmptyTokenRange", path, "token ", t["occurrenceId"], " has an empty range")),
            F.when(unsorted, error(3, i, -1, 7, "UnsortedTokenRange", _path(path, ".startUtf8"), *start, " precedes tokens[", i - 1, "] start ", before["startUtf8"]))
            .when(r["startUtf8"] < before["endUtf8"], error(3, i, -1, 7, "OverlappingTokenRange", _path(path, ".startUtf8"), *start, " overlaps tokens[", i - 1, "] ending at ", before["endUtf8"])),
        ]

    def axes(t: Column, i: Column) -> list[Column]:
        wrong = axes_violation(t)
        return [F.when(wrong.isNotNull(), error(4, i, -1, 0, "IllegalTokenAxes", _path("tokens[", i, "]"), wrong))]

    due = lambda n: F.when(n["kind"] == "PARAGRAPH", 0).otherwise(1)
    depth = _where("structure", lambda n: n["depth"] != due(n), lambda n, i: [F.when(n["depth"] != due(n), error(5, i, -1, 7, "InvalidOutlineDepth", _path("structure[", i, "].depth"), "depth ", n["depth"], ", expected ", due(n), " for this outline kind"))])
    nameless = _each("derivation", lambda s, i: [F.when((s["passId"] == "") | (s["ruleId"] == ""), error(9, i, -1, 0, "MissingDerivationIdentity", _path("derivation[", i, "]"), "empty passId or ruleId"))])
    sources = F.flatten(F.transform("derivation", lambda x, i: F.transform(x["sourceRanges"], lambda r, j: F.struct(i.alias("i"), j.alias("j"), r.alias("r")))))
    docs = docs.withColumns({"sources": sources, "length": F.when(given, F.octet_length("bytes")).otherwise(declared), "text": F.when(utf8, F.col("bytes"))})

    def field(array: str, *way: str) -> Column:
        found = _list(array)
        for name in way:
            found = found[name]
        return found

    def suspects(array: str, ranges: str) -> Column:
        return (_token_suspects if array == "tokens" else _suspects)("text", "length", field(array, ranges, "startUtf8"), field(array, ranges, "endUtf8"))

    edges = _broken_edges(F.col("structure"))
    ids = {"tokens": "occurrenceId", "structure": "nodeId", "derivation": "passId"}
    bad = {f"bad_{a}": suspects(a, "byteRange") for a in _STAGES} | {"bad_sources": suspects("sources", "r")}
    docs = docs.withColumns(bad | {"edges": edges} | {f"again_{a}": _again(field(a, c)) for a, c in ids.items()})

    def repeated(array: str, stage: int, k: int, code: str) -> Column:
        value = lambda i: F.get(_list(array), i)[ids[array]]
        shown = (lambda i: ("`", T.escaped(value(i)), "`")) if array == "derivation" else lambda i: (value(i),)
        return F.transform(f"again_{array}", lambda i: error(stage, i, -1, k, code, _path(array, "[", i, "]"), f"duplicate {ids[array]} ", *shown(i)))

    docs = docs.withColumn("ranges", _ranges())

    def bounds(r: Column) -> list[Column]:
        def bad(when: Column, k: int, code: str, field: str, *detail) -> Column:
            return F.when(when, error(r["stage"], r["i"], r["j"], k, code, _path(_range_path(r), field), *detail))

        return [
            bad(r["s"] < 0, 0, "NegativeOffset", ".startUtf8", r["s"], " is negative"),
            bad(r["e"] < 0, 1, "NegativeOffset", ".endUtf8", r["e"], " is negative"),
            bad(r["s"] > r["e"], 2, "RangeOutOfOrder", "", "start ", r["s"], " exceeds end ", r["e"]),
            bad(r["e"] > F.col("length"), 3, "RangeOutOfBounds", ".endUtf8", r["e"], " exceeds source length ", F.col("length")),
            bad(r["s_splits"], 4, "RangeNotOnCharBoundary", ".startUtf8", r["s"], " is not a UTF-8 character boundary"),
            bad(r["e_splits"], 5, "RangeNotOnCharBoundary", ".endUtf8", r["e"], " is not a UTF-8 character boundary"),
        ]

    def edge(c: Column) -> Column:
        cycle = c["code"] == "StructureCycle"
        path = _path("structure[", c["i"], "].childNodeIds[", c["j"], "]")
        order = F.when(c["code"] == "MultipleStructureParents", 1).when(c["code"] == "ChildRangeOutsideParent", 2).otherwise(0)
        return error(F.when(cycle, 7).otherwise(6), c["i"], c["j"], order, c["code"], path, c["detail"])

    repeats = [repeated("tokens", 3, 8, "DuplicateTokenId"), repeated("structure", 5, 6, "DuplicateNodeId"), repeated("derivation", 9, 1, "DuplicateDerivationPassId")]
    flat = F.concat(head, _each("ranges", bounds), _each("bad_tokens", layout), _where(_list("tokens"), lambda t: axes_violation(t).isNotNull(), axes), depth, nameless, F.transform("edges", edge), *repeats)
    return docs, F.when(F.col("given.analysis").isNotNull(), flat).otherwise(F.slice(flat, 1, 0))


def _with_bytes(found: DataFrame, sources: DataFrame | None) -> DataFrame:
    found = found.select("doc_id", "analysis")
    if sources is None:
        return found.withColumn("bytes", F.lit(None).cast("binary"))
    return found.join(sources.select("doc_id", "bytes"), "doc_id", "left")


def interchange_errors(found: DataFrame, sources: DataFrame | None = None, contract: Contract = Contract()) -> DataFrame:
    """doc_id, stage, i, j, k, code, path, message of every broken rule; sorted by these it is the report.

    found is doc_id (unique), analysis; sources is doc_id, bytes where the sources are
    at hand. ``with_errors`` does the same without a join where they stand side by side.
    """
    return with_errors(_with_bytes(found, sources), contract).select("doc_id", F.inline("errors"))


def report(errors: Column) -> Column:
    """The text of a document's errors, null without any."""
    lines = F.transform(errors, lambda e: F.concat(F.lit("\n  - "), e["message"]))
    return F.when(F.size(errors) > 0, F.concat(F.lit("document failed validation ("), F.size(errors).cast("string"), F.lit(" issue(s)):"), F.array_join(lines, "")))


#: A tree as its maker gives it: kinds are Document, Sentence, Word and Punct.
SPAN = "struct<start:int,end:int>"
TREE = "struct<kind:string,sentences:array<struct<kind:string,start:int,end:int,parts:array<struct<kind:string,start:int,end:int>>>>>"


def _span_faults(x: dict[str, Column], i: Column, before: dict[str, Column], path: Column) -> list[tuple[Column, str, Column, Column]]:
    """(broken, code, path, what) of a span (s, e, and whether each splits a character) in the order of checking.

    ``before`` has s and e of the item before it in its list, null for the first.
    """
    text = lambda *parts: _path(*parts)
    return [
        (x["s"] > x["e"], "ReversedSpan", path, text("start ", x["s"], " exceeds end ", x["e"])),
        (x["e"] > F.col("_size"), "SpanOutOfBounds", _path(path, ".end"), text(x["e"], " exceeds source length ", F.col("_size"))),
        (x["s_splits"], "SpanNotOnCharBoundary", _path(path, ".start"), text(x["s"], " is not a UTF-8 character boundary")),
        (x["e_splits"], "SpanNotOnCharBoundary", _path(path, ".end"), text(x["e"], " is not a UTF-8 character boundary")),
        (x["s"] < before["s"], "UnsortedSpan", _path(path, ".start"), text("start ", x["s"], " precedes item ", i - 1, " start ", before["s"])),
        (x["s"] < before["e"], "OverlappingSpan", _path(path, ".start"), text("start ", x["s"], " overlaps item ", i - 1, " ending at ", before["e"])),
    ]


#: The first item at fault of a list: its number, its sentence and place there (parts alone), and whether an end of it splits a character.
_PLACE = StructType().add("n", "integer").add("i", "integer").add("j", "integer").add("s_splits", "boolean").add("e_splits", "boolean")
_FAULTS = StructType().add("head", _PLACE).add("leaf", _PLACE).add("token", _PLACE).add("pair", _PLACE).add("leaves", "integer")


def _numbers(x: pa.Array) -> np.ndarray:
    """Nulls as NaN, which no comparison finds at fault."""
    return x.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _faults(source: pa.Array, tree: pa.Array, tokens: pa.Array) -> pa.Array:
    """The first sentence, part, token and pair of each row that break a rule of ``classification_errors``, and how many parts there are."""
    size, splits = pc.fill_null(pc.binary_length(source), 0).to_numpy(zero_copy_only=False), _splitter(source)

    def lists(x: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The list and place there of each item, and the items."""
        sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(sizes)), sizes)
        return of, np.arange(len(of)) - _starts(sizes)[of], x.flatten()

    def ends(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _numbers(pc.struct_field(items, "start")), _numbers(pc.struct_field(items, "end"))

    def is_no(items: pa.Array, *kinds: str) -> np.ndarray:
        return ~pc.is_in(pc.struct_field(items, "kind"), pa.array(kinds, pa.string())).to_numpy(zero_copy_only=False)

    def spans(doc: np.ndarray, place: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        wrong = (s > e) | (e > size[doc]) | splits(doc, s) | splits(doc, e)
        wrong[1:] |= (place[1:] > 0) & ((s[1:] < s[:-1]) | (s[1:] < e[:-1]))
        return wrong

    def first(wrong: np.ndarray, doc: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
        found = np.flatnonzero(wrong)
        rows, which = np.unique(doc[found], return_index=True)
        found = found[which]
        own = [pa.array(x[found].astype(np.int32)) for x in (n, i, j)] + [pa.array(splits(doc[found], x[found])) for x in (s, e)]
        at = np.full(len(size), -1, np.int64)
        at[rows] = np.arange(len(rows))
        return pa.StructArray.from_arrays(own, ["n", "i", "j", "s_splits", "e_splits"]).take(pa.array(at, mask=at < 0))

    doc, i, heads = lists(pc.struct_field(tree, "sentences"))
    s, e = ends(heads)
    head = first(is_no(heads, "Sentence") | spans(doc, i, s, e), doc, i, i, i, s, e)
    of, j, leaves = lists(pc.struct_field(heads, "parts"))
    l_doc, ls, le = doc[of], *ends(leaves)
    counts = np.bincount(l_doc, minlength=len(size))
    n = np.arange(len(of)) - _starts(counts)[l_doc]
    wrong = is_no(leaves, "Word", "Punct") | spans(l_doc, j, ls, le) | (ls < s[of]) | (le > e[of])
    leaf = first(wrong, l_doc, n, i[of], j, ls, le)
    t_doc, t, items = lists(tokens)
    ts, te = ends(items)
    token = first(spans(t_doc, t, ts, te), t_doc, t, t, t, ts, te)
    both = np.flatnonzero(t < counts[t_doc])
    mate, d = _starts(counts)[t_doc[both]] + t[both], t_doc[both]
    other = lambda a, b: (a != b) & ~np.isnan(a) & ~np.isnan(b)
    pair = first(other(ls[mate], ts[both]) | other(le[mate], te[both]), d, t[both], i[of][mate], j[mate], ts[both], te[both])
    return pa.StructArray.from_arrays([head, leaf, token, pair, pa.array(counts.astype(np.int32))], ["head", "leaf", "token", "pair", "leaves"])


@F.arrow_udf(_FAULTS)
def _first_faults(source: pa.Array, tree: pa.Array, tokens: pa.Array) -> pa.Array:
    return _in_parts(_faults, source, tree, tokens)


_first_faults = _first_faults.asNondeterministic()  # as those above


def classification_errors(classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, code, path, message: the first broken rule of each row that breaks one.

    classified: key, text (null: empty), tree and tokens of the types TREE and
    array<SPAN>, as another parser and annotator give them; ids may repeat. All that a
    rule reads stands in one row, so nothing is exchanged or joined: an Arrow pass over
    the lists of a batch finds the first item of each at fault, only that item's words are
    made, and the first error is the smallest in the order of stages: root, sentences with
    their parts, tokens, their number, their pairs.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = classified.select(key, raw.alias("_raw"), F.col("tree").cast(TREE).alias("_tree"), F.coalesce(F.col("tokens").cast(f"array<{SPAN}>"), F.array()).alias("_spans"))
    docs = docs.withColumn("_found", _first_faults("_raw", "_tree", "_spans"))
    head, leaf, token, pair, leaves = (F.col("_found")[c] for c in ("head", "leaf", "token", "pair", "leaves"))
    root, sentences, tokens = F.col("_tree.kind"), F.col("_tree.sentences"), F.size("_spans")
    # root, sentence, part, token, count, pair: the stage that the first error is of
    stage = F.when(~root.eqNullSafe("Document"), 0).when(head.isNotNull() & (leaf.isNull() | (head["i"] <= leaf["i"])), 1).when(leaf.isNotNull(), 2).when(token.isNotNull(), 3).when(leaves != tokens, 4).when(pair.isNotNull(), 5)
    docs = docs.withColumn("_stage", stage).where("_stage IS NOT NULL")

    # the item at fault, the one before it and what it is compared with (a part's parent, a token's part) are picked here, so that a rule is written once
    def of(*stages: Column | None) -> Column:
        pick = F
        for n, x in enumerate(stages, 1):
            pick = pick if x is None else pick.when(F.col("_stage") == n, x)
        return pick

    def item(x: Column, kind: Column | None = None) -> Column:
        return F.struct((F.lit(None).cast("string") if kind is None else kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))

    def before(x: Callable[[Column], Column], i: Column) -> Column:
        return F.when(i > 0, item(x(i - 1)))

    sentence, span = (lambda i: F.get(sentences, i)), (lambda i: F.get("_spans", i))
    part = lambda at: lambda j: F.get(F.get(sentences, at["i"])["parts"], j)
    own = lambda x: item(x, x["kind"])
    docs = docs.select(
        key, "_stage", F.octet_length("_raw").alias("_size"), root.alias("_root"), leaves.alias("_leaves"), tokens.alias("_tokens"), of(head, leaf, token, None, pair).alias("_at"),
        of(own(sentence(head["n"])), own(part(leaf)(leaf["j"])), item(span(token["n"])), None, item(span(pair["n"]))).alias("_x"),
        of(before(sentence, head["n"]), before(part(leaf), leaf["j"]), before(span, token["n"])).alias("_before"),
        of(item(F.lit(None).cast(SPAN)), item(sentence(leaf["i"])), None, None, item(part(pair)(pair["j"]))).alias("_other"),
    )
    at, x, other, stage = F.col("_at"), F.col("_x"), F.col("_other"), F.col("_stage")
    place = _path("tree.root.sentences[", at["i"], "].parts[", at["j"], "]")
    node = of(_path("tree.root.sentences[", at["n"], "]"), place)
    spot = F.when(stage < 3, _path(node, ".span")).otherwise(_path("tokens[", at["n"], "].span"))
    docs = docs.withColumns({"_node": node, "_spot": spot, "_mate": F.when(stage == 5, place)})
    kind = lambda found, wanted: _path("expected ", wanted, ", found ", F.coalesce(found, F.lit("None")))
    wrong = ((stage == 1) & ~x["kind"].eqNullSafe("Sentence")) | ((stage == 2) & ~F.coalesce(x["kind"].isin("Word", "Punct"), F.lit(False)))
    both = {"s": x["start"], "e": x["end"], "s_splits": at["s_splits"], "e_splits": at["e_splits"]}
    faults = [
        (stage == 0, "UnexpectedNodeKind", F.lit("tree.root"), kind(F.col("_root"), F.lit("Document"))),
        (stage == 4, "TreeTokenCountMismatch", F.lit("tokens"), _path("tree has ", F.col("_leaves"), " leaves but annotator emitted ", F.col("_tokens"), " tokens")),
        (stage == 5, "TreeTokenSpanMismatch", F.col("_spot"), _path("token ", x["start"], "..", x["end"], " does not match ", F.col("_mate"), ".span ", other["start"], "..", other["end"])),
        (wrong, "UnexpectedNodeKind", F.col("_node"), kind(x["kind"], F.when(stage == 1, "Sentence").otherwise("Word or Punct"))),
        *_span_faults(both, F.when(stage == 2, at["j"]).otherwise(at["n"]), {"s": F.col("_before.start"), "e": F.col("_before.end")}, F.col("_spot")),
        (F.lit(True), "ChildSpanOutsideParent", F.col("_spot"), _path("child ", x["start"], "..", x["end"], " falls outside parent ", other["start"], "..", other["end"])),
    ]

    def first(*values: Column | int) -> Column:
        """The value that belongs to the first broken rule."""
        out = None
        for (broken, *_), (n, v) in zip(faults, enumerate(values), strict=True):
            test = F.col("_rule") == n if "_rule" in docs.columns else broken
            out = F.when(test, v) if out is None else out.when(test, v)
        return out

    docs = docs.withColumn("_rule", first(*range(len(faults))))
    docs = docs.select(key, first(*[code for _, code, _, _ in faults]).alias("code"), first(*[path for _, _, path, _ in faults]).alias("path"), first(*[what for *_, what in faults]).alias("_what"))
    return docs.select(key, "code", "path", _path("at ", F.col("path"), ": ", F.col("_what")).alias("message"))
