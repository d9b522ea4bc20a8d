"""What the rules say of ``sources.cases``, written down by hand, as SQL."""

from __future__ import annotations


def text(v: str) -> str:
    """A text as SQL, control characters spelled out."""
    parts = "'" + v.replace("'", "''") + "'"
    for c in "\n\r\x00":
        parts = parts.replace(c, f"' || chr({ord(c)}) || '")
    return parts


def values(*columns: str, rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else text(v)
    names = ", ".join(f'"{c}"' for c in ("doc_id", *columns))
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) e({names})"


HASH, BAD_HASH = "sha256:b4a69a3181ed0efb73a374adbc0a9b51f8fda02d5ce9d54266506488b144bec1", "sha256:4a1ed66b6d1510d0d427c8d3818439f489439f5a0e6cc8151a22dd337a45e6a7"
SCHEMA, VOCABULARY = "sha256:4404256591b2fbaaf4a7a3fb2ae03fd4256afb4557b605a19c0b966ee287e122", "sha256:c4f1a36f839ba6e56955c60c8fa45f8d6692685fd137eed2a084416f52531461"
_NOT_CONTENT, _NOT_FUNCTION = "only a CONTENT word may carry an openClassKind", "only a FUNCTION word may carry a functionKind"
BROKEN = [
    (-doc, code, path, f"at {path}: {what}")
    for doc, code, path, what in [
        (1001, "UnsupportedContractVersion", "contractVersion", 'unsupported contract version `other\\n\\"v\\"`'),
        (1002, "SchemaHashMismatch", "schemaHash", f"expected `{SCHEMA}`, found `x\\u{{200b}}y`"),
        (1003, "VocabularyHashMismatch", "vocabularyHash", f"expected `{VOCABULARY}`, found `z`"),
        (1004, "NegativeByteLength", "source.utf8ByteLength", "-1 is negative"),
        (1004, "ByteLengthMismatch", "source.utf8ByteLength", "declared -1, actual 17"),
        (1005, "ByteLengthMismatch", "source.utf8ByteLength", "declared 16, actual 17"),
        (1006, "ContentHashMismatch", "source.contentHash", f"expected `{HASH}`, found `sha256:no`"),
        (1007, "ContentHashMismatch", "source.contentHash", f"expected `{BAD_HASH}`, found `{HASH}`"),
        (1007, "SourceNotUtf8", "source", "not valid UTF-8"),
        (1008, "NegativeOffset", "tokens[0].byteRange.startUtf8", "-2 is negative"),
        (1009, "RangeOutOfOrder", "tokens[3].byteRange", "start 12 exceeds end 11"),
        (1010, "RangeOutOfBounds", "tokens[5].byteRange.endUtf8", "18 exceeds source length 17"),
        (1011, "RangeNotOnCharBoundary", "tokens[0].byteRange.startUtf8", "1 is not a UTF-8 character boundary"),
        (1012, "EmptyTokenRange", "tokens[4].byteRange", "token 4 has an empty range"),
        (1013, "UnsortedTokenRange", "tokens[3].byteRange.startUtf8", "start 8 precedes tokens[2] start 9"),
        (1014, "OverlappingTokenRange", "tokens[2].byteRange.startUtf8", "start 8 overlaps tokens[1] ending at 9"),
        (1015, "DuplicateTokenId", "tokens[3]", "duplicate occurrenceId 1"),
        (1016, "IllegalTokenAxes", "tokens[0]", "a WORD token must carry a lexicalClass"),
        (1017, "IllegalTokenAxes", "tokens[1]", "a FUNCTION word must carry a functionKind"),
        (1018, "IllegalTokenAxes", "tokens[1]", _NOT_CONTENT),
        (1019, "IllegalTokenAxes", "tokens[0]", _NOT_FUNCTION),
        (1020, "IllegalTokenAxes", "tokens[0]", _NOT_CONTENT),
        (1021, "IllegalTokenAxes", "tokens[2]", "a non-word token must not carry a lexicalClass"),
        (1022, "IllegalTokenAxes", "tokens[4]", "a non-word token must not carry a functionKind"),
        (1023, "IllegalTokenAxes", "tokens[5]", "a non-word token must not carry an openClassKind"),
        (1024, "DuplicateNodeId", "structure[3]", "duplicate nodeId 2"),
        (1024, "DanglingChildRef", "structure[1].childNodeIds[0]", "references missing child 3"),
        (1025, "InvalidOutlineDepth", "structure[2].depth", "depth 0, expected 1 for this outline kind"),
        (1026, "DanglingChildRef", "structure[1].childNodeIds[1]", "references missing child 9"),
        (1027, "MultipleStructureParents", "structure[1].childNodeIds[1]", "child 2 already belongs to parent 0, not 1"),
        (1027, "ChildRangeOutsideParent", "structure[1].childNodeIds[1]", "child 2 falls outside parent 1"),
        (1028, "ChildRangeOutsideParent", "structure[0].childNodeIds[0]", "child 2 falls outside parent 0"),
        (1029, "StructureCycle", "structure[2].childNodeIds[0]", "edge 2 -> 0 closes a structure cycle"),
        (1030, "RangeOutOfOrder", "diagnostics[0].byteRange", "start 5 exceeds end 1"),
        (1030, "RangeNotOnCharBoundary", "diagnostics[0].byteRange.endUtf8", "1 is not a UTF-8 character boundary"),
        (1031, "EmptyDerivation", "derivation", "must not be empty"),
        (1032, "MissingDerivationIdentity", "derivation[0]", "empty passId or ruleId"),
        (1033, "DuplicateDerivationPassId", "derivation[1]", "duplicate passId `segment`"),
        (1034, "RangeNotOnCharBoundary", "derivation[1].sourceRanges[0].startUtf8", "1 is not a UTF-8 character boundary"),
        (1035, "NegativeOffset", "diagnostics[0].byteRange.startUtf8", "-5 is negative"),
        (1035, "RangeOutOfBounds", "diagnostics[0].byteRange.endUtf8", "99 exceeds source length 17"),
    ]
]
REPORTED = (
    ["E_CONTRACT_VERSION", "E_SCHEMA_HASH", "E_VOCABULARY_HASH", "E_SOURCE_LENGTH", "E_SOURCE_LENGTH", "E_SOURCE_HASH", "E_SOURCE_UTF8"]
    + ["E_RANGE"] * 7 + ["E_SHAPE"] + ["E_AXES"] * 8 + ["E_SHAPE"] * 6 + ["E_RANGE"] + ["E_SHAPE"] * 3 + ["E_RANGE"] * 2
)
ADMITTED = [
    ("E_CONTRACT_VERSION", "contractVersion"), ("E_SCHEMA_HASH", "schemaHash"), ("E_VOCABULARY_HASH", "vocabularyHash"), ("E_ARTIFACT_SHAPE", "source.utf8ByteLength"), ("E_BYTE_LENGTH", "source.utf8ByteLength"),
    ("E_CONTENT_HASH", "source.contentHash"), ("E_SOURCE_UTF8", "source"), ("E_ARTIFACT_SHAPE", "tokens[0].byteRange.startUtf8"), ("E_BYTE_RANGE_ORDER", "tokens[3].byteRange"), ("E_BYTE_RANGE_BOUNDS", "tokens[5].byteRange.endUtf8"),
    ("E_BYTE_RANGE_BOUNDARY", "tokens[0].byteRange.startUtf8"), ("E_TOKEN_EMPTY", "tokens[4].byteRange"), ("E_TOKEN_UNSORTED", "tokens[3].byteRange.startUtf8"), ("E_TOKEN_OVERLAP", "tokens[2].byteRange.startUtf8"),
    ("E_DUPLICATE_OCCURRENCE_ID", "tokens[3]"), *[("E_TOKEN_AXES", f"tokens[{i}]") for i in (0, 1, 1, 0, 0, 2, 4, 5)], ("E_DUPLICATE_NODE_ID", "structure[3]"), ("E_OUTLINE_DEPTH", "structure[2].depth"),
    ("E_DANGLING_CHILD_REF", "structure[1].childNodeIds[1]"), ("E_MULTIPLE_STRUCTURE_PARENTS", "structure[1].childNodeIds[1]"), ("E_CHILD_RANGE", "structure[0].childNodeIds[0]"), ("E_STRUCTURE_CYCLE", "structure[2].childNodeIds[0]"),
    ("E_BYTE_RANGE_ORDER", "diagnostics[0].byteRange"), ("E_EMPTY_DERIVATION", "derivation"), ("E_MISSING_DERIVATION_IDENTITY", "derivation[0]"), ("E_DUPLICATE_DERIVATION_PASS_ID", "derivation[1]"),
    ("E_BYTE_RANGE_BOUNDARY", "derivation[1].sourceRanges[0].startUtf8"), ("E_ARTIFACT_SHAPE", "diagnostics[0].byteRange.startUtf8"),
]
_S0 = "tree.root.sentences[0]"
TREE_ERRORS = [
    (i, code, path, f"at {path}: {what}")
    for i, (code, path, what) in enumerate(
        [
            ("UnexpectedNodeKind", "tree.root", "expected Document, found Sentence"),
            ("UnexpectedNodeKind", _S0, "expected Sentence, found Word"),
            ("UnexpectedNodeKind", f"{_S0}.parts[0]", "expected Word or Punct, found Sentence"),
            ("ReversedSpan", f"{_S0}.span", "start 5 exceeds end 0"),
            ("SpanOutOfBounds", f"{_S0}.span.end", "9 exceeds source length 5"),
            ("SpanNotOnCharBoundary", f"{_S0}.parts[0].span.end", "1 is not a UTF-8 character boundary"),
            ("SpanNotOnCharBoundary", f"{_S0}.span.start", "1 is not a UTF-8 character boundary"),
            ("UnsortedSpan", "tree.root.sentences[1].span.start", "start 0 precedes item 0 start 3"),
            ("OverlappingSpan", f"{_S0}.parts[1].span.start", "start 0 overlaps item 0 ending at 2"),
            ("ChildSpanOutsideParent", f"{_S0}.parts[2].span", "child 4..5 falls outside parent 0..4"),
            ("UnsortedSpan", "tokens[1].span.start", "start 0 precedes item 0 start 3"),
            ("TreeTokenCountMismatch", "tokens", "tree has 3 leaves but annotator emitted 2 tokens"),
            ("TreeTokenSpanMismatch", "tokens[2].span", f"token 4..4 does not match {_S0}.parts[2].span 4..5"),
        ],
        1,
    )
]
ALERTS = [
    (0, 0, 9, 13, "vale/Own.A", "warning", "Say less.", None), (0, 1, 9, 13, "vale/Own.Word", "warning", "Say less.", None), (0, 2, 20, 24, "vale/Own.Word", "info", "Say less.", None),
    *[
        (i, 0, None, None, None, None, message, kind)
        for i, kind, message in [
            (2, "MalformedOutput", "output must be an object keyed by one source"),
            (3, "MalformedOutput", "output is not valid JSON: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"),
            (4, "Unavailable", "no output"), (5, "SourceMismatch", "the analyzer returned an unexpected source"), (6, "MalformedOutput", "the analyzer returned 2 sources for one document"),
            (7, "MalformedOutput", "the analyzer returned a source twice"), (8, "InvalidAlert", "alert check (8 bytes) line 3 is outside the source"),
            (9, "InvalidAlert", "alert check (8 bytes) match length 2 does not equal source slice length 2"), (10, "InvalidAlert", "alert check (8 bytes) end column 13 is outside line 1"),
            (11, "InvalidAlert", "alert check (9 bytes) cannot form an external rule code"), (12, "InvalidAlert", "alert check (8 bytes) has unsupported severity (5 bytes)"),
            (13, "InvalidAlert", "alert check (8 bytes) has invalid inclusive columns (2, 1)"), (14, "InvalidAlert", "alert check (8 bytes) has an empty message"), (15, "InvalidAlert", "alert shape is invalid"),
        ]
    ],
]
SESSIONS = """VALUES ('s:a', 3, 'plain', 'The 😀 dog' || chr(13) || chr(10) || 'is just late.'), ('s:b', 3, 'markdown', ' Endry` good. Really.'), ('s:e', 3, 'plain', 'new whole' || chr(13)), ('s:f', 1, 'markdown', 'second')"""
SHOWN = """SELECT * FROM (VALUES ('file:///a.txt', '3', 'accepted', '0,0,1,0,0,0,2,3,4,0,0,4,2,0,0', '0:9-0:13 INFORMATION weak-word: weak word ''very'''), ('file:///b.md', '1', 'accepted', '0,0,3,0,0,0,4,3,4,0,0,4,2,0,0', '0:11-0:17 INFORMATION weak-word: weak word ''really'''),
('s:a', '3', 'accepted', '0,0,3,0,0,0,7,3,4,0,1,0,2,0,0', '1:3-1:7 INFORMATION weak-word: weak word ''just'''), ('s:b', '3', 'accepted', '', '0:14-0:20 INFORMATION weak-word: weak word ''really'''), ('s:e', '3', 'accepted', '', ''), ('s:f', '1', 'accepted', '', '')) e(uri, result_id, status, data, diagnostics)"""
BYTES = """SELECT * FROM (VALUES ('a.md', 'markdown', '# ok', NULL), ('b.MARKDOWN', 'markdown', 'é', NULL), ('c.txt', 'plain', '', NULL), ('d.txt', NULL, NULL, 'invalid-utf8'), ('e.txt', NULL, NULL, 'invalid-utf8'), ('f', NULL, NULL, 'invalid-utf8'), ('g.txt', NULL, NULL, 'invalid-utf8')) g(name, format, text, error)"""
