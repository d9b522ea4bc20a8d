"""Own literal inputs for rules that no corpus breaks: broken documents and trees, alerts, sessions, bytes."""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contract import SCHEMA_HASH, VOCABULARY_HASH

#: The text of the broken documents: two paragraphs, one sentence each.
TEXT = "Ünder it.\n\nGo 2."


def _token(i: int, start: int, end: int, kind: str, lexical=None, function=None, open_=None) -> dict:
    return {"occurrenceId": i, "byteRange": {"startUtf8": start, "endUtf8": end}, "tokenKind": kind, "lexicalClass": lexical, "functionKind": function, "openClassKind": open_}


def _node(i: int, kind: str, start: int, end: int, depth: int, children: list) -> dict:
    return {"nodeId": i, "kind": kind, "byteRange": {"startUtf8": start, "endUtf8": end}, "depth": depth, "childNodeIds": children}


def _step(pass_id: str, rule_id: str) -> dict:
    return {"passId": pass_id, "ruleId": rule_id, "compilerBuildHash": "b", "sourceRanges": [{"startUtf8": 0, "endUtf8": 17}]}


#: A document of TEXT that breaks no rule.
GOOD = {
    "contractVersion": "textlens.syntax/v1", "schemaHash": SCHEMA_HASH, "vocabularyHash": VOCABULARY_HASH,
    "source": {"unitId": "u", "contentHash": "sha256:HASH", "utf8ByteLength": 17},
    "tokens": [_token(0, 0, 6, "WORD", "CONTENT"), _token(1, 7, 9, "WORD", "FUNCTION", "PRONOUN"), _token(2, 9, 10, "PUNCTUATION"), _token(3, 12, 14, "WORD", "CONTENT", None, "VERB"), _token(4, 15, 16, "NUMBER"), _token(5, 16, 17, "PUNCTUATION")],
    "structure": [_node(0, "PARAGRAPH", 0, 10, 0, [2]), _node(1, "PARAGRAPH", 12, 17, 0, [3]), _node(2, "SENTENCE", 0, 10, 1, []), _node(3, "SENTENCE", 12, 17, 1, [])],
    "diagnostics": [], "derivation": [_step("segment", "s"), _step("classify", "c")],
}

#: Changes of GOOD by path; a row for each, numbered from 1; row 0 is GOOD.
CHANGES = [
    {"contractVersion": "other\n\"v\""},
    {"schemaHash": "x​y"},
    {"vocabularyHash": "z"},
    {"source/utf8ByteLength": -1},
    {"source/utf8ByteLength": 16},
    {"source/contentHash": "sha256:no"},
    {"bytes": b"\xff" + TEXT.encode()[1:]},
    {"tokens/0/byteRange/startUtf8": -2},
    {"tokens/3/byteRange/endUtf8": 11},
    {"tokens/5/byteRange/endUtf8": 18},
    {"tokens/0/byteRange/startUtf8": 1},
    {"tokens/4/byteRange/endUtf8": 15},
    {"tokens/3/byteRange/startUtf8": 8},
    {"tokens/2/byteRange/startUtf8": 8},
    {"tokens/3/occurrenceId": 1},
    {"tokens/0/lexicalClass": None},
    {"tokens/1/functionKind": None},
    {"tokens/1/openClassKind": "NOUN"},
    {"tokens/0/functionKind": "ARTICLE"},
    {"tokens/0/lexicalClass": "PROPER_NOUN_CANDIDATE", "tokens/0/openClassKind": "NOUN"},
    {"tokens/2/lexicalClass": "CONTENT"},
    {"tokens/4/functionKind": "ARTICLE"},
    {"tokens/5/openClassKind": "NOUN"},
    {"structure/3/nodeId": 2},
    {"structure/2/depth": 0},
    {"structure/1/childNodeIds": [3, 9]},
    {"structure/1/childNodeIds": [3, 2]},
    {"structure/0/byteRange/endUtf8": 9},
    {"structure/2/childNodeIds": [0]},
    {"diagnostics": [{"byteRange": {"startUtf8": 5, "endUtf8": 1}, "severity": "INFO", "code": "c", "message": "m"}]},
    {"derivation": []},
    {"derivation/0/ruleId": ""},
    {"derivation/1/passId": "segment"},
    {"derivation/1/sourceRanges/0/startUtf8": 1},
    {"diagnostics": [{"byteRange": {"startUtf8": -5, "endUtf8": 99}, "severity": "INFO", "code": "c", "message": "m"}]},
]


def _changed(changes: dict) -> tuple[str, bytes]:
    import hashlib

    doc, raw = copy.deepcopy(GOOD), TEXT.encode()
    doc["source"]["contentHash"] = "sha256:" + hashlib.sha256(raw).hexdigest()
    for path, value in changes.items():
        if path == "bytes":
            raw = value
            continue
        *way, last = [int(p) if p.isdigit() else p for p in path.split("/")]
        at = doc
        for step in way:
            at = at[step]
        at[last] = value
    return json.dumps(doc), raw


def broken_documents(spark: SparkSession) -> DataFrame:
    """doc_id (negative), analysis, bytes; the last one isn't JSON."""
    from ..operators.interchange import ANALYSIS

    rows = [(-1000 - i, *_changed(c)) for i, c in enumerate([{}, *CHANGES])] + [(-1999, "{", TEXT.encode())]
    frame = spark.createDataFrame([(i, j, bytearray(b)) for i, j, b in rows], "doc_id long, json string, bytes binary")
    parsed = F.from_json("json", ANALYSIS[:-1] + ",_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    return frame.select("doc_id", parsed.alias("a"), "bytes").select("doc_id", F.when(F.col("a._bad").isNull(), F.col("a").dropFields("_bad")).alias("analysis"), "bytes")


#: Root kind, sentences (kind, start, end, parts) and tokens over "é a."
_PARTS = [("Word", 0, 2), ("Word", 3, 4), ("Punct", 4, 5)]
_SPANS = [(0, 2), (3, 4), (4, 5)]
TREES = [
    ("Document", [("Sentence", 0, 5, _PARTS)], _SPANS),
    ("Sentence", [], []),
    ("Document", [("Word", 0, 5, _PARTS)], _SPANS),
    ("Document", [("Sentence", 0, 5, [("Sentence", 0, 2), *_PARTS[1:]])], _SPANS),
    ("Document", [("Sentence", 5, 0, _PARTS)], _SPANS),
    ("Document", [("Sentence", 0, 9, _PARTS)], _SPANS),
    ("Document", [("Sentence", 0, 5, [("Word", 0, 1), *_PARTS[1:]])], _SPANS),
    ("Document", [("Sentence", 1, 5, _PARTS)], _SPANS),
    ("Document", [("Sentence", 3, 5, _PARTS[1:]), ("Sentence", 0, 2, _PARTS[:1])], _SPANS),
    ("Document", [("Sentence", 0, 5, [_PARTS[0], ("Word", 0, 4), _PARTS[2]])], _SPANS),
    ("Document", [("Sentence", 0, 4, _PARTS)], _SPANS),
    ("Document", [("Sentence", 0, 5, _PARTS)], [(3, 4), (0, 2), (4, 5)]),
    ("Document", [("Sentence", 0, 5, _PARTS)], _SPANS[:2]),
    ("Document", [("Sentence", 0, 5, _PARTS)], [(0, 2), (3, 4), (4, 4)]),
]


def broken_trees(spark: SparkSession) -> DataFrame:
    from ..operators.validate import SPAN, TREE

    return spark.createDataFrame([(i, "é a.", (kind, sentences), spans) for i, (kind, sentences, spans) in enumerate(TREES)], f"doc_id long, text string, tree {TREE}, tokens array<{SPAN}>")


def byte_rows(spark: SparkSession) -> DataFrame:
    rows = [("a.md", b"# ok"), ("b.MARKDOWN", "é".encode()), ("c.txt", b""), ("d.txt", b"\xff"), ("e.txt", b"ab\xc3"), ("f", b"\xed\xa0\x80"), ("g.txt", b"\xc0\x80")]
    return spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "name string, bytes binary")


def _alert(line: int, first: int, last: int, match: str, **other) -> dict:
    return {"Action": {"Name": "", "Params": None}, "Span": [first, last], "Check": "Own.Word", "Description": "", "Link": "", "Message": "Say less.", "Severity": "warning", "Match": match, "Line": line} | other


_SOURCE = "It is é very\r\nlong 😀 text"
ALERTS = [
    (json.dumps({"stdin.txt": [_alert(2, 6, 6, "😀", Severity="suggestion"), _alert(1, 9, 12, "very"), _alert(1, 9, 12, "very", Check="Own.A", Severity="error")]}),),
    ("{}",), ("[]",), ("{",), (None,),
    (json.dumps({"other": []}),), (json.dumps({"stdin.txt": [], "b": []}),), ('{"stdin.txt": [], "stdin.txt": []}',),
    (json.dumps({"stdin.txt": [_alert(3, 1, 1, "x")]}),), (json.dumps({"stdin.txt": [_alert(1, 1, 2, "xx")]}),), (json.dumps({"stdin.txt": [_alert(1, 12, 13, "y\r")]}),),
    (json.dumps({"stdin.txt": [_alert(1, 1, 2, "It", Check="bad check")]}),), (json.dumps({"stdin.txt": [_alert(1, 1, 2, "It", Severity="fatal")]}),), (json.dumps({"stdin.txt": [_alert(1, 2, 1, "It")]}),),
    (json.dumps({"stdin.txt": [_alert(1, 1, 2, "It", Message="")]}),), (json.dumps({"stdin.txt": [{"Check": "A.B"}]}),),
]


def alerts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, _SOURCE, a) for i, (a,) in enumerate(ALERTS)], "doc_id long, text string, output string")


#: uri, seq, kind, format, start line and character, end line and character, text
EVENTS = [
    ("s:a", 1, "open", "plain", None, None, None, None, "The 😀 cat\r\nis very late."), ("s:a", 2, "change", None, 0, 7, 0, 10, "dog"), ("s:a", 3, "change", None, 1, 3, 1, 7, "just"),
    ("s:b", 1, "open", "markdown", None, None, None, None, "It is `very` good."), ("s:b", 2, "change", None, 0, 99, 0, 99, " Really."), ("s:b", 3, "change", None, 9, 0, 9, 9, " End"),
    ("s:c", 1, "open", "plain", None, None, None, None, "gone"), ("s:c", 2, "close", None, None, None, None, None, None), ("s:c", 3, "change", None, None, None, None, None, "never"),
    ("s:d", 1, "change", None, None, None, None, None, "unknown"), ("s:d", 2, "close", None, None, None, None, None, None),
    ("s:e", 1, "open", "plain", None, None, None, None, "old"), ("s:e", 2, "change", None, None, None, None, None, "new whole\rtext"), ("s:e", 3, "change", None, 1, 0, 1, 4, ""),
    ("s:f", 1, "open", "plain", None, None, None, None, "first"), ("s:f", 2, "open", "markdown", None, None, None, None, "second"),
]


def session_events(spark: SparkSession) -> DataFrame:
    from ..streaming.session import EVENT

    return spark.createDataFrame(EVENTS, EVENT)


def messages(spark: SparkSession) -> DataFrame:
    """An editor's messages: a document opened, edited twice in one notification, another one closed."""
    point = lambda line, char: {"line": line, "character": char}

    def sent(method: str, **params) -> str:
        return json.dumps({"jsonrpc": "2.0", "method": f"textDocument/{method}", "params": params})

    def opened(uri: str, language: str, text: str) -> str:
        return sent("didOpen", textDocument={"uri": uri, "languageId": language, "version": 1, "text": text})

    edits = [{"range": {"start": point(0, 11), "end": point(0, 17)}, "text": "very"}, {"range": {"start": point(0, 0), "end": point(0, 3)}, "text": "A"}]
    rows = [
        opened("file:///a.txt", "plaintext", "The cat is really clear."), sent("didChange", textDocument={"uri": "file:///a.txt", "version": 2}, contentChanges=edits),
        opened("file:///b.md", "Markdown", "The cat is really clear.\n\n```text\nIt is really code.\n```\n"), opened("file:///c.txt", "plaintext", "closed"),
        sent("didClose", textDocument={"uri": "file:///c.txt"}), json.dumps({"id": 4, "method": "shutdown"}), "{",
    ]
    return spark.createDataFrame(list(enumerate(rows)), "seq long, json string")
