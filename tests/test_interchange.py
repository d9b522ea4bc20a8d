"""Interchange documents, their contract, the gate of projections and their readers."""

import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlens.functions import lexer
from textlens.functions import vocabulary as V
from textlens.operators import annotate, consumers, contract, external, interchange, render, structure, validate
from textlens.operators.contract import Contract
from textlens.plans import queries as plans
from textlens.sources import cases, documents

TEXT = "Paris – é is big. We saw Rome.\n\nThe 2 cats sat."


@pytest.fixture(scope="module")
def built(spark):
    docs = spark.createDataFrame([(1, "one", TEXT), (2, "none", None), (3, "empty", "")], "doc_id long, name string, text string")
    found = interchange.analyses(docs)
    return docs, found, {r["doc_id"]: r["json"] for r in interchange.canonical_json(found).collect()}


def test_canonical(spark, built):
    _, found, texts = built
    for text in texts.values():
        assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    one = json.loads(texts[1])
    assert one["source"]["utf8ByteLength"] == len(TEXT.encode()) and [n["childNodeIds"] for n in one["structure"]][:2] == [[2, 3], [4]]
    assert one["derivation"][1]["ruleId"] == "contextual-open-class-annotator"
    assert json.loads(texts[2])["tokens"] == [] and json.loads(texts[3])["structure"] == []
    assert validate.interchange_errors(found, found.select("doc_id", "bytes")).count() == 0


def test_written_documents_come_back(spark, built, tmp_path):
    path = str(tmp_path / "ir")
    interchange.write(built[1], path)
    spark.createDataFrame([("{",)], "value string").write.mode("append").text(path)
    good, bad = interchange.read(spark, path)
    back = interchange.canonical_json(good.withColumn("doc_id", F.lit(0))).collect()
    assert sorted(r["json"] for r in back) == sorted(built[2].values())
    assert [r["error"] for r in bad.collect()] == ["malformed"]


#: Children by node, and the broken edges (node, place) by code.
ROUGH = [
    ([[1], [0, 2], [], [9, 0], [3]], {"StructureCycle": [(1, 0)], "DanglingChildRef": [(3, 0)], "MultipleStructureParents": [(3, 1)]}),
    ([[0]], {"StructureCycle": [(0, 0)]}),
    ([[1, 2], [], []], {}),
    ([[1], [2], [3], [4], [1]], {"StructureCycle": [(4, 0)], "MultipleStructureParents": [(4, 0)]}),
]


def test_edges_and_cycles(spark):
    rows = [(d, i, i, 0, 9, kids) for d, (tree, _) in enumerate(ROUGH) for i, kids in enumerate(tree)]
    nodes = spark.createDataFrame(rows, "_row long, i int, node_id int, start int, end int, children array<int>")
    found = {}
    for f in (structure.broken_edges, structure.closing_edges):
        for r in f(nodes, []).collect():
            found.setdefault((r["_row"], r["code"]), []).append((r["i"], r["j"]))
    assert {k: sorted(v) for k, v in found.items()} == {(d, code): places for d, (_, codes) in enumerate(ROUGH) for code, places in codes.items()}
    twice = nodes.unionByName(nodes.where("i = 0").withColumn("i", F.lit(7)))
    assert {(r["_row"], r["i"]) for r in structure.repeated_nodes(twice, []).collect()} == {(d, 7) for d in range(4)}
    assert structure.closing_edges(nodes.limit(0), []).count() == structure.broken_edges(nodes.limit(0), []).count() == 0


def test_plain_annotator_has_its_own_name(spark, built):
    found = interchange.analyses(built[0], Contract(contextual=False)).where("doc_id = 1").first()["analysis"]
    assert found["derivation"][1]["ruleId"] == "lexical-annotator"


def test_malformed_json_is_refused(spark):
    good, bad = interchange.read_json(spark.createDataFrame([(1, "{"), (2, None)], "doc_id long, json string"))
    assert good.count() == 0 and bad.count() == 2


def test_gate(spark, built):
    good, bad = interchange.project(built[0])
    assert good.count() == 3 and bad.count() == 0
    for c, kind in ((Contract(annotator=("segment", "x")), "DuplicatePassId"), (Contract(parser=("", "")), "MissingPassIdentity")):
        good, bad = interchange.project(built[0], c)
        assert good.count() == 0 and {r["error"] for r in bad.collect()} == {kind}
        with pytest.raises(ValueError):
            interchange.analyses(built[0], c)
    trees = cases.broken_trees(spark).where("doc_id IN (0, 2)").withColumn("doc_id", F.col("doc_id") + 1)
    good, bad = interchange.project(built[0], classified=trees)
    assert [(r["doc_id"], r["error"]) for r in bad.collect()] == [(3, "InvalidClassification")] and good.count() == 2


def test_repeated_documents(spark, built):
    twice = interchange.analyses(built[0].union(built[0]))
    assert validate.with_errors(twice).where("size(errors) > 0").count() == 0 and twice.count() == 6


SDL = '"One line."\ntype A {\n  a: Int!\n}\n"""\nBlock\n"""\ntype B {\n  "field"\n  b: Int\n}\n"""one"""\n'


def test_schema_hash_ignores_descriptions():
    bare = "type A {\n  a: Int!\n}\ntype B {\n  b: Int\n}"
    assert contract.strip_descriptions(SDL) == bare and contract.schema_hash(SDL) == contract.schema_hash(bare) != contract.schema_hash(bare + "x")


def _manifest():
    axes = [dict(zip(("tokenKind", "lexicalClass", "openClassKind", "visualRole"), a, strict=True)) for a in V.AXES]
    roles = [dict(zip(("visualRole", "ansi", "lspTokenType", "highlightClass"), r, strict=True)) for r in V.ROLES]
    return {"version": "v", "classRoles": axes, "roleProjections": roles}


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda m: m.update(version="w"), "does not match"), (lambda m: m.update(other=1), "shape"), (lambda m: m["roleProjections"].pop(), "projection roles"), (lambda m: m["roleProjections"].append(m["roleProjections"][0]), "duplicate projection"),
        (lambda m: m["classRoles"].append(m["classRoles"][0]), "duplicate class role"), (lambda m: m["classRoles"].pop(), "do not match"), (lambda m: m["classRoles"][0].update(visualRole="X"), "without a projection"), (lambda m: m["classRoles"][0].update(extra=1), "shape"),
    ],
)
def test_manifests(change, message):
    good = _manifest()
    axes, projections = contract.read_manifest(json.dumps(good).encode(), "v")
    assert axes == V.AXES and projections == V.ROLES
    change(good)
    with pytest.raises(ValueError, match=message):
        contract.read_manifest(json.dumps(good).encode(), "v")


def test_profiles(spark):
    found = cases.broken_documents(spark).where("doc_id = -1000")
    c = Contract()
    for profiles, code in (([("x", c.schema_hash, c.vocabulary_hash)], "E_CONTRACT_VERSION"), ([(c.version, "x", c.vocabulary_hash), ("y", c.schema_hash, "z")], "E_SCHEMA_HASH"), ([(c.version, c.schema_hash, "x")], "E_VOCABULARY_HASH"), ([(c.version, c.schema_hash, c.vocabulary_hash)], None)):
        assert consumers.consume(found, profiles).first()["code"] == code


def test_editor_consumer(spark):
    text = "a \U0001f600\r\nthe é"
    rows = [(1, text, [1, 0, 3, 0, 0]), (2, text, [0, 3, 1, 0, 0]), (3, text, [0, 0, 1, 99, 0]), (4, text, [0, 0, 1]), (5, text, [2, 0, 1, 0, 0]), (6, None, [])]
    found = spark.createDataFrame(rows, "doc_id long, text string, data array<int>")
    out = {r["doc_id"]: r["code"] for r in consumers.consume_editor(found).collect()}
    assert out == {1: None, 2: "E_LSP_POSITION", 3: "E_LSP_SHAPE", 4: "E_LSP_SHAPE", 5: "E_LSP_POSITION", 6: None}
    assert {r["code"] for r in consumers.consume_editor(found, ["noun"]).collect()} == {"E_LSP_LEGEND"}
    assert "`8..11` | `the`" in consumers.consume_editor(found).where("doc_id = 1").first()["report"]


def test_coordinates():
    assert consumers.same_coordinates("é`x`", "é   ")
    assert not consumers.same_coordinates("a\nb", "a b") and not consumers.same_coordinates("abc", "ab") and not consumers.same_coordinates("\U0001f600", "abcd")


def test_failures_are_rows(spark):
    row = spark.range(1).select(*render.failure("invalid-classification", "at tokens: x")).first()
    assert (row["code"], row["severity"], row["start_line"]) == ("textlens/invalid-classification", "ERROR", 0)


SCRIPT = """import json, sys, time
text = sys.stdin.buffer.read().decode()
if "slow" in text: time.sleep(9)
if "fail" in text: sys.stderr.write("bad thing"); sys.exit(7)
if "big" in text: print("x" * 5000); sys.exit(0)
if "bytes" in text: sys.stdout.buffer.write(b"\\xff"); sys.exit(0)
print(json.dumps({"stdin.txt": [{"Action": {"Name": "", "Params": None}, "Span": [1, 2], "Check": "A.B", "Description": "", "Link": "", "Message": "m", "Severity": "error", "Match": text[:2], "Line": 1}]}))
"""


def test_external_process(spark, tmp_path):
    import sys
    import threading

    path = tmp_path / "fake.py"
    path.write_text(SCRIPT)
    run = external.Analyzer((sys.executable, str(path)), (sys.executable, "-c", "print('own version 3.14.2')"), timeout=2.0, max_bytes=2000)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ok text", "slow", "fail", "big", "bytes"])], "doc_id long, text string")
    out = {r["doc_id"]: (r["rule"], r["severity"], r["error"]) for r in external.analyze(docs, run).collect()}
    assert out == {0: ("vale/A.B", "warning", None), 1: (None, None, "Timeout"), 2: (None, None, "ProcessFailure"), 3: (None, None, "OutputTooLarge"), 4: (None, None, "InvalidUtf8")}
    assert run.version() == (3, 14, 2)
    stop = threading.Event()
    stop.set()

    def kind(call):
        with pytest.raises(external.AnalyzerError) as e:
            call()
        return e.value.kind

    assert kind(lambda: run.analyze("x", stop)) == "Cancelled" and kind(lambda: external.Analyzer(("/no/such",)).analyze("x")) == "Unavailable" and kind(lambda: external.Analyzer(())) == "Configuration"
    assert kind(lambda: external.Analyzer(("x",), (sys.executable, "-c", "print('v2.0.1')")).version()) == "IncompatibleVersion" and kind(lambda: external.Analyzer(("x",), (sys.executable, "-c", "print('nothing')")).version()) == "UnrecognizedVersion"
    found = external.prepared(external.analyze(docs.where("doc_id = 0"), run), docs)
    assert external.bind(found, docs).first()["error"] is None
    assert external.bind(found, docs.withColumn("text", F.lit("new"))).first()["error"] == "SourceMismatch"


def test_rule_codes():
    assert all(map(external.valid_code, ("a/b", "vale/A.B-c_1", "a/b/c"))) and not any(map(external.valid_code, ("a", "a/", "/b", "a//b", "a b/c", "é/b", "a/" + "b" * 128)))


def test_classifications_are_checked_in_their_row(spark):
    # long enough that reading the text once an offset, or meeting parts and tokens in a join, would show
    n = 4_000
    parts = [("Word", 3 * i, 3 * i + 2) for i in range(n)]
    spans = [(s, e) for _, s, e in parts]
    trees = [(1, ("Document", [("Sentence", 0, 3 * n, parts)]), spans), (2, ("Document", [("Sentence", 0, 3 * n, parts)]), [*spans[:-1], (3 * n - 2, 3 * n - 1)])]
    given = spark.createDataFrame([(i, "é " * n, tree, own) for i, tree, own in trees], f"doc_id long, text string, tree {validate.TREE}, tokens array<{validate.SPAN}>")
    found = validate.classification_errors(given)
    assert "Exchange" not in found._jdf.queryExecution().toString() and "Join" not in found._jdf.queryExecution().toString()
    assert [tuple(r)[:3] for r in found.collect()] == [(2, "SpanNotOnCharBoundary", f"tokens[{n - 1}].span.start")]


def test_sentences_carry_their_tokens(spark):
    docs = spark.createDataFrame([(0, 1, "One two. Three!"), (1, 2, None)], "_row long, doc_id long, text string")
    rows = {r["doc_id"]: r for r in annotate.with_sentence_ranges(docs, ["doc_id"]).collect()}
    assert [[t["pos"] for t in s["own"]] for s in rows[1]["sentences"]] == [[0, 1, 2], [3, 4]] and [t for s in rows[1]["sentences"] for t in s["own"]] == rows[1]["tokens"]
    assert rows[2]["sentences"] == [] and rows[2]["tokens"] == []


def test_first_faults_are_found_for_a_batch(spark, monkeypatch):
    span = lambda s, e: {"start": s, "end": e}
    head = lambda s, e, *parts: {"kind": "Sentence", **span(s, e), "parts": [{"kind": "Word", **span(*p)} for p in parts]}
    trees = [[head(0, 4, (0, 2), (3, 4)), head(5, 9, (5, 9), (8, 9))], [head(0, None, (0, 1), (None, 3)), None], None, []]
    tokens = [[span(0, 2), span(3, 4), span(5, 9), span(9, 9)], [span(0, 1), span(2, None)], None, [span(1, 0)]]
    given = (
        pa.array(["aé bcdefg".encode(), b"abc", None, b""]), pa.array([{"kind": "Document", "sentences": t} for t in trees], pa.struct([("kind", pa.string()), ("sentences", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("parts", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])))])),
        pa.array(tokens, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    )
    found = validate._faults(*given)
    place = lambda x: x and (x["n"], x["i"], x["j"], x["s_splits"], x["e_splits"])
    assert [[place(r[c]) for c in ("head", "leaf", "token", "pair")] for r in found.to_pylist()] == [
        [None, (0, 0, 0, False, True), (0, 0, 0, False, True), (3, 1, 1, False, False)], [(1, 1, 1, False, False), None, None, None],
        [None] * 4, [None, None, (0, 0, 0, False, False), None],
    ]
    assert found.field("leaves").to_pylist() == [4, 2, 0, 0]
    monkeypatch.setattr(validate, "PART", 1)
    assert validate._in_parts(validate._faults, *given).to_pylist() == found.to_pylist()
    # the lists are read in the pass, not item by item in expressions
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    rows = docs.select("*", F.lit(None).cast(validate.TREE).alias("tree"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("tokens"))
    assert "transform(" not in validate.classification_errors(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_outlines_are_checked_in_their_row(spark):
    plan = plans.outline_damage(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "a. b\n\nc")], "doc_id long, text string")
    own = {r["doc_id"]: [tuple(n) for n in r["outline"]] for r in render.outlines(docs, ["doc_id"]).collect()}
    assert own == {r["doc_id"]: [tuple(n) for n in r["outline"]] for r in render.with_outline(docs, ["doc_id"]).collect()} and not own[2]
    node = f"struct<byteRange:{interchange.RANGE},childNodeIds:array<int>,nodeId:int>"
    rough = spark.createDataFrame([(1, [((9, 0), [1, 7], 0), ((5, 0), [0], 1), ((12, 0), None, 1)])], f"doc_id long, outline array<{node}>")
    assert sorted(tuple(r)[1:3] for r in validate.outline_errors(rough, ["doc_id"]).collect()) == [
        ("ChildRangeOutsideParent", "structure[1].childNodeIds[0]"), ("DanglingChildRef", "structure[0].childNodeIds[1]"), ("DuplicateNodeId", "structure[2]"), ("StructureCycle", "structure[1].childNodeIds[0]"),
    ]
    # small files must not become large tables in the driver's memory
    nodes = spark.createDataFrame([(0, 0, 0, 0, 9, [1])], "_row long, i int, node_id int, start int, end int, children array<int>")
    for f in (structure.broken_edges, structure.closing_edges):
        assert "Broadcast" not in f(nodes, [])._jdf.queryExecution().executedPlan().toString()


def test_texts_meet_verdicts_before_they_are_analysed(spark):
    plan = plans.projected_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    join = next(depth(line) for line in lines if "Join LeftOuter" in line)
    # the join's rows are cut above it, once; nothing that was cut is exchanged
    above = [line for line in lines if "MapInArrow" in line and depth(line) < join]
    assert len(above) == 1 and "_wrong" in above[0]


def test_reports_exchange_texts_not_tokens(spark):
    plan = plans.diagnose_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sort_array(collect_list(struct(pos" not in plan and "function_axis" not in plan
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line and "LeftOuter" in line)
    assert sum("MapInArrow" in line for line in lines[:join]) == 1 and not any("Exchange" in line for line in lines[:join])


def test_codes_without_messages(spark):
    found = cases.broken_documents(spark)
    columns = ["doc_id", "stage", "i", "j", "k", "code", "path"]
    told = validate.with_errors(found).select("doc_id", F.inline("errors")).select(*columns)
    codes = validate.error_codes(found, ["doc_id"])
    assert sorted(map(str, codes.select(*columns).collect())) == sorted(map(str, told.collect()))
    assert "array_sort" not in codes._jdf.queryExecution().optimizedPlan().toString()


def test_repeats_are_sorted_not_walked():
    lists = [[0, 0, 1, 1, 1], None, [3, 1, 3, 2, 1], [], [5, 4], [1, 2]]
    want = [[1, 3, 4], [], [2, 4], [], [], []]
    assert validate._repeats(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == want
    assert validate._repeats(pa.array([[str(x) for x in v or []] for v in lists], pa.list_(pa.string()))).to_pylist() == want
    assert validate._repeats(pa.array([[1, None, 1, None]], pa.list_(pa.int32()))).to_pylist() == [[2]]
    assert validate._repeats(pa.array([[0, 0], *lists], pa.list_(pa.int32())).slice(1)).to_pylist() == want


def test_trees_are_not_exchanged(spark):
    docs = spark.createDataFrame([(1, 'He "ran." Go 2!'), (2, None), (3, " ")], "doc_id long, text string")
    found = annotate.trees(docs, ["doc_id"])
    for df in (found, annotate.with_sentence_ranges(docs, ["doc_id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [(s["kind"], s["start"], s["end"], [tuple(p) for p in s["parts"]]) for s in rows[1]["sentences"]] == [
        ("Sentence", 0, 9, [("Word", 0, 2), ("Punct", 3, 4), ("Word", 4, 7), ("Punct", 7, 8), ("Punct", 8, 9)]), ("Sentence", 10, 15, [("Word", 10, 12), ("Word", 13, 14), ("Punct", 14, 15)]),
    ]
    assert [tuple(t) for t in rows[1]["tokens"]] == [tuple(p)[1:] for s in rows[1]["sentences"] for p in s["parts"]]
    assert rows[2]["sentences"] == rows[2]["tokens"] == rows[3]["sentences"] == []


def test_projection_is_one_plan(spark):
    docs = spark.createDataFrame([(1, "one", TEXT), (2, "none", None)], "doc_id long, name string, text string")
    found = interchange.projected(docs)
    # the lexer and its second pass for ambiguous words; outlines come from the same tokens
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert [(r["error"], r["analysis"] is not None) for r in found.collect()] == [(None, True)] * 2
    good, bad = interchange.project(docs, Contract(annotator=("", "x")))
    assert good.count() == 0 and bad.count() == 2


def test_line_breaks_are_counted_by_the_lexer():
    texts = ["\r\na\r\n\n b\r", "\nc \r \n\r d", None, "e\r", "\n\nf. g"]
    t = lexer.Texts(pa.array(texts))
    assert t.breaks().tolist() == [len(re.findall("\r\n|\r|\n", g)) for g in t.gaps().to_pylist()] == [1, 2, 1, 3, 0, 2, 0, 0]


def test_outline_damage_cuts_texts_once(spark):
    plan = plans.outline_damage(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_whole_documents_are_not_exchanged(spark):
    texts = [t for _, _, t in documents.FIXTURES] + ["Lead, book fast.\n\nTo record book lead. The’re fast “dogs” 5x book", "", None, "fast", "Take the lead\r\n\r\nbook"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = annotate.whole(docs, ["doc_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    columns = ["pos", "start", "end", "function_axis", "lexical_class", "open_axis", "token_kind"]
    for contextual in (True, False):
        rows = annotate.whole(docs, ["doc_id"], contextual).select("doc_id", F.inline("tokens")).select("doc_id", "occurrenceId", "byteRange.startUtf8", "byteRange.endUtf8", "functionKind", "lexicalClass", "openClassKind", "tokenKind")
        assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, map(tuple, annotate.tokens(docs, columns, contextual).collect())))
    sents = found.select("doc_id", F.inline("sentences")).select("doc_id", "start", "end").collect()
    assert sorted(map(tuple, sents)) == sorted(map(tuple, annotate.sentences(docs).select("doc_id", "start", "end").collect()))


def test_only_suspects_are_spelled_out(monkeypatch):
    texts = pa.array([b"a\xc3\xa9 b", None, b"", b"xyz"])
    starts, ends = pa.array([[0, 2, 4], [0, None], [], [1, 0, 2]], pa.list_(pa.int32())), pa.array([[1, 3, 5], [9, 5], [], [1, 2, 4]], pa.list_(pa.int32()))
    found = validate._suspected(texts, pa.array([5, None, 0, 3], pa.int32()), starts, ends, True).to_pylist()
    assert [[(x["i"], x["s_splits"], x["e_splits"]) for x in own] for own in found] == [[(1, True, False)], [(1, False, False)], [], [(0, False, False), (1, False, False), (2, False, False)]]
    monkeypatch.setattr(validate, "PART", 2)
    assert validate._in_parts(lambda *x: validate._suspected(*x, True), texts, pa.array([5, None, 0, 3], pa.int32()), starts, ends).to_pylist() == found
    lists = lambda *x: pa.array(x, pa.list_(pa.int32()))
    kids = pa.array([[[1], []], [[1], [0]], [[1, 1], []], [[5], []], [[1], []], [[1], []]], pa.list_(pa.list_(pa.int32())))
    n = len(kids)
    sound = validate._sound(lists(*[[0, 1]] * (n - 1), [0, 0]), kids, lists(*[[0, 0]] * n), lists(*[[9, 5]] * 4, [5, 9], [9, 9]))
    assert sound.tolist() == [True, False, False, False, False, False]


def test_report_cuts_styled_tokens_alone(spark, built):
    found = consumers.consume(built[1])
    assert "transform(filter(" in found._jdf.queryExecution().optimizedPlan().toString()
    out = {r["doc_id"]: (r["code"], r["report"]) for r in found.collect()}
    lines = [line.split(" | ") for line in out[1][1].removeprefix(render.REPORT_HEAD).splitlines()]
    raw = TEXT.encode()
    cut = [[raw[slice(*map(int, place.strip("| `").split("..")))].decode(), text.strip("`"), role.strip("` |")] for place, text, role in lines]
    assert all(a == b for a, b, _ in cut) and ["is", "is", "STRUCTURAL_KEYWORD"] in cut and ["2", "2", "LITERAL"] in cut
    assert not {"big", ".", "–", "é"} & {text for _, text, _ in cut} and out[2] == out[3] == (None, render.REPORT_HEAD)
