"""Token, class and finding expectations on small texts; SQL parity of every query on the small corpus."""

import json
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textlens.functions import lexer, markdown
from textlens.functions import vocabulary as V
from textlens.operators import annotate, lint, prose, render
from textlens.plans import queries as plans
from textlens.sources import documents

SF = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate(texts)], "doc_id long, name string, text string")


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("doc_id", "pos").select(*columns).collect()]


def kinds(text):
    t = lexer.Texts(pa.array([text]))
    return list(zip(t.lexemes().to_pylist(), t.kinds().to_pylist(), strict=True))


def test_tokens_are_bytes(spark):
    assert rows(annotate.tokens(docs(spark, "é a-b 1,2.")), "lexeme", "kind", "start", "end") == [("é", "word", 0, 2), ("a-b", "word", 3, 6), ("1,2", "number", 7, 10), (".", "end", 10, 11)]


def test_empty_null_and_repeated_ids(spark):
    assert annotate.tokens(docs(spark, "", None, " \n ")).count() == 0
    twice = spark.createDataFrame([(1, "a. b"), (1, "c d."), (None, "e")], "doc_id long, text string")
    assert sorted((r["lexeme"], r["start"], r["sent_id"]) for r in annotate.tokens(twice).collect()) == [(".", 1, 0), (".", 3, 0), ("a", 0, 0), ("b", 3, 1), ("c", 0, 0), ("d", 2, 0), ("e", 0, 0)]
    assert {r["data"] is not None for r in render.editor_tokens(docs(spark, None, ""), ["doc_id"]).collect()} == {True}


def test_long_tokens():
    assert kinds("a" + "-a" * 50_000)[0][1] == "word" and len(kinds("a" + "-a" * 50_000)) == 1


# a scanner of its own for the lexer's rules
_SCAN = re.compile(r"[^\W\d_][^\W_]*(?:['\u2019-][^\W_]+)*|[0-9]+(?:[.,][0-9]+)*|[.!?]+|[ \t\r\n\f]+|.", re.S)


@settings(max_examples=400, deadline=None)
@given(st.text("ab1 2.,'\u2019-!?\n\r\t(\"\U0001f600\u00e9", max_size=40))
def test_lexer_against_a_scanner(text):
    want = [m for m in _SCAN.findall(text) if m.strip(" \t\r\n\f")]
    assert [x for x, _ in kinds(text)] == want
    t = lexer.Texts(pa.array(["x y", text, None, text]))
    raw = text.encode()
    own = t.doc == 1
    assert [raw[s:e].decode() for s, e in zip(t.start[own], t.end[own], strict=True)] == want
    for name in ("kind", "start", "end", "char", "unit", "glued"):
        assert np.array_equal(getattr(t, name)[own], getattr(t, name)[t.doc == 3])
    units, gaps = text.encode("utf-16-le"), np.array(t.gaps().to_pylist(), object)[own]
    at = 0
    for s, c, u, x, gap, glued, broken in zip(t.start[own], t.char[own], t.unit[own], want, gaps, t.glued[own], t.broken()[own], strict=True):
        assert text[c:].startswith(x) and units[2 * u :].startswith(x.encode("utf-16-le")) and raw[at:s].decode() == gap
        assert glued == (not gap and at > 0) and broken == (at > 0 and bool(re.search("[\r\n]", gap)))
        at = s + len(x.encode())


def test_places(spark):
    texts = ["a\r\n\U0001f600 b\rc\n\nd", "\n\nx", "é y\n", "no break"]
    for r in annotate.tokens(docs(spark, *texts), ["lexeme", "row", "col", "col16", "end_col", "len16"]).collect():
        line = re.split("\r\n|\r|\n", texts[r["doc_id"]])[r["row"]]
        assert line[r["col"] : r["end_col"]] == r["lexeme"] == line.encode("utf-16-le")[2 * r["col16"] : 2 * (r["col16"] + r["len16"])].decode("utf-16-le")


@pytest.mark.parametrize(("text", "count"), [('"Hi." Go.', 2), ('Hi. "Go."', 2), ("a.b", 2), ("e.g. x", 3), ("", 0), ("?!?!", 1), ("1.5 x", 1)])
def test_sentences(spark, text, count):
    assert annotate.sentences(docs(spark, text)).count() == count


def test_new_numerals():
    assert kinds("\U00011de1\U00016ff4") == [("\U00011de1\U00016ff4", "number")]


def test_senses(spark):
    text = "I will book a room. The book is old. The lead pipe fell. She writes fast. A fast car."
    found = annotate.tokens(docs(spark, text)).where(annotate.F.lower("lexeme").isin(V.AMBIGUOUS))
    assert rows(found, "lexeme", "open_kind") == [("book", "Verb"), ("book", "Noun"), ("lead", "Adjective"), ("fast", "Adverb"), ("fast", "Adjective")]
    assert annotate.word_count() == {"closed": 240, "open": 16}


def test_long_runs_of_ambiguous_words(spark):
    found = rows(annotate.tokens(docs(spark, "to " + "book " * 9 + "dog", "the " + "lead " * 20_000 + "dog")), "doc_id", "pos", "open_kind")
    assert [k for d, p, k in found if d == 0 and p < 4] == [None, "Verb", None, None]
    assert {k for d, p, k in found if d == 1 and 0 < p <= 20_000} == {"Adjective"}


def test_every_query_has_one_exchange_of_tokens(spark):
    """Sentences and classes need no exchange but that by row number."""
    plan = annotate.sentences(docs(spark, "a")).select("sent_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_row") == plan.count("Exchange ") == 1 and plan.count("MapInArrow") == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_join_neither_lines_nor_texts(spark):
    """Places come with a finding's tokens; what is exchanged are the tokens that rules are about."""
    plan = _plan(lint.placed_findings(docs(spark, "a")))
    assert "SortMergeJoin" not in plan and "posexplode" not in plan.replace("posexplode(_words", "")
    assert "Exchange" not in _plan(lint.run_ons(docs(spark, "a")))


def test_classes_exchange_ambiguous_words_alone(spark):
    for df in (annotate.tokens(docs(spark, "a"), ["pos", "role"]), render.highlight_spans(docs(spark, "a"))):
        assert _plan(df).count("Exchange hashpartitioning") == 1
    given = annotate.classified(docs(spark, "A big old book fell on the far side."), [], ["start"], annotate.beside_ambiguous)
    assert [r["lexeme"] for r in given.orderBy("start").collect()] == ["old", "book", "fell"]


def test_words_beyond_reach_make_no_passive(spark):
    """Tokens that the lexer leaves out lie between words that other rules keep."""
    d = docs(spark, "It was closed a b is c d e f written", "It is. Written by book it was lost very by a book", "The door is lost by a book.")
    found = lint.findings(d).where("rule = 'passive-voice'")
    assert sorted((r["doc_id"], r["message"]) for r in found.collect()) == [(2, "passive-voice candidate 'is lost'")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aOf Bthe'\u2019\u00c4\u00e91.-\r\n", max_size=30), max_size=4))
def test_titles_against_words(texts):
    closed = {w for w, _ in V.CLOSED_ROWS}
    want = []
    for i, text in enumerate(texts):
        row = 0
        for line in re.split(r"(?<=[\r\n])", text):
            words = re.findall(r"(?:[^\W\d_]|['\u2019])+", line)
            others = [w for w in words if not w[0].isupper()]
            if len(words) - len(others) >= 2 and all(w.replace("\u2019", "'").lower() in closed for w in others):
                want.append((i, len(re.findall("\r\n|\r|\n", text[:row]))))
            row += len(line)
    t = lexer.Texts(pa.array(texts, pa.string()))
    assert list(zip(*(x.tolist() for x in t.title_rows()), strict=True)) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aB1.!'\u2019)\"\U0001f600 \r\n", max_size=25), max_size=4))
def test_sentences_and_places_token_by_token(texts):
    t = lexer.Texts(pa.array(texts, pa.string()))
    got = list(zip(t.sent_id().tolist(), t.ends().tolist(), t.words().tolist(), t.nth().tolist(), t.start[t.head].tolist(), t.row().tolist(), t.col().tolist(), strict=True))
    want = []
    for i, text in enumerate(texts):
        own = [(x, k, c, s, g) for x, k, d, c, s, g in zip(t.lexemes().to_pylist(), t.kinds().to_pylist(), t.doc.tolist(), t.char.tolist(), t.start.tolist(), t.glued.tolist(), strict=True) if d == i]
        anchor, sent, words, nth, first, rows = None, 0, 0, 0, 0, []
        for x, kind, c, s, glued in own:
            closer = glued and x in V.CLOSERS
            if anchor == "end" and not closer:
                sent, words = sent + 1, 0
            first = s if not rows or rows[-1][0] != sent else first
            word = kind in ("word", "number")
            words += word
            before = re.split("\r\n|\r|\n", text[:c])
            rows.append([sent, False, words, nth, first, len(before) - 1, len(before[-1])])
            nth += word
            anchor = anchor if closer else kind
        for k, r in enumerate(rows):
            r[1] = k + 1 == len(rows) or rows[k + 1][0] != r[0]
        want += [tuple(r) for r in rows]
    assert got == want


def test_sql_tokens_stay_arrays(spark):
    """No token is a Python row; the function for tables gives what the one for single texts gives."""
    found = plans.queries()["sql_tokens"](spark, SF)
    assert "ArrowEvalPython" in _plan(found) and "BatchEvalPythonUDTF" not in _plan(found)
    docs(spark, "a b. c", None, "", "\u00e9 1").createOrReplaceTempView("few_texts")
    own, other = (sorted(map(tuple, spark.sql(f"SELECT d.doc_id, t.* FROM few_texts d, LATERAL {f} t").collect())) for f in ("tokenize_prose(d.text)", "inline(prose_tokens(d.text))"))
    assert own == other and len(own) == 6


def test_one_long_line_is_no_title(spark):
    """Tests of a line are linear in it."""
    found = annotate.title_lines(docs(spark, "A" * 300_000 + "\nThe Day of Days\n" + "A1" * 200_000 + "\r\nOf a Day\r\nAn Old Day")).collect()
    assert sorted(r["row"] for r in found) == [1, 2, 3, 4]


def test_passive(spark):
    d = spark.createDataFrame([r for r in documents.FIXTURES if r[1] == "passive"], "doc_id long, name string, text string")
    found = lint.passive_voice(d)
    assert sorted(r["message"] for r in found.collect()) == ["passive-voice candidate '" + m + "'" for m in ("is closed", "is, written", "was carefully reviewed", "was written")]


def test_run_on_boundary(spark):
    d = docs(spark, " ".join(["w"] * 40) + ".", " ".join(["w"] * 41) + ".")
    assert [r["doc_id"] for r in lint.run_ons(d).collect()] == [1]


def test_report_positions(spark):
    d = docs(spark, "One é.\r\nIt was very late.")
    assert [r["line"] for r in lint.report_lines(d).collect()] == ["t0:2:8: info [weak-word]: weak word 'very'"]


def test_ansi_strips_back(spark):
    d = docs(spark, 'The "é" cat\n runs 5!', "", "  ", None)
    colored = {r["doc_id"]: r["colored"] for r in render.ansi(d).collect()}
    assert {k: v and re.sub("\x1b\\[[0-9;]*m", "", v) for k, v in colored.items()} == {r["doc_id"]: r["text"] for r in d.collect()}
    assert {r["colored"] for r in render.ansi(d, color=False).collect()} == {r["text"] for r in d.collect()}


def test_masked_marks_are_not_styled(spark):
    d = prose.prose(spark.createDataFrame([(1, "The x\n\n```\n.the\n```\n", "markdown")], "doc_id long, text string, format string"))
    assert render.ansi(d).first()["colored"] == "\x1b[1;35mThe\x1b[0m x\n\n```\n.the\n```\n"


def test_bundles(spark):
    bundle = json.loads(render.highlight_bundles(docs(spark, "a\n\U0001f600 the")).first()["bundle"])
    assert bundle["syntax"]["spans"][-1] == {"className": "keyword", "range": {"start": {"row": 1, "column": 2}, "end": {"row": 1, "column": 5}}}


MASKED = [
    ("Say `a b` now.", "Say       now."), ("a\n\n    code\n\nb", "a\n\n    .   \n\nb"), ("[a](b (c) 'd')", "[a](b (c) 'd')"), ("[a](b_(c))", "[a]       "), ("[a](<b c> \"d (\")", "[a]             "), ("t](x)", "t](x)"),
    ("[a][b]\n\n[b]: u\n[b]: v\n", "[a]   \n\n.     \n      \n"), ("![a][]\n\n[a]: u", "![a]  \n\n.     "), ("[a][no]", "[a][no]"), ("<b>x</b> <a@b.c>", "   x            "), ("---\na: b\n---\nc", ".  \n    \n   \nc"),
    ("---\nno end", "---\nno end"), ("`a", "`a"), ("~~~\na\r\nb", ".  \n \r\n "), ("<div>\nx\n\ny", ".    \n \n\ny"), ("> `a`\n> b", ">    \n> b"), ("- a\n\n      c\n", "- a\n\n      .\n"), ("a \\`b\\` c", "a \\`b\\` c"),
    ("A\n===\n`b`", "A\n===\n   "), ("[a\\]b][c]\n\n[c]: <d>", "[a\\]b]   \n\n.       "),
]


@pytest.mark.parametrize(("text", "want"), MASKED)
def test_masks(text, want):
    assert markdown.mask(text) == want


def test_masks_as_a_plan(spark):
    """The window and the expressions give what merging and blanking each text by itself gives."""
    rng = random.Random(5)
    made = ["".join(rng.choices("ab`[]()<>!\\#->+~:\"' \t\n\r*_=.1\u00e9\u6f22\U0001f600", k=rng.randrange(80))) for _ in range(3000)]
    made += ["`a``b`" * 500, "", None, "[a]: b\n\n<div>\n\n```\n", *[t for t, _ in MASKED]]
    d = spark.createDataFrame([(i, t, "markdown") for i, t in enumerate(made)] + [(-1, "`a`", "plain"), (-2, "`a`", None), (-1, "`b`", "markdown")], "doc_id long, text string, format string")
    got = [(r["doc_id"], r["prose"]) for r in prose.prose(d).collect()]
    want = [(i, t if t is None else markdown.mask(t)) for i, t in enumerate(made)] + [(-1, "`a`"), (-2, "`a`"), (-1, "   ")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert prose.prose(d.where("false")).count() == 0 and prose.mask_ranges(d.where("false")).count() == 0


def test_long_markdown_is_linear():
    n, took = 50_000, time.time()
    for text in ("[" * n + "](" * n, "a <!-- " * n, "<?" * n, "[" * n + "]" * n, "[a]: b\n" * n, "[" * n + "](x)" * n, "[a]: b\n\n" * n):
        markdown.found(text)
    assert time.time() - took < 30


def test_deep_and_long_markdown():
    for text in ("- a" + "\n" * 100_000 + "  b `x`\n", ">" * 5000 + " `a`", "- " * 3000 + "`a`", "`" * 20_001, "[" * 20_000 + "](x)" * 100):
        assert len(markdown.mask(text)) == len(text)


@settings(max_examples=300, deadline=None)
@given(st.text("ab`[]()<>!\\#->+~:\"' \t\n\r*_=.1\u00e9\u6f22\U0001f600", max_size=60))
def test_masks_keep_coordinates(text):
    from textlens.operators.consumers import same_coordinates

    assert same_coordinates(text, markdown.mask(text))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con, plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql_parity(spark, oracle, name):
    con, sql = oracle
    want = con.sql(sql[name]).fetchall()
    columns = [d[0] for d in con.sql(sql[name]).description]
    found = plans.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert want and key(found.select(*columns).collect()) == key(want)


def test_every_query_has_sql_or_a_test():
    assert set(plans.queries()) == set(plans.oracle_sql())
