"""Registered queries over the corpus, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sql as sql_functions
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import annotate, consumers, diagnose, external, interchange, lint, prose, render, validate
from ..operators.contract import Contract
from ..sources import cases, documents, files
from ..streaming import session
from . import expected


def _docs(spark: SparkSession, sf_dir: str, fixtures: bool = True) -> DataFrame:
    return documents.corpus(spark, sf_dir, fixtures)


def token_stream(spark, sf_dir):
    return annotate.tokens(_docs(spark, sf_dir, False), ["pos", "lexeme", "kind", "start", "end"])


def sentence_spans(spark, sf_dir):
    return annotate.sentences(_docs(spark, sf_dir)).select("doc_id", "sent_id", "start", "end", "words")


def number_tokens(spark, sf_dir):
    return annotate.tokens(_docs(spark, sf_dir), ["lexeme", "start", "kind"]).where("kind = 'number'").select("doc_id", "lexeme", "start")


def number_prefixes(spark, sf_dir):
    """The number that the text of a token begins with, where it begins with one."""
    words = annotate.tokens(_docs(spark, sf_dir), ["pos", "lexeme"])
    return words.select("doc_id", "pos", T.numeric_prefix(F.col("lexeme")).alias("number")).where("number <> ''")


def closed_class_counts(spark, sf_dir):
    words = annotate.tokens(_docs(spark, sf_dir), ["lexeme", "kind"]).where("kind = 'word'")
    return annotate.lexicon(words).where("function_kind IS NOT NULL").groupBy("function_kind").agg(F.count(F.lit(1)).alias("n"))


def lexicon_classes(spark, sf_dir):
    """Context-free classes of all words and numbers."""
    words = annotate.tokens(_docs(spark, sf_dir), ["lexeme", "kind"]).where("kind IN ('word', 'number')")
    return annotate.lexicon(words).groupBy("pos_class").agg(F.count(F.lit(1)).alias("n"))


def pos_class_counts(spark, sf_dir):
    return annotate.tokens(_docs(spark, sf_dir), ["pos_class"]).groupBy("pos_class").agg(F.count(F.lit(1)).alias("n"))


def proper_nouns(spark, sf_dir):
    return annotate.tokens(_docs(spark, sf_dir), ["lexeme", "start", "pos_class"]).where("pos_class = 'ProperNoun'").select("doc_id", "lexeme", "start")


def title_case_lines(spark, sf_dir):
    return annotate.title_lines(_docs(spark, sf_dir))


def open_class_tokens(spark, sf_dir):
    plain = annotate.tokens(_docs(spark, sf_dir), ["lexeme", "start", "pos_class", "open_kind"], contextual=False)
    return plain.where("pos_class = 'Open'").select("doc_id", "lexeme", "start", "open_kind")


def contextual_senses(spark, sf_dir):
    c = annotate.tokens(_docs(spark, sf_dir), ["pos", "lexeme", "pos_class", "open_kind"])
    return c.where(T.ascii_lower(F.col("lexeme")).isin(V.AMBIGUOUS))


def weak_words(spark, sf_dir):
    return lint.weak_words(_docs(spark, sf_dir))


def run_on_sentences(spark, sf_dir):
    return lint.run_ons(_docs(spark, sf_dir))


def length_outliers(spark, sf_dir):
    return lint.length_outliers(_docs(spark, sf_dir))


def passive_voice(spark, sf_dir):
    return lint.passive_voice(_docs(spark, sf_dir))


def lint_findings(spark, sf_dir):
    return lint.findings(_docs(spark, sf_dir))


def lint_strict(spark, sf_dir):
    """The rules under another configuration: shorter sentences, other words."""
    return lint.findings(_docs(spark, sf_dir), lint.LintConfig(max_words=30, outlier_min=20, outlier_ratio=3, weak_words=["thing", "unquestionably", "good"]))


def lint_report_lines(spark, sf_dir):
    return lint.report_lines(_docs(spark, sf_dir))


def doc_lint_summary(spark, sf_dir):
    return lint_findings(spark, sf_dir).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def paragraph_outline(spark, sf_dir):
    o = render.outline(_docs(spark, sf_dir))
    return o.select("doc_id", "node_id", "kind", "depth", "start", "end", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


def content_hashes(spark, sf_dir):
    return render.content_hashes(_docs(spark, sf_dir))


def visual_roles(spark, sf_dir):
    return render.role_counts(annotate.tokens(_docs(spark, sf_dir), ["role"]))


def roles_by_axes(spark, sf_dir):
    """Roles found from the axes alone, as a reader of documents finds them."""
    axes = annotate.tokens(_docs(spark, sf_dir), ["token_kind", "lexical_class", "open_axis"])
    counts = axes.groupBy("token_kind", "lexical_class", "open_axis").agg(F.count(F.lit(1)).alias("n"))
    return render.roles_of_axes(counts)


def ansi_render(spark, sf_dir):
    return render.ansi(_docs(spark, sf_dir))


def highlight_spans(spark, sf_dir):
    return render.highlight_spans(_docs(spark, sf_dir))


def semantic_token_deltas(spark, sf_dir):
    return render.token_deltas(_docs(spark, sf_dir))


def editor_diagnostics(spark, sf_dir):
    return render.editor_diagnostics(_docs(spark, sf_dir))


def ansi_roundtrip(spark, sf_dir):
    return render.ansi_spans(ansi_render(spark, sf_dir))


def lsp_roundtrip(spark, sf_dir):
    return render.delta_spans(render.editor_tokens(_docs(spark, sf_dir), ["_row", "doc_id", "text"]))


def span_report(spark, sf_dir):
    return render.span_report(_docs(spark, sf_dir))


def ir_documents(spark, sf_dir):
    return interchange.canonical_json(interchange.analyses(_docs(spark, sf_dir)))


def files_round_trip(spark, sf_dir):
    """The canonical JSON of all documents, written to a folder of files and read back by line: what each line says of its source."""
    files.register(spark)
    folder = files.scratch(spark)
    found = interchange.canonical_json(interchange.analyses(_docs(spark, sf_dir, False)))
    found.select("json").write.format("textlens").mode("append").option("path", folder).option("compression", "zstd").save()
    lines = spark.read.format("textlens").option("path", folder).option("lines", "true").load()
    good, bad = interchange.read_json(lines.select(F.lit(0).alias("doc_id"), F.coalesce("text", F.lit("")).alias("json")))
    source = F.col("analysis.source")
    good = good.select(source["unitId"].alias("unit"), source["contentHash"].alias("content_hash"), source["utf8ByteLength"].alias("bytes"), F.size("analysis.tokens").alias("tokens"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(bad.select("error"), allowMissingColumns=True)


def diagnose_report(spark, sf_dir):
    return diagnose.diagnose(_docs(spark, sf_dir))


def _read_back(spark, sf_dir) -> DataFrame:
    """Documents written as JSON, read again beside their sources."""
    docs = _docs(spark, sf_dir)
    found = interchange.analyses(docs)
    json = found.select("doc_id", "bytes", F.to_json("analysis", {"ignoreNullFields": "false"}).alias("json"))
    return json.select("doc_id", F.from_json("json", interchange.ANALYSIS).alias("analysis"), "bytes")


def consumer_report(spark, sf_dir):
    """Span reports that a reader of the JSON makes, and what it says of broken documents."""
    return consumers.consume(_read_back(spark, sf_dir).unionByName(cases.broken_documents(spark)))


def consumer_admission(spark, sf_dir):
    """The first fault that an admission finds in broken documents."""
    return consumers.admission(cases.broken_documents(spark)).select("doc_id", "code", "path")


def editor_consumer_report(spark, sf_dir):
    """Span reports from editor tokens."""
    return consumers.consume_editor(render.editor_tokens(_docs(spark, sf_dir), ["doc_id", "text"]))


def ir_validation_errors(spark, sf_dir):
    """The errors of all documents after every token starts a byte late and two share an id."""
    found = interchange.analyses(_docs(spark, sf_dir))

    def late(t):
        r = t["byteRange"]
        return t.withField("byteRange", r.withField("startUtf8", r["startUtf8"] + 1)).withField("occurrenceId", F.floor(t["occurrenceId"] / 2).cast("int"))

    damaged = found.withColumn("analysis", F.col("analysis").withField("tokens", F.transform("analysis.tokens", late)))
    return validate.error_codes(damaged, ["doc_id"]).select("doc_id", "stage", "code", "path")


def _damaged(spark, sf_dir) -> DataFrame:
    """Interchange documents, damaged in twenty ways by their id; every 21st is as it was made, as are those with too few tokens."""
    found = interchange.analyses(_docs(spark, sf_dir, False)).withColumn("way", F.pmod("doc_id", F.lit(21)))
    a, way, raw = F.col("analysis"), F.col("way"), F.col("bytes")
    tokens, size = F.col("analysis.tokens"), F.octet_length("bytes")
    span = lambda start, end: F.struct(end.cast("int").alias("endUtf8"), start.cast("int").alias("startUtf8"))

    def at(array: str, place: Column, change) -> Column:
        return a.withField(array, F.transform("analysis." + array, lambda x, i: F.when(i == place, change(x)).otherwise(x)))

    def token(place: Column, start, end) -> Column:
        return at("tokens", place, lambda t: t.withField("byteRange", span(start(t["byteRange"]), end(t["byteRange"]))))

    def steps(change) -> Column:
        return a.withField("derivation", F.transform("analysis.derivation", change))

    start, end = (lambda r: r["startUtf8"]), (lambda r: r["endUtf8"])
    first, last, two = F.lit(0), F.size(tokens) - 1, F.size(tokens) >= 2
    swapped = F.transform(tokens, lambda t, i: F.when(i < 2, t.withField("byteRange", F.get(tokens, 1 - i)["byteRange"])).otherwise(t))
    wrong = F.when(F.get(tokens, first)["tokenKind"] == "WORD", F.lit(None).cast("string")).otherwise("CONTENT")
    note = F.struct(span(F.lit(-5), size + 99).alias("byteRange"), F.lit("c").alias("code"), F.lit("m").alias("message"), F.lit("INFO").alias("severity"))
    ways = {
        1: a.withField("contractVersion", F.lit("other")), 2: a.withField("schemaHash", F.lit("x")), 3: a.withField("vocabularyHash", F.lit("z")),
        4: a.withField("source.utf8ByteLength", F.lit(-1)), 5: a.withField("source.utf8ByteLength", size + 1), 6: a.withField("source.contentHash", F.lit("sha256:no")),
        8: token(first, lambda r: F.lit(-2), end), 9: token(last, end, start), 10: token(last, start, lambda r: size + 1), 11: token(last, end, end),
        12: F.when(two, a.withField("tokens", swapped)).otherwise(a), 13: token(F.lit(1), lambda r: F.get(tokens, first)["byteRange"]["startUtf8"], end), 14: at("tokens", first, lambda t: t.withField("lexicalClass", wrong)),
        15: at("structure", first, lambda n: n.withField("depth", n["depth"] + 1)), 16: a.withField("diagnostics", F.array(note)), 17: a.withField("derivation", F.slice("analysis.derivation", 1, 0)),
        18: steps(lambda x: x.withField("ruleId", F.lit(""))), 19: steps(lambda x: x.withField("passId", F.lit("p"))), 20: steps(lambda x: x.withField("sourceRanges", F.transform(x["sourceRanges"], lambda r: span(r["startUtf8"], r["endUtf8"] + 1)))),
    }
    kind = interchange.ANALYSIS
    damaged = F.lit(None).cast(kind)
    for k, change in ways.items():
        damaged = F.when(way == k, change.cast(kind)).otherwise(damaged)
    damaged = F.when(way.isin(*ways), damaged).otherwise(a.cast(kind))
    return found.select("doc_id", damaged.alias("analysis"), F.when(way == 7, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw).alias("bytes"))


def ir_damage(spark, sf_dir):
    """Every error of all documents, damaged in twenty ways by their id, in the report's words."""
    return validate.with_errors(_damaged(spark, sf_dir)).select("doc_id", F.inline("errors")).select("doc_id", "stage", "code", "path", "message")


def ir_damage_reports(spark, sf_dir):
    """The whole report of each damaged document, null for those without an error."""
    return validate.with_errors(_damaged(spark, sf_dir)).select("doc_id", validate.report(F.col("errors")).alias("report"))


def ir_broken_documents(spark, sf_dir):
    """Every rule of interchange documents, broken at least once, with the report's words."""
    return validate.with_errors(cases.broken_documents(spark)).select("doc_id", F.inline("errors")).select("doc_id", "code", "path", "message")


def ir_reports(spark, sf_dir):
    """The whole report of each broken document."""
    return validate.with_errors(cases.broken_documents(spark)).select("doc_id", validate.report(F.col("errors")).alias("report"))


def projection_gate(spark, sf_dir):
    """How many documents pass their own validation, and how many are refused."""
    state = interchange.projected(_docs(spark, sf_dir)).select(F.coalesce("error", F.lit("accepted")).alias("state"))
    return state.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _trees(docs: DataFrame) -> DataFrame:
    """Trees and tokens of the library's own parser, as another program would hand them over."""
    rows = annotate.trees(docs, ["_row", "doc_id", "text"])
    return rows.select("_row", "doc_id", "text", F.struct(F.lit("Document").alias("kind"), "sentences").alias("tree"), "tokens")


def classification_errors(spark, sf_dir):
    """The first error of all documents after every token starts a byte late."""
    late = F.transform("tokens", lambda t: F.struct((t["start"] + 1).alias("start"), t["end"].alias("end")))
    return validate.classification_errors(_trees(_docs(spark, sf_dir)).withColumn("tokens", late)).select("doc_id", "code", "path")


def _damaged_trees(docs: DataFrame) -> DataFrame:
    """Trees and tokens, damaged in ten ways by the document's id; documents with less than two parts or tokens are left out."""
    # sentences as a column of their own: read out of the tree, they would be made anew at each of their uses
    trees = _trees(docs).select("*", F.pmod("doc_id", F.lit(10)).alias("way"), F.col("tree.sentences").alias("_sentences"))
    s, t, way = F.col("_sentences"), F.col("tokens"), F.col("way")
    first = F.get(s, F.lit(0))
    last = F.size(s) - 1
    enough = (F.size(first["parts"]) >= 2) & (F.size(t) >= 2)

    def sentences(change) -> Column:
        return F.transform(s, change)

    def parts(change) -> Column:
        return sentences(lambda x, i: F.when(i == 0, x.withField("parts", F.transform(x["parts"], change))).otherwise(x))

    lead = F.get(first["parts"], F.lit(0))
    damaged = F.when(way == 1, sentences(lambda x, i: F.when(i == 0, x.withField("kind", F.lit("Word"))).otherwise(x)))
    damaged = damaged.when(way == 2, parts(lambda p, j: F.when(j == 0, p.withField("kind", F.lit("Sentence"))).otherwise(p)))
    damaged = damaged.when(way == 3, sentences(lambda x, i: F.when(i == last, x.withField("start", x["end"] + 1)).otherwise(x)))
    damaged = damaged.when(way == 4, sentences(lambda x, i: F.when(i == last, x.withField("end", F.octet_length("text") + 9)).otherwise(x)))
    damaged = damaged.when(way == 5, parts(lambda p, j: F.when(j == 1, p.withField("start", lead["start"])).otherwise(p)))
    damaged = damaged.when(way == 6, sentences(lambda x, i: F.when(i == 0, x.withField("start", lead["end"])).otherwise(x)))
    tree = F.struct(F.when(way == 0, "Sentence").otherwise("Document").alias("kind"), damaged.otherwise(s).alias("sentences"))
    swapped = F.transform(t, lambda x, i: F.when(i < 2, F.get(t, 1 - i)).otherwise(x))
    empty = F.transform(t, lambda x, i: F.when(i == F.size(t) - 1, x.withField("start", x["end"])).otherwise(x))
    tokens = F.when(way == 7, F.slice(t, 1, F.size(t) - 1)).when(way == 8, swapped).when(way == 9, empty).otherwise(t)
    return trees.where(enough).select("_row", "doc_id", "text", tree.alias("tree"), tokens.alias("tokens"))


def classification_damage(spark, sf_dir):
    """The first error of documents that are damaged in ten ways, by their id."""
    return validate.classification_errors(_damaged_trees(_docs(spark, sf_dir))).select("doc_id", "code", "path")


def projected_documents(spark, sf_dir):
    """What becomes of all documents whose parts are checked, where those of two in three are damaged: the source of the accepted, the error of the refused."""
    docs = _docs(spark, sf_dir, False)
    found = interchange.projected(docs, classified=_damaged_trees(docs.where("doc_id % 3 <> 0")))
    source = F.col("analysis.source")
    good = {"content_hash": source["contentHash"], "tokens": F.size("analysis.tokens"), "passes": F.size("analysis.derivation")}
    return found.select("doc_id", *[F.when(F.col("error").isNull(), c).alias(n) for n, c in good.items()], "error")


def admitted_documents(spark, sf_dir):
    """The first fault that an admission finds in each document, damaged in twenty ways by its id; null where it is let in."""
    return consumers.admission(_damaged(spark, sf_dir)).select("doc_id", "code", "path")


def outline_damage(spark, sf_dir):
    """Repeated ids, broken edges and cycles of outlines that are damaged in five ways, by their id."""
    way, pars, last = F.pmod("doc_id", F.lit(5)), F.col("_pars"), F.size("outline") - 1
    o = render.outlines(_docs(spark, sf_dir), ["doc_id"])
    o = o.withColumn("_pars", F.size(F.filter("outline", lambda n: n["kind"] == "PARAGRAPH")))

    def damaged(n: Column) -> Column:
        node, span, own = n["nodeId"], n["byteRange"], n["childNodeIds"]
        kids = F.when((way == 1) & (node == 0), F.array_append(own, F.lit(999_999))).when((way == 2) & (node == pars - 1) & (node > 0), F.array_append(own, pars)).when((way == 4) & (node == pars), F.array(F.lit(0)))
        end = F.when((way == 3) & (node == 0), span["startUtf8"] + 1).otherwise(span["endUtf8"])
        return F.struct(F.struct(end.alias("endUtf8"), span["startUtf8"].alias("startUtf8")).alias("byteRange"), kids.otherwise(own).alias("childNodeIds"), F.when((way == 0) & (node == last), 0).otherwise(node).alias("nodeId"))

    # written down, so that texts are cut once whatever reads the outlines
    nodes = files.written(o.select("doc_id", F.transform("outline", damaged).alias("outline")))
    return validate.outline_errors(nodes, ["doc_id"]).select("doc_id", "code", "path", "message")


def classification_cases(spark, sf_dir):
    """Every rule of classifications, broken once."""
    return validate.classification_errors(cases.broken_trees(spark))


def markdown_masked_lint(spark, sf_dir):
    """Findings of Markdown and plain texts, code and destinations left out."""
    own = documents.markdown_fixtures(spark).withColumn("_row", F.col("doc_id"))
    docs = own.unionByName(_docs(spark, sf_dir, False).withColumn("format", F.lit("plain")))
    return lint.findings(prose.prose(docs))


def markdown_masks(spark, sf_dir):
    """What is prose of own Markdown texts, and of all documents in a fence."""
    own = documents.markdown_fixtures(spark).withColumn("_row", F.col("doc_id"))
    docs = own.unionByName(documents.in_markdown(_docs(spark, sf_dir, False)))
    return prose.prose(docs).select("doc_id", "prose")


def markdown_ranges(spark, sf_dir):
    """What isn't prose of all documents, behind a link, a code span and definitions that touch the fence: byte ranges."""
    docs = documents.in_linked_markdown(_docs(spark, sf_dir, False))
    return prose.mask_ranges(docs).drop("_row")


def markdown_ansi(spark, sf_dir):
    """Documents in a fence, colored: tokens of code stay as they are."""
    return render.ansi(prose.prose(documents.in_markdown(_docs(spark, sf_dir, False))))


def utf8_gate(spark, sf_dir):
    """Bytes that are no UTF-8 are refused, never replaced: own ones, and documents as files."""
    good, bad = documents.gate(cases.byte_rows(spark).unionByName(documents.in_files(_docs(spark, sf_dir, False))))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    return good.select("name", "format", "text", *none("error")).unionByName(bad.select("name", *none("format", "text"), "error"))


def sql_tokens(spark, sf_dir):
    """The lexer as a lateral function in SQL, over all documents."""
    sql_functions.register(spark)
    _docs(spark, sf_dir, False).createOrReplaceTempView("textlens_documents")
    return spark.sql("SELECT d.doc_id, t.pos, t.lexeme, t.kind, t.start, t.`end` FROM textlens_documents d, LATERAL inline(prose_tokens(d.text)) t")


def external_alerts(spark, sf_dir):
    return external.external_findings(cases.alerts(spark)).select("doc_id", "n", "start", "end", "rule", "severity", "message", "error")


def session_replay(spark, sf_dir):
    """Each conversation as a session: its first turn opens, every later one is put on top; and an editor's log."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id IS NOT NULL")
    text = F.coalesce("text", F.lit(""))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), text))
    first = F.col("seq") == 1
    zero = F.when(~first, 0)
    turns = turns.select(F.col("conv_id").cast("string").alias("uri"), nth.cast("long").alias("seq"), text.alias("t"))
    events = turns.select(
        "uri", "seq", F.when(first, "open").otherwise("change").alias("kind"), F.lit("plain").alias("format"),
        *[zero.alias(c) for c in ("start_line", "start_char", "end_line", "end_char")], F.when(first, F.col("t")).otherwise(F.concat("t", F.lit("\n"))).alias("text"),
    )
    return session.replay(events.unionByName(cases.session_events(spark)))


def session_results(spark, sf_dir):
    """What an editor shows after a log of messages: tokens and diagnostics of every open document."""
    events = session.events_of_messages(cases.messages(spark))
    shown = session.results(session.replay(events.unionByName(cases.session_events(spark))))
    note = lambda d: F.format_string("%d:%d-%d:%d %s %s: %s", d["start_line"], d["start_char"], d["end_line"], d["end_char"], d["severity"], d["code"], d["message"])
    return shown.select("uri", "result_id", "status", F.array_join(F.col("data").cast("array<string>"), ",").alias("data"), F.array_join(F.transform("diagnostics", note), "; ").alias("diagnostics"))


QUERIES = [
    token_stream, sentence_spans, number_tokens, number_prefixes, closed_class_counts, lexicon_classes, pos_class_counts, proper_nouns, title_case_lines, open_class_tokens, contextual_senses,
    weak_words, run_on_sentences, length_outliers, passive_voice, lint_findings, lint_strict, lint_report_lines, doc_lint_summary, paragraph_outline, content_hashes, visual_roles, roles_by_axes,
    ansi_render, highlight_spans, semantic_token_deltas, editor_diagnostics, ansi_roundtrip, lsp_roundtrip, span_report, ir_documents, files_round_trip, diagnose_report, consumer_report, consumer_admission,
    editor_consumer_report, ir_validation_errors, ir_damage, ir_damage_reports, ir_broken_documents, ir_reports, projection_gate, classification_errors, classification_damage, projected_documents, admitted_documents, outline_damage, classification_cases, markdown_masked_lint, markdown_masks, markdown_ranges, markdown_ansi,
    utf8_gate, sql_tokens, external_alerts, session_replay, session_results,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def _values(rows: list[tuple]) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_SP = r" \t\r\n\f\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
_RE = rf"(?s)\p{{L}}[\p{{L}}\p{{N}}]*(?:[''’\-][\p{{L}}\p{{N}}]+)*|\p{{N}}+(?:[.,]\p{{N}}+)*|[.!?]+|[{_SP}]+|."
_UP, _LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql(fixtures: bool = True) -> str:
    """Common tables: docs, seg, tok (tokens), sent, cls (before refinement)."""
    more = f" UNION ALL SELECT * FROM ({_values(documents.FIXTURES)}) f(doc_id, name, text)" if fixtures else ""
    w = "PARTITION BY doc_id ORDER BY p"
    before = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, 'doc' || doc_id AS name, text FROM documents{more}),
seg0 AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, regexp_extract_all(text, '{_RE}') AS l FROM docs)),
seg AS (SELECT *, CASE WHEN regexp_matches(s, '^\\p{{L}}') THEN 'word' WHEN regexp_matches(s, '^\\p{{N}}') THEN 'number' WHEN regexp_matches(s, '^[.!?]') THEN 'end'
  WHEN regexp_matches(s, '^[{_SP}]') THEN 'space' WHEN s IN {_IN(V.QUOTES)} THEN 'quote' ELSE 'punct' END AS kind,
  coalesce(sum(octet_length(encode(s))) OVER {before}, 0)::INT AS "start", lag(s) OVER ({w}) AS gap FROM seg0),
tok0 AS (SELECT doc_id, p, s, kind, "start", ("start" + octet_length(encode(s)))::INT AS "end",
  CASE WHEN regexp_matches(coalesce(gap, ''), '^[{_SP}]') THEN gap ELSE '' END AS gap FROM seg WHERE kind <> 'space'),
tok1 AS (SELECT *, coalesce(s IN {_IN(V.CLOSERS)} AND lag("end") OVER ({w}) = "start", false) AS closer FROM tok0),
tok2 AS (SELECT *, coalesce(last_value(CASE WHEN NOT closer THEN kind END IGNORE NULLS) OVER {before} = 'end' AND NOT closer, false) AS starts FROM tok1),
tok AS (SELECT *, (row_number() OVER ({w}) - 1)::INT AS pos, (sum(starts::INT) OVER ({w}))::INT AS sent_id FROM tok2),
sent AS (SELECT doc_id, sent_id, min("start") AS "start", max("end") AS "end", count(*) FILTER (kind IN ('word', 'number')) AS words, arg_min(gap, pos) AS gap FROM tok GROUP BY 1, 2),
closed(w, fk) AS ({_values(V.CLOSED_ROWS)}), seeds(w, ok) AS ({_values(V.OPEN_ROWS)}),
lex AS (SELECT t.*, fk AS function_kind, CASE WHEN fk IS NULL THEN ok END AS open_kind, translate(s, '{_UP}', '{_LO}') AS lower,
  CASE WHEN fk IS NOT NULL THEN 'Function' WHEN kind = 'number' THEN 'Number' WHEN ok IS NOT NULL THEN 'Open' WHEN kind = 'word' THEN 'Content' WHEN kind = 'quote' THEN 'Quote' ELSE 'Punctuation' END AS base
  FROM tok t LEFT JOIN closed c ON kind = 'word' AND translate(s, '{_UP}’', '{_LO}''') = c.w LEFT JOIN seeds o ON kind = 'word' AND translate(s, '{_UP}', '{_LO}') = o.w),
line0 AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '[\\r\\n]') AS l FROM docs)),
line1 AS (SELECT doc_id, line, list_filter(regexp_split_to_array(t, '[^\\p{{L}}''’]+'), lambda x: x <> '') AS ws FROM line0),
line2 AS (SELECT doc_id, line FROM line1 WHERE len(list_filter(ws, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= 2
  AND len(list_filter(ws, lambda x: NOT regexp_matches(x, '^\\p{{Lu}}') AND translate(x, '{_UP}’', '{_LO}''') NOT IN {_IN([w for w, _ in V.CLOSED_ROWS])})) = 0),
ev AS (SELECT l.*, kind IN ('word', 'number') AS is_word, 1 + sum(len(regexp_extract_all(gap, '[\\r\\n]'))) OVER ({w}) AS line FROM lex l),
ev2 AS (SELECT ev.*, line2.line IS NOT NULL AS title, is_word AND (coalesce(count(*) FILTER (is_word) OVER (PARTITION BY ev.doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
  OR regexp_matches(gap, '[\\r\\n]')) AS crossed FROM ev LEFT JOIN line2 ON ev.doc_id = line2.doc_id AND ev.line = line2.line),
ev3 AS (SELECT *, last_value(CASE WHEN crossed THEN title END IGNORE NULLS) OVER ({w}) AS in_title,
  sum((crossed OR starts)::INT) OVER ({w}) AS grp, is_word AND regexp_matches(s, '^\\p{{L}}') AS alpha FROM ev2),
ev4 AS (SELECT *, coalesce(max(alpha::INT) OVER (PARTITION BY doc_id, grp ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM ev3),
cls AS (SELECT doc_id, p, pos, sent_id, s, kind, "start", "end", gap, lower, function_kind,
  CASE WHEN base IN ('Content', 'Open') AND seen AND NOT coalesce(in_title, false) AND regexp_matches(s, '^\\p{{Lu}}') THEN 'ProperNoun' ELSE base END AS pc0, open_kind AS ok0 FROM ev4),
hint AS (SELECT *, CASE WHEN pc0 = 'Open' THEN ok0 END AS ok1, pc0 = 'Content' AND lower IN {_IN(V.AMBIGUOUS)} AS amb FROM cls),
hint1 AS (SELECT *, CASE WHEN amb THEN NULL WHEN pc0 = 'Function' AND lower = 'to' THEN 'S' WHEN function_kind IN ('Article', 'Determiner', 'Preposition') THEN 'N' WHEN function_kind IN ('Pronoun', 'Auxiliary') THEN 'S'
  WHEN ok1 = 'Adjective' THEN 'N' WHEN ok1 = 'Noun' OR pc0 = 'ProperNoun' THEN 'S' WHEN ok1 = 'Verb' THEN 'V' WHEN pc0 = 'Content' AND regexp_matches(lower, '[^s]s$') THEN 'S' ELSE '' END AS h0,
  coalesce(lead(pc0) OVER ({w}) IN ('Content', 'ProperNoun') OR lead(ok1) OVER ({w}) = 'Noun', false) AS nn FROM hint),
{_senses(w)}
c AS (SELECT *, CASE WHEN sense <> '' THEN 'Open' ELSE pc0 END AS pos_class, CASE WHEN sense <> '' THEN sense ELSE ok1 END AS open_kind FROM hint2 LEFT JOIN senses USING (doc_id, sense_k))
"""


def _senses(w: str) -> str:
    """Senses of ambiguous words, left to right through runs of any length."""

    def sense(b: str) -> str:
        return f"""CASE WHEN x.lower IN ('book', 'record') THEN CASE {b} WHEN 'S' THEN 'Verb' WHEN 'N' THEN 'Noun' ELSE '' END
  WHEN x.lower = 'lead' THEN CASE WHEN {b} = 'S' THEN 'Verb' WHEN {b} = 'N' AND x.nn THEN 'Adjective' WHEN {b} = 'N' THEN 'Noun' ELSE '' END
  ELSE CASE WHEN {b} = 'V' THEN 'Adverb' WHEN x.nn THEN 'Adjective' ELSE '' END END"""

    after = "CASE r.sense WHEN 'Verb' THEN 'V' WHEN 'Noun' THEN 'S' WHEN 'Adjective' THEN 'N' ELSE '' END"
    return f"""hint2 AS MATERIALIZED (SELECT *, coalesce(lag(h0) OVER ({w}), '') AS sense_before, coalesce(lag(amb) OVER ({w}), false) AS sense_follows, row_number() OVER ({w}) AS sense_k FROM hint1),
senses(doc_id, sense_k, sense) AS (SELECT x.doc_id, x.sense_k, {sense("x.sense_before")} FROM hint2 x WHERE x.amb AND NOT x.sense_follows
  UNION ALL SELECT x.doc_id, x.sense_k, {sense(f"({after})")} FROM senses r JOIN hint2 x ON x.doc_id = r.doc_id AND x.sense_k = r.sense_k + 1 WHERE x.amb),"""


def oracle_sql() -> dict[str, str]:
    sql, roles = _sql(), "r(role, ansi, token_type, highlight)"
    role_rows = "VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in V.ROLES)
    role = "CASE pos_class WHEN 'Function' THEN 'STRUCTURAL_KEYWORD' WHEN 'ProperNoun' THEN 'TYPE_LIKE' WHEN 'Number' THEN 'LITERAL' WHEN 'Punctuation' THEN 'MUTED' WHEN 'Quote' THEN 'QUOTED' WHEN 'Open' THEN upper(open_kind) ELSE 'UNSTYLED' END"
    weak = f"""SELECT doc_id, "start", "end", 'weak-word' AS rule, 'info' AS severity, 'weak word ''' || {{word}} || '''' AS message FROM c WHERE pos_class IN ('Content', 'Open') AND lower IN {_IN(V.WEAK_WORDS)}""".replace("{word}", "lower")
    runs = """SELECT doc_id, "start", "end", 'run-on' AS rule, 'warning' AS severity, 'sentence runs to ' || words || ' words' AS message FROM sent WHERE words > 40"""
    outl = """SELECT doc_id, "start", "end", 'length-outlier' AS rule, 'info' AS severity, 'sentence is ' || words || ' words; the document averages ' || (total // n) AS message
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(words) OVER (PARTITION BY doc_id) AS total FROM sent WHERE words > 0) WHERE n >= 2 AND words BETWEEN 25 AND 40 AND words * n >= 2 * total"""
    outline = """, o AS (SELECT *, CASE WHEN len(regexp_extract_all(gap, '\\r\\n|\\r|\\n')) >= 2 AND row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) > 1 THEN 1 ELSE 0 END AS brk FROM sent),
o1 AS (SELECT *, (sum(brk) OVER (PARTITION BY doc_id ORDER BY sent_id))::INT AS par FROM o),
o2 AS (SELECT *, ((max(par) OVER (PARTITION BY doc_id)) + 1 + sent_id)::INT AS node FROM o1)
SELECT doc_id, node AS node_id, 'SENTENCE' AS kind, 1 AS depth, "start", "end", '' AS children FROM o2
UNION ALL SELECT doc_id, par, 'PARAGRAPH', 0, min("start"), max("end"), string_agg(node::VARCHAR, ',' ORDER BY node) FROM o2 GROUP BY doc_id, par"""
    step = """{"compilerBuildHash":"textlens@0.1","passId":"%s","ruleId":"%s","sourceRanges":[{"endUtf8":<n>,"startUtf8":0}]}"""
    steps = step % ("segment", "prose-segmenter") + "," + step % ("classify", "contextual-open-class-annotator")
    schema_hash, vocabulary_hash = expected.SCHEMA, expected.VOCABULARY
    span = """'{"endUtf8":' || "end" || ',"startUtf8":' || "start" || '}'"""
    axis = lambda value: f"""coalesce('"' || {value} || '"', 'null')"""
    lexical = "CASE pos_class WHEN 'Function' THEN 'FUNCTION' WHEN 'ProperNoun' THEN 'PROPER_NOUN_CANDIDATE' WHEN 'Content' THEN 'CONTENT' WHEN 'Open' THEN 'CONTENT' END"
    token_kind = "CASE WHEN pos_class IN ('Number', 'Punctuation', 'Quote') THEN upper(pos_class) ELSE 'WORD' END"
    token = f"""'{{"byteRange":' || {span} || ',"functionKind":' || {axis("CASE WHEN pos_class = 'Function' THEN upper(function_kind) END")} || ',"lexicalClass":' || {axis(lexical)}
  || ',"occurrenceId":' || pos || ',"openClassKind":' || {axis("CASE WHEN pos_class = 'Open' THEN upper(open_kind) END")} || ',"tokenKind":"' || {token_kind} || '"}}'"""
    node = f"""'{{"byteRange":' || {span} || ',"childNodeIds":[' || children || '],"depth":' || depth || ',"kind":"' || kind || '","nodeId":' || node_id || '}}'"""
    nodes = outline.replace("SELECT doc_id, node AS node_id", "nodes AS (SELECT doc_id, node AS node_id", 1).replace("FROM o1)\nnodes", "FROM o1),\nnodes", 1) + ")"
    documents_sql = nodes + f""", tj AS (SELECT doc_id, string_agg({token}, ',' ORDER BY pos) AS tj FROM c GROUP BY 1), nj AS (SELECT doc_id, string_agg({node}, ',' ORDER BY node_id) AS nj FROM nodes GROUP BY 1),
h AS (SELECT doc_id, name, coalesce(text, '') AS x, octet_length(encode(coalesce(text, ''))) AS n FROM docs)
SELECT h.doc_id, '{{"contractVersion":"textlens.syntax/v1","derivation":[' || replace('{steps}', '<n>', n::VARCHAR) || '],"diagnostics":[],"schemaHash":"{schema_hash}","source":{{"contentHash":"sha256:' || sha256(x) || '","unitId":"' || name || '","utf8ByteLength":' || n
|| '}},"structure":[' || coalesce(nj, '') || '],"tokens":[' || coalesce(tj, '') || '],"vocabularyHash":"{vocabulary_hash}"}}' AS json FROM h LEFT JOIN tj USING (doc_id) LEFT JOIN nj USING (doc_id)"""
    wide = "octet_length(encode(s[1])) > 1"
    late = f"""SELECT doc_id, 3 AS stage, 'EmptyTokenRange' AS code, 'tokens[' || pos || '].byteRange' AS path FROM tok WHERE "end" = "start" + 1
UNION ALL SELECT doc_id, 3, 'RangeNotOnCharBoundary', 'tokens[' || pos || '].byteRange.startUtf8' FROM tok WHERE {wide} UNION ALL SELECT doc_id, 3, 'DuplicateTokenId', 'tokens[' || pos || ']' FROM tok WHERE pos % 2 = 1"""
    n_steps = len(Contract().passes)
    head = [
        (1, 1, "UnsupportedContractVersion", "'contractVersion'", "'unsupported contract version `other`'"), (2, 1, "SchemaHashMismatch", "'schemaHash'", f"'expected `{Contract().schema_hash}`, found `x`'"),
        (3, 1, "VocabularyHashMismatch", "'vocabularyHash'", f"'expected `{Contract().vocabulary_hash}`, found `z`'"), (4, 2, "NegativeByteLength", "'source.utf8ByteLength'", "'-1 is negative'"),
        (4, 2, "ByteLengthMismatch", "'source.utf8ByteLength'", "'declared -1, actual ' || n"), (5, 2, "ByteLengthMismatch", "'source.utf8ByteLength'", "'declared ' || (n + 1) || ', actual ' || n"),
        (6, 2, "ContentHashMismatch", "'source.contentHash'", "'expected `sha256:' || sha256(t) || '`, found `sha256:no`'"), (7, 2, "ByteLengthMismatch", "'source.utf8ByteLength'", "'declared ' || n || ', actual ' || (n + 1)"),
        (7, 2, "ContentHashMismatch", "'source.contentHash'", "'expected `sha256:' || sha256('\\xFF'::BLOB || encode(t)) || '`, found `sha256:' || sha256(t) || '`'"), (7, 2, "SourceNotUtf8", "'source'", "'not valid UTF-8'"),
        (8, 3, "NegativeOffset", "'tokens[0].byteRange.startUtf8'", "'-2 is negative'"), (9, 3, "RangeOutOfOrder", "'tokens[' || (m - 1) || '].byteRange'", "'start ' || el || ' exceeds end ' || sl"),
        (10, 3, "RangeOutOfBounds", "'tokens[' || (m - 1) || '].byteRange.endUtf8'", "(n + 1) || ' exceeds source length ' || n"), (11, 3, "EmptyTokenRange", "'tokens[' || (m - 1) || '].byteRange'", "'token ' || (m - 1) || ' has an empty range'"),
        (12, 3, "UnsortedTokenRange", "'tokens[1].byteRange.startUtf8'", "'start ' || s0 || ' precedes tokens[0] start ' || s1"), (13, 3, "OverlappingTokenRange", "'tokens[1].byteRange.startUtf8'", "'start ' || s0 || ' overlaps tokens[0] ending at ' || e0"),
        (14, 4, "IllegalTokenAxes", "'tokens[0]'", "CASE WHEN k0 = 'word' THEN 'a WORD token must carry a lexicalClass' ELSE 'a non-word token must not carry a lexicalClass' END"), (15, 5, "InvalidOutlineDepth", "'structure[0].depth'", "'depth 1, expected 0 for this outline kind'"),
        (16, 8, "NegativeOffset", "'diagnostics[0].byteRange.startUtf8'", "'-5 is negative'"), (16, 8, "RangeOutOfBounds", "'diagnostics[0].byteRange.endUtf8'", "(n + 99) || ' exceeds source length ' || n"), (17, 9, "EmptyDerivation", "'derivation'", "'must not be empty'"),
        *[(18, 9, "MissingDerivationIdentity", f"'derivation[{i}]'", "'empty passId or ruleId'") for i in range(n_steps)], *[(19, 9, "DuplicateDerivationPassId", f"'derivation[{i}]'", "'duplicate passId `p`'") for i in range(1, n_steps)],
        *[(20, 9, "RangeOutOfBounds", f"'derivation[{i}].sourceRanges[0].endUtf8'", "(n + 1) || ' exceeds source length ' || n") for i in range(n_steps)],
    ]
    enough = {w: 2 if w in (12, 13) else 1 for w in range(8, 16)}
    errors = " UNION ALL ".join(f"SELECT doc_id, {stage}::INT AS stage, '{code}' AS code, {path} AS path, 'at ' || {path} || ': ' || {text} AS message, {o} AS o FROM dm WHERE way = {w}" + (f" AND m >= {enough[w]}" if w in enough else "") for o, (w, stage, code, path, text) in enumerate(head))
    damages = f""", dm AS (SELECT d.doc_id, d.doc_id % 21 AS way, coalesce(d.text, '') AS t, octet_length(encode(coalesce(d.text, ''))) AS n, k.* EXCLUDE (doc_id) FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS m, arg_min("start", pos) AS s0, arg_min("end", pos) AS e0, arg_min(kind, pos) AS k0, max("start") FILTER (pos = 1) AS s1, arg_max("start", pos) AS sl, arg_max("end", pos) AS el FROM tok GROUP BY doc_id) k ON d.doc_id = k.doc_id),
er AS ({errors}) """
    broken = f"""SELECT doc_id, CASE WHEN bool_or({wide}) THEN 'SpanNotOnCharBoundary' ELSE 'TreeTokenSpanMismatch' END AS code,
  'tokens[' || coalesce(min(pos) FILTER ({wide}), 0) || '].span' || CASE WHEN bool_or({wide}) THEN '.start' ELSE '' END AS path FROM tok GROUP BY doc_id"""
    damage = """, b AS (SELECT doc_id, sent_id, min(pos) AS p0, max(pos) AS p1 FROM tok GROUP BY 1, 2),
d AS (SELECT doc_id, (doc_id % 10 + 10) % 10 AS way, max(sent_id) AS last, max(p1) AS t, max(p1) FILTER (sent_id = 0) AS k FROM b GROUP BY 1 HAVING max(p1) FILTER (sent_id = 0) >= 1)
SELECT doc_id, CASE way WHEN 0 THEN 'UnexpectedNodeKind' WHEN 1 THEN 'UnexpectedNodeKind' WHEN 2 THEN 'UnexpectedNodeKind' WHEN 3 THEN 'ReversedSpan' WHEN 4 THEN 'SpanOutOfBounds' WHEN 5 THEN 'OverlappingSpan'
  WHEN 6 THEN 'ChildSpanOutsideParent' WHEN 7 THEN 'TreeTokenCountMismatch' WHEN 8 THEN 'UnsortedSpan' ELSE 'TreeTokenSpanMismatch' END AS code,
CASE way WHEN 0 THEN 'tree.root' WHEN 1 THEN 'tree.root.sentences[0]' WHEN 2 THEN 'tree.root.sentences[0].parts[0]' WHEN 3 THEN 'tree.root.sentences[' || last || '].span' WHEN 4 THEN 'tree.root.sentences[' || last || '].span.end'
  WHEN 5 THEN 'tree.root.sentences[0].parts[1].span.start' WHEN 6 THEN 'tree.root.sentences[0].parts[0].span' WHEN 7 THEN 'tokens' WHEN 8 THEN 'tokens[1].span.start' ELSE 'tokens[' || t || '].span' END AS path FROM d"""
    outline_damage = outline.split("SELECT doc_id, node AS node_id")[0].rstrip() + """, n AS (SELECT doc_id, (doc_id % 5 + 5) % 5 AS way, node, par, "start", "end", (max(par) OVER (PARTITION BY doc_id)) + 1 AS pars, max(node) OVER (PARTITION BY doc_id) AS last,
  row_number() OVER (PARTITION BY doc_id, par ORDER BY node) - 1 AS j FROM o2), g AS (SELECT doc_id, way, pars, last, par, min("start") AS "start", max("end") AS "end", count(*) AS size FROM n GROUP BY ALL),
e AS (SELECT doc_id, 'DuplicateNodeId' AS code, 'structure[' || last || ']' AS path, 'duplicate nodeId 0' AS what FROM g WHERE way = 0 AND par = 0
UNION ALL SELECT doc_id, 'DanglingChildRef', 'structure[' || par || '].childNodeIds[' || j || ']', 'references missing child ' || node FROM n WHERE way = 0 AND node = last
UNION ALL SELECT doc_id, 'DanglingChildRef', 'structure[0].childNodeIds[' || size || ']', 'references missing child 999999' FROM g WHERE way = 1 AND par = 0
UNION ALL SELECT doc_id, unnest(['MultipleStructureParents', 'ChildRangeOutsideParent']), 'structure[' || par || '].childNodeIds[' || size || ']', unnest(['child ' || pars || ' already belongs to parent 0, not ' || par, 'child ' || pars || ' falls outside parent ' || par]) FROM g WHERE way = 2 AND par = pars - 1 AND par > 0
UNION ALL SELECT n.doc_id, 'ChildRangeOutsideParent', 'structure[0].childNodeIds[' || j || ']', 'child ' || node || ' falls outside parent 0' FROM n JOIN g ON n.doc_id = g.doc_id AND g.par = 0 WHERE n.way = 3 AND n.par = 0 AND n."end" > g."start" + 1
UNION ALL SELECT doc_id, 'StructureCycle', 'structure[' || pars || '].childNodeIds[0]', 'edge ' || pars || ' -> 0 closes a structure cycle' FROM g WHERE way = 4 AND par = 0
UNION ALL SELECT doc_id, 'ChildRangeOutsideParent', 'structure[' || pars || '].childNodeIds[0]', 'child 0 falls outside parent ' || pars FROM g WHERE way = 4 AND par = 0 AND size > 1)
SELECT doc_id, code, path, 'at ' || path || ': ' || what AS message FROM e"""
    replay = f"""SELECT conv_id::VARCHAR AS uri, count(*) AS generation, 'plain' AS format, string_agg(coalesce(text, ''), chr(10) ORDER BY turn DESC NULLS LAST, coalesce(text, '') DESC) AS text FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id UNION ALL {expected.SESSIONS}"""
    styled = f", st AS (SELECT c.*, r.* FROM (SELECT *, {role} AS own FROM c) c JOIN ({role_rows}) {roles} ON own = r.role)"
    colored = """ SELECT d.doc_id, coalesce(a.x, d.text) AS colored FROM docs d LEFT JOIN (SELECT seg.doc_id, string_agg(CASE WHEN ansi IS NULL THEN seg.s ELSE chr(27) || '[' || ansi || 'm' || seg.s || chr(27) || '[0m' END, '' ORDER BY seg.p) AS x
FROM seg LEFT JOIN st ON seg.doc_id = st.doc_id AND seg.p = st.p GROUP BY seg.doc_id) a USING (doc_id)"""
    w = "(PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    units = "length(s) + len(regexp_extract_all(s, '[\\x{10000}-\\x{10FFFF}]'))"
    placed = styled + f""", u0 AS (SELECT doc_id, p, s, kind, {units} AS u, coalesce(sum(length(s)) OVER {w}, 0) AS c0, coalesce(sum({units}) OVER {w}, 0) AS c16,
  CASE WHEN kind = 'space' THEN len(regexp_extract_all(s, '\\r\\n|\\r|\\n')) ELSE 0 END AS nb, length(regexp_replace(s, '(?s)^.*[\\r\\n]', '')) AS tail FROM seg),
u1 AS (SELECT doc_id, p, u, c0, c16, coalesce(sum(nb) OVER {w}, 0)::INT AS "row", coalesce(last_value(CASE WHEN nb > 0 THEN c0 + length(s) - tail END IGNORE NULLS) OVER {w}, 0) AS ls,
  coalesce(last_value(CASE WHEN nb > 0 THEN c16 + u - tail END IGNORE NULLS) OVER {w}, 0) AS ls16 FROM u0),
pl AS (SELECT st.doc_id, pos, s, "start", "end", highlight, token_type, "row", (c0 - ls)::INT AS col, (c16 - ls16)::INT AS col16, u::INT AS "length" FROM st JOIN u1 ON st.doc_id = u1.doc_id AND st.p = u1.p)"""
    kinds = "list_position([" + ", ".join(f"'{t}'" for t in V.LEGEND) + "], token_type) - 1"
    editor = "FROM pl WHERE token_type IS NOT NULL WINDOW d AS (PARTITION BY doc_id ORDER BY pos)"
    deltas = f""" SELECT doc_id, pos, "row" - coalesce(lag("row") OVER d, 0) AS delta_line, col16 - CASE WHEN "row" = coalesce(lag("row") OVER d, 0) THEN coalesce(lag(col16) OVER d, 0) ELSE 0 END AS delta_start, "length", {kinds} AS "type", 0 AS modifiers {editor}"""
    cell = "CASE WHEN s = '`' THEN '`` ` ``' ELSE '`' || replace(s, '|', '\\|') || '`' END"
    report = f""" SELECT d.doc_id, '# Highlight spans' || chr(10) || chr(10) || '| UTF-8 bytes | Text | Role |' || chr(10) || '| --- | --- | --- |' || chr(10) || coalesce(x, '') AS report FROM docs d LEFT JOIN
(SELECT doc_id, string_agg('| `' || "start" || '..' || "end" || '` | ' || {cell} || ' | `' || own || '` |' || chr(10), '' ORDER BY p) AS x FROM st WHERE token_type IS NOT NULL GROUP BY 1) USING (doc_id)"""
    unseen = "regexp_matches(s, '^[\\x{0B}\\x{85}\\x{2028}\\x{2029}]$')"
    agent = lambda t: f"({t}.pos_class IN ('Content', 'ProperNoun') OR ({t}.pos_class = 'Open' AND {t}.open_kind = 'Noun') OR coalesce({t}.function_kind = 'Pronoun', false)) AND {t}.lower NOT IN {_IN(V.NO_AGENT)}"
    ahead = lambda t, k: f"LEFT JOIN wn {t} ON {t}.doc_id = pa.doc_id AND {t}.sent_id = pa.sent_id AND {t}.k = pa.k + pa.skip + {k}"
    passive = f""", v AS (SELECT *, sum((NOT {unseen})::INT) OVER (PARTITION BY doc_id ORDER BY p) AS vis FROM c),
wn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY p) AS k FROM v WHERE kind IN ('word', 'number')),
pa AS (SELECT x.doc_id, x.sent_id, x.k, x.p AS p0, x."start", CASE WHEN (y.pos_class = 'Open' AND y.open_kind = 'Adverb') OR (y.pos_class = 'Content' AND octet_length(encode(y.s)) > 2 AND y.lower LIKE '%ly') THEN 1 ELSE 0 END AS skip
  FROM wn x JOIN wn y ON y.doc_id = x.doc_id AND y.sent_id = x.sent_id AND y.k = x.k + 1 WHERE x.function_kind = 'Auxiliary' AND x.lower IN {_IN(V.BE_AUXILIARIES)}),
ph AS (SELECT pa.doc_id, pa.p0, pa."start", t.p AS p1, t."end", t.lower AS part, coalesce(b.function_kind = 'Preposition' AND b.lower = 'by' AND b.vis = t.vis + 1 AND o.vis = b.vis + 1
    AND CASE WHEN o.function_kind IN ('Article', 'Determiner') THEN q.vis = o.vis + 1 AND {agent("q")} ELSE {agent("o")} END, false) AS phrase
  FROM pa {ahead("t", 1)} {ahead("b", 2)} {ahead("o", 3)} {ahead("q", 4)} WHERE t.pos_class = 'Content' OR (t.pos_class = 'Open' AND t.open_kind = 'Verb')),
pv AS (SELECT ph.doc_id, ph."start", ph."end", 'passive-voice' AS rule, 'info' AS severity, 'passive-voice candidate ''' || string_agg(seg.s, '' ORDER BY seg.p) || '''' AS message
  FROM ph JOIN seg ON seg.doc_id = ph.doc_id AND seg.p BETWEEN ph.p0 AND ph.p1 WHERE part IN {_IN(V.EVENTIVE)} OR (part IN {_IN(V.NEEDS_BY_PHRASE)} AND phrase) GROUP BY ALL)"""
    other_words = "SELECT doc_id, \"start\", \"end\", 'weak-word' AS rule, 'info' AS severity, 'weak word ''' || lower || '''' AS message FROM c WHERE pos_class IN ('Content', 'Open') AND lower IN ('thing', 'unquestionably', 'good')"
    strict = f"{other_words} UNION ALL {runs.replace('> 40', '> 30')} UNION ALL {outl.replace('BETWEEN 25 AND 40', 'BETWEEN 20 AND 30').replace('>= 2 * total', '>= 3 * total')} UNION ALL SELECT * FROM pv"
    lint_all = passive + f", lf AS (SELECT * FROM pv UNION ALL {weak} UNION ALL {runs} UNION ALL {outl})"
    begin = ' JOIN pl a ON a.doc_id = lf.doc_id AND a."start" = lf."start"'
    at = begin + ' JOIN pl b ON b.doc_id = lf.doc_id AND b."end" = lf."end"'
    marks = ", ".join(f"({m[0]}, {'NULL' if m[4] is None else expected.text(m[4])})" for m in documents.MARKDOWN)
    masked = _sql(False).replace("WITH RECURSIVE docs AS (", f"WITH RECURSIVE md(doc_id, text) AS (VALUES {marks}), docs AS (SELECT doc_id, '' AS name, text FROM md UNION ALL ", 1)
    null = lambda v: f"""coalesce('"' || {v} || '"', 'null')"""
    diag_token = f"""'{{"ansi":' || {null("ansi")} || ',"byteRange":{{"endUtf8":' || "end" || ',"startUtf8":' || "start" || '}},"editorTokenType":' || {null("token_type")} || ',"editorTokenTypeIndex":' || coalesce((CASE WHEN token_type IS NOT NULL THEN {kinds} END)::VARCHAR, 'null')
  || ',"functionKind":' || {null("CASE WHEN pos_class = 'Function' THEN upper(function_kind) END")} || ',"highlightClass":' || {null("highlight")} || ',"lexicalClass":' || {null(lexical)} || ',"occurrenceId":' || pos
  || ',"openClassKind":' || {null("CASE WHEN pos_class = 'Open' THEN upper(open_kind) END")} || ',"text":' || to_json(s)::VARCHAR || ',"tokenKind":"' || {token_kind} || '","visualRole":"' || own || '"}}'"""
    diag_note = """'{"byteRange":{"endUtf8":' || lf."end" || ',"startUtf8":' || lf."start" || '},"code":"' || rule || '","column":' || (a.col + 1) || ',"line":' || (a."row" + 1) || ',"message":' || to_json(message)::VARCHAR
  || ',"severity":"' || upper(severity) || '","text":' || to_json(decode(encode(d.text)[lf."start" + 1:lf."end"]))::VARCHAR || '}'"""
    legend = "[" + ",".join(f'"{t}"' for t in V.LEGEND) + "]"
    diag = placed + lint_all + f""", dt AS (SELECT doc_id, count(*) AS n, count(ansi) AS na, count(highlight) AS nh, count(token_type) AS ne, string_agg({diag_token}, ',' ORDER BY pos) AS j FROM st GROUP BY 1),
dn AS (SELECT lf.doc_id, count(*) AS n, string_agg({diag_note}, ',' ORDER BY lf."start", rule) AS j FROM lf{begin} JOIN docs d ON d.doc_id = lf.doc_id GROUP BY 1)
SELECT d.doc_id, '{{"contracts":{{"syntax":{{"contractVersion":"textlens.syntax/v1","schemaHash":"{schema_hash}"}},"vocabulary":{{"hash":"{vocabulary_hash}","legend":{legend}}}}},"diagnostics":[' || coalesce(dn.j, '') || '],"reportVersion":"textlens.diagnose/v1","source":{{"contentHash":"sha256:'
 || sha256(d.text) || '","unitId":"' || d.name || '","utf8ByteLength":' || octet_length(encode(d.text)) || '}},"summary":{{"ansiColoredTokens":' || coalesce(na, 0) || ',"diagnostics":' || coalesce(dn.n, 0) || ',"editorTokens":' || coalesce(ne, 0) || ',"highlightedTokens":' || coalesce(nh, 0)
 || ',"tokens":' || coalesce(dt.n, 0) || '}},"tokens":[' || coalesce(dt.j, '') || '],"tool":{{"name":"textlens","version":"0.1"}}}}' AS report FROM docs d LEFT JOIN dt USING (doc_id) LEFT JOIN dn USING (doc_id)"""
    reports = sql + styled + report
    good_report = f"""{expected.text(render.REPORT_HEAD)} || '| `7..9` | `it` | `STRUCTURAL_KEYWORD` |' || chr(10) || '| `12..14` | `Go` | `VERB` |' || chr(10) || '| `15..16` | `2` | `LITERAL` |' || chr(10)"""
    faults = ", ".join(f"(-{1000 + i}, '{c}')" for i, c in enumerate(expected.REPORTED, 1)) + ", (-1999, 'E_JSON')"
    broken_rows = expected.values("code", "path", "message", rows=expected.BROKEN)
    axes_rows = "VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in V.AXES)
    fence = "('```text' || chr(10) || replace(coalesce(text, ''), chr(96), chr(39)) || chr(10) || '```')"
    blank = fence
    for wide, by in (("\\x{10000}-\\x{10FFFF}", "chr(160) || chr(160)"), ("\\x{800}-\\x{FFFF}", "chr(12288)"), ("\\x{80}-\\x{7FF}", "chr(160)")):
        blank = f"regexp_replace({blank}, '[{wide}]', {by}, 'g')"
    blank = f"regexp_replace({blank}, '[^\\r\\n\\x{{80}}-\\x{{10FFFF}}]', ' ', 'g')"
    muted = "chr(27) || '[90m.' || chr(27) || '[0m'"
    more = {
        "passive_voice": sql + passive + " SELECT * FROM pv",
        "lint_findings": sql + lint_all + " SELECT * FROM lf",
        "lint_strict": sql + passive + " " + strict,
        "doc_lint_summary": sql + lint_all + " SELECT doc_id, rule, count(*) AS n FROM lf GROUP BY 1, 2",
        "lint_report_lines": sql + placed + lint_all + """ SELECT lf.doc_id, lf."start", rule, d.name || ':' || (a."row" + 1) || ':' || (a.col + 1) || ': ' || severity || ' [' || rule || ']: ' || message AS line FROM lf JOIN docs d ON d.doc_id = lf.doc_id""" + begin,
        "editor_diagnostics": sql + placed + lint_all + """ SELECT lf.doc_id, a."row" AS start_line, a.col16 AS start_char, b."row" AS end_line, (b.col16 + b."length")::INT AS end_char, CASE severity WHEN 'warning' THEN 'WARNING' ELSE 'INFORMATION' END AS severity, rule AS code, 'textlens' AS source, message FROM lf""" + at,
        "diagnose_report": sql + diag,
        "consumer_report": f"SELECT doc_id, NULL AS code, report FROM ({reports}) UNION ALL SELECT -1000, NULL, {good_report} UNION ALL SELECT doc_id, code, NULL FROM (VALUES {faults}) f(doc_id, code)",
        "editor_consumer_report": f"SELECT doc_id, NULL::VARCHAR AS code, report FROM ({reports})",
        "consumer_admission": expected.values("code", "path", rows=[(-1000, None, None), *[(-1000 - i, *r) for i, r in enumerate(expected.ADMITTED, 1)], (-1999, "E_ARTIFACT_SHAPE", None)]),
        "ir_broken_documents": broken_rows,
        "ir_reports": f"WITH b AS (SELECT *, row_number() OVER () AS n FROM ({broken_rows})) SELECT doc_id, 'document failed validation (' || count(*) || ' issue(s)):' || string_agg(chr(10) || '  - ' || message, '' ORDER BY n) AS report FROM b GROUP BY 1 UNION ALL SELECT unnest([-1000, -1999]), NULL",
        "projection_gate": sql + " SELECT 'accepted' AS state, count(*) AS n FROM docs",
        "classification_cases": expected.values("code", "path", "message", rows=expected.TREE_ERRORS),
        "markdown_masks": f"SELECT * FROM (VALUES {marks}) m(doc_id, prose) UNION ALL SELECT doc_id, 'Intro.' || chr(10) || chr(10) || '.' || substr({blank}, 2) || chr(10) || chr(10) || 'End.' FROM documents",
        "markdown_ranges": """WITH m AS (SELECT doc_id, octet_length(encode(name)) AS n, octet_length(encode(coalesce(text, ''))) AS b FROM (SELECT doc_id, 'doc' || doc_id AS name, text FROM documents))
            SELECT doc_id, (6 + n)::INT AS start, (9 + n)::INT AS "end", false AS parts FROM m UNION ALL SELECT doc_id, (14 + n)::INT, (16 + 2 * n)::INT, false FROM m
            UNION ALL SELECT doc_id, (19 + 2 * n)::INT, (37 + 2 * n + 8 + b + 5)::INT, true FROM m""",
        "markdown_ansi": f"SELECT doc_id, 'Intro' || {muted} || chr(10) || chr(10) || {fence} || chr(10) || chr(10) || 'End' || {muted} AS colored FROM documents",
        "sql_tokens": _sql(False) + 'SELECT doc_id, pos, s AS lexeme, kind, "start", "end" FROM tok',
        "markdown_masked_lint": masked + lint_all + " SELECT * FROM lf",
        "utf8_gate": expected.BYTES + """ UNION ALL SELECT 'doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'plain' END END,
  CASE WHEN doc_id % 3 <> 0 THEN text END, CASE WHEN doc_id % 3 = 0 THEN 'invalid-utf8' END FROM documents""",
        "external_alerts": expected.values("n", "start", "end", "rule", "severity", "message", "error", rows=expected.ALERTS),
        "session_results": expected.SHOWN,
        "number_prefixes": sql + "SELECT doc_id, pos, s AS number FROM tok WHERE kind = 'number'",
        "lexicon_classes": sql + "SELECT base AS pos_class, count(*) AS n FROM lex WHERE kind IN ('word', 'number') GROUP BY 1",
        "title_case_lines": sql + 'SELECT doc_id, (line - 1)::INT AS "row" FROM line2',
        "roles_by_axes": sql + f""", t AS (SELECT {token_kind} AS token_kind, {lexical} AS lexical_class, CASE WHEN pos_class = 'Open' THEN upper(open_kind) END AS open_axis FROM c), g AS (SELECT token_kind, lexical_class, open_axis, count(*) AS n FROM t GROUP BY 1, 2, 3)
SELECT g.*, role FROM g LEFT JOIN ({axes_rows}) r(a, b, d, role) ON a = token_kind AND b IS NOT DISTINCT FROM lexical_class AND d IS NOT DISTINCT FROM open_axis""",
    }
    return more | {
        "span_report": sql + styled + report,
        "ansi_render": sql + styled + colored,
        "highlight_spans": sql + placed + ' SELECT doc_id, pos, highlight AS class, "row", col, (col + length(s))::INT AS end_col FROM pl WHERE highlight IS NOT NULL',
        "semantic_token_deltas": sql + placed + deltas,
        "lsp_roundtrip": sql + placed + f' SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n, "start", "end", "row", col16, "length", {kinds} AS "type" FROM pl WHERE token_type IS NOT NULL',
        "ir_documents": sql + documents_sql,
        "ir_validation_errors": sql + late,
        "ir_damage": _sql(False) + damages + "SELECT doc_id, stage, code, path, message FROM er",
        "ir_damage_reports": _sql(False) + damages + """SELECT doc_id, r.report FROM documents LEFT JOIN (SELECT doc_id, 'document failed validation (' || count(*) || ' issue(s)):' || string_agg(chr(10) || '  - ' || message, '' ORDER BY o) AS report FROM er GROUP BY doc_id) r USING (doc_id)""",
        "classification_errors": sql + broken,
        "classification_damage": sql + damage,
        "admitted_documents": _sql(False) + damages + """SELECT doc_id, (['E_CONTRACT_VERSION', 'E_SCHEMA_HASH', 'E_VOCABULARY_HASH', 'E_ARTIFACT_SHAPE', 'E_BYTE_LENGTH', 'E_CONTENT_HASH', 'E_BYTE_LENGTH', 'E_ARTIFACT_SHAPE', 'E_BYTE_RANGE_ORDER', 'E_BYTE_RANGE_BOUNDS', 'E_TOKEN_EMPTY',
            'E_TOKEN_UNSORTED', 'E_TOKEN_OVERLAP', 'E_TOKEN_AXES', 'E_OUTLINE_DEPTH', 'E_ARTIFACT_SHAPE', 'E_EMPTY_DERIVATION', 'E_MISSING_DERIVATION_IDENTITY', 'E_DUPLICATE_DERIVATION_PASS_ID', 'E_BYTE_RANGE_BOUNDS'])[CASE WHEN path IS NOT NULL THEN doc_id % 21 END] AS code, path
            FROM documents LEFT JOIN (SELECT doc_id, arg_min(path, o) AS path FROM er GROUP BY doc_id) USING (doc_id)""",
        "projected_documents": _sql(False) + damage.replace("SELECT doc_id, CASE way", ", w AS (SELECT doc_id, CASE way").replace("END AS path FROM d", "END AS path FROM d WHERE doc_id % 3 <> 0") + f"""), n AS (SELECT doc_id, count(*) AS tokens FROM tok GROUP BY doc_id)
            SELECT doc_id, CASE WHEN w.code IS NULL THEN 'sha256:' || sha256(coalesce(text, '')) END AS content_hash, CASE WHEN w.code IS NULL THEN coalesce(tokens, 0)::INT END AS tokens, CASE WHEN w.code IS NULL THEN {n_steps} END AS passes, CASE WHEN w.code IS NOT NULL THEN 'InvalidClassification' END AS error
            FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN n USING (doc_id)""",
        "outline_damage": sql + outline_damage,
        "session_replay": replay,
        "ansi_roundtrip": sql + f", t AS (SELECT *, {role} AS role FROM c) SELECT doc_id, \"start\", \"end\", ansi, s AS lexeme FROM t JOIN ({role_rows}) {roles} ON t.role = r.role WHERE ansi IS NOT NULL",
        "files_round_trip": _sql(False) + ", n AS (SELECT doc_id, count(*) AS tokens FROM tok GROUP BY doc_id) SELECT 'doc' || doc_id AS unit, 'sha256:' || sha256(coalesce(text, '')) AS content_hash, octet_length(encode(coalesce(text, '')))::INT AS bytes, coalesce(tokens, 0)::INT AS tokens, NULL::VARCHAR AS error FROM documents LEFT JOIN n USING (doc_id)",
        "token_stream": _sql(False) + 'SELECT doc_id, pos, s AS lexeme, kind, "start", "end" FROM tok',
        "sentence_spans": sql + 'SELECT doc_id, sent_id, "start", "end", words FROM sent',
        "number_tokens": sql + "SELECT doc_id, s AS lexeme, \"start\" FROM tok WHERE kind = 'number'",
        "closed_class_counts": sql + "SELECT function_kind, count(*) AS n FROM lex WHERE function_kind IS NOT NULL GROUP BY 1",
        "pos_class_counts": sql + "SELECT pos_class, count(*) AS n FROM c GROUP BY 1",
        "proper_nouns": sql + "SELECT doc_id, s AS lexeme, \"start\" FROM cls WHERE pc0 = 'ProperNoun'",
        "open_class_tokens": sql + "SELECT doc_id, s AS lexeme, \"start\", ok1 AS open_kind FROM hint WHERE pc0 = 'Open'",
        "contextual_senses": sql + f"SELECT doc_id, pos, s AS lexeme, pos_class, open_kind FROM c WHERE lower IN {_IN(V.AMBIGUOUS)}",
        "weak_words": sql + weak,
        "run_on_sentences": sql + runs,
        "length_outliers": sql + outl,
        "paragraph_outline": sql + outline,
        "content_hashes": sql + "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, octet_length(encode(text)) AS bytes, true AS fits FROM docs",
        "visual_roles": sql + f", t AS (SELECT {role} AS role, count(*) AS n FROM c GROUP BY 1) SELECT t.role, n, ansi, token_type, highlight FROM t LEFT JOIN ({role_rows}) {roles} ON t.role = r.role",
    }
