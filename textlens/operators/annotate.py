"""Tokens, sentences and word classes as rows.

The lexer is one Arrow pass that yields a row for each token with its offsets. What a
token knows by its order alone (its sentence, its place on its line, whether a capital is
a name's) is a running sum in that pass, where a text's tokens stand in order already.
Classes are a broadcast join and column expressions; nothing of that is exchanged. Senses
are windows and folds over the ambiguous words and what stands beside them, the only
tokens that are exchanged for classes. Whoever needs some tokens alone says which
(``only``), and the others never leave the pass.

Repeated and null ids are harmless; a text that isn't UTF-8 counts as null
(``sources.documents`` reports those). Memory of the lexer is bounded by ``SIZE`` bytes
of text or the longest single text; windows of a long text spill.

Row numbers are given where documents have none. Some results read documents twice and
meet again by that number, so an input that gives its rows in another order each time it
is read has to be numbered (``numbered``) and written down first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import lexer as L
from ..functions import text as T
from ..functions import vocabulary as V

#: Bytes of text that are cut into tokens at once.
SIZE = 1_000_000
ROW = "_row"


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``size`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi
        lo = hi


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, unless they have one."""
    return docs if ROW in docs.columns else docs.withColumn(ROW, F.monotonically_increasing_id())


def analysed(docs: DataFrame) -> Column:
    """The text that is analysed: the column ``prose`` where there is one (see ``prose``), else ``text``; null unless UTF-8."""
    name = "prose" if "prose" in docs.columns else "text"
    return F.when(F.is_valid_utf8(F.col(name)), F.col(name))


#: What the lexer gives of each token: type, and how it is read off.
LEXED = {
    "pos": ("int", lambda t: t.pos), "lexeme": ("string", L.Texts.lexemes), "kind": ("string", L.Texts.kinds), "start": ("int", lambda t: t.start), "end": ("int", lambda t: t.end),
    "char": ("int", lambda t: t.char), "unit": ("int", lambda t: t.unit), "gap": ("string", L.Texts.gaps), "glued": ("boolean", lambda t: t.glued), "broken": ("boolean", L.Texts.broken),
    "breaks": ("int", L.Texts.breaks), "sent_id": ("int", L.Texts.sent_id), "starts": ("boolean", lambda t: t.starts), "ends": ("boolean", L.Texts.ends), "words": ("int", L.Texts.words), "nth": ("int", L.Texts.nth),
    "row": ("int", L.Texts.row), "col": ("int", L.Texts.col), "end_col": ("int", L.Texts.end_col), "col16": ("int", L.Texts.col16), "len16": ("int", L.Texts.len16), "guarded": ("boolean", lambda t: t.guarded),
    "first_start": ("int", lambda t: t.start[t.head]), "first_row": ("int", lambda t: t.row()[t.head]), "first_col": ("int", lambda t: t.col()[t.head]), "first_col16": ("int", lambda t: t.col16()[t.head]),
}
#: Which tokens are given.
Only = Callable[[L.Texts], np.ndarray]


def lexed(docs: DataFrame, keep: list[str], columns: list[str], only: Only | None = None) -> DataFrame:
    """Row number, ``keep`` and ``columns`` of LEXED, a row for each token (of ``only``).

    start and end count UTF-8 bytes, char characters and unit UTF-16 units before the
    token; gap is the white space before it, glued that there is none but another token,
    broken that it holds a line break after another token; breaks counts its line breaks.
    sent_id is the number of a token's sentence, starts and ends whether the token is its
    first (but for the text's first) or last, words how many words it has so far, first_
    where it began; nth counts the text's words before the token. row, col, end_col, col16
    and len16 are its place on its line (characters and UTF-16 units), guarded whether a
    capital is a name's. Documents without a token (null, empty, blank) have no row.
    """
    kept = [ROW, *keep]
    source = numbered(docs).select(*kept, analysed(docs).alias("_text"))
    kinds = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            for lo, hi in slices(texts, SIZE):
                t = L.Texts(texts.slice(lo, hi - lo))
                given = None if only is None else only(t)
                if given is not None and not given.any():
                    continue
                own = [LEXED[c][1](t) for c in columns]
                found = [*[batch.column(i).slice(lo, hi - lo).take(pa.array(t.doc)) for i in range(len(kept))], *[x if isinstance(x, pa.Array) else pa.array(x) for x in own]]
                found = pa.RecordBatch.from_arrays(found, [*kept, *columns])
                yield found if given is None else found.filter(pa.array(given))

    return source.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], *[f"`{c}` {LEXED[c][0]}" for c in columns]]))


def ordered() -> WindowSpec:
    """Token rows of a document in order."""
    return Window.partitionBy(ROW).orderBy("start")


def so_far() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _is_word() -> Column:
    return F.coalesce(F.col("kind").isin("word", "number"), F.lit(False))


def sentences(docs: DataFrame, keep: list[str] | None = None, breaks: bool = False) -> DataFrame:
    """Row number, ``keep`` (doc_id unless given), sent_id, start, end, words (and breaks: line breaks before it) of each sentence."""
    keep = ["doc_id"] if keep is None else keep
    t = lexed(docs, keep, ["sent_id", "start", "end", "kind", *(["breaks", "starts", "pos"] if breaks else [])])
    # the breaks before its first token, as a sum: groups of plain numbers are hashed before they are exchanged
    gap = [F.sum(F.when(F.col("starts") | (F.col("pos") == 0), F.col("breaks"))).cast("int").alias("breaks")] if breaks else []
    found = t.groupBy(ROW, "sent_id").agg(*[F.first(c).alias(c) for c in keep], F.min("start").alias("start"), F.max("end").alias("end"), F.count_if(_is_word()).alias("words"), *gap)
    return found.select(ROW, *keep, "sent_id", "start", "end", "words", *(["breaks"] if breaks else []))


def title_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, row of the lines that are titles: two capitalised words at least, and every other one closed-class."""
    source = docs.select(key, analysed(docs).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1), SIZE):
                doc, row = L.Texts(batch.column(1).slice(lo, hi - lo)).title_rows()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(row)], [key, "row"])

    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)[key]}, row int")


def _looked_up(rows: DataFrame, word: Column) -> DataFrame:
    """function_kind and open_kind of a word, by a broadcast join with the fixed tables (256 rows).

    A curly apostrophe counts as a straight one in closed-class words alone; no seed has either.
    """
    quote = lambda v: "'" + v.replace("'", "\\'") + "'" if v else "CAST(NULL AS STRING)"
    table = ", ".join(f"({quote(w)}, {quote(f)}, {quote(o)})" for w, f, o in [*[(w, k, None) for w, k in V.CLOSED_ROWS], *[(w, None, k) for w, k in V.OPEN_ROWS]])
    known = rows.sparkSession.sql(f"SELECT * FROM VALUES {table} AS t(_known, function_kind, open_kind)")
    return rows.join(F.broadcast(known), T.closed_key(word) == F.col("_known"), "left").drop("_known")


def lexicon(words: DataFrame, lexeme: str = "lexeme") -> DataFrame:
    """Context-free classes of any column of words: function_kind, open_kind and pos_class.

    Precedence is closed class, whole number, seed, content.
    """
    word = F.col(lexeme)
    kind = F.when(F.col("function_kind").isNotNull(), "Function").when(word.rlike(T.WHOLE_NUMBER), "Number").when(F.col("open_kind").isNotNull(), "Open").otherwise("Content")
    return _looked_up(words, word).withColumn("pos_class", kind)


def classified(docs: DataFrame, keep: list[str], columns: list[str], only: Only | None = None) -> DataFrame:
    """Row number, ``keep``, ``columns`` of LEXED, start, lexeme, kind, function_kind, open_kind and pos_class of tokens (of ``only``), before neighbours are looked at.

    A content or seed word is a proper-noun candidate where a capital is a name's (guarded).
    """
    own = list(dict.fromkeys([*columns, "start", "lexeme", "kind"]))
    kind = F.col("kind")
    tokens = _looked_up(lexed(docs, keep, [*own, *(["guarded"] if "guarded" not in own else [])], only), F.when(kind == "word", F.col("lexeme")))
    base = F.when(kind == "number", "Number").when(kind == "quote", "Quote").when(kind != "word", "Punctuation").when(F.col("function_kind").isNotNull(), "Function")
    base = base.when(F.col("guarded"), "ProperNoun").when(F.col("open_kind").isNotNull(), "Open").otherwise("Content")
    return tokens.select(ROW, *keep, *own, "function_kind", F.when(~F.col("guarded"), F.col("open_kind")).alias("open_kind"), base.alias("pos_class"))


def _hint(x: Callable[[str], Column] = F.col) -> Column:
    """What a token is evidence for: N (nominal), S (subject), V (verb) or nothing; ``x`` gives its columns."""
    kind, open_kind, lexeme = x("pos_class"), x("open_kind"), x("lexeme")
    function = F.when(T.ascii_lower(lexeme) == "to", "S").when(x("function_kind").isin("Article", "Determiner", "Preposition"), "N").when(x("function_kind").isin("Pronoun", "Auxiliary"), "S").otherwise("")
    opened = F.when(open_kind == "Noun", "S").when(open_kind == "Verb", "V").when(open_kind == "Adjective", "N").otherwise("")
    plural = F.when(lexeme.rlike("[^sS][sS]$"), "S").otherwise("")
    return F.when(kind == "Function", function).when(kind == "Open", opened).when(kind == "Content", plural).when(kind == "ProperNoun", "S").otherwise("")


def _sense(word: Column, hint: Column, nounish_after: Column) -> Column:
    """V, N, J or R (adverb) for an ambiguous word, - where it stays content."""
    named = F.when(hint == "S", "V").when(hint == "N", "N").otherwise("-")
    lead = F.when(hint == "S", "V").when((hint == "N") & nounish_after, "J").when(hint == "N", "N").otherwise("-")
    fast = F.when(hint == "V", "R").when(nounish_after, "J").otherwise("-")
    return F.when(word.isin("book", "record"), named).when(word == "lead", lead).otherwise(fast)


def _folded(words: Column, hint: Column, of: Callable[[Column], tuple[Column, Column]]) -> Column:
    """The senses of an island's words, a letter each, from left to right; ``hint`` is of the token before, ``of`` gives a word and whether a noun may follow."""

    def step(state: Column, x: Column) -> Column:
        word, noun_after = of(x)
        sense = _sense(word, state["hint"], noun_after)
        after = F.when(sense == "V", "V").when(sense == "N", "S").when(sense == "J", "N").otherwise("")
        return F.struct(after.alias("hint"), F.concat(state["senses"], sense).alias("senses"))

    return F.aggregate(words, F.struct(hint.alias("hint"), F.lit("").alias("senses")), step)["senses"]


def _open_kind(sense: Column) -> Column:
    return F.when(sense == "V", "Verb").when(sense == "N", "Noun").when(sense == "J", "Adjective").when(sense == "R", "Adverb")


def beside_ambiguous(t: L.Texts) -> np.ndarray:
    """Ambiguous words and the tokens beside them."""
    return t.beside(t.among(V.AMBIGUOUS))


def refined(docs: DataFrame, keep: list[str], columns: list[str], wanted: list[str], only: Only | None = None) -> DataFrame:
    """Row number and ``wanted`` columns of ``classified`` tokens, with the senses of ambiguous content words.

    A word is decided by the token before, as that was decided itself, and by the class
    of the token after. Consecutive ambiguous words are an island; an island is one row
    whose words are folded from left to right, and it carries its words' own columns, so
    that they are put back by a union: nothing is joined. The fold's state is a hint and
    a string with a letter a word. Ambiguous words and what stands beside them are the
    only tokens that are exchanged. ``only`` chooses among the others; ambiguous words
    are always given.
    """
    docs = numbered(docs)
    word = T.ascii_lower(F.col("lexeme"))
    ambiguous = (F.col("pos_class") == "Content") & word.isin(V.AMBIGUOUS)
    own = list(dict.fromkeys([*wanted, "pos_class", "open_kind"]))
    plain = classified(docs, keep, columns, only).where(~ambiguous).select(ROW, *own)
    tokens = classified(docs, keep, columns, beside_ambiguous)
    tokens = tokens.withColumns({"_hint": _hint(), "_ambiguous": ambiguous})
    nounish = F.col("pos_class").isin("Content", "ProperNoun") | F.coalesce(F.col("open_kind") == "Noun", F.lit(False))
    tokens = tokens.withColumn("_nounish", nounish).select(
        "*", F.coalesce(F.lead("_nounish").over(ordered()), F.lit(False)).alias("_noun_after"), F.coalesce(F.lag("_hint").over(ordered()), F.lit("")).alias("_hint_before"),
        F.sum((~F.col("_ambiguous")).cast("int")).over(so_far()).alias("_island"),
    )
    packed = F.struct(F.col("start").alias("_at"), word.alias("_word"), "_noun_after", "_hint_before", *own)
    islands = tokens.where("_ambiguous").groupBy(ROW, "_island").agg(F.sort_array(F.collect_list(packed)).alias("_words"))

    senses = _folded(F.col("_words"), F.col("_words")[0]["_hint_before"], lambda x: (x["_word"], x["_noun_after"]))
    folded = islands.withColumn("_senses", F.encode(senses, "UTF-8"))
    out = folded.select(ROW, F.posexplode("_words").alias("_k", "_x"), "_senses").select(ROW, *[F.col("_x")[c].alias(c) for c in own], F.decode(F.substring("_senses", F.col("_k") + 1, F.lit(1)), "UTF-8").alias("_sense"))
    found = _open_kind(F.col("_sense"))
    out = out.withColumns({"open_kind": found, "pos_class": F.when(found.isNotNull(), "Open").otherwise(F.col("pos_class"))}).drop("_sense")
    return plain.unionByName(out)


#: Interchange and presentation axes by class; roles of open classes follow their kind.
def _token_kind() -> Column:
    c = F.col("pos_class")
    return F.when(c == "Number", "NUMBER").when(c == "Punctuation", "PUNCTUATION").when(c == "Quote", "QUOTE").otherwise("WORD")


def _lexical_class() -> Column:
    c = F.col("pos_class")
    return F.when(c == "Function", "FUNCTION").when(c == "ProperNoun", "PROPER_NOUN_CANDIDATE").when(c.isin("Content", "Open"), "CONTENT")


def role_of_class() -> Column:
    c = F.col("pos_class")
    role = F.when(c == "Function", "STRUCTURAL_KEYWORD").when(c == "ProperNoun", "TYPE_LIKE").when(c == "Number", "LITERAL").when(c == "Punctuation", "MUTED").when(c == "Quote", "QUOTED")
    return role.when(c == "Open", F.upper("open_kind")).otherwise("UNSTYLED")


#: Token columns that follow from the class.
DERIVED = {
    "token_kind": _token_kind, "lexical_class": _lexical_class, "role": role_of_class, "function_axis": lambda: F.when(F.col("pos_class") == "Function", F.upper("function_kind")),
    "open_axis": lambda: F.when(F.col("pos_class") == "Open", F.upper("open_kind")),
}
CLASSES = ["pos_class", "function_kind", "open_kind", *DERIVED]
COLUMNS = ["pos", "lexeme", "kind", "start", "end", "row", "col", "end_col", "col16", "len16", "breaks", "sent_id", "starts", *CLASSES]


def tokens(docs: DataFrame, columns: list[str] | None = None, contextual: bool = True, key: str = "doc_id") -> DataFrame:
    """A row for each token: the key and ``columns`` (all of COLUMNS unless given).

    breaks counts the line breaks in the gap before a token; row, col and col16 are
    0-based (characters and UTF-16 units). Documents without a token (null, empty,
    blank) have no row. Without ``contextual``, ambiguous words stay undecided. What
    isn't asked for isn't computed, and nothing is exchanged but for senses.
    """
    wanted = COLUMNS if columns is None else columns
    return with_rows(docs, [key], wanted, contextual).select(key, *wanted)


def with_rows(docs: DataFrame, keep: list[str], wanted: list[str], contextual: bool = True, only: Only | None = None) -> DataFrame:
    """``tokens`` (of ``only`` and, where classes are wanted, ambiguous words) with the row number and ``keep``."""
    plain = [c for c in wanted if c in LEXED]
    if any(c in CLASSES for c in wanted):
        found = refined(docs, keep, plain, [*keep, *[c for c in wanted if c not in DERIVED], "function_kind"], only) if contextual else classified(docs, keep, plain, only)
        found = found.withColumns({c: f() for c, f in DERIVED.items() if c in wanted})
    else:
        found = lexed(docs, keep, plain, only)
    return found.select(ROW, *keep, *[c for c in wanted if c not in keep])


TOKEN = ["pos", "lexeme", "start", "end", "kind", "role", "token_kind", "lexical_class", "function_axis", "open_axis", "row", "col", "end_col", "col16", "len16", "breaks", "sent_id"]


def grouped(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Row number and all rows of a document as one sorted array of structs, by the first of ``columns``."""
    return rows.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def nested(docs: DataFrame, keep: list[str], contextual: bool = True, columns: list[str] = TOKEN) -> DataFrame:
    """``keep`` with all tokens in one array (empty for texts without any), a row for each document."""
    docs = numbered(docs)
    found = grouped(with_rows(docs, [], columns, contextual), columns, "tokens")
    out = docs.join(found, ROW, "left")
    return out.select(ROW, *keep, F.coalesce("tokens", F.array().cast(found.schema["tokens"].dataType)).alias("tokens"))


#: A token of a whole document, as the interchange format has it.
AXES = "struct<byteRange:struct<endUtf8:int,startUtf8:int>,functionKind:string,lexicalClass:string,occurrenceId:int,openClassKind:string,tokenKind:string>"
_SENTENCE = "struct<start:int,end:int,breaks:int>"
_ISLAND = "array<struct<word:string,noun_after:boolean,pos_class:string,open_kind:string,function_kind:string,lexeme:string>>"


def _in_lists(docs: DataFrame, keep: list[str], lists: dict[str, tuple[str, Callable[[L.Texts], pa.Array]]]) -> DataFrame:
    """``keep`` and ``lists`` (type of their items, and how they are read off), a row for each document."""
    source = docs.select(*keep, analysed(docs).alias("_text"))
    kinds = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            for lo, hi in slices(texts, SIZE):
                t = L.Texts(texts.slice(lo, hi - lo))
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *[read(t) for _, read in lists.values()]], [*keep, *lists])

    return source.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"`{c}` array<{kind}>" for c, (kind, _) in lists.items()]]))


def sentence_lists(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and sentences (start, end, breaks) as an array, a row for each document, without an exchange."""
    return _in_lists(docs, keep, {"sentences": (_SENTENCE, L.Texts.sentence_lists)})


_RANGED = "struct<pos:int,start:int,end:int,kind:string>"


def with_sentence_ranges(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, tokens (pos, start, end, kind) and sentences (start, end, own: its tokens) as arrays, without an exchange."""
    return _in_lists(docs, keep, {"tokens": (_RANGED, L.Texts.kind_lists), "sentences": (f"struct<start:int,end:int,own:array<{_RANGED}>>", L.Texts.range_lists)})


def trees(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, tokens (start, end) and sentences (kind, start, end, parts: kind, start, end) as another parser would give them, without an exchange."""
    part = "struct<kind:string,start:int,end:int>"
    return _in_lists(docs, keep, {"tokens": ("struct<start:int,end:int>", L.Texts.span_lists), "sentences": (f"struct<kind:string,start:int,end:int,parts:array<{part}>>", L.Texts.tree_lists)})


def whole(docs: DataFrame, keep: list[str], contextual: bool = True, once: bool = False) -> DataFrame:
    """``keep``, tokens (of type AXES) and sentences (start, end, breaks) as arrays, a row for each document, without an exchange.

    A batch of texts is cut at once, so its tokens already stand by document and in order:
    they leave the lexer as one list a document, and no row of a token is made. Texts
    that hold an ambiguous word are a second pass, which gives the words' islands as well;
    these are folded in the document's own row. With ``once`` that is the pass of all
    texts: for docs that are a join, which two passes would make twice.
    """
    lists = {"tokens": (AXES, L.Texts.token_lists), "sentences": (_SENTENCE, L.Texts.sentence_lists)}
    if not contextual:
        return _in_lists(docs, keep, lists)
    asked = F.coalesce(analysed(docs).rlike(rf"(?i)(?<![a-z])(?:{'|'.join(V.AMBIGUOUS)})(?![a-z])"), F.lit(False))
    islands = {"_nth": ("int", L.Texts.undecided_lists), "_islands": (_ISLAND, L.Texts.island_lists)}
    found = _in_lists(docs if once else docs.where(asked), keep, lists | islands)
    senses = F.transform("_islands", lambda w: _folded(w, _hint(lambda c: F.get(w, F.lit(0))[c]), lambda x: (x["word"], x["noun_after"])))
    found = found.withColumn("_senses", F.encode(F.array_join(senses, ""), "UTF-8"))

    def decided(t: Column, i: Column) -> Column:
        nth = F.get("_nth", i)
        return F.when(nth > 0, t.withField("openClassKind", F.upper(_open_kind(F.decode(F.substring("_senses", nth, F.lit(1)), "UTF-8"))))).otherwise(t)

    tokens = F.when(F.octet_length("_senses") > 0, F.transform("tokens", decided)).otherwise(F.col("tokens"))
    found = found.select(*keep, tokens.alias("tokens"), "sentences")
    return found if once else _in_lists(docs.where(~asked), keep, lists).unionByName(found)


def word_count() -> dict[str, int]:
    """Sizes of the two lexicons."""
    return {"closed": len(V.CLOSED_ROWS), "open": len(V.OPEN_ROWS)}
