"""Tokens of many texts at once, as arrays.

Texts are one array of code points; every rule of the lexer is a running sum, a running
maximum or a table lookup over it, so a batch costs a fixed number of passes whatever the
texts hold. What a token knows by its order alone (its sentence's number and beginning,
its line, words so far) is such a sum too. Classes, senses, rules and everything after
them are plans over the token rows (``operators.annotate``).
"""

from __future__ import annotations

from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import vocabulary as V

LETTER, NUMERAL, JOINER, SEPARATOR, END, SPACE, QUOTE, CLOSER, ALPHABETIC, UPPERCASE = (1 << i for i in range(10))
KINDS = ["word", "number", "end", "space", "quote", "punct"]
WORD, NUMBER, STOP, BLANK, QUOTED, PUNCT = range(6)
#: Classes before neighbours are looked at, with their lexical class and token kind in the interchange format.
CLASSES = [
    ("Number", None, "NUMBER"), ("Quote", None, "QUOTE"), ("Punctuation", None, "PUNCTUATION"), ("Function", "FUNCTION", "WORD"),
    ("ProperNoun", "PROPER_NOUN_CANDIDATE", "WORD"), ("Open", "CONTENT", "WORD"), ("Content", "CONTENT", "WORD"),
]
NAME, OPEN, CONTENT = 4, 5, 6


@cache
def _flags() -> np.ndarray:
    """Bits of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = np.r_[0:0xD800, 0xE000:0x110000]
    table = np.zeros(0x110000, np.uint16)
    properties = {
        LETTER: r"\p{L}", NUMERAL: r"[\p{N}\U00011DE0-\U00011DE9\U00016FF4-\U00016FF6]", JOINER: r"['’-]", SEPARATOR: "[.,]", END: "[.!?]",
        SPACE: r"[ \t\r\n\f\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]", QUOTE: "[" + "".join(V.QUOTES) + "]",
        CLOSER: "[" + regex.escape("".join(V.CLOSERS)) + "]", ALPHABETIC: r"\p{Alphabetic}", UPPERCASE: r"\p{Uppercase}",
    }
    for bit, pattern in properties.items():
        for m in regex.finditer(pattern + "+", every):
            table[at[m.start() : m.end()]] |= bit
    return table


def _before(x: np.ndarray, first) -> np.ndarray:
    """x moved one place on."""
    out = np.empty_like(x)
    out[:1] = first
    out[1:] = x[:-1]
    return out


def _after(x: np.ndarray) -> np.ndarray:
    """x moved one place back, False at the end."""
    out = np.zeros_like(x)
    out[:-1] = x[1:]
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    """Exclusive running sum, one longer than x."""
    out = np.zeros(len(x) + 1, np.int32)
    np.cumsum(x, out=out[1:])
    return out


def _among(found: pa.Array, words: list[str], straight: bool) -> np.ndarray:
    found = pc.ascii_lower(found)
    if straight:
        found = pc.replace_substring(found, "\u2019", "'")
    return pc.is_in(found, pa.array(words, pa.string())).to_numpy(zero_copy_only=False)


def _place(found: pa.Array, words: list[str]) -> np.ndarray:
    """The place of each word in ``words``, its ASCII letters in lower case and curly apostrophes straight; -1 for others."""
    found = pc.replace_substring(pc.ascii_lower(found), "\u2019", "'")
    return pc.fill_null(pc.index_in(found, value_set=pa.array(words, pa.string())), -1).to_numpy(zero_copy_only=False)


def listed(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """``values`` in lists of so many."""
    return pa.ListArray.from_arrays(pa.array(_sums(counts)), values)


class Texts:
    """A column of texts as code points, with the tokens found in it.

    Tokens are numbered over all texts; ``doc`` is a token's row and ``pos`` its number
    there. ``glued``: right behind another token. ``start`` and ``end`` count UTF-8 bytes, ``char`` characters and ``unit`` UTF-16
    units from the text's start.
    """

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.bytes, self.offsets = raw, offsets - offsets[0]
        self.x = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int32)  # byte of each character
        self.bounds = np.searchsorted(self.at, self.offsets).astype(np.int32)  # character range of each text
        self._segment()
        home = self.bounds[:-1][self.doc]
        wide = self.wide = _sums(self.x > 0xFFFF)
        self.start, self.end = self.at[self.c0] - self.at[home], self.at[self.c1] - self.at[home]
        self.glued = (self.pos > 0) & (_before(self.c1, -1) == self.c0)
        self.char = self.c0 - home
        self.unit = self.char + wide[self.c0] - wide[home]

    def _segment(self) -> None:
        f = _flags()[self.x]
        n = len(f)
        new = np.zeros(n + 1, bool)
        new[self.bounds] = True
        new = new[:n]
        alnum = (f & (LETTER | NUMERAL)) != 0
        starts = np.flatnonzero(alnum & ~(_before(alnum, False) & ~new))
        stops = np.flatnonzero(alnum & ~_after(alnum & ~new)) + 1
        letters = _sums((f & LETTER) != 0)
        has = letters[stops] > letters[starts]
        # runs that one mark parts from the run before, in the same text
        near = np.zeros(len(starts), bool)
        near[1:] = (starts[1:] == stops[:-1] + 1) & ~new[starts[1:]] & ~new[np.minimum(starts[1:] - 1, n - 1)]
        mark = f[np.maximum(starts - 1, 0)] if n else np.empty(0, np.uint8)
        joined = near & ((mark & JOINER) != 0)
        chain = np.maximum.accumulate(np.where(joined, 0, np.arange(len(starts)))) if len(starts) else np.empty(0, np.int64)
        seen = _sums(has)
        word = seen[1:] > seen[chain]  # a run is (the end of) a word when the chain had a letter so far
        goes_on = joined & _before(word, False)
        numeral_first = (f[starts] & LETTER) == 0 if n else np.empty(0, bool)
        decimal = near & ((mark & SEPARATOR) != 0) & numeral_first & ~_before(word, True)
        begins = np.ones(n, bool)
        begins[alnum] = False
        begins[starts[goes_on | decimal] - 1] = False
        begins[starts[~goes_on & ~decimal]] = True
        # a number at the head of a run ends where its first letter is
        at_letter = np.flatnonzero((f & LETTER) != 0)
        mixed = numeral_first & has & ~goes_on
        if mixed.any():
            begins[at_letter[letters[starts[mixed]]]] = True
        for bit in (END, SPACE):
            is_ = (f & bit) != 0
            begins[is_ & _before(is_, False) & ~new] = False
        begins[new] = True
        seg = self.seg = np.flatnonzero(begins).astype(np.int32)
        lead = f[seg]
        kind = np.full(len(seg), PUNCT, np.int8)
        for bit, k in ((QUOTE, QUOTED), (SPACE, BLANK), (END, STOP), (NUMERAL, NUMBER), (LETTER, WORD)):
            kind[(lead & bit) != 0] = k
        self.seg_kind, stop = kind, np.append(seg[1:], n)[: len(seg)].astype(np.int32)
        self.token = np.flatnonzero(kind != BLANK).astype(np.int32)  # segments that are tokens
        self.kind = kind[self.token]
        self.c0, self.c1 = seg[self.token], stop[self.token]
        self.doc = (np.searchsorted(self.bounds, self.c0, "right") - 1).astype(np.int32)
        first = np.searchsorted(self.c0, self.bounds[:-1]).astype(np.int32)
        self.pos = np.arange(len(self.doc), dtype=np.int32) - first[self.doc]

    def _segments(self) -> pa.Array:
        at = self.at[np.append(self.seg, len(self.x))].astype(np.int32)
        return pa.StringArray.from_buffers(len(self.seg), pa.py_buffer(at), pa.py_buffer(self.bytes))

    @cached_property
    def _lexemes(self) -> pa.Array:
        return self._segments().take(pa.array(self.token))

    def lexemes(self) -> pa.Array:
        return self._lexemes

    def kinds(self) -> pa.Array:
        return pa.array(KINDS, pa.string()).take(pa.array(self.kind.astype(np.int32)))

    def broken(self) -> np.ndarray:
        """Whether the white space between a token and the one before it holds a line break."""
        breaks = _sums((self.x == 10) | (self.x == 13))
        return (self.pos > 0) & (breaks[self.c0] > breaks[_before(self.c1, 0)])

    def breaks(self) -> np.ndarray:
        """Line breaks in the white space before each token; CRLF is one."""
        so_far = self._rows
        before = np.where(self.pos > 0, _before(self.c1, 0), self.bounds[:-1][self.doc])
        return so_far[self.c0] - so_far[before]

    def gaps(self) -> pa.Array:
        """The white space before each token, empty where there is none."""
        before = np.maximum(self.token - 1, 0)
        blank = (self.token > 0) & (self.seg_kind[before] == BLANK) & (self.seg[before] >= self.bounds[:-1][self.doc]) if len(self.token) else np.zeros(0, bool)
        return pc.fill_null(self._segments().take(pa.array(before, mask=~blank)), "")

    @cached_property
    def _rows(self) -> np.ndarray:
        """Line breaks before each character; CRLF is one."""
        lf, cr = self.x == 10, self.x == 13
        behind = _before(cr, False)
        behind[self.bounds[:-1][self.bounds[:-1] < len(cr)]] = False
        return _sums((lf & ~behind) | cr)

    @cached_property
    def lines(self) -> np.ndarray:
        """First character of each line of all texts, in order: a new one after every CR or LF; the empty ones at texts' ends aside."""
        begins = np.zeros(len(self.x) + 1, bool)
        begins[self.bounds] = True
        begins[1:] |= (self.x == 10) | (self.x == 13)
        return np.flatnonzero(begins[:-1]).astype(np.int32)

    @cached_property
    def line(self) -> np.ndarray:
        """The line that each token stands on, as its place in ``lines``."""
        return np.searchsorted(self.lines, self.c0, "right") - 1

    @cached_property
    def titles(self) -> np.ndarray:
        """Whether each line is a title: two capitalised words at least, and every other one closed-class. Words are letters and apostrophes here."""
        flags = _flags()[self.x]
        letter = ((flags & ALPHABETIC) != 0) | (self.x == 0x27) | (self.x == 0x2019)
        inner = letter.copy()
        inner[self.lines] = False
        begin = np.flatnonzero(letter & ~(_before(letter, False) & inner))
        end = np.flatnonzero(letter & ~(_after(letter) & _after(inner))) + 1
        line = np.searchsorted(self.lines, begin, "right") - 1
        capital = (flags[begin] & UPPERCASE) != 0
        out = np.bincount(line[capital], minlength=len(self.lines)) >= 2
        # other words are looked up on lines that may be titles alone
        asked = ~capital & out[line]
        cuts = np.stack([self.at[begin[asked]], self.at[end[asked]]], 1).ravel()
        words = pa.StringArray.from_buffers(max(len(cuts) - 1, 0), pa.py_buffer(np.ascontiguousarray(cuts, np.int32) if len(cuts) else np.zeros(1, np.int32)), pa.py_buffer(self.bytes))
        words = words.take(pa.array(np.arange(0, len(words), 2)))
        out[line[asked][~_among(words, [w for w, _ in V.CLOSED_ROWS], True)]] = False
        return out

    def title_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and row of the lines that are titles; rows count CRLF as one break."""
        at = self.lines[self.titles]
        doc = np.searchsorted(self.bounds, at, "right") - 1
        return doc, self._rows[at] - self._rows[self.bounds[:-1][doc]]

    def row(self) -> np.ndarray:
        return self._rows[self.c0] - self._rows[self.bounds[:-1][self.doc]]

    def col(self) -> np.ndarray:
        return self.c0 - self.lines[self.line]

    def col16(self) -> np.ndarray:
        return self.col() + self.wide[self.c0] - self.wide[self.lines[self.line]]

    def end_col(self) -> np.ndarray:
        return self.c1 - self.lines[self.line]

    def len16(self) -> np.ndarray:
        return self.c1 - self.c0 + self.wide[self.c1] - self.wide[self.c0]

    @cached_property
    def _each(self) -> np.ndarray:
        return np.arange(len(self.pos), dtype=np.int32)

    @cached_property
    def starts(self) -> np.ndarray:
        """Whether a token begins a sentence: it is no closer (a quote or bracket right behind another token), and the last token that isn't one was an end."""
        closer = self.glued & self._first_is(CLOSER)
        last = np.maximum.accumulate(np.where(closer, 0, self._each))
        return (self.pos > 0) & ~closer & (self.kind[_before(last, 0)] == STOP)

    @cached_property
    def head(self) -> np.ndarray:
        """The token that each token's sentence begins with."""
        return np.maximum.accumulate(np.where(self.starts | (self.pos == 0), self._each, 0))

    def sent_id(self) -> np.ndarray:
        so_far = np.cumsum(self.starts, dtype=np.int32)
        return so_far - so_far[self._each - self.pos]

    def ends(self) -> np.ndarray:
        """Whether a token is the last of its sentence."""
        out = np.ones(len(self.pos), bool)
        out[:-1] = (self.starts | (self.pos == 0))[1:]
        return out

    def is_word(self) -> np.ndarray:
        return (self.kind == WORD) | (self.kind == NUMBER)

    def words(self) -> np.ndarray:
        """Words of a token's sentence up to it."""
        so_far = _sums(self.is_word())
        return so_far[1:] - so_far[self.head]

    def nth(self) -> np.ndarray:
        """Words of a token's text before it."""
        so_far = _sums(self.is_word())
        return so_far[:-1] - so_far[self._each - self.pos]

    def _first_is(self, bit: int) -> np.ndarray:
        return (_flags()[self.x[self.c0]] & bit) != 0

    @cached_property
    def guarded(self) -> np.ndarray:
        """Whether a token is capitalised where only a name is.

        An alphabetic word came before it since the sentence began or a line was crossed,
        and the line that was crossed last is no title. A line is crossed by the first
        word of a text and by a word right behind a line break.
        """
        is_word, first = self.is_word(), self._each - self.pos
        so_far, alphas = _sums(is_word), _sums(is_word & self._first_is(ALPHABETIC))[:-1]
        crossed = is_word & ((so_far[:-1] == so_far[first]) | self.broken())
        last = lambda x: np.maximum.accumulate(np.where(x, self._each, -1))
        line, parted = last(crossed), last(crossed | self.starts)
        title = self.titles[self.line]
        in_title = (line >= first) & title[line]
        since = alphas > alphas[np.maximum(parted, first)]
        return (self.kind == WORD) & self._first_is(UPPERCASE) & ~in_title & since

    def among(self, words: list[str], straight: bool = False) -> np.ndarray:
        """Whether a token, its ASCII letters in lower case, is one of ``words``; with ``straight``, a curly apostrophe counts as a straight one."""
        return _among(self._lexemes, words, straight)

    def beside(self, tokens: np.ndarray) -> np.ndarray:
        """``tokens`` and those right before and behind them."""
        return tokens | _before(tokens, False) | _after(tokens)

    def phrases(self, first: list[str], then: list[str], within: int, reach: int) -> np.ndarray:
        """Tokens from a word of ``first`` that has one of ``then`` among the next ``within`` words, up to the word ``reach`` words on."""
        at = np.flatnonzero(self.is_word())
        begins, follows = self.among(first)[at], self.among(then)[at]
        near = np.zeros(len(at), bool)
        for k in range(1, within + 1):
            near[:-k] |= follows[k:]
        found = np.flatnonzero(begins & near)
        depth = np.zeros(len(self.pos) + 1, np.int32)
        np.add.at(depth, at[found], 1)
        np.add.at(depth, at[np.minimum(found + reach, len(at) - 1)] + 1, -1)
        return np.cumsum(depth[:-1]) > 0

    @cached_property
    def closed(self) -> np.ndarray:
        """The place of each word in CLOSED_ROWS, -1 for others."""
        return np.where(self.kind == WORD, _place(self._lexemes, [w for w, _ in V.CLOSED_ROWS]), -1)

    @cached_property
    def seed(self) -> np.ndarray:
        """The place of each open-class seed in OPEN_ROWS, -1 for others and for names."""
        return np.where((self.kind == WORD) & ~self.guarded, _place(self._lexemes, [w for w, _ in V.OPEN_ROWS]), -1)

    @cached_property
    def base(self) -> np.ndarray:
        """The class of each token before neighbours are looked at, as its place in CLASSES."""
        kind = self.kind
        return np.select([kind == NUMBER, kind == QUOTED, kind != WORD, self.closed >= 0, self.guarded, self.seed >= 0], range(6), 6).astype(np.int32)

    def _named(self, at: np.ndarray, names: list) -> pa.Array:
        return pa.array(names, pa.string()).take(pa.array(at, pa.int32(), mask=at < 0))

    def _each_text(self, tokens: np.ndarray | None = None) -> np.ndarray:
        """How many tokens (of ``tokens``) each text has."""
        return np.bincount(self.doc if tokens is None else self.doc[tokens], minlength=len(self.bounds) - 1)

    def token_lists(self) -> pa.ListArray:
        """Each text's tokens with their axes, as the interchange format has them."""
        names = ["byteRange", "functionKind", "lexicalClass", "occurrenceId", "openClassKind", "tokenKind"]
        span = pa.StructArray.from_arrays([pa.array(self.end), pa.array(self.start)], ["endUtf8", "startUtf8"])
        closed, seed = (self._named(at, [k.upper() for _, k in rows]) for at, rows in ((self.closed, V.CLOSED_ROWS), (np.where(self.base == OPEN, self.seed, -1), V.OPEN_ROWS)))
        lexical, kind = (self._named(self.base, [c[i] for c in CLASSES]) for i in (1, 2))
        return listed(self._each_text(), pa.StructArray.from_arrays([span, closed, lexical, pa.array(self.pos), seed, kind], names))

    def sentence_lists(self) -> pa.ListArray:
        """Each text's sentences: start, end, and the line breaks before them."""
        head = np.flatnonzero(self.starts | (self.pos == 0))
        last = np.append(head[1:], len(self.pos))[: len(head)] - 1
        return listed(self._each_text(head), pa.StructArray.from_arrays([pa.array(self.start[head]), pa.array(self.end[last]), pa.array(self.breaks()[head])], ["start", "end", "breaks"]))

    def _spans(self) -> dict[str, pa.Array]:
        return {"start": pa.array(self.start), "end": pa.array(self.end)}

    def _in_sentences(self, tokens: pa.Array, name: str, **same: str) -> pa.ListArray:
        """Each text's sentences: what is the ``same`` of each, start, end, and their own tokens under ``name``."""
        head = np.flatnonzero(self.starts | (self.pos == 0))
        sizes = np.diff(np.append(head, len(self.pos)))
        found = {k: pa.repeat(pa.scalar(v), len(head)) for k, v in same.items()} | {"start": pa.array(self.start[head]), "end": pa.array(self.end[head + sizes - 1]), name: listed(sizes, tokens)}
        return listed(self._each_text(head), pa.StructArray.from_arrays(list(found.values()), list(found)))

    def _kinds(self) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(self.pos), *self._spans().values(), self.kinds()], ["pos", "start", "end", "kind"])

    def kind_lists(self) -> pa.ListArray:
        """Each text's tokens: pos, start, end, kind."""
        return listed(self._each_text(), self._kinds())

    def range_lists(self) -> pa.ListArray:
        """Each text's sentences: start, end, and their tokens as in ``kind_lists``."""
        return self._in_sentences(self._kinds(), "own")

    def span_lists(self) -> pa.ListArray:
        """Each text's tokens: start, end."""
        return listed(self._each_text(), pa.StructArray.from_arrays(list(self._spans().values()), ["start", "end"]))

    def tree_lists(self) -> pa.ListArray:
        """Each text's sentences as a parser's tree has them, with their words and marks."""
        kind = pa.array(["Word", "Punct"], pa.string()).take(pa.array(np.where(self.is_word(), 0, 1).astype(np.int32)))
        parts = pa.StructArray.from_arrays([kind, *self._spans().values()], ["kind", "start", "end"])
        return self._in_sentences(parts, "parts", kind="Sentence")

    def _undecided(self) -> np.ndarray:
        return (self.base == CONTENT) & self.among(V.AMBIGUOUS)

    def undecided_lists(self) -> pa.ListArray:
        """The number of each token among the ambiguous content words of its text, from 1; 0 for all others."""
        mine = self._undecided()
        so_far = _sums(mine)
        return listed(self._each_text(), pa.array(np.where(mine, so_far[1:] - so_far[self._each - self.pos], 0).astype(np.int32)))

    def island_lists(self) -> pa.ListArray:
        """Each text's runs of ambiguous content words: the word, whether a noun may follow, and the token before."""
        mine = self._undecided()
        at = np.flatnonzero(mine)
        head = at[(self.pos[at] == 0) | ~_before(mine, False)[at]]
        noun = np.array([k == "Noun" for _, k in V.OPEN_ROWS])
        nounish = (self.base == CONTENT) | (self.base == NAME) | ((self.base == OPEN) & noun[self.seed])
        follows = _after(nounish) & ~_after(self.pos == 0)
        before = np.where(self.pos[at] > 0, at - 1, -1)
        of = lambda x: np.where(before < 0, -1, x[before]) if len(x) else before
        behind = [self._named(of(self.base), [c[0] for c in CLASSES]), self._named(of(self.seed), [k for _, k in V.OPEN_ROWS]), self._named(of(self.closed), [k for _, k in V.CLOSED_ROWS]), self._lexemes.take(pa.array(before, pa.int64(), mask=before < 0))]
        words = pa.StructArray.from_arrays([pc.ascii_lower(self._lexemes.take(pa.array(at))), pa.array(follows[at]), *behind], ["word", "noun_after", "pos_class", "open_kind", "function_kind", "lexeme"])
        sizes = np.diff(np.append(np.searchsorted(at, head), len(at)))
        return listed(self._each_text(head), listed(sizes, words))
