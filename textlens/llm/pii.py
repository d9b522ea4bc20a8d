"""Personal data: base patterns, and a semi-Markov conditional random field beside them.

The base patterns are exact and always kept. The field reads the neighbourhoods of
numbers and of spelled-out at-signs, scores whole candidate segments of up to
``LONGEST`` tokens with features of the span, and a dynamic program chooses
boundaries and kinds jointly. Its segments are added where they touch no base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Tokens of an entity at most.
LONGEST = 14
#: How much better than plain text a segment must score to be added.
MARGIN = 2.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a number's first digit only: a later start in the same run of digits can't do better
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind and then start, in code points."""
    found: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0]) if m.end() - m.start() < 60 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# Where the field looks: numbers of several groups, and at-signs spelled out
_NUMBER = re.compile(r"[+(]?[0-9][0-9\x20().\-]{5,}[0-9]")
_MARKED_AT, _MARKED_DOT = (rf"[\[({{]\x20?{w}\x20?[\])}}]" for w in ("at", "dot"))
# a local part of any length, from where it begins, and a domain of any number of parts
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?{_MARKED_AT}\x20?[A-Za-z0-9-]++(?:\x20?(?:{_MARKED_DOT}|\.)\x20?[A-Za-z0-9-]++)*+", re.I)
_WHOLE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]+(?:\x20?(?:[\[({]\x20?dot\x20?[\])}]|\.)\x20?[A-Za-z]{2,})+", re.I)
# a bracketed "at" or "dot" is one token, so that an address of several parts isn't longer than an entity may be
_TOKEN = re.compile(rf"{_MARKED_AT}|{_MARKED_DOT}|[0-9]+|[^\W\d_]+|[^\w\s]|_", re.I)
_AT_TOKEN = re.compile(rf"at|@|{_MARKED_AT}", re.I)
# Words that announce a kind, or another sort of number
CUES = {
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "whatsapp", "telefon", "téléphone", "teléfono"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"},
    "ip": {"ip", "host", "server", "address", "ipv4"},
    "email": {"mail", "email", "contact", "write"},
    "number": {"order", "invoice", "ref", "reference", "id", "version", "date", "isbn", "page", "no", "item", "account", "total"},
}
_CUE = {w: k for k, words in CUES.items() for w in words}
FEATURES = [
    "bias", "digits0", "digits1-6", "digits7", "digits8-9", "digits10", "digits11-12", "digits13-15", "digits16-19", "digits20+", "groups1", "groups2", "groups3", "groups4", "groups5+",
    "plus", "bracket", "at_sign", "at_word", "dot_word", "quad", "luhn", "fours", "334", "34", "long_group", "dashes", "spaces", "dots", "mixed", "letters", "ends_in_mark", "one_token",
    "cue_phone", "cue_card", "cue_ip", "cue_email", "cue_number", "year", "plain_word", "spelled_whole", "touches_left", "touches_right", "starts_in_mark",
]
_AT = {f: i for i, f in enumerate(FEATURES)}


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Indices of the binary features that the span of tokens i to j - 1 has."""
    span = text[tokens[i][0] : tokens[j - 1][1]]
    groups = re.findall(r"[0-9]+", span)
    n = sum(map(len, groups))
    lengths = [len(g) for g in groups]
    on = ["bias"]
    on.append("digits0" if n == 0 else "digits1-6" if n < 7 else "digits7" if n == 7 else "digits8-9" if n < 10 else "digits10" if n == 10 else "digits11-12" if n < 13 else "digits13-15" if n < 16 else "digits16-19" if n < 20 else "digits20+")
    if groups:
        on.append(f"groups{len(groups)}" if len(groups) < 5 else "groups5+")
    low = span.lower()
    seps = set(re.sub(r"[0-9A-Za-z]", "", span))
    on += ["plus"] * (span[0] == "+") + ["bracket"] * (span[0] == "(") + ["at_sign"] * ("@" in span)
    on += ["at_word"] * bool(re.search(r"[\[({] ?at ?[\])}]", low)) + ["dot_word"] * bool(re.search(r"[\[({] ?dot ?[\])}]|\.", low))
    on += ["quad"] * (bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", span)) and all(int(g) < 256 for g in groups))
    on += ["luhn"] * (13 <= n <= 19 and luhn("".join(groups))) + ["fours"] * (len(groups) > 2 and set(lengths[:-1]) == {4})
    on += ["334"] * (lengths[-3:] == [3, 3, 4]) + ["34"] * (lengths == [3, 4]) + ["long_group"] * any(k > 4 for k in lengths)
    on += ["dashes"] * (seps == {"-"}) + ["spaces"] * (seps == {" "}) + ["dots"] * (seps == {"."}) + ["mixed"] * (len(seps) > 1)
    on += ["letters"] * bool(re.search(r"[^\W\d_]", span)) + ["ends_in_mark"] * (not span[-1].isalnum()) + ["one_token"] * (j - i == 1)
    on += ["year"] * (len(groups) <= 3 and any(len(g) == 4 and g[:2] in ("19", "20") for g in groups) and n <= 8)
    on += ["plain_word"] * (j - i == 1 and span.isalpha())
    on += ["spelled_whole"] * bool(_WHOLE.fullmatch(span)) + ["starts_in_mark"] * (not span[0].isalnum() and span[0] not in "+(")
    left, right = tokens[i][0], tokens[j - 1][1]
    before, after = text[max(0, left - 1) : left], text[right : right + 2]
    on += ["touches_left"] * (before.isalnum() or (before != "" and before in "._%+-")) + ["touches_right"] * (after[:1].isalnum() or (after[:1] in (".", "-", "_") and after[1:].isalnum()))
    for a, b in tokens[max(0, i - 3) : i]:
        if kind := _CUE.get(text[a:b].lower()):
            on.append(f"cue_{kind}")
    return sorted({_AT[f] for f in on})


def candidates(text: str, tokens: list[tuple[int, int]], closed: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """((start, stop) token pairs, feature matrix) of the segments of a text.

    Every token is a segment; longer ones, of up to ``LONGEST`` tokens, need a digit or a
    spelled-out at-sign, no gap of more than one blank, and no ``closed`` token.
    """
    n, spans, rows = len(tokens), [], []
    digit = [text[a].isdigit() for a, _ in tokens]
    at = [bool(_AT_TOKEN.fullmatch(text, a, b)) for a, b in tokens]
    for i in range(n):
        some = False
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            a, b = tokens[j - 1]
            if j > i + 1 and (a - tokens[j - 2][1] > 1 or "\n" in text[tokens[j - 2][1] : a]):
                break
            if closed is not None and closed[j - 1] and j > i + 1:
                break
            some = some or digit[j - 1] or at[j - 1]
            if j == i + 1 or some:
                spans.append((i, j))
                rows.append(features(text, tokens, i, j))
            if closed is not None and closed[i]:
                break
    matrix = np.zeros((len(spans), len(FEATURES)))
    for k, on in enumerate(rows):
        matrix[k, on] = 1
    return np.array(spans, np.int64).reshape(-1, 2), matrix


def _total(x: np.ndarray, axis) -> np.ndarray:
    """log of the sum of exponentials."""
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Field:
    """Weights of a semi-Markov field; plain text is segments of one token."""

    def __init__(self):
        self.weights = np.zeros((len(LABELS), len(FEATURES)))
        self.follows = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, spans: np.ndarray, matrix: np.ndarray, closed: list[bool] | None = None) -> np.ndarray:
        out = matrix @ self.weights.T
        out[spans[:, 1] - spans[:, 0] > 1, 0] = -np.inf
        if closed is not None:  # a token of a base span is plain text here
            out[np.array(closed, bool)[spans[:, 0]], 1:] = -np.inf
        return out

    def decode(self, text: str, tokens: list[tuple[int, int]], closed: list[bool] | None = None) -> list[tuple[str, int, int]]:
        """The best segmentation's entities, those ``MARGIN`` better than plain text."""
        n, k = len(tokens), len(LABELS)
        spans, matrix = candidates(text, tokens, closed)
        scores = self.scores(spans, matrix, closed)
        order = np.argsort(spans[:, 1], kind="stable")
        ends = np.searchsorted(spans[order, 1], np.arange(n + 2))
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0
        back = np.zeros((n + 1, k, 2), np.int64)
        for j in range(1, n + 1):
            own = order[ends[j] : ends[j + 1]]
            through = best[spans[own, 0]][:, :, None] + self.follows  # segment, label before, label
            before = through.argmax(1)
            total = through.max(1) + scores[own]
            pick = total.argmax(0)
            best[j] = total[pick, np.arange(k)]
            back[j, :, 0], back[j, :, 1] = own[pick], before[pick, np.arange(k)]
        alone = {int(spans[o, 0]): o for o in range(len(spans)) if spans[o, 1] == spans[o, 0] + 1}
        j, y, out = n, int(best[n].argmax()), []
        while j > 0:
            o, before = back[j, y]
            i = int(spans[o, 0])
            if y:
                plain = sum(scores[alone[t], 0] + self.follows[0, 0] for t in range(i, j))
                if scores[o, y] + self.follows[before, y] - plain >= MARGIN:
                    out.append((LABELS[y], tokens[i][0], tokens[j - 1][1]))
            j, y = i, int(before)
        return out[::-1]

    def gradient(self, spans: np.ndarray, matrix: np.ndarray, n: int, gold: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected features, for gold segments (row of spans, label)."""
        k = len(LABELS)
        scores = self.scores(spans, matrix)
        by_end, by_start = np.argsort(spans[:, 1], kind="stable"), np.argsort(spans[:, 0], kind="stable")
        ends, starts = np.searchsorted(spans[by_end, 1], np.arange(n + 2)), np.searchsorted(spans[by_start, 0], np.arange(n + 1))
        ahead, behind = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        ahead[0, 0], behind[n] = 0, 0
        for j in range(1, n + 1):
            own = by_end[ends[j] : ends[j + 1]]
            ahead[j] = _total(ahead[spans[own, 0]][:, :, None] + self.follows + scores[own][:, None, :], (0, 1))
        for i in range(n - 1, -1, -1):
            own = by_start[starts[i] : starts[i + 1]]
            behind[i] = _total(self.follows + (scores[own] + behind[spans[own, 1]])[:, None, :], (0, 2))
        total = _total(ahead[n], 0)
        joint = np.exp(np.minimum(ahead[spans[:, 0]][:, :, None] + self.follows + (scores + behind[spans[:, 1]])[:, None, :] - total, 0))
        w, f = -(joint.sum(1).T @ matrix), -joint.sum(0)
        before = 0
        for o, y in gold:
            w[y] += matrix[o]
            f[before, y] += 1
            before = y
        return w, f


def examples(seed: int, count: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with marked entities, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    upto = lambda a, b: int(rng.integers(a, b + 1))
    syllables = ["ba", "con", "der", "er", "fi", "go", "in", "ka", "lo", "mer", "na", "on", "pre", "ra", "st", "ta", "un", "ver", "wi", "zo"]
    word = lambda: "".join(pick(syllables) for _ in range(upto(1, 3)))

    def checked(n: int, good: bool = True) -> str:
        body = pick("3456") + digits(n - 2)
        return body + pick([d for d in "0123456789" if luhn(body + d) == good])

    def grouped(d: str, sizes: tuple, sep: str) -> str:
        at = np.cumsum([0, *sizes])
        return sep.join(d[a:b] for a, b in zip(at, at[1:], strict=False))

    def entity(kind: str) -> str:
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            sep = pick([" ", "-", "."])
            return pick([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}{sep}{b}{sep}{c}", f"+{upto(1, 99)} {a} {b} {c}", f"+{upto(20, 99)} {digits(3)} {digits(upto(6, 8))}", f"+{upto(20, 99)} ({digits(upto(2, 4))}) {digits(7)}", f"1-{a}-{b}-{c}"])
        if kind == "card":
            d = checked(pick([15, 16, 16, 16]))
            return pick([d, grouped(d, (4, 4, 4, 4), pick(" -"))]) if len(d) == 16 else pick([d, grouped(d, (4, 6, 5), pick(" -"))])
        if kind == "ip":
            return ".".join(str(upto(0, 255)) for _ in range(4))
        a, o = pick(["[]", "()", "{}"]), pick(["", " "])
        dot = pick([f"{o}{a[0]}dot{a[1]}{o}", "."])
        return f"{word()}{pick(['', '.' + word()])}{o}{a[0]}at{a[1]}{o}{word()}{dot}{pick(['com', 'org', 'net', 'de'])}"

    def decoy() -> str:
        return pick([
            f"{upto(1, 12)}-{upto(1, 28)}-20{digits(2)}", f"20{digits(2)}-0{upto(1, 9)}-1{digits(1)}", f"{upto(1, 28)}.{upto(1, 12)}.19{digits(2)}", digits(8), checked(16, False), f"{digits(4)} {digits(4)} {digits(3)}", digits(12),
            f"{upto(300, 999)}.{digits(3)}.{digits(2)}.{digits(3)}", f"{digits(3)} {digits(2)} {digits(1)}", f"{digits(5)}-{digits(5)}", digits(21), f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{upto(1, 9)},{digits(3)},{digits(3)}",
            f"{upto(1, 23)}:{digits(2)}", f"{upto(1, 9)}.{upto(0, 9)}.{upto(0, 9)}", f"{digits(4)}", f"({digits(4)})", f"{digits(2)} - {digits(2)}", f"at {word()}", f"({word()} at {word()})", digits(6), f"{digits(2)} {digits(3)} {digits(3)}",
        ])

    for _ in range(count):
        text, marks = "", []
        for _ in range(upto(1, 2)):
            text += " ".join(word() for _ in range(upto(1, 4))) + " "
            if rng.random() < 0.6:
                kind = pick(KINDS)
                if rng.random() < 0.4:
                    text += pick(sorted(CUES[kind])) + pick([" ", ": "])
                value = entity(kind)
                marks.append((kind, len(text), len(text) + len(value)))
            else:
                if rng.random() < 0.4:
                    text += pick(sorted(CUES["number"])) + " "
                value = decoy()
            text += value + pick([" ", ". ", ", ", "; ", ") "])
        yield text + word(), marks


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


@cache
def trained(seed: int = 1, count: int = 1000, rounds: int = 5, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """The field fitted by adaptive gradient ascent on the conditional likelihood of ``count`` sentences."""
    field, made = Field(), []
    for text, marks in examples(seed, count):
        tokens = tokens_of(text)
        spans, matrix = candidates(text, tokens)
        row = {(int(i), int(j)): o for o, (i, j) in enumerate(spans)}
        starts = {a: (k, b) for k, a, b in marks}
        gold, i = [], 0
        while i < len(tokens):
            kind, b = starts.get(tokens[i][0], (None, 0))
            j = next((j for j in range(i + 1, len(tokens) + 1) if tokens[j - 1][1] == b), 0) if kind else 0
            if j and (i, j) not in row:
                break  # a generated entity that no segment covers teaches nothing
            gold.append((row[i, j or i + 1], LABELS.index(kind) if j else 0))
            i = j or i + 1
        if i == len(tokens):
            made.append((spans, matrix, len(tokens), gold))
    past = [np.full_like(field.weights, 1e-2), np.full_like(field.follows, 1e-2)]
    for _ in range(rounds):
        for example in made:
            for x, g, p in zip((field.weights, field.follows), field.gradient(*example), past, strict=True):
                g = g - ridge * x
                p += g * g
                x += rate * g / np.sqrt(p)
    return field


def _windows(text: str) -> list[tuple[int, int]]:
    """Merged neighbourhoods of numbers and spelled-out at-signs, cut at no token."""
    places = [m.span() for m in _NUMBER.finditer(text)]
    if any(c in text for c in "[({"):
        places += [m.span() for m in _SPELLED.finditer(text)]
    out: list[list[int]] = []
    for s, e in sorted(places):
        s, e = max(0, s - 40), min(len(text), e + 20)
        while s > 0 and text[s - 1].isalnum() and text[s].isalnum():
            s -= 1
        while e < len(text) and text[e - 1].isalnum() and text[e].isalnum():
            e += 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Entities of the field that touch no base span."""
    if not _DIGIT.search(text) and "at" not in text.lower():
        return []
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    starts = [s for s, _ in taken]

    def touched(a: int, b: int) -> bool:
        k = bisect_left(starts, b) - 1
        return k >= 0 and taken[k][1] > a

    out: list[tuple[str, int, int]] = []
    for lo, hi in _windows(text):
        window = text[lo:hi]
        tokens = tokens_of(window)
        closed = [touched(a + lo, b + lo) for a, b in tokens]
        for kind, a, b in field.decode(window, tokens, closed) if tokens and not all(closed) else []:
            if kind != "card" or luhn(re.sub(r"[^0-9]", "", window[a:b])):
                out.append((kind, a + lo, b + lo))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts of base spans, base_sha256, spans (base and added) and n_added of every row.

    Null and empty texts have no spans (the hash of the empty string). Every row, also
    a repeated one, gives a row; texts are read whole; other columns are not read.
    A base span is never changed or dropped; added spans never overlap any other.
    """
    field = trained()
    source = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list] = {k: [] for k in KINDS}
            hashes, spans, extra = [], [], []
            for body in batch.column(1).to_pylist():
                base = base_spans(body or "")
                more = added_spans(body, base, field) if body else []
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
                extra.append(len(more))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return source.mapInArrow(run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
