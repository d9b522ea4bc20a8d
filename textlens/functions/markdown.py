"""Masks what isn't prose in a Markdown text, without moving a byte, line or UTF-16 unit.

A text is cut into blocks twice over: containers (quotes, list items) strip their
marks from lines, what is left is code, HTML, metadata, definitions or running text.
Running text is then read for code spans, autolinks, HTML, link destinations and
reference names. Scope: CommonMark blocks and links, and metadata between --- or +++.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+|$)")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_INDENT = re.compile(r" {0,3}\t| {4}")
_TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
# Names that open an HTML block of their own.
_NAMES = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6"
    "|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
#: How an HTML block starts, how it ends (None: at a blank line), and whether it may follow text at once.
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r" {0,3}<!--"), re.compile("-->"), True),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>"), True),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">"), True),
    (re.compile(rf" {{0,3}}</?(?:{_NAMES})(?:\s|/?>|$)", re.I), None, True),
    (re.compile(rf" {{0,3}}(?:{_TAG})\s*$"), None, False),
]
_INLINE_HTML = re.compile(rf"{_TAG}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<![A-Za-z][^>]*>", re.S)
_AUTOLINK = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*>|<[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*>", re.A)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){1,999})\]", re.S)
_TITLE = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)"
_GAP = r"[ \t]*(?:\r\n|\r|\n)?[ \t]*"
_BLANKS = re.compile(" *")
_DEFINITION = re.compile(rf"{_LABEL.pattern}:{_GAP}(?:<(?:[^<>\r\n\\]|\\.)*>|[^\s<]\S*)(?:(?=[ \t\r\n]){_GAP}(?:{_TITLE})(?=[ \t]*(?:[\r\n]|$)))?[ \t]*(?:\r\n|\r|\n|$)", re.S)


#: Inline HTML that only its own mark closes.
_CLOSING = {"<!--": "-->", "<?": "?>", "<![CDATA[": "]]>"}
#: Containers inside each other beyond which a mark is text.
DEEPEST = 100
#: Parentheses inside each other that a bare link destination may have.
DEEPEST_DESTINATION = 32
#: Characters of a label.
LABEL = 999


@dataclass
class _Scan:
    text: str
    masks: list[tuple[int, int, bool]] = field(default_factory=list)
    names: set[str] = field(default_factory=set)
    running: list[list[tuple[int, int]]] = field(default_factory=list)
    rendered: list[int] = field(default_factory=list)
    defined: list[int] = field(default_factory=list)


def _name(label: str) -> str:
    return " ".join(label.split()).casefold()


def _bare(text: str, span: tuple[int, int]) -> str:
    return text[span[0] : span[1]].rstrip("\r\n")


def _starts_block(line: str) -> bool:
    """Whether a line can't go on a paragraph."""
    return bool(_FENCE.match(line) or _RULE.match(line) or _HEADING.match(line) or _QUOTE.match(line) or re.match(r" {0,3}(?:[-+*]|1[.)])[ \t]+\S", line) or any(p.match(line) for p, _, joins in _HTML if joins))


def _blocks(scan: _Scan, lines: list[tuple[int, int]], depth: int = 0) -> None:
    text, i = scan.text, 0
    following: list[int | None] = []  # of each line, the first that isn't blank from there on; made once, where an item needs it
    while i < len(lines):
        line = _bare(text, lines[i])
        begin = lines[i][0]
        if not line.strip():
            i += 1
            continue
        end = _metadata(text, lines, i, line)
        if end is None and _INDENT.match(line):
            end = i + 1
            while end < len(lines) and (_INDENT.match(_bare(text, lines[end])) or not _bare(text, lines[end]).strip()):
                end += 1
            while not _bare(text, lines[end - 1]).strip():
                end -= 1
            begin += _INDENT.match(line).end()
        fence = _FENCE.match(line) if end is None else None
        if fence:
            close, end = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$"), i + 1
            while end < len(lines) and not close.match(_bare(text, lines[end])):
                end += 1
            end = min(end + 1, len(lines))
            begin += len(line) - len(line.lstrip(" "))
        html = next(((p, stop) for p, stop, _ in _HTML if p.match(line)), None) if end is None else None
        if html:
            end = i + 1
            if html[1] is None:
                while end < len(lines) and _bare(text, lines[end]).strip():
                    end += 1
            elif not html[1].search(line):
                while end < len(lines) and not html[1].search(_bare(text, lines[end])):
                    end += 1
                end = min(end + 1, len(lines))
        if end is not None:
            scan.masks.append((begin, lines[end - 1][1], True))
            scan.rendered.append(begin)
            i = end
        elif _RULE.match(line):
            scan.rendered.append(begin)
            i += 1
        elif _HEADING.match(line):
            at = begin + _HEADING.match(line).end()
            scan.running.append([(at, lines[i][1])])
            scan.rendered.append(at)
            i += 1
        elif _QUOTE.match(line) and depth < DEEPEST:
            i = _quote(scan, lines, i, depth)
        elif _ITEM.match(line) and depth < DEEPEST:
            following = following or _next_content(text, lines)
            i = _item(scan, lines, i, depth, following)
        else:
            i = _paragraph(scan, lines, i)


def _metadata(text: str, lines: list, i: int, line: str) -> int | None:
    """The line after a metadata block that starts here."""
    mark = line.rstrip()
    if mark not in ("---", "+++") or i + 1 >= len(lines) or not _bare(text, lines[i + 1]).strip():
        return None
    closing = ("---", "...") if mark == "---" else ("+++",)
    return next((j + 1 for j in range(i + 1, len(lines)) if _bare(text, lines[j]).rstrip() in closing), None)


def _quote(scan: _Scan, lines: list, i: int, depth: int) -> int:
    inner, lazy = [], False
    while i < len(lines):
        line = _bare(scan.text, lines[i])
        mark = _QUOTE.match(line)
        if mark:
            inner.append((lines[i][0] + mark.end(), lines[i][1]))
            rest = line[mark.end() :]
            lazy = bool(rest.strip()) and not (_starts_block(rest) or _INDENT.match(rest)) or bool(_QUOTE.match(rest))
        elif lazy and line.strip() and not _starts_block(line):
            inner.append(lines[i])
        else:
            break
        i += 1
    _blocks(scan, inner, depth + 1)
    return i


def _next_content(text: str, lines: list) -> list[int | None]:
    out, at = [None] * len(lines), None
    for k in range(len(lines) - 1, -1, -1):
        at = k if _bare(text, lines[k]).strip() else at
        out[k] = at
    return out


def _item(scan: _Scan, lines: list, i: int, depth: int, next_content: list[int | None]) -> int:
    line = _bare(scan.text, lines[i])
    mark = _ITEM.match(line)
    rest = line[mark.end() :]
    spaces = len(rest) - len(rest.lstrip(" "))
    width = mark.end() + (spaces if rest.strip() and spaces < 4 else 0)
    inner, fenced = [(lines[i][0] + min(width, len(line)), lines[i][1])], None
    lazy = bool(rest.strip()) and not _starts_block(rest.lstrip())
    i += 1
    while i < len(lines):
        line = _bare(scan.text, lines[i])
        indent = len(line) - len(line.lstrip(" "))
        if not line.strip():
            following = next_content[i]
            if following is None or len(_bare(scan.text, lines[following])) - len(_bare(scan.text, lines[following]).lstrip(" ")) < width:
                break
            inner.append(lines[i])
            lazy = False
        elif indent >= width:
            inner.append((lines[i][0] + width, lines[i][1]))
            own = line[width:]
            fenced = None if fenced and _FENCE.match(own) else (fenced or _FENCE.match(own))
            lazy = not fenced and not _starts_block(own)
        elif lazy and not _starts_block(line) and not _ITEM.match(line):
            inner.append(lines[i])
        else:
            break
        i += 1
    _blocks(scan, inner, depth + 1)
    return i


def _paragraph(scan: _Scan, lines: list, i: int) -> int:
    first, text = i, scan.text
    i += 1
    while i < len(lines):
        line = _bare(text, lines[i])
        if not line.strip() or (_starts_block(line) and not re.match(r" {0,3}-+[ \t]*$", line)):
            break
        i += 1
        if re.match(r" {0,3}(?:=+|-+)[ \t]*$", line):
            break
    own = lines[first:i]
    whole, places = _joined(text, own)
    at = 0
    while m := _DEFINITION.match(whole, _BLANKS.match(whole, at).end()):
        if not m[1].strip():
            break
        scan.names.add(_name(m[1]))
        scan.masks.append((places[m.start()], places[m.end() - 1] + 1, True))
        line = text.rfind("\n", 0, places[m.start()]) + 1
        line = max(line, text.rfind("\r", 0, places[m.start()]) + 1)
        if re.fullmatch(" {0,3}", text[line : places[m.start()]]):
            scan.defined.append(places[m.start()] - (places[m.start()] - line))
        at = m.end()
    if at < len(whole):
        rest = [(max(s, places[at]), e) for s, e in own if e > places[at]]
        scan.running.append(rest)
        scan.rendered.append(places[at] + len(whole[at:]) - len(whole[at:].lstrip()))
    return i


def _joined(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[int]]:
    return "".join(text[s:e] for s, e in spans), [k for s, e in spans for k in range(s, e)]


def _destination(text: str, at: int) -> int | None:
    """The place after the closing mark of "(destination title)", which starts at ``at``."""
    space = re.compile(r"[ \t\r\n]*")
    i = space.match(text, at + 1).end()
    if text[i : i + 1] == "<":
        m = re.compile(r"<(?:[^<>\r\n\\]|\\.)*>").match(text, i)
        if not m:
            return None
        i = m.end()
    else:
        depth = 0
        while i < len(text) and text[i] > " " and text[i] != "\x7f":
            if text[i] == "\\" and i + 1 < len(text) and not text[i + 1].isalnum():
                i += 1
            elif text[i] == "(":
                depth += 1
                if depth > DEEPEST_DESTINATION:
                    return None
            elif text[i] == ")":
                if not depth:
                    break
                depth -= 1
            i += 1
        if depth:
            return None
    j = space.match(text, i).end()
    title = re.compile(_TITLE, re.S).match(text, j) if j > i else None
    if title:
        j = space.match(text, title.end()).end()
    return j + 1 if text[j : j + 1] == ")" else None


def _inline(scan: _Scan, spans: list[tuple[int, int]]) -> None:
    text, places = _joined(scan.text, spans)
    found: list[tuple[int, int]] = []
    brackets: list[tuple[int, bool]] = []  # place, image
    spent = 0  # brackets of the stack, from below, that a link stands in: none of them opens another, images apart
    last = {mark: text.rfind(mark) for mark in [*_CLOSING.values(), ">"]}
    ticks: dict[int, list[int]] = {}
    for m in re.finditer("`+", text):
        ticks.setdefault(len(m[0]), []).append(m.start())
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            size = len(re.compile("`+").match(text, i)[0])
            same = ticks.get(size, [])
            k = bisect_left(same, i + size)
            if k < len(same):
                found.append((i, same[k] + size))
                i = same[k] + size
            else:
                i += size
        elif c == "<":
            m = _AUTOLINK.match(text, i) if last[">"] > i else None
            if not m and last[">"] > i and all(last[end] > i for mark, end in _CLOSING.items() if text.startswith(mark, i)):
                m = _INLINE_HTML.match(text, i)
            if m:
                found.append(m.span())
            i = m.end() if m else i + 1
        elif c == "!" and text[i + 1 : i + 2] == "[":
            brackets.append((i + 1, True))
            i += 2
        elif c == "[":
            brackets.append((i, False))
            i += 1
        elif c == "]" and brackets:
            start, image = brackets.pop()
            end = _link(scan, text, start, i, found) if image or len(brackets) >= spent else None
            spent = len(brackets) if end is not None and not image else min(spent, len(brackets))
            i = end or i + 1
        else:
            i += 1
    scan.masks += [(places[s], places[e - 1] + 1, False) for s, e in found]


def _link(scan: _Scan, text: str, start: int, close: int, found: list) -> int | None:
    """The end of the link whose label is text[start : close + 1]; its hidden part goes to ``found``."""
    after = close + 1
    if text[after : after + 1] == "(" and (end := _destination(text, after)):
        found.append((after, end))
        return end
    named = _LABEL.match(text, after)
    if named:
        if _name(named[1]) in scan.names:
            found.append(named.span())
            return named.end()
        return None
    if close - start > LABEL + 1 or _name(text[start + 1 : close]) not in scan.names:
        return None
    if text[after : after + 2] == "[]":
        found.append((after, after + 2))
        return after + 2
    return after


def found(text: str) -> list[tuple[int, int, bool]]:
    """Ranges (characters) that aren't prose, and whether they part what stands around them; they may overlap and touch."""
    scan = _Scan(text)
    lines = [m.span() for m in _LINE.finditer(text) if m.end() > m.start()]
    _blocks(scan, lines)
    for spans in scan.running:
        _inline(scan, spans)
    rendered = sorted(scan.rendered)
    for at in scan.defined:  # what renders nothing up to the next rendered place goes with a definition
        k = bisect_right(rendered, at)
        scan.masks.append((at, rendered[k] if k < len(rendered) else len(text), True))
    return [m for m in scan.masks if m[0] < m[1]]


def excluded(text: str) -> list[tuple[int, int, bool]]:
    """``found`` in order, what overlaps or touches merged."""
    merged: list[list] = []
    for s, e, parts in sorted(found(text)):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
            merged[-1][2] |= parts
        else:
            merged.append([s, e, parts])
    return [tuple(m) for m in merged]


def _blank(text: str, parts: bool) -> str:
    dot = next((i for i, c in enumerate(text) if c not in "\r\n" and c < "\x80"), None) if parts else None
    wide = lambda c: " " if c < "\x80" else " " if c < "ࠀ" else "　" if c < "\U00010000" else "  "
    return "".join(c if c in "\r\n" else "." if i == dot else wide(c) for i, c in enumerate(text))


def mask(text: str) -> str:
    """``text`` with everything that isn't prose blanked; the same object where there is nothing."""
    ranges = excluded(text)
    if not ranges:
        return text
    out, at = [], 0
    for s, e, parts in ranges:
        out += [text[at:s], _blank(text[s:e], parts)]
        at = e
    return "".join([*out, text[at:]])
