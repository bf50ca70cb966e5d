"""A Markdown scanner: headings, list items, links, tables and comments of a text, with their offsets.

Code and comments are blanked, length and line ends kept, so that nothing in
them is structure.  When in doubt a construct is left as prose.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache


@dataclass(slots=True)
class Line:
    start: int
    end: int  # without the terminator
    text: str  # as masked


@dataclass(slots=True)
class Heading:
    level: int
    text: str
    start: int
    end: int
    slug: str
    anchor: str


@dataclass(slots=True)
class ListItem:
    start: int
    end: int
    text_start: int
    indent: int
    depth: int
    checkbox: str | None
    checkbox_start: int | None
    first_line: str
    body: str
    masked: str


@dataclass(slots=True)
class Link:
    form: str
    target: str
    start: int
    end: int
    target_start: int
    raw: str


@dataclass(slots=True)
class Cell:
    text: str
    start: int
    end: int


@dataclass(slots=True)
class Table:
    start: int
    headers: list[Cell]
    rows: list[list[Cell]]


@dataclass(slots=True)
class Comment:
    inner: str
    start: int
    end: int


@dataclass
class FrontMatter:
    entries: dict[str, list[str]] = field(default_factory=dict)
    places: dict[str, tuple[int, int]] = field(default_factory=dict)
    problems: list[tuple[str, int]] = field(default_factory=list)
    body_start: int = 0


class Scan:
    """What is in a text.  Each kind of block is searched for when it is first asked for, so that a reader of one pays for no other."""

    def __init__(self, text: str):
        self.text = text
        self._ends = _terminated(text)
        self._starts = [a for a, _ in self._ends]
        self._plain = text.isascii()

    @cached_property
    def front(self) -> FrontMatter:
        return read_front_matter(self.text, self._ends)

    @cached_property
    def _masked(self) -> tuple[str, list[Comment]]:
        return _mask(self.text, self.front.body_start, self._ends)

    @property
    def masked(self) -> str:
        return self._masked[0]

    @property
    def comments(self) -> list[Comment]:
        return self._masked[1]

    @cached_property
    def lines(self) -> list[Line]:
        masked = self.masked
        return [Line(a, b, masked[a:b]) for a, b in self._ends]

    @cached_property
    def _headed(self) -> tuple[list[Heading], set[int]]:
        return _headings(self.lines, self.text)

    @property
    def headings(self) -> list[Heading]:
        return self._headed[0]

    @cached_property
    def items(self) -> list[ListItem]:
        return _items(self.lines, self.text, self._headed[1])

    @cached_property
    def links(self) -> list[Link]:
        return _links(self.masked, self.text)

    @cached_property
    def tables(self) -> list[Table]:
        return _tables(self.lines, self.text)

    def place(self, offset: int) -> tuple[int, int]:
        """Line and column from 1; columns count UTF-16 units."""
        k = bisect.bisect_right(self._starts, offset) - 1
        if self._plain:
            return k + 1, 1 + offset - self._starts[k]
        before = self.text[self._starts[k] : offset]
        return k + 1, 1 + len(before) + sum(c > "\uffff" for c in before)

    @cached_property
    def _sections(self) -> tuple[list[int], list[list[str]]]:
        starts, open_, stack = [], [[]], []
        for h in self.headings:
            while stack and stack[-1].level >= h.level:
                stack.pop()
            stack.append(h)
            starts.append(h.start)
            open_.append([x.text for x in stack])
        return starts, open_

    def section(self, offset: int) -> list[str]:
        """The open headings at an offset, outermost first."""
        starts, open_ = self._sections
        return open_[bisect.bisect_right(starts, offset)]


_NO_SLUG, _SPACE, _RUN = re.compile(r"[^\w\s-]"), re.compile(r"\s"), re.compile(r"[^\n\r]+")


@lru_cache(4096)
def slugify(text: str) -> str:
    return _SPACE.sub("-", _NO_SLUG.sub("", text.lower()).strip())


def blank(text: str) -> str:
    return _RUN.sub(lambda m: " " * (m.end() - m.start()), text)


def blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with ``spans``, which are in order and don't overlap, blanked."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], blank(text[a:b])]
        at = b
    return "".join([*out, text[at:]])


_FENCE = re.compile(r"^[ \t>]*(?:[-*+] +|\d{1,9}[.)] +)?(`{3,}|~{3,})(.*)$")
_FENCE_END = re.compile(r"^[ \t>]*(`{3,}|~{3,})[ \t]*$")
_RAW = re.compile(r"<(pre|script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BULLET = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])\s")
_CODE = re.compile(r"[`<](?:(?<=`)`*|(?<=<)!--)")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_END = re.compile(r"\r\n|\n|\r")


def _terminated(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    if "\r" not in text:
        for line in text.split("\n"):
            out.append((at, at + len(line)))
            at += len(line) + 1
        return out
    for m in _END.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def _mask(text: str, begin: int, ends: list[tuple[int, int]]) -> tuple[str, list[Comment]]:
    """The text with code and comments blanked, and the comments."""
    spans = [(0, begin)] if begin else []
    fence, open_at, blank_before = None, 0, True
    in_comment = False
    for a, b in ends:
        if b < begin:
            continue
        line = text[a:b]
        if fence is None and not in_comment:
            m = _FENCE.match(line) if "```" in line or "~~~" in line else None
            if m and not (m.group(1)[0] == "`" and "`" in m.group(2)):
                fence, open_at = m.group(1), a
                continue
            empty = not line or line.isspace()
            if blank_before and not empty and line.startswith(("    ", "\t")) and not _BULLET.match(line):
                spans.append((a, b))
                continue
            blank_before = empty
            in_comment = "<!--" in line and line.rfind("<!--") > line.rfind("-->") and line.lstrip().startswith("<!--")
        elif fence is not None:
            m = _FENCE_END.match(line) if fence in line else None
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
                spans.append((open_at, b))
                fence, blank_before = None, True
        else:
            in_comment = "-->" not in line
    if fence is not None:
        spans.append((open_at, len(text)))
    masked = blanked(text, spans)
    if "<" in masked:
        masked = blanked(masked, [m.span() for m in _RAW.finditer(masked)])
    spans, comments, at = [], [], begin
    # Code spans and comments, from left to right.
    for m in _CODE.finditer(masked):
        if m.start() < at:
            continue
        if m.group() == "<!--":
            end = masked.find("-->", m.end())
            line_start = masked.rfind("\n", 0, m.start()) + 1
            if end < 0 and masked[line_start : m.start()].strip():
                continue  # unclosed within a line: prose
            stop = len(text) if end < 0 else end + 3
            comments.append(Comment(text[m.end() : len(text) if end < 0 else end], m.start(), stop)) if end >= 0 else None
        else:
            close = re.compile(rf"(?<!`){m.group()}(?!`)").search(masked, m.end())
            para = _PARAGRAPH.search(masked, m.end())
            if not close or (para and para.start() < close.start()):
                at = m.end()
                continue
            stop = close.end()
        spans.append((m.start(), stop))
        at = stop
    return blanked(masked, spans), comments


_KEY_ITEM = re.compile(r"^\s*-\s+(.*?)\s*$")
_KEY_PAIR = re.compile(r"^(\s*)([A-Za-z0-9_][A-Za-z0-9_ .-]*?)\s*:(?:\s+(.*?))?\s*$")


def read_front_matter(text: str, lines: list[tuple[int, int]] | None = None) -> FrontMatter:
    """Between two lines of exactly ``---``: scalars, quoted text, inline and block lists, one nested level; anything richer is a problem."""
    out = FrontMatter()
    lines = _terminated(text) if lines is None else lines
    if not text.startswith("---") or text[slice(*lines[0])].rstrip() != "---":
        return out
    end = next((k for k in range(1, len(lines)) if text.startswith("---", lines[k][0]) and text[slice(*lines[k])].rstrip() == "---"), None)
    if end is None:
        out.problems.append(("front matter is never closed", 0))
        return out
    out.body_start = lines[end + 1][0] if end + 1 < len(lines) else len(text)
    key, parent = None, None

    def put(name: str, values: list[str], a: int, b: int) -> None:
        out.entries[name], out.places[name] = values, (a, b)

    for a, b in lines[1:end]:
        line = text[a:b]
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = _KEY_ITEM.match(line)
        pair = _KEY_PAIR.match(line)
        if item and key:
            value = _scalar(item.group(1))
            if value is None:
                out.problems.append((f'the value of "{key}" is not read', a))
                continue
            put(key, [*out.entries.get(key, []), value], out.places.get(key, (a, b))[0], b)
        elif pair:
            name = pair.group(2).lower()
            if pair.group(1):
                if parent is None:
                    out.problems.append((f'"{name}" is indented below no key', a))
                    continue
                name = f"{parent}.{name}"
            raw = pair.group(3) or ""
            key = name
            if not pair.group(1):
                parent = name if not raw else None
            at = a + line.index(":") + 1
            at += len(text[at:b]) - len(text[at:b].lstrip())
            if not raw or raw.startswith("#"):
                put(name, [], at, b)
            elif raw.startswith("[") and raw.endswith("]"):
                put(name, [v for v in (_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", raw)) if v], at, b)
            else:
                value = _scalar(raw)
                if value is None:
                    out.problems.append((f'the value of "{name}" is not read', at))
                else:
                    put(name, [value], at, b)
        else:
            out.problems.append(("a line of the front matter is not read", a))
    out.entries = {k: v for k, v in out.entries.items() if v or not any(o.startswith(f"{k}.") for o in out.entries)}
    return out


_QUOTED, _REMARK, _NESTED = re.compile(r"^(['\"])(.*)\1\s*(?:#.*)?$"), re.compile(r"\s+#.*$"), re.compile(r":(?:\s|$)")


def _scalar(raw: str) -> str | None:
    raw = raw.strip()
    if raw[:1] in ("'", '"'):
        m = _QUOTED.match(raw)
        return m.group(2) if m else None
    if raw[:1] in ("|", ">", "&", "*", "!", "{", "["):
        return None
    plain = _REMARK.sub("", raw).strip() if "#" in raw else raw
    return None if ":" in plain and _NESTED.search(plain) else plain  # a key within the value: a mapping, which isn't read


_ITEM = re.compile(r"^([ \t>]*)(?:[-*+]|\d{1,9}[.)])[ \t]+(?:\[(.)\](?=[ \t]|$)[ \t]*)?")
_RULE = re.compile(r"\s*([-*_])(?:\s*\1){2,}\s*")


def _items(lines: list[Line], text: str, opens: set[int]) -> list[ListItem]:
    out: list[ListItem] = []
    open_: list[tuple[int, int]] = []  # (indent, index in out)
    marks = [_ITEM.match(line.text) for line in lines]
    for k, line in enumerate(lines):
        m = marks[k]
        if not m or k in opens or _RULE.fullmatch(line.text):
            continue
        indent = len(m.group(1).expandtabs(4))
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        last = k
        for j in range(k + 1, len(lines)):
            if j in opens or marks[j]:
                break
            if not text[lines[j].start : lines[j].end].strip():
                body = ""
                for n in range(j + 1, len(lines)):
                    body = text[lines[n].start : lines[n].end]
                    if body.strip():
                        break
                else:
                    body = ""
                if len(body) - len(body.lstrip()) <= indent:
                    break
                continue
            last = j
        box = m.group(2)
        begin = line.start + m.end()
        end = lines[last].end
        box_at = line.start + line.text.index("[", len(m.group(1))) if box is not None else None
        masked = line.text[m.end() :] if last == k else "\n".join([line.text[m.end() :], *[x.text for x in lines[k + 1 : last + 1]]])
        out.append(ListItem(line.start + len(m.group(1)), end, begin, indent, len(open_), box if box is None else text[box_at + 1], box_at, text[begin : line.end].strip(), text[begin:end], masked))
        open_.append((indent, len(out) - 1))
    return out


_LINK = re.compile(
    r"(?P<image>!?)\[\[(?P<wiki>[^\[\]\n]+)\]\]"
    r"|(?P<mark>!?)\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\](?:\((?P<inline>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*|<[^<>\n]*>)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*\)|\[(?P<ref>[^\[\]\n]*)\])?"
    r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]*:[^<>\s]*)>"
)
_LINK_BEGIN = re.compile(r"[!\[<]")
_DEFINITION = re.compile(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]*(<[^<>\n]*>|\S+)", re.M)


def _links(masked: str, text: str) -> list[Link]:
    """Links that cite, in order; images are none, embeds of wiki links are."""
    defined, definition_spans = {}, []
    if "]:" in masked:
        for m in _DEFINITION.finditer(masked):
            defined.setdefault(m.group(1).strip().lower(), (m.group(2).strip("<>"), m.start(2)))
            definition_spans.append(m.span())
    out = []
    at = 0
    while begin := _LINK_BEGIN.search(masked, at):
        m = _LINK.match(masked, begin.start())
        if not m:
            at = begin.start() + 1
            continue
        at = m.end()
        if definition_spans and any(a <= m.start() < b for a, b in definition_spans):
            continue
        raw = text[m.start() : m.end()]
        if m.group("wiki") is not None:
            name = m.group("wiki").split("|")[0]
            out.append(Link("wiki", name.strip(), m.start(), m.end(), m.start("wiki"), raw))
        elif m.group("auto"):
            out.append(Link("autolink", m.group("auto"), m.start(), m.end(), m.start("auto"), raw))
        elif m.group("inline") is not None:
            if not m.group("mark"):
                out.append(Link("inline", m.group("inline").strip("<>"), m.start(), m.end(), m.start("inline"), raw))
        else:
            key = (m.group("ref") or m.group("label") or "").strip().lower()
            if key in defined and not m.group("mark"):
                out.append(Link("reference", defined[key][0], m.start(), m.end(), defined[key][1], raw))
            elif m.group("ref") is None:
                at = m.start() + 1 + len(m.group("mark"))  # a bracket of prose may hold a link
    return out


_BAR = re.compile(r"\|(?<!\\\|)")
_DASHES = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*")


def _cells(line: Line, text: str) -> list[Cell]:
    raw = text[line.start : line.end]
    cuts = [m.start() for m in _BAR.finditer(line.text)]
    lead = not line.text[: cuts[0]].strip() if cuts else False
    edges = cuts if lead else [-1, *cuts]
    if edges and line.text[edges[-1] + 1 :].strip():
        edges = [*edges, len(raw)]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        cell = raw[a + 1 : b]
        begin = a + 1 + len(cell) - len(cell.lstrip())
        out.append(Cell(cell.strip(), line.start + begin, line.start + begin + len(cell.strip())))
    return out


def _tables(lines: list[Line], text: str) -> list[Table]:
    out, k = [], 1
    while k < len(lines):
        dashes = lines[k].text
        if "-" in dashes and not dashes.strip(" \t|:-") and ("|" in dashes or "|" in lines[k - 1].text) and _DASHES.fullmatch(dashes):
            head = _cells(lines[k - 1], text)
            if head and len(head) == len(_cells(lines[k], text)):
                rows, j = [], k + 1
                while j < len(lines) and "|" in lines[j].text:
                    rows.append(_cells(lines[j], text))
                    j += 1
                out.append(Table(lines[k - 1].start, head, rows))
                k = j
        k += 1
    return out


_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_HEADING_TEXT = re.compile(r"^ {0,3}#{1,6}[ \t]*(.*?)(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*")
_REMARKS = re.compile(r"<!--.*?-->")


def _headings(lines: list[Line], text: str) -> tuple[list[Heading], set[int]]:
    """Headings in order, and the lines that they take."""
    headings, opens, seen = [], set(), {}

    def heading(level: int, a: int, b: int, label: str, k: int) -> None:
        slug = slugify(label)
        n = seen.get(slug, 0)
        seen[slug] = n + 1
        headings.append(Heading(level, label, a, b, slug, f"{slug}-{n}" if n else slug))
        opens.add(k)

    for k, line in enumerate(lines):
        first = line.text.lstrip(" ")[:1]
        if first == "#" and (m := _HEADING.match(line.text)):
            raw = _HEADING_TEXT.match(text[line.start : line.end])
            heading(len(m.group(1)), line.start, line.end, _REMARKS.sub("", raw.group(1) if raw else m.group(2) or "").strip(), k)
        elif first in ("=", "-") and k and _UNDERLINE.fullmatch(line.text) and lines[k - 1].text.strip() and k - 1 not in opens and not _ITEM.match(lines[k - 1].text) and "|" not in lines[k - 1].text:
            above = lines[k - 1]
            heading(1 if "=" in line.text else 2, above.start, line.end, text[above.start : above.end].strip(), k - 1)
            opens.add(k)
    headings.sort(key=lambda h: h.start)
    return headings, opens


def scan(text: str) -> Scan:
    return Scan(text)
