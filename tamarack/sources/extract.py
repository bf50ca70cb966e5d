"""From Markdown files to rows: documents, items and reference candidates.

``extract`` reads one file; ``extracted`` applies it to a table of sources, a
batch at a time, and gives one nested row a specification, which
``tamarack.plans.corpus`` takes apart into tables.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tamarack.sources import words as W
from tamarack.sources.markdown import Cell, ListItem, Scan, Table, blanked, scan, slugify
from tamarack.vocab import EDGE_KINDS, FAMILY_DIRECTORIES, ID_KEYS, OPENNESS, PHASE_WORDS, RETIRING_DIRECTORIES, STATUS_HEADINGS, STATUS_KEYS

# Names


_REF_ENDS, _REF_GAPS, _REF_BEGIN = re.compile(r"^[#<(\[]+|[)\]>.,;:]+$"), re.compile(r"[\s._-]+"), re.compile(r"^[#(\[]+")


def normalise_ref(value: str) -> str:
    if value.isalnum():
        return value.lower()
    return _REF_GAPS.sub("", _REF_ENDS.sub("", value.strip().lower()))


_PREFIXED = re.compile(r"([A-Za-z][A-Za-z0-9_]{0,15}?)[\s._-]*([0-9]{1,6})\Z")


def prefixed(value: str) -> tuple[str, str] | None:
    m = _PREFIXED.match(_REF_BEGIN.sub("", value.strip()))
    return (m.group(1).upper(), m.group(2)) if m else None


def stem_of(path: str) -> str:
    folder, _, base = path.rpartition("/")
    stem = base.rpartition(".")[0] or base
    return folder.rpartition("/")[2] if folder and stem.lower() in ("readme", "index") else stem


def family_of(path: str) -> str | None:
    return next((FAMILY_DIRECTORIES[s] for s in reversed(path.lower().split("/")[:-1]) if s in FAMILY_DIRECTORIES), None)


_WORD, _SUFFIX, _NUMBER = re.compile(r"[^\W_]"), re.compile(r"\.[^./]*\Z"), re.compile(r"#?[0-9]{1,6}")
_STEM_NUMBER = re.compile(r"([A-Za-z]{1,15}[\s._-]?[0-9]{1,6}|[0-9]{1,6})(?=[\s._-]|\Z)")
_TITLE_NUMBER = re.compile(r"\s*([A-Za-z]{1,15}[\s._-]?[0-9]{1,6})\b")


def identify(path: str, declared: str | None, aliases: list[str], heading: str | None, owns_file: bool = True) -> dict:
    """``id, family, number, aliases``: the first name with a number wins, of the declared one, the file's and the heading's."""
    if declared is not None and not _WORD.search(declared):
        declared = None
    stem, family = stem_of(path), family_of(path)
    token = _STEM_NUMBER.match(stem)
    title = _TITLE_NUMBER.match(heading or "")
    names = [(declared, True)] + ([(token.group(1) if token else stem, True), (title and title.group(1), False)] if owns_file else [])
    numbered = None
    for name, bare in names:
        if not name:
            continue
        m = prefixed(name)
        if m is None and bare and _NUMBER.fullmatch(name.strip()):
            m = (family, name.strip().lstrip("#"))
        if m:
            numbered = m
            break
    own_family = (numbered[0] if numbered else None) or family
    digits = numbered[1] if numbered else None
    fallback = (declared or "").strip() or stem or path
    ident = f"{own_family}-{digits}" if digits and own_family else fallback
    spelled = [ident] + ([stem, path, _SUFFIX.sub("", path)] if owns_file else []) + [declared or "", *aliases]
    if digits:
        n = str(int(digits))
        spelled += [f"{own_family}-{d}" if own_family else d for d in (digits, n, n.zfill(3), n.zfill(4))]
    return {"id": ident, "family": own_family, "number": int(digits) if digits else None, "aliases": list(dict.fromkeys(a for a in map(normalise_ref, spelled) if a))}


# Lifecycle


_TAG, _INNER_LINE, _MARKS, _INLINE = re.compile(r"<[^>]*>"), re.compile(r"(?<=[^\W_])_(?=[^\W_])"), re.compile(r"[`*_~\"'#]"), re.compile(r"\[([^\]]*)\]\([^)]*\)")
_DATE, _NO_WORDS = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), re.compile(r"[\W_]+")


def normalise_status(raw: str) -> str:
    raw = _INLINE.sub(r"\1", _MARKS.sub("", _INNER_LINE.sub(" ", _TAG.sub(" ", raw))))
    return _NO_WORDS.sub(" ", _DATE.sub(" ", raw).lower()).strip()


@lru_cache(4096)
def phase_of(raw: str | None) -> str:
    if raw is None:
        return "unknown"
    text = normalise_status(raw)
    words, joined = set(text.split()), text.replace(" ", "-")
    for phase, terms in PHASE_WORDS:
        if any(t in joined if "-" in t else t in words for t in terms):
            return phase
    return "unknown"


def phase_from_path(path: str) -> str:
    return "retired" if set(path.lower().split("/")[:-1]) & set(RETIRING_DIRECTORIES) else "unknown"


_EMPHASIS, _ENCLOSING = re.compile(r"[`*_]"), re.compile(r"[()<>\"'（）]")
_SUCCEEDED = re.compile(r"(?:super[sc]eded|replaced|obsoleted)\s*(?:by|with|through)?\s*[:\-–—]?\s*(.+)", re.I)
_LISTED = re.compile(r"[,;、，；]|\band\b")


def successors(status: str) -> list[str]:
    m = _SUCCEEDED.search(_EMPHASIS.sub("", status))
    parts = _LISTED.split(m.group(1)) if m else []
    clean = [_ENCLOSING.sub(" ", _INLINE.sub(r"\1", p)).strip() for p in parts]
    return [c for c in clean if 0 < len(c) < 200]


# Directives


_DIRECTIVE = re.compile(r"\s*@([a-z-]+)\b")


def directives(s: Scan) -> list[dict]:
    out = []
    for c in s.comments:
        m = _DIRECTIVE.match(c.inner)
        if not m or m.group(1) not in W.DIRECTIVES:
            continue
        attrs = {}
        for a in re.finditer(r"([A-Za-z][A-Za-z0-9_-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?", c.inner[m.end() :]):
            group = next((g for g in (2, 3, 4) if a.group(g) is not None), None)
            at = c.start + 4 + m.end() + (a.start(group) if group else a.end())
            attrs[a.group(1).lower()] = ((a.group(group) if group else "true").strip(), at)
        out.append({"name": m.group(1), "attrs": attrs, "start": c.start, "end": c.end})
    return out


def attr(d: dict | None, name: str) -> str | None:
    return d["attrs"][name][0] or None if d and name in d["attrs"] else None


# Items


@lru_cache(4096)
def folded_heading(text: str) -> str:
    text = re.sub(r"[`*_~]|^[\d.]+\s+", "", text.lower()).strip(" :.?!")
    return re.sub(r"\s+", " ", re.sub(r"^[^\w]+|[^\w]+$", "", text))


_GAP = re.compile(r"\s+")


def summarise(text: str) -> str:
    text = _GAP.sub(" ", _INLINE.sub(r"\1", text) if "](" in text else text).strip()
    return text if len(text) <= 120 else text[:117] + "..."


_PHRASES = {re.sub(r"[ -]", " ", p): d for d, ps in W.MARKERS.items() for p in ps}
_MARKER = re.compile(
    r"(?:[ \t>]|(?:[-*+]|[0-9]{1,9}[.)])[ \t]+)*(?P<open>\*{1,2}|_{1,2})?\s*(?P<phrase>"
    + "|".join(re.escape(p).replace(r"\ ", "[ _-]").replace("'", "['’]") for p in sorted(_PHRASES, key=len, reverse=True))
    + r")(?!\w)(?P<close>\*{1,2}|_{1,2})?\s*(?:[(\[][^)\]\n]{0,60}[)\]])?\s*(?P<after>[:：.]|[-–—](?=\s)|\Z|\n)?",
    re.I,
)
_STATEMENT = re.compile(r"[\n.?!(\[](?:(?<=[\n(\[])|(?<=[.?!])\s+)")
_STRUCK = re.compile(r"~~(.+)~~[.!]?")


def markers(body: str) -> Iterator[tuple[str, str, int]]:
    """(disposition, phrase, offset) of phrases that begin a statement and are emphasised, punctuated or shouted."""
    begins = [0, *(m.end() for m in _STATEMENT.finditer(body))]
    last = 0
    for at in begins:
        m = _MARKER.match(body, at)
        if not m or m.start("phrase") < last:
            continue
        phrase = m.group("phrase")
        strong = m.group("open") and m.group("close") or (m.group("after") or "").strip() or (phrase.isupper())
        if strong:
            last = m.end("phrase")
            yield _PHRASES[re.sub(r"[ _-]", " ", phrase.lower().replace("’", "'"))], phrase, m.start("phrase")


def item_state(item: ListItem, directive: dict | None, section: list[str], in_section: bool) -> dict:
    """What became of an item: the strongest signal, the latest of equals; others that disagree are conflicts."""
    found = []  # (source, disposition, raw, offset)
    if directive and (state := attr(directive, "state")) and state.lower() in W.STATE_ALIASES:
        found.append(("directive", W.STATE_ALIASES[state.lower()], state, directive["attrs"]["state"][1]))
    found += [("marker", d, p, item.text_start + at) for d, p, at in markers(item.masked)]
    if m := _STRUCK.fullmatch(item.first_line.strip()):
        found.append(("strikethrough", "satisfied", m.group(1), item.text_start))
    if item.checkbox in W.CHECKBOXES:
        found.append(("checkbox", W.CHECKBOXES[item.checkbox], f"[{item.checkbox}]", item.checkbox_start))
    if in_section:
        found.append(("section", "unresolved", section[-1] if section else "", item.start))
    win = max(found or [("default", "unresolved", "", item.start)], key=lambda x: (W.SIGNAL_PRIORITY[x[0]], x[3]))
    against = [x for x in found if x[0] != "section" and OPENNESS[x[1]] != OPENNESS[win[1]]]
    return {"disposition": win[1], "openness": OPENNESS[win[1]], "evidence": win[0], "conflicts": [{"source": a, "disposition": b, "raw": c} for a, b, c, _ in against]}


# References

_VERB = {p: (kind, back) for kind, back, phrases in W.VERBS for p in phrases}
_VERB_RE = re.compile(r"(?<![\w-])(?:" + "|".join(re.escape(p) for p in sorted(_VERB, key=len, reverse=True)) + r")(?![\w-])")
_NO = re.compile(r"(?<![\w-])(?:" + "|".join(W.NEGATIONS) + r")(?![\w-])")
_NO_BEFORE = re.compile(r"(?:(?<![\w-])(?:" + "|".join((*W.NEGATIONS, "no one", "cannot")) + r"|[^\W\d_]+n['’]t))(?: (?:" + "|".join(W.BETWEEN_NEGATION_AND_VERB) + r"))*(?: |,.+,)$")
#: Patterns that are searched for begin with a set of characters where they can, as the matcher skips to one.
_BREAK = re.compile(r"[.?!;。？！；|\n](?:(?<=[.?!;])\s|(?<=[。？！；|])|(?<=\n)(?:\s*\n|\s*[-*+>#]))")


_STATEMENT_MARKS, _FOLLOWING_MARKS, _GAP_OR_COMMAS, _SEE = re.compile(r"[`*_~()\[\]]"), re.compile(r"[`*_~\"'()\[\],]"), re.compile(r"[\s,]+"), re.compile(r"(?<![\w-])see(?![\w-])")
_FOLLOWING_BREAK = re.compile(r"[.?!;\n|。？！；]")
_FOLLOWING_VERBS = [(kind, phrases) for kind, back, phrases in W.VERBS if not back and kind not in ("assumes", "depends-on")]


@lru_cache(16384)
def _governing(statement: str) -> tuple[str, bool] | None:
    """What the nearest phrase of a statement says of the citation that follows it."""
    statement = _STATEMENT_MARKS.sub(" ", statement)
    words = _GAP_OR_COMMAS.sub(" ", statement)
    commas = _GAP_OR_COMMAS.sub(lambda m: "," if "," in m.group() else " ", statement) if "," in statement else words
    best = None
    for m in _VERB_RE.finditer(words):
        rest = words[m.end() :]
        if len(rest) > W.VERB_WINDOW or _NO.search(rest) or _SEE.search(rest):
            continue
        best = None if _NO_BEFORE.search(commas[: m.start()]) else _VERB[m.group()]
    return best


@lru_cache(16384)
def _answering(after: str) -> str | None:
    """The relation that the words after a citation say that they have to it."""
    after = _GAP.sub(" ", _FOLLOWING_MARKS.sub(" ", after)).strip()
    return next((kind for kind, phrases in _FOLLOWING_VERBS if after.startswith(phrases)), None)


def classify(text: str, start: int, end: int, section: list[str]) -> tuple[str, bool]:
    """(relation, whether it points back) of a citation: what the nearest phrase before it says, unless it is denied; else what follows; else the section."""
    window = text[max(0, start - 160) : start]
    cut = 0
    for m in _BREAK.finditer(window):
        cut = m.end()
    if best := _governing(window[cut:].lower()):
        return best
    if kind := _answering(_FOLLOWING_BREAK.split(text[end : end + 80], maxsplit=1)[0].lower()):
        return kind, True
    weak = any(folded_heading(h) in W.WEAK_SECTIONS for h in section)
    return ("relates-to" if weak else "references"), False


_SCHEME, _DRIVE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:"), re.compile(r"[A-Za-z]:[\\/]")
_LINKED, _WIKI_ENDS = re.compile(r"\[[^\]]*\]\(([^)\s]*)"), re.compile(r"^\[\[|\]\]$")


def external(target: str) -> bool:
    return ":" in target and bool(_SCHEME.match(target)) and not _DRIVE.match(target)


def clean_target(value: str) -> str:
    m = _LINKED.search(value) if "](" in value else None
    return (m.group(1) if m else _WIKI_ENDS.sub("", value.strip())).strip("<> ").strip()


_BARE = re.compile(r"[A-Za-z](?<!\w[A-Za-z])[A-Za-z0-9]{0,14}[\s._-]?[0-9]{1,6}\b", re.A)


def bare_references(s: Scan) -> Iterator[tuple[str, int]]:
    text = blanked(s.masked, [(link.start, link.end) for link in s.links])
    for m in _BARE.finditer(text):
        family = (prefixed(m.group()) or ("",))[0].lower()
        if family in W.NOT_A_FAMILY or len(family) < 2 or text[m.start() - 1 : m.start()] in ("/", ".") and m.start() or text[m.end() : m.end() + 1] == "/":
            continue
        yield m.group(), m.start()


def edit_apart(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1]
    return a[i + (len(a) > len(b)) :] == b[i + (len(b) > len(a)) :]


_FOLDED = {re.sub(r"[^a-z0-9]", "", k): (k, *v) for k, v in W.RELATION_KEYS.items()}
_NO_KEY = re.compile(r"[^a-z0-9]")


@lru_cache(4096)
def nearest_key(folded: str) -> str | None:
    """The first relation key that is one edit from a folded key."""
    return next((k for f, (k, _, _) in _FOLDED.items() if edit_apart(folded, f)), None)


SPECIFICATION = (
    "id string, family string, number int, aliases array<string>, path string, title string, line int, column int, raw_status string, phase string, history boolean, status_line int, status_column int, "
    "fm map<string,array<string>>, region boolean, container string, anchors array<string>, "
    "items array<struct<id:string,title:string,line:int,column:int,declared:boolean,section:array<string>,text:string,body:string,disposition:string,openness:string,evidence:string,conflicts:array<struct<source:string,disposition:string,raw:string>>>>, "
    "refs array<struct<kind:string,from:string,target:string,origin:string,line:int,column:int,raw:string,inverted:boolean,opportunistic:boolean>>, "
    "problems array<struct<message:string,line:int>>, misread array<struct<key:string,suggestion:string,line:int,column:int>>, spec_ord int"
)


_HEADER_MARKS = re.compile(r"[*_`]")
_STATUS_MARKS = re.compile(r"[:*_`]")


def _register(table: Table) -> tuple[int, int | None, int | None, dict[int, tuple[str, bool]]] | None:
    """(id, status, title, relation columns) of a table that lists specifications."""
    names = [_HEADER_MARKS.sub("", h.text).strip().lower() for h in table.headers]
    find = lambda known: next((k for k, n in enumerate(names) if n in known), None)
    ids, status = find(W.ID_COLUMNS), find(W.STATUS_COLUMNS)
    relations = {k: W.RELATION_COLUMNS[n] for k, n in enumerate(names) if n in W.RELATION_COLUMNS and k != ids}
    title = next((k for k, n in enumerate(names) if n in W.TITLE_COLUMNS and k != ids), None)
    return (ids, status, title, relations) if ids is not None and (status is not None or relations) else None


def _status(s: Scan, fm: dict[str, list[str]], node: dict | None, within: tuple[int, int]) -> tuple[str | None, int | None]:
    if raw := attr(node, "status"):
        return raw, node["attrs"]["status"][1]
    for key in STATUS_KEYS:
        if key in fm and ", ".join(fm[key]).strip():
            return ", ".join(fm[key]), s.front.places[key][0]
    begin, end = within
    heading = next((h for h in s.headings if begin <= h.start < end and _STATUS_MARKS.sub("", h.text.lower()).strip() in STATUS_HEADINGS), None)
    if heading:
        for line in s.lines:
            if line.start <= heading.end or not line.text.strip():
                continue
            if any(h.start == line.start for h in s.headings):
                break
            m = re.match(r"\s*(?:[-*+]\s+)?", s.text[line.start : line.end])
            return s.text[line.start + m.end() : line.end].strip(), line.start + m.end()
    body = next((h.start for h in s.headings if h.level >= 2), len(s.text))
    for t in s.tables:
        if t.start < body and len(t.headers) == 2 and _register(t) is None:
            for cells in [t.headers, *t.rows]:
                if len(cells) > 1 and cells[1].text and re.sub(r"[*_]", "", cells[0].text).lower() in ("status", "state"):
                    return cells[1].text, cells[1].start
    return None, None


def _anchors(headings) -> list[str]:
    return list(dict.fromkeys(x for h in headings for x in (h.slug, h.anchor)))


#: A negation as the whole of a code span: it denies like one in the text.
_CODED_NO = re.compile(r"(?<!`)(`+) ?(no|not|no-one|nobody|none|never|neither|nor|nothing|without) ?\1(?!`)", re.I)


def with_coded_negations(masked: str, text: str) -> str:
    """``masked`` with the negations that ``text`` has in code spans."""
    out, last = [], 0
    for m in _CODED_NO.finditer(text) if "`" in text else ():
        out += [masked[last : m.start(2)], m.group(2)]
        last = m.end(2)
    return "".join([*out, masked[last:]])


#: What is read of each specification beyond itself.
PARTS = ("items", "refs", "misread")


def extract(path: str, text: str, parts: Collection[str] = PARTS) -> list[dict]:
    """A file's own specification, then its regions: headings with an id and a status, and rows of registers.

    Of items, references and misread keys only ``parts`` are looked for."""
    s = scan(text)
    told = directives(s)
    if any(d["name"] == "spec-ignore" for d in told):
        return []
    node = next((d for d in told if d["name"] == "spec-node"), None)
    fm = s.front.entries
    specs: list[dict] = []
    spans: list[tuple[int, int, dict]] = []  # of regions

    def spec(ident: dict, title: str, at: int, status: tuple[str | None, int | None], owns: bool, values: dict, container: str | None, record: bool) -> dict:
        raw, where = status
        said = phase_of(raw)
        phase = "record" if record else said if said != "unknown" else phase_from_path(path) if owns else "unknown"
        line, column = s.place(at)
        row = {**ident, "path": path, "title": title, "line": line, "column": column, "raw_status": raw, "phase": phase, "history": record, "status_line": None, "status_column": None, "fm": values, "region": not owns, "container": container, "anchors": [], "items": [], "refs": [], "problems": [], "misread": [], "spec_ord": len(specs), "_status_at": where}
        if where is not None:
            row["status_line"], row["status_column"] = s.place(where)
        specs.append(row)
        return row

    h1 = next((h for h in s.headings if h.level == 1), None)
    declared = attr(node, "id") or next((fm[k][0] for k in ID_KEYS if fm.get(k)), None)
    aliases = [*fm.get("alias", []), *fm.get("aliases", []), *(re.split(r"[,;\s]+", attr(node, "alias") or attr(node, "aliases") or "") if node else [])]
    title = attr(node, "title") or (fm.get("title") or [None])[0] or (h1.text if h1 else None) or stem_of(path)
    record = (attr(node, "kind") or "").lower() in ("log", "record", "history") or (attr(node, "history") or "").lower() == "true"
    own = spec(identify(path, declared, aliases, h1.text if h1 else None), title, h1.start if h1 else 0, _status(s, fm, node, (0, len(text))), True, fm, None, record)
    own["anchors"] = _anchors(s.headings)
    inherited = {k: v for k, v in fm.items() if k not in (*ID_KEYS, *STATUS_KEYS, "title", "alias", "aliases") and _NO_KEY.sub("", k) not in _FOLDED}
    claimed: list[tuple[int, int]] = []
    for k, h in enumerate(s.headings):
        m = _TITLE_NUMBER.match(h.text) if h.level > 1 else None
        if not m or (prefixed(m.group(1)) or ("NO",))[0].lower() in W.NOT_A_FAMILY:
            continue
        end = next((x.start for x in s.headings[k + 1 :] if x.level <= h.level), len(text))
        labelled = re.search(r"^\s*(?:[-*+]\s+)?(?:\*\*|__)?status(?:\*\*|__)?\s*:(?:\*\*|__)?\s*(.+?)\s*$", s.masked[h.end : end], re.I | re.M)
        sub = next((x for x in s.headings[k + 1 :] if x.start < end and _STATUS_MARKS.sub("", x.text.lower()).strip() in STATUS_HEADINGS), None)
        local = next((d for d in told if d["name"] == "spec-node" and d is not node and h.start <= d["start"] < end), None)
        if labelled:
            status = (s.text[h.end + labelled.start(1) : h.end + labelled.end(1)], h.end + labelled.start(1))
        elif sub or local:
            status = _status(s, {}, local, (sub.start if sub else end, end))
        else:
            continue
        ident = identify(path, attr(local, "id") or m.group(1), [], None, False)
        if ident["id"] != own["id"]:
            spans.append((h.start, end, spec(ident, re.sub(r"^[\s:.–—-]+", "", h.text[m.end() :]) or h.text, h.start, status, False, inherited, own["id"], False)))
            specs[-1]["anchors"] = _anchors(x for x in s.headings if h.start <= x.start < end)
    column_refs = []
    for t in s.tables:
        schema = _register(t)
        if not schema:
            continue
        ids, status_at, title_at, relations = schema
        for cells in t.rows:
            get = lambda k: cells[k] if k is not None and k < len(cells) else Cell("", t.start, t.start)  # noqa: E731, B023
            name = re.sub(r"[`*_]|!?\[([^\]]*)\]\([^)]*\)", r"\1", get(ids).text).strip()
            if not prefixed(name) and not _NUMBER.fullmatch(name):
                continue
            status = get(status_at)
            row = spec(identify(path, name, [], None, False), get(title_at).text or name, get(ids).start, (status.text or None, status.start if status.text else None), False, inherited, own["id"], False)
            spans.append((get(ids).start, cells[-1].end, row))
            for k, (kind, back) in relations.items():
                cell = get(k)
                claimed.append((cell.start, cell.end))
                if not cell.text or re.fullmatch(r"-+|—|–|n/?a|none|nil|tbd|\.|_+", cell.text, re.I):
                    continue
                if "refs" not in parts:
                    continue
                line, column = s.place(cell.start)
                for target in map(clean_target, re.split(r"[,;]|<br\s*/?>|\band\b", cell.text)):
                    if target:
                        column_refs.append((row, {"kind": kind, "from": row["id"], "target": target, "origin": "directive", "line": line, "column": column, "raw": cell.text, "inverted": back, "opportunistic": False}))

    def owner(at: int) -> dict:
        inside = [x for x in spans if x[0] <= at < x[1]]
        return max(inside, key=lambda x: x[0])[2] if inside else own

    # Items
    ordinals: dict[str, int] = {}
    held: list[tuple[int, int, str]] = []
    free = [d for d in told if d["name"] == "spec-item"]
    for item in s.items if "items" in parts or "refs" in parts else ():
        section = s.section(item.start)
        in_section = any(folded_heading(h) in W.OBLIGATION_SECTIONS for h in section)
        bound = next((d for d in free if item.start <= d["start"] < item.end or (d["end"] <= item.start and not s.text[d["end"] : item.start].strip(" \t\r\n>"))), None)
        if bound:
            free.remove(bound)
        if not (bound or item.checkbox is not None or (in_section and item.depth == 0)):
            continue
        doc = owner(item.start)
        slug = slugify(section[-1]) if section else "item"
        ordinals[f"{doc['id']}#{slug}"] = n = ordinals.get(f"{doc['id']}#{slug}", 0) + 1
        ident = f"{doc['id']}#{attr(bound, 'id') or f'{slug}.{n}'}"
        held.append((item.start, item.end, ident))
        if "items" not in parts:
            continue
        line, column = s.place(item.start)
        short = summarise(re.sub(r"<!--.*?-->", "", item.first_line) if "<!--" in item.first_line else item.first_line)
        doc["items"].append({"id": ident, "title": attr(bound, "title") or short, "line": line, "column": column, "declared": attr(bound, "id") is not None, "section": section, "text": short, "body": item.body, **item_state(item, bound, section, in_section)})

    def holder(at: int) -> str:
        inside = [x for x in held if x[0] <= at < x[1]]
        return max(inside)[2] if inside else owner(at)["id"]

    def cite(row: dict, at: int, **ref) -> None:
        line, column = s.place(at)
        row["refs"].append({**ref, "line": line, "column": column})

    # References
    for row, ref in column_refs:
        row["refs"].append(ref)
    for key, values in fm.items():
        folded = _NO_KEY.sub("", key)
        if folded in _FOLDED:
            _, kind, back = _FOLDED[folded]
            for v in values if "refs" in parts else ():
                if target := clean_target(v):
                    cite(own, s.front.places[key][0], kind=kind, **{"from": own["id"]}, target=target, origin="front-matter", raw=f"{key}: {v}", inverted=back, opportunistic=False)
        elif "misread" in parts and (near := nearest_key(folded)):
            if any(prefixed(v) or "/" in v or re.search(r"\.(?:md|markdown|mdx|txt|rst|adoc|asciidoc)$", v, re.I) for v in values):
                line, column = s.place(s.front.places[key][0])
                own["misread"].append({"key": key, "suggestion": near, "line": line, "column": column})
    if "refs" in parts:
        for row in specs:
            for target in successors(row["raw_status"] or ""):
                if target := clean_target(target):
                    cite(row, row["_status_at"], kind="supersedes", **{"from": row["id"]}, target=target, origin="front-matter", raw=row["raw_status"], inverted=True, opportunistic=True)
        for d in told:
            if d["name"] == "spec-edge" and (written := attr(d, "kind")):
                kind = written if written in EDGE_KINDS else "references"
                for name in ("to", "from"):
                    if target := attr(d, name):
                        cite(owner(d["start"]), d["attrs"][name][1], kind=kind, **{"from": holder(d["start"])}, target=target, origin="directive", raw=f'@spec-edge kind="{written}" {name}="{target}"', inverted=name == "from", opportunistic=False)
        linked = set()
        prose = with_coded_negations(s.masked, s.text)
        taken = lambda at: any(a <= at < b for a, b in claimed)
        for link in s.links:
            target = clean_target(link.target)
            if not target or external(target) or taken(link.start):
                continue
            kind, back = classify(prose, link.start, link.end, s.section(link.start))
            linked.add(normalise_ref(target.split("#")[0]))
            cite(owner(link.start), link.target_start, kind=kind, **{"from": holder(link.start)}, target=target, origin="link", raw=link.raw, inverted=back, opportunistic=False)
        for word, at in bare_references(s):
            if normalise_ref(word) not in linked and not taken(at):
                kind, back = classify(prose, at, at + len(word), s.section(at))
                cite(owner(at), at, kind=kind, **{"from": holder(at)}, target=word, origin="text", raw=word, inverted=back, opportunistic=True)
    own["problems"] = [{"message": m, "line": s.place(at)[0]} for m, at in s.front.problems] + ([{"message": "the file holds NUL characters", "line": 1}] if "\0" in text else [])
    for row in specs:
        del row["_status_at"]
    return specs


def extracted(sources: DataFrame, parts: Collection[str] = PARTS) -> DataFrame:
    """One row a specification of ``sources(path, text)``, with ``parts``; null texts count as empty."""
    arrow = to_arrow_schema(StructType.fromDDL(SPECIFICATION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [row for path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for row in extract(path, text or "", parts)]
                rows = [{**r, "fm": list(r["fm"].items())} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return sources.select("path", "text").mapInArrow(run, SPECIFICATION)
