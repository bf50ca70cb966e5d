"""Scalar functions over statuses, references and paths, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.vocab import DOCUMENT_EXTENSIONS, FAMILY_DIRECTORIES, PHASE_WORDS, RECEPTIVITY, RETIRING_DIRECTORIES, STATUS_HEADINGS

#: JavaScript's idea of white space, which Java's ``\s`` doesn't share.
SPACE_CODES = (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
SPACE_CLASS = "".join(f"\\x{{{code:X}}}" for code in SPACE_CODES)
SPACE = f"[{SPACE_CLASS}]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalise_status(c: Column) -> Column:
    """A status as words: without tags, emphasis, link targets, pictographs and dates."""
    for pattern, to in (
        (r"<[^>]*>", " "),
        (r"(?<=[\p{L}\p{N}])_(?=[\p{L}\p{N}])", " "),
        (r"[`*_~\"'#]", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\u2139", " "),  # the one pictograph that is a letter; the others fall below
        (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def once(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def phase_of(c: Column) -> Column:
    """The phase that a status names; ``unknown`` for null or no known word."""
    whole, hyphened, places = [], [], []
    for rank, (phase, terms) in enumerate(PHASE_WORDS):
        places.append(F.lit(phase))
        for t in terms:
            (hyphened if "-" in t else whole).append((t, rank))
    ranks = F.create_map(*[F.lit(x) for kv in whole for x in kv])
    parts = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(r).alias("rank")) for t, r in hyphened])

    def first(text: Column) -> Column:
        by_word = F.array_min(F.transform(F.split(text, " "), lambda w: ranks[w]))
        by_part = F.array_min(F.transform(parts, lambda p: F.when(F.contains(F.replace(text, F.lit(" "), F.lit("-")), p["term"]), p["rank"])))
        return F.get(F.array(*places), F.least(by_word, by_part))

    return F.coalesce(once(normalise_status(c), first), F.lit("unknown"))


def receptivity_of(phase: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RECEPTIVITY.items() for x in kv])[phase]


def is_retired(phase: Column) -> Column:
    return phase == "retired"


def is_status_heading(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.lower(c), "[:*_`]", "")).isin(*STATUS_HEADINGS)


def phase_from_path(path: Column) -> Column:
    """``retired`` if a directory of the path says so; the file's name doesn't count."""
    parts = F.split(F.lower(path), "/")
    directories = F.slice(parts, 1, F.size(parts) - 1)
    return F.when(F.arrays_overlap(directories, F.array(*map(F.lit, RETIRING_DIRECTORIES))), "retired").otherwise("unknown")


def supersession_targets(raw: Column) -> Column:
    """The successors that a status names, as an array."""
    pattern = r"(?is)(?:super[sc]eded|replaced|obsoleted)\s*(?:by|with|through)?\s*[:\-\u2013\u2014]?\s*([^\n\r]+)"
    tail = F.regexp_extract(F.regexp_replace(raw, "[`*_]", ""), pattern, 1)
    clean = lambda t: trimmed(F.regexp_replace(F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[()<>\"'\uFF08\uFF09]", " "))
    parts = F.transform(F.split(tail, r"[,;\u3001\uFF0C\uFF1B]|\band\b"), clean)
    return F.filter(parts, lambda t: (F.length(t) > 0) & (F.length(t) < 200))


def normalise_ref(c: Column) -> Column:
    """The form under which references are compared."""
    c = F.regexp_replace(F.lower(trimmed(c)), r"^[#<(\[]+|[)\]>.,;:]+$", "")
    return F.regexp_replace(c, f"[{SPACE_CLASS}._-]+", "")


def anchor_target(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def anchor_of(c: Column) -> Column:
    """What follows the first ``#``; null without one."""
    at = F.instr(c, "#")
    return F.when(at > 0, F.substr(c, at + 1))


PREFIXED = r"^([A-Za-z][A-Za-z0-9_]{0,15}?)[\s._-]*([0-9]{1,6})$"


def prefixed_family(c: Column) -> Column:
    """Family of ``ADR-12`` and the like, upper case; null for other text."""
    got = F.regexp_extract(F.regexp_replace(trimmed(c), r"^[#(\[]+", ""), PREFIXED, 1)
    return F.when(got != "", F.upper(got))


def prefixed_number(c: Column) -> Column:
    got = F.regexp_extract(F.regexp_replace(trimmed(c), r"^[#(\[]+", ""), PREFIXED, 2)
    return F.when(got != "", got.cast("int"))


def bare_number(c: Column) -> Column:
    got = F.regexp_extract(trimmed(c), r"^#?([0-9]{1,6})$", 1)
    return F.when(got != "", got.cast("int"))


def is_family_name(c: Column) -> Column:
    return F.coalesce(prefixed_family(F.concat(trimmed(c), F.lit("-0"))) == F.upper(trimmed(c)), F.lit(False))


_EXTENSION = rf"(?i)\.({'|'.join(DOCUMENT_EXTENSIONS)})$"


def looks_like_path(c: Column) -> Column:
    return F.contains(c, F.lit("/")) | c.rlike(_EXTENSION)


def looks_like_citation(c: Column) -> Column:
    return prefixed_family(c).isNotNull() | looks_like_path(c)


def is_document_target(c: Column) -> Column:
    """Whether a target could be a document: no extension, none that looks like one, or a document's."""
    base = F.substring_index(anchor_target(c), "/", -1)
    extension = F.regexp_extract(base, r"\.[^.]*$", 0)
    return F.when(extension == "", True).when(~extension.rlike(r"^\.[A-Za-z][A-Za-z0-9]*$"), True).otherwise(base.rlike(_EXTENSION))


def is_external(c: Column) -> Column:
    return c.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~c.rlike(r"(?i)^[a-z]:[\\/]")


def family_from_path(path: Column) -> Column:
    """Family of the nearest enclosing directory that has one."""
    parts = F.split(F.lower(path), "/")
    directories = F.reverse(F.slice(parts, 1, F.size(parts) - 1))
    names = F.create_map(*[F.lit(x) for kv in FAMILY_DIRECTORIES.items() for x in kv])
    return F.get(F.filter(F.transform(directories, lambda d: names[d]), lambda f: f.isNotNull()), F.lit(0))


def within_one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, substitution or swap of neighbours apart; equal texts aren't."""
    n = F.length(a)
    # Where the texts first differ: the length of their common beginning.
    i = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.length(b)), F.lit(1))), F.lit(0), lambda p, k: F.when((p == k - 1) & (F.substr(a, k, F.lit(1)) == F.substr(b, k, F.lit(1))), k).otherwise(p))
    swap = (n == F.length(b)) & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, i + 2, F.lit(1))) & (F.substr(a, i + 2, F.lit(1)) == F.substr(b, i + 1, F.lit(1))) & (F.substr(a, i + 3) == F.substr(b, i + 3))
    return F.when(a == b, False).when(F.abs(n - F.length(b)) > 1, False).when(F.levenshtein(a, b, 1) == 1, True).otherwise(swap)


def slugify(c: Column) -> Column:
    """Lower case, punctuation dropped, spaces to hyphens; letters of any script stay."""
    return F.regexp_replace(trimmed(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s_-]", "")), r"\s", "-")


def fold_relation_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def document_of(node_id: Column) -> Column:
    return F.substring_index(node_id, "#", 1)


def percent_decoded(c: Column) -> Column:
    """Percent escapes resolved, ``+`` kept; null if malformed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def truncate(c: Column, limit: int = 48) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 3), F.lit("...")))


def summarise(c: Column, limit: int = 120) -> Column:
    """One line of text: links flattened, white space collapsed, cut with ``...``."""
    flat = F.regexp_replace(F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\s+", " ")
    return truncate(F.trim(flat), limit)


def format_ref(file: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", file, line, column)


# Paths


def to_posix(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def is_absolute_path(c: Column) -> Column:
    return c.rlike(r"^(?:[/\\]|[A-Za-z]:)")


def dirname(c: Column) -> Column:
    """Up to the last slash; empty without one."""
    return F.regexp_extract(c, r"(?s)^(.*)/[^/]*$", 1)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extname(c: Column) -> Column:
    """The last extension, lower case; a leading dot makes none."""
    return F.lower(F.regexp_extract(basename(c), r"(?s)^.+(\.[^.]*)$", 1))


def normalise_path(c: Column) -> Column:
    """``.``, empty segments and ``..`` resolved; a relative path keeps leading ``..``."""
    absolute = F.startswith(c, F.lit("/"))
    parts = F.filter(F.split(c, "/"), lambda s: (s != "") & (s != "."))

    def step(out: Column, s: Column) -> Column:
        last = F.when(F.size(out) > 0, F.element_at(out, -1))
        up = F.when(F.coalesce(last != "..", F.lit(False)), F.slice(out, 1, F.size(out) - 1)).when(~absolute, F.concat(out, F.array(F.lit("..")))).otherwise(out)
        return F.when(s == "..", up).otherwise(F.concat(out, F.array(s)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    # Most paths are as they should be; walking over segments costs much more than a look at them.
    return F.when(c.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(joined)).otherwise(c)


def resolve_from(from_file: Column, target: Column) -> Column:
    """A target as seen from a file."""
    folder = dirname(from_file)
    joined = F.when(folder != "", F.concat(folder, F.lit("/"), target)).otherwise(target)
    return normalise_path(F.when(F.startswith(target, F.lit("/")), target).otherwise(joined))


def path_alias(path: Column) -> Column:
    """Path without its last extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def file_stem(path: Column) -> Column:
    """Name without extension; ``readme`` and ``index`` take their folder's name."""
    base = basename(path)
    stem = F.when(base.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    folder = dirname(path)
    return F.when(F.lower(stem).isin("readme", "index") & (folder != ""), basename(folder)).otherwise(stem)


def suggest_reference_glob(target: Column) -> Column:
    t = trimmed(target)
    stem = F.regexp_extract(t, r"^(.*?[\s._-]*)[0-9]+$", 1)
    return F.when(stem.rlike(r"[^\s._-]"), F.concat(stem, F.lit("*"))).otherwise(t)


# Escapes of the exports


def escape_annotation(c: Column, as_property: bool = False) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if as_property else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_dot(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def template_parts(template: str) -> list[tuple[str, int | None, str | None]]:
    """A template as (text, place, key): literal text, or a place with an attribute key."""
    out, at = [], 0
    for m in re.finditer(r"\{([0-9]+)(?:\.([A-Za-z_][A-Za-z0-9_.:-]*))?\}", template):
        if m.start() > at:
            out.append((template[at : m.start()], None, None))
        out.append((m.group(0), int(m.group(1)), m.group(2)))
        at = m.end()
    return out + ([(template[at:], None, None)] if at < len(template) else [])
