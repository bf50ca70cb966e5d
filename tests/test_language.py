"""Selectors, patterns, globs, the scanner, states and citations."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.plans.globs import GlobError, compile_glob, glob_base, rebase
from tamarack.plans.pattern import Automaton, PatternError, found, is_harmless, java_pattern
from tamarack.plans.project import ConfigError, parse_config
from tamarack.plans.selector import NodeMatcher, Predicate, Query, QueryError, Step, parse_query
from tamarack.sources.extract import classify, edit_apart, extract, identify, phase_of
from tamarack.sources.markdown import scan


def test_parse_query():
    q = parse_query(" document[status='a \\' b'][fm.x] -supersedes,AMENDS-> * <=depends-on= item[text~=a+] ")
    assert q == Query(
        NodeMatcher("document", (Predicate("status", "=", "a ' b"), Predicate("fm.x", "exists"))),
        (Step("out", ("supersedes", "amends"), False, NodeMatcher(None)), Step("in", ("depends-on",), True, NodeMatcher("item", (Predicate("text", "~=", "a+"),)))),
    )
    assert parse_query("[id=x] -*-> any").steps[0].kinds is None


@pytest.mark.parametrize(
    ("text", "offset"),
    [("", 0), ("thing", 0), ("document[", 9), ("document[a", 10), ("document[a=b", 12), ("document[a='b]", 14), ("document -x-> item", 10), ("document -depends-on=> item", 9), ("document foo", 9), ("item[text~=a(b]", 14), ("item[text~='(?=a)']", 12)],
)
def test_query_errors(text, offset):
    with pytest.raises(QueryError) as e:
        parse_query(text)
    assert e.value.offset == offset


@pytest.mark.parametrize("pattern", ["(", "a{3,1}", "(?=a)", "(?<n>a)", r"\1", r"\p{L}", r"\q", r"\01", "a**", "*a", "[a", "a)", "\\", "(a{4000}){4000}"])
def test_refused_patterns(pattern):
    with pytest.raises(PatternError):
        java_pattern(pattern)


def test_patterns_match(spark):
    cases = [(r"^a.c$", "AbC", True), (r"\d{2,3}", "x12", True), (r"[^\W_]+", "__", False), (r"a|b{", "b{", True), (r"\bcat\b", "a cat.", True), (r"x[\s]y", "x y", True), (r"a.b", "a\nb", False), ("", "", True)]
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[F.lit(s).rlike(java_pattern(p)).alias(f"c{k}") for k, (p, s, _) in enumerate(cases)]).first()
    assert list(row) == [w for *_, w in cases]


_PATTERNS = (
    r"^a.c$", r"\d{2,3}", r"[^\W_]+", r"a|b{", r"\bcat\b", r"x[\s]y", r"a.b", "", r"(a+)+$", r"(?:a|b)*c\b", r"^\s*$", r"[a-c]{2,}x?$", r"(x+x+)+y", r"\Ba\B", r"[]a]", r"[^]b", r"a{0,2}b{2}", r"^(?:[^-]*-){2}z",
    r"[\d-]x", r"\u0041\x62", r"(|a)b$", r"k+z", r"[a\S]y", r"^.*\.$",
)


def test_automaton_agrees_with_the_jvm(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    texts = ["", "AbC", "x12", "__", "b{", "a cat.", "x y", "a\nb", "\u212az", "\u2028", "a-b-z", "AB", "3x"] + ["".join(rng.choices("abcxyz-_ .A1\n", k=rng.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[F.col("t").rlike(java_pattern(p)).alias(f"c{k}") for k, p in enumerate(_PATTERNS)]).collect()
    for k, p in enumerate(_PATTERNS):
        search = Automaton(p).search
        assert [r.t for r in rows if search(r.t) != r[f"c{k}"]] == [], p


def test_automaton_is_linear(spark):
    from pyspark.sql import functions as F

    assert [is_harmless(p) for p in (r"^[12]-(urgent|high)$", r"v\d+", "(a+)+$", "a.*b", "(a|a?){40}b", "a{2,5}b")] == [True, True, False, False, False, True]
    began = time.monotonic()
    for p in ("(a+)+$", "^(a|a)*$", "(x+x+)+y", "(?:a?){200}a{200}$"):
        assert not Automaton(p).search(("a" if "x" not in p else "x") * 150 + "!")
        assert not Automaton(p).search(("a" if "x" not in p else "x") * 100_000 + "!")
    assert time.monotonic() - began < 10
    df = spark.createDataFrame([("a" * 54 + "!", ["no", None, "aa"]), (None, None), ("xa", [])], "v string, vs array<string>")
    assert [tuple(r) for r in df.select(found("(a+)+$", F.col("v"), False), found("(a+)+$", F.col("vs"), True), found("a$", F.col("vs"), True)).collect()] == [(False, True, True), (False, False, False), (True, False, False)]


def test_automaton_forgets(monkeypatch):
    monkeypatch.setattr(Automaton, "KEPT", 5)
    a = Automaton(r"(ab|ba)+c\b")
    assert [a.search(t) for t in ("xababbac", "ababcx", "abbabac.", "")] == [True, False, True, False]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("docs/**/*.md", ["docs/a.md", "docs/x/y/a.md"], ["docs/a.txt", "a.md", "xdocs/a.md"]),
        ("docs", ["docs", "docs/a/b"], ["docs2", "a/docs"]),
        ("docs/", ["docs/a"], ["docs"]),
        ("**/a?.{md,txt}", ["ab.md", "x/ac.txt"], ["a.md", "x/abc.md", "a/.md"]),
        ("[!a-c]x", ["dx"], ["ax", "/x"]),
        ("a.b", ["a.b"], ["axb"]),
        ("**", ["a", "a/b"], []),
    ],
)
def test_globs(glob, yes, no):
    r = re.compile(compile_glob(glob))
    assert all(r.search(p) for p in yes) and not any(r.search(p) for p in no)


@pytest.mark.parametrize("glob", ["", "a[b", "a{b", "../a", "a/../b", "+(a)", "{a,b}" * 9])
def test_refused_globs(glob):
    with pytest.raises(GlobError):
        compile_glob(glob)


def test_glob_parts():
    assert glob_base("docs/adr/*.md") == "docs/adr" and rebase("!x/*", "a/b/") == "!a/b/x/*"


def test_scanner_masks_and_structure():
    s = scan("# A `b` #\n\n```\n# no\n[x](y)\n```\n\n    code [c](d)\n\nText ``[e](f)`` [g](h) <!-- [i](j)\n# no --> [[k|l]] ![m](n) ![[o]]\n\nSetext\n------\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n| a |\n|---|---|\n")
    assert [h.text for h in s.headings] == ["A `b`", "Setext"] and [h.level for h in s.headings] == [1, 2]
    assert [k.target for k in s.links] == ["h", "k", "o"]
    assert [[c.text for c in r] for t in s.tables for r in [t.headers, *t.rows]] == [["a", "b"], ["1", "2"]]
    assert len(s.masked) == len(s.text)


def test_line_ends_agree():
    text = "# T\n\n## Todo\n\n- [ ] a\n  b\n- [x] c\n\nsee [d](e.md)\n"
    want = [(i.first_line, i.checkbox) for i in scan(text).items]
    for end in ("\r\n", "\r"):
        s = scan(text.replace("\n", end))
        assert [(i.first_line, i.checkbox) for i in s.items] == want and [s.place(k.start)[0] for k in s.links] == [9]


def test_columns_count_utf16():
    s = scan("😀 [a](b.md)")
    assert s.place(s.links[0].start) == (1, 4)


@pytest.mark.parametrize(
    ("line", "state"),
    [("- [ ] x", "unresolved"), ("- [x] x", "satisfied"), ("- [~] x", "narrowed"), ("- [-] x", "rejected"), ("- [ ] **Moot** x", "obviated"), ("- [ ] WONTFIX", "accepted-debt"), ("- [ ] Resolved: yes", "satisfied"), ("- [ ] resolved things", "unresolved"), ("- [ ] ~~gone~~", "satisfied"), ("- [x] Still open: y", "unresolved"), ("- [ ] delegated to: z", "delegated")],
)
def test_item_states(line, state):
    (spec,) = extract("a.md", f"# A\n\n{line}\n")
    assert spec["items"][0]["disposition"] == state


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [("This is blocked by ", ".", ("blocked-by", False)), ("not blocked by ", "", ("references", False)), ("superseded by ", "", ("supersedes", True)), ("", " supersedes it", ("supersedes", True)), ("depends on a. See ", "", ("references", False)), ("tracked in, see ", "", ("references", False)), ("It will be decided in ", "", ("delegates-to", False)), ("because of ", "", ("assumes", False))],
)
def test_citations(before, after, want):
    assert classify(before + "[x](y)" + after, len(before), len(before) + 6, []) == want
    assert classify("[x](y)", 0, 6, ["See also"]) == ("relates-to", False)


def test_identity():
    got = identify("docs/adr/0007-a-b.md", None, ["Other"], "ADR-9: no")
    assert got["id"] == "ADR-0007" and {"adr7", "adr007", "adr0007", "0007ab", "other", "docs/adr/0007abmd"} <= set(got["aliases"])
    assert identify("x/readme.md", None, [], None)["id"] == "x" and identify("x/y.md", "--", [], "RFC 3 z")["id"] == "RFC-3"


def test_phase_words():
    assert [phase_of(x) for x in (None, "**Accepted**", "Superseded by X", "provisionally accepted", "Final 2020-01-01", "archived", "odd")] == ["unknown", "active", "retired", "draft", "frozen", "record", "unknown"]


@given(st.text("abc", max_size=5), st.text("abc", max_size=5))
def test_edit_apart(a, b):
    near = {a[:i] + c + a[i + d :] for i in range(len(a) + 1) for c in ("", "a", "b", "c") for d in (0, 1)} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    assert edit_apart(a, b) == (a != b and b in near)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*"#-*`[]()<>!|:\n\r \tax~_1.@", "<!--", "-->", "---\n", "```\n", "| a |"]), max_size=80).map("".join))
def test_any_text_is_read(text):
    for spec in extract("docs/adr/0001-x.md", text):
        assert re.search(r"\w", spec["id"]) and spec["line"] >= 1 and spec["column"] >= 1
        assert all(r["target"] and r["line"] >= 1 for r in spec["refs"])


def test_long_lines_finish():
    rng = random.Random(1)
    for text in ("`" * 20000 + "a", "[" * 3000, "<!--" * 3000, "- " * 5000, "".join(rng.choices("[]()`*|", k=4000))):
        extract("a.md", text)


def test_config():
    c = parse_config('{"families": ["ADR"], "severities": {"self-reference": "off"}, "rules": {"b": {"query": "document -amends-> *", "message": "{0} {1.phase}"}, "a": {"query": ["item"]}}}')
    assert [r.id for r in c.rules] == ["project:a", "project:b"] and c.severities == {"self-reference": "off"}
    with pytest.raises(ConfigError) as e:
        parse_config('{"x": 1, "strict": "no", "families": ["a"], "ignoreFamilies": ["A"], "rules": {"r": {"query": "item", "message": "{1} {0.nope}"}, "!": {}}}')
    assert len(e.value.problems) == 6


def test_readers_of_some_blocks_pay_for_no_others():
    from tamarack.sources.blocks import KINDS, blocks

    text = "---\nstatus: accepted\ndepnds-on: ADR-2\n---\n# ADR-1: A\n\n## Todo\n\n- [ ] amends [b](b.md)\n\n| ID | Status |\n| --- | --- |\n| Q1 | draft |\n\n<!-- c -->\n"
    whole = list(blocks("a.md", text))
    assert {b["kind"] for b in whole} == set(KINDS)
    for kind in KINDS:
        assert list(blocks("a.md", text, [kind])) == [b for b in whole if b["kind"] == kind]
    s = scan(text)
    assert s.front.entries["status"] == ["accepted"] and not {"_masked", "lines", "items", "links", "tables"} & set(vars(s))
    full = extract("a.md", text)
    assert [len(full[0][k]) for k in ("items", "refs", "misread")] == [1, 2, 1]
    for parts in ((), ["items"], ["refs"], ["misread"]):
        assert extract("a.md", text, parts) == [{**row, **{k: [] for k in ("items", "refs", "misread") if k not in parts}} for row in full]
