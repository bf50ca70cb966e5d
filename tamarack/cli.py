"""Command line: ``check``, ``query``, ``graph``, ``rules``, ``diff``.

Exit codes: 0 clean, 1 findings (or no match), 2 could not run.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from tamarack.plans import report, rules
from tamarack.plans.project import LEVELS, Config, ConfigError, parse_config
from tamarack.vocab import SEVERITIES

VERSION = "0.2"


def _arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tamarack")
    sub = p.add_subparsers(dest="command", required=True)
    scope = argparse.ArgumentParser(add_help=False)
    scope.add_argument("--root", default=".")
    scope.add_argument("--config")
    scope.add_argument("--no-config", action="store_true")
    for name in ("ignore", "history", "ignore-ref", "family", "ignore-family"):
        scope.add_argument(f"--{name}", action="append", default=[])
    check = sub.add_parser("check", parents=[scope])
    check.add_argument("--rule", action="append", default=[], metavar="ID=SEVERITY")
    check.add_argument("--strict", action="store_true")
    check.add_argument("--baseline")
    check.add_argument("--record-baseline")
    check.add_argument("--ratchet", action="store_true")
    check.add_argument("--format", choices=("human", "json", "sarif", "markdown", "gitlab", "github"), default="human")
    check.add_argument("--max", type=int, default=200)
    check.add_argument("--max-warnings", type=int)
    check.add_argument("--color", action="store_true")
    check.add_argument("--ascii", action="store_true")
    check.add_argument("--verbose", action="store_true")
    query = sub.add_parser("query", parents=[scope])
    query.add_argument("selector")
    query.add_argument("--limit", type=int)
    graph = sub.add_parser("graph", parents=[scope])
    graph.add_argument("--graph-format", choices=("dot", "mermaid", "json"), default="dot")
    graph.add_argument("--documents-only", action="store_true")
    listed = sub.add_parser("rules")
    listed.add_argument("id", nargs="?")
    listed.add_argument("--explain", action="store_true")
    diff = sub.add_parser("diff")
    diff.add_argument("before")
    diff.add_argument("after")
    diff.add_argument("--format", choices=("text", "json", "markdown"), default="text")
    for x in (check, query, graph):
        x.add_argument("patterns", nargs="*")
    return p.parse_args(argv)


def _refused(a: argparse.Namespace) -> list[str]:
    """Options that make no sense together."""
    if a.command in ("rules", "diff"):
        return []
    out = []
    if a.config and a.no_config:
        out.append("--config and --no-config exclude each other")
    both = {f.upper() for f in a.family} & {f.upper() for f in a.ignore_family}
    out += [f"family {f} is both asked for and ignored" for f in sorted(both)]
    if a.command == "check":
        if a.record_baseline and a.baseline:
            out.append("--record-baseline writes what --baseline would accept: give one of them")
        if a.record_baseline and a.ratchet:
            out.append("--ratchet compares with a baseline: not while one is recorded")
        if a.record_baseline and a.max_warnings is not None:
            out.append("--max-warnings judges a run: not while a baseline is recorded")
        if a.max < 0 or (a.max_warnings is not None and a.max_warnings < 0):
            out.append("--max and --max-warnings are numbers from 0")
        if (a.color or a.ascii) and a.format != "human":
            out.append("--color and --ascii are for the human report")
        if a.verbose and a.format not in ("human", "markdown"):
            out.append("--verbose is for the human and Markdown reports; the others say everything")
    if a.command == "query" and a.limit is not None and a.limit < 1:
        out.append("--limit is a number from 1")
    if a.command == "graph" and a.documents_only and a.graph_format == "json":
        out.append("the JSON export always has items: --documents-only is for drawings")
    return out


def _package_config(path: str):
    """The value of ``tamarack`` in a package.json, if there is one."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except (OSError, ValueError):
        return None
    return held.get("tamarack") if isinstance(held, dict) else None


def _print(lines) -> None:
    for line in lines:
        print(line)


def _config(a: argparse.Namespace) -> Config:
    """The configuration file's, with the flags' values over or after it."""
    path = a.config
    at = os.path.abspath(a.root)
    while path is None and not a.no_config:
        if os.path.exists(found := os.path.join(at, ".tamarack.json")):
            path = found
        elif _package_config(os.path.join(at, "package.json")) is not None:
            path = os.path.join(at, "package.json")
        elif os.path.exists(os.path.join(at, ".git")) or os.path.dirname(at) == at:
            break
        at = os.path.dirname(at)
    c = Config()
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        held = _package_config(path) if os.path.basename(path) == "package.json" else None
        c = parse_config(text if held is None else json.dumps(held))
    c.include = tuple(a.patterns) or c.include
    for mine, flag in (("ignore", a.ignore), ("history", a.history), ("ignore_references", a.ignore_ref), ("families", a.family), ("ignore_families", a.ignore_family)):
        setattr(c, mine, (*getattr(c, mine), *flag))
    for setting in getattr(a, "rule", []):
        name, _, level = setting.partition("=")
        if level not in LEVELS or (name not in SEVERITIES and not name.startswith("project:")):
            raise ConfigError([f"--rule {setting}: a rule and one of {', '.join(LEVELS)} are expected"])
        c.severities[name] = level
    c.strict = c.strict or getattr(a, "strict", False)
    return c


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _arguments(sys.argv[1:] if argv is None else argv)
    if a.command == "rules":
        for name, level in SEVERITIES.items():
            if a.id in (None, name):
                print(f"{name} {level}" + (f"\n    {report.DESCRIPTIONS[name]}" if a.explain else ""))
        return 0 if a.id is None or a.id in SEVERITIES else 2
    if refused := _refused(a):
        print("; ".join(refused), file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    try:
        return _diff(spark, a) if a.command == "diff" else _over_corpus(spark, a, _config(a))
    except (ConfigError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


def _diff(spark, a) -> int:
    from tamarack.operators import diff
    from tamarack.sources.exports import read_generator, read_graph_export

    before, after = read_graph_export(spark, a.before), read_graph_export(spark, a.after)
    warning = diff.generator_warning(read_generator(spark, a.before), read_generator(spark, a.after))
    _print({"text": diff.diff_text, "json": diff.diff_json, "markdown": diff.diff_markdown}[a.format](before, after, warning))
    return 0


def _over_corpus(spark, a, c: Config) -> int:
    from tamarack.operators import baseline as B
    from pyspark.sql import functions as F

    from tamarack.functions.text import prefixed_family
    from tamarack.plans.analysis import summary, unread_front_matter
    from tamarack.plans.corpus import Options, analyse, families, list_files, read_sources
    from tamarack.plans.selector import execute, render, union
    from tamarack.sources.exports import baseline_json, read_baseline
    from tamarack.storage import settle

    spec_files = read_sources(spark, a.root, c.include, c.ignore)
    corpus = analyse(spec_files, Options(c.ignore_references, c.families, c.ignore_families, c.history), list_files(spark, a.root))
    graph = corpus.graph
    held = {r.family for r in families(corpus.specs).collect()}  # a row a family
    if unknown := sorted({f.upper() for f in (*c.families, *c.ignore_families)} - {f.upper() for f in held}):
        cited = {r.f for r in corpus.suppressed.select(F.upper(prefixed_family(F.col("target"))).alias("f")).distinct().collect()}
        if unknown := [f for f in unknown if f not in cited]:
            raise ConfigError([f"no document and no reference is of the family {f}" for f in unknown])
    if a.command == "query":
        project = {r.id: r.queries for r in c.rules}
        matched = union(graph, list(project[a.selector]), limit=a.limit) if a.selector in project else execute(graph, a.selector, limit=a.limit)
        some = False
        for r in render(graph, matched).orderBy("text").toLocalIterator():
            some = True
            print(r.text)
        return 0 if some else 1
    if a.command == "graph":
        if a.graph_format == "json":
            lines = report.graph_json(graph)
            print('{\n  "version": 1,\n  "generator": {"name": "tamarack", "version": "%s"},' % VERSION)
            for k, name in enumerate(("nodes", "edges")):
                _print(report._array(name, (r for r in lines.where(F.col("table") == name).select("json").toLocalIterator()), bool(k)))
            print("}")
        else:
            for r in report.graph_lines(graph, a.graph_format, a.documents_only).orderBy("part", "ord").toLocalIterator():
                print(r.text)
        return 0
    found = settle(rules.run_rules(graph, corpus.dangling, corpus.misread, c.severities, c.strict, c.rules, c.max_related), "findings")
    if a.record_baseline:
        with open(a.record_baseline, "w", encoding="utf-8") as f:
            f.write(baseline_json(B.tally(found)))
        return 0
    stale = gone = taken = 0
    if accepted := a.baseline or c.baseline:
        entries, problems = read_baseline(spark, accepted)
        if problems:
            raise ConfigError(problems)
        reasons = {r.reason: r["count"] for r in B.stale_entries(found, entries, graph.documents).groupBy("reason").count().collect()}
        stale, gone = sum(reasons.values()), reasons.get("gone", 0)
        kept = settle(B.apply_baseline(found, entries, ["file", "line", "column", "message"]).where("kept").select(*found.columns), "kept")
        taken = found.count() - kept.count()
        found = kept
    levels = rules.resolve_severities(c.severities, False, c.rules)
    raised = tuple(sorted(k for k, v in levels.items() if c.strict and v == "warn" and k not in c.severities))
    run = report.Run(summary(graph, found).first(), raised, accepted, taken, stale, gone, a.ratchet or c.ratchet, unread_front_matter(corpus.specs).first().unread, c.strict)
    more = (corpus.suppressed, corpus.problems)
    if a.format == "human":
        _print(report.human(found, run, a.max, a.color, a.ascii, a.verbose, *more))
    elif a.format == "markdown":
        _print(report.markdown(found, run, a.max, *(more if a.verbose else (None, None))))
    elif a.format == "sarif":
        _print(report.sarif(found, run, c.rules))
    elif a.format == "json":
        _print(report.json_report(found, run, spec_files.select("path"), *more))
    elif a.format == "gitlab":
        _print(["[", *_commas(r.json for r in report.code_quality(rules.in_order(found), raised).toLocalIterator()), "]"])
    else:
        _print(r.text for r in report.annotations(rules.in_order(found)).toLocalIterator())
    over = a.max_warnings is not None and run.counts.warnings > a.max_warnings
    return int(not run.ok or over or run.loose)


def _commas(rows):
    before = None
    for r in rows:
        if before is not None:
            yield f"  {before},"
        before = r
    if before is not None:
        yield f"  {before}"


if __name__ == "__main__":
    sys.exit(main())
