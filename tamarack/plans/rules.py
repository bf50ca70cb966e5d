"""The diagnostics, each a query over the graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import dirname, resolve_from, suggest_reference_glob, template_parts, truncate
from tamarack.operators.cycles import components
from tamarack.operators.graph import SpecGraph, with_owners
from tamarack.plans.selector import Query, attribute, execute, matcher, parse_query
from tamarack.vocab import CLOSED_ROUND_RULES, EDGE_TRAITS, OBLIGATION_EDGES, REFERENCE_RULES, SEVERITIES, SEVERITY_ORDER

FINDING = "rule string, message string, file string, line int, column int, nodes array<string>, target string, related array<struct<file:string,line:int,note:string>>, hint string"
MAX_RELATED = 8
GHOST = parse_query("*[openness!=closed][phase!=retired] -delegates-to,blocked-by-> *[receptivity=sealed]")
STALE = tuple(parse_query(f"*[phase!=retired] -depends-on,assumes,amends,blocked-by-> {end}") for end in ("document[phase=retired]", "item[state=obviated]"))
_NODE = ("id", "kind", "document", "phase", "history", "raw_status", "text", "file", "line", "column", "status_line", "status_column")


@dataclass(frozen=True)
class ProjectRule:
    name: str
    queries: tuple[Query, ...]
    message: str
    hint: str = ""
    severity: str = "warn"

    @property
    def id(self) -> str:
        return f"project:{self.name}"


def _phrase(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, t in EDGE_TRAITS.items() for x in (k, t[3])])[kind]


def _describe(p: str) -> Column:
    return F.when(F.col(f"{p}_kind") == "document", F.col(f"{p}_id")).otherwise(F.concat(F.col(f"{p}_document"), F.lit(' "'), truncate(F.col(f"{p}_text")), F.lit('"')))


def _suffix(p: str) -> Column:
    return F.when(F.coalesce(F.length(f"{p}_raw_status"), F.lit(0)) > 0, F.concat(F.lit(' ("'), f"{p}_raw_status", F.lit('")'))).otherwise("")


def _note(file, line, note) -> Column:
    return F.struct(file.alias("file"), line.cast("int").alias("line"), note.alias("note"))


def _named(nodes: DataFrame, p: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in _NODE])


def _finding(df: DataFrame, rule: str, message: Column, at: Sequence[Column], nodes: Column, hint: Column, related: Column | None = None, target: Column | None = None) -> DataFrame:
    none = F.array().cast("array<struct<file:string,line:int,note:string>>")
    return df.select(
        F.lit(rule).alias("rule"), message.alias("message"), at[0].alias("file"), at[1].cast("int").alias("line"), at[2].cast("int").alias("column"), nodes.cast("array<string>").alias("nodes"),
        (F.lit(None).cast("string") if target is None else target).alias("target"), (none if related is None else related).alias("related"), hint.alias("hint"),
    )


def _matched(graph: SpecGraph, query: Query) -> DataFrame:
    """One-step matches with their edge and the attributes of both ends (``s_`` and ``t_``).

    As ``execute`` does, but each end is joined once, with what its predicates
    leave of it, and the edge's columns come along.
    """
    (step,) = query.steps
    here, there = ("from", "to") if step.direction == "out" else ("to", "from")
    edges = graph.edges if step.kinds is None else graph.edges.where(F.col("kind").isin(*step.kinds))
    edge = edges.where(~F.col("reflexive")).select(
        F.col(here).alias("s_id"), F.col(there).alias("t_id"), "edge_ord", F.col("kind").alias("edge_kind"), "from", "to", F.col("file").alias("e_file"), F.col("line").alias("e_line"), F.col("column").alias("e_column")
    )
    if step.kinds is None or len(step.kinds) > 1:  # of several edges between the same nodes the first counts
        rest = [c for c in edge.columns if c not in ("s_id", "t_id")]
        edge = edge.groupBy("s_id", "t_id").agg(F.min_by(F.struct(*rest), "edge_ord").alias("e")).select("s_id", "t_id", "e.*")
    start, end = graph.nodes.where(matcher(query.start)), graph.nodes.where(matcher(step.node))
    return edge.join(_named(start, "s"), "s_id").join(_named(end, "t"), "t_id")


def _edge_at() -> list[Column]:
    return [F.col("e_file"), F.col("e_line"), F.col("e_column")]


def ghost_handover(graph: SpecGraph) -> DataFrame:
    """Open obligations handed to what can no longer take them."""
    m = _matched(graph, GHOST)
    seal = F.when((F.col("t_phase") == "record") & ~F.col("t_history"), "archived").otherwise(F.col("t_phase"))
    m = m.withColumn("seal", seal).withColumn("word", F.expr("case seal when 'retired' then 'retired' when 'record' then 'a historical record' when 'archived' then 'archived' else 'frozen' end"))
    what = F.when(F.col("s_kind") == "item", "open obligation ").otherwise("obligation ")
    message = F.concat(what, _phrase(F.col("edge_kind")), F.lit(" "), _describe("t"), F.lit(", which is "), "word")
    owner = F.col("t_document")
    hint = (
        F.when(F.col("seal") == "retired", F.concat(F.lit("nothing will be read from "), owner, F.lit(" again - re-home this in a live document, or close it here")))
        .when(F.col("seal") == "record", F.concat(owner, F.lit(" is a log of what happened and will never act - re-home this in a live document")))
        .when(F.col("seal") == "archived", F.concat(owner, F.lit(" is a closed round of work and will never act - re-home this in a live document")))
        .otherwise(F.concat(owner, F.lit(" is frozen and cannot take on new work - open an amendment, or close this here")))
    )
    sealed = _note(F.col("t_file"), F.col("t_status_line"), F.concat(owner, F.lit(" is "), "word", _suffix("t")))
    related = F.when(F.col("s_kind") == "item", F.array(sealed, _note(F.col("s_file"), F.col("s_line"), F.concat(F.lit("the obligation: "), "s_text")))).otherwise(F.array(sealed))
    return _finding(m, "ghost-handover", message, _edge_at(), F.array("s_id", "t_id"), hint, related)


def stale_premise(graph: SpecGraph) -> DataFrame:
    """Live things that rest on what was retired or obviated, less what a ghost handover claims."""
    claimed = _matched(graph, GHOST).select("edge_ord")
    m = _matched(graph, STALE[0]).unionByName(_matched(graph, STALE[1])).join(claimed, "edge_ord", "left_anti")
    item = F.col("t_kind") == "item"
    because = F.when(item, "that question was obviated - its premise no longer holds").otherwise(F.concat("t_id", F.lit(" is retired"), _suffix("t")))
    message = F.concat(_describe("s"), F.lit(" "), _phrase(F.col("edge_kind")), F.lit(" "), _describe("t"), F.lit(", which no longer holds"))
    closed = F.when(item, "the question closed").otherwise(F.concat("t_id", F.lit(" was retired")))
    hint = F.concat(F.lit("re-check this dependency: the constraint it assumes may have been lifted when "), closed)
    at = _note(F.col("t_file"), F.when(item, F.col("t_line")).otherwise(F.col("t_status_line")), because)
    return _finding(m, "stale-premise", message, _edge_at(), F.array("s_id", "t_id"), hint, F.array(at))


def references(dangling: DataFrame) -> DataFrame:
    """The three rules over references that resolve to nothing or to too much."""
    q = F.concat(F.lit('"'), "target", F.lit('"'))
    reason = F.col("reason")
    rule = F.when(reason == "ambiguous", "ambiguous-reference").when(reason == "not-a-spec", "reference-outside-corpus").otherwise("broken-reference")
    message = (
        F.when(reason == "ambiguous", F.concat(q, F.lit(" matches "), F.size("candidates"), F.lit(" documents")))
        .when(reason == "unknown-anchor", F.concat(q, F.lit(" points at an anchor that does not exist")))
        .when(reason == "not-a-spec", F.concat(q, F.lit(" resolves to a file that is not a specification")))
        .otherwise(F.concat(q, F.lit(" does not resolve to any document")))
    )
    folder = dirname(resolve_from(F.col("file"), F.trim(F.substring_index("target", "#", 1))))
    include = F.concat(F.lit('include it: "'), F.when(folder != "", F.concat(folder, F.lit("/*.md"))).otherwise("*.md"), F.lit('"'))
    hint = (
        F.when(reason == "ambiguous", F.concat(F.lit("disambiguate it - candidates: "), F.array_join("candidates", ", ")))
        .when(F.size("candidates") > 0, F.concat(F.lit("did you mean "), F.array_join(F.slice("candidates", 1, 3), ", "), F.lit("?")))
        .when(F.startswith("raw", F.lit("[[")) & (reason == "unknown-target"), F.concat(F.lit('fix the identifier, or leave the tag out: --ignore-ref "'), suggest_reference_glob(F.col("target")), F.lit('"')))
        .when(reason == "unknown-anchor", "check the heading or item id it is meant to address")
        .when(reason == "not-a-spec", include)
        .otherwise("fix the identifier, or add the document it names")
    )
    out = _finding(dangling, "", message, [F.col("file"), F.col("line"), F.col("column")], F.array("from"), hint, target=F.col("target"))
    return dangling.select(rule.alias("rule"), message.alias("message"), "file", "line", "column", F.array("from").alias("nodes"), "target", F.array().cast("array<struct<file:string,line:int,note:string>>").alias("related"), hint.alias("hint")).select(*out.columns)


def without_hand_offs(graph: SpecGraph) -> DataFrame:
    """Edges less obligations that a document hands to what supersedes it."""
    own = with_owners(graph, graph.edges)
    successor = own.where("kind = 'supersedes'").select(F.col("to_document").alias("from_document"), F.col("from_document").alias("to_document")).distinct()
    duty = F.col("kind").isin(*OBLIGATION_EDGES)
    return own.where(duty).join(successor, ["from_document", "to_document"], "left_anti").unionByName(own.where(~duty))


def circular_delegation(graph: SpecGraph) -> DataFrame:
    """Documents whose obligations, or supersessions, go round."""
    logs = graph.documents.where("history").select(F.col("id").alias("node"))
    out = None
    for edges, words in (
        (without_hand_offs(graph).where(F.col("kind").isin(*OBLIGATION_EDGES)), "delegation cycle across {} documents: nothing in it can ever land"),
        (with_owners(graph, graph.edges.where("kind = 'supersedes'")), "supersession cycle across {} documents"),
    ):
        between = edges.where("from_document <> to_document")
        found = components(between.select(F.col("from_document").alias("a"), F.col("to_document").alias("b")))
        logged = found.join(logs, "node", "left_semi").select("component").distinct()
        kept = found.join(logged, "component", "left_anti")
        inside = between.join(kept.select(F.col("node").alias("from_document"), "component"), "from_document").join(kept.select(F.col("node").alias("to_document"), F.col("component").alias("other")), "to_document").where("component = other")
        # What a component shows of its edges: the first, and as many notes as a finding has at most.
        note = F.concat("from", F.lit(" "), _phrase(F.col("kind")), F.lit(" "), "to")
        edge = inside.groupBy("component").agg(F.min(F.struct("edge_ord", "file", "line", "column")).alias("e"), F.slice(F.array_sort(F.collect_list(F.struct("edge_ord", "file", "line", note.alias("note")))), 1, MAX_RELATED).alias("r"))
        members = kept.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
        head, tail = words.split("{}")
        m = members.join(edge, "component")
        related = F.transform("r", lambda r: F.struct(r["file"].alias("file"), r["line"].cast("int").alias("line"), r["note"].alias("note")))
        one = _finding(m, "circular-delegation", F.concat(F.lit(head), F.size("nodes"), F.lit(tail)), [F.col("e.file"), F.col("e.line"), F.col("e.column")], F.col("nodes"), F.lit("break the loop: one of these must own the work outright, or be closed"), related)
        out = one if out is None else out.unionByName(one)
    return out


def handed_on(graph: SpecGraph) -> DataFrame:
    """Items with a delegation to a document that isn't sealed."""
    live = graph.nodes.where("receptivity <> 'sealed'").select(F.col("id").alias("to"))
    return graph.edges.where("kind = 'delegates-to'").join(live, "to", "left_semi").select(F.col("from").alias("id")).distinct()


def orphaned_obligation(graph: SpecGraph) -> DataFrame:
    """Retired or frozen documents that still hold open items."""
    open_ = graph.items.where("openness <> 'closed' and phase in ('retired', 'frozen')").join(handed_on(graph), "id", "left_anti")
    per = open_.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("node_ord", "id", "file", "line", "disposition", "text"))).alias("held"))
    m = per.join(graph.documents.select("id", "phase", "file", "status_line", "status_column"), per["document"] == F.col("id"))
    n = F.size("held")
    message = F.concat("phase", F.lit(" document still holds "), n, F.when(n == 1, " open obligation").otherwise(" open obligations"))
    hint = F.concat(F.lit("move each one to a live document or close it - as it stands, "), F.when(n == 1, "it disappears").otherwise("they disappear"), F.lit(" with "), "id")
    related = F.transform(F.slice("held", 1, MAX_RELATED), lambda h: _note(h["file"], h["line"], F.concat(h["disposition"], F.lit(": "), h["text"])))
    nodes = F.concat(F.array("id"), F.transform("held", lambda h: h["id"]))
    return _finding(m, "orphaned-obligation", message, [F.col("file"), F.col("status_line"), F.col("status_column")], nodes, hint, related)


def supersessions(graph: SpecGraph) -> DataFrame:
    """Superseded documents that still read as current, or that don't say what replaced them."""
    edge = graph.edges.where("kind = 'supersedes' and not reflexive").select(F.col("from").alias("s_id"), F.col("to").alias("t_id"), F.col("file").alias("e_file"), F.col("line").alias("e_line"), "declared_in")
    docs = graph.documents
    s = docs.where("not history").select(F.col("id").alias("s_id"))
    t = docs.select(F.col("id").alias("t_id"), F.col("phase").alias("t_phase"), F.col("path").alias("t_path"), F.col("file").alias("t_file"), F.col("status_line").alias("t_status_line"), F.col("status_column").alias("t_status_column"))
    m = edge.join(s, "s_id").join(t, "t_id")
    at = [F.col("t_file"), F.col("t_status_line"), F.col("t_status_column")]
    nodes = F.array("t_id", "s_id")
    live = _finding(
        m.where("t_phase not in ('retired', 'record', 'unknown')"), "live-supersession", F.concat("t_id", F.lit(" is superseded by "), "s_id", F.lit(" but still reads as "), "t_phase"), at, nodes,
        F.concat(F.lit("mark "), "t_id", F.lit(" as superseded, or drop the claim in "), "s_id"), F.array(_note(F.col("e_file"), F.col("e_line"), F.lit("the supersession is declared here"))),
    )
    archived = F.col("t_phase") == "record"
    quiet = m.where("t_phase in ('retired', 'record')").where(~F.array_contains("declared_in", F.col("t_path")))
    return live.unionByName(_finding(
        quiet, "unreciprocated-supersession", F.concat("t_id", F.lit(" is "), F.when(archived, "archived").otherwise("retired"), F.lit(" but never says that "), "s_id", F.lit(" replaced it")), at, nodes,
        F.when(archived, F.concat(F.lit("make the status of "), "t_path", F.lit(' "archived, superseded by '), "s_id", F.lit('" so a reader who lands there is redirected'))).otherwise(F.concat(F.lit('add "superseded-by: '), "s_id", F.lit('" to '), "t_path", F.lit(" so a reader who lands there is redirected"))),
        F.array(_note(F.col("e_file"), F.col("e_line"), F.concat(F.lit("only "), "s_id", F.lit(" records the relationship")))),
    ))


def state_conflict(graph: SpecGraph) -> DataFrame:
    m = graph.items.where(F.size("conflicts") > 0)
    said = F.transform("conflicts", lambda c: F.concat(F.lit("a "), c["source"], F.lit(" saying "), c["disposition"]))
    n = F.size("conflicts")
    listed = F.when(n == 1, said[0]).otherwise(F.concat(F.array_join(F.slice(said, 1, n - 1), ", "), F.lit(" and "), F.element_at(said, -1)))
    related = F.transform("conflicts", lambda c: _note(F.col("file"), F.col("line"), F.concat(c["source"], F.lit(" says "), c["disposition"], F.lit(": "), c["raw"])))
    return _finding(m, "state-conflict", F.concat(F.lit("item reads as "), "disposition", F.lit(" but also carries "), listed), [F.col("file"), F.col("line"), F.col("column")], F.array("id"), F.concat(F.lit("make the two agree - it is treated as "), "openness"), related)


def misread_key(keys: DataFrame) -> DataFrame:
    return _finding(keys, "unknown-relation-key", F.concat(F.lit('"'), "key", F.lit('" declares no relation')), [F.col("file"), F.col("line"), F.col("column")], F.array("from"), F.concat(F.lit("spell it "), "suggestion", F.lit(", or move it out of front matter if it is not a relation")), target=F.col("key"))


def self_reference(graph: SpecGraph, also: Sequence[str] = ()) -> DataFrame:
    """Obligations and premises that never leave their document.  ``also``: further kinds to report."""
    kinds = [k for k, t in EDGE_TRAITS.items() if t[0] or t[1]] + list(also)
    m = graph.edges.where(F.col("reflexive") & F.col("kind").isin(*kinds)).select(F.col("kind").alias("edge_kind"), F.col("from").alias("s_id"), F.col("file").alias("e_file"), F.col("line").alias("e_line"), F.col("column").alias("e_column")).join(_named(graph.nodes, "s"), "s_id")
    moves = F.col("edge_kind").isin(*[k for k, t in EDGE_TRAITS.items() if t[1]])
    hint = F.when(moves, "this obligation looks delegated but never left - point it at another document, or own it here").otherwise("a document cannot depend on itself - repoint or remove the reference")
    return _finding(m, "self-reference", F.concat(_describe("s"), F.lit(" "), _phrase(F.col("edge_kind")), F.lit(" itself")), _edge_at(), F.array("s_id"), hint)


def render_template(template: str, places: int) -> Column:
    """A template over ``n0, n1, ...`` (structs of node attributes); what a node lacks stays as it is written."""
    parts = []
    for text, place, key in template_parts(template):
        if place is None or place >= places:
            parts.append(F.lit(text))
        else:
            value = F.col(f"n{place}.id") if key is None else F.get(F.col(f"n{place}.v")[key.lower()], F.lit(0))
            parts.append(F.coalesce(value, F.lit(text)))
    return F.concat(*parts) if parts else F.lit("")


def project_findings(graph: SpecGraph, rule: ProjectRule) -> DataFrame:
    """A project rule's matches, one for each sequence of nodes, with its message and hint filled in."""
    keys = sorted({key.lower() for t in (rule.message, rule.hint) for _, _, key in template_parts(t) if key})
    values = F.create_map(*[x for k in keys for x in (F.lit(k), attribute(k))]) if keys else F.create_map().cast("map<string,array<string>>")
    node = graph.nodes.select(F.col("id").alias("nid"), F.struct("id", values.alias("v")).alias("n"), F.col("file").alias("n_file"), F.col("line").alias("n_line"), F.col("column").alias("n_column"))
    out = None
    matched = None
    for k, q in enumerate(rule.queries):
        one = execute(graph, q).withColumn("query", F.lit(k))
        matched = one if matched is None else matched.unionByName(one)
    matched = matched.groupBy("nodes").agg(F.min_by("edges", "query").alias("edges"))
    for places in sorted({len(q.steps) + 1 for q in rule.queries}):
        m = matched.where(F.size("nodes") == places)
        for i in range(places):
            extra = ["n_file", "n_line", "n_column"] if i == 0 else []
            m = m.join(node.select(F.col("nid").alias(f"i{i}"), F.col("n").alias(f"n{i}"), *extra), F.col("nodes")[i] == F.col(f"i{i}")).drop(f"i{i}")
        first = graph.edges.select(F.col("edge_ord").alias("first"), F.col("file").alias("e_file"), F.col("line").alias("e_line"), F.col("column").alias("e_column"))
        m = m.withColumn("first", F.get("edges", F.lit(0))).join(first, "first", "left")
        at = [F.coalesce(f"e_{c}", f"n_{c}") for c in ("file", "line", "column")]
        one = _finding(m, rule.id, render_template(rule.message, places), at, F.col("nodes"), render_template(rule.hint, places))
        out = one if out is None else out.unionByName(one)
    return out


def resolve_severities(overrides: Mapping[str, str] | None = None, strict: bool = False, project: Sequence[ProjectRule] = ()) -> dict[str, str]:
    """Every rule's severity: the default, the override, and under ``strict`` warnings that aren't overridden as errors."""
    out = dict(SEVERITIES) | {r.id: r.severity for r in project}
    if strict:
        out = {k: "error" if v == "warn" else v for k, v in out.items()}
    return out | dict(overrides or {})


def exempt_records(graph: SpecGraph, findings: DataFrame) -> DataFrame:
    """Without findings about declared logs, and about archived documents where the rule is of a closed round."""
    records = graph.nodes.where("phase = 'record'").select(F.col("id").alias("subject"), F.col("history").alias("logged"))
    joined = findings.withColumn("subject", F.get("nodes", F.lit(0))).join(records, "subject", "left")
    spared = ~F.col("rule").isin(*REFERENCE_RULES) & F.col("logged").isNotNull() & (F.col("logged") | F.col("rule").isin(*CLOSED_ROUND_RULES))
    return joined.where(~F.coalesce(spared, F.lit(False))).drop("subject", "logged")


def in_order(diagnostics: DataFrame) -> DataFrame:
    """Severity, place, rule, message."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_ORDER.items() for x in kv])[F.col("severity")]
    return diagnostics.orderBy(rank, "file", "line", "column", "rule", "message")


def run_rules(graph: SpecGraph, dangling: DataFrame | None = None, misread: DataFrame | None = None, severities: Mapping[str, str] | None = None, strict: bool = False, project: Sequence[ProjectRule] = (), max_related: int = MAX_RELATED) -> DataFrame:
    """All diagnostics: ``rule, severity, message, file, line, column, nodes, target, related, hint``, not in any order."""
    levels = resolve_severities(severities, strict, project)
    on = lambda *rules: any(levels.get(r) != "off" for r in rules)
    parts = []
    for rules, make in (
        (("ghost-handover",), ghost_handover), (("stale-premise",), stale_premise), (("circular-delegation",), circular_delegation), (("orphaned-obligation",), orphaned_obligation),
        (("live-supersession", "unreciprocated-supersession"), supersessions), (("state-conflict",), state_conflict), (("self-reference",), self_reference),
    ):
        if on(*rules):
            parts.append(make(graph))
    if dangling is not None and on(*REFERENCE_RULES[:3]):
        parts.append(references(dangling))
    if misread is not None and on("unknown-relation-key"):
        parts.append(misread_key(misread))
    parts += [project_findings(graph, r) for r in project if on(r.id)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    level = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])[F.col("rule")]
    out = exempt_records(graph, out).withColumn("severity", level).where("severity <> 'off'")
    return out.withColumn("related", F.slice("related", 1, max_related)).select("rule", "severity", "message", "file", "line", "column", "nodes", "target", "related", "hint")
