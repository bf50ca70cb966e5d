"""The path-selector language: parsed to a small tree, compiled to a DataFrame plan.

    query     := node step*
    node      := word? predicate*           (one of both at least)
    predicate := "[" key (op value)? "]"    op: = != ^= $= *= ~=
    step      := -kinds-> node | <-kinds- node | =kinds=> node | <=kinds= node
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.closure import shortest_paths
from tamarack.operators.graph import SpecGraph
from tamarack.plans.pattern import PatternError, found, java_pattern
from tamarack.vocab import EDGE_KINDS, NODE_WORDS


class QueryError(ValueError):
    def __init__(self, message: str, offset: int):
        super().__init__(f"{message} (at {offset})")
        self.message, self.offset = message, offset


@dataclass(frozen=True)
class Predicate:
    key: str
    operator: str
    value: str = ""


@dataclass(frozen=True)
class NodeMatcher:
    kind: str | None
    predicates: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Step:
    direction: str
    kinds: tuple[str, ...] | None
    transitive: bool
    node: NodeMatcher


@dataclass(frozen=True)
class Query:
    start: NodeMatcher
    steps: tuple[Step, ...] = ()


_TOKEN = {
    "word": re.compile(r"[A-Za-z]+|\*"),
    "key": re.compile(r"[A-Za-z_][A-Za-z0-9_.:-]*"),
    "operator": re.compile(r"!=|\^=|\$=|\*=|~=|="),
    "bare": re.compile(r"[^\]\s]*"),
    "space": re.compile(r"\s*"),
    "forward": re.compile(r"([-=])([A-Za-z,*-]*?)([-=])>"),
    "backward": re.compile(r"<([-=])([A-Za-z,*-]*)([-=])(?=\s|$|[A-Za-z*\[])"),
}


class _Parser:
    """Recursive descent over the text; ``at`` is where the next token begins."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def take(self, token: str) -> re.Match | None:
        m = _TOKEN[token].match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def next(self) -> str:
        return self.text[self.at : self.at + 1]

    def query(self) -> Query:
        start, steps = self.node(), []
        self.take("space")
        while self.at < len(self.text):
            steps.append(self.step())
            self.take("space")
        return Query(start, tuple(steps))

    def node(self) -> NodeMatcher:
        self.take("space")
        begin, kind = self.at, None
        if word := self.take("word"):
            name = word.group().lower()
            if name not in NODE_WORDS:
                raise QueryError(f'unknown node type "{word.group()}", expected document, item or *', begin)
            kind = NODE_WORDS[name]
        elif self.next() != "[":
            raise QueryError("expected a node type (document, item or *) or a [predicate]", begin)
        predicates = []
        while self.next() == "[":
            predicates.append(self.predicate())
        return NodeMatcher(kind, tuple(predicates))

    def predicate(self) -> Predicate:
        self.at += 1
        key = self.take("key")
        if not key:
            raise QueryError('expected an attribute name after "["', self.at)
        name = key.group().lower()
        if self.next() == "]":
            self.at += 1
            return Predicate(name, "exists")
        op = self.take("operator")
        if not op:
            raise QueryError(f'expected an operator (=, !=, ^=, $=, *=, ~=) or "]" after "{name}"', self.at)
        begin = self.at
        value = self.value()
        if self.next() != "]":
            raise QueryError('expected "]" to close the predicate', self.at)
        self.at += 1
        if op.group() == "~=":
            try:
                java_pattern(value)
            except PatternError as e:
                raise QueryError(str(e), begin + e.offset + (self.text[begin] in "\"'")) from None
        return Predicate(name, op.group(), value)

    def value(self) -> str:
        quote = self.next()
        if quote not in ("'", '"'):
            return self.take("bare").group()
        out, self.at = [], self.at + 1
        while self.at < len(self.text) and self.next() != quote:
            if self.next() == "\\":
                self.at += 1
            out.append(self.next())
            self.at += 1
        if self.at >= len(self.text):
            raise QueryError("unterminated quoted value", min(self.at, len(self.text)))
        self.at += 1
        return "".join(out)

    def step(self) -> Step:
        begin = self.at
        for token, direction, skip in (("forward", "out", 1), ("backward", "in", 2)):
            if m := self.take(token):
                if m.group(1) != m.group(3):
                    raise QueryError("mismatched arrow: -kind-> or <-kind- for one hop, =kind=> or <=kind= for any number", begin)
                return Step(direction, self.kinds(m.group(2), begin + skip), m.group(1) == "=", self.node())
        raise QueryError("expected a relation step such as -delegates-to->, <-assumes- or =supersedes=>", begin)

    @staticmethod
    def kinds(raw: str, offset: int) -> tuple[str, ...] | None:
        names = [] if raw == "*" else [k.lower() for k in raw.split(",") if k]
        for name in names:
            if name not in EDGE_KINDS:
                raise QueryError(f'unknown relation "{name}", expected one of: {", ".join(EDGE_KINDS)}', offset)
        return tuple(dict.fromkeys(names)) or None


def parse_query(text: str) -> Query:
    return _Parser(text).query()


# Predicates as Column expressions


def attribute(key: str) -> Column:
    """Values of an attribute as an array of strings; empty where a node has none."""
    one = lambda c: F.when(c.isNotNull(), F.array(c.cast("string"))).otherwise(F.array().cast("array<string>"))
    item = F.col("kind") == "item"
    own = lambda c: F.when(item, one(c)).otherwise(F.array().cast("array<string>"))
    if key in ("id", "kind", "title", "file", "line", "phase", "receptivity", "path", "document"):
        return one(F.col(key))
    if key == "status":
        return one(F.col("raw_status"))
    if key == "alias":
        return F.coalesce(F.col("aliases"), F.array().cast("array<string>"))
    if key in ("disposition", "openness", "text", "body", "evidence"):
        return own(F.col(key))
    if key == "state":
        return own(F.col("disposition"))
    if key == "section":
        return F.when(item, F.coalesce(F.col("section"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    if key == "conflicted":
        return own(F.when(F.coalesce(F.size("conflicts"), F.lit(0)) > 0, "true").otherwise("false"))
    if key.startswith("fm."):
        return F.when(item, F.array().cast("array<string>")).otherwise(F.coalesce(F.col("fm")[key[3:]], F.array().cast("array<string>")))
    return F.array().cast("array<string>")


#: Attributes with exactly one value on every node: compared without an array.
_SCALAR = {"id": "id", "kind": "kind", "title": "title", "file": "file", "document": "document", "phase": "phase", "receptivity": "receptivity"}


def _test(p: Predicate, v: Column) -> Column:
    needle = F.lit(p.value.lower())
    match p.operator:
        case "exists":
            return F.length(v) > 0
        case "=" | "!=":
            return F.lower(v) == needle
        case "^=":
            return F.startswith(F.lower(v), needle)
        case "$=":
            return F.endswith(F.lower(v), needle)
        case "*=":
            return F.contains(F.lower(v), needle)
    raise ValueError(p.operator)


def predicate(p: Predicate) -> Column:
    """Whether some value passes; ``!=`` whether none is equal, so that an absent attribute passes."""
    if p.operator == "~=":
        return found(p.value, F.col(_SCALAR[p.key]) if p.key in _SCALAR else attribute(p.key), p.key not in _SCALAR)
    if p.key in _SCALAR:
        hit = F.coalesce(_test(p, F.col(_SCALAR[p.key])), F.lit(False))
    else:
        hit = F.exists(attribute(p.key), lambda v: _test(p, v))
    return ~hit if p.operator == "!=" else hit


def matcher(m: NodeMatcher) -> Column:
    out = F.lit(True) if m.kind is None else F.col("kind") == m.kind
    for p in m.predicates:
        out = out & predicate(p)
    return out


# Execution


def _hop(graph: SpecGraph, paths: DataFrame, tails: DataFrame, step: Step, allow_reflexive: bool) -> DataFrame:
    """``tail, head, walked``: what one step reaches from each tail."""
    here, there = ("from", "to") if step.direction == "out" else ("to", "from")
    edges = graph.edges if step.kinds is None else graph.edges.where(F.col("kind").isin(*step.kinds))
    if not step.transitive:
        kept = edges if allow_reflexive else edges.where(~F.col("reflexive"))
        return kept.select(F.col(here).alias("tail"), F.col(there).alias("head"), F.array("edge_ord").alias("walked"), F.array("edge_ord").alias("rank"))
    reached = shortest_paths(tails, edges.select(F.col(here).alias("a"), F.col(there).alias("b"), "edge_ord", "reflexive"))
    kept = reached if allow_reflexive else reached.where("moved")
    return kept.select(F.col("start").alias("tail"), F.col("end").alias("head"), F.col("path").alias("walked"), F.concat(F.array(F.size("path").cast("bigint")), F.col("path")).alias("rank"))


def execute(graph: SpecGraph, query: Query | str, limit: int | None = None, allow_reflexive: bool = False) -> DataFrame:
    """``nodes array<string>, edges array<bigint>``: each match's nodes (the start and one a step) and the edges it walked.

    Steps run left to right.  Of several edges between the same nodes the first
    counts, so that a sequence of nodes is matched once.  ``limit`` keeps the
    first so many paths of each step in the order of nodes and edges; the start
    is not limited.
    """
    query = parse_query(query) if isinstance(query, str) else query
    start = graph.nodes.where(matcher(query.start))
    order = F.array("node_ord") if limit else F.lit(None).cast("array<bigint>")
    paths = start.select(F.array("id").alias("nodes"), F.array().cast("array<bigint>").alias("edges"), F.col("id").alias("tail"), order.alias("rank"))
    for step in query.steps:
        tails = paths.select("tail").distinct() if step.transitive else paths
        hop = _hop(graph, paths, tails, step, allow_reflexive).withColumnRenamed("rank", "hop_rank")
        if step.node.kind is not None or step.node.predicates:
            hop = hop.join(graph.nodes.where(matcher(step.node)).select(F.col("id").alias("head")), "head", "left_semi")
        rank = F.concat("rank", "hop_rank") if limit else F.col("rank")
        paths = paths.join(hop, "tail").select(F.concat("nodes", F.array("head")).alias("nodes"), F.concat("edges", "walked").alias("edges"), F.col("head").alias("tail"), rank.alias("rank"))
        if not step.transitive and (step.kinds is None or len(step.kinds) > 1):
            # Edges are unique in (kind, from, to): one kind can't join two nodes twice.
            paths = paths.groupBy("nodes").agg(F.min("edges").alias("edges"), F.first("tail").alias("tail"), F.min("rank").alias("rank"))
        if limit:
            paths = paths.orderBy("rank").limit(limit)
    return paths.select("nodes", "edges")


def union(graph: SpecGraph, queries: list[Query | str], **options) -> DataFrame:
    """Matches of several selectors; a sequence of nodes that more than one finds is given once, as the first finds it."""
    out = None
    for k, q in enumerate(queries):
        one = execute(graph, q, **options).withColumn("query", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("nodes").agg(F.min_by("edges", "query").alias("edges"))


def render(graph: SpecGraph, matches: DataFrame) -> DataFrame:
    """``matches`` with ``text``: the walk as ``a -kind-> b <-kind- c``."""
    edge = graph.edges.select("edge_ord", "kind", "from", "to")
    match = ["nodes", "edges"]
    steps = matches.select(*match, F.posexplode("edges").alias("pos", "edge_ord")).join(edge, "edge_ord")
    gathered = steps.groupBy(*match).agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "from", "to"))).alias("hops"))
    begin = F.struct(F.col("nodes")[0].alias("at"), F.col("nodes")[0].alias("text"))

    def go(acc: Column, e: Column) -> Column:
        forward = e["from"] == acc["at"]
        at = F.when(forward, e["to"]).otherwise(e["from"])
        arrow = F.when(forward, F.concat(F.lit(" -"), e["kind"], F.lit("-> "))).otherwise(F.concat(F.lit(" <-"), e["kind"], F.lit("- ")))
        return F.struct(at.alias("at"), F.concat(acc["text"], arrow, at).alias("text"))

    text = F.aggregate(F.coalesce("hops", F.array().cast("array<struct<pos:int,kind:string,from:string,to:string>>")), begin, go)["text"]
    return matches.join(gathered, match, "left").select("nodes", "edges", text.alias("text"))
