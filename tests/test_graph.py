"""Traversal, components, baselines, intervals, exports and the command line, against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tamarack.cli import main
from tamarack.operators import baseline as B
from tamarack.operators import diff as D
from tamarack.operators.closure import shortest_paths
from tamarack.operators.cycles import components, strong_components
from tamarack.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, SpecGraph
from tamarack.operators.intervals import innermost
from tamarack.plans import report, rules
from tamarack.plans.selector import execute, union
from tamarack.sources.exports import FormatError, baseline_json, read_baseline, read_graph_export


def make_graph(spark, phases, edges):
    """Documents with phases, and (kind, from, to) edges in order."""
    nodes = [{"id": i, "kind": "document", "title": i, "file": f"{i}.md", "line": 1, "path": f"{i}.md", "aliases": [i.lower()], "phase": p, "receptivity": "sealed" if p in ("retired", "frozen", "record") else "receptive", "history": False, "raw_status": p, "fm": {"o": [p]}, "document": i, "declared": True, "status_line": 1, "status_column": 1, "column": 1, "node_ord": k} for k, (i, p) in enumerate(phases.items())]
    rows = [{"kind": k, "from": a, "to": b, "origin": "link", "file": f"{a}.md", "line": 1, "column": 1, "raw": "", "declared_in": [f"{a}.md"], "reflexive": a == b, "edge_ord": n} for n, (k, a, b) in enumerate(edges)]
    return SpecGraph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(rows, EDGE_SCHEMA))


def brute_paths(edges, start):
    """Breadth first; a start is its own end by the first way back."""
    after = {}
    for n, (a, b) in enumerate(edges):
        after.setdefault(a, []).append((n, b))
    paths, queue = {}, [(start, ())]
    while queue:
        node, path = queue.pop(0)
        for n, b in after.get(node, []):
            if b not in paths:
                paths[b] = (*path, n)
                if b != start:
                    queue.append((b, (*path, n)))
    return paths


@pytest.mark.parametrize("seed", range(3))
def test_shortest_paths(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(22)]
    df = spark.createDataFrame([(a, b, n, a == b) for n, (a, b) in enumerate(edges)], "a string, b string, edge_ord bigint, reflexive boolean")
    starts = spark.createDataFrame([(f"n{k}",) for k in range(12)], "id string")
    want = {(f"n{k}", e): p for k in range(12) for e, p in brute_paths(edges, f"n{k}").items()}
    for small in (1000, 0):
        rows = shortest_paths(starts, df, small=small).collect()
        assert {(r.start, r.end): tuple(r.path) for r in rows} == want
        assert all(r.moved == any(edges[n][0] != edges[n][1] for n in r.path) for r in rows)


@pytest.mark.parametrize("seed", range(2))
def test_components_small_and_in_rounds(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)} | {("n1", "n1"), ("z0", "z0")})
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for p, q in edges:
                if p == x and q not in seen:
                    seen.add(q)
                    todo.append(q)
        reach[a] = seen
    want = {(min([a, *(b for b in reach[a] if a in reach[b])]), a) for a in reach if a in reach[a]}
    df = spark.createDataFrame(edges, "a string, b string")
    for small in (10**6, 0):
        assert {(r.component, r.node) for r in components(df, small).collect()} == want
    assert sorted(map(sorted, strong_components([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)]))) == [[1, 2], [3, 4]]


def test_selector_semantics(spark):
    g = make_graph(spark, {"A": "active", "B": "retired", "C": "draft"}, [("amends", "A", "B"), ("depends-on", "A", "B"), ("depends-on", "B", "C"), ("depends-on", "C", "A"), ("references", "A", "A")])
    ids = lambda m: sorted(tuple(r.nodes) for r in m.collect())
    assert [tuple(r.edges) for r in execute(g, "[id=A] -*-> *").collect()] == [(0,)]
    assert ids(execute(g, "[id=A] =*=> *")) == [("A", "B"), ("A", "C")]  # the shortest way back to A is reflexive
    assert ids(execute(g, "[id=A] =references=> *")) == []
    assert ids(execute(g, "[id=A] =references=> *", allow_reflexive=True)) == [("A", "A")]
    assert ids(execute(g, "document[fm.o=draft] <=depends-on= [phase!=active]")) == [("C", "B"), ("C", "C")]
    assert len(execute(g, "* -depends-on-> *", limit=2).collect()) == 2
    assert ids(union(g, ["[id=A]", "*[phase=active]", "[id=B]"])) == [("A",), ("B",)]


def test_cycles_and_hand_offs(spark):
    g = make_graph(spark, {"A": "active", "B": "active", "C": "active", "D": "active"}, [("delegates-to", "A", "B"), ("delegates-to", "B", "A"), ("delegates-to", "C", "D"), ("blocked-by", "D", "C"), ("supersedes", "D", "C")])
    found = rules.circular_delegation(g).collect()
    assert [(r.nodes, r.message) for r in found] == [(["A", "B"], "delegation cycle across 2 documents: nothing in it can ever land")]
    assert len(found[0].related) == 2
    off = rules.run_rules(g, severities={"circular-delegation": "off"}).collect()
    assert {r.rule for r in off} == {"live-supersession"}


def test_baseline_round_trip(spark, tmp_path):
    g = make_graph(spark, {"A": "active", "B": "retired", "C": "active"}, [("depends-on", "A", "B"), ("depends-on", "C", "B"), ("assumes", "A", "B")])
    found = rules.run_rules(g)
    (tmp_path / "b.json").write_text(baseline_json(B.tally(found)))
    entries, problems = read_baseline(spark, str(tmp_path / "b.json"))
    assert not problems and sorted(tuple(r) for r in entries.collect()) == sorted(tuple(r) for r in B.tally(found).collect())
    assert B.apply_baseline(found, entries, ["file", "message"]).where("kept").count() == 0
    fewer = entries.where("document = 'A'").withColumn("count", F.lit(1).cast("bigint"))
    kept = B.apply_baseline(found, fewer, ["file", "message"]).where("kept").collect()
    assert sorted((r.document, r.message) for r in kept) == [("C", "C depends on B, which no longer holds")]  # A's two edges to B are one match
    more = spark.createDataFrame([("stale-premise", "A", "B", 5), ("stale-premise", "Z", "B", 1)], entries.schema)
    assert {(r.document, r.surplus, r.reason) for r in B.stale_entries(found, more, g.documents).collect()} == {("A", 4, "paid"), ("Z", 1, "gone")}
    (tmp_path / "bad.json").write_text('{"version": 1, "findings": [{"rule": 1}, {"rule": "a", "document": "b"}]}')
    assert len(read_baseline(spark, str(tmp_path / "bad.json"))[1]) == 1
    (tmp_path / "worse.json").write_text("[")
    assert read_baseline(spark, str(tmp_path / "worse.json"))[0].count() == 0


def test_exports_and_diff(spark, tmp_path):
    g = make_graph(spark, {"A": "active", "B": 'retired', "C": "active"}, [("depends-on", "A", "B"), ("supersedes", "C", "B")])
    for name, graph in (("a", SpecGraph(g.nodes.where("id <> 'C'"), g.edges.where("kind <> 'supersedes'"))), ("b", g)):
        out = {"version": 1, "nodes": [], "edges": []}
        for r in report.graph_json(graph).collect():
            out[r.table].append(json.loads(r.json))
        (tmp_path / f"{name}.json").write_text(json.dumps(out))
    a, b = (read_graph_export(spark, str(tmp_path / f"{n}.json")) for n in "ab")
    assert {(r.id, r.change) for r in D.documents(a, b).collect()} == {("C", "added")}
    assert [(r.change, r.kind, r["from"], r.to) for r in D.relations(a, b).collect()] == [("added", "supersedes", "C", "B")]
    (tmp_path / "c.json").write_text('{"nodes": 1}')
    with pytest.raises(FormatError):
        read_graph_export(spark, str(tmp_path / "c.json"))
    text = [r.text for r in report.graph_lines(g).orderBy("part", "ord").collect()]
    assert text[0] == "digraph specs {" and '  "A" -> "B" [label="depends-on"];' in text and text[-1] == "}"
    found = rules.run_rules(g)
    from tamarack.plans.analysis import summary

    run = report.Run(summary(g, found).first(), ("stale-premise",), "base.json", 2, 3, 1, True, 4, True)
    sarif = json.loads("\n".join(report.sarif(found, run)))
    rules_of = sarif["runs"][0]["tool"]["driver"]["rules"]
    assert [r["id"] for r in rules_of] == sorted({r.rule for r in found.collect()}) and all(r["shortDescription"]["text"] and r["defaultConfiguration"]["level"] in ("error", "warning", "note") for r in rules_of)
    results = sarif["runs"][0]["results"]
    assert len(results) == found.count() and all(rules_of[r["ruleIndex"]]["id"] == r["ruleId"] and r["properties"]["escalated"] == (r["ruleId"] == "stale-premise") for r in results)
    whole = json.loads("\n".join(report.json_report(found, run, spark.createDataFrame([("b.md",), ('a "q".md',)], "path string"))))
    assert whole["version"] == 1 and not whole["ok"] and whole["summary"]["errors"] == run.counts.errors and whole["files"] == ['a "q".md', "b.md"] and len(whole["diagnostics"]) == found.count() and whole["problems"] == []
    for colour, plain in ((False, True), (True, False)):
        text = "\n".join(report.human(found, run, 1, colour, plain))
        assert "4 front-matter values not read" in text and "3 baseline entries no longer occur - 1 of them" in text and "2 accepted by base.json" in text and text.endswith("the specification graph is inconsistent") and ("\x1b[" in text) == colour
        assert f"... and {found.count() - 1} more" in text
    table = "\n".join(report.markdown(found, run))
    assert table.startswith("### tamarack\n\nThe specification graph is inconsistent.") and table.count("<br>") == found.count() and "(strict)" in table
    assert report.annotations(found).first().text.startswith("::")
    assert {json.loads(r.json)["severity"] for r in report.code_quality(found).collect()} <= {"critical", "minor", "info"}
    assert json.loads(report.json_lines(found).first().json)["line"] == 1


def test_innermost_intervals(spark):
    rng = random.Random(4)
    spans = [(rng.randrange(3), n, b, b + rng.randrange(0, 30)) for n, b in enumerate(rng.randrange(100) for _ in range(40))]
    points = [(rng.randrange(3), at) for at in range(110)]
    got = {(r.g, r.at): r.id for r in innermost(spark.createDataFrame(points, "g int, at int"), spark.createDataFrame(spans, "g int, id int, begin int, end int"), ["g"], ["g", "at"], 8).collect()}
    for g, at in points:
        inside = [s for s in spans if s[0] == g and s[2] <= at < s[3]]
        assert (g, at) in got if inside else (g, at) not in got
        if inside:
            best = max(inside, key=lambda s: (s[2], -s[3]))
            assert [(s[2], s[3]) for s in spans if s[1] == got[g, at]] == [(best[2], best[3])]


def test_command_line(spark, tmp_path, capsys):
    docs = tmp_path / "docs" / "adr"
    docs.mkdir(parents=True)
    (docs / "0001-a.md").write_text("---\nstatus: accepted\n---\n# ADR-0001\n\nThis depends on [b](0002-b.md).\n")
    (docs / "0002-b.md").write_text("---\nstatus: rejected\n---\n# ADR-0002\n")
    root = ["--root", str(tmp_path), "--no-config"]
    assert main(["query", *root, "document -depends-on-> *"], spark) == 0
    assert capsys.readouterr().out.strip() == "ADR-0001 -depends-on-> ADR-0002"
    assert main(["query", *root, "document[id=zz]"], spark) == 1 and main(["query", *root, "thing"], spark) == 2
    assert main(["check", *root], spark) == 1 and "stale-premise" in capsys.readouterr().out
    assert main(["check", *root, "--record-baseline", str(tmp_path / "b.json")], spark) == 0
    assert main(["check", *root, "--baseline", str(tmp_path / "b.json"), "--format", "json"], spark) == 0
    assert main(["check", *root, "--rule", "stale-premise=off"], spark) == 0 and main(["check", *root, "--rule", "x=y"], spark) == 2
    for wrong in (["--config", "x", "--no-config"], ["--record-baseline", "a", "--baseline", "b"], ["--max", "-1"], ["--ascii", "--format", "json"], ["--family", "adr", "--ignore-family", "ADR"], ["--family", "NOSUCH"]):
        assert main(["check", *root, *wrong], spark) == 2, wrong
    capsys.readouterr()
    assert main(["check", *root, "--format", "json"], spark) == 1 and json.loads(capsys.readouterr().out)["version"] == 1
    assert main(["check", *root, "--format", "sarif"], spark) == 1 and json.loads(capsys.readouterr().out)["version"] == "2.1.0"
    assert main(["check", *root, "--format", "gitlab"], spark) == 1 and all(r["fingerprint"] for r in json.loads(capsys.readouterr().out))
    assert main(["graph", *root, "--graph-format", "json"], spark) == 0
    (tmp_path / "export.json").write_text(capsys.readouterr().out)
    for form, start in (("text", "No relational change."), ("markdown", "### tamarack diff"), ("json", "{")):
        assert main(["diff", str(tmp_path / "export.json"), str(tmp_path / "export.json"), "--format", form], spark) == 0 and capsys.readouterr().out.startswith(start)
    assert main(["rules", "stale-premise", "--explain"], spark) == 0 and "rests on" in capsys.readouterr().out
    assert main(["rules", "self-reference"], spark) == 0 and main(["graph", *root, "--graph-format", "mermaid", "--documents-only"], spark) == 0
    assert "graph LR" in capsys.readouterr().out
