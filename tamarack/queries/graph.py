"""Selectors, traversal, graph algorithms and diagnostics over the graph of the order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.operators.cycles import components
from tamarack.operators.graph import SpecGraph, lifted, unique_edges, with_known_ends, with_owners
from tamarack.plans import rules
from tamarack.plans.selector import execute, parse_query, render, union
from tamarack.sources.tables import order_graph
from tamarack.vocab import EDGE_TRAITS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GRAPH_SQL = """
WITH RECURSIVE docs AS (
  SELECT o_orderkey AS k, 'ORD-' || o_orderkey AS id, 'orders/' || o_custkey || '/' || o_orderkey AS path,
         CASE WHEN o_orderstatus = 'O' THEN 'accepted' WHEN o_orderstatus = 'F' THEN 'superseded' WHEN o_orderpriority LIKE '1%' THEN 'Archived'
              WHEN o_orderpriority LIKE '2%' THEN '*Final*' WHEN o_orderpriority LIKE '3%' THEN 'on hold' ELSE 'draft' END AS raw_status,
         CASE WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderstatus = 'F' THEN 'retired' WHEN o_orderpriority LIKE '1%' THEN 'record'
              WHEN o_orderpriority LIKE '2%' THEN 'frozen' WHEN o_orderpriority LIKE '3%' THEN 'unknown' ELSE 'draft' END AS phase,
         o_orderpriority AS priority, o_custkey AS cust, o_orderdate AS date FROM orders),
docs2 AS MATERIALIZED (SELECT *, CASE WHEN phase IN ('draft', 'active') THEN 'receptive' WHEN phase = 'unknown' THEN 'unknown' ELSE 'sealed' END AS receptivity,
                 phase = 'record' AND cust % 2 = 0 AS history FROM docs),
lines AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n,
                 l_linestatus || l_returnflag AS code, l_returnflag AS flag, l_partkey AS part, l_discount AS discount FROM lineitem),
items AS MATERIALIZED (SELECT *, 'ORD-' || k || '#line.' || n AS id, 'line ' || n || ' part ' || part AS text,
                 CASE code WHEN 'ON' THEN 'unresolved' WHEN 'OA' THEN 'delegated' WHEN 'OR' THEN 'narrowed' WHEN 'FN' THEN 'satisfied' WHEN 'FA' THEN 'accepted-debt' ELSE 'obviated' END AS disposition,
                 CASE WHEN code IN ('ON', 'OA') THEN 'open' WHEN code = 'OR' THEN 'partial' ELSE 'closed' END AS openness FROM lines),
nodes AS MATERIALIZED (
  SELECT id, 'document' AS kind, id AS document, k, 0 AS n, path, phase, receptivity, history, raw_status, priority AS title, priority, cust, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS flag, CAST(NULL AS VARCHAR) AS disposition, CAST(NULL AS VARCHAR) AS openness, false AS conflicted, k * 1000 AS node_ord FROM docs2
  UNION ALL
  SELECT i.id, 'item', 'ORD-' || i.k, i.k, i.n, d.path, d.phase, d.receptivity, d.history, d.raw_status, i.text, NULL, NULL, i.text, i.flag, i.disposition, i.openness, i.disposition = 'obviated' AND i.discount > 0.05, i.k * 1000 + i.n FROM items i JOIN docs2 d ON i.k = d.k),
linked AS MATERIALIZED (SELECT k, cust, path, k - k % 10 + ((k % 10) * (k % 10) + 1) % 10 AS f, lag(k) OVER (PARTITION BY cust ORDER BY date, k) AS prev FROM docs2),
edges AS MATERIALIZED (
  SELECT 'contains' AS kind, 'ORD-' || k AS f, id AS t, false AS reflexive, (CAST(1 AS BIGINT) << 50) + k * 1000 + n AS edge_ord, 'ORD-' || k AS file, false AS both_say FROM items
  UNION ALL SELECT 'supersedes', 'ORD-' || k, 'ORD-' || prev, false, (CAST(2 AS BIGINT) << 50) + k, path, k % 2 = 0 FROM linked WHERE prev IS NOT NULL
  UNION ALL SELECT 'depends-on', 'ORD-' || k, 'ORD-' || f, false, (CAST(3 AS BIGINT) << 50) + k, path, false FROM linked
  UNION ALL SELECT 'delegates-to', i.id, 'ORD-' || l.f, false, (CAST(4 AS BIGINT) << 50) + i.k * 1000 + i.n, 'ORD-' || i.k, false FROM items i JOIN linked l ON i.k = l.k WHERE disposition = 'delegated'
  UNION ALL SELECT 'references', id, 'ORD-' || k, true, (CAST(5 AS BIGINT) << 50) + k * 1000 + n, 'ORD-' || k, false FROM items WHERE disposition = 'narrowed')
"""


def query(name: str, sql: str | None, prefix: str = GRAPH_SQL):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = prefix + sql
        return f

    return put


def over_graph(name: str, sql: str | None):
    """Registers a function of the graph."""
    return lambda f: query(name, sql)(lambda spark, sf_dir: f(order_graph(spark, sf_dir))) and f


def flat(matches: DataFrame, n: int, walked: bool = True) -> DataFrame:
    cols = [F.col("nodes")[i].alias(f"n{i}") for i in range(n)]
    return matches.select(*cols, *([F.array_join(F.col("edges").cast("array<string>"), ",").alias("walked")] if walked else []))


def selector(name: str, text: str, sql: str, n: int = 1, **options) -> None:
    over_graph(name, sql)(lambda g: flat(execute(g, text, **options), n, n > 1))


# 2.4 predicates

selector("sel_kind_filter", "document", "SELECT id AS n0 FROM nodes WHERE kind = 'document'")
selector("sel_eq", "item[state=OBVIATED]", "SELECT id AS n0 FROM nodes WHERE kind = 'item' AND disposition = 'obviated'")
selector("sel_neq_absent", "*[openness!=closed]", "SELECT id AS n0 FROM nodes WHERE openness IS DISTINCT FROM 'closed'")
selector("sel_prefix", "document[title^=1-urg]", "SELECT id AS n0 FROM nodes WHERE kind = 'document' AND lower(title) LIKE '1-urg%'")
selector("sel_suffix", "item[text$='7']", "SELECT id AS n0 FROM nodes WHERE kind = 'item' AND text LIKE '%7'")
selector("sel_contains", "item[body*='FLAG r']", "SELECT id AS n0 FROM nodes WHERE kind = 'item' AND flag = 'R'")
selector("sel_regex", r"document[title~='^[12]-(urgent|high)$']", "SELECT id AS n0 FROM nodes WHERE kind = 'document' AND regexp_matches(lower(title), '^[12]-(urgent|high)$')")
selector("sel_regex_repeats", r"document[title~='^(?:[1-5]+-)+.*(ent|igh)$']", "SELECT id AS n0 FROM nodes WHERE kind = 'document' AND regexp_matches(lower(title), '^([1-5]+-)+.*(ent|igh)$')")
selector("sel_exists", "node[section]", "SELECT id AS n0 FROM nodes WHERE kind = 'item'")
selector("sel_fm", "document[fm.priority=1-URGENT]", "SELECT id AS n0 FROM nodes WHERE priority = '1-URGENT'")
selector("sel_multivalue", "document[fm.tags=2][fm.tags!=draft]", "SELECT id AS n0 FROM nodes WHERE kind = 'document' AND priority LIKE '2%' AND raw_status <> 'draft'")
selector("sel_item_inherits", "item[phase=retired][receptivity=sealed][path^='orders/1']", "SELECT id AS n0 FROM nodes WHERE kind = 'item' AND phase = 'retired' AND path LIKE 'orders/1%'")
selector("sel_status_alias", "*[status*=final][alias$=1]", "SELECT id AS n0 FROM nodes WHERE raw_status = '*Final*' AND k % 10 = 1")
selector("sel_conjunction", "item[openness=open][state!=delegated][section=Lines][conflicted=false]", "SELECT id AS n0 FROM nodes WHERE disposition = 'unresolved'")
selector("sel_unknown_key", "document[nothing!=x]", "SELECT id AS n0 FROM nodes WHERE kind = 'document'")

# 2.5 steps

HOP = "SELECT a.id AS n0, b.id AS n1, CAST(min(e.edge_ord) AS VARCHAR) AS walked FROM edges e JOIN nodes a ON a.id = e.{h} JOIN nodes b ON b.id = e.{t} WHERE NOT e.reflexive AND {w} GROUP BY 1, 2"
hop = lambda w, h="f", t="t": HOP.format(w=w, h=h, t=t)
FLAGSHIP = "document[receptivity=sealed] -contains-> item[openness!=closed]"
selector("step_out", FLAGSHIP, hop("e.kind = 'contains' AND a.receptivity = 'sealed' AND b.openness <> 'closed'"), 2)
selector("step_in", "document[phase=active] <-delegates-to- item[fm.x!=1]", hop("e.kind = 'delegates-to' AND a.phase = 'active'", "t", "f"), 2)
selector("step_multi_kind", "document -supersedes,depends-on-> document[phase=retired]", hop("e.kind IN ('supersedes', 'depends-on') AND a.kind = 'document' AND b.phase = 'retired'"), 2)
selector("step_any_kind", "document[fm.priority=1-URGENT] -*-> document", hop("a.priority = '1-URGENT' AND b.kind = 'document'"), 2)
selector("step_reflexive_excluded", "item[openness!=closed] -*-> *", hop("a.kind = 'item' AND a.openness <> 'closed'"), 2)
selector("step_reflexive_allowed", "item[openness=partial] -*-> *", hop("a.openness = 'partial'").replace("NOT e.reflexive AND ", ""), 2, allow_reflexive=True)
selector("step_dedupe", "document -depends-on,supersedes-> *", hop("e.kind IN ('supersedes', 'depends-on')"), 2)
selector("step_chain", "document[phase=draft] -contains-> item -delegates-to-> document[phase!=active]",
         "SELECT a.id AS n0, b.id AS n1, c.id AS n2, e.edge_ord || ',' || f.edge_ord AS walked FROM nodes a JOIN edges e ON e.f = a.id AND e.kind = 'contains' JOIN nodes b ON b.id = e.t JOIN edges f ON f.f = b.id AND f.kind = 'delegates-to' JOIN nodes c ON c.id = f.t WHERE a.phase = 'draft' AND a.kind = 'document' AND c.phase <> 'active'", 3)
selector("step_limit", "document -depends-on-> document", "SELECT f AS n0, t AS n1, CAST(edge_ord AS VARCHAR) AS walked FROM edges WHERE kind = 'depends-on' ORDER BY edge_ord LIMIT 500", 2, limit=500)

# depends-on has one way on from each node: a walk of up to ten steps is the only path.
WALK = """, walk AS (
  SELECT f AS s, t AS e, CAST(edge_ord AS VARCHAR) AS p, 1 AS depth FROM edges WHERE kind = '{kind}'
  UNION ALL SELECT w.s, x.t, {path}, depth + 1 FROM walk w JOIN edges x ON x.f = w.e AND x.kind = '{kind}' WHERE depth < {most} AND w.s <> w.e),
best AS (SELECT s, e, arg_min(p, depth) AS p, min(depth) AS depth FROM walk GROUP BY s, e)
"""
walk = lambda kind, path="p || ',' || x.edge_ord", most=10: WALK.format(kind=kind, path=path, most=most)
selector("trans_out", "document[phase=retired] =depends-on=> document[phase=active]",
         walk("depends-on") + "SELECT s AS n0, e AS n1, p AS walked FROM best JOIN nodes a ON a.id = s JOIN nodes b ON b.id = e WHERE a.phase = 'retired' AND b.phase = 'active'", 2)
selector("trans_in", "document[phase=frozen] <=depends-on= document", walk("depends-on", "p || ',' || x.edge_ord").replace("best AS", "best0 AS") + """, turned AS (
  SELECT t AS s, f AS e, CAST(edge_ord AS VARCHAR) AS p, 1 AS depth FROM edges WHERE kind = 'depends-on'
  UNION ALL SELECT w.s, x.f, p || ',' || x.edge_ord, depth + 1 FROM turned w JOIN edges x ON x.t = w.e AND x.kind = 'depends-on' WHERE depth < 10 AND w.s <> w.e)
SELECT s AS n0, e AS n1, arg_min(p, depth) AS walked FROM turned JOIN nodes a ON a.id = s WHERE a.phase = 'frozen' GROUP BY 1, 2""", 2)
selector("trans_cycle_self", "document =depends-on=> document", walk("depends-on") + "SELECT s AS n0, e AS n1, p AS walked FROM best", 2)


@over_graph("trans_evidence_path", walk("supersedes", most=40) + "SELECT s AS n0, e AS n1, p AS walked FROM best JOIN nodes a ON a.id = s WHERE a.title LIKE '1%'")
def _chains(g):
    return flat(execute(g, "document[title^=1] =supersedes=> document"), 2)


@over_graph("trans_then_step", walk("depends-on") + "SELECT b.s AS n0, b.e AS n1, e.t AS n2, b.p || ',' || e.edge_ord AS walked FROM best b JOIN nodes a ON a.id = b.s JOIN edges e ON e.f = b.e AND e.kind = 'contains' JOIN nodes c ON c.id = e.t WHERE a.phase = 'draft' AND c.openness = 'partial'")
def _then(g):
    return flat(execute(g, "document[phase=draft] =depends-on=> document -contains-> item[openness=partial]"), 3)


@over_graph("selector_union", "SELECT id AS n0 FROM nodes WHERE kind = 'document' AND (phase = 'retired' OR title LIKE '5%')")
def _union(g):
    return flat(union(g, ["document[phase=retired]", "document[title^=5]"]), 1, False)


@over_graph("match_rendering", "SELECT f || ' -' || kind || '-> ' || t AS text FROM edges WHERE kind = 'depends-on' UNION ALL SELECT t || ' <-' || e.kind || '- ' || f FROM edges e JOIN nodes a ON a.id = t WHERE e.kind = 'supersedes' AND a.phase = 'frozen'")
def _rendered(g):
    return render(g, execute(g, "document -depends-on-> document")).select("text").unionAll(render(g, execute(g, "document[phase=frozen] <-supersedes- document")).select("text"))


# 2.5 graph algorithms

RING = walk("depends-on") + ", ring AS (SELECT s FROM best WHERE s = e) "


@over_graph("scc_depends_on", RING + "SELECT min(b.s) AS component, b.e AS node FROM best b JOIN ring a ON a.s = b.s JOIN ring c ON c.s = b.e GROUP BY 2")
def _scc(g):
    e = g.edges.where("kind = 'depends-on'")
    return components(e.select(F.col("from").alias("a"), F.col("to").alias("b")))


LIFT = """, own AS (SELECT *, split_part(f, '#', 1) AS fd, split_part(t, '#', 1) AS td FROM edges)
, lift AS (SELECT kind, fd, td, min(edge_ord) AS edge_ord FROM own WHERE fd <> td GROUP BY 1, 2, 3)
"""


@over_graph("scc_documents", LIFT + """, w AS (SELECT fd AS s, td AS e, 1 AS depth FROM lift WHERE kind = 'delegates-to'
  UNION ALL SELECT w.s, x.td, depth + 1 FROM w JOIN lift x ON x.fd = w.e AND x.kind = 'delegates-to' WHERE depth < 10 AND w.s <> w.e),
ring AS (SELECT DISTINCT s FROM w WHERE s = e)
SELECT min(w.s) AS component, w.e AS node FROM w JOIN ring a ON a.s = w.s JOIN ring c ON c.s = w.e GROUP BY 2""")
def _scc_documents(g):
    e = lifted(g, ["delegates-to"])
    return components(e.select(F.col("from").alias("a"), F.col("to").alias("b")))


@over_graph("lift_documents_only", LIFT + "SELECT kind, fd AS \"from\", td AS \"to\", edge_ord FROM lift")
def _lift(g):
    return lifted(g)


@over_graph("owner_lookup", "SELECT edge_ord, split_part(f, '#', 1) AS from_document, split_part(t, '#', 1) AS to_document FROM edges WHERE kind <> 'contains'")
def _owners(g):
    return with_owners(g, g.edges.where("kind <> 'contains'")).select("edge_ord", "from_document", "to_document")


@over_graph("fk_filter", "SELECT e.edge_ord FROM edges e JOIN nodes a ON a.id = e.f JOIN nodes b ON b.id = e.t WHERE a.phase <> 'retired' AND b.phase <> 'retired'")
def _fk(g):
    return with_known_ends(g.nodes.where("phase <> 'retired'"), g.edges).select("edge_ord")


@over_graph("edge_dedupe_declared_in", LIFT + "SELECT kind, fd AS \"from\", td AS \"to\", min(edge_ord) AS edge_ord, string_agg(f, ',' ORDER BY edge_ord) AS declared_in FROM own WHERE kind = 'delegates-to' GROUP BY 1, 2, 3")
def _dedupe(g):
    raw = with_owners(g, g.edges.where("kind = 'delegates-to'")).select("kind", F.col("from_document").alias("from"), F.col("to_document").alias("to"), "edge_ord", F.col("from").alias("file"))
    return unique_edges(raw.withColumn("declared_in", F.lit(None))).select("kind", "from", "to", "edge_ord", F.array_join("declared_in", ",").alias("declared_in"))


HANDED = ", handed AS (SELECT DISTINCT e.f FROM edges e JOIN nodes b ON b.id = e.t WHERE e.kind = 'delegates-to' AND b.receptivity <> 'sealed') "


@over_graph("handed_on_anti", HANDED + "SELECT id, openness FROM nodes WHERE kind = 'item' AND openness <> 'closed' AND NOT EXISTS (SELECT 1 FROM handed h WHERE h.f = id)")
def _handed(g):
    return g.items.where("openness <> 'closed'").join(rules.handed_on(g), "id", "left_anti").select("id", "openness")


HAND_OFF = LIFT + ", succ AS (SELECT DISTINCT td AS fd, fd AS td FROM own WHERE kind = 'supersedes') , kept AS (SELECT o.* FROM own o LEFT JOIN succ s ON s.fd = o.fd AND s.td = o.td WHERE NOT (o.kind IN ('delegates-to', 'blocked-by') AND s.fd IS NOT NULL)) "


@over_graph("handoff_anti", HAND_OFF + "SELECT edge_ord FROM kept")
def _hand_offs(g):
    return rules.without_hand_offs(g).select("edge_ord")


@query("edge_traits", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(a).lower()}, {str(b).lower()}, {str(c).lower()}, '{p}')" for k, (a, b, c, p) in EDGE_TRAITS.items()) + ") t(kind, load_bearing, transfers_obligation, lifecycle, phrase)", "")
def _traits(spark, sf_dir):
    cols = [F.struct(F.lit(k).alias("kind"), F.lit(a).alias("load_bearing"), F.lit(b).alias("transfers_obligation"), F.lit(c).alias("lifecycle"), F.lit(p).alias("phrase")) for k, (a, b, c, p) in EDGE_TRAITS.items()]
    return spark.range(1).select(F.explode(F.array(*cols)).alias("t")).select("t.*")


# 2.7 diagnostics

FINDING_SQL = "rule, message, file, line, array_to_string(nodes, ',') AS nodes, hint"


def finding(df: DataFrame) -> DataFrame:
    return df.select("rule", "message", "file", F.col("line").cast("bigint").alias("line"), F.array_join("nodes", ",").alias("nodes"), "hint")


DESCRIBE = "CASE WHEN {p}.kind = 'document' THEN {p}.id ELSE {p}.document || ' \"' || {p}.text || '\"' END"
GHOST_SQL = """
SELECT 'ghost-handover' AS rule, 'open obligation delegates to ' || b.id || ', which is ' || CASE WHEN b.phase = 'retired' THEN 'retired' WHEN b.history THEN 'a historical record' WHEN b.phase = 'record' THEN 'archived' ELSE 'frozen' END AS message,
       e.file, 1 AS line, a.id || ',' || b.id AS nodes,
       CASE WHEN b.phase = 'retired' THEN 'nothing will be read from ' || b.id || ' again - re-home this in a live document, or close it here'
            WHEN b.history THEN b.id || ' is a log of what happened and will never act - re-home this in a live document'
            WHEN b.phase = 'record' THEN b.id || ' is a closed round of work and will never act - re-home this in a live document'
            ELSE b.id || ' is frozen and cannot take on new work - open an amendment, or close this here' END AS hint
FROM edges e JOIN nodes a ON a.id = e.f JOIN nodes b ON b.id = e.t
WHERE e.kind = 'delegates-to' AND a.openness IS DISTINCT FROM 'closed' AND a.phase <> 'retired' AND b.receptivity = 'sealed'
"""
STALE_SQL = """
SELECT 'stale-premise' AS rule, a.id || ' depends on ' || b.id || ', which no longer holds' AS message, e.file, 1 AS line, a.id || ',' || b.id AS nodes,
       're-check this dependency: the constraint it assumes may have been lifted when ' || b.id || ' was retired' AS hint
FROM edges e JOIN nodes a ON a.id = e.f JOIN nodes b ON b.id = e.t WHERE e.kind = 'depends-on' AND a.phase <> 'retired' AND b.phase = 'retired'
"""
CIRCULAR_SQL = """, duty AS (SELECT * FROM kept WHERE kind = 'delegates-to' AND fd <> td),
w AS (SELECT fd AS s, td AS e, 1 AS depth FROM duty UNION SELECT w.s, x.td, depth + 1 FROM w JOIN duty x ON x.fd = w.e WHERE depth < 8 AND w.s <> w.e),
ring AS (SELECT DISTINCT s FROM w WHERE s = e),
comp AS (SELECT min(w.s) AS c, w.e AS node FROM w JOIN ring a ON a.s = w.s JOIN ring b ON b.s = w.e GROUP BY 2),
good AS (SELECT c, count(*) AS n, string_agg(node, ',' ORDER BY node) AS nodes FROM comp JOIN docs2 d ON d.id = node GROUP BY c HAVING count(*) > 1 AND NOT bool_or(d.history)),
inner_edge AS (SELECT a.c, arg_min(x.file, x.edge_ord) AS file FROM duty x JOIN comp a ON a.node = x.fd JOIN comp b ON b.node = x.td AND b.c = a.c GROUP BY 1)
SELECT 'circular-delegation' AS rule, 'delegation cycle across ' || n || ' documents: nothing in it can ever land' AS message, file, 1 AS line, nodes, 'break the loop: one of these must own the work outright, or be closed' AS hint
FROM good JOIN inner_edge USING (c)
"""
ORPHANED_SQL = """, held AS (SELECT document, count(*) AS n, string_agg(id, ',' ORDER BY node_ord) AS items FROM nodes WHERE kind = 'item' AND openness <> 'closed' AND phase IN ('retired', 'frozen') AND NOT EXISTS (SELECT 1 FROM handed h WHERE h.f = id) GROUP BY 1)
SELECT 'orphaned-obligation' AS rule, d.phase || ' document still holds ' || n || ' open ' || CASE WHEN n = 1 THEN 'obligation' ELSE 'obligations' END AS message, d.path AS file, 2 AS line, d.id || ',' || items AS nodes,
       'move each one to a live document or close it - as it stands, ' || CASE WHEN n = 1 THEN 'it disappears' ELSE 'they disappear' END || ' with ' || d.id AS hint
FROM held JOIN docs2 d ON d.id = held.document
"""
LIVE_SQL = """
SELECT 'live-supersession' AS rule, t.id || ' is superseded by ' || s.id || ' but still reads as ' || t.phase AS message, t.path AS file, 2 AS line, t.id || ',' || s.id AS nodes,
       'mark ' || t.id || ' as superseded, or drop the claim in ' || s.id AS hint
FROM edges e JOIN docs2 s ON s.id = e.f JOIN docs2 t ON t.id = e.t WHERE e.kind = 'supersedes' AND NOT s.history AND t.phase NOT IN ('retired', 'record', 'unknown')
"""
QUIET_SQL = """
SELECT 'unreciprocated-supersession' AS rule, t.id || ' is ' || CASE WHEN t.phase = 'record' THEN 'archived' ELSE 'retired' END || ' but never says that ' || s.id || ' replaced it' AS message, t.path AS file, 2 AS line, t.id || ',' || s.id AS nodes,
       CASE WHEN t.phase = 'record' THEN 'make the status of ' || t.path || ' "archived, superseded by ' || s.id || '" so a reader who lands there is redirected'
            ELSE 'add "superseded-by: ' || s.id || '" to ' || t.path || ' so a reader who lands there is redirected' END AS hint
FROM edges e JOIN docs2 s ON s.id = e.f JOIN docs2 t ON t.id = e.t WHERE e.kind = 'supersedes' AND NOT s.history AND t.phase IN ('retired', 'record') AND NOT e.both_say
"""
CONFLICT_SQL = """
SELECT 'state-conflict' AS rule, 'item reads as obviated but also carries a checkbox saying unresolved' AS message, path AS file, n + 1 AS line, id AS nodes, 'make the two agree - it is treated as closed' AS hint FROM nodes WHERE conflicted
"""
SELF_SQL = """
SELECT 'self-reference' AS rule, a.document || ' "' || a.text || '" references itself' AS message, e.file, 1 AS line, a.id AS nodes, 'a document cannot depend on itself - repoint or remove the reference' AS hint
FROM edges e JOIN nodes a ON a.id = e.f WHERE e.reflexive
"""
over_graph("rule_ghost_handover", GHOST_SQL)(lambda g: finding(rules.ghost_handover(g)))
over_graph("rule_stale_premise", STALE_SQL)(lambda g: finding(rules.stale_premise(g)))
over_graph("rule_circular", HAND_OFF + CIRCULAR_SQL)(lambda g: finding(rules.circular_delegation(g)))
over_graph("rule_orphaned", HANDED + ORPHANED_SQL)(lambda g: finding(rules.orphaned_obligation(g)))
over_graph("rule_live_supersession", LIVE_SQL)(lambda g: finding(rules.supersessions(g).where("rule = 'live-supersession'")))
over_graph("rule_unreciprocated", QUIET_SQL)(lambda g: finding(rules.supersessions(g).where("rule <> 'live-supersession'")))
over_graph("rule_state_conflict", CONFLICT_SQL)(lambda g: finding(rules.state_conflict(g)))
over_graph("rule_self_reference", SELF_SQL)(lambda g: finding(rules.self_reference(g, ["references"])))

PROJECT = rules.ProjectRule(
    "urgent", (parse_query("document[fm.priority=1-URGENT][phase=draft] -depends-on-> document[phase!=active]"), parse_query("document[phase=frozen] -depends-on-> document[phase=retired]")),
    "{0} ({0.phase}, {0.fm.cust}) rests on {1} {1.status} {9} {1.fm.none}", "see {1.path}",
)
PROJECT_SQL = """
SELECT 'project:urgent' AS rule, a.id || ' (' || a.phase || ', ' || a.cust || ') rests on ' || b.id || ' ' || b.raw_status || ' {9} {1.fm.none}' AS message, e.file, 1 AS line, a.id || ',' || b.id AS nodes, 'see ' || b.path AS hint
FROM edges e JOIN nodes a ON a.id = e.f JOIN nodes b ON b.id = e.t WHERE e.kind = 'depends-on' AND ((a.priority = '1-URGENT' AND a.phase = 'draft' AND b.phase <> 'active') OR (a.phase = 'frozen' AND b.phase = 'retired'))
"""
over_graph("rule_project_template", PROJECT_SQL)(lambda g: finding(rules.project_findings(g, PROJECT)))

SUBJECT = "split_part(split_part(nodes, ',', 1), '#', 1)"
ALL_SQL = HANDED + HAND_OFF + CIRCULAR_SQL.replace("SELECT 'circular-delegation'", ", circular AS (SELECT 'circular-delegation'").rstrip() + ")" + ORPHANED_SQL.replace("SELECT 'orphaned-obligation'", ", orphaned AS (SELECT 'orphaned-obligation'").rstrip() + ")" + f"""
, found AS (SELECT * FROM circular UNION ALL SELECT * FROM orphaned UNION ALL {GHOST_SQL} UNION ALL {STALE_SQL} UNION ALL {LIVE_SQL} UNION ALL {QUIET_SQL} UNION ALL {CONFLICT_SQL})
, spared AS (SELECT found.* FROM found LEFT JOIN docs2 d ON d.id = {SUBJECT} AND d.phase = 'record' WHERE NOT coalesce(d.history OR (d.phase = 'record' AND rule IN ('ghost-handover', 'stale-premise')), false))
, graded AS (SELECT *, CASE WHEN rule IN ('unreciprocated-supersession', 'state-conflict') THEN 'warn' ELSE 'error' END AS severity FROM spared)
"""


@over_graph("record_exemption", ALL_SQL + "SELECT rule, message, file, line, nodes, hint FROM spared")
def _exempt(g):
    g = g.settled()
    return finding(rules.run_rules(g))


@over_graph("strict_severity", ALL_SQL + "SELECT rule, CASE WHEN rule = 'state-conflict' THEN 'info' ELSE 'error' END AS severity, count(*) AS n FROM graded WHERE rule <> 'stale-premise' GROUP BY 1, 2")
def _strict(g):
    g = g.settled()
    return rules.run_rules(g, strict=True, severities={"state-conflict": "info", "stale-premise": "off"}).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@over_graph("diag_order_topk", ALL_SQL + "SELECT row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, file, line, rule, message) AS place, rule, message FROM graded QUALIFY place <= 200")
def _top(g):
    g = g.settled()
    first = rules.in_order(rules.run_rules(g)).limit(200)
    rank = F.when(F.col("severity") == "error", 0).otherwise(1)
    return first.select(F.row_number().over(Window.orderBy(rank, "file", "line", "column", "rule", "message")).cast("bigint").alias("place"), "rule", "message")


@over_graph("related_cap", HANDED + ORPHANED_SQL.replace("SELECT 'orphaned-obligation'", ", o AS (SELECT 'orphaned-obligation'").rstrip() + ") SELECT nodes, least(3, len(string_split(nodes, ',')) - 1) AS related FROM o")
def _related(g):
    return rules.orphaned_obligation(g).select(F.array_join("nodes", ",").alias("nodes"), F.size(F.slice("related", 1, 3)).cast("bigint").alias("related"))


@over_graph("summary", ALL_SQL + """SELECT (SELECT count(*) FROM docs2) AS documents, (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM edges) AS edges,
 (SELECT count(*) FROM nodes WHERE kind = 'item' AND openness <> 'closed' AND phase <> 'record') AS open_obligations,
 (SELECT count(*) FROM graded WHERE severity = 'error') AS errors, (SELECT count(*) FROM graded WHERE severity = 'warn') AS warnings, (SELECT count(*) FROM graded WHERE severity = 'info') AS infos""")
def _summary(g):
    from tamarack.plans.analysis import summary

    g = g.settled()
    return summary(g, rules.run_rules(g))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["step_out"](spark, sf_dir)


def graph_of(spark: SparkSession, sf_dir: str) -> SpecGraph:
    return order_graph(spark, sf_dir)
