"""Markdown corpora made from the order tables, one file an order, through scanner, extraction, resolution and rules.

The SQL says what must come out of a file from the row that it was made of; it
never reads the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.plans import rules
from tamarack.plans.analysis import suppressed_groups, unread_front_matter
from tamarack.plans.corpus import Corpus, Options, analyse, families
from tamarack.sources.blocks import scanned
from tamarack.sources.extract import extracted
from tamarack.sources.tables import order_lines, table

QUERIES, SQL = {}, {}

#: Lines of a file: 1-5 front matter, 6 title, 8 questions, from 10 the items, then notes and a table.
FILE_SQL = """
WITH n AS (SELECT count(*) AS n FROM orders),
o AS MATERIALIZED (SELECT o_orderkey AS k, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p, o_orderpriority AS priority, lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS pad,
       (o_orderkey * 7 + 3) % n AS j, o_orderkey - o_orderkey % 10 + ((o_orderkey % 10) * (o_orderkey % 10) + 1) % 10 AS f FROM orders, n),
d AS MATERIALIZED (SELECT *, 'ADR-' || pad AS id, 'docs/adr/' || pad || '-order.md' AS path, 'ADR-' || lpad(CAST(j AS VARCHAR), 6, '0') AS jid, 'ADR-' || lpad(CAST(f AS VARCHAR), 6, '0') AS fid,
       CASE WHEN s = 'O' THEN 'accepted' WHEN s = 'F' THEN 'Superseded by ADR-' || lpad(CAST(j AS VARCHAR), 6, '0') WHEN p = '1' THEN 'Archived' WHEN p = '2' THEN 'final' ELSE 'draft' END AS raw_status,
       CASE WHEN s = 'O' THEN 'active' WHEN s = 'F' THEN 'retired' WHEN p = '1' THEN 'record' WHEN p = '2' THEN 'frozen' ELSE 'draft' END AS phase, k % 7 = 0 AS misspelt FROM o),
l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n,
       l_linestatus || l_returnflag AS code, l_partkey AS part FROM lineitem),
i AS MATERIALIZED (SELECT l.k, l.n, code, part, d.id, d.path, d.phase, d.fid, d.id || '#open-questions.' || l.n AS item, 9 + l.n AS line, 'line ' || l.n || ' of part ' || part AS plain FROM l JOIN d ON d.k = l.k),
c AS MATERIALIZED (SELECT d.*, coalesce(m, 0) AS m FROM d LEFT JOIN (SELECT k, count(*) AS m FROM l GROUP BY 1) x ON x.k = d.k)
"""


def files(spark, sf_dir: str) -> DataFrame:
    """``path, text`` of the files, and ``k``."""
    pad = lambda c: F.lpad(F.col(c).cast("string"), 6, "0") if isinstance(c, str) else F.lpad(c.cast("string"), 6, "0")
    text = lambda *a: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in a])
    orders = table(spark, sf_dir, "orders")
    k, r = F.col("o_orderkey"), F.col("o_orderkey") % 10
    o = orders.select(k.alias("k"), F.col("o_orderstatus").alias("s"), F.substring("o_orderpriority", 1, 1).alias("p"), F.col("o_orderpriority").alias("priority"), ((k * 7 + 3) % orders.count()).alias("j"), (k - r + (r * r + 1) % 10).alias("f"))
    rest = text("](", pad("f"), "-order.md)")
    code = F.col("disposition")
    line = text("line ", F.col("n"), " of part ", F.col("part"))
    item = F.when(code == "unresolved", text("- [ ] ", line)).when(code == "delegated", text("- [ ] ", line, " is delegated to [next", rest)).when(code == "narrowed", text("- [~] ", line)).when(code == "satisfied", text("* [x] ", line)).when(code == "accepted-debt", text("- ~~", line, "~~")).otherwise(text("- ", line))
    lines = order_lines(spark, sf_dir).join(o.select("k", "f"), "k").groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("t")))), lambda x: x["t"]), "\n").alias("items"))
    o = o.join(lines, "k", "left")
    status = F.when(F.col("s") == "O", "accepted").when(F.col("s") == "F", text("Superseded by ADR-", pad("j"))).when(F.col("p") == "1", "Archived").when(F.col("p") == "2", "final").otherwise("draft")
    other = text("](", pad("j"), "-order.md#")
    body = F.concat_ws(
        "\n", F.lit("---"), text("status: ", status), text("depends-on: ADR-", pad("f")), F.when(F.col("k") % 7 == 0, text("depnds-on: ADR-", pad("f"))).otherwise(text("priority: ", F.col("priority"))), F.lit("---"),
        text("# ADR-", F.col("k"), ": Order"), F.lit(""), F.lit("## Open questions"), F.lit(""), F.col("items"), F.lit(""), F.lit("## Notes"), F.lit(""),
        text("This amends [the other", other, "notes), see [lost](lost-", F.col("k"), ".md) and [odd", other, "nowhere-", F.col("k"), ")."), F.lit(""),
        F.lit("| ID | Question | Status |"), F.lit("| --- | --- | --- |"), text("| Q", F.col("k"), " | Who? | accepted |"), F.lit(""), text("<!-- seen ", F.col("k"), " -->"), F.lit("```\n# not a heading\n- [ ] not an item\n```"), F.lit(""),
    )
    return o.select("k", text("docs/adr/", pad("k"), "-order.md").alias("path"), body.alias("text"))


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = FILE_SQL + sql
        return f

    return put


_held: dict[tuple, Corpus] = {}


def corpus(spark, sf_dir: str) -> Corpus:
    """The corpus without options, which many queries read: its tables are written once a session."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _held:
        _held[name] = analyse(files(spark, sf_dir))
    return _held[name]


def block(name: str, kind: str, cols: dict[str, str], sql: str) -> None:
    """Registers the blocks of one kind as a query."""
    query(name, sql)(lambda spark, sf_dir: scanned(files(spark, sf_dir), [kind]).select(*[F.expr(e).alias(c) for c, e in cols.items()]))


# Scanner

block("md_headings", "heading", {"path": "path", "line": "line", "level": "level", "text": "text", "anchor": "target", "depth": "size(section)"}, """
SELECT path, 6 AS line, 1 AS level, 'ADR-' || k || ': Order' AS text, 'adr-' || k || '-order' AS anchor, 1 AS depth FROM c UNION ALL SELECT path, 8, 2, 'Open questions', 'open-questions', 2 FROM c
UNION ALL SELECT path, CASE WHEN m = 0 THEN 11 ELSE 11 + m END, 2, 'Notes', 'notes', 2 FROM c""")
block("md_list_items", "item", {"path": "path", "line": "line", "column": "column", "depth": "level", "box": "target", "section": "element_at(section, -1)"}, """
SELECT path, line, 1 AS "column", 0 AS depth, CASE WHEN code IN ('ON', 'OA') THEN ' ' WHEN code = 'OR' THEN '~' WHEN code = 'FN' THEN 'x' END AS box, 'Open questions' AS section FROM i""")
block("md_links", "link", {"path": "path", "line": "line", "target": "target", "raw": "text"}, """
, jp AS (SELECT *, lpad(CAST(j AS VARCHAR), 6, '0') || '-order.md#' AS other, CASE WHEN m = 0 THEN 13 ELSE 13 + m END AS line FROM c)
SELECT path, line, other || 'notes' AS target, '[the other](' || other || 'notes)' AS raw FROM jp UNION ALL SELECT path, line, 'lost-' || k || '.md', '[lost](lost-' || k || '.md)' FROM jp
UNION ALL SELECT path, line, other || 'nowhere-' || k, '[odd](' || other || 'nowhere-' || k || ')' FROM jp UNION ALL SELECT path, line, substr(fid, 5) || '-order.md', '[next](' || substr(fid, 5) || '-order.md)' FROM i WHERE code = 'OA'""")
block("md_cells", "cell", {"path": "path", "line": "line", "place": "level", "text": "text", "header": "target"}, """
, t AS (SELECT path, k, CASE WHEN m = 0 THEN 17 ELSE 17 + m END AS line FROM c)
SELECT path, line, 0 AS place, 'Q' || k AS text, 'ID' AS header FROM t UNION ALL SELECT path, line, 1, 'Who?', 'Question' FROM t UNION ALL SELECT path, line, 2, 'accepted', 'Status' FROM t""")
block("md_comments", "comment", {"path": "path", "line": "line", "text": "text"}, "SELECT path, CASE WHEN m = 0 THEN 19 ELSE 19 + m END AS line, 'seen ' || k AS text FROM c")
block("md_front_matter", "entry", {"path": "path", "line": "line", "column": "column", "key": "target", "text": "text"}, """
SELECT path, 2 AS line, 9 AS "column", 'status' AS key, raw_status AS text FROM c UNION ALL SELECT path, 3, 13, 'depends-on', fid FROM c
UNION ALL SELECT path, 4, CASE WHEN misspelt THEN 12 ELSE 11 END, CASE WHEN misspelt THEN 'depnds-on' ELSE 'priority' END, CASE WHEN misspelt THEN fid ELSE priority END FROM c""")

# Extraction


@query("md_documents", """SELECT id, path, family, number, title, line, raw_status, phase, status_line, status_column, region, container, anchors FROM (
SELECT id, path, 'ADR' AS family, CAST(k AS INTEGER) AS number, 'ADR-' || k || ': Order' AS title, 6 AS line, raw_status, phase, 2 AS status_line, 9 AS status_column, false AS region, NULL AS container, 'adr-' || k || '-order,open-questions,notes' AS anchors FROM c
UNION ALL SELECT 'Q-' || k, path, 'Q', CAST(k AS INTEGER), 'Q' || k, CASE WHEN m = 0 THEN 17 ELSE 17 + m END, 'accepted', 'active', CASE WHEN m = 0 THEN 17 ELSE 17 + m END, 14 + length(CAST(k AS VARCHAR)), true, id, '' FROM c)""")
def _documents(spark, sf_dir):
    return extracted(files(spark, sf_dir), ()).select("id", "path", "family", "number", "title", "line", "raw_status", "phase", "status_line", "status_column", "region", "container", F.array_join("anchors", ",").alias("anchors"))


ITEM_STATE = """CASE WHEN code IN ('ON', 'OA', 'FR') THEN 'unresolved' WHEN code = 'OR' THEN 'narrowed' ELSE 'satisfied' END AS disposition,
 CASE WHEN code IN ('ON', 'OA', 'FR') THEN 'open' WHEN code = 'OR' THEN 'partial' ELSE 'closed' END AS openness, CASE WHEN code = 'FA' THEN 'strikethrough' WHEN code = 'FR' THEN 'section' ELSE 'checkbox' END AS evidence"""


@query("md_items", f"SELECT item AS id, id AS document, line, {ITEM_STATE}, 'ADR-' || k || ': Order > Open questions' AS section, n FROM i")
def _items(spark, sf_dir):
    own = extracted(files(spark, sf_dir), ["items"]).select(F.col("id").alias("document"), F.posexplode("items").alias("pos", "i"))
    return own.select("i.id", "document", "i.line", "i.disposition", "i.openness", "i.evidence", F.array_join("i.section", " > ").alias("section"), (F.col("pos") + 1).cast("bigint").alias("n"))


REF = """
, loc AS (SELECT *, CASE WHEN m = 0 THEN 13 ELSE 13 + m END AS notes, lpad(CAST(j AS VARCHAR), 6, '0') || '-order.md#' AS other FROM c)
, ref AS (SELECT 'depends-on' AS kind, id AS "from", fid AS target, 'front-matter' AS origin, 3 AS line, 13 AS "column", false AS inverted, false AS opportunistic FROM loc
 UNION ALL SELECT 'supersedes', id, jid, 'front-matter', 2, 9, true, true FROM loc WHERE s = 'F'
 UNION ALL SELECT 'delegates-to', item, substr(fid, 5) || '-order.md', 'link', line, 7 + length(plain) + 24, false, false FROM i WHERE code = 'OA'
 UNION ALL SELECT 'amends', id, other || 'notes', 'link', notes, 25, false, false FROM loc
 UNION ALL SELECT 'references', id, 'lost-' || k || '.md', 'link', notes, 44 + length(other), false, false FROM loc) """


@query("md_references", REF + """SELECT * FROM ref UNION ALL SELECT 'references', id, other || 'nowhere-' || k, 'link', notes, 64 + length(other) + length(CAST(k AS VARCHAR)), false, false FROM loc""")
def _references(spark, sf_dir):
    refs = extracted(files(spark, sf_dir), ["refs"]).select(F.explode("refs").alias("r")).select("r.*")
    return refs.where("origin <> 'text'").select("kind", "from", "target", "origin", "line", "column", "inverted", "opportunistic")


@query("md_misread_keys", "SELECT id AS \"from\", path AS file, 'depnds-on' AS key, 'depends-on' AS suggestion, 4 AS line FROM c WHERE misspelt")
def _misread(spark, sf_dir):
    return corpus(spark, sf_dir).misread.select("from", "file", "key", "suggestion", "line")


# Resolution


@query("md_edges", """
, e AS (SELECT 'contains' AS kind, id AS "from", 'Q-' || k AS "to" FROM c UNION ALL SELECT 'contains', id, item FROM i UNION ALL SELECT 'depends-on', id, fid FROM c UNION ALL SELECT 'supersedes', jid, id FROM c WHERE s = 'F'
 UNION ALL SELECT 'delegates-to', item, fid FROM i WHERE code = 'OA' UNION ALL SELECT 'amends', id, jid FROM c)
SELECT kind, "from", "to", split_part("from", '#', 1) = split_part("to", '#', 1) AND kind <> 'contains' AS reflexive FROM e""")
def _edges(spark, sf_dir):
    return corpus(spark, sf_dir).graph.edges.select("kind", "from", "to", "reflexive")


LOST = REF + """, lost AS (SELECT id AS "from", path AS file, 'lost-' || k || '.md' AS target, 'unknown-target' AS reason, notes AS line, 0 AS candidates FROM loc
 UNION ALL SELECT id, path, other || 'nowhere-' || k, 'unknown-anchor', notes, 0 FROM loc) """


@query("md_dangling", LOST + "SELECT * FROM lost")
def _dangling(spark, sf_dir):
    return corpus(spark, sf_dir).dangling.select("from", "file", "target", "reason", "line", F.size("candidates").alias("candidates"))


@query("md_suppressed", LOST + """SELECT target, count(*) AS n, min(file) AS file, min(line) AS line FROM lost WHERE reason = 'unknown-target' GROUP BY target""")
def _suppressed(spark, sf_dir):
    return suppressed_groups(analyse(files(spark, sf_dir), Options(ignore_references=["lost-*"])).suppressed).select("target", "n", "file", "line")


@query("md_families", "SELECT 'ADR' AS family UNION ALL SELECT 'Q'")
def _families(spark, sf_dir):
    return families(extracted(files(spark, sf_dir), ()))


@query("md_history", "SELECT id, phase, history, receptivity FROM (SELECT id, CASE WHEN k % 10 = 3 THEN 'record' ELSE phase END AS phase, k % 10 = 3 AS history, CASE WHEN k % 10 = 3 OR phase NOT IN ('draft', 'active') THEN 'sealed' ELSE 'receptive' END AS receptivity FROM c UNION ALL SELECT 'Q-' || k, 'active', false, 'receptive' FROM c)")
def _history(spark, sf_dir):
    return analyse(files(spark, sf_dir), Options(history=["docs/adr/*3-order.md"])).documents.select("id", "phase", "history", "receptivity")


@query("md_near_miss", """SELECT 'X-' || k AS "from", CASE k % 3 WHEN 0 THEN 'ADR-' || pad WHEN 1 THEN 'ADR-' || pad ELSE NULL END AS suggestion FROM d""")
def _near(spark, sf_dir):
    """A path with a letter too many, a family misspelt, and a name that is near to nothing."""
    k = F.regexp_extract("path", r"(\d{6})", 1)
    number = F.col("k")
    cite = F.when(number % 3 == 0, F.concat(F.lit("[a](../adr/"), k, F.lit("-orderr.md)"))).when(number % 3 == 1, F.concat(F.lit("[[ADRR-"), k, F.lit("]]"))).otherwise(F.concat(F.lit("[a](elsewhere/"), k, F.lit("-orderr.md)")))
    own = files(spark, sf_dir)
    more = own.select(F.concat(F.lit("docs/x/X-"), "k", F.lit(".md")).alias("path"), F.concat(F.lit("---\nid: X-"), "k", F.lit("\n---\n# A note\n\n"), cite, F.lit("\n")).alias("text"))
    left = analyse(own.select("path", "text").unionAll(more)).dangling.where("`from` like 'X-%'")
    return left.select("from", F.get("candidates", F.lit(0)).alias("suggestion"))


@query("md_outside_corpus", """SELECT id AS "from", 'lost-' || k || '.md' AS target, CASE WHEN k % 2 = 0 THEN 'not-a-spec' ELSE 'unknown-target' END AS reason FROM c""")
def _outside(spark, sf_dir):
    own = files(spark, sf_dir)
    known = own.where("k % 2 = 0").select(F.concat(F.lit("docs/adr/lost-"), "k", F.lit(".md")).alias("path"))
    return analyse(own, known_paths=known).dangling.where("reason <> 'unknown-anchor'").select("from", "target", "reason")


@query("md_unread", "SELECT count(*) AS unread FROM c WHERE k % 3 = 0")
def _unread(spark, sf_dir):
    own = files(spark, sf_dir)
    broken = F.when(F.col("k") % 3 == 0, F.regexp_replace("text", "(?m)^status: .*$", "status: Superseded by ADR-3: see notes")).otherwise(F.col("text"))
    return unread_front_matter(extracted(own.withColumn("text", broken), ()))


# Rules


@query("md_rule_references", LOST + """SELECT 'broken-reference' AS rule, '"' || target || '"' || CASE WHEN reason = 'unknown-anchor' THEN ' points at an anchor that does not exist' ELSE ' does not resolve to any document' END AS message, file, line, "from" AS nodes,
 CASE WHEN reason = 'unknown-anchor' THEN 'check the heading or item id it is meant to address' ELSE 'fix the identifier, or add the document it names' END AS hint FROM lost""")
def _rule_references(spark, sf_dir):
    return rules.references(corpus(spark, sf_dir).dangling).select("rule", "message", "file", "line", F.array_join("nodes", ",").alias("nodes"), "hint")


@query("md_rule_misread_key", """SELECT 'unknown-relation-key' AS rule, '"depnds-on" declares no relation' AS message, path AS file, 4 AS line, id AS nodes, 'spell it depends-on, or move it out of front matter if it is not a relation' AS hint FROM c WHERE misspelt""")
def _rule_misread(spark, sf_dir):
    return rules.misread_key(corpus(spark, sf_dir).misread).select("rule", "message", "file", "line", F.array_join("nodes", ",").alias("nodes"), "hint")


@query("md_rule_outside_corpus", """SELECT rule, message, hint, count(*) AS n FROM (SELECT 'reference-outside-corpus' AS rule, 'resolves to a file that is not a specification' AS message, 'include it: "docs/adr/*.md"' AS hint FROM c WHERE k % 2 = 0) GROUP BY 1, 2, 3""")
def _rule_outside(spark, sf_dir):
    own = files(spark, sf_dir)
    known = own.where("k % 2 = 0").select(F.concat(F.lit("docs/adr/lost-"), "k", F.lit(".md")).alias("path"))
    found = rules.references(analyse(own, known_paths=known).dangling).where("rule = 'reference-outside-corpus'")
    return found.groupBy("rule", F.regexp_replace("message", '^".*" ', "").alias("message"), "hint").agg(F.count("*").alias("n"))


@query("md_rule_ambiguous", """SELECT 'ambiguous-reference' AS rule, '"twin" matches 2 documents' AS message, 'Y-' || k AS nodes, 'disambiguate it - candidates: ' || least('T-' || k, 'U-' || k) || ', U-' || k AS hint FROM d WHERE k < 1""")
def _rule_ambiguous(spark, sf_dir):
    made = spark.createDataFrame([("docs/y/T-0.md", "---\nid: T-0\nalias: twin\n---\n# T\n"), ("docs/y/U-0.md", "---\nid: U-0\nalias: twin\n---\n# U\n"), ("docs/y/Y-0.md", "---\nid: Y-0\n---\n# Y\n\n[[twin]]\n")], "path string, text string")
    left = analyse(files(spark, sf_dir).select("path", "text").unionAll(made)).dangling.where("`from` = 'Y-0'")
    return rules.references(left).select("rule", "message", F.array_join("nodes", ",").alias("nodes"), "hint")
