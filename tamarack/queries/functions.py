"""Scalar functions, each over a whole table of the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import text as X
from tamarack.plans.globs import glob_filter
from tamarack.sources.tables import table
from tamarack.vocab import DOCUMENT_EXTENSIONS, FAMILY_DIRECTORIES, PHASE_WORDS, STATUS_HEADINGS

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return put


#: Statuses and references as people write them, made from the orders.
STATUS_SQL = """WITH s AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN '**Accepted**' WHEN 1 THEN 'Superseded by [ORD-' || (o_orderkey // 2) || '](../a.md), RFC 7 and KEP-' || o_orderkey
 WHEN 2 THEN 'in_progress 2020-01-02' WHEN 3 THEN '<b>Final</b> "text"' WHEN 4 THEN 'Provisionally  accepted' WHEN 5 THEN o_orderpriority WHEN 6 THEN 'replaced with: `x.md`; (y)' ELSE 'Signed-off #2' END AS status FROM orders) """
REF_SQL = """WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 10 WHEN 0 THEN ' ORD-' || o_orderkey || ' ' WHEN 1 THEN '[#rfc_' || o_orderkey || ').' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) WHEN 3 THEN '#' || (o_orderkey % 1000) || ':'
 WHEN 4 THEN '../orders/./' || o_custkey || '//' || o_orderkey || '.md#top' WHEN 5 THEN 'https://example.com/' || o_orderkey WHEN 6 THEN 'img/' || o_orderkey || '.png' WHEN 7 THEN 'Notes.v' || o_orderkey
 WHEN 8 THEN 'a%20b/' || o_orderkey || '+c.TXT' ELSE 'docs/archive/README.md' END AS ref FROM orders) """


def _status(spark, sf_dir):
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    made = [
        F.lit("**Accepted**"), F.concat(F.lit("Superseded by [ORD-"), F.expr("o_orderkey div 2"), F.lit("](../a.md), RFC 7 and KEP-"), k), F.lit("in_progress 2020-01-02"), F.lit('<b>Final</b> "text"'),
        F.lit("Provisionally  accepted"), F.col("o_orderpriority"), F.lit("replaced with: `x.md`; (y)"), F.lit("Signed-off #2"),
    ]
    return o.select(k.alias("k"), _pick(k % 8, made).alias("status"))


def _ref(spark, sf_dir):
    k, cust, o = F.col("o_orderkey"), F.col("o_custkey"), table(spark, sf_dir, "orders")
    text = lambda *a: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in a])
    made = [
        text(" ORD-", k, " "), text("[#rfc_", k, ")."), k.cast("string"), text("#", k % 1000, ":"), text("../orders/./", cust, "//", k, ".md#top"), text("https://example.com/", k), text("img/", k, ".png"), text("Notes.v", k),
        text("a%20b/", k, "+c.TXT"), F.lit("docs/archive/README.md"),
    ]
    return o.select(k.alias("k"), _pick(k % 10, made).alias("ref"))


def _pick(which, values):
    out = None
    for i, v in enumerate(values[:-1]):
        out = F.when(which == i, v) if out is None else out.when(which == i, v)
    return out.otherwise(values[-1])


NORM = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(status, '<[^>]*>', ' ', 'g'), '([\p{L}\p{N}])_([\p{L}\p{N}])', '\1 \2', 'g'), '[`*_~"''#]', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[0-9]{4}-[0-9]{2}-[0-9]{2}', ' ', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'))"""


#: Phases by words, in the order of precedence; terms with hyphens count anywhere in the text.
PHASE = "CASE " + " ".join(
    "WHEN " + " OR ".join([f"len(list_intersect(string_split(text, ' '), {[t for t in terms if '-' not in t]!r})) > 0"] * any("-" not in t for t in terms) + [f"contains(replace(text, ' ', '-'), '{t}')" for t in terms if "-" in t]) + f" THEN '{phase}'"
    for phase, terms in PHASE_WORDS
) + " ELSE 'unknown' END"
#: Each term of the vocabulary in turn, between other words.
TERMS = [t for _, terms in PHASE_WORDS for t in terms]
TERM_SQL = f"SELECT o_orderkey AS k, 'It is *' || upper(({TERMS!r})[o_orderkey % {len(TERMS)} + 1]) || '* ' || CASE o_orderkey % 3 WHEN 0 THEN 'and draft' WHEN 1 THEN '2020-01-02' ELSE o_orderstatus END AS status FROM orders"
HEADINGS = ["Status", "**Current Status** ", "Statuses", "", "STATE", "_Lifecycle_", "Stage `", "My status"]
KEYS = ["Depends_On", "de-pends", "X 1", "superseded-by", "Blocked By"]
NAMES = [" Adr ", "x_1", "1x", "ADR2", "a-b", "", "rfc", "averyveryverylongname", "q", "A1B2"]
PREFIX_RE = r"^([A-Za-z][A-Za-z0-9_]{0,15}?)[\s._-]*([0-9]{1,6})$"
DOCUMENT_RE = rf"(?i)\.({'|'.join(DOCUMENT_EXTENSIONS)})$"


@query("fn_normalise_status", STATUS_SQL + f"SELECT k, {NORM} AS text FROM s")
def _normalise_status(spark, sf_dir):
    return _status(spark, sf_dir).select("k", X.normalise_status(F.col("status")).alias("text"))


@query("fn_phase_of", STATUS_SQL + f", a AS (SELECT k, status FROM s UNION ALL SELECT k + 1000000000, status FROM ({TERM_SQL}) t), n AS (SELECT k, {NORM} AS text FROM a), p AS (SELECT k, {PHASE} AS phase FROM n) SELECT k, phase, CASE WHEN phase IN ('draft', 'active') THEN 'receptive' WHEN phase = 'unknown' THEN 'unknown' ELSE 'sealed' END AS receptivity FROM p")
def _phase_of(spark, sf_dir):
    k = F.col("o_orderkey")
    term = F.upper(F.element_at(F.array(*map(F.lit, TERMS)), (k % len(TERMS) + 1).cast("int")))
    more = table(spark, sf_dir, "orders").select((k + 1000000000).alias("k"), F.concat(F.lit("It is *"), term, F.lit("* "), F.when(k % 3 == 0, "and draft").when(k % 3 == 1, "2020-01-02").otherwise(F.col("o_orderstatus"))).alias("status"))
    phased = _status(spark, sf_dir).unionAll(more).select("k", X.phase_of(F.col("status")).alias("phase"))
    return phased.withColumn("receptivity", X.receptivity_of(F.col("phase")))


@query("fn_phase_from_path", "SELECT page_id, CASE WHEN len(list_intersect(string_split(lower(html), '/')[:-2], ['archive', 'archived', 'attic', 'deprecated', 'graveyard', 'historical', 'obsolete', 'rejected', 'retired', 'superseded', 'superceded', 'withdrawn'])) > 0 THEN 'retired' ELSE 'unknown' END AS by_html, 'retired' AS by_folder FROM pages")
def _phase_from_path(spark, sf_dir):
    folder = F.concat(F.lit("docs/Archive/"), "page_id", F.lit("/superseded.md"))
    return table(spark, sf_dir, "pages").select("page_id", X.phase_from_path(F.col("html")).alias("by_html"), X.phase_from_path(folder).alias("by_folder"))


@query("fn_supersession_targets", STATUS_SQL + r""", t AS (SELECT k, regexp_extract(regexp_replace(status, '[`*_]', '', 'g'), '(?is)(?:super[sc]eded|replaced|obsoleted)\s*(?:by|with|through)?\s*[:\-\x{2013}\x{2014}]?\s*([^\n\r]+)', 1) AS tail FROM s)
SELECT k, array_to_string(list_filter(list_transform(string_split_regex(tail, '[,;]|\band\b'), lambda x: trim(regexp_replace(regexp_replace(x, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[()<>"'']', ' ', 'g'))), lambda x: length(x) BETWEEN 1 AND 199), '|') AS targets FROM t""")
def _targets(spark, sf_dir):
    return _status(spark, sf_dir).select("k", F.array_join(X.supersession_targets(F.col("status")), "|").alias("targets"))


@query("fn_normalise_ref", REF_SQL + r"SELECT k, regexp_replace(regexp_replace(lower(trim(ref)), '^[#<(\[]+|[)\]>.,;:]+$', '', 'g'), '[\s._-]+', '', 'g') AS norm FROM r")
def _normalise_ref(spark, sf_dir):
    return _ref(spark, sf_dir).select("k", X.normalise_ref(F.col("ref")).alias("norm"))


@query("fn_parse_prefixed", REF_SQL + rf""", c AS (SELECT k, ref, regexp_replace(trim(ref), '^[#(\[]+', '') AS x FROM r)
SELECT k, upper(nullif(regexp_extract(x, '{PREFIX_RE}', 1), '')) AS family, CAST(nullif(regexp_extract(x, '{PREFIX_RE}', 2), '') AS INTEGER) AS number, CAST(nullif(regexp_extract(trim(ref), '^#?([0-9]{{1,6}})$', 1), '') AS INTEGER) AS bare,
 regexp_matches(x, '{PREFIX_RE}') OR contains(ref, '/') OR regexp_matches(ref, '{DOCUMENT_RE}') AS cited FROM c""")
def _prefixed(spark, sf_dir):
    c = F.col("ref")
    return _ref(spark, sf_dir).select("k", X.prefixed_family(c).alias("family"), X.prefixed_number(c).alias("number"), X.bare_number(c).alias("bare"), X.looks_like_citation(c).alias("cited"))


@query("fn_split_anchor", "SELECT page_id, split_part(url, '#', 1) AS target, CASE WHEN strpos(url, '#') > 0 THEN substr(url, strpos(url, '#') + 1) END AS anchor FROM pages")
def _anchor(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.anchor_target(F.col("url")).alias("target"), X.anchor_of(F.col("url")).alias("anchor"))


@query("fn_is_document_target", REF_SQL + rf""", b AS (SELECT k, ref, regexp_extract(split_part(ref, '#', 1), '[^/]*$') AS base FROM r), e AS (SELECT *, regexp_extract(base, '\.[^.]*$') AS ext FROM b)
SELECT k, ext = '' OR NOT regexp_matches(ext, '^\.[A-Za-z][A-Za-z0-9]*$') OR regexp_matches(base, '{DOCUMENT_RE}') AS document, regexp_matches(ref, '(?i)^[a-z][a-z0-9+.-]*:') AND NOT regexp_matches(ref, '(?i)^[a-z]:[\\/]') AS external,
 contains(ref, '/') OR regexp_matches(ref, '{DOCUMENT_RE}') AS path FROM e""")
def _document_target(spark, sf_dir):
    c = F.col("ref")
    return _ref(spark, sf_dir).select("k", X.is_document_target(c).alias("document"), X.is_external(c).alias("external"), X.looks_like_path(c).alias("path"))


@query("fn_slugify", r"SELECT doc_id, md5(regexp_replace(trim(regexp_replace(lower(text), '[^\p{L}\p{N}\s_-]', '', 'g'), E' \n\r\t'), '\s', '-', 'g')) AS slug FROM documents")
def _slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.slugify(F.col("text"))).alias("slug"))


@query("fn_within_one_edit", """WITH p AS (SELECT DISTINCT p_name AS n FROM part), w AS (SELECT DISTINCT unnest(string_split(n, ' ')) AS w FROM p),
v AS (SELECT w, u FROM w, (VALUES (0), (1), (2), (3), (4)) t(i), LATERAL (SELECT CASE i WHEN 0 THEN w WHEN 1 THEN substr(w, 2) WHEN 2 THEN w || 'x' WHEN 3 THEN substr(w, 2, 1) || substr(w, 1, 1) || substr(w, 3) ELSE reverse(w) END AS u))
SELECT w, u, w <> u AND damerau_levenshtein(w, u) = 1 AS near FROM v""")
def _near(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    c = F.col("w")
    forms = F.array(c, F.substring(c, 2, 10**6), F.concat(c, F.lit("x")), F.concat(F.substring(c, 2, 1), F.substring(c, 1, 1), F.substring(c, 3, 10**6)), F.reverse(c))
    return w.select("w", F.explode(forms).alias("u")).select("w", "u", X.within_one_edit(F.col("w"), F.col("u")).alias("near"))


@query("fn_paths", REF_SQL + r""", b AS (SELECT k, ref, regexp_extract(ref, '[^/]*$') AS base, CASE WHEN contains(ref, '/') THEN regexp_replace(ref, '/[^/]*$', '') ELSE '' END AS dir FROM r),
n AS (SELECT *, list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(string_split('base/' || ref, '/'), lambda p: [p])), lambda a, p: CASE WHEN p[1] IN ('', '.') THEN a WHEN p[1] = '..' THEN a[:-2] ELSE list_concat(a, p) END) AS parts, regexp_replace(base, '\.[^.]*$', '') AS name FROM b)
SELECT k, array_to_string(parts, '/') AS resolved, base, dir, lower(regexp_extract(base, '\.[^.]*$')) AS ext, starts_with(ref, '/') AS absolute, CASE WHEN lower(name) IN ('readme', 'index') THEN regexp_extract(dir, '[^/]*$') ELSE name END AS stem FROM n""")
def _paths(spark, sf_dir):
    c = F.col("ref")
    return _ref(spark, sf_dir).select("k", X.resolve_from(F.lit("base/index.md"), c).alias("resolved"), X.basename(c).alias("base"), X.dirname(c).alias("dir"), X.extname(c).alias("ext"), X.is_absolute_path(c).alias("absolute"), X.file_stem(c).alias("stem"))


@query("fn_summarise", r"WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 117) || '...' END AS line, CASE WHEN length(t) <= 48 THEN t ELSE substr(t, 1, 45) || '...' END AS short FROM t")
def _summarise(spark, sf_dir):
    t = F.col("text")
    flat = F.trim(F.regexp_replace(t, r"\s+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.summarise(t).alias("line"), X.truncate(flat).alias("short"))


@query("fn_percent_decoded", REF_SQL + "SELECT k, url_decode(ref) AS decoded FROM r")
def _decoded(spark, sf_dir):
    return _ref(spark, sf_dir).select("k", X.percent_decoded(F.col("ref")).alias("decoded"))


@query("fn_family", rf"""WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'docs/RFCS/decisions/' WHEN 1 THEN 'specs/rfc/x/' WHEN 2 THEN 'a/' || lower(substr(o_orderpriority, 3, 3)) || '/adr/../' ELSE '' END || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '/adr' ELSE '.md' END AS path,
 ({NAMES!r})[o_orderkey % {len(NAMES)} + 1] AS name FROM orders),
d AS (SELECT *, list_transform(list_reverse(string_split(lower(path), '/')[:-2]), lambda x: (MAP {FAMILY_DIRECTORIES!r})[x]) AS families FROM p)
SELECT k, list_filter(families, lambda f: f IS NOT NULL)[1] AS family, coalesce(upper(nullif(regexp_extract(trim(name) || '-0', '{PREFIX_RE}', 1), '')) = upper(trim(name)), false) AS named FROM d""")
def _family(spark, sf_dir):
    k = F.col("o_orderkey")
    folder = F.when(k % 4 == 0, "docs/RFCS/decisions/").when(k % 4 == 1, "specs/rfc/x/").when(k % 4 == 2, F.concat(F.lit("a/"), F.lower(F.substring("o_orderpriority", 3, 3)), F.lit("/adr/../"))).otherwise("")
    path = F.concat(folder, k, F.when(k % 5 == 0, "/adr").otherwise(".md"))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), X.family_from_path(path).alias("family"), X.is_family_name(name).alias("named"))


@query("fn_status_heading", f"""WITH h AS (SELECT o_orderkey AS k, ({HEADINGS!r})[o_orderkey % {len(HEADINGS)} + 1] || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN ':' ELSE o_orderstatus END AS text, ({KEYS!r})[o_orderkey % {len(KEYS)} + 1] || '_' || o_orderpriority AS key FROM orders)
SELECT k, trim(regexp_replace(lower(text), '[:*_`]', '', 'g')) IN {STATUS_HEADINGS!r} AS heading, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS folded FROM h""")
def _heading(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    text = F.concat(pick(HEADINGS), F.when(k % 3 == 0, "").when(k % 3 == 1, ":").otherwise(F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), X.is_status_heading(text).alias("heading"), X.fold_relation_key(F.concat(pick(KEYS), F.lit("_"), "o_orderpriority")).alias("folded"))


@query("fn_escapes", r"""SELECT doc_id, md5(replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')) AS data, md5(replace(replace(replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')) AS property, md5(replace(replace(text, '\', '\\'), '"', '\"')) AS dot FROM documents""")
def _escapes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.escape_annotation(t)).alias("data"), F.md5(X.escape_annotation(t, True)).alias("property"), F.md5(X.escape_dot(t)).alias("dot"))


@query("fn_reference_glob", REF_SQL + "SELECT k, CASE k % 10 WHEN 0 THEN 'ORD-*' WHEN 5 THEN 'https://example.com/*' WHEN 7 THEN 'Notes.v*' WHEN 2 THEN ref ELSE trim(ref) END AS glob FROM r")
def _glob(spark, sf_dir):
    return _ref(spark, sf_dir).select("k", X.suggest_reference_glob(F.col("ref")).alias("glob"))


@query("glob_filter", r"WITH p AS (SELECT o_orderkey AS k, 'orders/' || o_custkey || '/' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.md' ELSE '.txt' END AS path FROM orders) SELECT k, path FROM p WHERE (regexp_full_match(path, 'orders/1[^/]*/[^/]*\.md') OR regexp_full_match(path, 'orders/(2|30)/.*')) AND NOT regexp_full_match(path, '(.*/)?[^/]*[5-7]\.(md|txt)')")
def _globs(spark, sf_dir):
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("orders/"), "o_custkey", F.lit("/"), k, F.when(k % 2 == 0, ".md").otherwise(".txt")).alias("path"))
    return p.where(glob_filter(F.col("path"), ["orders/1*/*.md", "orders/{2,30}/**", "!**/*[5-7].{md,txt}"]))
