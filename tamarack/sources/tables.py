"""The property graph of the order tables: orders are documents, their lines items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.text import phase_of, receptivity_of
from tamarack.operators.graph import SpecGraph

LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
#: (line status, return flag): what has become of the line.
DISPOSITIONS = {("O", "N"): "unresolved", ("O", "A"): "delegated", ("O", "R"): "narrowed", ("F", "N"): "satisfied", ("F", "A"): "accepted-debt", ("F", "R"): "obviated"}
#: Ordinals of an order's lines stay below.
LINES = 1000
ORD = {"contains": 1, "supersedes": 2, "depends-on": 3, "delegates-to": 4, "references": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with ``k, id, path, raw_status, phase, receptivity, history, priority, cust, date``."""
    o = table(spark, sf_dir, "orders")
    pick = F.substring("o_orderpriority", 1, 1)
    status = F.when(F.col("o_orderstatus") == "O", "accepted").when(F.col("o_orderstatus") == "F", "superseded").when(pick == "1", "Archived").when(pick == "2", "*Final*").when(pick == "3", "on hold").otherwise("draft")
    out = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("ORD-"), "o_orderkey").alias("id"), F.concat(F.lit("orders/"), "o_custkey", F.lit("/"), "o_orderkey").alias("path"), status.alias("raw_status"),
                   F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("date"))
    out = out.withColumn("phase", phase_of(F.col("raw_status")))
    return out.withColumns({"receptivity": receptivity_of(F.col("phase")), "history": (F.col("phase") == "record") & (F.col("cust") % 2 == 0)})


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with ``k, n, id, disposition, openness, flag, part, discount``; ``n`` numbers an order's lines by all their columns."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS))
    line = table(spark, sf_dir, "lineitem").withColumn("n", number)
    disposition = None
    for (status, flag), name in DISPOSITIONS.items():
        hit = (F.col("l_linestatus") == status) & (F.col("l_returnflag") == flag)
        disposition = F.when(hit, name) if disposition is None else disposition.when(hit, name)
    openness = F.when(F.col("disposition").isin("unresolved", "delegated"), "open").when(F.col("disposition") == "narrowed", "partial").otherwise("closed")
    out = line.select(F.col("l_orderkey").alias("k"), "n", F.concat(F.lit("ORD-"), "l_orderkey", F.lit("#line."), "n").alias("id"), disposition.alias("disposition"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"), F.col("l_discount").alias("discount"))
    return out.withColumn("openness", openness)


def _linked(k):
    """The order that order ``k`` rests on: in each block of ten a cycle of six and four tails."""
    r = k % 10
    return k - r + (r * r + 1) % 10


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("date"))
    lines = order_lines(spark, sf_dir).select("k", "n", "id", "disposition")
    doc = lambda c: F.concat(F.lit("ORD-"), c)
    ordinal = lambda kind, c: (F.lit(ORD[kind] << 50) + c).cast("bigint")
    at = F.col("k") * LINES + F.col("n")
    before = F.lag("k").over(Window.partitionBy("cust").orderBy("date", "k"))
    path = lambda c: F.concat(F.lit("orders/"), "cust", F.lit("/"), c)
    said = F.when(F.col("k") % 2 == 0, F.array(path("k"), path("prev"))).otherwise(F.array(path("k")))
    alone = lambda c: F.array(c).alias("declared_in")
    parts = [
        lines.select(F.lit("contains").alias("kind"), doc("k").alias("from"), F.col("id").alias("to"), alone(doc("k")), ordinal("contains", at).alias("edge_ord")),
        o.withColumn("prev", before).where("prev is not null").select(F.lit("supersedes"), doc("k"), doc("prev"), said, ordinal("supersedes", F.col("k"))),
        o.select(F.lit("depends-on"), doc("k"), doc(_linked(F.col("k"))), alone(path("k")), ordinal("depends-on", F.col("k"))),
        lines.where("disposition = 'delegated'").select(F.lit("delegates-to"), "id", doc(_linked(F.col("k"))), alone(doc("k")), ordinal("delegates-to", at)),
        lines.where("disposition = 'narrowed'").select(F.lit("references"), "id", doc("k"), alone(doc("k")), ordinal("references", at)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select(
        "kind", "from", "to", F.when(F.col("kind") == "contains", "structural").otherwise("directive").alias("origin"), F.col("declared_in")[0].alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("").alias("raw"),
        "declared_in", (F.col("kind") == "references").alias("reflexive"), "edge_ord",
    )


def order_graph(spark: SparkSession, sf_dir: str) -> SpecGraph:
    """Every order and line with its relations.  Items inherit from their order by one join on the order's key."""
    d, i = order_documents(spark, sf_dir), order_lines(spark, sf_dir)
    fm = F.create_map(F.lit("priority"), F.array("priority"), F.lit("cust"), F.array(F.col("cust").cast("string")), F.lit("tags"), F.array(F.lower("raw_status"), F.substring("priority", 1, 1)))
    none = lambda t: F.lit(None).cast(t)
    aliases = F.array(F.concat(F.lit("ord"), "k"), F.col("k").cast("string"))
    shared = ["path", "phase", "receptivity", "history", "raw_status"]
    documents = d.select(
        "id", F.lit("document").alias("kind"), F.col("priority").alias("title"), F.col("path").alias("file"), F.lit(1).alias("line"), "path", aliases.alias("aliases"), "phase", "receptivity", "history", "raw_status",
        fm.alias("fm"), F.col("id").alias("document"), F.lit(True).alias("declared"), none("array<string>").alias("section"), none("string").alias("text"), none("string").alias("body"), none("string").alias("disposition"),
        none("string").alias("openness"), none("string").alias("evidence"), none("array<struct<source:string,disposition:string,raw:string>>").alias("conflicts"), F.lit(2).alias("status_line"), F.lit(9).alias("status_column"), F.lit(1).alias("column"), (F.col("k") * LINES).alias("node_ord"),
    )
    conflict = F.when((F.col("disposition") == "obviated") & (F.col("discount") > 0.05), F.array(F.struct(F.lit("checkbox").alias("source"), F.lit("unresolved").alias("disposition"), F.lit("[ ]").alias("raw")))).otherwise(F.array().cast("array<struct<source:string,disposition:string,raw:string>>"))
    text = F.concat(F.lit("line "), "n", F.lit(" part "), "part")
    joined = i.join(d.select("k", *shared), "k")
    items = joined.select(
        "id", F.lit("item").alias("kind"), text.alias("title"), F.col("path").alias("file"), (F.col("n") + 1).alias("line"), "path", aliases.alias("aliases"), "phase", "receptivity", "history", "raw_status",
        none("map<string,array<string>>").alias("fm"), F.concat(F.lit("ORD-"), "k").alias("document"), F.lit(False).alias("declared"), F.array(F.lit("Lines"), F.col("flag")).alias("section"), text.alias("text"), F.concat(text, F.lit(" flag "), "flag").alias("body"),
        "disposition", "openness", F.lit("checkbox").alias("evidence"), conflict.alias("conflicts"), F.lit(2).alias("status_line"), F.lit(9).alias("status_column"), F.lit(1).alias("column"), (F.col("k") * LINES + F.col("n")).alias("node_ord"),
    )
    return SpecGraph(documents.unionByName(items), order_edges(spark, sf_dir))
