"""Baselines and graph exports on disk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, SpecGraph

ENTRY = "rule string, document string, subject string, count bigint"


class FormatError(ValueError):
    pass


def read_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The entries of a baseline file, and what is wrong with it; a file that can't be read has no entries."""
    empty = spark.createDataFrame([], ENTRY)
    try:
        raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (ValueError, TypeError) as e:
        return empty, [f"the baseline is not JSON: {e}"]
    if not isinstance(raw, dict) or raw.get("version") != 1 or not isinstance(raw.get("findings"), list):
        return empty, ["a baseline has version 1 and a list of findings"]
    rows, problems = [], []
    for k, f in enumerate(raw["findings"]):
        count = f.get("count", 1) if isinstance(f, dict) else None
        if isinstance(f, dict) and isinstance(f.get("rule"), str) and isinstance(f.get("document"), str) and isinstance(f.get("subject", ""), str) and isinstance(count, int) and count >= 1:
            rows.append((f["rule"], f["document"], f.get("subject", ""), count))
        else:
            problems.append(f"finding {k} of the baseline is not read")
    return spark.createDataFrame(rows, ENTRY), problems


def baseline_json(tally: DataFrame) -> str:
    """A baseline file's text, in the order of rule, document and subject."""
    rows = tally.orderBy("rule", "document", "subject").collect()
    return json.dumps({"version": 1, "findings": [{"rule": r.rule, "document": r.document, **({"subject": r.subject} if r.subject else {}), **({"count": r["count"]} if r["count"] > 1 else {})} for r in rows]}, indent=2) + "\n"


_NODE = "id string, kind string, title string, file string, line int, path string, phase string, status string, aliases array<string>, declared boolean, document string, section array<string>, disposition string, openness string"
_EDGE = "kind string, from string, to string, origin string, declaredIn array<string>, file string, line int"


def read_generator(spark: SparkSession, path: str) -> dict | None:
    """What program and version a graph export says it was made by."""
    r = spark.read.schema("generator struct<name:string,version:string>").json(path, multiLine=True).first()
    return None if r is None or r.generator is None else r.generator.asDict()


def read_graph_export(spark: SparkSession, path: str) -> SpecGraph:
    """A graph export of version 1, one JSON object over any number of lines."""
    raw = spark.read.schema(f"version int, nodes array<struct<{_NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{_EDGE.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    head = raw.select("version", F.col("nodes").isNotNull().alias("n"), F.col("edges").isNotNull().alias("e")).first()
    if head is None or head.version != 1 or not head.n or not head.e:
        raise FormatError(f"{path} is no graph export of version 1")
    n = raw.select(F.posexplode("nodes").alias("node_ord", "n")).select("node_ord", "n.*").withColumnRenamed("status", "raw_status")
    e = raw.select(F.posexplode("edges").alias("edge_ord", "e")).select("edge_ord", "e.*").withColumnRenamed("declaredIn", "declared_in")
    e = e.withColumn("reflexive", (F.substring_index("from", "#", 1) == F.substring_index("to", "#", 1)) & (F.col("kind") != "contains"))

    def shaped(df: DataFrame, schema: str) -> DataFrame:
        fields = spark.createDataFrame([], schema).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    n = n.withColumns({"document": F.coalesce("document", "id"), "text": F.col("title"), "declared": F.coalesce("declared", F.lit(False))})
    return SpecGraph(shaped(n, NODE_SCHEMA), shaped(e, EDGE_SCHEMA))
