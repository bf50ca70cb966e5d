"""The property graph: a table of nodes and a table of edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.storage import settle

NODE_SCHEMA = (
    "id string, kind string, title string, file string, line int, path string, aliases array<string>, phase string, receptivity string, history boolean, raw_status string, "
    "fm map<string,array<string>>, document string, declared boolean, section array<string>, text string, body string, disposition string, openness string, evidence string, "
    "conflicts array<struct<source:string,disposition:string,raw:string>>, status_line int, status_column int, column int, node_ord bigint"
)
EDGE_SCHEMA = "kind string, from string, to string, origin string, file string, line int, column int, raw string, declared_in array<string>, reflexive boolean, edge_ord bigint"


@dataclass(frozen=True)
class SpecGraph:
    """``nodes``: documents and items; items carry their document's phase, receptivity, status, path and aliases.
    ``edges`` are unique in (kind, from, to), and ``edge_ord`` and ``node_ord`` say what comes first."""

    nodes: DataFrame
    edges: DataFrame

    def settled(self) -> SpecGraph:
        """The same tables, written once: for what reads them many times."""
        return SpecGraph(settle(self.nodes, "nodes"), settle(self.edges, "edges"))

    @property
    def documents(self) -> DataFrame:
        return self.nodes.where("kind = 'document'")

    @property
    def items(self) -> DataFrame:
        return self.nodes.where("kind = 'item'")


def with_known_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")


def with_owners(graph: SpecGraph, edges: DataFrame) -> DataFrame:
    """``edges`` with the documents that own their ends.  An item's id begins with its document's, so no join is needed."""
    return edges.withColumns({"from_document": F.substring_index("from", "#", 1), "to_document": F.substring_index("to", "#", 1)})


def lifted(graph: SpecGraph, kinds: list[str] | None = None) -> DataFrame:
    """``kind, from, to, edge_ord`` between documents: the first edge of each kind and pair stands for all."""
    edges = graph.edges if kinds is None else graph.edges.where(F.col("kind").isin(*kinds))
    own = with_owners(graph, edges).where("from_document <> to_document")
    return own.groupBy("kind", F.col("from_document").alias("from"), F.col("to_document").alias("to")).agg(F.min("edge_ord").alias("edge_ord"))


def unique_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (kind, from, to): the first, with the files that declare it in order of appearance."""
    rest = [c for c in edges.columns if c not in ("kind", "from", "to", "declared_in", "edge_ord")]
    said = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", "file"))), lambda x: x["file"]))
    first = F.min(F.struct("edge_ord", *rest)).alias("first")
    return edges.groupBy("kind", "from", "to").agg(first, said.alias("declared_in")).select("kind", "from", "to", "declared_in", "first.*")
