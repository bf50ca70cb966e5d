"""Cycles: strongly connected components by trimming and colouring."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.storage import settle

ROUNDS = 4
#: Edges that one task searches by itself (some tens of MB); more are searched in rounds.
SMALL = 200_000


def _trim(edges: DataFrame) -> DataFrame:
    """Without edges whose ends lack a way in or a way out, until none is left to take."""
    count = edges.count()
    while count:
        for _ in range(ROUNDS):
            edges = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        edges = settle(edges, "trimmed")
        left = edges.count()
        if left == count:
            break
        count = left
    return edges


def _least(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Each node's least colour of those that reach it."""
    while True:
        now = colour
        for _ in range(ROUNDS):
            sent = edges.join(now, edges["a"] == now["node"]).select(F.col("b").alias("node"), "colour")
            now = sent.unionAll(now).groupBy("node").agg(F.min("colour").alias("colour"))
        now = settle(now, "colours")
        changed = now.join(colour.withColumnRenamed("colour", "was"), "node").where("colour <> was")
        if changed.isEmpty():
            return now
        colour = now


def strong_components(edges: list[tuple]) -> list[list]:
    """Components of more than one node, depth first with an explicit stack."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for b in rest:
                if b not in index:
                    index[b] = low[b] = len(index)
                    stack.append(b)
                    on.add(b)
                    work.append((b, iter(after.get(b, ()))))
                    break
                if b in on:
                    low[node] = min(low[node], index[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = [stack.pop()]
                    while members[-1] != node:
                        members.append(stack.pop())
                    on.difference_update(members)
                    if len(members) > 1:
                        out.append(members)
    return out


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [e for b in batches for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    rows = [(min(c), n) for c in strong_components(edges) for n in c]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], names=["component", "node"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``component, node`` for each component of more than one node, and each node with an edge to itself.

    ``edges(a, b)`` are strings.  ``component`` is the least of its nodes' ids.
    Up to ``small`` edges are searched depth first by one task.  Of more, nodes
    without a way in or out are trimmed; then the least id that reaches a node
    colours it; what reaches the colour's own node within the colour is that
    node's component; it is taken out, and the rest goes round again.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b").distinct()
    loops = edges.where("a = b").select(F.col("a").alias("component"), F.col("a").alias("node"))
    rest, out = settle(edges.where("a <> b"), "edges"), None
    if rest.count() <= small:
        # Written, so that what reads it more than once doesn't search again.
        out = settle(rest.coalesce(1).mapInArrow(_in_one_task, "component string, node string"), "component")
    else:
        out = _in_rounds(_trim(rest))
    loops = loops if out is None else loops.join(out.select("node"), "node", "left_anti").select("component", "node")
    return loops if out is None else out.unionByName(loops)


def _in_rounds(rest: DataFrame) -> DataFrame | None:
    out = None
    while not rest.isEmpty():
        nodes = rest.select(F.col("a").alias("node")).unionAll(rest.select(F.col("b").alias("node"))).distinct()
        colour = _least(rest, nodes.withColumn("colour", F.col("node")))
        inside = rest.join(colour.select(F.col("node").alias("a"), "colour"), "a").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("other")), "b").where("colour = other").select("a", "b", "colour")
        inside = settle(inside, "inside")
        # Backwards from each colour's own node.
        back = settle(colour.where("node = colour").select("node", "colour"), "back")
        grown, seen = back, back
        while True:
            for _ in range(ROUNDS):
                step = inside.join(grown.select(F.col("node").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("node"), "colour").distinct()
                grown = step.join(seen, ["node", "colour"], "left_anti")
                seen = seen.unionAll(grown)
            before = back.count()
            back = settle(seen.distinct(), "back")
            if back.count() == before:
                break
            seen = back
            grown = back
        found = settle(back.select(F.col("colour").alias("component"), "node"), "component")
        size = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
        large = found.join(size.select("component"), "component", "left_semi")
        out = large if out is None else out.unionAll(large)
        gone = found.select(F.col("node").alias("a"))
        rest = rest.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b")
        rest = _trim(settle(rest, "rest"))
    return out
