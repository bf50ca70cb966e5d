"""Transitive steps: shortest paths from many starts at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.storage import settle

#: Edges that are sent to every task (some tens of MB); more are joined in rounds.
SMALL = 200_000
#: Rounds that one plan holds before its result is written.
ROUNDS = 2


PATHS = "start string, end string, path array<bigint>, moved boolean"


def _search(shared):
    """Breadth first from each start, edges in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = shared.value
        types = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], names=["start", "end", "path", "moved"])

        rows: list[tuple] = []
        for b in batches:
            for start in b.column(0).to_pylist():
                seen, queue = set(), deque([(start, (), False)])
                while queue:
                    node, path, moved = queue.popleft()
                    for number, other, reflexive in after.get(node, ()):
                        if other not in seen:
                            seen.add(other)
                            step = (other, (*path, number), moved or not reflexive)
                            rows.append((start, *step))
                            if other != start:
                                queue.append(step)
                if len(rows) > 20_000:
                    yield made(rows)
                    rows = []
        yield made(rows)

    return run


def shortest_paths(starts: DataFrame, edges: DataFrame, most: int = 10_000, small: int = SMALL) -> DataFrame:
    """``start, end, path array<bigint>, moved``: the shortest path from each start to each node it reaches.

    ``starts`` has one column; ``edges(a, b, edge_ord, reflexive)``.  Of equally
    short paths the one whose edge ordinals come first counts.  A start is its
    own end only by a path that leaves it and returns, and is not walked through
    again.  ``moved``: not every edge of the path is reflexive.

    Up to ``small`` edges go to every task, which searches from its own starts.
    Of more, each round extends the newest paths by one edge, keeps the least path to
    each new end and drops ends that were reached before.  Every ``ROUNDS``
    rounds the new paths are written to the shared folder.
    """
    name = starts.columns[0]
    adjacent = edges.select("a", "b", "edge_ord", "reflexive")
    few = adjacent.limit(small + 1).collect()
    if len(few) <= small:
        after: dict = {}
        for r in sorted(few, key=lambda r: r.edge_ord):
            after.setdefault(r.a, []).append((r.edge_ord, r.b, r.reflexive))
        return starts.select(F.col(name).cast("string")).where(F.col(name).isNotNull()).mapInArrow(_search(starts.sparkSession.sparkContext.broadcast(after)), PATHS)
    newest = starts.select(F.col(name).alias("start"), F.col(name).alias("end"), F.array().cast("array<bigint>").alias("path"), F.lit(False).alias("moved"))
    known, done = None, 0
    while done < most:
        layers = []
        for _ in range(ROUNDS):
            open_ = newest if done == 0 and not layers else newest.where("start <> end")
            grown = open_.join(adjacent, open_["end"] == adjacent["a"]).select("start", F.col("b").alias("end"), F.concat("path", F.array("edge_ord")).alias("path"), (F.col("moved") | ~F.col("reflexive")).alias("moved"))
            best = grown.groupBy("start", "end").agg(F.min(F.struct("path", "moved")).alias("x")).select("start", "end", "x.path", "x.moved")
            for old in [*([known] if known is not None else []), *layers]:
                best = best.join(old.select("start", "end"), ["start", "end"], "left_anti")
            layers.append(best)
            newest = best
        batch = layers[0]
        for layer in layers[1:]:
            batch = batch.unionAll(layer)
        done += ROUNDS
        # The depth tells the last layer, from which the next rounds go on.
        batch = settle(batch.withColumn("depth", F.size("path")), "paths")
        known = batch if known is None else known.unionAll(batch)
        newest = batch.where(F.col("depth") == done).drop("depth")
        if newest.isEmpty():
            break
    return known.select("start", "end", "path", "moved")
