"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import drop, materialise

#: Nodes with so many links that they are joined by broadcast: at most twice this number.
HUBS = 1 << 13


def with_least(rows: DataFrame, links: DataFrame, many: int) -> DataFrame:
    """``rows(a, b)`` with ``m``, the least ``b`` of ``links`` for the ``a``.

    A hub, which has over ``many`` links, would be one task's work in a join
    by ``a``; hubs are few (the links over ``many``) and are sent to all tasks.
    """
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > many).select("a", F.col("m").alias("hub_m")))
    met = rows.join(hubs, "a", "left")
    rest = met.where("hub_m is null").select("a", "b").join(least.where(F.col("n") <= many).select("a", "m"), "a")
    return met.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")).unionAll(rest)


def _large_star(edges: DataFrame, many: int) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = with_least(both.where("b > a"), both, many)
    return moved.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, many: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = with_least(down, down, many)
    moved = moved.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
    return moved.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60, hubs: int = HUBS) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the least node reachable.

    Alternates large-star and small-star rounds until each node points at its
    component's least node; the number of rounds grows with the logarithm of
    the longest chain.  Minima are combined before the shuffle; a node with
    over one in ``hubs`` of all links is joined by broadcast (at most twice
    ``hubs`` such nodes).  Each round's links are written to the shared folder.
    Links whose ends are equal or null are passed over.
    """
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        many = max(32, now.count() // hubs)
        wide = materialise(_large_star(now, many), "links")
        nxt = materialise(_small_star(wide, many), "links")
        # Stars only: each start has one link, and no end of a link is itself the start of one.
        same = not nxt.groupBy("a").count().where("count > 1").head(1)
        same = same and not nxt.select(F.col("b").alias("a")).distinct().join(nxt.select("a"), "a", "left_semi").head(1)
        drop(wide)
        drop(now)
        now = nxt
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._tamarack_path = now._tamarack_path
    return out
