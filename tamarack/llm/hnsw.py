"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors are one node that carries its smallest ids.  Nodes are dealt to
shards by a digest of the vector; a shard has some 64 times the root of the
number of nodes, so that shards and their number both grow with it.  Within a
shard nodes are inserted in blocks: each gets a top level drawn from its
digest with the usual geometric law, walks down the graph built so far with a
beam of ``ef_build``, meets the others of its block by a matrix product, and is
linked to neighbours that are nearer to it than to any neighbour kept before,
and back; a row of links that runs full is thinned by the same rule.  The
graph is stored as flat arrays: neighbours row by row, -1 where a row has
fewer.

A search descends greedily through the upper levels and runs a beam of ``ef``
nodes on the lowest; all queries of a block walk together.  A task loads a
shard's graph once and streams its queries past it; each query's results are
merged over the shards.

Nearness is the largest inner product.  The graph is built on vectors with one
more component, which makes their lengths equal, so that order by inner
product is order by distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.common import materialise, scratch, table

#: A shard has so many vectors at least, and so many bytes of them at most.
SHARD_ROWS, SHARD_BYTES = 1 << 13, 1 << 28
M, EF_BUILD, EF = 24, 128, 256
#: Nodes inserted at once, and bytes that mark the nodes which a block of walks has seen.
BLOCK, SEEN_BYTES = 1 << 11, 1 << 27
#: Nodes of a stored piece of a graph.
PIECE = 1 << 14
#: Open nodes that a walk looks behind at each step.
STRIDE = 2


def shard_rows_for(nodes: int, dim: int) -> int:
    """Grows with the root of ``nodes`` as far as a shard's vectors fit a task's memory."""
    return min(max(SHARD_ROWS, 64 * math.isqrt(nodes)), max(1, SHARD_BYTES // (8 * dim)))


def ef_for(rows: int) -> int:
    """Beam of a search: grows with the root of a shard's rows, as vectors without structure lose recall otherwise."""
    return max(EF, 2 * math.isqrt(rows))


def levels_of(digests: np.ndarray, m: int) -> np.ndarray:
    """Top levels by the law P(level >= k) = m ** -k, from 64 random bits each."""
    u = (digests >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(m)).astype(np.int64)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """One more component: all rows get the length of the longest."""
    sq = (vectors.astype(np.float64) ** 2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(sq.max() - sq, 0))[:, None]], 1).astype(np.float32)


def walk(queries: np.ndarray, x: np.ndarray, links: np.ndarray, start: np.ndarray, ef: int) -> np.ndarray:
    """For each query the ``ef`` rows of its beam, nearest first, -1 beyond the last."""
    step = max(1, SEEN_BYTES // max(1, len(x)))
    parts = [_walk(queries[at : at + step], x, links, start[at : at + step], ef) for at in range(0, len(queries), step)]
    return np.concatenate(parts) if parts else np.zeros((0, min(ef, len(x))), np.int64)


def _walk(queries: np.ndarray, x: np.ndarray, links: np.ndarray, start: np.ndarray, ef: int) -> np.ndarray:
    q, n, width = len(queries), len(x), links.shape[1]
    ef = min(ef, n)
    stride = min(STRIDE, ef)
    beam = np.full((q, ef), -1, np.int64)
    score = np.full((q, ef), -np.inf, np.float32)
    open_ = np.zeros((q, ef), bool)
    beam[:, 0], score[:, 0], open_[:, 0] = start, np.einsum("ij,ij->i", queries, x[start]), True
    seen = np.zeros((q, n), bool)
    seen[np.arange(q), start] = True
    moving = np.arange(q)
    while True:
        moving = moving[open_[moving].any(1)]
        if not len(moving):
            break
        near = np.empty((len(moving), stride * width), np.int64)
        fresh = np.zeros(near.shape, bool)
        for k in range(stride):
            j = np.where(open_[moving], score[moving], -np.inf).argmax(1)
            more = open_[moving, j]
            open_[moving, j] = False
            at = slice(k * width, (k + 1) * width)
            near[:, at] = links[np.maximum(beam[moving, j], 0)]
            fresh[:, at] = (near[:, at] >= 0) & more[:, None] & ~seen[moving[:, None], near[:, at]]
            row, col = np.nonzero(fresh[:, at])
            seen[moving[row], near[row, k * width + col]] = True
        row, col = np.nonzero(fresh)
        sims = np.full(near.shape, -np.inf, np.float32)
        sims[row, col] = np.einsum("ij,ij->i", queries[moving[row]], x[near[row, col]])
        all_score = np.concatenate([score[moving], sims], 1)
        pick = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
        score[moving] = np.take_along_axis(all_score, pick, 1)
        beam[moving] = np.where(np.isneginf(score[moving]), -1, np.take_along_axis(np.concatenate([beam[moving], near], 1), pick, 1))
        open_[moving] = np.take_along_axis(np.concatenate([open_[moving], fresh], 1), pick, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(beam, order, 1)


def choose(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, m: int, looked_at: int) -> np.ndarray:
    """Up to ``m`` of each row's ``candidates`` (-1: none), the nearest ``looked_at`` of them looked at: nearer to ``own`` than to any kept before, then the nearest passed over; -1 beyond the last."""
    out = np.full((len(own), m), -1, np.int32)
    for at in range(0, len(own), 256):
        c = candidates[at : at + 256]
        near = np.where(c >= 0, np.einsum("ij,ikj->ik", own[at : at + 256], x[np.maximum(c, 0)]), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")[:, :looked_at]
        c, near = np.take_along_axis(c, order, 1), np.take_along_axis(near, order, 1)
        v = x[np.maximum(c, 0)]
        between = v @ v.transpose(0, 2, 1)
        use, count = np.zeros(c.shape, bool), np.zeros(len(c), np.int64)
        for j in range(c.shape[1]):
            ok = (count < m) & (c[:, j] >= 0) & ~(use & (between[:, j] > near[:, j, None])).any(1)
            use[:, j] = ok
            count += ok
        for j in range(c.shape[1]):  # places that stay free go to the nearest passed over
            ok = (count < m) & (c[:, j] >= 0) & ~use[:, j]
            use[:, j] |= ok
            count += ok
        r, j = np.nonzero(use)
        out[at + r, np.cumsum(use, 1)[r, j] - 1] = c[r, j]
    return out


def _link(x: np.ndarray, links: np.ndarray, begin: int, end: int, found: np.ndarray, m: int, ef: int) -> None:
    """Links rows ``begin`` to ``end`` to those that their walks ``found`` and to each other, and back."""
    own, b = x[begin:end], end - begin
    near = own @ own.T
    np.fill_diagonal(near, -np.inf)
    c = min(ef, b - 1)
    beside = np.argpartition(-near, c - 1, axis=1)[:, :c] + begin if c else np.zeros((b, 0), np.int64)
    kept = choose(x, own, np.concatenate([found, beside], 1), m, ef)
    links[begin:end, :m] = kept
    row, col = np.nonzero(kept >= 0)
    a, t = row + begin, kept[row, col].astype(np.int64)
    new = ~(links[t] == a[:, None]).any(1)
    a, t = a[new], t[new]
    order = np.lexsort((-np.einsum("ij,ij->i", x[a], x[t]), t))  # the nearest first
    a, t = a[order], t[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    nth = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
    width = links.shape[1]
    place = (links[t] >= 0).sum(1) + nth
    fits = place < width
    links[t[fits], place[fits]] = a[fits]
    if fits.all():
        return
    a, t, nth = a[~fits], t[~fits], (place - width)[~fits]
    full, which = np.unique(t, return_inverse=True)
    more = np.full((len(full), width), -1, np.int64)
    some = nth < width
    more[which[some], nth[some]] = a[some]
    links[full] = -1
    links[full, : 2 * m] = choose(x, x[full], np.concatenate([_held(links, full), more], 1), 2 * m, 2 * width)


def _held(links: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return links[rows].astype(np.int64)


class Graph:
    """Flat arrays: the vectors, and for each level its nodes and their neighbours as rows of the level."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels
        self.upper = [vectors if not k else vectors[nodes] for k, (nodes, _) in enumerate(levels)]

    @classmethod
    def build(cls, vectors: np.ndarray, digests: np.ndarray, m: int = M, ef: int = EF_BUILD) -> Graph:
        """Inserts the vectors in their order, which should be random, in blocks that double up to ``BLOCK``."""
        x, top, n = lifted(vectors), levels_of(digests, m), len(vectors)
        nodes = [np.flatnonzero(top >= k) for k in range(int(top.max()) + 1)]
        xs = [x if not k else x[nd] for k, nd in enumerate(nodes)]
        links = [np.full((len(nd), 3 * m), -1, np.int32) for nd in nodes]
        begin = 0
        while begin < n:
            end = min(n, begin + min(BLOCK, max(256, begin)))
            entry = None  # the node from which each of the block goes on
            for k in range(len(nodes) - 1, -1, -1):
                r0, r1 = np.searchsorted(nodes[k], (begin, end))
                found = np.zeros((r1 - r0, 0), np.int64)
                if r0:
                    at = np.zeros(end - begin, np.int64) if entry is None else np.searchsorted(nodes[k], entry)
                    stays = nodes[k][r0:r1] - begin
                    passes = np.setdiff1d(np.arange(end - begin), stays)
                    found = walk(xs[k][r0:r1], xs[k][:r0], links[k], at[stays], ef)
                    at[passes] = walk(x[begin + passes], xs[k][:r0], links[k], at[passes], 1)[:, 0]
                    if len(stays):
                        at[stays] = found[:, 0]
                    entry = nodes[k][at]
                if r1 > r0:
                    _link(xs[k], links[k], int(r0), int(r1), found, m, ef)
            begin = end
        out = []
        for k, nd in enumerate(nodes):
            wide = np.flatnonzero(links[k][:, 2 * m] >= 0)
            links[k][wide, : 2 * m] = choose(xs[k], xs[k][wide], _held(links[k], wide), 2 * m, 3 * m)
            out.append((nd.astype(np.int32), np.ascontiguousarray(links[k][:, : 2 * m])))
        return cls(vectors, out)

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """For each query the ``ef`` nodes of its beam, nearest first, -1 beyond the last."""
        entry = None
        for k in range(len(self.levels) - 1, 0, -1):
            nodes, links = self.levels[k]
            at = np.zeros(len(queries), np.int64) if entry is None else np.searchsorted(nodes, entry)
            entry = nodes[walk(queries, self.upper[k], links, at, 1)[:, 0]]
        return walk(queries, self.vectors, self.levels[0][1], np.zeros(len(queries), np.int64) if entry is None else entry.astype(np.int64), ef)


def _usable(ids: list, vectors: list) -> Iterator[tuple[int, np.ndarray]]:
    for i, v in zip(ids, vectors, strict=True):
        if i is None or v is None or not len(v) or None in v:
            continue
        a = np.array(v, np.float64)
        if np.isfinite(a).all() and a.any():
            yield i, a + 0.0  # one zero


NODES = "dim int, vector binary, ids array<long>, query_ids array<long>"


def _nodes(keep: int, every: int):
    """Equal vectors of a batch as one row with the ``keep`` smallest ids and the ids that are queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in _usable(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(v.tobytes(), []).append(i)
            rows = [(len(k) // 8, k, sorted(set(ids))[:keep], [i for i in ids if i % every == 0]) for k, ids in held.items()]
            types = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], names=["dim", "vector", "ids", "query_ids"])

    return run


#: A piece of a graph (kind 0: vectors, ids and lowest links of a stretch of nodes; kind 1: an upper level) or a query (kind 2).
PIECES = "dim int, shard int, kind int, seq int, vectors binary, ids array<array<long>>, nodes binary, links binary"


def _build(m: int, ef: int):
    """Rows ordered by (dim, shard) -> the pieces of each one's graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        types = [pa.int32()] * 4 + [pa.binary(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.binary()]

        def made():
            dim, shard = held[0][:2]
            vectors = np.frombuffer(b"".join(r[3] for r in held), np.float64).reshape(-1, dim)
            digests = np.frombuffer(b"".join(r[2][8:16] for r in held), np.uint64)
            ids = [r[4] for r in held]
            held.clear()
            graph = Graph.build(vectors.astype(np.float32), digests, m, ef)
            rows = [(dim, shard, 0, at, vectors[at : at + PIECE].tobytes(), ids[at : at + PIECE], None, graph.levels[0][1][at : at + PIECE].tobytes()) for at in range(0, len(vectors), PIECE)]
            rows += [(dim, shard, 1, k, None, None, nodes.tobytes(), links.tobytes()) for k, (nodes, links) in enumerate(graph.levels) if k]
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield from made()
                held.append(row)
        if held:
            yield from made()

    return run


def _key() -> "F.Column":
    return F.unhex(F.md5("vector"))


def index(parts: DataFrame, keep: int, shard_rows: int | None = None, m: int = M, ef_build: int = EF_BUILD) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The pieces of the shards' graphs, written to the shared folder, and for each vector length (shards, rows of a shard).

    ``parts(dim, vector, ids)``: a node keeps its ``keep`` smallest ids of all its parts.
    """
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    # A hot vector comes once from each batch of rows: gathered in two steps, so that neither list grows with the input as a whole.
    some = parts.groupBy("dim", "vector", F.pmod(F.xxhash64("ids"), F.lit(256)).alias("salt")).agg(least)
    nodes = materialise(some.groupBy("dim", "vector").agg(least).withColumn("key", _key()), "nodes")
    counts = {r.dim: r["count"] for r in nodes.groupBy("dim").count().collect()}  # a row for each vector length
    rows_of = {d: shard_rows or shard_rows_for(n, d) for d, n in counts.items()}
    sizes = {d: (-(-n // rows_of[d]), rows_of[d]) for d, n in counts.items()}
    shards = F.coalesce(*[F.when(F.col("dim") == d, F.lit(s)) for d, (s, _) in sizes.items()], F.lit(1))
    dealt = nodes.select("dim", F.pmod(F.xxhash64("key"), shards).cast("int").alias("shard"), "key", "vector", "ids")
    # More partitions than shards: few share one, and AQE doesn't put small ones together.
    tasks = 4 * max(1, sum(s for s, _ in sizes.values()))
    rows = dealt.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "key")
    return materialise(rows.mapInArrow(_build(m, ef_build), PIECES), "graphs"), sizes


MATCHES = "key binary, vec_id long, score double"


def _search(k: int, ef: int | None, m: int):
    """Rows ordered by (dim, shard, part, kind, seq): a graph's pieces, then its queries -> the k nearest ids of each query in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, pieces, graph, vectors, ids = None, [], None, None, []
        asked: list[tuple[bytes, bytes]] = []

        def load(dim: int):
            low = [p for p in pieces if p[0] == 0]
            found = np.frombuffer(b"".join(p[1] for p in low), np.float64).reshape(-1, dim)
            links = np.frombuffer(b"".join(p[4] for p in low), np.int32).reshape(-1, 2 * m)
            levels = [(np.arange(len(found), dtype=np.int32), links), *((np.frombuffer(p[3], np.int32), np.frombuffer(p[4], np.int32).reshape(-1, 2 * m)) for p in pieces if p[0] == 1)]
            return Graph(found.astype(np.float32), levels), found, [i for p in low for i in p[2]]

        def answer():
            queries = np.frombuffer(b"".join(v for _, v in asked), np.float64).reshape(len(asked), -1)
            keys, hits, scores = [], [], []
            for (key, _), q, beam in zip(asked, queries, graph.search(queries.astype(np.float32), ef or ef_for(len(vectors))), strict=True):
                beam = beam[beam >= 0]
                best: dict[int, float] = {}
                for s, i in sorted((-s, i) for x, s in zip(beam.tolist(), (vectors[beam] @ q).tolist(), strict=True) for i in ids[x]):
                    if len(best) < k:
                        best.setdefault(i, -s)
                keys += [key] * len(best)
                hits += best.keys()
                scores += best.values()
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hits, pa.int64()), pa.array(scores, pa.float64())], names=["key", "vec_id", "score"])

        for b in batches:
            for at in range(0, b.num_rows, 64):
                for dim, shard, part, kind, v, own, nodes, links in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    if (dim, shard, part) != name:
                        if asked:
                            yield answer()
                        name, pieces, graph = (dim, shard, part), [], None
                    if kind < 2:
                        pieces.append((kind, v, own, nodes, links))
                        continue
                    if graph is None:
                        graph, vectors, ids = load(dim)
                        pieces = []
                    asked.append((nodes, v))
                    if len(asked) == 1024:
                        yield answer()
        if asked:
            yield answer()

    return run


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, ef: int | None = None, shard_rows: int | None = None, m: int = M, ef_build: int = EF_BUILD) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose ``vec_id`` is divisible by ``every`` its ``k`` nearest other ids found.

    Ordered by inner product in double precision, ties to the smaller id.
    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without an id, take no part; vectors of another length are only
    compared with their like.  Repeated ids count once; rows with a query's
    own id are none of its results.  Other columns are passed over; an empty
    table gives an empty result.  ``shard_rows``: nodes of a shard, by default
    ``shard_rows_for`` of their number; ``ef``: the beam, by default ``ef_for``
    of a shard's rows.
    """
    with scratch() as kept:
        parts = materialise(embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_nodes(k + 1, every), NODES), "vectors")
        graphs, sizes = index(parts.select("dim", "vector", "ids"), k + 1, shard_rows, m, ef_build)
        # Equal vectors are one query, whatever the number of rows that ask it.
        asked = materialise(parts.where(F.size("query_ids") > 0).select("dim", "vector").distinct().withColumn("key", _key()), "asked")
        counts = {r.dim: r["count"] for r in asked.groupBy("dim").count().collect()}
        # As many queries to a copy of a shard's graph as the shard has rows.
        copies = {d: -(-n // sizes[d][1]) for d, n in counts.items()}
        of = lambda table: F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in table.items()], F.lit(0))
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1))
        shards = of({d: s for d, (s, _) in sizes.items()})
        pieces = graphs.withColumn("part", F.explode(upto(of(copies)))).select("dim", "shard", "part", "kind", "seq", "vectors", "ids", "nodes", "links")
        met = asked.withColumn("shard", F.explode(upto(shards))).select(
            "dim", "shard", F.pmod(F.xxhash64("key", F.lit(9)), of(copies)).cast("int").alias("part"), F.lit(2).alias("kind"), F.lit(0).alias("seq"), F.col("vector").alias("vectors"),
            F.lit(None).cast("array<array<long>>").alias("ids"), F.col("key").alias("nodes"), F.lit(None).cast("binary").alias("links"),
        )
        tasks = 4 * max(1, sum(sizes[d][0] * n for d, n in copies.items()))
        rows = pieces.unionAll(met).repartition(tasks, "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "kind", "seq", "nodes")
        found = rows.drop("seq").mapInArrow(_search(k + 1, ef, m), MATCHES).groupBy("key", "vec_id").agg(F.max("score").alias("score"))
        first = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("key").agg(F.collect_list(F.struct("vec_id", "score")).alias("hits"))
        best = materialise(best, "best")
        kept += [parts, best]
    # k + 1 ids of a vector leave k when a query's own is taken out.
    queries = parts.select(F.explode("query_ids").alias("query_id"), _key().alias("key"))
    out = queries.join(best, "key").select("query_id", F.explode("hits").alias("hit")).where("hit.vec_id <> query_id").groupBy("query_id", "hit.vec_id").agg(F.max("hit.score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
