"""SimHash near-duplicate search with pigeonring filtering.

A fingerprint's 64 bits lie in 16 segments of 4 bits on a ring.  If two
fingerprints differ in at most T bits, some start exists from which every
chain of l consecutive segments differs in at most ``l * T / 16`` bits (the
pigeonring principle).  The first ``chain`` segments of such a chain give the
lookup keys: the budgets say how many of them may differ at each length, and
for each largest set of segments that may, the others form a key that both
fingerprints share.  Rows that meet under a key are tested against the budgets
of the whole chain and then against T.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import materialise, scratch, table
from tamarack.llm.components import components

SEGMENTS, BITS = 16, 4
#: Members of a key's group that one task searches; larger groups are cut into blocks.
GROUP_ROWS = 20_000


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Lower-cases A-Z, takes word shingles, repeats included; a bit is set if over half the shingles' XXH64 have it."""
    split = (text or "").encode().lower().split()
    if not split:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(split) <= words:
        hashes = np.array([digest(b" ".join(split), seed)], dtype=">u8")
    else:
        hashes = np.fromiter((digest(b" ".join(s), seed) for s in zip(*(split[i:] for i in range(words)), strict=False)), np.uint64, len(split) - words + 1).astype(">u8")
    ones = np.zeros(64, np.int64)
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(words: int, seeds: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                cols = [pa.array(np.array([fingerprint(t, words, s) for t in texts], np.uint64).view(np.int64)) for s in seeds]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *cols], names=["doc_id", *[f"fp{i}" for i in range(len(seeds))]])

    return run


def variants(distance: int, chain: int) -> list[tuple[int, int]]:
    """(start, mask) of every lookup key for fingerprints within ``distance``."""
    budget = [l * distance // SEGMENTS for l in range(chain + 1)]
    fits = lambda d: all(sum(x < l for x in d) <= budget[l] for l in range(1, chain + 1))
    dropped = [d for d in combinations(range(chain), budget[chain]) if fits(d)]
    out = []
    for start in range(SEGMENTS):
        for d in dropped:
            mask = 0
            for k in range(chain):
                if k not in d:
                    mask |= ((1 << BITS) - 1) << (BITS * ((start + k) % SEGMENTS))
            out.append((start, mask))
    return out


def _chains(distance: int) -> np.ndarray:
    """[start, l]: the bits of the l + 1 segments from start on."""
    out = np.zeros((SEGMENTS, SEGMENTS), np.uint64)
    for start in range(SEGMENTS):
        mask = 0
        for k in range(SEGMENTS):
            mask |= ((1 << BITS) - 1) << (BITS * ((start + k) % SEGMENTS))
            out[start, k] = mask
    return out


class Linker:
    """Finds which fingerprints of a group are linked."""

    def __init__(self, distance: int, total: int | None):
        self.distance, self.total, self.masks = distance, total, _chains(distance)
        # Only the longest chain for each budget can exclude more than the shorter ones do.
        self.lengths = [l for l in range(1, SEGMENTS + 1) if l == SEGMENTS or l * distance // SEGMENTS < (l + 1) * distance // SEGMENTS]

    def linked(self, fps: list[np.ndarray], other: list[np.ndarray], start) -> np.ndarray:
        x = fps[0] ^ other[0]
        ok = np.ones(x.shape, bool)
        for l in self.lengths:  # the last is the whole ring: the full Hamming distance
            ok &= np.bitwise_count(x & self.masks[start, l - 1]) <= l * self.distance // SEGMENTS
        if self.total is not None:
            ok &= sum(np.bitwise_count(a ^ b).astype(np.int16) for a, b in zip(fps, other, strict=True)) <= self.total
        return ok

    def forest(self, rep: np.ndarray, fps: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that join what the group's pairs join: each row to the least of those that it hangs together with."""
        left, a, b = np.arange(len(rep)), [], []
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            tree = [queue[0]]
            while queue and len(left):
                at = queue.pop()
                hit = self.linked([f[left] for f in fps], [f[at] for f in fps], start)
                found = left[hit].tolist()
                tree += found
                queue += found
                left = left[~hit]
            own = np.sort(rep[tree])
            a.append(own[1:])
            b.append(np.full(len(own) - 1, own[0]))
        return (np.concatenate(a), np.concatenate(b)) if a else (rep[:0], rep[:0])


LINK_SCHEMA = "a long, b long, key long, start int, fps array<long>"


def _links(distance: int, total: int | None, n_fps: int, group_rows: int | None):
    """Rows ordered by key: (key, start, rep, fp0, ...) -> links (a, b), and the rows of groups over ``group_rows``, for blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, names = Linker(distance, total), ["a", "b", "key", "start", "fps"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        held: list[np.ndarray] = []
        over = None  # the key whose group is being handed on

        def out(a, b):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a, types[0]), pa.array(b, types[1]), *(pa.nulls(n, t) for t in types[2:])], names=names)

        def hand_on(cols):
            n = len(cols[0])
            fps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_fps), pa.array(np.stack(cols[3:], 1).ravel()))
            return pa.RecordBatch.from_arrays([pa.array(cols[2]), pa.nulls(n, types[1]), pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), fps], names=names)

        def groups(cols) -> Iterator[pa.RecordBatch]:
            key, start, rep, fps = cols[0], cols[1], cols[2], [c.view(np.uint64) for c in cols[3:]]
            if len(key) < 2:
                return
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            a, b = [], []
            few = np.repeat(size <= 6, size)
            for d in range(1, 6):
                i = np.flatnonzero((key[:-d] == key[d:]) & few[:-d]) if d < len(key) else []
                if not len(i):
                    break
                hit = i[link.linked([f[i] for f in fps], [f[i + d] for f in fps], start[i])]
                a.append(rep[hit])
                b.append(rep[hit + d])
            for f, n in zip(first[size > 6], size[size > 6], strict=True):
                x, y = link.forest(rep[f : f + n], [z[f : f + n] for z in fps], int(start[f]))
                a.append(x)
                b.append(y)
            if a and sum(map(len, a)):
                yield out(np.concatenate(a), np.concatenate(b))

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)] if held else cols
            if not len(cols[0]):
                continue
            key = cols[0]
            if over is not None:  # rows of a large group that go on
                n = int(np.searchsorted(key != over, True)) if (key == over).all() else int(np.argmax(key != over))
                n = len(key) if (key == over).all() else n
                if n:
                    yield hand_on([c[:n] for c in cols])
                cols, key = [c[n:] for c in cols], key[n:]
                held = []
                if not len(key):
                    continue
                over = None
            last = int(np.argmax(key == key[-1]))
            yield from groups([c[:last] for c in cols])
            held = [c[last:] for c in cols]
            if group_rows and len(held[0]) > group_rows:
                over = held[0][0]
                yield hand_on(held)
                held = []
        if held:
            yield from groups(held)

    return run


def links(prints: DataFrame, distance: int, chain: int, total: int | None = None, group_rows: int = GROUP_ROWS, salt: str | None = None) -> DataFrame:
    """Links (a, b) between the ``rep`` of ``prints(rep, fp0, ...)`` whose fp0 differ in ``distance`` bits or fewer.

    Not every pair of a group is emitted: within a key's group each row is
    linked to the least ``rep`` of those that it hangs together with, so that
    n rows give at most n - 1 links (groups of six or fewer: each pair).  Groups over ``group_rows`` are
    cut into blocks, and each pair of blocks is searched by a task of its own;
    nothing is dropped.  With the column ``salt`` only rows that agree in it
    are compared.
    """
    fps = [c for c in prints.columns if c.startswith("fp")]
    keys = F.array(*[F.struct(F.xxhash64(F.col("fp0").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)), F.lit(v), *([F.col(salt)] if salt else [])).alias("key"), F.lit(s).alias("start")) for v, (s, m) in enumerate(variants(distance, chain))])
    rows = prints.where("rep is not null").select("rep", *fps, F.explode(keys).alias("k")).select("k.key", "k.start", "rep", *fps)
    sort = ["key", *fps]
    found = materialise(rows.repartition("key").sortWithinPartitions(*sort).mapInArrow(_links(distance, total, len(fps), group_rows), LINK_SCHEMA), "found")
    direct = found.where("key is null").select("a", "b")
    large = found.where("key is not null")
    if not large.head(1):
        return direct
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(group_rows)).cast("int").alias("n"))
    dealt = large.join(F.broadcast(blocks) if blocks.count() < 10_000 else blocks, "key").withColumn("i", F.pmod(F.xxhash64("fps", F.lit(7)), F.col("n")).cast("int"))
    pairs = dealt.select("key", "start", "a", "fps", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j")).select(
        F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "start", F.col("a").alias("rep"), *[F.col("fps")[i].alias(c) for i, c in enumerate(fps)]
    )
    more = pairs.repartition("key").sortWithinPartitions(*sort).mapInArrow(_links(distance, total, len(fps), None), LINK_SCHEMA).select("a", "b")
    return direct.unionAll(more)


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, chain: int = 7, seeds: tuple[int, ...] = (42,), total: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (long) and ``component_id``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are passed over.
    Texts without words, empty or null have fingerprint zero and are linked
    like any other.  Repeated rows keep a row each.  A row whose ``doc_id`` is
    null belongs to its fingerprint's component but never names it; a
    component whose rows all lack a ``doc_id`` has ``component_id`` null.  An
    empty table gives an empty result.

    ``seeds``: with more than one, further fingerprints by other seeds, and
    two documents are linked only if all of them together differ in ``total``
    bits or fewer as well.
    """
    fps = [f"fp{i}" for i in range(len(seeds))]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in fps)
    with scratch() as kept:
        prints = materialise(docs.select("doc_id", "text").mapInArrow(_fingerprints(words, seeds), schema), "prints")
        distinct = materialise(prints.groupBy(*fps).agg(F.min("doc_id").alias("rep")), "distinct")
        of = components(links(distinct, distance, chain, total, group_rows))
        kept += [prints, distinct, of]
    label = distinct.join(of, F.col("rep") == F.col("node"), "left").select(*fps, F.coalesce("component", "rep").alias("component_id"))
    return prints.join(label, fps, "left").select("doc_id", F.col("fp0").alias("fp"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
