"""One document of each group of near duplicates stays.

Two documents are near duplicates if their sets of five-word shingles have a
Jaccard similarity of 0.8 or more, or, where a ``distance`` is given as in the
pipeline, if their SimHash fingerprints differ in so many bits or fewer and
that similarity is 0.5 or more: a passage that two texts repeat can bring the
fingerprints of quite different texts together.

``simhash.links`` finds all near fingerprints by pigeonring.  As a block that is
added, cut or replaced often moves more bits, texts of a similarity of 0.8 or
more come from an exact prefix filter besides: with all shingles in one order,
the rarest first, two such sets have a shingle in common among the first
``n - ceil(0.8 n) + 1`` of each.  Shingles that only one text has come first and
meet nobody, so that few texts have candidates at all.  The components of all
candidates bound the exact check, which compares the fingerprints and the
shingle sets themselves.

Shingles that a large share of the texts have are found while the texts are
read and travel with their texts, not to the bucket of their hash; so no task
gathers the texts of a common passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.common import drop, fresh, materialise, row_key, scratch
from tamarack.llm.components import HUBS, components, with_least
from tamarack.llm.simhash import fingerprint, links

SHINGLE, SIMILARITY = 5, 0.8
#: The pipeline's distance of linked fingerprints in bits; segments of the keys that find them; the similarity that their texts must have.
DISTANCE, CHAIN, ALIKE = 4, 7, 0.5
#: Shingles of a bucket, whose documents one task counts, and shingles that a task deals out at once.
BUCKET_SHINGLES, DEALT_SHINGLES = 1 << 20, 1 << 19
#: A shingle is common if at least one text in so many has it; and there are so many common ones at most.
COMMON_SHARE, COMMON = 512, 1 << 18
#: Words that one task compares at once, besides one document.
GROUP_WORDS = 1_500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than ``size`` are one shingle."""
    n = len(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), n + 1)], np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, n)
    out = h[: n - size + 1].copy()
    for j in range(1, size):
        out = _mix(out) + h[j : n - size + 1 + j]
    return np.unique(_mix(out))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


#: Names of texts that share their first name with another text: {(name, check): name of its own}.
Renamed = dict[tuple[int, int], int]


def _node(words: list[bytes], bits: int, renamed: Renamed) -> tuple[int, int]:
    """A text's name and a second hash of it, by which texts of one name are told apart."""
    raw = xxhash.xxh3_128_intdigest(b" ".join(words))
    name, check = (raw & ((1 << 64) - 1)) >> (64 - bits), raw >> 64
    return renamed.get((name, check), name) if renamed else name, check


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


PRINTS = "row_key binary, doc_id long, node long, check long, n_words long, n_shingles long, fp long"


def _prints(shingle: int, bits: int, renamed: Renamed, fingerprints: bool):
    """(row_key, doc_id, text) -> a row each, ``fp`` null but for ``fingerprints``; and, without ``row_key``, shingles that many texts of a chunk have: (node: hash, n_words: texts with it, n_shingles: texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PRINTS.split(", ")]
        held: dict[int, np.ndarray] = {}
        n = 0

        def common():
            h, count = np.unique(np.concatenate(list(held.values())), return_counts=True)
            many = count >= max(4, len(held) / COMMON_SHARE)
            h, count = h[many].view(np.int64), count[many]
            k = len(h)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(h), pa.nulls(k, pa.int64()), pa.array(count), pa.array(np.full(k, len(held))), pa.nulls(k, pa.int64())], names=names)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                nodes, checks, n_words, n_shingles, fps = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    words = _words(text)
                    node, check = _node(words, bits, renamed)
                    own = shingles(words, shingle)
                    nodes.append(_signed(node))
                    checks.append(_signed(check))
                    n_words.append(len(words))
                    n_shingles.append(len(own))
                    fps.append(_signed(fingerprint(text)) if fingerprints else None)
                    if node not in held:
                        held[node] = own
                        n += len(own)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in (nodes, checks, n_words, n_shingles, fps))], names=names)
                if n >= DEALT_SHINGLES:
                    yield common()
                    held, n = {}, 0
        if held:
            yield common()

    return run


def _deal(shingle: int, buckets: int, bits: int, renamed: Renamed, common):
    """text -> (bucket, hashes, nodes): the shingles of many texts by bucket, 8 bytes each, and the text of each; common shingles by their text, in buckets below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        hot = common.value[0]

        def made():
            h = np.concatenate(list(held.values()))
            nodes = np.repeat(np.array(list(held), np.uint64), [len(x) for x in held.values()])
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                bucket[is_hot] = -1 - (nodes[is_hot] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, h, nodes = bucket[order], h[order], nodes[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[first[1:], len(bucket)]
            blobs = [[raw[8 * a : 8 * e] for a, e in zip(first.tolist(), ends.tolist(), strict=True)] for raw in (h.tobytes(), nodes.tobytes())]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], names=["bucket", "hashes", "nodes"])

        n = 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for text in b.column(0).slice(at, 64).to_pylist():
                    words = _words(text)
                    node = _node(words, bits, renamed)[0]
                    if node not in held:
                        held[node] = shingles(words, shingle)
                        n += len(held[node])
                    if n >= DEALT_SHINGLES:
                        yield made()
                        held, n = {}, 0
        if held:
            yield made()

    return run


def _shared(common):
    """Rows ordered by bucket -> (node, hash, texts) of each shingle that two texts or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_texts = common.value
        bucket, held = None, []
        seen = np.zeros(0, np.int64)

        def out(cols):
            for at in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in cols], names=["node", "hash", "texts"])

        def made():
            h, node = (np.frombuffer(b"".join(x), np.int64) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((node, h))
            h, node = h[order], node[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]  # copies of a text count once
            h, node = h[new], node[new]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[first, len(h)])
            texts = np.repeat(size, size)
            some = texts > 1
            yield from out([node[some], h[some], texts[some]])

        for b in batches:
            for k, hashes, nodes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != bucket:
                    if held:
                        yield from made()
                    seen = seen[:0]
                bucket = k
                if k >= 0:
                    held.append((hashes, nodes))
                    continue
                h, node = np.frombuffer(hashes, np.uint64), np.frombuffer(nodes, np.int64)
                new = ~np.isin(node, seen)  # a text's common shingles come together, from each chunk that has the text
                seen = np.union1d(seen, node)
                yield from out([node[new], h[new].view(np.int64), hot_texts[np.searchsorted(hot, h[new])]])
        if held:
            yield from made()

    return run


def candidates(docs: DataFrame, texts: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, least: float, bucket_shingles: int = BUCKET_SHINGLES, bits: int = 64, renamed: Renamed | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect each two of ``texts(node, n_shingles)`` whose similarity is ``least`` or more, and some others.

    ``common``: the hashes of common shingles in ascending order, and how many texts about have each.
    """
    total = texts.agg(F.sum("n_shingles")).first()[0] or 0
    shared_common = docs.sparkSession.sparkContext.broadcast(common)
    dealt = docs.select("text").mapInArrow(_deal(shingle, max(64, -(-total // bucket_shingles)), bits, renamed or {}, shared_common), "bucket int, hashes binary, nodes binary")
    shared = materialise(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(shared_common), "node long, hash long, texts long"), "shared")
    own = Window.partitionBy("node")
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("texts", "hash"))).withColumn("n_shared", F.count("*").over(own))
    n = F.col("n_shingles")
    prefix = n - F.ceil(n * F.lit(least) - F.lit(1e-9)) + 1
    # The shingles that no other text has come first.
    meet = materialise(ranked.join(texts.select("node", "n_shingles"), "node").where(F.col("rank") + n - F.col("n_shared") <= prefix).select(F.col("hash").alias("a"), F.col("node").alias("b")), "prefixes")
    drop(shared)
    met = with_least(meet, meet, max(32, meet.count() // HUBS))
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def print_candidates(texts: DataFrame, distance: int, chain: int = CHAIN) -> DataFrame:
    """Links ``(a, b)`` that connect each two of ``texts(node, fp)`` whose fingerprints differ in ``distance`` bits or fewer, and no others."""
    own = texts.select(F.col("fp").alias("a"), F.col("node").alias("b"))
    same = with_least(own, own, max(32, texts.count() // HUBS)).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    distinct = own.groupBy("a").agg(F.min("b").alias("rep")).select("rep", F.col("a").alias("fp0"))
    return links(distinct, distance, chain).unionAll(same)


def exact_links(nodes: list[int], sets: list[np.ndarray], least: float, fps: np.ndarray | None = None, distance: int | None = None, alike: float = ALIKE) -> list[tuple[int, int]]:
    """Links that join what all pairs of similarity ``least`` or more join: each found set to the one it was found from.

    With a ``distance`` a similarity of ``alike`` is enough for sets whose ``fps`` differ in so many bits or fewer.
    """
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    mark = np.zeros(int(flat.max()) + 1, bool)
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            limit = np.full(len(left), least) if distance is None else np.where(np.bitwise_count(fps[left] ^ fps[at]) <= distance, min(alike, least), least)
            some = (size[left] >= limit * size[at]) & (size[at] >= limit * size[left])
            fits, limit = left[some], limit[some]
            if not len(fits):
                continue
            own = flat[begin[at] : begin[at] + size[at]]
            mark[own] = True
            n = size[fits]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[fits], n)
            both = np.add.reduceat(mark[flat[within]].astype(np.int64), np.cumsum(n) - n)
            mark[own] = False
            found = fits[both >= limit * (n + size[at] - both) - 1e-9]
            out += [(nodes[x], nodes[at]) for x in found.tolist()]
            queue += found.tolist()
            left = left[~np.isin(left, found, assume_unique=True)]
    return out


def _verify(shingle: int, least: float, distance: int | None, alike: float):
    """Rows ordered by key: (key, node, fp, text) -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, fps, sets = None, [], [], []

        def made():
            prints = None if distance is None else np.array(fps, np.int64).view(np.uint64)
            found = exact_links(nodes, sets, least, prints, distance, alike) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for b in batches:
            for at in range(0, b.num_rows, 64):
                for k, node, fp, text in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    if k != key:
                        yield made()
                        key, nodes, fps, sets = k, [], [], []
                    nodes.append(node)
                    fps.append(fp)
                    sets.append(shingles(_words(text), shingle))
        yield made()

    return run


def _common(prints: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles: every one that over two texts in ``COMMON_SHARE`` have (but for four texts a chunk), ``COMMON`` at most."""
    counted = prints.where("row_key is null")
    whole = prints.where("row_key is not null").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("shingles")).first()
    least = max(8, whole.rows / COMMON_SHARE, (whole.shingles or 0) / COMMON)
    rows = counted.groupBy("node").agg(F.sum("n_words").alias("texts")).where(F.col("texts") >= least).collect()  # so many at most: least times their number is no more than all shingles
    h, texts = np.array([r.node for r in rows], np.int64).view(np.uint64), np.array([r.texts for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], texts[order]


def _named(keyed: DataFrame, shingle: int, bits: int, fingerprints: bool = False) -> tuple[DataFrame, Renamed]:
    """The texts' prints under names of which no two texts share one.

    Two texts of one 64-bit name are rare: of n texts, n * n / 2 ** 65 pairs.
    Those get names of their own by their second hash, told to every task.
    """
    renamed: Renamed = {}
    for _ in range(8):
        prints = materialise(keyed.mapInArrow(_prints(shingle, bits, renamed, fingerprints), PRINTS), "prints")
        named = prints.where("row_key is not null")
        twice = named.groupBy("node").agg(F.min("check").alias("one"), F.max("check").alias("two")).where("one <> two").select("node")
        clash = named.join(twice, "node").select("node", "check").distinct().collect()
        if not clash:
            return prints, renamed
        drop(prints)
        back = {(own, check): name for (name, check), own in renamed.items()}
        for node, check in ((r.node % (1 << 64), r.check % (1 << 64)) for r in clash):
            first = back.get((node, check), node)
            renamed[first, check] = xxhash.xxh3_64_intdigest(f"{first} {check}".encode(), len(renamed) + 1)
    raise RuntimeError("texts could not be told apart by name")


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, group_words: int = GROUP_WORDS, bucket_shingles: int = BUCKET_SHINGLES, bits: int = 64, distance: int | None = None, chain: int = CHAIN, alike: float = ALIKE) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)``: ``rows(row_key, doc_id, node, ...)`` says which text each row has, ``groups(node, best, label)`` each text's group.

    ``row_key`` is a digest of ``doc_id`` and ``text`` (128 bits); ``best`` is
    the text's row with the smallest ``doc_id``, null last.  ``bits``: those
    of a text's first name.  With ``distance`` texts are also near duplicates
    if their fingerprints differ in so many bits or fewer and their similarity
    is ``alike`` or more; ``chain``: segments of the keys that find these.
    """
    keyed = docs.select(row_key().alias("row_key"), "doc_id", "text")
    prints, renamed = _named(keyed, shingle, bits, distance is not None)
    rows = prints.where("row_key is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"))).alias("best")
    texts = materialise(rows.groupBy("node").agg(best, F.first("n_words").alias("n_words"), F.first("n_shingles").alias("n_shingles"), F.first("fp").alias("fp")), "texts")
    met = candidates(docs, texts, _common(prints), shingle, least, bucket_shingles, bits, renamed)
    coarse = components(met if distance is None else met.unionAll(print_candidates(texts, distance, chain)))
    member = materialise(texts.join(coarse, "node").select("component", "node", "fp", "n_words", F.col("best.row_key").alias("row_key")), "members")
    blocks = F.ceil(F.sum(F.col("n_words") + 1) / F.lit(group_words)).cast("int").alias("n")
    large = materialise(member.groupBy("component").agg(blocks).where("n > 1"), "large")
    member = member.join(large, "component", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = keyed.select("row_key", "text").join(member, "row_key").select("component", "node", "fp", "text", "n", "i")
    # A pair of blocks is compared by a task of its own.
    pairs = dealt.select("component", "node", "fp", "text", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    pairs = pairs.select(F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "node", "fp", "text")
    sure = components(pairs.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_verify(shingle, least, distance, alike), "a long, b long"))
    groups = texts.join(sure, "node", "left").select("node", "best", F.coalesce("component", "node").alias("label"))
    return rows, groups


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest ``doc_id``.

    Needs ``doc_id`` and ``text``; other columns stay.  Words part at ASCII
    white space, A-Z count as a-z.  Null and empty texts have one (empty) text
    in common.  A null ``doc_id`` comes after all others; of repeated rows
    (``doc_id`` and ``text``) one stays.  An empty table gives an empty result.
    """
    with scratch() as left:
        _, groups = near_duplicate_groups(docs, **parameters)
        kept = materialise(groups.groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.row_key").alias("_kept")), "kept")
        left.append(kept)
    key = fresh(docs, "_row_key")
    out = docs.withColumn(key, row_key())
    return out.join(kept, out[key] == kept["_kept"], "left_semi").dropDuplicates([key]).drop(key)
