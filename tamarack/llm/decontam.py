"""Benchmark decontamination by SimHash over item-sized windows.

A text is read as lower-cased words (runs of letters, digits and underscores).
A window has as many words as an item, and its SimHash is that of its five-word
shingles, repeats included.  Item fingerprints of one length are cut into four
blocks of 16 bits.  A window within ``radius`` bits of an item is, in some
block, within that block's share of them (shares that add up to the radius
less three, so that staying beyond all of them takes more than the radius);
each block has a table from its values to the items within its share, and the
union of the looked-up sets holds every item within the radius.  Those within
it are verified by the exact similarity of the weighted shingle sets (sum of
smaller over sum of larger counts).

A window can only be similar to an item if nearly all of its shingles occur in
items at all: 2 s / (1 + s) of them for a similarity of s and equal lengths.
Other windows aren't fingerprinted.  No row is moved: items travel to the
documents, in blocks of a bounded number and size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import table

WORD = regex.compile(r"\w+")
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
#: Bytes of item texts, and items, that are sent to the executors at once.
BLOCK_BYTES, BLOCK_ITEMS = 16 << 20, 1 << 12
BLOCKS = 4
#: Windows fingerprinted at once.
REGION = 1 << 13


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive word hashes."""
    n = len(ids) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(size):
        h = (h ^ ids[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def simhash(hashes: np.ndarray) -> int:
    return int.from_bytes(np.packbits(_bits(hashes).sum(0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def shares(radius: int) -> list[int]:
    """How many bits may differ in each block: a pair that differs in more in every block differs in over ``radius`` bits."""
    spread = max(0, radius - BLOCKS + 1)
    return [(spread + k) // BLOCKS for k in range(BLOCKS)]


class Index:
    """The fingerprints of items of one length, and for each block a table from its values to a bit for each item."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, radius: int):
        self.items, self.prints, self.radius = items, prints, radius
        values, self.tables = np.arange(1 << 16, dtype=np.uint16)[:, None], []
        for block, share in enumerate(shares(radius)):
            own = self._part(prints, block).astype(np.uint16)
            table = np.empty((1 << 16, -(-len(prints) // 8)), np.uint8)
            for at in range(0, len(own), 64):  # bounded memory
                table[:, at // 8 : at // 8 + 8] = np.packbits(np.bitwise_count(values ^ own[at : at + 64]) <= share, axis=1)
            self.tables.append(table)

    @staticmethod
    def _part(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        near = self.tables[0][self._part(prints, 0)]
        for block in range(1, BLOCKS):
            near |= self.tables[block][self._part(prints, block)]
        w, i = np.nonzero(np.unpackbits(near, axis=1, count=len(self.prints)))
        ok = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
        return w[ok], self.items[i[ok]]


class Items:
    """A block of benchmark items with the multi-index of each length's fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS):
        self.shingle, self.least, self.radius = shingle, least, radius
        read = [(i, w) for i, w in ((i, words_of(t)) for i, t in rows) if w]
        self.ids = [i for i, _ in read]
        self.n_words = np.array([len(w) for _, w in read], np.int64)
        self.vocabulary = {w: xxhash.xxh64_intdigest(w.encode(), 7) for _, ws in read for w in ws}
        self.hashes = [shingle_hashes(self.word_hashes(w), min(shingle, len(w))) for _, w in read]
        self.counts = [Counter(h.tolist()) for h in self.hashes]
        self.prints = np.array([simhash(h) for h in self.hashes], np.uint64)
        # For each shingle length the shingles of its items in order, and the items' lengths.
        self.known: dict[int, tuple[np.ndarray, list[int]]] = {}
        for k in {min(shingle, int(n)) for n in self.n_words}:
            mine = [x for x, n in enumerate(self.n_words.tolist()) if min(shingle, n) == k]
            self.known[k] = np.unique(np.concatenate([self.hashes[x] for x in mine])), sorted({int(self.n_words[x]) for x in mine})
        self.indexes: dict[int, Index] = {}

    def __getstate__(self):
        return {**self.__dict__, "indexes": {}}  # each worker makes those that it needs

    def index(self, n: int) -> Index:
        if n not in self.indexes:
            items = np.flatnonzero(self.n_words == n)
            self.indexes[n] = Index(items, self.prints[items], self.radius)
        return self.indexes[n]

    def word_hashes(self, words: list[str]) -> np.ndarray:
        """0 for a word of no item."""
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.uint64, len(words))

    def search(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item_id, similarity, first word, words, differing bits) of the best window for each item that the text holds."""
        words = words_of(text)
        ids = self.word_hashes(words)
        best: dict[int, tuple[float, int, int, int]] = {}
        hashes: dict[int, np.ndarray] = {}
        for k, (known, lengths) in self.known.items():
            # A text shorter than the shingle is one shingle of its own.
            size = min(k, len(ids))
            if not size:
                continue
            inside = np.convolve(ids != 0, np.ones(size, np.int64), "valid") == size
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            found = shingle_hashes(ids, size)[at]
            row = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = np.zeros(len(inside) + 1, np.int64)
            hit[at + 1] = known[row] == found
            if not hit.any():
                continue
            upto = np.cumsum(hit)  # known shingles before each place
            for n in lengths:
                m = max(1, min(n, len(words)) - size + 1)  # shingles of a window
                # Shared s of m and of the item's t shingles: similarity s / (m + t - s) at most.
                need = self.least / (1 + self.least) * (m + n - k + 1)
                starts = np.flatnonzero(upto[m:] - upto[:-m] >= need - 1e-9)
                if len(starts):
                    if size not in hashes:
                        hashes[size] = shingle_hashes(np.fromiter((xxhash.xxh64_intdigest(w.encode(), 7) for w in words), np.uint64, len(words)), size)
                    self._windows(hashes[size], starts, m, n, min(n, len(words)), best)
        return [(self.ids[x], *best[x]) for x in sorted(best)]

    def _windows(self, hashes: np.ndarray, starts: np.ndarray, m: int, n: int, n_words: int, best: dict) -> None:
        """Fingerprints the windows of ``m`` shingles at ``starts`` and verifies the items of ``n`` words that the index finds."""
        index = self.index(n)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for begin in range(0, len(part), REGION):
                s = part[begin : begin + REGION]
                ones = np.zeros((len(s) + m, 64), np.int32)
                np.cumsum(_bits(hashes[s[0] : s[-1] + m]), axis=0, out=ones[1:], dtype=np.int32)
                prints = np.packbits((ones[m:] - ones[:-m]) * 2 > m, axis=1).view(">u8").ravel().astype(np.uint64)
                held, p = Counter(), -1
                for w, x in zip(*index.candidates(prints), strict=True):
                    if s[w] != p:
                        p = int(s[w])
                        held = Counter(hashes[p : p + m].tolist())
                    sim = similarity(held, self.counts[x])
                    if sim >= self.least and (x not in best or sim > best[x][0]):
                        best[x] = (sim, p, n_words, int(np.bitwise_count(prints[w] ^ self.prints[x])))


FOUND = "doc_id long, item_id long, similarity double, first_word long, n_words long, differing int"


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(d, *hit) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for hit in items.search(t)]
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of some ``block_bytes`` and ``BLOCK_ITEMS`` each; the whole table never lies in memory at once."""
    whole = benchmark.agg(F.sum(F.octet_length("text")).alias("size"), F.count("text").alias("rows")).first()
    n = max(-(-int(whole.size or 0) // block_bytes), -(-whole.rows // BLOCK_ITEMS))
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").collect()
        yield sorted(((r.item_id, r.text) for r in rows if r.text), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)`` and item of ``benchmark(item_id, text)`` that it holds.

    ``similarity`` is that of the best window (``least`` or more), which begins
    at word ``first_word`` and has ``n_words``; of equal ones the first is
    given.  A document shorter than an item is one window; an item of fewer
    words than a shingle is one shingle and must occur as it is.  Null texts,
    and texts and items without words, match nothing; repeated rows and items
    are reported each.  Other columns are passed over; either table may be
    empty.
    """
    sc = docs.sparkSession.sparkContext
    rows, out = docs.select("doc_id", "text"), None
    for block in _item_blocks(benchmark, block_bytes):
        found = rows.mapInArrow(_search(sc.broadcast(Items(block, shingle, least, radius))), FOUND)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


def _clean(shared, names: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keep = [i for i, t in enumerate(part.column(text_at).to_pylist()) if not items.search(t)]
                yield pa.RecordBatch.from_arrays(part.take(pa.array(keep, pa.int64())).columns, names=names)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item.

    Needs ``text``; columns of any name stay.  Null and empty texts hold none
    and stay, repeated rows stay or go together; either table may be empty.
    """
    sc = docs.sparkSession.sparkContext
    for block in _item_blocks(benchmark, BLOCK_BYTES):
        docs = docs.mapInArrow(_clean(sc.broadcast(Items(block)), docs.columns, docs.columns.index("text")), docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
