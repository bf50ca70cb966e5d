"""Substring deduplication by recompression.

Each document is read as a sequence of word names (64-bit content hashes, so
that a name is the same wherever it is made).  A round of recompression names
each maximal run of one symbol and then each pair of neighbours whose left
symbol lies in the left and whose right symbol in the right half of a hashed
partition of the alphabet; both names are hashes of what they replace, and so
global without an exchange.  With each symbol goes the range of words that its
forming depends on: within every occurrence of that range the same symbol
appears.

Every window of ``window`` words is given to the highest symbol whose range
lies inside the window (ties by name), or, where there is none, to itself.
Equal windows are thus given to equal symbols, and the symbol's name says in
which bucket they meet.  Neighbouring windows share most of their symbols,
which keeps what is sent small: a symbol stands for some five windows.  In the
bucket the windows' own names verify the repeat: 56 bits of a hash, and with
the 256 or more buckets, which follow from the window's words too, 64.

Repeats within a chunk of documents are settled before the shuffle, and only
windows in their smallest document there travel on: a passage that a third of
all documents share costs a row a chunk at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import MAX_LONG, row_key, table

WINDOW = 13
#: Words of a chunk: what one task holds at once, besides one document.
CHUNK_WORDS = 300_000
#: Bytes of text for each bucket.
BUCKET_BYTES = 2 << 20
ROUNDS = 2
FAR = 1 << 30
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: What parts the alphabet anew in each round.
SIDES = np.random.default_rng(13).integers(0, 1 << 63, ROUNDS, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def recompress(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, k: int):
    """One round: names runs, then pairs.  lo, hi: the words that a symbol depends on.  Also tells which symbols are new pairs."""
    n = len(s)
    new = np.ones(n, bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    d = doc[first]
    m = len(first)
    with_next = np.zeros(m, bool)
    with_next[:-1] = d[1:] == d[:-1]
    with_last = np.zeros(m, bool)
    with_last[1:] = with_next[:-1]
    # A run's end shows only where the next symbol is known to differ.
    a = np.minimum(np.minimum.reduceat(lo, first), np.where(with_last, lo[first - 1], -FAR))
    b = np.maximum(np.maximum.reduceat(hi, first), np.where(with_next, hi[np.minimum(first + size, n - 1)], FAR))
    name = s[first]
    name = np.where(size > 1, mix(name + size.astype(np.uint64) * K3), name)
    right = mix(name ^ SIDES[k]) >> np.uint64(63) == 1
    pair = np.zeros(m, bool)
    pair[:-1] = ~right[:-1] & right[1:] & with_next[:-1]
    second = np.zeros(m, bool)
    second[1:] = pair[:-1]
    # A symbol that stays alone depends on the neighbour that it could have been paired with.
    a2 = np.where(right & ~second, np.minimum(a, np.where(with_last, np.roll(a, 1), -FAR)), a)
    b2 = np.where(~right & ~pair, np.maximum(b, np.where(with_next, np.roll(b, -1), FAR)), b)
    i = np.flatnonzero(pair)
    b2[i] = b[i + 1]
    name[i] = mix(name[i] * K1 + mix(name[i + 1] + K2))
    keep = ~second
    return name[keep], a2[keep], b2[keep], d[keep], pair[keep]


def window_names(s: np.ndarray, window: int) -> np.ndarray:
    n = len(s) - window + 1
    h = s[:n].copy()
    for j in range(1, window):
        h = h * K2 + s[j : j + n]
    return mix(h)


def window_symbols(s: np.ndarray, doc: np.ndarray, names: np.ndarray, window: int) -> np.ndarray:
    """For each window the name of the symbol it is given to."""
    n = len(s)
    at = np.arange(n, dtype=np.int64)
    by_span: list[list] = [[] for _ in range(window + 1)]
    now = (s, at, at + 1, doc)
    for k in range(ROUNDS):
        *now, pair = recompress(*now, k)
        lo, hi = now[1][pair], now[2][pair]
        rank = (now[0][pair] >> np.uint64(2)) | (np.uint64(k + 1) << np.uint64(62))
        span = hi - lo
        for w in range(window + 1):
            i = np.flatnonzero(span == w)
            if len(i):
                by_span[w].append((lo[i], rank[i]))
    best = np.zeros(n + 1, np.uint64)  # best[p]: the highest symbol within [p, p + w)
    for w in range(1, window + 1):
        best[:-1] = np.maximum(best[:-1], best[1:])
        for lo, rank in by_span[w]:
            best[lo] = np.maximum(best[lo], rank)
    best = best[: len(names)]
    return np.where(best == 0, names >> np.uint64(2), best)


def _chunks(batches: Iterator[pa.RecordBatch], words: int):
    """Lists of (key, doc_id, words of the text), some ``words`` words each."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            for key, doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                split = (text or "").encode().split()
                held.append((key, MAX_LONG if doc_id is None else doc_id, split))
                n += len(split)
                if n >= words:
                    yield held
                    held, n = [], 0
    if held:
        yield held


SENT = "bucket int, chunk long, names binary, first binary, size binary, doc binary, ids binary"


def _send(window: int, buckets: int, chunk_words: int):
    """Rows by bucket: the names of windows by runs (first window in the chunk, number, document), with the ids of the documents; and a row with bucket -1 and the chunk's documents and repeats found here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for seq, docs in enumerate(_chunks(batches, chunk_words)):
            docs = [d for d in docs if len(d[2]) >= window]
            if not docs:
                continue
            chunk = (task << 32) | seq
            n = np.array([len(d[2]) for d in docs])
            keys, ids = b"".join(d[0] for d in docs), np.array([d[1] for d in docs], np.int64)
            digest = xxhash.xxh64_intdigest
            s = np.fromiter((digest(w) for d in docs for w in d[2]), np.uint64, int(n.sum()))
            doc = np.repeat(np.arange(len(docs), dtype=np.int64), n)
            del docs
            names = window_names(s, window)
            symbol = window_symbols(s, doc, names, window)
            del s
            p = np.flatnonzero(doc[: len(names)] == doc[window - 1 :])
            order = np.argsort(names[p])
            q = p[order]
            first = np.flatnonzero(np.append(True, names[q][1:] != names[q][:-1]))
            least = np.minimum.reduceat(ids[doc[q]], first)
            repeat = ids[doc[q]] > np.repeat(least, np.diff(np.append(first, len(q))))
            here = np.sort(q[repeat]).astype(np.uint32)
            q = np.sort(q[~repeat])
            cut = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1] + 1) | (symbol[q[1:]] != symbol[q[:-1]]) | (doc[q[1:]] != doc[q[:-1]])])) if len(q) else q
            size = np.diff(np.append(cut, len(q)))
            to = (mix(symbol[q[cut]] + K3) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            cut, size, to = cut[order], size[order], to[order]
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            sent = names[q[np.repeat(cut, size) + within]]
            ends, runs = np.cumsum(size), np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
            rows = [(-1, chunk, here.tobytes(), np.cumsum(n).astype(np.uint32).tobytes(), None, keys, ids.tobytes())]
            for f, e in zip(runs, [*runs[1:], len(to)], strict=True):
                held, which = np.unique(doc[q[cut[f:e]]], return_inverse=True)
                begin = ends[f - 1] if f else 0
                rows.append((int(to[f]), chunk, pack(sent[begin : ends[e - 1]]), q[cut[f:e]].astype(np.uint32).tobytes(), size[f:e].astype(np.uint32).tobytes(), which.astype(np.uint32).tobytes(), ids[held].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 5], strict=True)], names=[x.split()[0] for x in SENT.split(", ")])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """The rows of each value of an ordered column."""
    held: list[tuple] = []
    for b in batches:
        for at in range(0, b.num_rows, 16):
            for row in zip(*(c.to_pylist() for c in b.slice(at, 16).columns), strict=True):
                if held and held[0][by] != row[by]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def pack(names: np.ndarray) -> bytes:
    """The upper 56 bits of each name; the bucket says as much as the lower 8."""
    return names.view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 1:] = raw
    return out.view(np.uint64).ravel()


FOUND = "chunk long, names binary, first binary, doc binary"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the windows that also start in a smaller document.  Rows with bucket -1 pass through."""

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 3], strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    def through(batches):
        for b in batches:
            bucket = b.column(0).to_numpy()
            table_rows = np.flatnonzero(bucket < 0)
            if len(table_rows):
                part = b.take(pa.array(table_rows))
                passed.append(pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), part.column(5)], names=[x.split()[0] for x in FOUND.split(", ")]))
            if len(table_rows) < b.num_rows:
                yield b.take(pa.array(np.flatnonzero(bucket >= 0))) if len(table_rows) else b

    passed: list[pa.RecordBatch] = []
    for rows in _grouped(through(batches), 0):
        yield from passed
        passed.clear()
        names = np.concatenate([unpack(r[2]) for r in rows])
        at, ids, n = [], [], []
        for r in rows:
            first, size, doc = (np.frombuffer(r[k], np.uint32).astype(np.int64) for k in (3, 4, 5))
            total = int(size.sum())
            at.append(np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total))
            ids.append(np.repeat(np.frombuffer(r[6], np.int64)[doc], size))
            n.append(total)
        ids, at = np.concatenate(ids), np.concatenate(at)
        order = np.argsort(names)
        names = names[order]
        first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        of = ids[order]
        repeat = np.sort(order[of > np.repeat(np.minimum.reduceat(of, first), np.diff(np.append(first, len(of))))])
        if len(repeat):
            ends = np.searchsorted(repeat, np.cumsum(n))
            sent = [(r[1], at[repeat[a:b]].astype(np.uint32).tobytes(), None, None) for r, a, b in zip(rows, [0, *ends[:-1]], ends, strict=True) if b > a]
            yield out(sent)
    yield from passed


def _cover(window: int):
    """Chunk by chunk: each document's removed words, as the starts and ends of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 0):
            own = next(r for r in rows if r[2] is not None)
            ends, keys = np.frombuffer(own[2], np.uint32).astype(np.int64), own[3]
            edge = np.zeros(int(ends[-1]) + 1, np.int64)
            for r in rows:
                p = np.frombuffer(r[1], np.uint32).astype(np.int64)  # a window is sent at most once
                np.add.at(edge, p, 1)
                np.add.at(edge, p + window, -1)
            gone = np.cumsum(edge) > 0
            gone[-1] = False
            turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)))
            starts, stops = turn[::2], turn[1::2]
            out = []
            begin = ends - np.diff(ends, prepend=0)
            if len(starts):
                # A range may go over the end of a document into the next; cut it there.
                inner = ends[:-1][gone[ends[:-1]] & gone[ends[:-1] - 1]]
                starts, stops = np.sort(np.append(starts, inner)), np.sort(np.append(stops, inner))
                which = np.searchsorted(ends, starts, side="right")
                cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
                for f, e in zip(cut, [*cut[1:], len(which)], strict=True):
                    d = which[f]
                    out.append((keys[16 * d : 16 * d + 16], np.stack([starts[f:e], stops[f:e]], 1).ravel().astype(np.int64) - begin[d]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([r.astype(np.uint32).tobytes() for _, r in out], pa.binary())], names=["key", "gone"])

    return run


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _keep(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                n, removed, sha, kept_text = [], [], [], []
                for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    kept, last = words, 0
                    if gone:
                        kept = []
                        for s, e in np.frombuffer(gone, np.uint32).reshape(-1, 2).tolist():
                            kept += words[last:s]
                            last = e
                        kept += words[last:]
                    joined = b" ".join(kept)
                    n.append(len(words))
                    removed.append(len(words) - len(kept))
                    sha.append(hashlib.sha256(joined).hexdigest())
                    if with_text:
                        kept_text.append(text if not gone else joined.decode())
                cols = [part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept_text, pa.string())] if with_text else []), names=[x.split()[0] for x in REMOVED.split(", ")] + ["kept_text"] * with_text)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, chunk_words: int = CHUNK_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_words, n_removed, kept_sha256``, and ``kept_text`` on demand (the text as it is where nothing goes).

    A word goes if a window of ``window`` words that covers it also starts in
    a document with a smaller ``doc_id``.  Rows with one ``doc_id`` are one
    document's: they don't remove each other's words.  A null ``doc_id``
    counts as larger than any other and is returned as null; a null or empty
    text has no words and an empty kept text's digest.  Other columns are
    passed over; an empty table gives an empty result.
    """
    keyed = docs.select(row_key().alias("key"), "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(256, size // bucket_bytes))
    sent = keyed.mapInArrow(_send(window, buckets, chunk_words), SENT)
    dealt = sent.repartition(F.when(F.col("bucket") < 0, F.col("chunk")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_meet, FOUND).repartition("chunk").sortWithinPartitions("chunk")
    gone = found.mapInArrow(_cover(window), "key binary, gone binary").dropDuplicates(["key"])
    return keyed.join(gone, "key", "left").select("doc_id", "text", "gone").mapInArrow(_keep(with_text), REMOVED + ", kept_text string" * with_text)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH g AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM g, unnest(range(1, len(w) - 11)) t(i)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN first USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM g),
kept AS (SELECT doc_id, count(gone.j) AS n_removed, string_agg(x, ' ' ORDER BY j) FILTER (WHERE gone.j IS NULL) AS t FROM word LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT g.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM g LEFT JOIN kept USING (doc_id)
"""
