"""Language ID by prediction by partial matching (PPM).

For each language a tree of contexts of up to ``ORDER`` bytes is counted over a
bounded sample of labelled texts.  A byte's code length after its context is
that of method C: the longest known context gives n / (total + distinct), or
else its escape, distinct / (total + distinct), and the next shorter context is
asked; below them all 256 bytes are equally likely.  The statistics are frozen
after training, and each whole text's exact code length under every language
is summed; the language with the shortest is predicted.

Bytes are those of the lower-cased text in UTF-8.  Trees are kept as hashed
tables of the strings that any language has, with a row of code lengths by
language: so many rows at most as the sample has bytes, for each order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamarack.llm.common import fresh, table
from tamarack.llm.ranking import first_share, seeded_hash

ORDER = 4
#: The sample: so many documents and bytes of text for each language at most.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 1_000_000
#: A text is in no learned language if the best one needs over so many bits a byte (as many as no model at all), and over so many bits more in all, as short texts prove little.
REJECT_BITS, SLACK_BITS = 8.0, 32.0
LETTER = regex.compile(r"\p{L}")
#: Bytes summed at once.
BLOCK = 1 << 16
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Strings:
    """Which row each of some byte strings, read as numbers, has; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at, rows, self.probes = self._home(keys), np.arange(len(keys), dtype=np.int32), 0
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]  # of rows that want one slot the last gets it
            left = self.slots[at] != rows
            at, rows, self.probes = (at[left] + 1) & (len(self.slots) - 1), rows[left], self.probes + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        row = self.slots[at]
        if not len(self.keys):
            return row
        wrong = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        for _ in range(self.probes - 1):
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            row[wrong] = self.slots[at[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self.keys[row[wrong]] != keys[wrong])]
        row[wrong] = -1
        return row


def _bytes(text: str) -> np.ndarray:
    """The bytes of a text, after ``ORDER`` zeros."""
    return np.concatenate([np.zeros(ORDER, np.uint64), np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint64)])


def _strings(x: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` before it, as a number whose lowest byte is its own."""
    n = len(x) - ORDER
    out = x[ORDER:].copy()
    for o in range(1, order + 1):
        out |= x[ORDER - o : ORDER - o + n] << np.uint64(8 * o)
    return out


@dataclass
class Model:
    """Frozen code lengths in bits by order; one column for each language, in the order of ``languages``."""

    languages: list[str]
    strings: list[Strings]  # contexts with the byte after them
    lengths: list[np.ndarray]  # their code lengths
    contexts: list[Strings]
    escapes: list[np.ndarray]

    def code_lengths(self, text: str) -> tuple[np.ndarray, int]:
        """Bits under each language, and the number of bytes."""
        x = _bytes(text)
        total = np.zeros(len(self.languages))
        for at in range(0, len(x) - ORDER, BLOCK):
            s = _strings(x[at : at + BLOCK + ORDER], ORDER)
            for order in range(ORDER, -1, -1):
                row = self.strings[order].rows(s & np.uint64((1 << (8 * order + 8)) - 1))
                known = row >= 0
                total += self.lengths[order][row[known]].sum(0, dtype=np.float64)
                s = s[~known]
                if not len(s):
                    break
                row = self.contexts[order].rows((s & np.uint64((1 << (8 * order + 8)) - 1)) >> np.uint64(8))
                total += self.escapes[order][row[row >= 0]].sum(0, dtype=np.float64)
            else:
                total += 8.0 * len(s)
        return total, len(x) - ORDER


def train(samples: dict[str, list[str]]) -> Model:
    languages = sorted(samples)
    raw = [[_bytes(t) for t in samples[k]] for k in languages]
    out = Model(languages, [], [], [], [])
    for order in range(ORDER + 1):
        counted = [np.unique(np.concatenate([_strings(x, order) for x in texts] or [np.zeros(0, np.uint64)]), return_counts=True) for texts in raw]
        every = np.unique(np.concatenate([g for g, _ in counted] or [np.zeros(0, np.uint64)]))
        contexts = np.unique(every >> np.uint64(8))
        lengths, escapes = np.empty((len(every), len(languages)), np.float32), np.zeros((len(contexts), len(languages)), np.float32)
        of = np.searchsorted(contexts, every >> np.uint64(8))
        shorter = out.strings[-1].rows(every & np.uint64((1 << (8 * order)) - 1)) if order else None
        for k, (grams, counts) in enumerate(counted):
            here = np.searchsorted(contexts, grams >> np.uint64(8))
            total, kinds = np.bincount(here, counts, len(contexts)), np.bincount(here, minlength=len(contexts))
            escapes[:, k] = np.where(total > 0, -np.log2(np.where(total > 0, kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
            lengths[:, k] = escapes[of, k] + (out.lengths[-1][shorter, k] if order else 8.0)
            lengths[np.searchsorted(every, grams), k] = -np.log2(counts / (total + kinds)[here])
        out.strings.append(Strings(every))
        out.lengths.append(lengths)
        out.contexts.append(Strings(contexts))
        out.escapes.append(escapes)
    return out


def held_out() -> "F.Column":
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, seed: int = 5) -> Model:
    """Trains on labelled rows outside the held-out fifth: for each language the first ``sample_docs`` in a seeded order, as far as they have ``sample_bytes`` together, the first in any case.

    Texts of over a quarter of ``sample_bytes`` come after all others, so that
    a long one doesn't end the sample.
    """
    fit = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out()).select("doc_id", "lang", F.octet_length("text").alias("n"), seeded_hash(seed, "doc_id").alias("h"))
    fit = fit.withColumn("long", F.col("n") > sample_bytes // 4)
    counts = {r.lang: (r.rows, r.short) for r in fit.groupBy("lang").agg(F.count("*").alias("rows"), F.count(F.when(~F.col("long"), 1)).alias("short")).collect()}  # a row a language
    early = F.coalesce(*[F.when(F.col("lang") == k, first_share(F.col("h"), sample_docs, short) & ~F.col("long") if short else first_share(F.col("h"), sample_docs, rows)) for k, (rows, short) in counts.items()], F.lit(True))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "n")
    ranked = fit.where(early).withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_docs)
    chosen = ranked.withColumn("b", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("b") <= sample_bytes) | (F.col("r") == 1)).select("doc_id", "lang").distinct()
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").where("text is not null").collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return train(samples)


def _predict(model, n_cols: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lang, score, bits = [], [], []
                for text in part.column(n_cols).to_pylist():
                    if text is None or not m.languages or not LETTER.search(text):
                        lang.append("und")
                        score.append(0.0)
                        bits.append(None)
                        continue
                    total, n = m.code_lengths(text)
                    best = int(np.argmin(total))  # of equal ones the first in code-point order
                    lang.append(m.languages[best])
                    score.append(float(1 / np.exp2(total[best] - total).sum()))
                    bits.append(float(total[best] / n))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_cols], pa.array(lang), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=names)

    return run


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits`` (code length for each byte), or ``names`` for them.

    Only ``text`` is read.  ``und``, score 0 and null bits where the text is
    null or has no letter, or nothing was learned.  Columns with the three
    names are replaced, others stay; repeated rows keep a row each.
    """
    text = F.col("text").alias(fresh(docs, "_text"))
    docs = docs.drop(*names)
    rows = docs.select("*", text)
    schema = StructType(list(docs.schema.fields))  # add() changes it
    for name, kind in zip(names, ("string", "double", "double"), strict=True):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared, len(docs.columns), [f.name for f in schema]), schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")


def keep_known(docs: DataFrame, model: Model, reject_bits: float = REJECT_BITS, slack_bits: float = SLACK_BITS) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language: the best one's code is at most ``slack_bits`` longer than ``reject_bits`` a byte.

    Null and empty texts and those without a letter go; repeated rows stay or
    go together; columns of any name stay.  Where nothing was learned, no row
    stays.
    """
    lang, score, bits = (fresh(docs, n) for n in ("_lang_pred", "_score", "_bits"))
    known = (F.col(lang) != "und") & ((F.col(bits) - reject_bits) * F.octet_length("text") <= slack_bits)
    return predict(docs, model, (lang, score, bits)).where(known).select(*[F.col(f"`{c}`") for c in docs.columns])
