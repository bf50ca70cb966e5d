"""Token counts with a digest cache.

A text's normal form collapses runs of ASCII white space to one space and cuts
them at both ends: tokenizers of the supported kind drop white space, so that
texts with one normal form have one count.  The normal form's SHA-256 and a
digest of the tokenizer's file and library version are the cache's key.
Counts that the cache holds are joined; of what it lacks each distinct form is
encoded once and appended.

Hot texts: each partition sends a form once, whatever its number of copies.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import materialise, row_of, shared_dir, table, utf8_bytes

#: Words whose counts a worker remembers; beyond that it starts anew.
MEMO_WORDS = 400_000
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


@lru_cache(maxsize=2)
def parts_at_space(path: str) -> bool:
    """Whether a text's count is the sum of its words' counts: the pre-tokenizer drops white space and the normalizer maps it to spaces, so that no token reaches over it."""
    if path.endswith(".model"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    flat = json.dumps([spec.get("pre_tokenizer"), spec.get("normalizer")])
    split = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split"]
    dropped = any(p.get("behavior") == "Removed" and p.get("invert") and r"[^\s\p{L}\p{N}]+" in p["pattern"].get("Regex", "") for p in split)
    special = all(not t.get("lstrip") and not t.get("rstrip") for t in spec.get("added_tokens", []))
    return dropped and special and '"add_prefix_space": true' not in flat


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """As the library counts whole texts, without begin, end or added special tokens; special strings in a text by its default."""
    t = _tokenizer(path)
    if path.endswith(".model"):
        return [len(x) for x in t.encode(texts, num_threads=1)]
    return [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


class Counter:
    """Counts texts; where the tokenizer parts at white space, by distinct words."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.path, self.memo_words, self.memo = path, memo_words, {}
        self.by_word = parts_at_space(path)

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return count_tokens(self.path, texts)
        split = [t.encode().split() for t in texts]
        memo = self.memo
        missing = list({w for words in split for w in words if w not in memo})
        if len(memo) + len(missing) > self.memo_words:
            memo.clear()
            missing = list({w for words in split for w in words})
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            memo.update(zip(part, count_tokens(self.path, [w.decode() for w in part]), strict=True))
        get = memo.__getitem__
        return [sum(map(get, words)) for words in split]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops a digest's further rows within the partition."""
    seen: set[bytes] = set()
    for b in batches:
        digests = b.column(0).to_pylist()
        keep = []
        for i, d in enumerate(digests):
            if d not in seen:
                seen.add(d)
                keep.append(i)
        if len(seen) > 1_000_000:
            seen.clear()
        if keep:
            yield b if len(keep) == b.num_rows else b.take(pa.array(keep))


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                n = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n)), part.column(0).cast(pa.binary()), pa.array(n, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Needs a ``text`` column; a column of one of the three names is replaced,
    other columns stay.  A null text counts as empty.  Repeated rows keep a
    row each; an empty table gives an empty result and appends nothing.
    ``cache_path`` is a Parquet folder that all executors share; it is made if
    missing and gets the counts of texts it lacked.  Two runs that append the
    same text at once leave a row each with one count; readers take one.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    digest = F.unhex(F.sha2(F.col("_form"), 256))
    form = F.coalesce("text", F.lit(""))
    if parts_at_space(tokenizer_path):  # only there white space makes no difference
        form = F.trim(F.regexp_replace(form, "[ \\t\\n\\x0B\\f\\r]+", " "))
    forms = docs.select(form.alias("_form")).select(digest.alias("digest"), "_form").mapInArrow(_once, "digest binary, _form string")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
        forms = forms.join(stored.select("digest"), "digest", "left_anti")
    misses = forms.repartition("digest").mapInArrow(_once, "digest binary, _form string").mapInArrow(_encode(tokenizer_path, version), CACHE_SCHEMA)
    misses.write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    # Written, so that nothing but shuffles lies below the join: only then AQE can cut up the partition of a hot text.
    counts = materialise(counts, "counts")
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    rows = docs.select(row_of(docs).alias("row"), utf8_bytes("text").alias("n_bytes"), form.alias("_form")).select("row", "n_bytes", digest.alias("digest"))
    return rows.join(counts, "digest", "left").select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = f"{shared_dir(spark)}/tamarack/token-cache-{uuid.uuid4().hex}"
    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), cache)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
