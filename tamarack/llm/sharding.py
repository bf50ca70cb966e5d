"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row's
fractional rank is ``(rank - 1/2) / rows of its source``.  In the order of
fractional ranks any stretch holds each source in proportion, and the order is
cut into shards whose counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import materialise, row_of, table, utf8_bytes
from tamarack.llm.ranking import buckets_for, hash_bucket, ranked, seeded_hash

SEED = 17


def shard(docs: DataFrame, shards: int = 40, seed: int = SEED, rows: int | None = None, tie: str | None = None) -> DataFrame:
    """``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard).

    Needs ``doc_id``, ``source`` and ``text``, or instead of the text its
    CRC-32 in the column ``tie``; columns named ``shard`` or ``slot`` are
    replaced, others stay whatever their names.  A null source is a stratum of
    its own.  The hash is of id and text, so that repeated or null ids are
    spread; rows that are equal in both are interchangeable.  Equal texts are
    dealt out like other rows: no shard can hold a group that is larger than
    itself.  Fewer rows than shards leave shards empty.
    """
    docs = docs.drop("shard", "slot")
    total = docs.count() if rows is None else rows
    n = buckets_for(total)
    crc = F.crc32(F.coalesce("text", F.lit(""))) if tie is None else F.col(tie)
    keyed = docs.select(row_of(docs).alias("_row"), "doc_id", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_stratum"), crc.alias("_tie"))
    keyed = keyed.withColumn("_hash", seeded_hash(seed, "doc_id", "_tie")).withColumn("_bucket", hash_bucket(F.col("_hash"), n))
    one = ranked(keyed.select("_stratum", "_bucket"), keyed, ["_stratum"], "_bucket", ["_hash", "doc_id", "_tie"])
    one = one.withColumn("_part", (2 * F.col("rank") - 1) / (2 * F.col("group_rows"))).drop("_bucket", "rank", "group_rows")
    one = one.withColumns({"_all": F.lit(0), "_bucket": F.floor(F.col("_part") * F.lit(n)).cast("long")})
    light = one.select("_all", "_bucket")
    two = ranked(light, one, ["_all"], "_bucket", ["_part", "_stratum", "_hash", "doc_id", "_tie"])
    place = F.col("rank") - 1
    which = F.expr(f"((rank - 1) * {shards}) div group_rows")
    begin = F.expr(f"(_shard * group_rows + {shards - 1}) div {shards}")
    return two.withColumn("_shard", which).select("_row.*", F.col("_shard").cast("int").alias("shard"), (place - begin).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    light = materialise(docs.select("doc_id", "source", utf8_bytes("text").alias("n"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")), "sizes")
    out = shard(light, tie="text_crc32")
    return out.select("doc_id", (F.col("n") + 16).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no CRC-32: its table follows from the polynomial, and the bytes are folded one by one.
OP4_SQL = """
WITH tbl AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, CAST(octet_length(encode(text)) AS BIGINT) + 16 AS size,
             xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, octet_length(encode(text))), lambda k: CAST('0x' || hex(encode(text))[2 * k + 1:2 * k + 2] AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
      FROM d, tbl),
k AS (SELECT *, substr(md5('17:' || doc_id || ':' || text_crc32), 1, 16) AS h FROM s),
r AS (SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) - 1 AS DOUBLE) / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS part FROM k),
g AS (SELECT *, row_number() OVER (ORDER BY part, stratum, h, doc_id) - 1 AS place, count(*) OVER () AS n FROM r),
b AS (SELECT *, place * 40 // n AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, place - (shard * n + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM b
"""
