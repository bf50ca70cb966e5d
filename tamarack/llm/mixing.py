"""Mixing sources to target weights by a curriculum that varies with time.

Each source's weight goes from a first to a last value over the training, in a
straight line; its integral is the source's share.  Targets are filled up to
``cap`` times a source's size, and the excess is shared by weight among the
others.  A source's documents, shuffled by a seeded hash, form its stream,
which is read ``target`` words far, around again if it is shorter.  Where a
document's middle lies in that demand says, by the inverse of the schedule's
integral, at what time of the training it is read; documents are range-sorted
by that position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm.common import materialise, row_of, table, word_count
from tamarack.llm.ranking import buckets_for, hash_bucket, seeded_hash

SEED = 23
#: (first, last) weight of the sources by place, repeating; integrals 3, 1, 2.
SCHEDULES = ((4.5, 1.5), (1.0, 1.0), (1.0, 3.0))


def source_targets(sizes: DataFrame, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes(source, _size)`` with ``first, last`` weights and ``target``.

    One row a source; the windows over all of them sort that short table.
    Sources in the order of their UTF-8 bytes, null last.  With
    ``reach = cap * size / weight`` in ascending order, a source is capped if
    the weight's worth of what is left reaches that far.
    """
    n = len(schedules)
    place = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % n
    pick = lambda k: F.element_at(F.array(*[F.lit(float(s[k])) for s in schedules]), (F.col("_place") + 1).cast("int"))
    out = sizes.withColumn("_place", place).withColumns({"first": pick(0), "last": pick(1)}).withColumn("_weight", (F.col("first") + F.col("last")) / 2)
    out = out.withColumns({"_reach": F.lit(cap) * F.col("_size") / F.col("_weight"), "_all": F.sum("_size").over(Window.partitionBy())})
    order = Window.orderBy("_reach", F.col("source").isNull(), "source")
    out = out.withColumns({
        "_capped": F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_left": F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    out = out.withColumn("_level", (F.lit(share) * F.col("_all") - F.lit(cap) * F.col("_capped")) / F.col("_left"))
    # The level rises while sources are capped; the first that isn't sets it.
    level = F.min(F.when(F.col("_reach") > F.col("_level"), F.struct("_reach", "_level"))).over(Window.partitionBy())["_level"]
    return out.withColumn("_level", level).withColumn("target", F.when(F.col("_level").isNull() | (F.col("_reach") <= F.col("_level")), F.lit(cap) * F.col("_size")).otherwise(F.col("_level") * F.col("_weight"))).select("source", "first", "last", "target")


def _position(read: "F.Column") -> "F.Column":
    """Time in [0, 1] at which so many of the source's words have been asked for."""
    u, a, b = read / F.col("target"), F.col("first"), F.col("last")
    return F.when(a == b, u).otherwise((F.sqrt(a * a + (b - a) * (a + b) * u) - a) / (b - a))


def mix(docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0, seed: int = SEED, rows: int | None = None, words: str | None = None, tie: str | None = None) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target``, ``taken``, ``position`` and ``again_position``.

    ``taken`` counts the words that the mix takes, repeats included: a source's
    sum is its rounded target.  A document may be taken in part where its
    source's stream ends.  ``position`` is null where nothing is taken,
    ``again_position`` where the document isn't read twice; ``cap`` is 2 at
    most.  Needs ``doc_id``, ``source`` and ``text``, or instead of the text
    its number of words and its MD5 in the columns ``words`` and ``tie``;
    columns with the six names are replaced, others stay whatever their names.
    A null source is a source, the last; null and empty texts have size 0.
    Repeated rows count each.
    """
    if cap > 2:
        raise ValueError("a stream is read twice at most")
    docs = docs.drop("size", "source_size", "target", "taken", "position", "again_position")
    n = buckets_for(docs.count() if rows is None else rows)
    label = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    digest = F.md5(F.coalesce("text", F.lit(""))) if tie is None else F.col(tie)
    keyed = docs.select(row_of(docs).alias("_row"), "doc_id", "source", label.alias("_source"), (word_count("text") if words is None else F.col(words)).alias("_words"), digest.alias("_tie"))
    keyed = keyed.withColumn("_hash", seeded_hash(seed, "doc_id", "_tie")).withColumn("_bucket", hash_bucket(F.col("_hash"), n))
    light = materialise(keyed.groupBy("_source", "source", "_bucket").agg(F.count("*").alias("_n"), F.sum("_words").alias("_w")), "mix-sizes")
    targets = source_targets(light.groupBy("source").agg(F.sum("_w").alias("_size")), schedules, share, cap)
    upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = light.select("_source", "source", "_bucket", F.coalesce(F.sum("_w").over(upto), F.lit(0)).alias("_w0"), F.sum("_w").over(Window.partitionBy("_source")).alias("source_size"))
    base = base.join(targets, base["source"].eqNullSafe(targets["source"])).select("_source", "_bucket", "_w0", "source_size", "first", "last", "target")
    within = Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", "_words").rowsBetween(Window.unboundedPreceding, -1)
    rows_ = keyed.drop("source").withColumn("_b", F.coalesce(F.sum("_words").over(within), F.lit(0))).join(base, ["_source", "_bucket"])
    size, before, total = F.col("_words"), F.col("_w0") + F.col("_b"), F.floor(F.col("target") + 0.5).cast("long")
    got = lambda end: F.least(F.greatest(end - before, F.lit(0)), size)
    one, two = got(total), got(total - F.col("source_size"))
    middle = before + size / 2
    return rows_.select(
        "_row.*", size.alias("size"), "source_size", "target", (one + two).cast("long").alias("taken"),
        F.when(one > 0, F.least(_position(middle), F.lit(1.0))).alias("position"),
        F.when(two > 0, F.least(_position(F.col("source_size") + middle), F.lit(1.0))).alias("again_position"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    light = materialise(docs.select("doc_id", "source", word_count("text").alias("words"), F.md5(F.coalesce("text", F.lit(""))).alias("tie")), "words")
    out = mix(light, words="words", tie="tie").select("doc_id", "size", "source_size", "target", "taken", "position", "again_position")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('23:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 16) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [4.5, 1.0, 1.0][k + 1] AS a, [1.5, 1.0, 3.0][k + 1] AS b, [3.0, 1.0, 2.0][k + 1] AS weight
      FROM (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM s)),
r AS (SELECT *, CAST(2 AS DOUBLE) * source_size / weight AS reach, sum(source_size) OVER () AS whole FROM w),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * whole - CAST(2 AS DOUBLE) * coalesce(sum(source_size) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / CAST(sum(CAST(weight AS DOUBLE)) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
v AS (SELECT *, (SELECT arg_min(level, reach) FROM l WHERE reach > level) AS set_level FROM l),
t AS (SELECT source, source_size, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b,
             CASE WHEN set_level IS NULL OR reach <= set_level THEN CAST(2 AS DOUBLE) * source_size ELSE set_level * CAST(weight AS DOUBLE) END AS target FROM v),
c AS (SELECT d.doc_id, d.size, t.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CAST(floor(t.target + CAST(0.5 AS DOUBLE)) AS BIGINT) AS total
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, least(greatest(total - before, 0), size) AS one, least(greatest(total - source_size - before, 0), size) AS two,
             (CAST(before AS DOUBLE) + CAST(size AS DOUBLE) / 2) / target AS u, (CAST(source_size AS DOUBLE) + (CAST(before AS DOUBLE) + CAST(size AS DOUBLE) / 2)) / target AS u2 FROM c)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
       CASE WHEN one > 0 THEN least(CASE WHEN a = b THEN u ELSE (sqrt(a * a + (b - a) * (a + b) * u) - a) / (b - a) END, 1.0) END AS position,
       CASE WHEN two > 0 THEN least(CASE WHEN a = b THEN u2 ELSE (sqrt(a * a + (b - a) * (a + b) * u2) - a) / (b - a) END, 1.0) END AS again_position
FROM g
"""


def take(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that the mix reads, as often as it reads them (never, once or twice), with the columns of ``docs``, range-sorted by their positions in the training.

    A document that is taken in part stays whole.  Null and empty texts are
    never read; of repeated rows each is read as its own place in the stream
    says.  Columns of any name stay; an empty table gives an empty result.
    """
    rows = docs.select(row_of(docs).alias("row"), "doc_id", "source", word_count("text").alias("words"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    out = mix(rows, words="words", tie="tie", **parameters)
    times = F.filter(F.array("position", "again_position"), lambda p: p.isNotNull())
    return out.select("row", "doc_id", F.explode(times).alias("at")).orderBy("at", "doc_id").select("row.*")
