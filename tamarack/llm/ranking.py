"""Ranks and running sums within groups, without one task for a group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(seed: int, *cols: str) -> "F.Column":
    """16 hexadecimal digits that shuffle rows: the same for the same values on any engine that has MD5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 16)


def first_share(hash_: "F.Column", wanted: int, rows: int) -> "F.Column":
    """Whether a seeded hash is among the first, of which some 2 * ``wanted`` + 100 of ``rows`` are: a sample of ``wanted`` can then be ranked without a row from each partition."""
    share = (2 * wanted + 100) / max(1, rows)
    return F.lit(True) if share >= 1 else hash_ < F.lit(f"{int(share * (1 << 64)):016x}")


def buckets_for(rows: int) -> int:
    """So many that a bucket and the table of buckets both grow with the root of the rows."""
    return max(1, math.ceil(math.sqrt(rows) / 2))


def hash_bucket(col: "F.Column", buckets: int) -> "F.Column":
    """Which of ``buckets`` equal ranges of the hash a row lies in."""
    return F.floor(F.conv(F.substring(col, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")


def ranked(light: DataFrame, rows: DataFrame, group: list[str], bucket: str, order: list[str], weight: str | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 1), ``group_rows`` and, with ``weight``, ``before`` (sum of the earlier rows' weights) and ``group_weight``.

    ``bucket`` says where in the group's order a row lies roughly; rows are
    ordered by bucket, then by ``order``.  ``light`` holds the same rows, with
    only the columns ``group``, ``bucket`` and ``weight``: its counts by
    bucket are combined before the shuffle and summed up over buckets, and
    each bucket is then ranked on its own.  ``group`` columns are not null.
    Columns of ``rows`` other than those named here must not begin with ``_``.
    """
    keys = [*group, bucket]
    aggs = [F.count("*").alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    sums = light.groupBy(*keys).agg(*aggs)
    upto = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    cols = [F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"), F.sum("_n").over(whole).alias("group_rows")]
    if weight:
        cols += [F.coalesce(F.sum("_w").over(upto), F.lit(0)).alias("_w0"), F.sum("_w").over(whole).alias("group_weight")]
    base = sums.select(*keys, *cols)
    within = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("_r", F.row_number().over(within))
    if weight:
        out = out.withColumn("_b", F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(base, keys).withColumn("rank", F.col("_n0") + F.col("_r"))
    if weight:
        out = out.withColumn("before", F.col("_w0") + F.col("_b"))
    return out.drop("_n0", "_r", "_w0", "_b")
