"""Interval joins: which intervals contain a point, and the innermost of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(points: DataFrame, spans: DataFrame, group: list[str], width: int) -> DataFrame:
    """Each pair of a point and a span of its group with ``begin <= at < end``.

    ``points(*group, at, ...)``, ``spans(*group, begin, end, ...)``.  Both meet in
    buckets of ``width``; a span is sent to each bucket that it touches, so that
    a width near the spans' own keeps both sides small.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    last = F.floor((F.col("end") - 1) / width)
    wide = spans.where("end > begin").withColumn("_b", F.explode(F.sequence(bucket("begin"), last)))
    return points.withColumn("_b", bucket("at")).join(wide, [*group, "_b"]).where("begin <= at and at < end").drop("_b")


def innermost(points: DataFrame, spans: DataFrame, group: list[str], key: list[str], width: int) -> DataFrame:
    """For each point (by ``key``) the containing span that begins last, of these the one that ends first."""
    found = containing(points, spans, group, width)
    rest = [c for c in spans.columns if c not in group]
    best = F.max_by(F.struct(*rest), F.struct(F.col("begin"), -F.col("end"))).alias("s")
    return found.groupBy(*key).agg(best).select(*key, "s.*")


def outside(points: DataFrame, spans: DataFrame, group: list[str], key: list[str], width: int) -> DataFrame:
    """Points in no span."""
    return points.join(containing(points, spans, group, width).select(*key).distinct(), key, "left_anti")
