"""Joins on closed integer intervals.

Spark plans a range condition as a nested loop. Here both sides are dealt to time buckets, joined on the
bucket (an equality, so it is sorted or hashed, and AQE splits skewed buckets), and each pair is kept in
one bucket only: the one in which the later of the two begins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _bucket(c: Column | str, width: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(width))


def overlap_join(a: DataFrame, b: DataFrame, width: int, on: Sequence[str] = (), a_ends=("start", "end"), b_ends=("start", "end"), prefix: str = "b_", how: str = "inner") -> DataFrame:
    """Pairs of intervals that share a point. b's columns but `on` get a prefix.

    `width` should be near the median length: an interval is dealt to each bucket that it meets."""
    right = b.select(*on, *[F.col(c).alias(prefix + c) for c in b.columns if c not in on])
    b0, b1 = (prefix + c for c in b_ends)
    spread_a = a.withColumn("__bucket", F.explode(F.sequence(_bucket(a_ends[0], width), _bucket(a_ends[1], width))))
    spread_b = right.withColumn("__bucket", F.explode(F.sequence(_bucket(b0, width), _bucket(b1, width))))
    once = F.col("__bucket") == _bucket(F.greatest(F.col(a_ends[0]), F.col(b0)), width)
    meet = (F.col(a_ends[0]) <= F.col(b1)) & (F.col(a_ends[1]) >= F.col(b0))
    return spread_a.join(spread_b, [*on, "__bucket"], how).where(meet & once).drop("__bucket")


def point_join(points: DataFrame, intervals: DataFrame, at: str, width: int, on: Sequence[str] = (), ends=("start", "end"), prefix: str = "i_") -> DataFrame:
    """Each point with the intervals that contain it."""
    right = intervals.select(*on, *[F.col(c).alias(prefix + c) for c in intervals.columns if c not in on])
    low, high = (prefix + c for c in ends)
    spread = right.withColumn("__bucket", F.explode(F.sequence(_bucket(low, width), _bucket(high, width))))
    return points.withColumn("__bucket", _bucket(at, width)).join(spread, [*on, "__bucket"]).where(F.col(at).between(F.col(low), F.col(high))).drop("__bucket")


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, right_at: str, values: Sequence[str], strict: bool = False, tie: str | None = None) -> DataFrame:
    """left with the `values` of the last right row at or before (strict: before) its time, by key.

    One union, one sort by key and time and a running last: no range join, one shuffle of either side."""
    l_rows = left.select(*on, F.col(at).alias("__at"), F.lit(0 if strict else 2).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.struct(*left.columns).alias("__row"), F.lit(None).cast("struct<" + ",".join(f"`{v}`:{right.schema[v].dataType.simpleString()}" for v in values) + ">").alias("__v"))
    r_rows = right.select(*on, F.col(right_at).alias("__at"), F.lit(1).alias("__side"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("__tie"), F.lit(None).cast(left.schema.simpleString()).alias("__row"), F.struct(*values).alias("__v"))
    w = Window.partitionBy(*on).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = l_rows.unionByName(r_rows).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where("__row is not null").select("__row.*", *[F.col(f"__v.{v}").alias(v) for v in values])
