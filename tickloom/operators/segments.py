"""Segments: [start, end] with a name and content. Pairing, statistics, density, scatter, tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType


def pair(events: DataFrame, keys: Sequence[str], begin: Column, end: Column, order: Sequence[str] = ("ts", "rank"), keep: Sequence[str] = ()) -> DataFrame:
    """Begin/end pairs by key: a later begin replaces an earlier one, an end takes the begin, an end alone is ignored.

    Only begins and ends go to the window; an end whose previous row is a begin closes it. Columns of the begin
    in `keep` get the prefix begin_."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = events.where(begin | end).withColumn("__begin", begin)
    rows = rows.withColumn("__open", F.lag("__begin").over(w)).withColumn("start", F.lag(order[0]).over(w))
    for c in keep:
        rows = rows.withColumn(f"begin_{c}", F.lag(c).over(w))
    return rows.where(~F.col("__begin") & F.col("__open")).withColumn("end", F.col(order[0])).drop("__begin", "__open")


def length(start: str = "start", end: str = "end") -> Column:
    return F.col(end) - F.col(start)


def statistics(rows: DataFrame, by: Sequence[str], value: Column, total: bool = False) -> DataFrame:
    """count, min, max, mean, sample standard deviation (null up to two values), total; with `total`, a row for all besides.

    The total of whole numbers is a decimal(30, 0): that of a few years in microseconds, times some hundred thousand, is beyond a long."""
    v = rows.withColumn("__v", value)
    whole = isinstance(v.schema["__v"].dataType, IntegralType)
    groups = v.rollup(*by) if total else v.groupBy(*by) if by else v.groupBy()
    n = F.count("__v")
    return groups.agg(n.alias("n"), F.min("__v").alias("minimum"), F.max("__v").alias("maximum"), F.avg("__v").alias("mean"), F.when(n > 2, F.stddev_samp("__v")).alias("deviation"), F.sum(F.col("__v").cast("decimal(20,0)") if whole else "__v").alias("total"))


def extremes(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Ends of the segment with the least and with the greatest value (ties: the earlier start, then end)."""
    low, high = F.struct(value, "start", "end"), F.struct(value, -F.col("start"), -F.col("end"))
    out = rows.groupBy(*by).agg(F.min(low).alias("a"), F.max(high).alias("b"))
    return out.select(*by, F.col("a.start").alias("min_start"), F.col("a.end").alias("min_end"), (-F.col("b.col2")).alias("max_start"), (-F.col("b.col3")).alias("max_end"))


def with_selection(rows: DataFrame, by: str, low: int, high: int) -> DataFrame:
    """The statistics tree: Total with its names, and Selection with the names that meet [low, high]."""
    value = length()

    def tree(df, label):
        out = statistics(df, [by], value, total=True)
        return out.select(F.lit(label).alias("root"), F.coalesce(by, F.lit(label)).alias("label"), *[c for c in out.columns if c != by])

    return tree(rows, "Total").unionByName(tree(overlapping(rows, low, high), "Selection"))


def overlapping(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.where((F.col("start") <= high) & (F.col("end") >= low))


def stab(rows: DataFrame, t: int) -> DataFrame:
    return overlapping(rows, t, t)


def ordered(rows: DataFrame, by: str = "start", descending: bool = False) -> DataFrame:
    """By start, end or length; ties by start, then end."""
    key = length() if by == "length" else F.col(by)
    return rows.orderBy(key.desc() if descending else key.asc(), "start", "end")


def density(rows: DataFrame, by: str, bins: int) -> DataFrame:
    """Durations of each name in equal bins from 0 to the greatest of all; the last bin is closed; nothing if the bins are 0 wide."""
    width = rows.agg(F.floor(F.max(length()) / bins).alias("__w"))  # one row
    at = F.least(F.floor(length() / F.col("__w")), F.lit(bins - 1))
    return rows.crossJoin(F.broadcast(width)).where("__w > 0").groupBy(by, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def scatter(rows: DataFrame, by: str, low: int, high: int, pixels: int) -> DataFrame:
    """Points (name, start, duration) where, of a name, a segment goes if it starts in the last kept one's pixel with a length within a pixel of its."""
    width = max(1, (high - low) // pixels)

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "duration"], kind="stable")
        keep, last = [], None
        for s, d in zip(pdf["start"], pdf["duration"], strict=True):
            drop = last is not None and s // width == last[0] // width and abs(d - last[1]) < width
            keep.append(not drop)
            last = last if drop else (s, d)
        return pdf[keep]

    # A pixel is thinned by itself but for its first segment, which is always kept: so name and pixel make the groups.
    points = overlapping(rows, low, high).select(F.col(by).alias("name"), "start", length().alias("duration"))
    return points.groupBy("name", F.floor(F.col("start") / width)).applyInPandas(thin, "name string, start long, duration long")


def page(rows: DataFrame, by: Sequence[Column | str], index: int, count: int, total_order: Sequence[str]) -> DataFrame:
    """Lines index .. index + count - 1 of the order: a top-k of index + count rows, never a whole sort."""
    return rows.orderBy(*by, *total_order).offset(index).limit(count)
