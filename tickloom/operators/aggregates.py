"""Counts, histograms, counters, weighted trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def grid(spark, low: int, high: int, n: int) -> DataFrame:
    """n buckets (bucket, start) of equal integer width."""
    width = max(1, -(-(high - low + 1) // n))
    return spark.range(n).select(F.col("id").alias("bucket"), (F.lit(low) + F.col("id") * width).alias("start"))


def histogram(events: DataFrame, low: int, high: int, n: int, weight: Column | None = None) -> DataFrame:
    """Events in n buckets of [low, high]; empty buckets give 0."""
    width = max(1, -(-(high - low + 1) // n))
    rows = events.where(F.col("ts").between(low, high)).groupBy(F.floor((F.col("ts") - low) / width).alias("bucket")).agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))
    return grid(events.sparkSession, low, high, n).join(F.broadcast(rows), "bucket", "left").select("bucket", "start", F.coalesce("n", F.lit(0)).alias("n"))


def spread_lost(lost: DataFrame, low: int, high: int, n: int) -> DataFrame:
    """Lost counts (start, end, lost) spread evenly over the buckets that their range meets."""
    width = max(1, -(-(high - low + 1) // n))
    first, last = F.floor((F.greatest("start", F.lit(low)) - low) / width), F.floor((F.least("end", F.lit(high)) - low) / width)
    rows = lost.where((F.col("start") <= high) & (F.col("end") >= low)).withColumn("bucket", F.explode(F.sequence(first, last)))
    a = F.greatest(F.col("start"), low + F.col("bucket") * width)
    b = F.least(F.col("end"), low + (F.col("bucket") + 1) * width - 1)
    return rows.groupBy("bucket").agg(F.sum(F.col("lost") * (b - a + 1) / (F.col("end") - F.col("start") + 1)).alias("lost"))


def adaptive_histogram(events: DataFrame, buckets: int) -> DataFrame:
    """A fixed number of buckets whose width starts at 1 and doubles until the whole span fits. Two passes."""
    span = events.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    exponent = F.greatest(F.lit(0), F.ceil(F.log2((F.col("t1") - F.col("t0") + 1) / F.lit(buckets)))).cast("int")
    span = span.withColumn("width", F.expr("bigint(1)") * F.pow(F.lit(2), exponent).cast("long"))
    rows = events.crossJoin(F.broadcast(span))  # one row
    return rows.groupBy(F.floor((F.col("ts") - F.col("t0")) / F.col("width")).alias("bucket"), "width").agg(F.count("*").alias("n"))


def counter(events: DataFrame, keys: Sequence[str], value: Column, cumulative: bool, order: Sequence[str] = ("ts", "rank")) -> DataFrame:
    """The counter's value after each event: the value itself, or the running sum. Rows with a null key are skipped."""
    rows = events.dropna(subset=list(keys))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("value", value if cumulative else F.sum(F.coalesce(value, F.lit(0))).over(w))


def sampled_counter(changes: DataFrame, keys: Sequence[str], times: Sequence[int], differential: bool = False) -> DataFrame:
    """(keys, t, value) on a grid of query times: the value as of t, or its growth since the time before.

    Changes are first reduced to one row a grid cell, so what is joined and windowed is as small as the grid."""
    points = sorted(set(times))
    array = F.array(*[F.lit(t).cast("long") for t in points])
    cell = F.size(F.filter(array, lambda t: t < F.col("ts")))  # the first time at or after the change
    cells = changes.withColumn("__cell", cell).where(F.col("__cell") < len(points)).groupBy(*keys, "__cell").agg(F.max_by("value", F.struct("ts", "rank")).alias("__v"))
    every = changes.select(*keys).distinct().withColumn("__cell", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1))))
    w = Window.partitionBy(*keys).orderBy("__cell")
    out = every.join(cells, [*keys, "__cell"], "left").withColumn("value", F.coalesce(F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    if differential:
        out = out.withColumn("value", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)))
    return out.select(*keys, F.get(array, F.col("__cell")).alias("t"), "value")


def weighted_tree(leaves: DataFrame, path: str, weight: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, path, weight, n) of every node: a node's weight is that of all leaves below it."""
    rows = leaves.withColumn("__node", F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.slice(path, 1, k))))
    return rows.groupBy(*group, F.col("__node").alias("path")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def merge_trees(*trees: DataFrame) -> DataFrame:
    """Nodes of equal path add up."""
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out.groupBy("path").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def regroup(tree: DataFrame, groups: str, level: int | None) -> DataFrame:
    """Trees grouped by the first `level` names of their group path (None: all together)."""
    keys = [] if level is None else [F.slice(groups, 1, level).alias(groups)]
    return tree.groupBy(*keys, "path").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def streams(packets: DataFrame, protocol: str = "protocol", source: str = "src", target: str = "dst", size: str = "bytes") -> DataFrame:
    """Conversations by unordered pair of endpoints: packets and bytes each way, start, stop, rate."""
    a, b = F.least(source, target), F.greatest(source, target)
    ab = F.col(source) == a
    n = lambda c: F.count(F.when(c, 1))
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col(size))), F.lit(0))
    out = packets.groupBy(F.col(protocol).alias("protocol"), a.alias("a"), b.alias("b"))
    out = out.agg(n(ab).alias("packets_ab"), n(~ab).alias("packets_ba"), s(ab).alias("bytes_ab"), s(~ab).alias("bytes_ba"), F.min("ts").alias("start"), F.max("ts").alias("stop"))
    span = (F.col("stop") - F.col("start")) / 1e6
    return out.withColumn("bps", F.when(span > 0, 8 * (F.col("bytes_ab") + F.col("bytes_ba")) / span))
