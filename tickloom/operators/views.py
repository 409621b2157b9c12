"""What views show: rows of states, series over a common or a generic X axis, markers, messages, columns.

All of it is relational: intervals and events in, rows out. Drawing is left to the reader of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import as_of, overlap_join, point_join
from .states import in_range


def state_rows(found: DataFrame, keys: Sequence[str], low: int, high: int, keep: Column | None = None) -> DataFrame:
    """(keys, start, duration, label) of the states in [low, high]. Of those that `keep` rejects none stays, and kept neighbours
    of one label with nothing between them but rejected ones are not joined: a gap stays a gap."""
    rows = in_range(found, low, high)
    rows = rows.where(keep) if keep is not None else rows
    return rows.select(*keys, "start", (F.col("end") - F.col("start") + 1).alias("duration"), F.col("value").alias("label"))


def compacted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbouring states of one label that touch become one."""
    w = Window.partitionBy(*keys).orderBy("start")
    fresh = ~(F.col("label").eqNullSafe(F.lag("label").over(w)) & (F.lag(F.col("start") + F.col("duration")).over(w) == F.col("start")))
    runs = rows.withColumn("__run", F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.sum("duration").alias("duration"), F.first("label").alias("label")).drop("__run")


def at_samples(found: DataFrame, keys: Sequence[str], times: Sequence[int]) -> DataFrame:
    """(keys, t, value): of each key the last value at or before each time (found: keys, ts, rank, value); none before the first."""
    points = F.explode(F.array(*[F.lit(t).cast("long") for t in sorted(set(times))]))
    asked = found.select(*keys).distinct().withColumn("t", points)
    last = found.groupBy(*keys, "ts").agg(F.max_by("value", "rank").alias("value"))
    return as_of(asked, last, list(keys), "t", "ts", ["value"]).where("value is not null")


def memory_series(found: DataFrame, times: Sequence[int], shift: bool) -> DataFrame:
    """(series, t, value) of each thread and in total, from (tid, ts, rank, value); a thread counts 0 before its first event.

    With `shift` (pages that were there before the trace) each thread's values are raised by the least it ever has, if that is negative."""
    low = found.groupBy("tid").agg(F.least(F.min("value"), F.lit(0)).alias("__low"))
    raised = found.join(low, "tid").withColumn("value", F.col("value") - F.col("__low")) if shift else found
    rows = at_samples(raised.select("tid", "ts", "rank", "value"), ["tid"], times)
    return rows.select(F.col("tid").cast("string").alias("series"), "t", "value").unionByName(rows.groupBy("t").agg(F.sum("value").alias("value")).select(F.lit("total").alias("series"), "t", "value"))


def disk_series(requests: DataFrame, times: Sequence[int], sector: int = 512) -> DataFrame:
    """(dev, t, bytes a second) of each step between sample times; a request spreads evenly over its time."""
    points = sorted(set(times))
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in zip(points, points[1:])])
    hit = F.filter(steps, lambda s: (s.a < F.col("completed")) & (s.b > F.col("issued")))
    rows = requests.where((F.col("issued") < points[-1]) & (F.col("completed") > points[0])).withColumn("s", F.explode(hit))
    share = (F.least("completed", "s.b") - F.greatest("issued", "s.a")) / (F.col("completed") - F.col("issued"))
    return rows.groupBy("dev", F.col("s.b").alias("t")).agg((F.sum(F.col("sectors") * sector * share) * 1e6 / F.first(F.col("s.b") - F.col("s.a"))).alias("rate"))


def deltas(series: DataFrame, keys: Sequence[str], t: str = "t", value: str = "value") -> DataFrame:
    """Each value less the one before it in its series; the first less 0."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(t))
    return series.withColumn(value, F.col(value) - F.coalesce(before, F.lit(0)))


def by_category(rows: DataFrame, series: str, ranges: Sequence[int], value: Column) -> DataFrame:
    """(series, low, high, n): rows whose value falls in each [low, high) of consecutive bounds; empty ranges of a series count 0."""
    bounds = [F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high")) for a, b in zip(ranges, ranges[1:])]
    counts = rows.groupBy(series).agg(*[F.count_if((value >= a) & (value < b)).alias(f"__{k}") for k, (a, b) in enumerate(zip(ranges, ranges[1:]))])
    cells = F.array(*[F.struct(b.alias("range"), F.col(f"__{k}").alias("n")) for k, b in enumerate(bounds)])
    return counts.select(series, F.explode(cells).alias("c")).select(series, "c.range.low", "c.range.high", "c.n")


def numbers(rows: DataFrame, value: Column, accept: Column) -> DataFrame:
    """What a chart's axis needs of the accepted values: how many, the least and the greatest."""
    return rows.where(accept & value.isNotNull()).agg(F.count("*").alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))


def lost_events(events: DataFrame, lost: Column, count: Column, until: Column, low: int, high: int) -> DataFrame:
    """(start, duration, n): the ranges in [low, high] in which a tracer lost events."""
    rows = events.where(lost).select(F.col("ts").alias("start"), (until - F.col("ts")).alias("duration"), count.alias("n"))
    return rows.where((F.col("start") <= high) & (F.col("start") + F.col("duration") >= low))


def split_markers(markers: DataFrame, parts: int) -> DataFrame:
    """Each marker (start, end, index) in equal parts, numbered from 0; bounds are rounded to whole units, the last ends with the marker."""
    at = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = markers.withColumn("part", at)
    span = F.col("end") - F.col("start")
    bound = lambda k: F.col("start") + F.floor(span * k / parts)
    return rows.select("index", "part", bound(F.col("part")).alias("start"), bound(F.col("part") + 1).alias("end"))


def weighted_markers(markers: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Each marker in parts whose widths are as the weights."""
    total, sums = sum(weights), [sum(weights[:k]) for k in range(len(weights) + 1)]
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(zip(sums, sums[1:]))])
    rows = markers.withColumn("p", F.explode(parts))
    span = F.col("end") - F.col("start")
    return rows.select("index", "p.part", (F.col("start") + F.floor(span * F.col("p.a") / total)).alias("start"), (F.col("start") + F.floor(span * F.col("p.b") / total)).alias("end"))


def messages(pairs: DataFrame, sender: str, receiver: str) -> DataFrame:
    """Matched pairs as messages of a sequence diagram: synchronous where both ends have one time."""
    return pairs.select(F.col(sender).alias("sender"), F.col(receiver).alias("receiver"), F.col("src_ts").alias("start"), F.col("dst_ts").alias("end"), (F.col("src_ts") == F.col("dst_ts")).alias("synchronous"))


def event_types(events: DataFrame, content: str, type_: str = "type") -> DataFrame:
    """(type, n, fields): the event types of a trace with the names of their fields, sorted."""
    keys = F.explode_outer(F.json_object_keys(content))
    names = events.select(type_, keys.alias("__f")).groupBy(type_).agg(F.array_sort(F.collect_set("__f")).alias("fields"))  # field names: a few a type
    return events.groupBy(type_).agg(F.count("*").alias("n")).join(names, type_)


def intersection(a: DataFrame, b: DataFrame, width: int, on: Sequence[str] = ()) -> DataFrame:
    """Each pair of time ranges that share a time, what they share, and whether the first contains the second."""
    both = overlap_join(a, b, width, on)
    return both.withColumn("o_start", F.greatest("start", "b_start")).withColumn("o_end", F.least("end", "b_end")).withColumn("contains", (F.col("start") <= F.col("b_start")) & (F.col("end") >= F.col("b_end")))


def binaries_at(calls: DataFrame, loads: DataFrame, page: int = 1 << 12) -> DataFrame:
    """The binary whose code holds each address at a call's time, with the offset in it.

    calls: (pid, ts, address); loads: (pid, base, size, path, loaded, unloaded). Code is dealt to pages of addresses, so the join
    is one of equality; a base can be used again after an unload."""
    code = loads.select("pid", F.col("base").alias("start"), (F.col("base") + F.col("size") - 1).alias("end"), "path", "loaded", "unloaded").where("end >= start")
    held = point_join(calls, code, "address", page, ["pid"]).where((F.col("ts") >= F.col("i_loaded")) & (F.col("ts") < F.col("i_unloaded")))
    return held.withColumn("path", F.col("i_path")).withColumn("offset", F.col("address") - F.col("i_start"))


def ongoing(changes: DataFrame, keys: Sequence[str], built: int) -> DataFrame:
    """(keys, start, value) of what each attribute holds while a history is built up to a time: its last value, since when."""
    rows = changes.where(F.col("ts") <= built)
    last = rows.groupBy(*keys, "ts").agg(F.max_by("value", "seq").alias("value"))
    w = Window.partitionBy(*keys).orderBy("ts")
    marked = last.withColumn("__new", ~F.col("value").eqNullSafe(F.lag("value").over(w)) | F.lag("ts").over(w).isNull())
    return marked.groupBy(*keys).agg(F.max(F.when(F.col("__new"), F.col("ts"))).alias("start"), F.max_by("value", "ts").alias("value"))


def checkpointed_states(changes: DataFrame, found: DataFrame, keys: Sequence[str], t: int, every: int, origin: int) -> DataFrame:
    """(keys, value) at t from a partial history: intervals that cross the checkpoint before t, then the changes from there to t."""
    mark = origin + (t - origin) // every * every
    base = found.where((F.col("start") <= mark) & (F.col("end") >= mark)).select(*keys, F.lit(mark).alias("ts"), F.lit(-1).cast("long").alias("seq"), "value")
    later = changes.where((F.col("ts") > mark) & (F.col("ts") <= t)).select(*keys, "ts", F.col("seq").cast("long").alias("seq"), "value")
    return base.unionByName(later).groupBy(*keys).agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def backward(found: DataFrame, count: int) -> DataFrame:
    """The last intervals by end, then start: a top-k, not a sort."""
    return found.orderBy(F.desc("end"), F.desc("start"), *[c for c in found.columns if c not in ("start", "end")]).limit(count)


def varint(value: Column) -> Column:
    """A number of 0 or more as bytes of seven bits, least first, each but the last with the high bit set; as hexadecimal text."""
    group = lambda k: F.shiftrightunsigned(value, k * 7)
    byte = lambda k: F.when(group(k + 1) > 0, F.bitwise_not(F.lit(~128)).bitwiseOR(group(k).bitwiseAND(F.lit(127)))).otherwise(group(k).bitwiseAND(F.lit(127)))
    text = lambda k: F.lpad(F.lower(F.hex(byte(k))), 2, "0")
    return F.concat(text(0), *[F.when(group(k) > 0, text(k)).otherwise("") for k in range(1, 9)])
