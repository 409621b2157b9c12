"""State system: changes fold into closed, gap-free intervals of an attribute's value; queries read them.

Changes are (keys..., ts, seq, value). Of several writes at one time the last (by seq) counts; an equal value
opens no interval; an interval ends one unit before the next begins and the last ends with the history."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import point_join


# ---------------------------------------------------------------- build


def last_writes(changes: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    return changes.groupBy(*keys, "ts").agg(F.max_by("value", seq).alias("value"))


def intervals(changes: DataFrame, keys: Sequence[str], end: int, start: int | None = None, seq: str = "seq") -> DataFrame:
    """(keys, start, end, value). With `start`, an attribute is null from there to its first change."""
    w = Window.partitionBy(*keys).orderBy("ts")
    rows = last_writes(changes, keys, seq)
    if start is not None:
        first = rows.groupBy(*keys).agg(F.min("ts").alias("ts")).where(F.col("ts") > start).select(*keys, F.lit(start).cast("long").alias("ts"), F.lit(None).cast(rows.schema["value"].dataType).alias("value"))
        rows = rows.unionByName(first)
    rows = rows.withColumn("__p", F.lag("value").over(w)).withColumn("__n", F.row_number().over(w))
    rows = rows.where((F.col("__n") == 1) | ~F.col("value").eqNullSafe(F.col("__p")))
    return rows.select(*keys, F.col("ts").alias("start"), F.coalesce(F.lead("ts").over(w) - 1, F.lit(end).cast("long")).alias("end"), "value")


def increments(changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Changes whose values add up: each becomes the running total (a null adds 0)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("value", F.sum(F.coalesce("value", F.lit(0))).over(w))


def depths(ops: DataFrame, keys: Sequence[str], push: Column, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The depth after each push or pop; popping an empty stack does nothing.

    The running sum less its least value so far (0 at most) is the depth that never goes below 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ops.withColumn("__s", F.sum(F.when(push, 1).otherwise(-1)).over(w))
    return rows.withColumn("depth", (F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).cast("long")).drop("__s")


def stack_intervals(ops: DataFrame, keys: Sequence[str], push: Column, value: str, end: int, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """(keys, depth, start, end, value) of pushed values: each lasts until the pop that returns below its depth.

    A level's rows are its pushes and the pops that leave it, so the row after a push on its level ends it."""
    rows = depths(ops, keys, push, order).withColumn("__push", push)
    w0 = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("__before", F.lag("depth", 1, 0).over(w0)).where(F.col("__push") | (F.col("__before") > F.col("depth")))
    rows = rows.withColumn("level", F.when(F.col("__push"), F.col("depth")).otherwise(F.col("depth") + 1))
    w = Window.partitionBy(*keys, "level").orderBy(*order)
    rows = rows.withColumn("__next", F.lead(order[0]).over(w))
    return rows.where("__push").select(*keys, F.col("level").alias("depth"), F.col(order[0]).alias("start"), F.coalesce(F.col("__next") - 1, F.lit(end).cast("long")).alias("end"), F.col(value).alias("value"))


def queue_items(ops: DataFrame, keys: Sequence[str], offer: Column, value: str, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """FIFO: the n-th effective poll takes the n-th offer; polling an empty queue does nothing."""
    rows = depths(ops, keys, offer, order).withColumn("__offer", offer)
    w0 = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("__before", F.lag("depth", 1, 0).over(w0)).where(F.col("__offer") | (F.col("__before") > F.col("depth")))
    n = F.row_number().over(Window.partitionBy(*keys, "__offer").orderBy(*order))
    rows = rows.withColumn("n", n)
    offers = rows.where("__offer").select(*keys, "n", F.col(order[0]).alias("offered"), value)
    polls = rows.where("not __offer").select(*keys, "n", F.col(order[0]).alias("polled"))
    return offers.join(polls, [*keys, "n"], "left")


def update_ongoing(found: DataFrame, updates: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Updates replace an interval's value from its start on: the last update inside an interval counts."""
    hits = point_join(updates, found, "ts", width, keys).groupBy(*keys, F.col("i_start").alias("start")).agg(F.max_by("value", F.struct("ts", "seq")).alias("__new"), F.lit(True).alias("__hit"))
    hits = hits.withColumn("__hit", F.lit(True))
    return found.join(hits, [*keys, "start"], "left").withColumn("value", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("value"))).drop("__new", "__hit")


def removals(paths: DataFrame, removed: DataFrame) -> DataFrame:
    """Null changes (path, ts, seq, value) for a removed path and all below it. removed: (path, ts, seq)."""
    r = removed.select(F.col("path").alias("__r"), "ts", "seq")
    deep = paths.select("path").distinct().withColumn("__r", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))))
    return deep.join(r, "__r").select("path", "ts", "seq", F.lit(None).cast("string").alias("value"))


def pool_slots(items: DataFrame, keys: Sequence[str], priority: bool = False) -> DataFrame:
    """The slot that each item (keys, id, start, end) takes while it lasts: the slot freed first (or, by priority, the lowest)."""
    from heapq import heappop, heappush

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "id"], kind="stable")
        free: list = []
        busy: list = []
        used, out, freed = 0, [], 0
        for start, end in zip(pdf["start"], pdf["end"], strict=True):
            while busy and busy[0][0] < start:
                _, slot = heappop(busy)
                freed += 1
                heappush(free, (slot if priority else freed, slot))
            if free:
                slot = heappop(free)[1]
            else:
                slot, used = used, used + 1
            heappush(busy, (end, slot))
            out.append(slot)
        return pdf.assign(slot=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", slot long"
    return items.groupBy(*keys).applyInPandas(assign, schema)


def mipmap(found: DataFrame, keys: Sequence[str], width: int, levels: int = 3, factor: int = 16) -> DataFrame:
    """(level, keys, bucket, minimum, maximum, total, n) of changes' values by ever wider buckets; each level folds the one below."""
    base = found.where("value is not null").groupBy(*keys, F.floor(F.col("start") / width).alias("bucket")).agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.sum("value").alias("total"), F.count("*").alias("n"))
    out, level = base.select(F.lit(0).alias("level"), "*"), base
    for k in range(1, levels):
        level = level.groupBy(*keys, F.floor(F.col("bucket") / factor).alias("bucket")).agg(F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.sum("total").alias("total"), F.sum("n").alias("n"))
        out = out.unionByName(level.select(F.lit(k).alias("level"), "*"))
    return out


# ---------------------------------------------------------------- query


def check_time(t: int, start: int, end: int) -> int:
    if not start <= t <= end:
        raise ValueError(f"time {t} is outside [{start}, {end}]")
    return t


def at_time(found: DataFrame, t: int) -> DataFrame:
    """The full state: of each attribute, the interval that contains t."""
    return found.where((F.col("start") <= t) & (F.col("end") >= t))


def at_times(found: DataFrame, times: Sequence[int]) -> DataFrame:
    """Intervals that contain one of some times, each once. The times are literals of the query, so no join is needed."""
    points = F.array(*[F.lit(t).cast("long") for t in sorted(set(times))])
    return found.where(F.exists(points, lambda t: (t >= F.col("start")) & (t <= F.col("end"))))


def in_range(found: DataFrame, low: int, high: int) -> DataFrame:
    return found.where((F.col("start") <= high) & (F.col("end") >= low))


def time_grid(low: int, high: int, step: int) -> list[int]:
    """Times from low by step, the upper bound included; a step of 0 counts as 1."""
    return sorted({*range(low, high + 1, max(1, step)), high})


def sampled(found: DataFrame, low: int, high: int, step: int) -> DataFrame:
    """Intervals that contain a point of the grid low, low + step, ..., or the upper bound. By arithmetic, without a grid table."""
    step = max(1, step)
    first = F.greatest(F.col("start"), F.lit(low))
    point = F.lit(low) + F.ceil((first - low) / F.lit(step)) * step
    hit = (point <= F.least(F.col("end"), F.lit(high))) | F.lit(high).between(F.col("start"), F.col("end"))
    return in_range(found, low, high).where(hit)


def until_non_null(found: DataFrame, low: int, high: int, start: int | None = None) -> DataFrame:
    """The first interval with a value that meets [low, high); low is clamped to the start of the history."""
    low = low if start is None else max(low, start)
    return found.where((F.col("start") < high) & (F.col("end") >= low) & F.col("value").isNotNull()).orderBy("start").limit(1)


def stack_top(stacks: DataFrame, keys: Sequence[str], t: int) -> DataFrame:
    return at_time(stacks, t).groupBy(*keys).agg(F.max("depth").alias("depth"), F.max_by("value", "depth").alias("value"))


def below(paths: DataFrame, parent: Sequence[str], recursive: bool = True, regex: str | None = None) -> DataFrame:
    """Sub-attributes of a path (column path array<string>)."""
    n = len(parent)
    rows = paths.where((F.size("path") > n) & (F.slice("path", 1, n) == F.array(*[F.lit(p) for p in parent]).cast("array<string>")) if n else F.size("path") > 0)
    rows = rows if recursive else rows.where(F.size("path") == n + 1)
    return rows.where(F.element_at("path", -1).rlike(regex)) if regex else rows


def wildcard(paths: DataFrame, pattern: Sequence[str]) -> DataFrame:
    """Paths that match a pattern: '*' is any name, '..' the parent of what precedes."""
    clean: list[str] = []
    for p in pattern:
        if p == "..":
            clean = clean[:-1]
        else:
            clean.append(p)
    cond = F.size("path") == len(clean)
    for k, p in enumerate(clean):
        if p != "*":
            cond = cond & (F.get("path", F.lit(k)) == p)
    return paths.where(cond)


def range_extremes(found: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    return in_range(found, low, high).groupBy(*keys).agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"))


def time_weighted_average(found: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """Mean of the value over [low, high]; null intervals add nothing, the divisor stays high - low; low == high gives the value."""
    rows = in_range(found, low, high)
    if low == high:
        return rows.groupBy(*keys).agg(F.coalesce(F.max("value").cast("double"), F.lit(0.0)).alias("average"))
    span = F.least(F.lit(high), F.col("end") + 1) - F.greatest(F.lit(low), F.col("start"))
    return rows.groupBy(*keys).agg((F.coalesce(F.sum(F.col("value") * span), F.lit(0)) / F.lit(high - low)).alias("average"))


def snapshot(found: DataFrame, t: int) -> DataFrame:
    """The full state as one JSON text an attribute, which `restored` reads back."""
    return at_time(found, t).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def restored(texts: DataFrame, schema) -> DataFrame:
    return texts.select(F.from_json("json", schema).alias("r")).select("r.*")
