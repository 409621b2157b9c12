"""Call stacks, call graphs, flame graphs.

Calls are rows (group..., id, parent, depth, name, path, start, end, self) made from entry and exit events."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .matching import clipped
from .segments import statistics
from .states import in_range, stack_intervals

CALL = "id long, parent long, depth int, name string, path array<string>, start long, end long, self_time long"


def calls(events: DataFrame, keys: Sequence[str], end: int) -> DataFrame:
    """Calls of each stack from (keys, ts, rank, name, entry): a sequential walk of one thread's events.

    An exit of an empty stack is ignored; open calls end with the trace. A group is one thread; its state is the stack,
    its output its calls. Long threads can be cut where a stack is empty (key column of the caller)."""
    names = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, stack = [], []
        pdf = pdf.sort_values(["ts", "rank"], kind="stable")

        def close(ts):
            own = stack.pop()
            took = ts - own["start"]
            if stack:
                stack[-1]["inner"] += took
            out.append((*key, own["id"], stack[-1]["id"] if stack else None, len(stack) + 1, own["name"], [x["name"] for x in stack] + [own["name"]], own["start"], ts, took - own["inner"]))

        for ts, rank, name, entry in pdf[["ts", "rank", "name", "entry"]].itertuples(index=False):
            if entry:
                stack.append({"id": rank, "name": name, "start": ts, "inner": 0})
            elif stack:
                close(ts)
        while stack:
            close(end)
        return pd.DataFrame(out, columns=[*keys, "id", "parent", "depth", "name", "path", "start", "end", "self_time"]).astype({"parent": "Int64"})

    return events.groupBy(*keys).applyInPandas(walk, f"{names}, {CALL}")


def call_intervals(events: DataFrame, keys: Sequence[str], end: int) -> DataFrame:
    """Only (keys, depth, start, end, value): windows suffice."""
    return stack_intervals(events, keys, F.col("entry"), "name", end, ("ts", "rank"))


def self_times(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """self_time from ids alone: the duration less that of the direct children."""
    inner = found.where("parent is not null").groupBy(*keys, F.col("parent").alias("id")).agg(F.sum(F.col("end") - F.col("start")).alias("__inner"))
    return found.drop("self_time").join(inner, [*keys, "id"], "left").withColumn("self_time", F.col("end") - F.col("start") - F.coalesce("__inner", F.lit(0))).drop("__inner")


def call_graph(found: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """By group and symbol path: calls, duration, self time and their statistics."""
    d = F.col("end") - F.col("start")
    n = F.count("*")
    return found.groupBy(*group, "path").agg(n.alias("n"), F.sum(d).alias("duration"), F.sum("self_time").alias("self_time"), F.min(d).alias("minimum"), F.max(d).alias("maximum"), F.avg(d).alias("mean"), F.when(n > 2, F.stddev_samp(d)).alias("deviation"))


def call_graph_in_range(found: DataFrame, keys: Sequence[str], low: int, high: int, group: Sequence[str] = ()) -> DataFrame:
    """The call graph of calls cut to [low, high]."""
    cut = in_range(found, low, high).withColumn("start", F.greatest("start", F.lit(low))).withColumn("end", F.least("end", F.lit(high)))
    return call_graph(self_times(cut, keys), group)


def function_statistics(found: DataFrame) -> DataFrame:
    return statistics(found, ["name"], F.col("end") - F.col("start"))


def kernel_statuses(found: DataFrame, statuses: DataFrame, width: int) -> DataFrame:
    """Time of each thread status below each symbol path: overlaps of calls and status intervals of a thread."""
    both = clipped(found, statuses, width, ["tid"])
    return both.groupBy("path", F.col("b_value").alias("status")).agg(F.sum(F.col("o_end") - F.col("o_start")).alias("time"))


def sampled_graph(samples: DataFrame, stack: str = "stack", group: Sequence[str] = ()) -> DataFrame:
    """Stack samples (outermost first) as a tree: the weight of a path is the number of samples in it."""
    rows = samples.withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(stack)), lambda k: F.slice(stack, 1, k)))).where(F.size(stack) > 0)
    return rows.groupBy(*group, "path").agg(F.count("*").alias("weight"))


def flame(graph: DataFrame, weight: str = "duration") -> DataFrame:
    """Boxes (depth, x, width): a node starts with its parent, after its heavier siblings.

    x is the sum, over a node's prefixes, of the heavier siblings' weights at each: a window among siblings, then a join
    of each node with its prefixes."""
    rows = graph.select("path", F.col(weight).alias("width"), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("__up"))
    w = Window.partitionBy("__up").orderBy(F.desc("width"), F.element_at("path", -1)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select("path", "width", F.coalesce(F.sum("width").over(w), F.lit(0)).alias("__offset"))
    deep = offsets.select("path", "width", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("__p"))
    return deep.join(offsets.select(F.col("path").alias("__p"), "__offset"), "__p").groupBy("path", "width").agg(F.sum("__offset").alias("x")).withColumn("depth", F.size("path"))


def at_depth(found: DataFrame, depth: int, low: int, high: int) -> DataFrame:
    return in_range(found, low, high).where(F.col("depth") == depth)


def next_in_parent(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sibling that starts after each call inside the same parent."""
    w = Window.partitionBy(*keys, "parent").orderBy("start", "id")
    return found.withColumn("next", F.lead("id").over(w))


def max_depth(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.max("depth").alias("depth"))
