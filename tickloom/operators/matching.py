"""Correlation of events: cause and effect by key, latencies, ledgers, host models."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import as_of, overlap_join


def match(events: DataFrame, keys: Sequence[str], cause: Column, effect: Column, order: Sequence[str] = ("ts", "rank")) -> DataFrame:
    """(keys, src_ts, dst_ts): causes and effects of a key are paired by occurrence, the first unmatched first."""
    rows = events.where(cause | effect).withColumn("__cause", cause)
    n = F.row_number().over(Window.partitionBy(*keys, "__cause").orderBy(*order))
    rows = rows.withColumn("n", n)
    a = rows.where("__cause").select(*keys, "n", F.col(order[0]).alias("src_ts"), F.col(order[1]).alias("src_rank"))
    b = rows.where("not __cause").select(*keys, "n", F.col(order[0]).alias("dst_ts"), F.col(order[1]).alias("dst_rank"))
    return a.join(b, [*keys, "n"])


def match_hosts(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sequential matching across hosts, as events (keys, host, ts, rank, direction) pass: an effect takes the first waiting
    cause of any host, a cause the first waiting effect of another host; the first unmatched of a host and key waits.

    A group is one key's events, so its size is that of one exchange."""
    names = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        waiting: dict[str, dict] = {"CAUSE": {}, "EFFECT": {}}
        out = []
        for host, ts, direction in pdf.sort_values(["ts", "rank"])[["host", "ts", "direction"]].itertuples(index=False):
            other = waiting["EFFECT" if direction == "CAUSE" else "CAUSE"]
            found = next((h for h in other if direction == "EFFECT" or h != host), None)
            if found is None:
                waiting[direction].setdefault(host, ts)
                continue
            t = other.pop(found)
            out.append((*key, host, ts, found, t) if direction == "CAUSE" else (*key, found, t, host, ts))
        return pd.DataFrame(out, columns=[*keys, "src_host", "src_ts", "dst_host", "dst_ts"])

    return events.groupBy(*keys).applyInPandas(walk, f"{names}, src_host string, src_ts long, dst_host string, dst_ts long")


def latencies(pairs: DataFrame) -> DataFrame:
    """Pairs as segments; reverse where the source is later."""
    return pairs.withColumn("reverse", F.col("src_ts") > F.col("dst_ts")).withColumn("duration", F.abs(F.col("dst_ts") - F.col("src_ts")))


def unmatched(events: DataFrame, keys: Sequence[str], pick: Column, against: Column) -> DataFrame:
    """Picked events without a counterpart of the same key."""
    return events.where(pick).join(events.where(against).select(*keys).distinct(), list(keys), "left_anti")


def ledger(events: DataFrame, keys: Sequence[str], amount: Column, order: Sequence[str] = ("ts", "rank")) -> DataFrame:
    """The running total of signed amounts by key, and the least total so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("total", F.sum(amount).over(w)).withColumn("lowest", F.min("total").over(w))


def leaks(allocations: DataFrame, frees: DataFrame, pointer: str = "ptr") -> DataFrame:
    """Allocations that no later free of the pointer ends before the next allocation: zero-length segments."""
    a = allocations.select(pointer, "ts", "tid", "size", F.lit(True).alias("__alloc"))
    f = frees.select(pointer, "ts", F.lit(None).cast("long").alias("tid"), F.lit(None).cast("long").alias("size"), F.lit(False).alias("__alloc"))
    w = Window.partitionBy(pointer).orderBy("ts", "__alloc")
    rows = a.unionByName(f).withColumn("__next", F.lead("__alloc").over(w))
    return rows.where(F.col("__alloc") & F.coalesce(F.col("__next"), F.lit(True))).select(pointer, "tid", "size", F.col("ts").alias("start"), F.col("ts").alias("end"))


def resolve_symbols(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbol at or below each address (pid, ts, address); of sized symbols only where the address is inside."""
    out = as_of(calls, symbols.select("pid", "base", "size", "name"), ["pid"], "address", "base", ["base", "size", "name"])
    inside = F.col("size").isNull() | (F.col("address") < F.col("base") + F.col("size"))
    return out.withColumn("symbol", F.when(inside, F.col("name"))).drop("base", "size", "name")


def clipped(a: DataFrame, b: DataFrame, width: int, on: Sequence[str] = ()) -> DataFrame:
    """Overlaps of two interval tables, cut to what they share."""
    both = overlap_join(a, b, width, on)
    return both.withColumn("o_start", F.greatest("start", "b_start")).withColumn("o_end", F.least("end", "b_end"))


def first_known(base: DataFrame, providers: Sequence[DataFrame], on: Sequence[str], value: str) -> DataFrame:
    """The first provider's value that is known."""
    out = base
    for k, p in enumerate(providers):
        out = out.join(p.select(*on, F.col(value).alias(f"__{k}")), list(on), "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"__{k}") for k in range(len(providers))])).drop(*[f"__{k}" for k in range(len(providers))])
