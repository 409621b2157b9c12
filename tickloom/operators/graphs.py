"""Execution graphs and critical paths.

Vertices are (worker, ts); horizontal edges hold a worker's state between two of its vertices, vertical edges join
workers at interactions: (src_worker, src_ts, dst_worker, dst_ts, state)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpointed

# Edge states by what they do to a path.
PASS = ("RUNNING", "INTERRUPTED", "PREEMPTED", "TIMER", "USER_INPUT", "BLOCK_DEVICE", "IPI", "DEFAULT", "EPS", "UNKNOWN", "PASS")
BLOCK = ("BLOCKED", "NETWORK", "BLOCK")


def execution_graph(switches: DataFrame, wakeups: DataFrame) -> DataFrame:
    """Edges from switches (ts, rank, cpu, prev_tid, prev_state, next_tid) and wakeups (ts, rank, waker, target).

    A thread's vertices are its switches and wakeups in order; the state of an edge follows from what opened it."""
    out = switches.select(F.col("prev_tid").alias("worker"), "ts", "rank", F.when(F.col("prev_state") == 0, "PREEMPTED").otherwise("BLOCKED").alias("state"))
    into = switches.select(F.col("next_tid").alias("worker"), "ts", "rank", F.lit("RUNNING").alias("state"))
    woken = wakeups.select(F.col("target").alias("worker"), "ts", "rank", F.lit("PREEMPTED").alias("state"))
    waking = wakeups.select(F.col("waker").alias("worker"), "ts", "rank", F.lit("RUNNING").alias("state"))
    points = out.unionByName(into).unionByName(woken).unionByName(waking).where("worker <> 0")
    w = Window.partitionBy("worker").orderBy("ts", "rank")
    across = points.withColumn("dst_ts", F.lead("ts").over(w)).where("dst_ts is not null")
    across = across.select(F.col("worker").alias("src_worker"), F.col("ts").alias("src_ts"), F.col("worker").alias("dst_worker"), "dst_ts", "state")
    down = wakeups.where("waker <> 0").select(F.col("waker").alias("src_worker"), F.col("ts").alias("src_ts"), F.col("target").alias("dst_worker"), F.col("ts").alias("dst_ts"), F.lit("DEFAULT").alias("state"))
    return across.unionByName(down)


def horizontal(edges: DataFrame) -> DataFrame:
    return edges.where("src_worker = dst_worker")


def vertical(edges: DataFrame) -> DataFrame:
    return edges.where("src_worker <> dst_worker")


def ends(edges: DataFrame) -> DataFrame:
    """First and last vertex of each worker."""
    v = edges.select(F.col("src_worker").alias("worker"), F.col("src_ts").alias("ts")).unionByName(edges.select(F.col("dst_worker").alias("worker"), F.col("dst_ts").alias("ts")))
    return v.groupBy("worker").agg(F.min("ts").alias("head"), F.max("ts").alias("tail"), F.count_distinct("ts").alias("n"))


def worker_times(edges: DataFrame) -> DataFrame:
    """Time of each worker's horizontal edges, and its share of all."""
    rows = horizontal(edges).groupBy(F.col("src_worker").alias("worker")).agg(F.sum(F.col("dst_ts") - F.col("src_ts")).alias("time"))
    total = rows.agg(F.sum("time").alias("__t"))  # one row
    return rows.crossJoin(F.broadcast(total)).select("worker", "time", (100.0 * F.col("time") / F.col("__t")).alias("percent"))


def reachable(edges: DataFrame, workers: Sequence[int]) -> DataFrame:
    """Workers that are joined to some by vertical edges, in either direction: a frontier join a round, until none is new."""
    spark = edges.sparkSession
    links = vertical(edges).select(F.col("src_worker").alias("a"), F.col("dst_worker").alias("b"))
    links = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found = frontier = spark.createDataFrame([(int(x),) for x in set(workers)], "worker long")
    while True:
        new = links.join(frontier.select(F.col("worker").alias("a")), "a").select(F.col("b").alias("worker")).distinct()
        frontier = checkpointed(new.join(found, "worker", "left_anti"))
        if frontier.isEmpty():
            return found
        found = checkpointed(found.unionByName(frontier))


def critical_path(edges: DataFrame, worker: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """The chain of edges that bounds a worker's time: passing edges stand for themselves; a blocked edge is replaced by
    what its waker did meanwhile, back to the start of the block, and so on.

    Edges are first cut to the workers that the worker is joined with; the walk over those is sequential, in one task."""
    some = reachable(edges, [worker])
    cut = edges.join(some.select(F.col("worker").alias("src_worker")), "src_worker", "left_semi")

    def walk(_key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in pdf[["src_worker", "src_ts", "dst_worker", "dst_ts", "state"]].sort_values(["src_ts", "dst_ts"]).itertuples(index=False)]
        into: dict = {}
        wake: dict = {}
        for e in rows:
            if e[0] != e[2]:
                wake[e[2], e[3]] = e
            elif e[1] < e[3]:  # a wakeup of oneself takes no time
                into[e[2], e[3]] = e
        own = [e for e in rows if e[0] == worker == e[2] and (start is None or e[3] > start) and (end is None or e[1] < end)]
        out: list[tuple] = []

        def resolve_block(e):
            """Edges of the path that ends where the block e ends, latest first. What is left of outer blocks is on a stack."""
            path, seen, todo = [], set(), []

            def enter(e, low):
                w = wake[e[2], e[3]]
                seen.add(e)
                path.append(w)
                todo.append((w[0], w[1], low))

            enter(e, e[1])
            while todo:
                target, at, low = todo.pop()
                if at > low and (w := wake.get((target, at))):
                    path.append(w)
                    target, at = w[0], w[1]
                if at <= low:
                    continue
                e = into.get((target, at))
                if e is None:
                    path.append((target, low, target, at, "UNKNOWN"))
                    continue
                todo.append((target, e[1], low))
                if e[4] in BLOCK and (e[2], e[3]) in wake and e not in seen:  # workers can wake each other at one time
                    enter(e, max(low, e[1]))
                else:
                    path.append((target, max(low, e[1]), target, at, e[4]))
            return path

        for e in own:
            if e[4] in BLOCK and (e[2], e[3]) in wake:
                out += reversed(resolve_block(e))
            else:
                out.append(e)
        return pd.DataFrame([(i, *e) for i, e in enumerate(out)], columns=["step", "src_worker", "src_ts", "dst_worker", "dst_ts", "state"])

    return cut.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(walk, "step long, src_worker long, src_ts long, dst_worker long, dst_ts long, state string")
