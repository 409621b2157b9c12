"""Structured Streaming forms of the operators whose state a watermark bounds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def counts(events: DataFrame, time: str, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Events by type in tumbling or sliding windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, time: str, late: str, gap: str, keys: Sequence[str]) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def matches(causes: DataFrame, effects: DataFrame, keys: Sequence[str], time: str, late: str, within: str) -> DataFrame:
    """Cause/effect pairs by a stream-stream join; the watermark drops what can't match any more."""
    a = causes.withWatermark(time, late).select(*[F.col(k).alias(f"c_{k}") for k in keys], F.col(time).alias("src"))
    b = effects.withWatermark(time, late).select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col(time).alias("dst"))
    same = F.expr(" AND ".join(f"c_{k} = e_{k}" for k in keys) + f" AND dst >= src AND dst <= src + interval {within}")
    return a.join(b, same)


def pairs(events: DataFrame, key: str, begin: str, end: str, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Begin/end segments of a key, the open begin being the state; it is forgotten once the watermark is idle_ms past it.

    The timeout is one of event time: one of processing time asks for another batch for ever, so that a run over what is
    available would not end, and its results would hang on the clock."""
    kind = events.schema[key].dataType.simpleString()
    events = events.withColumn("__at", F.timestamp_micros("micros")).withWatermark("__at", late)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(parts)).sort_values(["micros", "rank"])
        for ts, name in rows[["micros", "type"]].itertuples(index=False):
            if name == begin:
                opened = ts
            elif name == end and opened is not None:
                out.append((k[0], opened, ts))
                opened = None
        if opened is None:
            if state.exists:
                state.remove()
        else:
            state.update((int(opened),))
            state.setTimeoutTimestamp(int(opened) // 1000 + idle_ms)
        yield pd.DataFrame(out, columns=[key, "start", "end"])

    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, start long, end long", "opened long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str, root: str) -> DataFrame:
    """Runs a stream over what is available, by batches written as Parquet under `root`, and returns the rows.

    A batch that is written again after a failure replaces itself; a complete one replaces all before it."""
    path = f"{root}/rows"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
