"""Shared plumbing: shared-folder stages, Arrow batches, vectorised words and hashes, components."""

from __future__ import annotations

import contextlib
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir, ship

#: Text bytes that one vectorised step handles; several arrays of eight times this size live at once.
SLICE_BYTES = 1 << 20
#: Seconds of writing a table after which its shuffle files are worth a collection of garbage.
LONG_S = 3
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


# ---------------------------------------------------------------- tables and stages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stage:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what precedes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tickloom-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, began = f"{self.root}/{name}", time.monotonic()
        df.write.mode("overwrite").parquet(path)
        if time.monotonic() - began > LONG_S:
            release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that have ended; listeners hold a plan until they have heard of its end."""
    for _ in range(2):  # what the first round frees holds more
        gc.collect()
        with contextlib.suppress(Py4JError):  # a busy listener only delays the cleaning
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5_000)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that long texts don't meet by the thousand in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


# ---------------------------------------------------------------- Arrow texts as bytes


def plain(column: pa.Array) -> pa.Array:
    """Nulls become empty texts."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    return pc.fill_null(column, "") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column, and where each text starts (one more entry than texts)."""
    column = plain(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about `limit` text bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if n > len(_POWERS[0]):
        n = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the polynomial of data[i:j] times BASE ** i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_table(word: Callable[[int], bool]) -> np.ndarray:
    """A-Z in lower case; bytes outside words become 0."""
    low = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([b if word(b) else 0 for b in low], np.uint8)


#: Words of anything but white space; words of digits, a-z and all beyond ASCII.
SPACED = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
ALPHANUMERIC = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Kept apart from 0, which marks what lies outside words.
SPACED[0] = 1


class Words:
    """The words of a column of texts: byte spans, hashes, and where each text's words start."""

    def __init__(self, column: pa.Array, kinds: np.ndarray):
        raw, self.at = text_bytes(column)
        self.low = kinds[raw]
        n = len(raw)
        inside = self.low != 0
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.at[(self.at > 0) & (self.at < n)]
        before[edges], after[edges - 1] = False, False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.hash = spans_hash(prefix_hash(self.low), self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; only those that end in the same text mean anything."""
        out = np.zeros(max(0, len(self) - n + 1), np.uint64)
        for k in range(n):
            out = out * BASE + self.hash[k : k + len(out)]
        return mix(out + np.uint64(n))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, one space apart."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions such that each `window` neighbours hold one with their least hash; of ties, as few as do.

    Equal windows yield an equal least hash wherever they stand."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    least = sliding(hashes, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), window, np.maximum)
    found = np.flatnonzero(hashes == most)
    value = hashes[found]
    if not (value[1:] == value[:-1]).any():
        return found
    keep, last = [], {}
    for i, (p, v) in enumerate(zip(found.tolist(), value.tolist(), strict=True)):
        later = found[i + 1] if i + 1 < len(found) and value[i + 1] == v else None
        if later is not None and v in last and later - last[v] <= window and p - last[v] < window:
            continue
        keep.append(p)
        last = {v: p}
    return np.array(keep, np.int64)


def sliding(x: np.ndarray, window: int, f) -> np.ndarray:
    span = 1
    while span * 2 <= window:
        x = f(x[: len(x) - span], x[span:])
        span *= 2
    rest = window - span
    return f(x[: len(x) - rest], x[rest:]) if rest else x


# ---------------------------------------------------------------- connected components


#: Up to so many links (16 bytes each) are joined by one task; more by steps over the whole table.
FEW_LINKS = 1 << 20


def _united(batches):
    """(id, component) of all ends of the links, by union and find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    for k in range(0, len(ids), 1 << 16):
        part = ids[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["id", "component"])


def components(spark: SparkSession, links: DataFrame, keep: Stage, name: str, few: int = FEW_LINKS) -> DataFrame:
    """(id, component) of all ends of links (a, b): component is the least id that links reach.

    Up to `few` links one task joins them; of more, large-star and small-star steps alternate until no edge changes. Nothing is
    collected but counts."""
    edges = keep.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    if edges.count() <= few:
        return keep.write(map_arrow(edges.coalesce(1), _united, "id long, component long"), f"{name}-all")
    step, before = 0, None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("m"), "a", "b")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        step += 1
        after = keep.write(small, f"{name}-{step}")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).cast("string")).first()
        keep.drop(f"{name}-{step - 1}")
        edges = after
        if now == before:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct()
        before = now
