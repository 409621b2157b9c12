"""Document fingerprints: invertible Bloom lookup tables over paragraph digests (operator 1).

A text is the multiset of its paragraphs (pieces between line feeds); the k-th copy of a paragraph has a
digest of its own. Each digest enters one cell of each of three parts of the table: a count, the digests'
XOR and their checks' XOR. Two versions' tables subtract cell by cell, which leaves the digests that differ;
peeling cells of one digest recovers them. Where peeling sticks, both tables are built again with twice the
cells, until it ends. The likeness is Jaccard's, from the recovered differences and the two sizes.

The fingerprint of a text is its table of CELLS cells, in hexadecimal: equal texts have equal fingerprints.

Nulls: a null text is empty (no paragraphs; two empty texts are alike, 1.0). Rows are taken in ascending
(doc_id, text) order, so repeated rows follow each other; null doc_ids come first. A sole row is its own
next. An empty table gives no rows. Further columns are ignored."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import Stage, map_arrow, plain, table

CELLS = 9
PARTS = 3
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digests(text: str) -> list[int]:
    """64-bit digests of the paragraphs, those of copies told apart."""
    seen: dict[str, int] = {}
    out = []
    for part in text.split("\n") if text else ():
        k = seen[part] = seen.get(part, -1) + 1
        out.append(xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), seed=k))
    return out


def _places(key: int, cells: int) -> tuple[int, int, int]:
    part = cells // PARTS
    x = (key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return (x >> 40) % part, part + ((x >> 20) & 0xFFFFF) % part, 2 * part + (x & 0xFFFFF) % part


def _check(key: int) -> int:
    return ((key ^ (key >> 31)) * 0xD6E8FEB86659FD93 >> 32) & 0xFFFFFFFF


def sketch(keys: list[int], cells: int = CELLS) -> list[list[int]]:
    """Counts, key XORs and check XORs of a table with the keys."""
    count, total, check = [0] * cells, [0] * cells, [0] * cells
    for key in keys:
        c = _check(key)
        for at in _places(key, cells):
            count[at] += 1
            total[at] ^= key
            check[at] ^= c
    return [count, total, check]


def peel(x: list[list[int]], y: list[list[int]]) -> tuple[set[int], set[int]] | None:
    """Digests that x alone and y alone hold, or None where the difference does not fit the tables."""
    cells = len(x[0])
    count = [a - b for a, b in zip(x[0], y[0], strict=True)]
    total = [a ^ b for a, b in zip(x[1], y[1], strict=True)]
    check = [a ^ b for a, b in zip(x[2], y[2], strict=True)]
    sides: tuple[set[int], set[int]] = (set(), set())
    queue = list(range(cells))
    while queue:
        at = queue.pop()
        if (sign := count[at]) not in (1, -1) or _check(key := total[at]) != check[at] or at not in _places(key, cells):
            continue
        sides[sign < 0].add(key)
        c = _check(key)
        for p in _places(key, cells):
            count[p] -= sign
            total[p] ^= key
            check[p] ^= c
            queue.append(p)
    return None if any(count) or any(total) or any(check) else sides


class Version:
    """A text's digests and its tables, each built once."""

    def __init__(self, text: str):
        self.keys = digests(text)
        self.tables: dict[int, list[list[int]]] = {}

    def table(self, cells: int) -> list[list[int]]:
        if cells not in self.tables:
            self.tables[cells] = sketch(self.keys, cells)
        return self.tables[cells]

    def fingerprint(self) -> str:
        count, total, check = self.table(CELLS)
        return struct.pack(f">{CELLS}I{CELLS}Q{CELLS}I", *count, *total, *check).hex()


def difference(x: Version, y: Version) -> tuple[set[int], set[int]]:
    """Digests of x alone and of y alone, by peeling ever larger tables."""
    cells = CELLS
    while (found := peel(x.table(cells), y.table(cells))) is None:
        cells *= 2
        if cells > 64 * (len(x.keys) + len(y.keys) + CELLS):  # no table of this size fails but by equal digests
            return set(x.keys) - set(y.keys), set(y.keys) - set(x.keys)
    return found


def likeness(x: Version, y: Version) -> float:
    gone, new = difference(x, y)
    apart, size = len(gone) + len(new), len(x.keys) + len(y.keys)
    return 1.0 if not size else (size - apart) / (size + apart)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc, text: str, own: Version, following: str, after: Version) -> tuple:
    other = edited(text, following)
    changed = Version(other)
    return doc, len(text), hashlib.sha256(other.encode()).hexdigest(), own.fingerprint(), changed.fingerprint(), likeness(own, changed), likeness(own, after)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        texts = plain(batch.column(1))
        for doc, text in zip(batch.column(0), texts, strict=True):
            yield doc.as_py(), text.as_py()


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, its edited text's, and their likeness and the next document's."""
    spark = docs.sparkSession
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def follow(batches):
        """Rows whose next row is in the same partition; of each partition, the first and the last text besides."""
        part, out, before, head = TaskContext.get().partitionId(), [], None, None
        for doc, text in _rows(batches):
            own = Version(text)
            if before is None:
                head = (doc, text)
            else:
                out.append((*_row(before[0], before[1], before[2], text, own), None, None, None))
            before = (doc, text, own)
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        if before is not None:
            out.append((None,) * 7 + (part, True, head[1]))
            out.append((before[0],) + (None,) * 6 + (part, False, before[1]))
        if out:
            yield _batch(out)

    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*names, "part", "head", "text"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    # One run deals the rows, so that the partitions' ends fit; its result is written, for the ends meet in a second step.
    found = Stage(spark).write(map_arrow(ordered, follow, SCHEMA + ", part int, head boolean, text string"), "follow")
    parts = sorted(r.part for r in found.where("head").select("part").collect())  # as many as partitions
    after = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    near = spark.createDataFrame(pd.DataFrame({"part": list(after), "after": list(after.values())}, dtype="int32"), "part int, after int") if parts else spark.createDataFrame([], "part int, after int")
    heads = found.where("head").select(F.col("part").alias("after"), F.col("text").alias("following"))
    ends = found.where("not head").select("doc_id", "text", "part").join(near, "part").join(heads, "after").select("doc_id", "text", "following")

    def close(batches):
        for batch in batches:
            rows = []
            for doc, text, following in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows.append(_row(doc, text, Version(text), following, Version(following)))
            if rows:
                yield _batch([(*r, None, None, None) for r in rows]).select(names)

    return found.where("part is null").select(names).unionByName(map_arrow(ends, close, SCHEMA))


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
