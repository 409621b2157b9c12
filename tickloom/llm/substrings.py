"""Exact substring dedup by merged Burrows-Wheeler transforms (operator 4).

A byte goes if a LENGTH-byte string that covers it also starts earlier (lesser doc_id, or the same document
and an earlier start).

1. Anchors: each LENGTH-byte string has the least hash of its GRAM-byte grams for its anchor, so equal strings have equal
   anchors. Neighbouring strings of one anchor are a stretch; stretches whose anchor no other stretch has, and which hold
   it once, drop out, and with them all text that repeats nowhere.
2. The bytes of each other stretch are a segment; each start is in one. Segments meet by their anchor. Under a frequent anchor they
   meet by the bytes that follow it, or else by those that precede it (a string goes at least half of LENGTH - GRAM bytes to
   one side), so a frequent line does not gather all texts that hold it. Strings that hold a frequent anchor more than once meet by
   the least hash of their longer grams.
3. Equal segments of one anchor: all but the first go as a whole. They are found as rows pass in order, and
   under frequent anchors first within 16 salts each, so no task meets a whole group of copies.
   (Of a key whose distinct segments exceed LARGE_BYTES every string is hashed and grouped by itself instead.)
4. Of the distinct segments of an anchor, only what agrees with another on both sides of the anchor goes on, where that is LENGTH
   bytes long; equal ones fold again. The rest form shards with a Burrows-Wheeler transform each. Shards are merged by refining
   their interleave: after h rounds it is sorted by the first h bytes, each round moving every suffix to its
   predecessor's bucket by the transforms alone; blocks of equal h-prefixes come with it. After LENGTH
   rounds the blocks are the repeated intervals. No suffix is sorted again.
5. In each interval, every occurrence but the earliest starts a removed string.

Nulls: a null text is empty. A row with a null doc_id is returned whole and takes no part. Rows that repeat a
doc_id are judged each by its own text: a string goes if it starts in a row of lesser doc_id, or in one of the same at an earlier
start. Empty tables give no rows;
further columns are ignored."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import Stage, map_arrow, mix, plain, prefix_hash, slices, sliding, spans_hash, table, text_bytes

LENGTH, GRAM = 100, 32
#: An anchor with more occurrences is frequent.
FREQUENT = 256
#: Bytes of segments in one merge (keys whose segments are larger make larger ones), and in each of its shards: small enough for a core's cache.
MERGE_BYTES, SHARD_BYTES = 1 << 15, 1 << 13
#: Distinct segments of one key that a task holds; of larger keys every string is hashed and grouped instead.
LARGE_BYTES = 2 << 20
SALTS = 16
_SEGMENT = "key long, doc_id long, start long, row long, segment binary, inside int, frequent boolean"


def stretches(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, row, low, high, twice): the strings that start in [low, high] have the anchor; twice: one starts with it and another follows."""

    def find(batches):
        for batch in batches:
            for part in slices(batch):
                raw, ends = text_bytes(part.column(2))
                if len(raw) < LENGTH:
                    continue
                start = np.arange(len(raw) - GRAM + 1)
                hashes = spans_hash(prefix_hash(raw), start, start + GRAM)
                least = sliding(hashes, LENGTH - GRAM + 1, np.minimum)
                docs_, rows, at = part.column(0).to_numpy(), part.column(1).to_numpy(), ends[:-1]
                sizes = np.maximum(np.diff(ends) - LENGTH + 1, 0)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                own = least[at[owner] + place]
                new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])][: len(own)])
                last = np.r_[new[1:], len(own)] - 1
                if len(new):
                    begins = hashes[at[owner] + place] == own
                    begins[last] = False
                    twice = np.logical_or.reduceat(begins, new)
                    columns = own[new].view(np.int64), docs_[owner[new]], rows[owner[new]], place[new].astype(np.int32), place[last].astype(np.int32), twice
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "doc_id", "row", "low", "high", "twice"])

    return map_arrow(docs.select("doc_id", "row", "text"), find, "anchor long, doc_id long, row long, low int, high int, twice boolean")


def _parts(sums: np.ndarray, a: int, low: int, high: int, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, last, at, gram): a stretch of a text that begins at a, by the one place `at` at which strings hold the anchor, or else (-1) by their least longer gram."""
    if len(at) == 1:
        return [(low, high, int(at[0]), 0)]
    long = GRAM + (LENGTH - GRAM) // 2
    start = np.arange(low, high + 1)
    before, after = np.searchsorted(at, start), np.searchsorted(at, start + LENGTH - GRAM, "right")
    only = np.where(after - before == 1, at[before], -1)
    grams = a + np.arange(low, high + LENGTH - long + 1)
    gram = np.where(only < 0, sliding(spans_hash(sums, grams, grams + long), LENGTH - long + 1, np.minimum), np.uint64(0))
    new = np.flatnonzero(np.r_[True, (only[1:] != only[:-1]) | (gram[1:] != gram[:-1])])
    return list(zip(start[new].tolist(), (np.r_[start[new[1:]], high + 1] - 1).tolist(), only[new].tolist(), gram[new].tolist(), strict=True))


def segments(docs: DataFrame, places: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The bytes of each stretch, by what brings equal strings together; inside is the anchor's place, -1 where it has several.

    What strings of a frequent anchor meet by depends on their own bytes only, not on their stretch."""
    half = (LENGTH - GRAM) // 2

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                raw, ends = text_bytes(part.column(2))
                sums = prefix_hash(raw)
                start = np.arange(max(0, len(raw) - GRAM + 1))
                hashes = spans_hash(sums, start, start + GRAM)
                rows: list[tuple] = []
                for doc, row, a, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ends.tolist(), part.column(3), strict=False):
                    lows, highs, anchors, counts = (own.values.field(k).to_numpy() for k in range(4))
                    for low, high, anchor, n in zip(lows.tolist(), highs.tolist(), anchors.tolist(), counts.tolist()):
                        found = low + np.flatnonzero(hashes[a + low : a + high + LENGTH - GRAM + 1].view(np.int64) == anchor)
                        if n <= frequent:
                            rows.append((anchor, doc, low, row, raw[a + low : a + high + LENGTH].tobytes(), int(found[0]) - low if len(found) == 1 else -1, False))
                            continue
                        for x, y, at, gram in _parts(sums, a, low, high, found):
                            if at < 0:
                                key = int(mix(np.array([gram], np.uint64) + np.uint64(3)).view(np.int64)[0])
                                rows.append((key, doc, x, row, raw[a + x : a + y + LENGTH].tobytes(), -1, True))
                                continue
                            # Strings that go `half` bytes beyond the anchor to the right, and the others, which go as far to the left.
                            for side, u, v, first, last in ((1, at, at + GRAM + half, max(x, at - half), y), (2, at - half, at + GRAM, x, min(y, at - half - 1))):
                                if first <= last:
                                    key = int(mix(spans_hash(sums, np.array([a + u]), np.array([a + v])) + np.uint64(side)).view(np.int64)[0])
                                    rows.append((key, doc, first, row, raw[a + first : a + last + LENGTH].tobytes(), at - first, True))
                    if len(rows) > 4000:
                        yield _batches(rows, _SEGMENT)
                        rows = []
                if rows:
                    yield _batches(rows, _SEGMENT)

    return map_arrow(docs.join(places, ["doc_id", "row"]).select("doc_id", "row", "text", "places"), cut, _SEGMENT)


# ---------------------------------------------------------------- transforms


class Shard:
    """The Burrows-Wheeler transform of some strings, each with an end mark of its own.

    byte[i] is the byte (plus 1) before the i-th suffix, 0 before a string's first; step[i] is the place of
    the suffix that starts with it; origin[i] says where the suffix stands in the joined strings."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) + 1 for s in strings])
        n, m = int(sizes.sum()), len(strings)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        last = first + sizes - 1
        self.bytes = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        rank = self.bytes + m
        rank[last] = np.arange(m)
        span = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1 if span < n else 0
            key = rank * (rank.max() + 2) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            rank[order] = new
            if new[-1] == n - 1:
                break
            span *= 2
        before = np.arange(n) - 1
        before[first] = last
        marks = np.zeros(n, bool)
        marks[first] = True
        self.origin = order
        self.step = rank[before[order]]
        self.byte = np.where(marks[order], 0, self.bytes[before[order]]).astype(np.uint8)
        self.ends = rank[last]
        self.size = n


def repeated(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in the joined shards, sorted by their first `depth` bytes, and the block of equals of each."""
    base = np.concatenate([[0], np.cumsum([s.size for s in shards])]).astype(np.int32)
    byte = np.concatenate([s.byte for s in shards])
    step = np.concatenate([s.step + b for s, b in zip(shards, base)]).astype(np.int32)
    ends = np.concatenate([s.ends + b for s, b in zip(shards, base)]).astype(np.int32)
    origin = np.concatenate([s.origin + b for s, b in zip(shards, base)])
    m, n = len(ends), len(byte)
    place, block = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    fresh = np.empty(n, bool)
    for _ in range(depth):
        before = byte[place]
        order = np.argsort(before, kind="stable")
        place = step[place[order]]
        place[:m] = ends  # the end marks differ from each other and keep their order
        block = block[order]
        np.not_equal(block[1:], block[:-1], out=fresh[1:])
        heads = np.cumsum(np.bincount(before, minlength=1))  # where the next byte's suffixes begin
        fresh[heads[heads < n]] = True
        fresh[:m] = True
        block = np.cumsum(fresh, dtype=np.int32)
        if block[-1] == n:
            break
    return origin[place], block


def later_starts(found: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(doc, row, start) of the strings in segments (doc, start, row, bytes) that also start earlier in one of them."""
    shards, group, size, where = [], [], 0, []
    for doc, start, row, segment in found:
        group.append(segment)
        where.append((doc, start, row, len(segment) + 1))
        size += len(segment) + 1
        if size >= SHARD_BYTES:
            shards.append(Shard(group))
            group, size = [], 0
    if group:
        shards.append(Shard(group))
    if not shards:
        return []
    place, block = repeated(shards, length)
    sizes = np.array([x[3] for x in where])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = np.bincount(block)
    some = np.flatnonzero(counts[block] > 1)
    if not len(some):
        return []
    place, block = place[some], block[some]
    owner = np.searchsorted(first, place, "right") - 1
    doc, start, row = (np.array([x[k] for x in where])[owner] for k in range(3))
    start = start + place - first[owner]
    order = np.lexsort((start, doc, block))
    doc, start, row, block = doc[order], start[order], row[order], block[order]
    head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    low = np.repeat(head, np.diff(np.append(head, len(block))))
    late = (doc != doc[low]) | (start != start[low])
    return list(set(zip(doc[late].tolist(), row[late].tolist(), start[late].tolist(), strict=True)))


# ---------------------------------------------------------------- groups


def _batches(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)


#: A run of removed starts, or else (low is null) a segment that goes on.
_FOUND = "key long, doc_id long, start long, row long, segment binary, inside int, low long, high long"


def _copy(doc, start, row, segment):
    return (None, doc, None, row, None, None, start, start + len(segment) - LENGTH)


def copies(batches):
    """Of rows in order of (key, segment, doc_id, start, row): the first of equal segments goes on, the others start removed strings throughout.

    Rows of one doc_id that hold it at one start precede each other nowhere, so all of them go on."""
    last = head = known = None
    out = []
    for key, doc, start, row, segment, inside in _rows(batches):
        if last != (key, segment) or (head == (doc, start) and known != row):
            last, head, known = (key, segment), (doc, start), row
            out.append((key, doc, start, row, segment, inside, None, None))
        elif head != (doc, start) and len(segment) >= LENGTH:
            out.append(_copy(doc, start, row, segment))
        if len(out) >= 2000:
            yield _batches(out, _FOUND)
            out = []
    if out:
        yield _batches(out, _FOUND)


def _runs(found: list[tuple[int, int, int]]) -> list[tuple]:
    """Neighbouring starts as rows."""
    out: list[list[int]] = []
    for doc, row, start in sorted(found):
        if out and out[-1][:2] == [doc, row] and out[-1][3] + 1 >= start:
            out[-1][3] = start
        else:
            out.append([doc, row, start, start])
    return [(None, d, None, r, None, None, a, b) for d, r, a, b in out]


def _alike(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _extents(sides: list[bytes]) -> list[int]:
    """Of each text the longest prefix that it shares with another: in order, that is one with a neighbour."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for a, b in zip(order, order[1:]):
        n = _alike(sides[a], sides[b])
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out


def trimmed(own: list[tuple[int, int, int, bytes, int]]) -> tuple[list[tuple[int, int, int, bytes]], list[tuple]]:
    """What of the distinct segments of one anchor may be in a string of two of them, and rows for those that are then equal to one before.

    Equal strings hold the anchor at one place, so they reach no further to either side of it than the segment agrees with any other."""
    if len(own) < 2 and all(i >= 0 for *_, i in own):
        return [], []
    if any(i < 0 for *_, i in own):
        return [x[:4] for x in own], []
    after = _extents([s[i:] for *_, s, i in own])
    before = _extents([s[:i][::-1] for *_, s, i in own])
    cut = sorted((s[i - b : i + a], doc, start + i - b, row) for (doc, start, row, s, i), a, b in zip(own, after, before, strict=True) if a + b >= LENGTH)
    kept, gone, head = [], [], None
    for s, doc, start, row in cut:
        if head and head[0] == s and head[1:] != (doc, start):
            gone.append(_copy(doc, start, row, s))
        else:
            head = s, doc, start
            kept.append((doc, start, row, s))
    return (kept, gone) if len(kept) > 1 else ([], gone)


def merge(batches, merge_bytes: int = MERGE_BYTES, large_bytes: int = LARGE_BYTES):
    """Of rows in order of (key, segment, doc_id, start, row): runs of removed starts. Keys gather until MERGE_BYTES are full.

    A key of more than LARGE_BYTES of distinct segments is not held: its segments go on."""
    gathered: list[tuple[int, int, int, bytes]] = []
    own: list[tuple[int, int, int, bytes, int]] = []
    out: list[tuple] = []
    size = held = 0
    key_now = last = head = known = None
    large = False
    for key, doc, start, row, segment, inside in _rows(batches):
        if key != key_now:
            some, gone = trimmed(own)
            gathered += some
            out += gone
            size += sum(len(s) for *_, s in some)
            own, held, key_now, last, large = [], 0, key, None, False
        if segment == last and (head != (doc, start) or known == row):
            if head != (doc, start) and len(segment) >= LENGTH:
                out.append(_copy(doc, start, row, segment))
        else:
            last, head, known = segment, (doc, start), row
            held += len(segment)
            own.append((doc, start, row, segment, inside))
            if large or held > large_bytes:
                large = True
                out += [(key, d, a, r, s, i, None, None) for d, a, r, s, i in own]
                own = []
        if size >= merge_bytes:
            out += _runs(later_starts(gathered))
            gathered, size = [], 0
        if len(out) >= 2000:
            yield _batches(out, _FOUND)
            out = []
    some, gone = trimmed(own)
    out += gone + _runs(later_starts(gathered + some))
    if out:
        yield _batches(out, _FOUND)


def every_start(batches):
    """The hash of each string in a segment."""
    for batch in batches:
        for doc, start, row, segment in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (n := len(segment) - LENGTH + 1) > 0:
                digests = [hashlib.blake2b(segment[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([doc] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(range(start, start + n), pa.int64())], ["digest", "doc_id", "row", "at"])


def removed_starts(docs: DataFrame, keep: Stage, frequent: int = FREQUENT, merge_bytes: int = MERGE_BYTES, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """(doc_id, row, low, high): every start in [low, high] begins a string that also starts earlier."""
    found = stretches(docs)
    # A stretch that holds its anchor twice may repeat strings of its own.
    counts = found.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where((F.col("n") > 1) | F.col("twice")).select("anchor", "n")
    places = found.join(counts, "anchor").groupBy("doc_id", "row").agg(F.collect_set(F.struct("low", "high", "anchor", "n")).alias("places"))  # as many as the document's stretches
    places = keep.write(places, "places")
    cut = keep.write(segments(docs, places, frequent), "segments")
    keep.drop("places")
    rows, order = ["key", "doc_id", "start", "row", "segment", "inside"], ["key", "segment", "doc_id", "start", "row"]
    salted = cut.where("frequent").repartition("key", F.pmod(F.xxhash64("segment", "doc_id"), F.lit(SALTS))).sortWithinPartitions(*order)
    first = keep.write(map_arrow(salted.select(*rows), copies, _FOUND), "frequent")
    rest = cut.where("not frequent").select(*rows).unionByName(first.where("low is null").select(*rows))
    merged = keep.write(map_arrow(rest.repartition("key").sortWithinPartitions(*order).select(*rows), partial(merge, merge_bytes=merge_bytes, large_bytes=large_bytes), _FOUND), "merged")
    keep.drop("segments")
    large = map_arrow(merged.where("low is null").select("doc_id", "start", "row", "segment"), every_start, "digest binary, doc_id long, row long, at long")
    least = large.groupBy("digest").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max(F.struct("doc_id", "at")).alias("last")).where("first <> last").select("digest", "first")
    late = large.join(least, "digest").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at"))).select("doc_id", "row", F.col("at").alias("low"), F.col("at").alias("high"))
    runs = [x.where("low is not null").select("doc_id", "row", "low", "high") for x in (first, merged)]
    return runs[0].unionByName(runs[1]).unionByName(late)


def removed(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs."""
    out, done, spans = [], 0, 0
    end = -1
    for low, high in sorted(runs):
        if low > end:
            spans += 1
            out.append(text[done:low])
        end = max(end, high + LENGTH)
        done = end
    out.append(text[done:])
    return b"".join(out), spans


def deduplicated(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row; kept is the remaining bytes."""
    keep = Stage(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    repeats = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    row = F.xxhash64("text") if repeats else F.lit(0).cast("long")  # tells the texts of one doc_id apart
    docs, known = docs.withColumn("row", row), known.withColumn("row", row)
    runs = removed_starts(known, keep, **limits)
    grouped = keep.write(runs.groupBy("doc_id", "row").agg(F.collect_set(F.struct("low", "high")).alias("runs")), "runs")  # as many as the document's starts
    keep.drop("frequent")
    keep.drop("merged")

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                ids, runs = part.column(0), part.column(2).to_pylist()
                texts = [t.as_py().encode() for t in plain(part.column(1))]
                left = [removed(t, [(x["low"], x["high"]) for x in r or ()]) for t, r in zip(texts, runs, strict=True)]
                columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(x) for t, (x, _) in zip(texts, left, strict=True)], pa.int64()), pa.array([n for _, n in left], pa.int64()), pa.array([x for x, _ in left], pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_arrow(docs.join(grouped, ["doc_id", "row"], "left").select("doc_id", "text", "runs"), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
