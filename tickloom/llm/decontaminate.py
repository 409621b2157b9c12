"""Benchmark decontamination by a prefix-filtered set join (operator 9).

Each benchmark item is cut into windows of 13 words (a shorter item is one window). A window is in a
document only if all its words are, so one token suffices as its prefix: its rarest word, rarity being
counted over all documents. Documents join the windows on that word; the bounds of the text (positions
before and after the word) and the gram hash discard, and the words themselves verify.

The benchmark is joined in blocks of at most BLOCK_BYTES of text, long items in parts: the index that goes to the
executors has a proven bound, whatever the benchmark's size, and all blocks together are the whole benchmark. Rows go
through one block after another and carry what was found.

Nulls: a null text has no words; a null doc_id is kept as null. Repeated rows each give a row; empty tables
give no rows; further columns are ignored. Null item_ids are no items. Items that repeat an item_id count once."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ._common import ALPHANUMERIC, Stage, Words, map_arrow, slices, table

WINDOW = 13
#: Of text; a block's windows take some fifty times as much in a worker.
BLOCK_BYTES = 2 << 20


class Index:
    """Windows of one block of items, by length and by rarest word."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        w = Words(pa.array([t or "" for _, t in items], pa.large_string()), ALPHANUMERIC)
        self.vocabulary = np.unique(w.hash)
        self.owners: dict[bytes, set] = defaultdict(set)
        self.spans: dict[bytes, np.ndarray] = {}
        for k, (item, _) in enumerate(items):
            a, b = int(w.first[k]), int(w.first[k + 1])
            for i in range(a, max(b - window + 1, a + (b > a))):
                j = min(i + window, b)
                text = w.text(i, j)
                self.owners[text].add(str(item))
                self.spans[text] = w.hash[i:j]

    def build(self, counts: dict[int, int]) -> Index:
        """By (length, offset of the rarest word): the sorted hashes of that word."""
        prefix = defaultdict(set)
        for words in self.spans.values():
            rare = min(range(len(words)), key=lambda i: (counts.get(int(words[i]), 0), int(words[i]), i))
            prefix[int(words[rare])].add((len(words), rare))
        self.tokens = np.array(sorted(prefix), np.uint64)
        self.places = [sorted(prefix[int(t)]) for t in self.tokens]
        del self.spans
        return self

    def hits(self, w: Words) -> dict[int, tuple[set, set]]:
        """By text: its hit words, and the items that have windows there."""
        out: dict[int, tuple[set, set]] = {}
        if not len(self.tokens) or not len(w):
            return out
        at = np.minimum(np.searchsorted(self.tokens, w.hash), len(self.tokens) - 1)
        for p in np.flatnonzero(self.tokens[at] == w.hash).tolist():
            doc = int(np.searchsorted(w.first, p, "right")) - 1
            for length, offset in self.places[at[p]]:
                i = p - offset
                if i < w.first[doc] or i + length > w.first[doc + 1]:  # the positional bound
                    continue
                if owners := self.owners.get(w.text(i, i + length)):
                    words, items = out.setdefault(doc, (set(), set()))
                    words.update(range(i - int(w.first[doc]), i - int(w.first[doc]) + length))
                    items |= owners
        return out


def _counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often the documents hold each word of the vocabulary."""
    if not len(vocabulary):
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column(0), ALPHANUMERIC)
                at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                total += np.bincount(at[known[at] == w.hash], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["word", "n"])

    rows = map_arrow(docs.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(vocabulary[r.word]): r.n for r in rows}


def pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, piece, text): items of more than `most` bytes in parts that share window - 1 words, so that each window is whole in one."""

    def cut(batches):
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(text.encode()) <= most:
                    rows.append((item, 0, text))
                    continue
                w = Words(pa.array([text], pa.large_string()), ALPHANUMERIC)
                i = 0
                while i < len(w):
                    j = max(int(np.searchsorted(w.end, w.start[i] + most, "right")), min(i + window, len(w)))
                    rows.append((item, i, w.text(i, j).decode()))
                    i = j - window + 1 if j < len(w) else j
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["item_id", "piece", "text"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return map_arrow(items, cut, "item_id string, piece long, text string")


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """The items in lists of at most block_bytes of text (but for windows that are longer by themselves); one list at least."""
    cut = pieces(benchmark, window, block_bytes // 4).withColumn("size", F.octet_length("text"))
    n = int((cut.agg(F.sum("size")).first()[0] or 0) // (block_bytes // 2)) + 1
    while n > 1:  # texts are dealt by hash, so a block can be fuller than others
        fullest = cut.groupBy(F.pmod(F.xxhash64("item_id", "piece", "text"), F.lit(n))).agg(F.sum("size").alias("size"), F.count_distinct("text").alias("n")).orderBy(F.desc("size")).first()
        if fullest.size <= block_bytes or fullest.n == 1:
            break
        n *= 2
    for k in range(n):
        part = cut if n == 1 else cut.where(F.pmod(F.xxhash64("item_id", "piece", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.select("item_id", "text").distinct().collect()]


def _names(taken: list[str], *wanted: str) -> list[str]:
    """Column names that the table doesn't have."""
    return [next(x for x in (w + "_" * k for k in range(len(taken) + 1)) if x.lower() not in {t.lower() for t in taken}) for w in wanted]


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> tuple[DataFrame, list[str]]:
    """The rows with their number of words, hit words and items, and what these columns are called.

    Each block adds to what the blocks before it found in a row, so rows need no key; between blocks the rows are written."""
    keep, names = Stage(docs.sparkSession), _names(docs.columns, "words", "hit", "items")
    words, hit, items = names
    schema = StructType([*docs.schema, StructField(words, LongType()), StructField(hit, ArrayType(LongType())), StructField(items, ArrayType(StringType()))])
    text_at, width = docs.columns.index("text"), len(docs.columns)

    def judge(index, first):
        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    w = Words(part.column(text_at), ALPHANUMERIC)
                    found = index.value.hits(w)
                    if first:
                        hits, owners = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                    else:
                        hits, owners = part.column(width + 1).to_pylist(), part.column(width + 2).to_pylist()
                    for k, (h, o) in found.items():
                        hits[k], owners[k] = sorted(h.union(hits[k])), sorted(o.union(owners[k]))
                    own = [pa.array(np.diff(w.first), pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(owners, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *own], [*part.schema.names[:width], *names])

        return run

    rows, before = docs, None
    for k, part in enumerate(blocks(benchmark, window, block_bytes)):
        if k:
            rows = keep.write(rows, f"block-{k}")
            if before:
                keep.drop(before)
            before = f"block-{k}"
        index = Index(part, window)
        index = docs.sparkSession.sparkContext.broadcast(index.build(_counts(docs, index.vocabulary)))
        rows = map_arrow(rows, judge(index, not k), schema)
    return rows, names


def _contaminated(words: str, hit: str):
    n = F.size(hit).cast("long")
    return (n > 0) & (20 * n >= F.col(words))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: words, hit words, items, their digest, and the 5 % rule."""
    rows, (words, hit, items) = _hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, block_bytes)
    n = F.size(hit).cast("long")
    return rows.select("doc_id", F.col(words).alias("n_words"), n.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), _contaminated(words, hit).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, that the 5 % rule leaves; each row is judged by its own text."""
    rows, (words, hit, _) = _hits(docs, benchmark, window, block_bytes)
    return rows.where(~_contaminated(words, hit)).select(docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
