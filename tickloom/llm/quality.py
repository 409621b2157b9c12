"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 5).

Ratings grade a document 0 (low quality), 1 (toxic) or 2 (neither). One weight vector over hashed text
features and ordered thresholds t1 < t2 give P(grade >= k) = logistic(w.x - tk). The expected grade is the
sum of the tail probabilities; documents with P(grade >= 2) >= KEEP are selected.

Features are the presence of each distinct word's hash, of the hashes of its first 4 and 5 letters (stems take
many endings), and of quantised shape measures (share of capitals, of marks, of repeated lines, of separators). Presence does not thin out as texts grow, so one insult
weighs the same in a long text; buckets whose presence does not shift the grade beyond chance get no weight.

Training takes a bounded sample: the SAMPLE labelled documents with the least hash of doc_id (a documented
parameter). Only their hashed features reach the driver. Scoring reads every document and whole texts.

Nulls: a null text is empty and scored like one; labels with a null doc_id, quality or toxic are not used.
Several labels of one document count each. Repeated rows each give a row; an empty table gives no rows;
without labels every document scores by the thresholds alone and is kept. Further columns are ignored, or kept
by `selected`."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import map_arrow, plain, table

BITS = 18
SAMPLE = 12_000
GRADES = 3
KEEP = 0.5
LEAST_DOCS = 20
LEAST_Z = 4.0
LEAST_PHI = 0.1
STEPS = 300
RIDGE = 1e-4
#: Words of which a worker remembers the bucket.
MOST_WORDS = 100_000


def _share(name: str, part: float, whole: float) -> str:
    """A quantised share, one feature for each step that it reaches."""
    return f"\t{name}{min(9, int(10 * part / whole)) if whole else 0}"


def features(text: str) -> set[str]:
    """Distinct words without their marks, and shape measures."""
    raw = text.split()
    words = {w.strip(".,;:!?\"'()[]*$%&#|").lower() for w in set(raw)}
    words.discard("")
    n = len(text)
    lines = [x for x in text.split("\n") if x]
    marked = sum(1 for w in raw if not w[-1].isalnum() and w[-1] not in ".,;:?\"')")
    capitals = sum(1 for w in raw if len(w) > 1 and w.isupper())
    words.add(_share("marked", marked, len(raw)))
    words.add(_share("capitals", capitals, len(raw)))
    words.add(_share("again", len(lines) - len(set(lines)), len(lines)))
    words.add(_share("distinct", len(words), len(raw)))
    words.add(_share("bars", sum(1 for w in raw if w == "|"), len(raw)))
    words.add(f"\tsize{n.bit_length()}")
    return words


_BUCKETS: dict[str, tuple[int, ...]] = {}


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def buckets(text: str) -> set[int]:
    """Buckets of a text's features, and of its words' first letters."""
    if len(_BUCKETS) > MOST_WORDS:
        _BUCKETS.clear()
    out: set[int] = set()
    for f in features(text):
        if (found := _BUCKETS.get(f)) is None:
            stems = [f"\n{f[:k]}" for k in (4, 5) if len(f) >= k and f[0] != "\t"]
            found = _BUCKETS[f] = tuple(map(bucket, [f, *stems]))
        out.update(found)
    return out


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """Weights of the buckets that have any, and the ordered thresholds."""

    weights: dict[int, float]
    thresholds: list[float]

    def score(self, found: set[int]) -> float:
        get = self.weights.get
        return sum(get(b, 0.0) for b in found)

    def tails(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        return [float(logistic(score - t)) for t in self.thresholds]


def fit(rows: list[tuple[np.ndarray, int]], grades: int = GRADES) -> Ordinal:
    """Cumulative-link regression by gradient steps, on the buckets that shift the grade beyond chance."""
    if not rows:
        return Ordinal({}, [-2.0 + k * 0.1 for k in range(grades - 1)])
    y = np.array([g for _, g in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x, _ in rows])
    where = np.concatenate([x for x, _ in rows]).astype(np.int32, copy=False)
    n = np.bincount(where, minlength=1 << BITS).astype(float)
    keep = np.zeros(1 << BITS, bool)
    for k in range(grades):  # presence against each grade's share
        p = (y == k).mean()
        hits = np.bincount(where, weights=(y == k)[owner], minlength=1 << BITS)
        with np.errstate(divide="ignore", invalid="ignore"):
            keep |= np.abs(hits - n * p) / np.sqrt(n * p * (1 - p)) >= max(LEAST_Z, LEAST_PHI * np.sqrt(len(rows)))
    keep &= n >= LEAST_DOCS
    names = np.flatnonzero(keep)
    column = np.cumsum(keep) - 1
    some = keep[where]
    owner, where = owner[some], column[where[some]]
    w = np.zeros(len(names))
    share = np.array([(y >= k).mean() for k in range(1, grades)]).clip(1e-4, 1 - 1e-4)
    theta = -np.log(share / (1 - share))  # t1 < t2 < ... since the shares fall
    first, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    params = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, t = params[: len(names)], params[len(names)] + np.concatenate([[0], np.cumsum(np.exp(params[len(names) + 1 :]))])
        s = np.bincount(owner, weights=w[where], minlength=len(rows))
        upper = np.concatenate([np.ones((len(rows), 1)), logistic(s[:, None] - t)], axis=1)  # P(grade >= k)
        lower = np.concatenate([upper[:, 1:], np.zeros((len(rows), 1))], axis=1)
        at = np.arange(len(rows)), y
        p = np.maximum(upper[at] - lower[at], 1e-12)
        up, low = upper[at] * (1 - upper[at]), lower[at] * (1 - lower[at])
        ds = -(up - low) / p  # of the negative log likelihood
        dt = np.zeros(len(t))
        np.add.at(dt, np.maximum(y - 1, 0), np.where(y > 0, up / p, 0))
        np.add.at(dt, np.minimum(y, len(t) - 1), np.where(y < len(t), -low / p, 0))
        dw = np.bincount(where, weights=ds[owner], minlength=len(names)) + RIDGE * len(rows) * w
        grown = np.exp(params[len(names) + 1 :])
        dg = np.array([dt[k + 1 :].sum() for k in range(len(t) - 1)]) * grown
        g = np.concatenate([dw, [dt.sum()], dg]) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    t = params[len(names)] + np.concatenate([[0], np.cumsum(np.exp(params[len(names) + 1 :]))])
    return Ordinal({int(b): float(x) for b, x in zip(names, params[: len(names)], strict=True) if abs(x) > 1e-6}, [float(x) for x in t])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """A model of at most `sample` labelled documents."""

    def hashed(batches):
        for batch in batches:
            found = [sorted(buckets(t)) for t in plain(batch.column(0)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["found", "grade"])

    some = F.broadcast(sample_labels(labels, sample))  # at most `sample` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id").select("text", "grade")
    got = map_arrow(rows, hashed, "found array<int>, grade int").toArrow()
    found = got.column("found").combine_chunks()
    values, ends = found.values.to_numpy(), found.offsets.to_numpy()  # numbers stay packed: the sample holds millions
    pairs = [(values[a:b], g) for a, b, g in zip(ends, ends[1:], got.column("grade").to_pylist())]
    return fit(sorted(pairs, key=lambda r: (r[1], len(r[0]), r[0].tobytes())))  # the same order in every run


def scored(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, expected_grade, tail_probability, selected) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        own = shared.value
        for batch in batches:
            scores = [own.score(buckets(t.as_py())) for t in plain(batch.column(1))]
            tails = [own.tails(s) for s in scores]
            last = [t[-1] for t in tails]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([sum(t) for t in tails], pa.float64()), pa.array(last, pa.float64()), pa.array([p >= keep for p in last], pa.bool_())],
                ["doc_id", "score", "expected_grade", "tail_probability", "selected"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), score, "doc_id long, score double, expected_grade double, tail_probability double, selected boolean")


def selected(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """The documents, all columns, that the model selects."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def choose(batches):
        own = shared.value
        for batch in batches:
            flag = [own.tails(own.score(buckets(t.as_py())))[-1] >= keep for t in plain(batch.column(at))]
            yield batch.filter(pa.array(flag, pa.bool_()))

    return map_arrow(docs, choose, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
