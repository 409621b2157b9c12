import random

import numpy as np

from tickloom.llm import quality as q


def test_thresholds_are_ordered_and_tails_fall():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(1500):
        g = int(rng.integers(0, 3))
        some = {1} | ({10} if rng.random() < (0.9, 0.5, 0.05)[g] else set()) | ({11} if rng.random() < (0.05, 0.5, 0.9)[g] else set()) | {int(x) for x in rng.integers(100, 400, 5)}
        rows.append((np.array(sorted(some)), g))
    m = q.fit(rows)
    assert m.thresholds == sorted(m.thresholds) and m.weights[11] > 0 > m.weights[10]
    t = m.tails(0.3)
    assert all(a >= b for a, b in zip(t, t[1:]))
    right = sum((m.tails(m.score(set(x.tolist())))[-1] >= 0.5) == (g == 2) for x, g in rows)
    assert right / len(rows) > 0.75


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = q.train(docs, labels.where("doc_id % 4 <> 0"))
    test = q.scored(docs, model).join(q.graded(labels).where("doc_id % 4 = 0"), "doc_id").select("grade", "selected").collect()
    clean = [r.selected for r in test if r.grade == 2]
    bad = [not r.selected for r in test if r.grade < 2]
    assert sum(clean) / len(clean) > 0.98 and sum(bad) / len(bad) > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "word " * 50000, None), (3, "$$$ !!! ###", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = q.train(docs, none)
    assert q.selected(docs, m).count() == 5 and q.selected(docs, m).columns == docs.columns
    some = spark.createDataFrame([(1, 0, 0), (None, 1, 1), (2, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = q.scored(docs, q.train(docs, some)).collect()
    assert len(rows) == 5 and all(0 <= r.tail_probability <= r.expected_grade <= 2 for r in rows)
    assert q.scored(docs.limit(0), m).count() == 0


def test_long_texts_keep_what_counts():
    rng = random.Random(1)
    words = [f"w{rng.randrange(3000)}" for _ in range(20000)]
    assert q.bucket("insult") in q.buckets(" ".join(words + ["insult"]))
