import random
import re

import numpy as np

from tickloom.llm import jaccard as j


def brute(rows):
    sets = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "B", "the", "é", "x1", "of", "zeta", "yes."])
    bases = [[f"{word()}{rng.randrange(40)}" for _ in range(rng.randrange(30, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        rows.append((i, rng.choice([" ", "\t", "\n "]).join(w)))
    rows += [(200 + i, "one two three") for i in range(3)] + [(210, ""), (211, None), (212, " \t"), (213, "ONE two three"), (214, "same words " * 400), (215, "same words " * 300)]
    # a chain: each step links, the ends do not
    chain = [f"c{k}" for k in range(100)]
    for i in range(8):
        rows.append((300 + i, " ".join(chain)))
        chain[i * 12] = f"d{i}"
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, token string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.near_duplicates(docs).collect()}
    assert got == brute(rows)
    left = sorted(r.doc_id for r in j.one_of_each(docs).collect())
    assert left == sorted({c for _, c in brute(rows).values()})


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in j.near_duplicates(docs).collect()), key=str)
    assert got == [(4, 4), (4, 4), (5, 4), (None, None)]
    assert j.near_duplicates(docs.limit(0)).count() == 0


def test_suffix_bound_never_drops():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 60, 2).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        assert j.linked(x, y) == (100 * shared >= 85 * (len(x) + len(y) - shared))
