import hashlib
import random

import pytest

from tickloom.llm import substrings as s


def brute(rows):
    """Every string of every text in order, against all before."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        cover = [False] * len(raw)
        for i in range(len(raw) - s.LENGTH + 1):
            x = raw[i : i + s.LENGTH]
            if x in seen:
                cover[i : i + s.LENGTH] = [True] * s.LENGTH
            seen.add(x)
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        spans = sum(c and not p for c, p in zip(cover, [False, *cover]))
        out[doc] = (len(raw), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_merged_transforms_sort_all_suffixes():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    shards = [s.Shard(strings[i : i + 7]) for i in range(0, 30, 7)]
    joined = b"".join(x + b"\0" for x in strings)
    place, block = s.repeated(shards, 12)
    suffix = [joined[p:].split(b"\0")[0] for p in place]
    assert sorted(place) == list(range(len(joined)))
    assert [x[:12] for x in suffix] == sorted(x[:12] for x in suffix)
    for k in range(1, len(place)):
        same = len(suffix[k]) >= 12 and suffix[k][:12] == suffix[k - 1][:12]
        assert (block[k] == block[k - 1]) == same


def _texts(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    long = [" ".join(word() for _ in range(120)) for _ in range(4)]
    rows = []
    for i in range(60):
        a = rng.choice(long)
        x = rng.randrange(len(a))
        text = " ".join(word() for _ in range(rng.randrange(40))) + a[x : x + rng.randrange(300)] + " ".join(word() for _ in range(rng.randrange(40)))
        rows.append((i, text))
    near = list(rows[3][1] + long[0])
    for k in range(8):
        near[rng.randrange(len(near))] = "Z"
        rows.append((100 + k, "".join(near)))
    return rows + [(200, "x" * 1000), (201, "ab" * 400), (202, "y" * 99), (203, "x" * 99), (204, ""), (205, None), (206, "ab" * 3000), (207, rows[5][1]), (208, rows[5][1])]


@pytest.mark.parametrize("limits", [{}, {"frequent": 2, "merge_bytes": 3000}, {"frequent": 2, "large_bytes": 500}])
def test_equals_brute_force(spark, limits):
    rows = _texts(random.Random(len(limits)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in s.deduplicated(docs, **limits).collect()}
    assert got == brute(rows)


def test_edges(spark):
    t = "abc " * 60
    docs = spark.createDataFrame([(None, t), (1, t), (1, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in s.deduplicated(docs).collect())
    assert got[0] == (0, 240, 0) and got[1] == got[2]
    assert s.deduplicated(docs.limit(0)).count() == 0


def _results(spark, rows, **limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in s.deduplicated(docs, **limits).collect())


def test_short_repetitive_texts(spark):
    rows = [(1, "x" * 101), (2, "word " * 24), (3, "ab" * 60 + "c"), (4, "-" * 168)]
    assert _results(spark, rows) == sorted((k, *v) for k, v in brute(rows).items())


def test_frequent_anchors_that_stand_twice_in_some_texts(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    before, between, line = text(70), text(28), text(34)
    rows = [(i, text(90) + line + text(90)) for i in range(10)]
    rows += [(20, before + line + between + text(100)), (21, before + line + between + line + text(100)), (22, between + line + between + line + before)]
    rows += [(23, before + line + between + line + before), (24, text(30) + between + line + between + line + before), (25, text(9) + "x" * 150), (26, "x" * 150 + line)]
    for frequent in (1, 2, 5):
        assert _results(spark, rows, frequent=frequent) == sorted((k, *v) for k, v in brute(rows).items())


@pytest.mark.parametrize("limits", [{}, {"frequent": 1}, {"frequent": 1, "large_bytes": 100}])
def test_rows_of_one_document_are_judged_by_their_own_texts(spark, limits):
    rng = random.Random(7)
    a, b = ("".join(rng.choice("abcdefghij ") for _ in range(250)) for _ in range(2))
    got = _results(spark, [(1, a), (1, a), (1, b[:120]), (2, b), (2, a[50:])], **limits)
    assert [x[:3] for x in got] == [(1, 120, 0), (1, 250, 0), (1, 250, 0), (2, 200, 200), (2, 250, 120)]
