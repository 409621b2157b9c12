import hashlib
import random
import re

from pyspark.sql import functions as F

from tickloom.llm import decontaminate as d


def brute(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, t in items:
        w = cut(t)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc, t in docs:
        w, hit, found = cut(t), set(), set()
        for i in range(len(w)):
            for k in range(1, 14):
                if owners := windows.get(tuple(w[i : i + k])) if i + k <= len(w) else None:
                    hit |= set(range(i, i + k))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def _case():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "Ünï", "a1", "zeta", "It's", "東京"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 40)))) for i in range(15)] + [(90, ""), (91, None), (92, "rareword"), (2, "the of the of")]
    docs = []
    for i in range(60):
        t = " ".join(word() for _ in range(rng.randrange(60)))
        if i % 3 == 0:
            a = items[rng.randrange(15)][1]
            t += rng.choice([" - ", "\n", "; "]) + a.upper() + " " + " ".join(f"x{rng.randrange(99)}" for _ in range(rng.randrange(400)))
        docs.append((i, t))
    return docs + [(70, None), (71, ""), (71, ""), (None, "a rareword here"), (72, "x " * 50000 + "rareword")], items


def test_equals_brute_force_in_one_and_many_blocks(spark):
    docs, items = _case()
    x = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id long").repartition(4)
    y = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for block in (d.BLOCK_BYTES, 300):
        got = sorted((tuple(r) for r in d.contamination(x, y, block_bytes=block).collect()), key=str)
        assert got == want
        kept = sorted((r.doc_id for r in d.without_contaminated(x, y, block_bytes=block).where("doc_id is not null").collect()))
        assert kept == sorted(r[0] for r in want if not r[5] and r[0] is not None)


def test_empty_tables(spark):
    x = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    y = spark.createDataFrame([], "item_id long, text string")
    assert tuple(d.contamination(x, y).first())[1:4] == (2, 0, 0)
    assert d.contamination(x.limit(0), y).count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    """Null and repeated ids, with columns whose names the operator might use; one block and several."""
    rows = [(None, "alpha beta", 1), (1, "other words", 2), (2, "alpha beta", 3), (2, "clean text here", 4), (3, None, 5), (3, "gamma", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit long").withColumn("words", F.lit("w")).withColumn("items", F.lit("i"))
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "delta epsilon zeta")], "item_id long, text string")
    for block in (d.BLOCK_BYTES, 8):
        left = d.without_contaminated(docs, bench, block_bytes=block)
        assert left.columns == docs.columns
        assert sorted((r.hit for r in left.collect())) == [2, 4, 5]


def test_long_items_are_cut_with_all_their_windows(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10000)}" for _ in range(500)]
    items = [(1, " ".join(words)), (2, "short one")]
    docs = [(i, " ".join(words[i * 20 : i * 20 + 13])) for i in range(24)] + [(50, " ".join(words[5:17])), (51, "a short one b"), (52, " ".join(words))]
    x, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    cut = d.pieces(y, d.WINDOW, 200).collect()
    assert len(cut) > 10 and max(len(r.text) for r in cut) <= 200
    assert sorted((tuple(r) for r in d.contamination(x, y, block_bytes=800).collect()), key=str) == brute(docs, items)
