import hashlib
import random

from tickloom.llm import fingerprint as f


def test_peeling_recovers_differences():
    rng = random.Random(1)
    for n in (0, 1, 3, 10, 60, 400):
        common = [rng.randrange(1 << 64) for _ in range(50)]
        a, b = [rng.randrange(1 << 64) for _ in range(n)], [rng.randrange(1 << 64) for _ in range(n // 2)]
        x, y = f.Version(""), f.Version("")
        x.keys, y.keys = common + a, common + b
        assert f.difference(x, y) == (set(a), set(b))


def test_digests_tell_copies_apart():
    assert len(set(f.digests("a\na\na\nb"))) == 4
    assert f.Version("a\nb").fingerprint() == f.Version("b\na").fingerprint() != f.Version("a\nb\nb").fingerprint()


def test_equals_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["é one", "two", "three", "x" * 30, ""]) + str(rng.randrange(5)) for _ in range(rng.randrange(1, 12))) for _ in range(200)] + ["", "", "one line", "z" * 100000]
    rows = list(enumerate(texts)) + [(900, None)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, part string").repartition(7)
    got = {r.doc_id: r for r in f.fingerprints(docs).collect()}
    assert set(got) == {i for i, _ in rows}

    def multiset(t):
        out, seen = set(), {}
        for p in t.split("\n") if t else ():
            seen[p] = seen.get(p, 0) + 1
            out.add((p, seen[p]))
        return out

    def like(a, b):
        x, y = multiset(a), multiset(b)
        return len(x & y) / len(x | y) if x | y else 1.0

    plain = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        t, nxt = plain[k], plain[(k + 1) % len(plain)]
        other = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(other.encode()).hexdigest())
        assert abs(r.near_edited - like(t, other)) < 1e-12 and abs(r.near_next - like(t, nxt)) < 1e-12
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint


def test_edges(spark):
    one = spark.createDataFrame([(3, "a\nb")], "doc_id long, text string")
    r = f.fingerprints(one).first()
    assert (r.near_next, r.n_chars) == (1.0, 3)
    assert f.fingerprints(one.limit(0)).count() == 0
    assert f.fingerprints(one.unionByName(one)).count() == 2
    assert f.fingerprints(spark.createDataFrame([(None, "x"), (1, "y")], "doc_id long, text string")).count() == 2
