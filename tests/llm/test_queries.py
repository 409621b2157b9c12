"""Corpus queries that SQL doesn't express, against plain versions over their whole tables at the least scale."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np

from tickloom.llm import html, quality, sentencepiece as sp, warc
from tickloom.llm.queries import queries

DATA = "/root/testdata/sf0.001"


def _rows(spark, name):
    return queries()[name](spark, DATA).collect()


def test_op2_paths_are_best(spark):
    """Each text's score against a scan over all pieces that end at each character."""
    own = sp.Model(sp.read_model())
    kinds = {sp.NORMAL, sp.USER_DEFINED}
    score = {t: s for t, s, k in own.pieces if k in kinds}
    longest = max(map(len, score))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    of = [s if k in kinds else None for _, s, k in own.pieces]
    rows = _rows(spark, "op2_sentencepiece")
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.exact and r.n_chars == len(text) and r.n_ids == len(r.ids)
        assert r.text_sha256 == r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if not text or sp.MARK in text:
            continue
        line = (sp.MARK + text).replace(" ", sp.MARK)
        single = [c in score for c in line]
        best = [0.0]
        for at in range(1, len(line) + 1):
            ends = [best[at - n] + score[line[at - n : at]] for n in range(1, min(longest, at) + 1) if line[at - n : at] in score]
            best.append(max(ends + ([] if single[at - 1] else [best[at - 1] + own.floor])))
        found = sum(of[i] for i in r.ids if of[i] is not None) + own.floor * single.count(False)
        assert math.isclose(found, best[-1], rel_tol=1e-9, abs_tol=1e-6), r.doc_id


def test_op5_grades_follow_the_model(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    m = quality.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = _rows(spark, "op5_quality")
    assert len(rows) == len(texts)
    for r in rows:
        found = set()
        for f in quality.features(texts[r.doc_id]):
            stems = [f] + [f"\n{f[:k]}" for k in (4, 5) if len(f) >= k and f[0] != "\t"]
            found |= {zlib.crc32(x.encode("utf-8", "surrogatepass")) % (1 << quality.BITS) for x in stems}
        s = sum(m.weights.get(b, 0.0) for b in found)
        tails = [1 / (1 + math.exp(-(s - t))) for t in m.thresholds]
        assert math.isclose(r.score, s, abs_tol=1e-9) and math.isclose(r.expected_grade, sum(tails), abs_tol=1e-9)
        assert math.isclose(r.tail_probability, tails[-1], abs_tol=1e-9) and r.selected == (tails[-1] >= quality.KEEP)


def test_op5_training_ends_where_the_likelihood_is_greatest():
    """The penalised likelihood by its definition falls, or stays, when any parameter moves."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        rows.append((np.array(sorted({1} | {10 + k for k in range(3) if rng.random() < (0.2 + 0.3 * ((g + k) % 3))})), g))
    m = quality.fit(rows)

    def loss(weights, thresholds):
        total = 0.0
        for x, g in rows:
            s = sum(weights.get(int(b), 0.0) for b in x)
            p = [1.0, *(1 / (1 + math.exp(-(s - t))) for t in thresholds), 0.0]
            total -= math.log(max(p[g] - p[g + 1], 1e-12))
        return total / len(rows) + quality.RIDGE * sum(w * w for w in weights.values()) / 2

    least = loss(m.weights, m.thresholds)
    assert m.weights
    for b, step in itertools.product(m.weights, (-0.1, 0.1)):
        assert loss(m.weights | {b: m.weights[b] + step}, m.thresholds) > least - 1e-5
    for k, step in itertools.product(range(2), (-0.1, 0.1)):
        assert loss(m.weights, [t + step * (i == k) for i, t in enumerate(m.thresholds)]) > least - 1e-5


def test_op7_decodes_each_page_best(spark):
    """Texts of all pages against the best of all labellings (short pages) or a plain table of best paths."""
    chain = html.trained()
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = _rows(spark, "op7_html")
    assert len(rows) == len(pages)
    for r in rows:
        found = html.blocks(pages[r.page_id])
        e = chain.emissions(html.features(found))
        n = len(found)

        def value(states):
            return chain.first[states[0]] + sum(e[i, s] for i, s in enumerate(states)) + sum(chain.moves[a, b] for a, b in zip(states, states[1:]))

        if n <= 10:
            best = max(itertools.product((html.MAIN, html.OTHER), repeat=n), key=value) if n else ()
        else:
            table = [{s: (chain.first[s] + e[0, s], (s,)) for s in (0, 1)}]
            for i in range(1, n):
                table.append({s: max(((table[-1][p][0] + chain.moves[p, s] + e[i, s], table[-1][p][1] + (s,)) for p in (0, 1)), key=lambda x: x[0]) for s in (0, 1)})
            best = max(table[-1].values(), key=lambda x: x[0])[1]
        assert r.text == "\n".join(b.text for b, s in zip(found, best, strict=True) if s == html.MAIN) and r.n_chars == len(r.text)


def test_op8_records_say_what_the_pages_hold(spark):
    """Headers, links and digests of all records, read by a plain split."""
    pages = [r.asDict() for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    by_page = {}
    for r in _rows(spark, "op8_warc"):
        raw = bytes(r.record)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        h = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(h["Content-Length"])]
        assert lines[0] == "WARC/1.1" and rest[len(block) :] == b"\r\n\r\n" and len(raw) == r.n_bytes
        assert h["WARC-Block-Digest"] == warc.sha1(block) == r.block_digest and hashlib.sha256(raw).hexdigest() == r.record_sha256
        assert (h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI")) == (r.record_type, r.record_id, r.refers_to, r.target_uri)
        by_page.setdefault(r.page_id, {})[r.record_type] = (h, block.decode())
    assert len(by_page) == len(pages)
    ids = set()
    for p in pages:
        (mh, about), (ch, text) = by_page[p["page_id"]]["metadata"], by_page[p["page_id"]]["conversion"]
        body = (p["html"] or "").encode()
        assert text == "\n".join(b.text for b in html.blocks(p["html"] or ""))
        assert mh["WARC-Refers-To"] == ch["WARC-Refers-To"] and mh.get("WARC-Target-URI") == p["url"]
        facts = dict(x.split(": ", 1) for x in about.strip().split("\r\n"))
        assert facts["source-WARC-Payload-Digest"] == warc.sha1(body) and facts["source-WARC-Record-ID"] == mh["WARC-Refers-To"]
        assert facts["conversion-record-id"] == ch["WARC-Record-ID"] and facts["conversion-digest"] == warc.sha1(text.encode())
        assert facts["http-Content-Length"] == str(len(body)) and facts["conversion-chars"] == str(len(text))
        ids |= {mh["WARC-Record-ID"], ch["WARC-Record-ID"], mh["WARC-Refers-To"]}
    assert len(ids) == 3 * len(pages) and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", x) for x in ids)
