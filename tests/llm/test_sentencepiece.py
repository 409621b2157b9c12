"""Encoding against a library's own Viterbi over the same pieces and scores, and exact round trips."""

import random

import pytest
import sentencepiece

from tickloom.llm import sentencepiece as own

RAW = own.read_model()


def _as_unigram(raw: bytes) -> bytes:
    """The model file with its kind set to unigram (field 3 of the trainer's message), without byte fallback."""
    out, at = bytearray(), 0
    while at < len(raw):
        start = at
        key, at = own._varint(raw, at)
        size, at = own._varint(raw, at)
        body = raw[at : at + size]
        at += size
        if key >> 3 == 2:
            spec = bytes(body) + b"\x18\x01"
            out += bytes([key]) + _number(len(spec)) + spec
        else:
            out += raw[start:at]
    return bytes(out)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


TEXTS = ["", " ", "  two  spaces ", "Hello world, this is a text.", "Ünïcödé 東京 \U0001f600 x", "a\nb\tc\r\n", "<s>▁</s> <0x41> ▁▁x", "\0\1", "x" * 3000, "the " * 500]


def test_round_trip():
    m = own.Model(RAW)
    rng = random.Random(1)
    for text in TEXTS + ["".join(chr(rng.choice([32, 32, 97, 101, 0x2581, 0x4E00, 0x1F600, 10, 0, 233])) for _ in range(rng.randrange(60))) for _ in range(300)]:
        assert m.decode(m.encode(text)) == text


def test_best_score_equals_librarys():
    m = own.Model(RAW)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=_as_unigram(RAW))
    score = lambda ids: sum(m.pieces[i][1] for i in ids)
    texts = ["Hello world, this is a text.", "international unbelievable   tokenisation", "Thnttionwh thtible of, be tiwh erered", "éèau ouè Ératre", "abc" * 30]
    for text in texts:
        assert score(m.encode(text)) == pytest.approx(score(theirs.encode(text)))


def test_runs_do_not_change_the_best_path():
    m = own.Model(RAW)
    for text in ["one two  three", "   a  b", "x y z " * 5]:
        whole = own.MARK + text.replace(" ", own.MARK)
        assert list(m.best(whole)) == m.encode(text)


def test_tables(spark):
    schema = "doc_id long, text string, ids string"
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (None, "héllo ▁ wörld", "b"), (3, "x" * 200000, "c")]
    got = own.round_trip(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r.exact for r in got)
    assert own.round_trip(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    back = own.decoded(own.encoded(docs)).collect()
    assert [r.text for r in back] == [r.decoded for r in back]


def test_clashing_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (2, None, None, None)], "doc_id long, text string, IDS string, decoded string")
    rows = own.encoded(docs)
    assert rows.columns == ["doc_id", "text", "decoded", "ids"]
    back = own.decoded(rows)
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id, r.decoded) for r in back.collect()) == [(1, "a b"), (2, None)]


def test_normalising_models_are_refused():
    spec = b"\x0a\x03nfk\x12\x02ab\x18\x01\x20\x00"
    with pytest.raises(ValueError, match="normalise"):
        own.Model(RAW + bytes([0x1A]) + _number(len(spec)) + spec)
