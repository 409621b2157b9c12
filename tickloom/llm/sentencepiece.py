"""SentencePiece encoding and decoding (operator 2).

An Aho-Corasick automaton over the pieces passes once over a run of text; at each position its output links
give every piece that ends there, and each relaxes the best score of that position (Viterbi). The result is
the segmentation with the highest sum of piece scores.

Pieces hold the word mark only as a prefix or alone, so the best path of a text is that of its runs of one
or more marks and the characters up to the next mark, one after the other (checked when a model is read; a
model with other pieces is encoded in one run). Runs recur, so each worker keeps a bounded table of them.

Scores are the model file's. Where the file was trained by byte pair merging, its scores are the ranks of
the merges, and the best sum is not always what merging gives: ids then differ from those of a merging
encoder, while decoding always gives the text back.

Unknown characters become byte pieces (or the unknown id, if the model has none), each run's penalty being
that of the lowest score less 10. A word mark that stands in the text itself is encoded in bytes, and so is
any text that spells a byte piece or a control piece: decode(encode(text)) == text for every text.

Models whose file asks for any normalisation but the mark before a text (character maps, removal of white space, the
mark as a suffix) are refused.

Nulls: a null text has null ids; an empty text has none. Repeated rows each give a row; further columns stay
in `encoded`. Empty tables give no rows."""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import map_arrow, plain, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Runs that a worker keeps in each of two generations; a run that is longer than LONG_RUN is never kept.
MOST_RUNS = 60_000
LONG_RUN = 64
# Kinds of pieces in a model file, and the unknown character's penalty.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PENALTY = 10.0


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(raw, at)
        elif wire == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        elif wire == 5:
            value, at = struct.unpack("<f", raw[at : at + 4])[0], at + 4
        else:
            value, at = raw[at : at + 8], at + 8
        yield number, value


@dataclass
class Model:
    """Pieces of a model file, with the automaton over those that may stand in a text."""

    raw: bytes
    pieces: list[tuple[str, float, int]] = field(default_factory=list, repr=False)
    prefix: bool = True

    def __post_init__(self):
        for number, value in _fields(self.raw):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                if dict(_fields(value)).get(24):
                    raise ValueError("models with the word mark as a suffix are not supported")
            elif number == 3:
                rules = dict(_fields(value))
                self.prefix = bool(rules.get(3, 1))
                # Such rules change the text before encoding, and decoding could not give it back.
                if rules.get(2) or rules.get(6) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError(f"models that normalise texts ({rules.get(1, b'').decode()}, or by removing or keeping white space) are not supported")
        self.automaton = ahocorasick.Automaton()
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        scores = [s for _, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED)]
        self.floor = min(scores, default=0.0) - PENALTY
        for i, (text, score, kind) in enumerate(self.pieces):
            if kind in (NORMAL, USER_DEFINED):
                self.automaton.add_word(text, (len(text), score, i))
            elif kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
        self.automaton.make_automaton()
        self.single = {text for text, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED) and len(text) == 1}
        self.split = all(MARK not in text.lstrip(MARK) for text, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        self.runs = re.compile(f"{MARK}*[^{MARK}]*")
        # A character that is in no piece stands alone on every path, so the paths before and after it are independent.
        self.newline = self._fallback("\n") if not any("\n" in text for text, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)) else []
        self.marked, self.bare = Known(self.best, MARK), Known(self.best, "")
        self.spelled = [bytes([int(t[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else (" \u2047 " if kind == UNKNOWN else t.replace(MARK, " ")).encode() for t, _, kind in self.pieces]

    def _fallback(self, char: str) -> list[int]:
        found = [self.bytes.get(b) for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in found else found

    def best(self, run: str) -> tuple[int, ...]:
        """Ids of the best path through a run."""
        n = len(run)
        score, back = [0.0] + [float("-inf")] * n, [(1, None)] * (n + 1)
        if self.single.issuperset(run):  # every character is a piece, so only matches relax
            for end, match in self.automaton.iter(run):
                size, value, _ = match
                if (x := score[end + 1 - size] + value) > score[end + 1]:
                    score[end + 1], back[end + 1] = x, match
        else:
            found = self.automaton.iter(run)
            end, match = next(found, (n, None))
            for at in range(1, n + 1):
                if run[at - 1] not in self.single:
                    score[at] = score[at - 1] + self.floor
                while end == at - 1:  # the output links' pieces that end here
                    if (x := score[at - match[0]] + match[1]) > score[at]:
                        score[at], back[at] = x, match
                    end, match = next(found, (n, None))
        out: list[int] = []
        while n:
            size, piece = back[n][0], back[n][-1]
            out += [piece] if piece is not None else self._fallback(run[n - 1])[::-1]
            n -= size
        return tuple(out[::-1])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        marked = self.marked
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += self._fallback(MARK)
            for n, line in enumerate(part.split("\n") if self.newline else (part,)):
                if n:
                    out += self.newline
                lead = self.prefix and not k and not n
                words = line.split(" ")
                if "" in words or not self.split:  # several spaces meet, or one stands at an end
                    whole = (MARK if lead else "") + line.replace(" ", MARK)
                    for run in self.runs.findall(whole) if self.split else [whole]:
                        if run:
                            out += self.bare[run]
                    continue
                out += marked[words[0]] if lead else self.bare[words[0]]
                for word in words[1:]:
                    out += marked[word]
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if self.prefix and text[:1] == " " else text


class Known(dict):
    """Ids of runs in two generations: when the young one is full it becomes the old one, whose runs return when asked for."""

    def __init__(self, best, prefix: str):
        super().__init__()
        self.best, self.prefix, self.old = best, prefix, {}

    def __missing__(self, run: str) -> tuple[int, ...]:
        if (ids := self.old.get(run)) is None:
            ids = self.best(self.prefix + run)
        if len(run) <= LONG_RUN:
            if len(self) >= MOST_RUNS:
                self.old = dict(self)
                self.clear()
            self[run] = ids
        return ids


_MODELS: dict[bytes, Model] = {}


def model(raw: bytes) -> Model:
    """One model for each worker and file."""
    key = hashlib.sha256(raw).digest()
    if key not in _MODELS:
        _MODELS[key] = Model(raw)
    return _MODELS[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _without(rows: DataFrame, name: str) -> DataFrame:
    return rows.select([c for c in rows.columns if c.lower() != name])


def encoded(docs: DataFrame, path: str = MODEL, column: str = "text") -> DataFrame:
    """The rows, all columns, with ids array<int>, in place of a column of that name. The file is read by the driver (vocabularies are of bounded size)."""
    docs = _without(docs, "ids")
    raw = docs.sparkSession.sparkContext.broadcast(read_model(path))
    at = docs.columns.index(column)

    def encode(batches):
        own = model(raw.value)
        for batch in batches:
            ids = [None if t is None else own.encode(t) for t in batch.column(at).to_pylist()]
            ends = np.cumsum([0, *(len(x or ()) for x in ids)])
            flat = np.fromiter((i for x in ids for i in x or ()), np.int32, ends[-1])
            offsets = pa.array(ends.tolist(), pa.int32(), mask=np.array([x is None for x in ids] + [False]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(flat))], [*batch.schema.names, "ids"])

    return map_arrow(docs, encode, f"{docs._jdf.schema().toDDL()}, ids array<int>")


def decoded(rows: DataFrame, path: str = MODEL, column: str = "ids") -> DataFrame:
    """The rows with the text of their ids, as column decoded, in place of a column of that name."""
    rows = _without(rows, "decoded")
    raw = rows.sparkSession.sparkContext.broadcast(read_model(path))
    at = rows.columns.index(column)

    def decode(batches):
        own = model(raw.value)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return map_arrow(rows, decode, f"{rows._jdf.schema().toDDL()}, decoded string")


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_ids, ids, text_sha256, decoded_sha256, exact): each whole text encoded, and its ids decoded."""
    raw = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def both(batches):
        own = model(raw.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = plain(part.column(1)).to_pylist()
                ids = [own.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, ends[-1])
                back = [own.decode(x) for x in ids]
                digests = [[hashlib.sha256(t.encode()).hexdigest() for t in x] for x in (texts, back)]
                columns = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *(pa.array(x, pa.string()) for x in digests), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_ids", "ids", "text_sha256", "decoded_sha256", "exact"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), both, "doc_id long, n_chars long, n_ids long, ids array<int>, text_sha256 string, decoded_sha256 string, exact boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
