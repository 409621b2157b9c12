"""Personal data by bootstrapped contextual extraction (operator 3).

Seeds are what the base patterns find (e-mail addresses, IP addresses, cards that pass Luhn, international
phone numbers). Their lexical contexts (the two words before; the word before with the word after) are
patterns. Candidates are unseen identifier-like strings: an address without a dotted domain, and digit
groups of at least seven digits that no base span touches. Spark scores the bipartite graph of patterns and
instances in ROUNDS rounds: a pattern's confidence in a kind is the mean score of its distinct instances, an
instance's score is the noisy-or of its patterns (seeds keep 1). Candidates in the slot of a pattern with at
least SUPPORT distinct seeds and CONFIDENCE become spans of the pattern's kind. Base spans always stay.

Nulls: a null text is empty; a null doc_id is kept. Repeated rows each give a row. Empty tables give no
rows. Offsets are code points, the end exclusive. Further columns are ignored, or kept by `masked`."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ._common import Stage, map_arrow, plain, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 5
CONFIDENCE = 0.9
#: Patterns that are sent to all executors at once; rows go through as many blocks of patterns as there are.
MOST_SENT = 200_000
#: A context word is known by so many of its code points, those next to the span.
WORD = 64

# The base patterns' character classes and limits.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_NEAR_ADDRESS = re.compile(r"(?<!\S)[^\s@]++@[^\s@]++(?!\S)")
_NEAR_NUMBER = re.compile(r"[0-9(](?:[0-9().-]|\x20(?=[0-9(])){5,}[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifier-like strings that no base span touches, with the kind that their shape allows."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in _NEAR_ADDRESS.finditer(text)]
    if _DIGITS.search(text):
        for m in _NEAR_NUMBER.finditer(text):
            n = len(_digits(m[0]))
            if n >= 7:
                out.append((1 if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", m[0]) else 2 if 13 <= n <= 19 else 3, *m.span()))
    if not out:
        return out
    taken = sorted((a, b) for _, a, b in base)
    kept, i = [], 0
    for kind, a, b in sorted(out, key=lambda x: x[1:]):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if (i == len(taken) or taken[i][0] >= b) and (not kept or kept[-1][2] <= a):
            kept.append((kind, a, b))
    return kept


def _word(word: str) -> str:
    return re.sub(r"[0-9]", "0", word.lower())


def _left(text: str, at: int) -> tuple[str, int]:
    """The last WORD code points of the word that ends before a place (of white space), and where the word begins; -1 if it is longer."""
    while at and text[at - 1].isspace():
        at -= 1
    part = text[max(0, at - WORD) : at]
    word = part.split()[-1] if part else ""
    low = at - len(word)
    return word, low if not low or text[low - 1].isspace() else -1


def contexts(text: str, start: int, end: int) -> list[int]:
    """The patterns around a span, as hashes: the two words before it, and the word before with the word after."""
    last, low = _left(text, start)
    before = _left(text, low)[0] if low > 0 else ""
    while end < len(text) and text[end].isspace():
        end += 1
    after = text[end : end + WORD].split()[:1]
    found = []
    if before:
        found.append(f"l {_word(before)} {_word(last)}")
    if last and after:
        found.append(f"b {_word(last)} _ {_word(after[0])}")
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in found]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.int64()))])
_FOUND = "row long, doc_id long, spans array<struct<kind:int,start:int,stop:int,value:long,seed:boolean,patterns:array<long>>>"


def _found(text: str) -> list[dict]:
    base = base_spans(text)
    rows = [(x, True) for x in base] + [(x, False) for x in candidates(text, base)]
    return [
        {"kind": k, "start": a, "stop": b, "value": xxhash.xxh3_64_intdigest(text[a:b].lower().encode("utf-8", "surrogatepass")) - (1 << 63), "seed": seed, "patterns": contexts(text, a, b)}
        for (k, a, b), seed in rows
    ]


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, spans): base spans as seeds, candidates, and the patterns around both."""

    def find(batches):
        for batch in batches:
            spans = [_found(t.as_py()) for t in plain(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN))], ["row", "doc_id", "spans"])

    return map_arrow(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), find, _FOUND)


def learn(found: DataFrame, keep: Stage, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that discover."""
    edges = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value", "s.seed", F.explode("s.patterns").alias("pattern")).distinct()
    # A pattern with too few seeds, or without a candidate, can't discover anything.
    useful = edges.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.count_if(~F.col("seed")).alias("others")).where((F.col("seeds") >= support) & (F.col("others") > 0))
    edges = keep.write(edges.join(useful.select("pattern"), "pattern", "left_semi"), "edges")
    total = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = edges.select("kind", "value", F.col("seed").cast("double").alias("score")).groupBy("kind", "value").agg(F.max("score").alias("score"))
    patterns = None
    for k in range(rounds):
        sums = edges.join(scores, ["kind", "value"]).groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count_if("seed").alias("seeds"))
        patterns = keep.write(sums.join(total, "pattern").where(F.col("seeds") >= support).select("pattern", "kind", (F.col("sum") / F.col("n")).alias("confidence")), f"patterns-{k}")
        doubt = edges.join(patterns, ["pattern", "kind"]).groupBy("kind", "value").agg(F.max("seed").alias("seed"), F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence")))).alias("doubt"))
        scores = doubt.select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("score"))
    return patterns.where(F.col("confidence") >= confidence)


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each document: base counts and digest, all spans, and how many the patterns added."""
    keep = Stage(docs.sparkSession)
    found = keep.write(scan(docs), "found")
    patterns = learn(found, keep)
    slots = found.select("row", F.explode(F.filter("spans", lambda s: ~s.seed)).alias("s")).select("row", "s.kind", "s.start", "s.stop", F.explode("s.patterns").alias("pattern"))
    added = slots.join(patterns, ["pattern", "kind"]).select("row", F.struct("kind", "start", "stop").alias("s")).distinct().groupBy("row").agg(F.collect_list("s").alias("added"))
    seeds = F.transform(F.filter("spans", lambda s: s.seed), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop")))
    both = found.join(added, "row", "left").select("doc_id", F.array_sort(seeds).alias("base"), F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,stop:int>>")).alias("added"))

    def written(spans):
        kinds = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.stop.cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return both.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def mask(text: str, spans) -> str:
    """The text with each span, or run of overlapping spans, replaced by its (first) kind."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def masked(docs: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """The documents, all columns, with personal data masked and n_chars (if there) set anew.

    Each block of patterns adds the spans that it discovers to a row's; the last one masks. Between blocks rows are written."""
    spark, keep = docs.sparkSession, Stage(docs.sparkSession)
    found = keep.write(scan(docs), "found")
    patterns = keep.write(learn(found, keep), "patterns")
    keep.drop("found")
    names = docs.columns
    text_at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    spans_name = next(x for x in ("spans" + "_" * k for k in range(len(names) + 1)) if x.lower() not in {n.lower() for n in names})
    blocks = int(patterns.count() // (max(2, most_sent) // 2)) + 1
    carried = StructType([*docs.schema, StructField(spans_name, ArrayType(ArrayType(IntegerType())))])

    def discover(strong, first: bool, last: bool):
        def spans_of(text: str | None) -> list:
            if text is None:
                return []
            base = base_spans(text)
            return (base if first else []) + [x for x in candidates(text, base) if strong.value and any((p, x[0]) in strong.value for p in contexts(text, *x[1:]))]

        def run(batches):
            for batch in batches:
                texts = batch.column(text_at).to_pylist()
                spans = [spans_of(t) for t in texts]
                if not first:
                    spans = [[*map(tuple, x), *y] for x, y in zip(batch.column(len(names)).to_pylist(), spans, strict=True)]
                columns = batch.columns[: len(names)]
                if last:
                    new = [t if t is None else mask(t, x) for t, x in zip(texts, spans, strict=True)]
                    columns[text_at] = pa.array(new, pa.string())
                    if n_at is not None:
                        columns[n_at] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(columns[n_at].type)
                    yield pa.RecordBatch.from_arrays(columns, names)
                else:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.list_(pa.int32())))], [*names, spans_name])

        return run

    rows = docs
    for k in range(blocks):
        if k:
            rows = keep.write(rows, f"block-{k}")
            if k > 1:
                keep.drop(f"block-{k - 1}")
        own = patterns.where(F.pmod("pattern", F.lit(blocks)) == k)
        strong = spark.sparkContext.broadcast({(r.pattern, r.kind) for r in own.collect()})
        last = k == blocks - 1
        rows = map_arrow(rows, discover(strong, not k, last), docs.schema if last else carried)
    return rows


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
