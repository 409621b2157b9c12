"""N-gram Jaccard join with rare-first prefix filtering (operator 10).

A document's set holds its distinct 4-word shingles. Two documents link when 100 * |x & y| >= 85 * |x | y|.

1. A sketch of fixed size counts all shingles of all documents; it orders shingles from rare to frequent.
   Any total order gives the same links, so the sketch's collisions cost time, never results.
2. Texts are read once more: each document's size, the key of its set and the |x| - ceil(0.85 |x|) + 1 first shingles
   in that order, its prefix, are written. Linked sets share a prefix shingle.
3. Equal sets are one class, known by the 64-bit hash of its set and its size; a class emits its prefix once a task, and
   shingles of one class alone drop out.
4. First round: each class is verified against the hub under each of its prefix shingles, once per pair. The hub
   is the class whose prefix others share most: of near copies, the text that the others were made of. This alone
   joins a large group of near copies, in as many pairs as the group has prefix rows.
5. Second round, across components: of the set whose prefix ends first, all common shingles but those beyond the prefix are
   shared prefix shingles, so a pair shares `_least_common` of them at least. Sizes fall into classes a factor of STEP
   wide. A shingle of a set counts towards a size class where a set of that class and of another component has it, too;
   size classes with too few shingles go, twice. Of the rest only the shingles that the fewest sets share, all but
   `_least_common` - 1, are joined (a second prefix, now by exact counts), within pairs of size classes. Positional bounds, what
   the first round found both to have in common with one hub, and the number of joined shingles discard pairs; a suffix bound and the
   whole sets verify.
6. Components are those of the verified links and the classes.

No group is collected, no pair of equal sets is made, and nothing is capped.

Nulls: a null text has no set and is linked with nothing; rows with a null doc_id give a row with a null
component. Repeated rows are each returned; rows that share a doc_id are one node. Empty tables give no rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import SPACED, Stage, Words, components, map_arrow, mix, slices, table

N = 4
SHARE, OF = 85, 100
SKETCH_BITS = 22
CHUNKS = 64
#: Bits of a token that hold the rarity level; the rest is the shingle's hash.
LEVEL_BITS = 6
#: Each size class is this factor wide, so linked sets are REACH classes apart at most.
STEP, REACH = 1.04, 5
#: Up to so many ids (8 MB) go to all executors to pick their texts; more are joined.
FEW_IDS = 1_000_000


def _sets(column: pa.Array, n: int = N):
    """For each text: its distinct shingle hashes, sorted."""
    w = Words(column, SPACED)
    grams, first = w.grams(n), w.first.tolist()
    for a, b in zip(first, first[1:]):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            whole = b - a
            for h in w.hash[a:b].tolist():
                whole = (whole * 0xD6E8FEB86659FD93 + h) & 0xFFFFFFFFFFFFFFFF
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


# ---------------------------------------------------------------- rarity


def _planes(sums: dict[int, np.ndarray]):
    """Counts of chunks as compressed byte planes; most counts need one."""
    rows = []
    for chunk, counts in sums.items():
        plane = 0
        while counts.any():
            rows.append((chunk, plane, zlib.compress((counts & 255).astype(np.uint8).tobytes(), 1)))
            counts, plane = counts >> 8, plane + 1
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["chunk", "plane", "counts"])


def sketch(docs: DataFrame, n: int, kinds: np.ndarray = SPACED, steps: int = 1) -> np.ndarray:
    """Log2 of the number of shingle occurrences in each of the sketch's buckets, over all documents, in `steps` steps each."""
    width = 1 << SKETCH_BITS
    step = width // CHUNKS

    def count(batches):
        total, waiting, held = np.zeros(width, np.int64), [], 0
        for batch in batches:
            for part in slices(batch):
                waiting.append((Words(part.column(0), kinds).grams(n) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                held += len(waiting[-1])
                if held > width // 2:
                    total += np.bincount(np.concatenate(waiting), minlength=width)
                    waiting, held = [], 0
        if held:
            total += np.bincount(np.concatenate(waiting), minlength=width)
        yield from _planes({k: total[k * step : (k + 1) * step] for k in range(CHUNKS)})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, plane, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = sums.setdefault(k, np.zeros(step, np.int64))
                own += np.frombuffer(zlib.decompress(x), np.uint8).astype(np.int64) << (8 * plane)
        yield from _planes(sums)

    schema = "chunk int, plane int, counts binary"
    levels = np.zeros(width, np.int64)
    # Two steps of adding, so that no task meets the counts of all partitions.
    salted = map_arrow(docs.select("text"), count, schema).repartition(F.col("chunk"), F.pmod(F.spark_partition_id(), F.lit(16)))
    for row in map_arrow(map_arrow(salted, add, schema).repartition("chunk"), add, schema).collect():
        levels[row.chunk * step : (row.chunk + 1) * step] += np.frombuffer(zlib.decompress(row.counts), np.uint8).astype(np.int64) << (8 * row.plane)
    return np.minimum(steps * np.log2(levels + 1), 64 * steps - 1 if steps < 4 else 255).astype(np.uint8)


def _tokens(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as integers that sort from rare to frequent."""
    level = levels[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(64 - LEVEL_BITS)) | (grams >> np.uint64(LEVEL_BITS)))


# ---------------------------------------------------------------- sets and prefixes


def _prefixes(docs: DataFrame, levels: np.ndarray, n: int) -> DataFrame:
    """(doc_id, n_shingles, key, tokens): the hash of the set and the tokens of its prefix, null for an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def prefix(batches):
        for batch in batches:
            for part in slices(batch):
                sizes, keys, tokens = [], [], []
                for grams in _sets(part.column(1), n):
                    sizes.append(size := len(grams))
                    keys.append(int(mix(grams * np.uint64(0x9E3779B97F4A7C15)).sum().view(np.int64)) if size else None)
                    tokens.append(_tokens(grams, shared.value)[: size + (SHARE * size) // -OF + 1].tobytes() if size else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "n_shingles", "key", "tokens"])

    return map_arrow(docs.select("doc_id", "text"), prefix, "doc_id long, n_shingles long, key long, tokens binary")


def _places(sets: DataFrame) -> DataFrame:
    """(token, key, place) of each class, once a task; place holds the set's size and the token's position in it."""

    def flat(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, keys, places = [], [], []
            for size, key, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key not in seen:
                    seen.add(key)
                    tokens.append(own := np.frombuffer(data, np.int64))
                    keys.append(np.full(len(own), key, np.int64))
                    places.append((np.int64(size) << 32) + np.arange(len(own)))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, places)], ["token", "key", "place"])

    return map_arrow(sets.where("doc_id is not null and key is not null").select("n_shingles", "key", "tokens"), flat, "token long, key long, place long")


# ---------------------------------------------------------------- bounds


def _least_overlap(x, y):
    return -((SHARE * (x + y)) // -(OF + SHARE))


def _bounds(x: str, y: str):
    """Length and positional bounds on two places."""
    sizes = [F.shiftright(F.col(c), 32) for c in (x, y)]
    at = [F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) for c in (x, y)]
    most = F.least(*at) + 1 + F.least(sizes[0] - at[0] - 1, sizes[1] - at[1] - 1)
    return (OF * F.least(*sizes) >= SHARE * F.greatest(*sizes)) & (most * (OF + SHARE) >= SHARE * (sizes[0] + sizes[1]))


def _rest(place):
    """How many tokens a set has beyond its prefix."""
    return F.floor((F.shiftright(place, 32) * SHARE + (OF - 1)) / OF) - 1


def _enough(rows: DataFrame, missing: str = "0", part: int = 1) -> DataFrame:
    """The pairs (a, b) that share enough prefix tokens, or that part (1 / part) of it, of a row (a, b, x, y) for each shared one but `missing` at most.

    Of the set whose prefix ends first, all common tokens but those of its own rest are shared prefix tokens, so the
    overlap is at most their number plus the larger rest."""
    sizes = [F.shiftright(F.col(c), 32) for c in ("x", "y")]
    rest = [_rest(F.col(c)) for c in ("x", "y")]
    pairs = rows.groupBy("a", "b").agg((F.count("*") + F.max(F.expr(missing))).alias("m"), F.max("x").alias("x"), F.max("y").alias("y"))  # places differ, sizes do not
    return pairs.where((part * F.col("m") + F.greatest(*rest)) * (OF + SHARE) >= SHARE * (sizes[0] + sizes[1])).select("a", "b")


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / np.log(STEP)).astype(np.int64)


def _least_common(sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each set and each of 2 REACH + 1 size classes: shared prefix tokens that a link needs at least; none links where it is 1 << 40.

    With partners of size z, more than 85 (s + z) / 185 - 0.85 max(s, z): it grows up to z = s and falls beyond."""
    s, other = sizes.astype(float)[:, None], own[:, None] + np.arange(-REACH, REACH + 1)
    low = np.maximum(np.ceil(s * SHARE / OF - 1e-6), np.floor(STEP**other - 1e-6))
    high = np.minimum(np.floor(s * OF / SHARE + 1e-6), np.ceil(STEP ** (other + 1) + 1e-6))
    need = [SHARE * (s + z) / (OF + SHARE) - SHARE / OF * np.maximum(s, z) for z in (low, high)]
    least = np.maximum(1, np.floor(np.minimum(*need) - 1e-6) + 1)
    return np.where(low <= high, least, 1 << 40).astype(np.int64)


# ---------------------------------------------------------------- pairs


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link. The suffix bound splits both at x's median and adds what either half can share."""
    least = _least_overlap(len(x), len(y))
    mid = len(x) // 2
    cut = int(np.searchsorted(y, x[mid]))
    if min(mid, cut) + min(len(x) - mid, len(y) - cut) < least:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return OF * shared >= SHARE * (len(x) + len(y) - shared)


_MEASURES = ("common", "size", "alike", "beyond", "lacks_0", "lacks_1", "lacks_2", "lacks_3")


def _verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, n: int, keep: Stage, name: str, levels=None, shared: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of classes as doc_ids (a, b) beside their keys (x, y), with `ok` where their whole sets link.

    The text of b is moved once for each pair, that of a once. With `levels` and `shared` also: how many shingles they have in
    common, the size of a's set, of b's shingles that a lacks the number that are shared in prefixes (`alike`) and the number beyond b's
    prefix (`beyond`), and a bit for each of a's shingles that b lacks (`lacks_0` to `lacks_3`; several can have one bit)."""
    names = ["a", "b", "x", "y", "ok", *_MEASURES]

    def verify(batches):
        for batch in batches:
            for part in slices(batch, "u"):
                rows = []
                tokens = part.column(6).to_pylist() if levels is not None else [None] * part.num_rows
                for x, y, own in zip(_sets(part.column(4), n), _sets(part.column(5), n), tokens, strict=True):
                    ok = bool(len(x)) and bool(len(y)) and linked(x, y)
                    if levels is None:
                        rows.append((ok, *[0] * len(_MEASURES)))
                        continue
                    size, common = len(y), len(np.intersect1d(x, y, assume_unique=True))
                    theirs, prefix = _tokens(x, levels.value), _tokens(y, levels.value)[: size + (SHARE * size) // -OF + 1]
                    beyond = size - common - len(np.setdiff1d(prefix, theirs, assume_unique=True))
                    alike = len(np.setdiff1d(np.array(own, np.int64).view(np.uint64), theirs))
                    flags = np.zeros(256, np.uint8)
                    flags[(np.setdiff1d(x, y, assume_unique=True) >> np.uint64(56)).astype(np.int64)] = 1
                    rows.append((ok, common, len(x), alike, beyond, *np.packbits(flags).view(np.int64).tolist()))
                extra = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.bool_(), *[pa.int64()] * len(_MEASURES)), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *extra], names)

    named = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    for key, doc in (("x", "a"), ("y", "b")):
        named = named.join(first.select(F.col("key").alias(key), F.col("rep").alias(doc)), key)
    named = keep.write(named.select("a", "b", "x", "y").where("a <> b").distinct(), f"{name}-pairs")
    ends = named.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    few = F.broadcast(ends) if named.count() <= FEW_IDS // 2 else ends
    texts = keep.write(docs.join(few, "doc_id", "left_semi"), f"{name}-texts")
    both = named.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("v")), "b")
    if shared is not None:
        both = both.join(shared.select(F.col("key").alias("y"), F.col("rows.token").alias("tokens")), "y")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("u")), "a")
    columns = ["a", "b", "x", "y", "u", "v"] + ["tokens"] * (shared is not None)
    found = map_arrow(both.select(*columns), verify, "a long, b long, x long, y long, ok boolean, " + ", ".join(f"{x} long" for x in _MEASURES)).distinct()
    found = keep.write(found if shared is not None else found.where("ok"), name)
    for x in ("pairs", "texts"):
        keep.drop(f"{name}-{x}")
    return found


def _hubs(verified: DataFrame) -> DataFrame:
    """(key, hub, measures): what the first round tells of each class and, of its hubs, the one that most classes met."""
    of = verified.groupBy("x").agg(F.count("*").alias("met"), F.max("size").alias("size"))
    every = verified.join(of.select("x", "met"), "x").select(F.col("y").alias("key"), "met", F.col("x").alias("hub"), *_MEASURES)
    itself = {"common": F.col("size"), "size": F.col("size")}
    every = every.unionByName(of.select(F.col("x").alias("key"), "met", F.col("x").alias("hub"), *(itself.get(m, F.lit(0).cast("long")).alias(m) for m in _MEASURES)))
    return every.groupBy("key").agg(F.max(F.struct("met", "hub", *_MEASURES)).alias("h")).select("key", "h.hub", *(f"h.{m}" for m in _MEASURES))


def _most_common():
    """Shingles that two sets which met the same hub can have in common, by their measures (prefixed x and y).

    Those in the hub are all but the ones that either lacks. Of others: where x's prefix ends first, those in it are shared
    ones of both prefixes, and the rest is beyond it."""
    lacked = [F.bit_count(F.col(f"xlacks_{k}").bitwiseOR(F.col(f"ylacks_{k}"))) for k in range(4)]
    lacking = F.greatest(sum(lacked[1:], lacked[0]), *(F.col(f"{p}size") - F.col(f"{p}common") for p in "xy"))
    return F.col("xsize") - lacking + F.least("xalike", "yalike") + F.greatest("xbeyond", "ybeyond")


_ROWS = "token long, key long, c long, class long, place long"


def _narrowed(rows: DataFrame, last: bool) -> DataFrame:
    """The rows (token, key, c, class, place) of sets that may link with one of another component; see `_least_common`.

    If `last`, only those of the second prefix, each with the lower and the upper size class of the pairs that it is for."""
    seen = rows.groupBy("token", "class").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"))
    # One entry for each size class: a set of a trillion shingles is in the 700th.
    seen = seen.groupBy("token").agg(F.collect_list(F.struct("class", "low", "high")).alias("seen"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").drop("low", "high")
    bits = f"aggregate(seen, 0, (b, z) -> b | if(abs(z.class - class) <= {REACH} and (z.low <> c or z.high <> c), shiftleft(1, cast(z.class - class + {REACH} as int)), 0))"
    near = rows.join(seen, "token").withColumn("bits", F.expr(bits)).where("bits <> 0")
    each = near.groupBy("key", "c", "class").agg(F.collect_list(F.struct("token", "place", "n", "bits")).alias("rows"))  # a prefix at most
    width = 2 * REACH + 1

    def narrow(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, c, own = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            token, place, often, bits = (lists.flatten().field(i).to_numpy() for i in range(4))
            row = np.repeat(np.arange(len(counts)), counts)
            flags = (bits[:, None] >> np.arange(width)) & 1 > 0
            starts = np.cumsum(counts) - counts
            has = np.add.reduceat(flags.astype(np.int64), starts)
            need = _least_common((place >> 32)[starts], own)
            flags &= (has >= need)[row]
            if not last:
                some = flags.any(1)
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (token, key[row], c[row], own[row], place)], ["token", "key", "c", "class", "place"])
                continue
            for k in range(width):
                some = np.flatnonzero(flags[:, k])
                if not len(some):
                    continue
                some = some[np.lexsort((token[some], often[some], row[some]))]
                of = row[some]
                heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                rank = np.arange(len(of)) - np.repeat(heads, np.diff(np.r_[heads, len(of)]))
                some = some[rank < has[of, k] - need[of, k] + 1]
                of, to = row[some], own[row[some]] + k - REACH
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token[some], key[of], c[of], own[of], place[some], np.minimum(own[of], to), np.maximum(own[of], to), need[of, k])], ["token", "key", "c", "class", "place", "lower", "upper", "need"])

    return map_arrow(each, narrow, _ROWS + (", lower long, upper long, need long" if last else ""))


def near_duplicates(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; component_id is the least doc_id that links reach."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keep, known = Stage(spark), docs.where("doc_id is not null")
    levels = sketch(known, n)
    sets = keep.write(_prefixes(docs, levels, n), "sets")
    classes = sets.where("doc_id is not null and key is not null").groupBy("key", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    classes = keep.write(classes, "classes")

    places = _places(sets)
    repeated = places.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("token")
    shared = places.join(repeated, "token").groupBy("key").agg(F.collect_set(F.struct("token", "place")).alias("rows"))  # a prefix at most
    # The hub of a group of near copies is the set whose prefix is shared most: edits make shingles of their own, and rare ones come first.
    size = F.shiftright(F.col("rows")[0]["place"], 32)
    shared = keep.write(shared.select("key", "rows", (F.size("rows") / (size - _rest(F.col("rows")[0]["place"]))).alias("common")), "shared")
    slim = keep.write(sets.select("doc_id", "n_shingles", "key"), "slim")
    keep.drop("sets")

    flat = shared.select("key", "common", F.inline("rows"))
    first = flat.groupBy("token").agg(F.max(F.struct("common", "key", "place")).alias("hub")).select("token", F.col("hub.key").alias("a"), F.col("hub.place").alias("x"))
    star = flat.select("token", F.col("key").alias("b"), F.col("place").alias("y")).join(first, "token").where("a <> b").where(_bounds("x", "y"))
    # Pairs with a third of what a link needs are measured, too: what a set has of the hub tells what it can share with the others.
    star = keep.write(_enough(star, part=3), "star")
    reps = classes.select("key", "rep")
    met = _verified(star, reps, known, n, keep, "links-1", spark.sparkContext.broadcast(levels), shared)
    one, hubs = met.where("ok"), _hubs(met)
    found = components(spark, one.select(F.col("x").alias("a"), F.col("y").alias("b")), keep, "round-1").withColumnRenamed("id", "key")

    placed = shared.select("key", "rows").join(found, "key", "left").select("key", F.coalesce("component", "key").alias("c"), F.inline("rows"))
    placed = placed.withColumn("class", F.floor(F.log(F.shiftright("place", 32).cast("double")) / float(np.log(STEP))).cast("long")).select("token", "key", "c", "class", "place")
    placed = keep.write(_narrowed(placed, False), "narrowed-1")
    placed = keep.write(_narrowed(placed, True), "narrowed-2")
    keep.drop("shared")
    keep.drop("narrowed-1")
    placed = placed.join(hubs, "key", "left")
    on, own = ["token", "lower", "upper"], ["c", "need", "hub", *_MEASURES]
    x = placed.where("class = lower").select(*on, F.col("key").alias("a"), F.col("place").alias("x"), *(F.col(k).alias(f"x{k}") for k in own))
    y = placed.where("class = upper").select(*on, F.col("key").alias("b"), F.col("place").alias("y"), *(F.col(k).alias(f"y{k}") for k in own))
    near = F.coalesce(F.col("xhub") != F.col("yhub"), F.lit(True)) | (_most_common() * (OF + SHARE) >= SHARE * (F.shiftright("x", 32) + F.shiftright("y", 32)))
    cross = x.join(y, on).where("xc <> yc and (lower < upper or a < b)").where(_bounds("x", "y")).where(near).select("a", "b", "x", "y", "xneed", "yneed")
    # The join lacks the last need - 1 tokens of either second prefix: common ones beyond the one that ends first are fewer than the larger need.
    cross = _enough(cross, "greatest(xneed, yneed) - 1")
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = keep.write(cross.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "cross")
    keep.drop("narrowed-2")
    two = _verified(cross, reps, known, n, keep, "links-2")

    several = slim.where("doc_id is not null and key is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id")
    same = slim.join(several, "doc_id").join(classes, ["key", "n_shingles"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = one.select("a", "b").unionByName(two.select("a", "b")).unionByName(same)
    joined = components(spark, links, keep, "round-2").withColumnRenamed("id", "rep")
    named = classes.join(joined, "rep", "left").select("key", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = slim.join(named, ["key", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """The documents, all columns, but for those whose component has a lesser doc_id; a repeated row stays once per row."""
    found = near_duplicates(docs, n).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 3), ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS m FROM r GROUP BY doc_id) c USING (doc_id)
"""
