"""Near-duplicate groups by SimHash links and verification on whole shingle sets.

The pipeline's form of operator 5: groups of documents whose sets of
five-word shingles, as XXH64 hashes, have a Jaccard similarity of 0.8 or more.
Texts with equal shingle sets are one class. Between classes, candidates are the links of the
binary-trie self-join over SimHash fingerprints. Pairs at 0.8 differ in about
nine of 64 bits, which no trie walk can afford to allow for, so MinHash bands
add candidates (24 bands of 6: a pair at 0.8 is missed once in 1,400 times).
Every candidate is verified on the whole sets of hashes, and groups are the
connected components of what holds.

Classes that meet in a band are compared pairwise up to :data:`SMALL` of
them. In a larger meeting a first round compares each class with the
:data:`HUBS` classes that agree most with the whole and with the
:data:`NEAREST` classes that agree most with itself, by parts if there are
more than :data:`MEETING`. This only shrinks the work: a second round finds
every pair of such classes that is similar enough and not yet in one
component, by a prefix-filter join that also compares bitmaps
(:func:`prefix_candidates`) and loses nothing.

Texts without words, null ones included, are one class. Groups are of rows:
rows that repeat a doc_id with different texts may lie in different groups,
and each group keeps its row of the smallest doc_id. Rows that repeat doc_id
and text stay or go together. A row without doc_id always stays. Very long
texts are compared whole. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, map_batches, words_of
from .components import connected_components
from .simhash import links, majority, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
SMALL, HUBS, NEAREST, MEETING = 48, 12, 12, 4096
#: The second round deals out the classes of one shingle in parts of about so many.
BLOCK = 1024
#: Shingles are put in order by their counts in about so many classes, as far as the most frequent go.
SAMPLE_CLASSES, SAMPLE_SHINGLES = 20_000, 500_000
#: Keys of wanted classes are broadcast up to so many rows (some MB), and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
#: A set's bitmap in the second round, in words of 64 bits.
BITMAP_WORDS = 8
_WORDS = [f"w{i}" for i in range(BITMAP_WORDS)]
_RANDOM = np.random.default_rng(11)
_A = (_RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def signature(hashes: np.ndarray) -> list[bytes]:
    """Eight bytes for each band; distinct hashes in."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), 512):
        np.minimum(low, (small[at : at + 512, None] * _A + _B).min(axis=0), out=low)
    return [hashlib.blake2b(band.tobytes(), digest_size=8).digest() for band in low.reshape(BANDS, ROWS)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same, fps, bands, sets = [], [], [], []
        for t in b.column(2).to_pylist():
            hashes = shingle_hashes(words_of(t, lower=True), SHINGLE)
            distinct = np.unique(hashes)
            same.append(int.from_bytes(hashlib.blake2b(distinct.tobytes(), digest_size=8).digest(), "little", signed=True))
            fps.append(np.uint64(majority(hashes)).astype(np.int64))
            bands.append([int.from_bytes(x, "little", signed=True) for x in signature(distinct)] if len(distinct) else [])
            sets.append(distinct.tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(same, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
            names=["doc_id", "key", "class", "fp", "bands", "shingles"])


def _meeting(members: list[int], sketches: list[bytes]) -> set[tuple[int, int]]:
    """Pairs to verify among the classes of one meeting."""
    n = len(members)
    if n <= SMALL:
        return {(min(a, b), max(a, b)) for i, a in enumerate(members) for b in members[:i] if a != b}
    grid = np.frombuffer(b"".join(sketches), np.uint8).reshape(n, BANDS)
    common = np.array([Counter(c.tolist()).most_common(1)[0][0] for c in grid.T], np.uint8)
    hubs = np.argsort(-(grid == common).sum(1), kind="stable")[:HUBS].tolist()
    pairs = {(min(members[i], members[h]), max(members[i], members[h])) for h in hubs for i in range(n) if members[i] != members[h]}
    for at in range(0, n, 128):
        agree = (grid[at : at + 128, None, :] == grid[None]).sum(2, dtype=np.int16)
        agree[np.arange(len(agree)), np.arange(at, at + len(agree))] = -1
        for i, near in enumerate(np.argpartition(-agree, NEAREST, axis=1)[:, :NEAREST].tolist(), at):
            pairs.update((min(members[i], members[j]), max(members[i], members[j])) for j in near if members[i] != members[j])
    return pairs


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs as (a, b), and classes of large meetings as (a, null)."""

    def batch_of(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    a, b = [], []
    for batch in batches:
        for i in range(batch.num_rows):
            dealt, classes, sketches = (batch.column(c)[i].as_py() for c in range(3))
            for x, y in _meeting(classes, sketches):
                a.append(x), b.append(y)
            if dealt or len(classes) > SMALL:
                a += classes
                b += [None] * len(classes)
            if len(b) > 50_000:
                yield batch_of(a, b)
                a, b = [], []
    if b:
        yield batch_of(a, b)


def band_candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): classes that meet in a band; and ``class``: those of meetings that were not compared pair by pair."""
    sketch = F.unhex(F.concat(*(F.lpad(F.hex(F.pmod(F.col("bands")[i], F.lit(256))), 2, "0") for i in range(BANDS))))
    wide = classes.where(F.size("bands") == BANDS).select("class", sketch.alias("sketch"), F.posexplode("bands").alias("band", "value"))
    rows = wide.select("class", "sketch", F.xxhash64("band", "value").alias("meeting"))
    sizes = rows.groupBy("meeting").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    met = rows.join(sizes, "meeting").withColumn("salt", F.when(F.col("n") > MEETING, F.pmod(F.xxhash64("class"), F.ceil(F.col("n") * 2 / MEETING))).otherwise(F.lit(0)))
    groups = met.groupBy("meeting", "salt").agg(F.collect_list("class").alias("classes"), F.collect_list("sketch").alias("sketches"), F.max(F.col("n") > MEETING).alias("dealt"))
    found = checkpointed(map_batches(groups.where((F.size("classes") > 1) | F.col("dealt")).select("dealt", "classes", "sketches"), _meet, "a long, b long"))
    return found.where(F.col("b").isNotNull()), found.where(F.col("b").isNull()).select(F.col("a").alias("class")).distinct()


def shingle_sets(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """class, shingles of the classes in ``pairs``; no other sets are moved."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = checkpointed(classes.join(ends, "class", "left_semi").select("class", F.col("first").alias("doc_id")))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return checkpointed(rows.select("class", "doc_id", "shingles").join(wanted, ["class", "doc_id"], "left_semi").select("class", "shingles").dropDuplicates(["class"]))


def similar_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The candidate pairs whose shingle sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            m, n = len(p) // 8, len(q) // 8
            if min(m, n) < similarity * max(m, n):
                out.append(False)
                continue
            shared = len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
            out.append(shared >= similarity * (m + n - shared) - 1e-9)
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(similar("x", "y")).select("a", "b")


def _prefixes(frequent: np.ndarray, counts: np.ndarray, similarity: float):
    """Of each set the shingles that a similar set of its size or less shares one of: the rarest, in one order for all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, ns, sizes = [], [], []
            for raw in b.column(2).to_pylist():
                own = np.frombuffer(raw, np.uint64)
                n = len(own)
                count = np.zeros(n, np.int64)
                if len(frequent) and n:
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    count = np.where(frequent[at] == own, counts[at], 0)
                first = np.lexsort((own, count))[: n - int(np.ceil(similarity * n - 1e-6)) + 1]
                tokens.append(own[first]), ns.append(len(first)), sizes.append(n)
            if sum(ns):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.repeat(b.column(i).to_numpy(), ns)) for i in range(2)),
                     pa.array(np.repeat(np.array(sizes, np.int32), ns)), pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in ns]))],
                    names=["token", "class", "label", "size", "at"])

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set the parities of its shingles' numbers by slot: two sets differ in as many shingles as slots, or more."""
    slots = 64 * BITMAP_WORDS
    for b in batches:
        out = np.zeros((b.num_rows, BITMAP_WORDS), "<u8")
        for i, raw in enumerate(b.column(1).to_pylist()):
            slot = (np.frombuffer(raw, np.uint64) >> np.uint64(17)) % np.uint64(slots)
            odd = np.bincount(slot.astype(np.int64), minlength=slots) & 1
            out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(out[:, i]).view("<i8")) for i in range(BITMAP_WORDS))], names=["class", *_WORDS])


def prefix_candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of different labels that can be similar enough; ``sets`` has class, label, shingles.

    Sets of sizes m <= n with similarity t share t (m + n) / (1 + t) shingles
    or more. So in any common order of all shingles, some shingle is among the
    first m - 2 t m / (1 + t) + 1 of the smaller and the first n - t n + 1 of
    the larger set. The order, rare ones first by a sample, only bears on how
    many pairs come up. A shingle's classes are dealt out so that every two
    still meet in one part. Pairs that meet are not kept before their bitmaps
    are compared, where they meet: sets that differ in too many slots differ in
    too many shingles. So strangers of one template, which share most of their
    shingles, meet without ever becoming candidates; of sets of some thousand
    shingles, which fill a bitmap, it drops fewer.
    """
    n = sets.count()
    sample = sets.where(F.pmod(F.xxhash64("class"), F.lit(-(-n // SAMPLE_CLASSES) or 1)) == 0).select("shingles")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()] or [np.zeros(0, np.int64)]))], names=["token"])

    seen = map_batches(sample, exploded, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    known = seen.orderBy(F.desc("n"), "token").limit(SAMPLE_SHINGLES).toPandas()
    frequent, counts = known["token"].to_numpy(np.int64).view(np.uint64), known["n"].to_numpy(np.int64)
    order = np.argsort(frequent)
    rows = map_batches(sets.select("class", "label", "shingles"), _prefixes(frequent[order], counts[order], similarity), "token long, class long, label long, size int, at int")
    shared = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi"))
    maps = checkpointed(map_batches(sets.select("class", "shingles"), _bitmaps, "class long, " + ", ".join(f"{w} long" for w in _WORDS)))
    met = checkpointed(rows.join(shared.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "token"))
    part = F.pmod(F.xxhash64("class"), F.col("parts"))
    small = met.where(F.col("at") <= F.col("size") - F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("size") - 1e-6))
    small = small.select("token", part.cast("int").alias("part"), F.col("class").alias("a"), F.col("label").alias("la"), F.col("size").alias("m"), F.col("at").alias("i"))
    large = met.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("class").alias("b"), F.col("label").alias("lb"), F.col("size").alias("n"), F.col("at").alias("j"))
    ordered = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b")))
    most = F.least("i", "j") + 1 + F.least(F.col("m") - 1 - F.col("i"), F.col("n") - 1 - F.col("j"))
    enough = (F.col("m") >= similarity * F.col("n") - 1e-6) & (most >= F.lit(similarity / (1 + similarity)) * (F.col("m") + F.col("n")) - 1e-6)
    own, other = (maps.select(F.col("class").alias(c), *[F.col(w).alias(f"{c}{w}") for w in _WORDS]) for c in "ab")
    if n <= BROADCAST_ROWS:
        pairs = small.join(large, ["token", "part"]).where((F.col("la") != F.col("lb")) & ordered & enough).select("a", "b", "m", "n")
        pairs = pairs.join(F.broadcast(own), "a").join(F.broadcast(other), "b")
    else:  # bitmaps travel with the rows
        pairs = small.join(own, "a").join(large.join(other, "b"), ["token", "part"]).where((F.col("la") != F.col("lb")) & ordered & enough)
    apart = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in _WORDS), F.lit(0))
    close = apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("m") + F.col("n")) + 1e-6
    return pairs.where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key (a hash of the text) and component_id (smallest doc_id of the row's group) of every row with an id."""
    rows = checkpointed(map_batches(
        docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text")),
        _describe, "doc_id long, key long, class long, fp long, bands array<long>, shingles binary"))
    classes = checkpointed(rows.groupBy("class").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    by_fp = classes.groupBy("fp").agg(F.min("class").alias("class"))
    near = links(by_fp.select("fp"))
    ends = near.join(by_fp.select(F.col("fp").alias("a"), F.col("class").alias("ca")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("class").alias("cb")), "b")
    equal = classes.select("class", "fp").join(by_fp.withColumnRenamed("class", "cb"), "fp").select(F.col("class").alias("a"), F.col("cb").alias("b"))
    banded, crowded = band_candidates(classes)
    candidates = ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).unionByName(equal).unionByName(banded)
    pairs = checkpointed(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    sets = shingle_sets(rows, classes, pairs)
    labels = connected_components(similar_links(pairs, sets, similarity)).withColumnRenamed("v", "class")
    crowded = checkpointed(crowded.join(labels, "class", "left").select("class", F.coalesce("label", "class").alias("label")))
    n_crowded = crowded.count()
    member = classes.select("class", "first").join(labels, "class", "left").select("class", "first", F.coalesce("label", "class").alias("label"))
    if n_crowded:
        more = checkpointed(prefix_candidates(sets.join(F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded, "class"), similarity))
        a, b = (crowded.select(F.col("class").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        met = similar_links(more, sets, similarity).join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        joined = connected_components(met).select(F.col("v").alias("label"), F.col("label").alias("least"))
        member = member.join(joined, "label", "left").select("class", "first", F.coalesce("least", "label").alias("label"))
    least = member.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "key", "class").join(member.join(least, "label").select("class", "component_id"), "class").select("doc_id", "key", "component_id")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id of every row with an id."""
    return groups(docs, similarity).drop("key")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The first document of every group, with all its columns."""
    key = free_name("_key", docs.columns)
    gone = groups(docs, similarity).where(F.col("doc_id") != F.col("component_id")).select("doc_id", F.col("key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("text")).join(gone, ["doc_id", key], "left_anti").select(*docs.columns)
