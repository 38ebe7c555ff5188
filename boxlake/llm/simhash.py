"""Operator 5: SimHash near-dedup by a binary-trie self-join.

Fingerprints are the bit-wise majority of the XXH64 of word shingles. Two
fingerprints at two or fewer differing bits agree on two of four 16-bit
blocks, so in one of six block orders they lie below the same trie node at
depth 32. Such a node's members are joined with themselves: node pairs are
walked down together, differing bits add up, and a pair of nodes is dropped
once the budget is spent. A node with very many members is first split, in
Spark, into pairs of its children whose next eight bits differ by no more
than the budget, so no task gets an unbounded node. Each node returns a
forest over its linked members, which keeps all components.

Equal fingerprints are one vertex, however many documents have them. Null
and empty texts have fingerprint zero and are linked like any other; a null
doc_id takes part and gets its component's smallest id. Repeated rows give
repeated result rows. Very long texts are hashed whole, in memory of one text's
words; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, words_of
from .components import connected_components

SEED, BITS = 42, 64
#: Members of a trie node above which it is split in Spark.
NODE_MEMBERS = 2000
#: Block orders: the two leading of four 16-bit blocks.
ORDERS = [(a, b, *(c for c in range(4) if c not in (a, b))) for a in range(4) for b in range(a + 1, 4)]


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; of the whole sequence if shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, hash64, n = b" ".join(words), xxhash.xxh64_intdigest, max(1, len(words) - k + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[min(k, len(words)) - 1 :].tolist()
    return np.array([hash64(joined[a:b], SEED) for a, b in zip(starts, last)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is one if it is one in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([majority(shingle_hashes(words_of(t, lower=True), shingle)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, fp long")


def trie_pairs(values: list[int], bits: int, budget: int) -> Iterator[tuple[int, int]]:
    """Positions of all pairs of sorted ``values`` that differ in at most ``budget`` of the low ``bits``."""
    stack = [(0, len(values), 0, len(values), bits, budget, 0, 0)]
    while stack:
        lo, hi, lo2, hi2, bit, left, base, base2 = stack.pop()
        if lo == hi or lo2 == hi2 or (base == base2 and hi - lo < 2):
            continue
        if bit == 0 or (hi - lo) * (hi2 - lo2) <= 16:
            for i in range(lo, hi):
                for j in range(max(lo2, i + 1), hi2):
                    if (values[i] ^ values[j]).bit_count() <= budget:
                        yield i, j
            continue
        bit -= 1
        half, half2 = base | 1 << bit, base2 | 1 << bit
        mid = bisect_left(values, half, lo, hi)
        if base == base2:
            stack += [(lo, mid, lo, mid, bit, left, base, base), (mid, hi, mid, hi, bit, left, half, half)]
            if left:
                stack.append((lo, mid, mid, hi, bit, left - 1, base, half))
            continue
        mid2 = bisect_left(values, half2, lo2, hi2)
        stack += [(lo, mid, lo2, mid2, bit, left, base, base2), (mid, hi, mid2, hi2, bit, left, half, half2)]
        if left:
            stack += [(lo, mid, mid2, hi2, bit, left - 1, base, half2), (mid, hi, lo2, mid2, bit, left - 1, half, base2)]


def forest(values: list[int], budget: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that connect all of ``values`` that the trie self-join connects."""
    values = sorted(set(values))
    top = list(range(len(values)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for i, j in trie_pairs(values, bits, budget):
        a, b = root(i), root(j)
        top[max(a, b)] = min(a, b)
    return [(values[root(i)], v) for i, v in enumerate(values) if root(i) != i]


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _below(order: int, fp: Column, depth: int) -> Column:
    """Bits 8*depth.. of what lies below the node at depth 32 in the given order."""
    third, fourth = ORDERS[order][2:]
    return F.shiftrightunsigned(_block(fp, third if depth < 2 else fourth), 8 * (1 - depth % 2)).bitwiseAND(F.lit(0xFF))


def links(distinct: DataFrame, budget: int = 2, members: int = NODE_MEMBERS) -> DataFrame:
    """(a, b): fingerprints of ``distinct`` (column fp) linked at ``budget`` <= 2 or fewer differing bits, as node forests."""
    if not 0 <= budget <= 2:
        raise ValueError("four blocks serve at most two differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [p for group in b.column(0).to_pylist() for p in forest([v & (1 << 64) - 1 for v in group], budget)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*pairs)], names=["a", "b"])

    fp = F.col("fp")
    node = F.explode(F.array(*(F.struct(F.lit(i).alias("order"), (F.shiftleft(_block(fp, o[0]), 16).bitwiseOR(_block(fp, o[1]))).cast("string").alias("path")) for i, o in enumerate(ORDERS))))
    nodes = distinct.select("fp", node.alias("node")).select("fp", "node.order", "node.path")
    found: DataFrame | None = None
    near = [[x ^ m for m in range(256) if m.bit_count() <= budget] for x in range(256)]
    for depth in range(5):
        # Depth 4 is a leaf: two distinct fingerprints of one order never share it unless within the budget.
        full = nodes.groupBy("order", "path").agg(F.count("*").alias("n")).where(F.col("n") > members)
        last = depth == 4 or full.isEmpty()
        here = nodes if last else nodes.join(full, ["order", "path"], "left_anti")
        groups = here.groupBy("order", "path").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        out = map_batches(groups.select("fps"), run, "a long, b long")
        found = out if found is None else found.unionByName(out)
        if last:
            break
        byte = F.coalesce(*(F.when(F.col("order") == o, _below(o, fp, depth)) for o in range(len(ORDERS)))).cast("int")
        mates = F.array(*(F.array(*map(F.lit, row)) for row in near))
        split = nodes.join(full, ["order", "path"], "left_semi").withColumn("x", byte).withColumn("y", F.explode(F.get(mates, F.col("x"))))
        nodes = checkpointed(split.select("fp", "order", F.concat_ws("/", "path", F.least("x", "y"), F.greatest("x", "y")).alias("path")))
    return found


def simhash_dedup(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    rows = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(links(distinct, budget))
    vertex = distinct.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = vertex.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = vertex.join(least, "label").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(texts: dict[int, str | None], shingle: int = 3, budget: int = 2) -> dict[int, tuple[str, int]]:
    """doc_id -> (fingerprint, component_id) by comparing all pairs, for tests."""
    fp = {d: majority(shingle_hashes(words_of(t, lower=True), shingle)) for d, t in texts.items()}
    top = {d: d for d in fp}

    def root(d: int) -> int:
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= budget:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: (f"{fp[d]:016x}", root(d)) for d in ids}
