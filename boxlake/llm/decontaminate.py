"""Operator 9: benchmark decontamination by containment.

Items are grouped by their number of distinct five-word shingles, one group
for each power of two. An item's sketch is its least XXH64 values, as many as
its group's upper size needs: if a document holds 80 % of the shingles, it
misses at most a fifth, so of a fifth and one more it must hold at least one.
A document looks up its shingles in the sketches of the groups it is long
enough for; each hit names an item, whose containment is then counted over
exact shingles of the whole document. No leak at or above the threshold is
lost, whatever the document's length.

Items of up to :data:`INDEX_WORDS` words together are sent to all tasks as one
index, and documents are read once. Beyond, nothing is broadcast: documents'
shingle hashes are joined with the sketches, and each candidate's text with
lists of its items (:data:`LIST`); documents are then read twice, however many
items there are. Both ways give the same rows.

Words are runs of characters other than ASCII white space, A-Z lower-cased.
An item of one to four words is one shingle of that length. Null and empty
items match nothing, null and empty documents hold nothing. Very long
documents and items are taken whole. Repeated rows on either side give
repeated results; a null id stays null. With an empty table on either side
nothing leaks. Other columns are ignored by :func:`leaks` and kept by
:func:`without_leaks`, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, checkpointed, free_name, map_batches, prepare, words_of
from .simhash import SEED, shingle_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Words of all items up to which they are one index in every task (some MB).
INDEX_WORDS = 500_000
#: Beyond, a document's text moves once for about so many candidate items.
LIST = 500
_FOUND = "array<struct<item_id: bigint, n_shared: int, n_item: int>>"


def shingles(words: list[bytes], k: int = SHINGLE) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]


def needed(size: int, threshold: float) -> int:
    """Least number of shared shingles."""
    return max(1, int(np.ceil(threshold * size - 1e-9)))


def sketch(own: frozenset[bytes], threshold: float) -> list[int]:
    """The item's least hashes, so many that its size group's largest item could not miss them all."""
    upper = 1 << (len(own) - 1).bit_length()
    return sorted(xxhash.xxh64_intdigest(s, SEED) for s in own)[: upper - needed(upper, threshold) + 1]


class ItemIndex:
    """Sketches of items, by shingle length and size group."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float):
        self.threshold = threshold
        self.sets: list[tuple[int, frozenset[bytes]]] = []
        groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text, lower=True)
            if not words:
                continue
            own = frozenset(shingles(words))
            groups[min(len(words), SHINGLE), (len(own) - 1).bit_length()].append(len(self.sets))
            self.sets.append((item_id, own))
        self.groups = []
        for (k, _), members in sorted(groups.items()):
            held, every = defaultdict(list), set()
            least = min(needed(len(self.sets[i][1]), threshold) for i in members)
            for i in members:
                every.update(xxhash.xxh64_intdigest(s, SEED) for s in self.sets[i][1])
                for h in sketch(self.sets[i][1], threshold):
                    held[h].append(i)
            keys = np.array(sorted(held), np.uint64)
            self.groups.append((k, least, keys, [held[int(h)] for h in keys], np.array(sorted(every), np.uint64)))

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shared, size) of all items contained in ``text``."""
        words, out = words_of(text, lower=True), []
        hashes: dict[int, np.ndarray] = {}
        for k, least, keys, items, every in self.groups:
            if len(words) - k + 1 < least:
                continue
            if k not in hashes:
                hashes[k] = shingle_hashes(words, k)
            hit = np.unique(_found(hashes[k], keys))
            if not len(hit):
                continue
            at = np.flatnonzero(_member(hashes[k], every)).tolist()
            mine = {b" ".join(words[i : i + k]) for i in at}
            for i in sorted({i for h in hit for i in items[h]}):
                item_id, own = self.sets[i]
                shared = len(own & mine)
                if shared >= needed(len(own), self.threshold):
                    out.append((item_id, shared, len(own)))
        return out


def _member(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return keys[at] == x


def _found(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in ``keys`` of the members of ``x``."""
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return at[keys[at] == x]


def _items(items: DataFrame) -> tuple[DataFrame, int]:
    """item_id and text of the items with words, and how many words they have."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    return items, items.agg(F.sum(F.size(F.split("text", WORD_GAP)).cast("long"))).first()[0] or 0


def contained_items(text: Column, items: list[tuple[int, str]], threshold: float = THRESHOLD) -> Column:
    """Array of those of the given items that a text contains."""
    index: list[ItemIndex] = []

    @F.pandas_udf(_FOUND)
    def search(texts: pd.Series) -> pd.Series:
        if not index:
            index.append(ItemIndex(items, threshold))
        return pd.Series([[{"item_id": i, "n_shared": s, "n_item": n} for i, s, n in index[0].search(None if t is None or t != t else t)] for t in texts], dtype=object)

    return search(text)


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))


def _joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """doc_id, key and the found items, by a join of shingle hashes with sketches."""
    items = checkpointed(items.withColumn("item", F.monotonically_increasing_id()))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text, lower=True)
                if words:
                    held = np.array(sketch(frozenset(shingles(words)), threshold), np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([min(len(words), SHINGLE)] * len(held), pa.int32()), pa.array(held), pa.array([item] * len(held), pa.int64())], names=["k", "hash", "item"])

    asked = checkpointed(map_batches(items.select("item", "text"), sketches, "k int, hash long, item long"))
    lengths = sorted(r.k for r in asked.select("k").distinct().collect())  # 1 to 5

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text, lower=True)
                for k in lengths:
                    if len(words) >= k:
                        own = np.unique(shingle_hashes(words, k)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.int64()), pa.array([k] * len(own), pa.int32()), pa.array(own)], names=["key", "k", "hash"])

    held = map_batches(_keyed(docs).select("key", "text"), hashed, "key long, k int, hash long")
    pairs = checkpointed(held.join(asked, ["k", "hash"]).select("key", "item").distinct())
    # A document meets its items in lists of about LIST, so its text moves once for so many.
    lists = pairs.groupBy("key").agg(F.ceil(F.count("*") / LIST).alias("lists"))
    wanted = pairs.join(lists, "key").join(items.select("item", F.struct("item_id", "text").alias("entry")), "item")
    wanted = wanted.groupBy("key", F.pmod(F.xxhash64("item"), F.col("lists")).alias("list")).agg(F.collect_list("entry").alias("entries"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, key, text, entries in zip(*(b.column(i).to_pylist() for i in range(4))):
                words, own, out = words_of(text, lower=True), {}, []
                for entry in entries:
                    item = words_of(entry["text"], lower=True)
                    k, item = min(len(item), SHINGLE), frozenset(shingles(item))
                    if k not in own:
                        own[k] = frozenset(shingles(words, k)) if len(words) >= k else frozenset()
                    shared = len(item & own[k])
                    if shared >= needed(len(item), threshold):
                        out.append((doc_id, key, entry["item_id"], shared, len(item)))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.int32()) for c in cols[3:])], names=["doc_id", "key", "item_id", "n_shared", "n_item"])

    met = _keyed(docs, "doc_id").join(wanted, "key").select(F.col("doc_id").cast("long"), "key", "text", "entries")
    return map_batches(met, verified, "doc_id long, key long, item_id long, n_shared int, n_item int")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, index_words: int = INDEX_WORDS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every contained item."""
    prepare(docs.sparkSession)
    items, words = _items(items)
    if words <= index_words:
        rows = [(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()]
        found = docs.select("doc_id", F.explode(contained_items(F.col("text"), rows, threshold)).alias("f")).select("doc_id", "f.*")
    else:
        found = _joined(docs, items, threshold)
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, index_words: int = INDEX_WORDS) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    prepare(docs.sparkSession)
    items, words = _items(items)
    if words <= index_words:
        rows = [(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()]
        return docs.where(F.size(contained_items(docs["text"], rows, threshold)) == 0)
    key, own = free_name("_key", docs.columns), free_name("_id", docs.columns)
    gone = _joined(docs, items, threshold).select(F.col("key").alias(f"{key}_gone"), F.col("doc_id").alias(f"{own}_gone")).distinct()
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text")).withColumn(own, F.col("doc_id").cast("long"))
    same = (keyed[key] == gone[f"{key}_gone"]) & keyed[own].eqNullSafe(gone[f"{own}_gone"])
    return keyed.join(gone, same, "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
with dw as (
  select row_number() over () as r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
iw as (
  select row_number() over () as i, item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from benchmark),
ish as (
  select distinct i, item_id, least(len(w), 5) as k, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p:p + 4], ' '))) as s
  from iw where len(w) > 0),
isz as (select i, count(*) as n_item from ish group by i),
ks as (select distinct k from ish),
dsh as (
  select distinct r, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) as s
  from dw, ks where len(w) >= k),
hit as (
  select d.r, d.doc_id, s.i, s.item_id, count(*) as n_shared
  from dsh d join ish s on d.k = s.k and d.s = s.s group by d.r, d.doc_id, s.i, s.item_id)
select doc_id, item_id, cast(n_shared as int) as n_shared, cast(n_item as int) as n_item, n_shared / n_item as containment
from hit join isz using (i) where n_shared >= ceil(0.8 * n_item - 1e-9)
"""
