"""Operator 3: removal of repeated token windows.

Every window of 35 words gets a Rabin-Karp hash over keyed hashes of its
words. Windows are dealt to buckets by a key of their own content, the least
hash of the six-word runs inside them, so that neighbouring windows mostly
stay together and travel as one run: key, document, start, and eight bytes for
each window. A bucket's windows are counted by (key, hash), 126 bits together;
those seen twice go back to their documents and merge into maximal removal
intervals. Words are not compared again: key and bases are drawn anew for each
result, so no input can be made to collide (:class:`Hasher`).

A window that repeats inside one batch of a map task is settled there and
shuffled once, so a passage that a third of all documents share costs its
bucket one entry for each batch of a map task, not one for each document.
Windows that differ but share a frequent phrase have one key: keys that, by a
sample of rows, have more than :data:`HOT_WINDOWS` windows are replaced by the
window's own hash in every task, so equal windows still meet and no key fills
a bucket.

Words are runs of characters other than ASCII white space, unchanged. Null
and empty texts, and texts of fewer than 35 words, lose nothing. Repeated
rows repeat each other's windows, so both are cut. An empty table gives an
empty result. Very long texts are taken whole, in memory of one text's
windows. Other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, words_of

WINDOW, KEY_WORDS = 35, 6
#: A map task hashes so many bytes at a time and sends after so many windows.
HASH_BYTES, SEND_WINDOWS = 1 << 20, 1_200_000
BUCKETS_PER_PARTITION = 4
#: Keys of more windows are dealt out by the windows' hashes; judged by about so many rows.
HOT_WINDOWS, SAMPLE_ROWS = 500_000, 20_000

_U = np.uint64
#: Prime of the windows' two polynomial hashes.
PRIME = (1 << 31) - 1
#: Bytes whose words are hashed at once, and the longest word that is hashed so.
STRETCH, LONG_WORD = 1 << 20, 64
_SPACES = [bytes([i]) for i in (32, *range(9, 14))]
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _folded(x: np.ndarray) -> np.ndarray:
    """A value below 2**32 that is ``x`` modulo :data:`PRIME`, for ``x`` below 2**63."""
    return (x & _U(PRIME)) + (x >> _U(31))


class Polynomial:
    """Rabin-Karp hash by prefix sums, with its tables of powers; modulo 2**64, or modulo :data:`PRIME`."""

    def __init__(self, base: int, prime: bool):
        self.prime, self.base, self.inverse = prime, base, pow(base, -1, PRIME if prime else 1 << 64)
        self.power = self.back = np.ones(1, _U)

    def _grown(self, table: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(table) < n:
            step = table * _U(pow(base, len(table), PRIME if self.prime else 1 << 64))
            table = np.concatenate([table, _folded(_folded(step)) if self.prime else step])
        return table

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.power, self.back = self._grown(self.power, self.base, len(values)), self._grown(self.back, self.inverse, len(values) + 1)
        out = np.zeros(len(values) + 1, _U)
        terms = values * self.power[: len(values)]
        np.cumsum(_folded(_folded(terms)) if self.prime else terms, out=out[1:])
        return out

    def between(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every stretch from a start to an end, whatever its place; modulo :data:`PRIME`."""
        x = _folded(_folded(_folded(_folded(prefix[ends] - prefix[starts])) * self.back[starts]))
        return np.where(x >= PRIME, x - _U(PRIME), x)

    def spans(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hash of every ``width`` neighbours, whatever their place."""
        sums = prefix[width:] - prefix[:-width]
        if not self.prime:
            return mixed(sums * self.back[: len(sums)])
        x = _folded(_folded(_folded(_folded(sums)) * self.back[: len(sums)]))
        return np.where(x >= PRIME, x - _U(PRIME), x)


class Hasher:
    """Keyed 64-bit hashes of words, and hashes of word runs; every base is drawn from the seed.

    A word's hash mixes three polynomials over its bytes modulo a prime, for
    all words of a stretch of text at once; words beyond :data:`LONG_WORD`
    bytes have a keyed digest. Two different windows agree in their window
    hash with a chance of about 2**-62 whatever their words are, as neither
    the key nor the bases are known beforehand; beside it they would have to
    agree in their key. A key has HOT_WINDOWS windows at most, so even if all
    keys had as many, less than one false pair is to be expected in 10**13
    windows.
    """

    def __init__(self, seed: bytes, window: int):
        self.seed, self.window = seed, window
        draw = np.random.default_rng(int.from_bytes(seed, "little"))
        self.runs, self.deal = (Polynomial(int(draw.integers(1 << 62)) * 2 + 1, False) for _ in range(2))
        self.fields = [Polynomial(int(draw.integers(2, PRIME)), True) for _ in range(2)]
        self.letters = [Polynomial(int(draw.integers(2, PRIME)), True) for _ in range(3)]
        self.odd = [_U(int(x) * 2 + 1) for x in draw.integers(1 << 62, size=2)]

    def _digest(self, word: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.seed).digest(), "little")

    def _stretch(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        letters = np.frombuffer(raw, np.uint8)
        edges = np.flatnonzero(np.diff(_GAP[letters], prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        values = letters.astype(_U) + _U(1)
        a, b, c = (f.between(f.prefix(values), starts, ends) for f in self.letters)
        out = mixed(mixed((a | b << _U(32)) * self.odd[0]) ^ c * self.odd[1])
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            out[i] = self._digest(raw[starts[i] : ends[i]])
        return out, starts

    def text(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of every word of a text, a stretch of :data:`STRETCH` bytes at a time."""
        found, at = [], 0
        while at < len(raw):
            end = len(raw)
            if end - at > STRETCH + LONG_WORD:
                gap = _SPACE.search(raw, at + STRETCH)
                end = gap.start() if gap else len(raw)
                if end - at > STRETCH + LONG_WORD:  # a long word lies across
                    word = max(raw.rfind(x, at, at + STRETCH) for x in _SPACES)
                    if word < at:
                        word = at - 1
                    found += [self._stretch(raw[at : word + 1]), (np.array([self._digest(raw[word + 1 : end])], _U), np.array([word + 1]))]
                    found[-2] = found[-2][0], found[-2][1] + at
                    at = end
                    continue
            hashes, starts = self._stretch(raw[at:end])
            found.append((hashes, starts + at))
            at = end
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, _U), np.zeros(0, np.int64))

    def words(self, words: list[bytes]) -> np.ndarray:
        return self.text(b" ".join(words))[0]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Least hash of the six-word runs inside every window."""
        return sliding_min(self.runs.spans(self.runs.prefix(words), KEY_WORDS), self.window - KEY_WORDS + 1)

    def windows(self, words: np.ndarray) -> np.ndarray:
        """Hash of every window: 62 bits modulo a prime, spread over 64."""
        a, b = (f.spans(f.prefix(words >> _U(shift) & _U(PRIME)), self.window) for f, shift in zip(self.fields, (0, 32)))
        return mixed(a | b << _U(31))

    def dealt(self, words: np.ndarray) -> np.ndarray:
        """Another hash of every window, by which windows of frequent keys are dealt out."""
        return self.deal.spans(self.deal.prefix(words), self.window)


def fresh_seed() -> bytes:
    return os.urandom(16)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    more = width - have
    return np.minimum(out[:-more], out[more:]) if more else out


def _runs(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of maximal runs over which all arrays stay as they are."""
    n = len(same[0])
    cut = np.zeros(n, bool)
    cut[:1] = True
    for x in same:
        cut[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(cut)
    return starts, np.diff(starts, append=n)


def _pack(keys, rows, starts, counts, hashes) -> bytes:
    return np.array([len(keys)], "<u4").tobytes() + keys.tobytes() + rows.tobytes() + starts.astype("<u4").tobytes() + counts.astype("<u2").tobytes() + hashes.astype("<u8").tobytes()


def _unpack(payload: bytes):
    n = int(np.frombuffer(payload, "<u4", 1)[0])
    keys, rows = np.frombuffer(payload, "<u8", n, 4), np.frombuffer(payload, "<i8", n, 4 + 8 * n)
    starts, counts = np.frombuffer(payload, "<u4", n, 4 + 16 * n), np.frombuffer(payload, "<u2", n, 4 + 20 * n)
    return keys, rows, starts, counts, np.frombuffer(payload, "<u8", offset=4 + 22 * n)


def _intervals(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch | None:
    """Runs of neighbouring windows as (row, start, n)."""
    if not len(rows):
        return None
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order].astype(np.int64)
    at, n = _runs(rows, starts - np.arange(len(starts)))
    return pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(starts[at].astype(np.int32)), pa.array(n.astype(np.int32))], names=["row", "start", "n"])


def hashed(hasher: Hasher, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Hashes of the words of all texts, one after another, and how many words each text has."""
    hashes, starts = hasher.text(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0).tolist()


class _Sender:
    """Collects the windows of a map task and packs them by bucket."""

    def __init__(self, n_buckets: int, hasher: Hasher, hot: np.ndarray):
        self.n_buckets, self.hasher, self.hot = n_buckets, hasher, hot
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, texts: list[tuple[int, bytes]]) -> None:
        """Hashes run over all texts at once; windows across two texts are left out."""
        h = self.hasher
        hashes, counts = hashed(h, [raw for _, raw in texts])
        if len(hashes) < h.window:
            return
        keys, found = h.keys(hashes), h.windows(hashes)
        if len(self.hot):
            many = self.hot[np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)] == keys
            if many.any():
                keys[many] = mixed(keys[many] ^ h.dealt(hashes)[many])
        at = 0
        for (row, _), words in zip(texts, counts):
            if (n := words - h.window + 1) > 0:
                self.parts.append((keys[at : at + n], found[at : at + n], row, n))
                self.held += n
            at += words

    def packed(self) -> Iterator[tuple[int, bytes]]:
        if not self.parts:
            return
        keys, hashes = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
        rows = np.repeat(np.array([p[2] for p in self.parts], "<i8"), [p[3] for p in self.parts])
        starts = np.concatenate([np.arange(p[3], dtype=np.uint32) for p in self.parts])
        self.parts, self.held = [], 0
        # Windows that repeat in here: all are settled, the first goes on to be met elsewhere.
        order = np.argsort(hashes, kind="stable")
        x, k = hashes[order], keys[order]
        again = np.zeros(len(x), bool)
        again[1:] = (x[1:] == x[:-1]) & (k[1:] == k[:-1])
        settled = again.copy()
        settled[:-1] |= again[1:]
        done = _intervals(rows[order[settled]], starts[order[settled]])
        keep = np.ones(len(x), bool)
        keep[order[again]] = False
        keys, hashes, rows, starts = keys[keep], hashes[keep], rows[keep], starts[keep]
        at, n = _runs(keys, rows, starts.astype(np.int64) - np.arange(len(starts)))
        over = np.flatnonzero(n > 65535)  # counts have two bytes
        if len(over):
            cut = np.concatenate([at, *(np.arange(at[i] + 65535, at[i] + n[i], 65535) for i in over)])
            at = np.sort(cut)
            n = np.diff(at, append=len(keys))
        bucket = (mixed(keys[at]) % _U(self.n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            runs = by[a:b]
            inside = np.repeat(at[runs] - (np.cumsum(n[runs]) - n[runs]), n[runs]) + np.arange(n[runs].sum())
            yield int(bucket[by[a]]), b"W" + _pack(keys[at[runs]], rows[at[runs]], starts[at[runs]], n[runs], hashes[inside])
        if done is not None:  # any bucket will do: it only passes them on
            step = max(1, -(-done.num_rows // self.n_buckets))
            first = int(mixed(keys[:1])[0] % _U(self.n_buckets)) if len(keys) else 0
            for i in range(0, done.num_rows, max(step, 4096)):
                part = done.slice(i, max(step, 4096))
                yield (first + i // max(step, 4096)) % self.n_buckets, b"D" + b"".join(np.ascontiguousarray(c.to_numpy()).tobytes() for c in part.columns)


def _send(n_buckets: int, window: int, seed: bytes, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(n_buckets, Hasher(seed, window), hot)

        def out():
            for bucket, payload in sender.packed():
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "payload"])

        held, size = [], 0
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    held.append((row, text.encode("utf-8", "surrogatepass")))
                    size += len(text)
                    if size >= HASH_BYTES:
                        sender.add(held)
                        held, size = [], 0
                        if sender.held >= SEND_WINDOWS:
                            yield from out()
        if held:
            sender.add(held)
        yield from out()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows seen twice, bucket by bucket; the rows come sorted by bucket."""

    def counted(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(payloads) < 2:
            return
        parts = [_unpack(p) for p in payloads]
        keys, rows, starts, counts, hashes = (np.concatenate([p[i] for p in parts]) for i in range(5))
        del parts
        run = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
        both = mixed(keys)[run] ^ hashes * _U(0x2545F4914F6CDD1D)
        order = np.argsort(both)
        x, k, h = both[order], keys[run[order]], hashes[order]
        again = np.zeros(len(x) + 1, bool)
        again[1:-1] = (x[1:] == x[:-1]) & (k[1:] == k[:-1]) & (h[1:] == h[:-1])
        seen = order[again[1:] | again[:-1]]
        first = np.cumsum(counts, dtype=np.int64) - counts
        out = _intervals(rows[run[seen]], starts[run[seen]] + (seen - first[run[seen]]))
        if out is not None:
            yield out

    bucket, held = None, []
    for b in batches:
        for key, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if key != bucket:
                yield from counted(held)
                bucket, held = key, []
            if payload[:1] == b"W":
                held.append(payload[1:])
            else:
                n = (len(payload) - 1) // 16
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(payload, "<i8", n, 1)), pa.array(np.frombuffer(payload, "<i4", n, 1 + 8 * n)), pa.array(np.frombuffer(payload, "<i4", n, 1 + 12 * n))], names=["row", "start", "n"])
    yield from counted(held)


def hot_keys(rows: DataFrame, window: int, seed: bytes) -> np.ndarray:
    """Sorted keys of more than :data:`HOT_WINDOWS` windows, by a sample; any set of keys gives the same result."""
    step = -(-rows.select("row").count() // SAMPLE_ROWS) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(seed, window)
        for b in batches:
            for text in b.column(0).to_pylist():
                words = hasher.text((text or "").encode("utf-8", "surrogatepass"))[0]
                if len(words) >= window:
                    keys, n = np.unique(hasher.keys(words), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    found = map_batches(rows.where(F.pmod(F.col("row"), F.lit(step)) == 0).select("text"), run, "key long, n long")
    many = found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * step > HOT_WINDOWS).select("key").collect()
    return np.sort(np.array([r.key for r in many], np.int64).view(_U))


def repeated_windows(rows: DataFrame, window: int = WINDOW, seed: bytes | None = None) -> DataFrame:
    """``rows`` has row (long) and text; gives runs (row, start, n) of repeated windows.

    Without ``seed`` the hashes are drawn anew; all tasks of this result share them.
    """
    spark = rows.sparkSession
    seed = seed or fresh_seed()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = map_batches(rows.select("row", "text"), _send(parts * BUCKETS_PER_PARTITION, window, seed, hot_keys(rows, window, seed)), "bucket int, payload binary")
    dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return map_batches(dealt, _count, "row long, start int, n int")


def keep_words(words: list[bytes], runs: list[tuple[int, int]], window: int = WINDOW) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Words outside, and the maximal removal intervals themselves."""
    gone: list[tuple[int, int]] = []
    for start, end in sorted((s, s + n + window - 1) for s, n in runs):
        if gone and start <= gone[-1][1]:
            gone[-1] = (gone[-1][0], max(end, gone[-1][1]))
        else:
            gone.append((start, end))
    kept, at = [], 0
    for a, b in gone:
        kept += words[at:a]
        at = b
    return kept + words[at:], gone


def substring_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, ``kept`` (text) and ``removed`` (word intervals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, starts, ns in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                words = words_of(text)
                kept, gone = keep_words(words, list(zip(starts or (), ns or ())), window)
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), [list(g) for g in gone]))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.list_(pa.int32())))],
                names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    # A set: equal rows share their runs. So it's bounded by the windows of one document.
    found = repeated_windows(rows, window).groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    return map_batches(rows.join(found, "row", "left").select("doc_id", "text", F.col("runs.start").alias("starts"), F.col("runs.n").alias("ns")), run, "doc_id long, n_words long, n_removed long, kept string, removed array<array<int>>")


def digest(cut: DataFrame) -> DataFrame:
    """The contract's columns."""
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 of every text, for tests."""
    from collections import Counter

    words = [words_of(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        kept, _ = keep_words(w, [(i, 1) for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1], window)
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
