"""Operator 2: byte-level BPE as a streaming transducer with bounded lookahead.

How far to the right a merge decision can depend on bytes not yet seen is a
property of the merge list alone (:func:`sufficient_lookahead`). Every piece
of a text, whatever its length, passes one buffer, which is merged by rank; a
token is emitted once it ends further than the lookahead from the buffer's
end, or once the piece ends. So what is held is bounded by the lookahead,
however long text and pieces are; ids go to their digest and to the decoder as
they come. Decoding feeds token bytes to an incremental UTF-8 state machine.
Behind the transducer, a memo of bounded bytes keeps the merges of buffer
contents that come again.

Null and empty texts give no tokens and decode to the empty string. Special
tokens that occur in a text become their own id, as in the tokenizers
library. Each input row gives one output row, repeated rows equal ones, an
empty table none; very long texts take longer, but no more memory. Other
columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Fixed value: the byte-level pre-tokenizer's pattern.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Texts are split into pieces a slab of about so many characters at a time. A slab ends before a single space
#: between other characters: a piece always begins there, and none that ends there looks further.
SLAB, SLAB_END = 1 << 14, regex.compile(r"\P{White_Space}(?= \P{White_Space})")
#: Bytes of buffer contents with their ids that a worker remembers, twice; what an entry costs besides.
MEMO_BYTES, ENTRY_BYTES = 40 << 20, 160


def byte_symbols() -> dict[str, int]:
    """Printable stand-in -> byte: Latin-1 print characters stand for themselves, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes of context after which no token can change any more.

    Say two continuations of one text first differ in whether rule q = (u, v)
    joins at a boundary. The next difference to the left can only be at the
    start of that u, by a later rule (t, x) where x begins with u in the sense
    of its merge tree (u is on the chain of left parts of x). Each step thus
    moves left by the length of a left part while ranks strictly increase, so
    the longest weighted chain bounds the reach; rules are visited from the
    last to the first.
    """
    left = {a + b: a for a, b in merges}
    reach: dict[bytes, int] = {}
    most = 1
    for a, b in reversed(merges):
        here = len(a) + reach.get(a, 0)
        most = max(most, len(b) + here)
        x: bytes | None = b
        while x is not None:
            if reach.get(x, 0) < here:
                reach[x] = here
            x = left.get(x)
    return most + 1


class Vocabulary:
    """Ranks, ids and token bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()
        as_bytes = lambda s: bytes(symbol[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.rank = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.none = len(merges)
        self.byte = [ids[bytes([x])] for x in range(256)]
        self.lookahead = sufficient_lookahead(merges)
        self.special = special
        self.token = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Merged(dict):
    """Content of a buffer -> packed ids after all merges: least rank first, leftmost on ties.

    Remembers contents of :data:`MEMO_BYTES` in all, twice: when it is full it
    becomes the old one, and what is found there again moves back.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.old, self.size = vocab, {}, 0

    def __missing__(self, data: bytes) -> bytes:
        packed = self.old.get(data)
        if packed is None:
            ids = list(map(self.vocab.byte.__getitem__, data))
            ids = self._by_heap(ids) if len(ids) > 64 else self._by_scan(ids)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        self.size += len(data) + len(packed) + ENTRY_BYTES
        if self.size > MEMO_BYTES:
            self.old, self.size = dict(self), 0
            self.clear()
        self[data] = packed
        return packed

    def _by_scan(self, ids: list[int]) -> list[int]:
        v = self.vocab
        get, made, none = v.rank.get, v.made, v.none
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            ids[i] = new = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 32 | ids[i + 1], none)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        """The same in n log n steps, for long contents."""
        v, n = self.vocab, len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), list(ids)
        rank = lambda i: v.rank.get(alive[i] << 32 | alive[after[i]]) if alive[i] >= 0 and after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if rank(i) != r:
                continue
            j = after[i]
            alive[i], alive[j], after[i] = v.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k))
        return [x for x in alive if x >= 0]


class Transducer:
    """Bytes in, stable tokens out; holds at most three lookaheads of bytes between calls.

    Inside a piece a token is stable once it ends further than the lookahead
    from the end of what is held; at the end of a piece all tokens are. No
    merge crosses the end of a stable token, so what lies before it is merged
    alone, whatever follows.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.buffer, self.merged = vocab, b"", Merged(vocab)
        self.room = 3 * vocab.lookahead

    def contents(self, data: bytes, ends: bool = True) -> Iterator[bytes]:
        """What is held after ``data``, cut at ends of stable tokens; the rest waits unless the piece ends."""
        held, self.buffer = self.buffer + data, b""
        while len(held) > self.room:
            end, limit = 0, self.room - self.vocab.lookahead
            for i in memoryview(self.merged[held[: self.room]]).cast("I"):
                if end + len(self.vocab.token[i]) > limit:
                    break
                end += len(self.vocab.token[i])
            yield held[:end]
            held = held[end:]
        if ends:
            yield held
        else:
            self.buffer = held

    def push(self, data: bytes, ends: bool) -> bytes:
        """Packed ids that become stable by ``data``."""
        return b"".join(map(self.merged.__getitem__, self.contents(data, ends)))

    def feed(self, data: bytes) -> Iterator[int]:
        """Ids that become stable by more bytes of a piece."""
        for at in range(0, len(data), self.room):
            yield from memoryview(self.push(data[at : at + self.room], False)).cast("I")

    def finish(self) -> Iterator[int]:
        """The rest of the piece's ids."""
        yield from memoryview(self.push(b"", True)).cast("I")

    def run(self, pieces: list[str]) -> bytes:
        """Packed ids of whole pieces."""
        held = [p.encode("utf-8", "surrogatepass") for p in pieces]
        if max(map(len, held), default=0) > self.room:  # else each piece's end is its only cut
            held = [c for data in held for c in self.contents(data)]
        return b"".join(map(self.merged.__getitem__, held))


class Encoder:
    """Texts in, packed ids out, in steps of bounded size."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.transducer = Transducer(self.vocab)

    def steps(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        v = self.vocab
        for part in v.split.split(text) if v.split is not None and any(s in text for s in v.special) else [text]:
            if part in v.special:
                yield struct.pack("<I", v.special[part])
            else:
                yield from self._steps(part)

    def _steps(self, text: str) -> Iterator[bytes]:
        at, t = 0, self.transducer
        while at < len(text):
            cut = SLAB_END.search(text, at + SLAB)
            end = cut.start() + 1 if cut else len(text)
            if end - at <= 4 * SLAB:
                yield t.run(PIECES.findall(text, at, end))
            else:  # hardly any place to cut: pieces may be as long as the text, and are never held whole
                for m in PIECES.finditer(text, at, end):
                    for i in range(m.start(), m.end(), t.room):
                        yield t.push(text[i : min(i + t.room, m.end())].encode("utf-8", "surrogatepass"), i + t.room >= m.end())
            at = end

    def encode(self, text: str) -> bytes:
        return b"".join(self.steps(text))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decoded(steps: Iterable[Iterable[int]], vocab: Vocabulary) -> Iterator[str]:
    """Text of the ids, step by step; bytes that are no UTF-8 become U+FFFD."""
    machine, token = codecs.getincrementaldecoder("utf-8")("replace"), vocab.token.__getitem__
    for ids in steps:
        yield machine.decode(b"".join(map(token, ids)))
    yield machine.decode(b"", final=True)


def round_trip(text: str | None, enc: Encoder) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the text decoded from them, without holding either whole."""
    n, digest, back = 0, hashlib.sha256(), hashlib.sha256()

    def ids() -> Iterator[memoryview]:
        nonlocal n
        for packed in enc.steps(text or ""):
            n += len(packed) // 4
            digest.update(packed)
            yield memoryview(packed).cast("I")

    for part in decoded(ids(), enc.vocab):
        back.update(part.encode("utf-8"))
    return n, digest.hexdigest(), back.hexdigest()


def bpe_encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``ids``, the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [memoryview(enc.encode(t or "")).cast("I").tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")), run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of rows as :func:`bpe_encode` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            texts = ["".join(decoded([ids or ()], vocab)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; per document the count and digests of both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n, ids, back = list(zip(*(round_trip(t, enc) for t in b.column(1).to_pylist()))) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
