"""Operator 4: token files that can be read document by document.

A file is a run of independent zstandard frames, then a directory in a
skippable frame, then the seek table of the zstandard seekable format (a
skippable frame with sizes and the low 32 bits of each frame's XXH64). A
reader needs the table, the directory and the frames that hold the documents
it wants; every frame is checked before use.

Documents are dealt by ranges of doc_id (and of how their texts begin, so that
rows without or with one id can be split), each task sorts its range by doc_id
and text and writes one file, so files in name order hold ascending ids. A file is written under
a name of its own attempt and then renamed: a task that runs again after an
executor was lost replaces the file by an equal one.

Null and empty texts hold the end id alone. A null doc_id sorts first and
stays null. Repeated doc_ids are ordered by text and kept as rows of their
own. An empty table gives no file and no row. Very long texts are encoded
whole, each in memory of its ids. Other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, shared_dir

# Fixed values of the seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: A frame is closed at so many ids or documents.
FRAME_IDS, FRAME_DOCS = 1 << 18, 512
#: Pieces whose ids a worker remembers, twice, and the longest of them that it keeps.
MEMO_ENTRIES, MEMO_CHARS = 150_000, 64
NO_ID = -(1 << 63)
#: Texts whose pieces are learned together have so many characters.
GROUP_CHARS = 1 << 19
#: Rows of one doc_id are split between files by so many first characters of their texts.
SPLIT_CHARS = 48


#: Texts and words whose pieces this module can tell itself: ASCII and Latin-1 letters.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*\Z")
# Fixed value: the tokenizer's pattern for pieces, over lower-case plain words.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


class Memo:
    """A bounded map; when full it becomes the old one, and entries found there again move back."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        if len(self.new) >= MEMO_ENTRIES:
            self.old, self.new = self.new, {}
        out, new, old = [], self.new, self.old
        for k in [k for k in keys if k not in new]:
            if (v := old.get(k)) is not None:
                new[k] = v
            else:
                out.append(k)
        return out


class WordEncoder:
    """The library's ids of a text, put together from the ids of its pieces.

    Only for tokenizers whose pieces never cross white space, whose normalizer
    treats words alike wherever they stand, and whose last token of each piece
    carries the end-of-word mark.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Memo()

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _new_pieces(self, pieces: list[str]) -> None:
        """All in one call: every piece ends at a token with the end-of-word mark."""
        if not pieces:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(pieces):
            raise ValueError("the tokenizer's pieces are not marked at their ends")
        packed, at = ids.tobytes(), 0
        for piece, cut in zip(pieces, cuts.tolist()):
            self.pieces.new[piece] = packed[at:cut]
            at = cut

    def _packed(self, runs: list[list[str]]) -> list[bytes]:
        """Packed ids of runs of pieces; what is new in any of them is learned in one call."""
        missing = self.pieces.missing(set().union(*runs))
        self._new_pieces(missing)
        known = self.pieces.new.__getitem__
        packed = [b"".join(map(known, run)) for run in runs]
        for p in missing:
            if len(p) > MEMO_CHARS:
                del self.pieces.new[p]
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        special = any(t in text for t in self.special)
        if not special and PLAIN.match(text):
            return self._packed([PIECE.findall(text.lower())])[0]
        out, run = [], []
        for word in re.split(r"[\x20\x09-\x0D]+", text):
            if PLAIN.match(word) and not (special and any(t in word for t in self.special)):
                run += PIECE.findall(word.lower())
            else:
                out += [*self._packed([run]), *self._whole([word])]
                run = []
        return b"".join([*out, *self._packed([run])])

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text, in order; texts go in groups of :data:`GROUP_CHARS` characters or one text."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if PLAIN.match(t) and not any(s in t for s in self.special)]
        out = dict(zip(plain, self._packed([PIECE.findall(texts[i].lower()) for i in plain]))) if plain else {}
        return [out[i] if i in out else self.encode(t) for i, t in enumerate(texts)]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class TokenFileWriter:
    """Writes documents in the order given."""

    def __init__(self, out):
        self.out, self.table, self.first, self.docs, self.ids = out, [], [], [], []
        self.compressor = zstandard.ZstdCompressor(level=1)
        self.n_docs = self.n_ids = self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, len(ids) // 4))
        self.ids.append(ids)
        self.held += len(ids) // 4
        self.n_docs += 1
        self.n_ids += len(ids) // 4
        if self.held >= FRAME_IDS or len(self.docs) >= FRAME_DOCS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        index = np.array(self.docs, "<i8")
        payload = struct.pack("<Q", len(index)) + index[:, 0].tobytes() + index[:, 1].tobytes() + b"".join(self.ids)
        frame = self.compressor.compress(payload)
        self.out.write(frame)
        self.table.append((len(frame), len(payload), xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF))
        self.first.append(self.docs[0][0])
        self.docs, self.ids, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        directory = np.array(self.first, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(directory)) + directory)
        self.table.append((8 + len(directory), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE))


class TokenFile:
    """Reads whole frames or single documents of a seekable file object."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        start = size - 9 - 12 * n
        if struct.unpack("<II", self._at(start - 8, 8)) != (SEEK_TABLE, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.table = list(struct.iter_unpack("<III", self._at(start, 12 * n)))
        self.starts = [0, *np.cumsum([e[0] for e in self.table]).tolist()]
        self.first = np.frombuffer(self._at(self.starts[n - 1] + 8, self.table[-1][0] - 8), "<i8")
        self.frames_read = 0

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        payload = zstandard.ZstdDecompressor().decompress(self._at(self.starts[k], self.table[k][0]), max_output_size=self.table[k][1])
        self.frames_read += 1
        if xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF != self.table[k][2]:
            raise ValueError(f"frame {k}: checksum differs")
        (n,) = struct.unpack_from("<Q", payload)
        doc_ids, sizes = np.frombuffer(payload, "<i8", n, 8), np.frombuffer(payload, "<i8", n, 8 + 8 * n)
        ids = np.frombuffer(payload, "<u4", offset=8 + 16 * n)
        for d, a, b in zip(doc_ids.tolist(), (np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist()):
            yield (None if d == NO_ID else d), ids[a:b]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.first)):
            yield from self.frame(k)

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The wanted documents that the file holds; other frames stay compressed."""
        wanted = set(wanted)
        frames = set()
        for d in wanted:  # a repeated id may span frames
            frames.update(range(max(0, int(np.searchsorted(self.first, d, "left")) - 1), int(np.searchsorted(self.first, d, "right"))))
        for k in sorted(frames):
            yield from ((d, ids) for d, ids in self.frame(k) if d in wanted)


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files below the URI ``out``; one row per file: part, file, n_docs, n_tokens, base.

    ``base`` is the number of ids in all files before it.
    """
    spark = docs.sparkSession
    end = struct.pack("<I", end_id)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), word_encoder(path)
        part = task.partitionId()
        fs, top = pafs.FileSystem.from_uri(out)
        fs.create_dir(top, recursive=True)
        name, own = f"{top}/part-{part:06d}.zst", f"{top}/.part-{part:06d}-{task.taskAttemptId()}"
        writer = sink = None
        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), encoder.encode_many([t or "" for t in b.column(1).to_pylist()])):
                if writer is None:
                    sink = fs.open_output_stream(own)
                    writer = TokenFileWriter(sink)
                writer.add(d, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": pa.array([writer.n_docs], pa.int64()), "n_tokens": pa.array([writer.n_ids], pa.int64())})

    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .repartitionByRange(n, "doc_id", F.substring("text", 1, SPLIT_CHARS)).sortWithinPartitions("doc_id", "text")
    )
    files = checkpointed(map_batches(ordered, write, "part int, file string, n_docs long, n_tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(files: DataFrame, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(out)
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(name) as source:
                    file = TokenFile(source)
                    for k in range(len(file.first)):
                        rows = []
                        for d, ids in file.frame(k):
                            rows.append((d, at, len(ids), zlib.crc32(ids)))
                            at += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(files.select("file", "base").repartition(n, "file"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str, end_id: int, out: str | None = None) -> DataFrame:
    """Write the files (a fresh shared folder unless named) and read them back."""
    out = out or shared_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, out, end_id), out)
