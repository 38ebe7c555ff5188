"""Operator 6: quality classifier by compression.

Two zstandard dictionaries, from well and from badly labelled text, are built
for each of three views of a text: the text itself, its shape (letters,
capitals and digits each mapped to one symbol), and its recurrence (a symbol
for each word by how far back the same word stood last). Every view is
compressed in short pieces with both dictionaries; the normalised difference
of the compressed sizes, ``(bad - good) / (bad + good)``, is all that a score
depends on. :data:`PSEUDO` bytes of the training rows' mean difference are
added to each, so that short texts, which tell little, lie near the mean. A
logistic curve, fitted on labelled rows that no dictionary has seen,
calibrates the three differences.

Fitted on about :data:`PER_CLASS` labelled rows of each class, drawn by a hash
of doc_id, two thirds for the dictionaries and a third for the curve. A dictionary is
trained on about :data:`SAMPLE_PIECES` pieces, drawn by hash from the whole of
its texts. With no row of a class the score is the share of label 1 (0.5
without rows).

Null and empty texts get the curve's value for the mean difference; in fitting
they are left out, as are labels other than 0 and 1 and rows without doc_id.
Very long texts are scored and learned whole. Repeated rows get equal scores,
a repeated doc_id in fitting counts once for each of its rows. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, held_out, map_batches, prepare
from .sampling import thinned

PER_CLASS, SAMPLE_PIECES, PSEUDO = 2000, 8000, 128
LEVEL, DICTIONARY = 3, 32768
THRESHOLD = 0.3

_SHAPE = bytes(97 if x >= 128 or 97 <= x <= 122 else 65 if 65 <= x <= 90 else 48 if 48 <= x <= 57 else x for x in range(256))
#: Symbols of words: the word before, two or three back, up to seven back, and so on; n for a new word.
_BACK, _NEW, _LINE = b"abcdefgh", ord("n"), ord(".")
#: Bytes of a piece of each view.
VIEWS = (512, 512, 16)
#: Sizes that a worker remembers for each view whose pieces have at most so many bytes.
MEMO_PIECES, MEMO_PIECE = 200_000, 16


def recurrence(data: bytes) -> bytes:
    out, last, k = bytearray(), {}, 0
    for line in data.split(b"\n"):
        for w in line.split():
            back = k - last.get(w, k)
            out.append(_BACK[min(back.bit_length(), 8) - 1] if back else _NEW)
            last[w] = k
            k += 1
        out.append(_LINE)
    return bytes(out)


def pieces(text: str | None) -> list[list[bytes]]:
    """Pieces of each view of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    views = (data, data.translate(_SHAPE), recurrence(data) if data else b"")
    return [[v[i : i + n] for i in range(0, len(v), n)] for v, n in zip(views, VIEWS)]


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their text itself serves
        return b"".join(samples)[-DICTIONARY:]


class Compressors:
    """Sizes of pieces with the good and the bad dictionary of each view; those of short pieces, which come again and again, are remembered."""

    def __init__(self, dictionaries: tuple[bytes, ...]):
        self.compress, self.seen = [], [{} for _ in VIEWS]
        for d in dictionaries:
            known = zstandard.ZstdCompressionDict(d)
            known.precompute_compress(LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def size(self, view: int, piece: bytes) -> tuple[int, int]:
        if VIEWS[view] > MEMO_PIECE:
            return len(self.compress[2 * view](piece)), len(self.compress[2 * view + 1](piece))
        seen = self.seen[view]
        if (found := seen.get(piece)) is None:
            if len(seen) >= MEMO_PIECES:
                seen.clear()
            found = seen[piece] = len(self.compress[2 * view](piece)), len(self.compress[2 * view + 1](piece))
        return found


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[bytes, ...]) -> Compressors:
    """Prepared once for each model in a worker."""
    return Compressors(dictionaries)


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries, good and bad by view; mean difference by view; the curve's offset and weight of each view."""

    dictionaries: tuple[bytes, ...]
    mean: tuple[float, ...]
    weights: tuple[float, ...]

    def compressors(self) -> Compressors:
        return _compressors(self.dictionaries)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.dictionaries:
            return np.full(len(texts), self.weights[0])
        compressors = self.compressors()
        x = differences(np.array([sizes(t, compressors) for t in texts]).reshape(-1, len(VIEWS), 2), self.mean)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30)))


def sizes(text: str | None, compressors: Compressors) -> list[list[int]]:
    """Compressed sizes by view: with the good and with the bad dictionary."""
    out = []
    for i, view in enumerate(pieces(text)):
        found = [compressors.size(i, p) for p in view]
        out.append([sum(s[0] for s in found), sum(s[1] for s in found)])
    return out


def differences(sizes: np.ndarray, mean: tuple[float, ...] | None = None) -> np.ndarray:
    """Normalised differences by row and view, with :data:`PSEUDO` bytes of the mean, if given."""
    good, bad = sizes[..., 0].astype(float), sizes[..., 1].astype(float)
    if mean is None:
        return (bad - good) / np.maximum(bad + good, 1)
    return (bad - good + PSEUDO * np.array(mean)) / (bad + good + PSEUDO)


def _curve(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps, classes weighted to their true shares."""
    w = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    x, beta, ridge = np.c_[np.ones(len(x)), (x - mean) / spread], np.zeros(x.shape[1] + 1), 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[1:] / spread
    return np.r_[beta[0] - mean @ weights, weights]


def _samples(texts: DataFrame, n: int = SAMPLE_PIECES) -> dict[tuple[int, int], list[bytes]]:
    """(label, view) -> about ``n`` pieces of these texts, drawn by a hash of their document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, label, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for view, own in enumerate(pieces(text)):
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * n, pa.int64()), pa.array([label] * n, pa.int32()), pa.array([view] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(own, pa.binary())],
                        names=["doc_id", "label", "view", "at", "piece"])

    found = map_batches(texts.select(F.col("doc_id").cast("long"), "label", "text"), run, "doc_id long, label int, view int, at int, piece binary")
    out: dict = {(q, v): [] for q in (0, 1) for v in range(len(VIEWS))}
    counts = {(r.label, r.view): r["count"] for r in found.groupBy("label", "view").count().collect()}
    share = F.coalesce(*[F.when((F.col("label") == q) & (F.col("view") == v), F.lit(n / c)) for (q, v), c in counts.items()], F.lit(0.0))
    hash_ = F.xxhash64("doc_id", "at")
    drawn = found.where(hash_.cast("double") / 2.0**64 + 0.5 < share).withColumn("hash", hash_)
    for r in sorted(drawn.collect(), key=lambda r: (r.label, r.view, r.hash, r.piece)):  # about n of each
        out[r.label, r.view].append(bytes(r.piece))
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    chosen, counts = thinned(known, "label", per_class)
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    part = (F.xxhash64("doc_id", F.lit("part")) % 3 != 0).alias("first")
    # The sample: about 2 * per_class texts.
    texts = checkpointed(docs.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text", part))
    samples = _samples(texts.where("first"))
    if not all(samples.values()):
        return QualityModel((), (), (prior,))
    model = QualityModel(tuple(_dictionary(samples[q, v]) for v in range(len(VIEWS)) for q in (1, 0)), (), ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for b in batches:
            found = [np.ravel(sizes(t, compressors)).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["label", "sizes"])

    seen = map_batches(texts.where("not first").select("label", "text"), run, "label int, sizes array<long>")
    rows = sorted((r.label, r.sizes) for r in seen.collect())  # about per_class, a few numbers each
    y = np.array([q for q, _ in rows])
    if len(set(y.tolist())) < 2:
        return QualityModel((), (), (prior,))
    found = np.array([s for _, s in rows]).reshape(-1, len(VIEWS), 2)
    mean = tuple(differences(found).mean(0).tolist())
    return QualityModel(model.dictionaries, mean, tuple(_curve(differences(found, mean), y, prior).tolist()))


def quality_score(text: Column, model: QualityModel) -> Column:
    """Score of a text column, from 0 to 1; more is better."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([None if t is None or t != t else t for t in texts]))

    return score(text)


def classify(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
