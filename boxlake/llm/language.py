"""Operator 7: language identification by error-correcting output codes.

Every language has a codeword. For each bit a linear classifier over hashed
character n-grams (one to three letters, logarithmic counts, unit length)
says on which side a text lies. Decoding adds up, for every language, the
loss of each bit, weighted by how reliable the bit is on rows that its
classifier has not seen; the least loss wins, and a text is ambiguous if the
runner-up is close.

Up to six languages get all distinct splits as bits, more get a random code
with the best least distance of many draws. A bit's classifier is the least
squares fit to the codeword bits given each language's mean features and the
n-grams' mean variance within languages, so fitting needs sums over rows only:
it gathers no rows, and solves systems of the size of the languages. Learned
is every value of ``lang``, each from about :data:`PER_LANGUAGE` rows, drawn
by a hash of doc_id, outside the held-out fold; the driver gets 128 KB of sums
for each. Reliability is cross-fitted over two halves of these rows; the model
itself takes both.

Null texts and texts without a letter are ``und`` with score 0, and are not
learned from; everything is ``und`` if no language was learned. Rows with a
null ``lang`` or doc_id are not learned from, but identified. Very long texts
are read whole, in slices. Repeated rows get equal results, ties go to the
language first in alphabetical order. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, held_out, map_batches, prepare
from .sampling import thinned

#: Labelled rows to learn a language from.
PER_LANGUAGE = 500
#: Features; variance added to every feature's own; sharpness of the score.
FEATURES, RIDGE, SHARPNESS = 4096, 1e-5, 4.0
#: Least lead, in units of one bit's loss, of a text that is not ambiguous.
MARGIN = 0.1
SLICE = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 for each of ``k`` classes."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        bits = 2 ** (k - 1) - 1
        return np.array([[1.0 if c == 0 or (b + 1) >> (c - 1) & 1 else -1.0 for b in range(bits)] for c in range(k)]) if k > 2 else np.array([[1.0], [-1.0]])
    draw, n = np.random.default_rng(seed), int(10 * np.log2(k))
    best, least = None, -1.0
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], (k, n))
        apart = (n - code @ code.T) / 2 + n * np.eye(k)
        if apart.min() > least and (np.abs(code.sum(0)) < k).all():
            best, least = code, apart.min()
    return best


def features(text: str) -> np.ndarray:
    total = np.zeros(FEATURES)
    before = np.zeros(0, np.uint32)
    for at in range(0, len(text), SLICE):
        own = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c, n = np.concatenate([before, own]), len(before)  # of n-grams, those that end in this slice
        before = c[-2:]
        grams = [own * np.uint32(0x9E3779B1)]
        if len(c) > 1:
            two = c[max(n - 1, 0) :]
            grams.append((two[:-1] * np.uint32(0x85EBCA6B)) ^ (two[1:] * np.uint32(0xC2B2AE35)))
        if len(c) > 2:
            grams.append((c[:-2] * np.uint32(0x27D4EB2F)) ^ (c[1:-1] * np.uint32(0x165667B1)) ^ (c[2:] * np.uint32(0x9E3779B1)))
        for g in grams:
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount(g >> np.uint32(20), minlength=FEATURES)
    x = np.log1p(total)
    return x / max(np.linalg.norm(x), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    offset: np.ndarray
    trust: np.ndarray  # of each bit, adding up to one

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.offset
        return np.maximum(0, 1 - margin[:, None, :] * self.code[None]) @ self.trust

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for t in texts:
            if not t or not self.languages or not _LETTER.search(t):
                out.append(("und", 0.0, False))
                continue
            loss = self.losses(features(t)[None])[0]
            p = np.exp(SHARPNESS * (loss.min() - loss))
            order = np.argsort(loss, kind="stable")
            close = len(order) > 1 and loss[order[1]] - loss[order[0]] < MARGIN
            out.append((self.languages[order[0]], float(p.max() / p.sum()), bool(close)))
        return out


@dataclass(frozen=True)
class Sums:
    """Of one language's rows: how many, sum and sum of squares of their features."""

    n: int
    x: np.ndarray
    xx: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.x + other.x, self.xx + other.xx)


def bit_classifiers(sums: list[Sums], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x bits) and offset, all languages counting alike."""
    means = np.array([s.x / s.n for s in sums])
    spread = np.mean([s.xx / s.n - m * m for s, m in zip(sums, means)], axis=0).clip(0) + RIDGE
    mean, offset = means.mean(0), code.mean(0)
    m = means - mean
    weights = (m / spread).T @ np.linalg.solve(len(m) * np.eye(len(m)) + (m / spread) @ m.T, code - offset)
    return weights, offset - mean @ weights


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by language and half; the rows come sorted by them."""
    key, n, x, xx = None, 0, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([x.tobytes()]), pa.array([xx.tobytes()])], names=["lang", "half", "n", "x", "xx"])

    for b in batches:
        for lang, half, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if not _LETTER.search(text):
                continue
            if (lang, half) != key:
                if key is not None:
                    yield out()
                key, n, x, xx = (lang, half), 0, np.zeros(FEATURES), np.zeros(FEATURES)
            f = features(text)
            n, x, xx = n + 1, x + f, xx + f * f
    if key is not None:
        yield out()


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    known = docs.where(~held_out(F.col("doc_id")) & (F.length("text") > 0)).select("doc_id", "lang", "text")
    rows, _ = thinned(known, "lang", per_language)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    rows = rows.select(F.col("lang").cast("string").alias("lang"), half, "text", "doc_id").repartition("lang", "half").sortWithinPartitions("lang", "half", "doc_id", "text")
    rows = checkpointed(rows.select("lang", "half", "text"))  # about per_language texts of each language
    halves: dict[str, dict[int, Sums]] = {}
    for r in map_batches(rows, _sums, "lang string, half int, n long, x binary, xx binary").collect():
        halves.setdefault(r.lang, {})[r.half] = Sums(r.n, np.frombuffer(r.x), np.frombuffer(r.xx))
    languages = sorted(halves)
    code = codewords(len(languages))
    if not languages:
        return LanguageModel((), code, np.zeros((FEATURES, 1)), np.zeros(1), np.ones(1))
    weights, offset = bit_classifiers([sum(list(halves[lang].values())[1:], list(halves[lang].values())[0]) for lang in languages], code)
    trust = np.ones(code.shape[1])
    crossed = [lang for lang in languages if len(halves[lang]) == 2]
    if len(crossed) > 1:
        own = code[[languages.index(lang) for lang in crossed]]
        models = {h: bit_classifiers([halves[lang][1 - h] for lang in crossed], own) for h in (0, 1)}

        def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lang, half, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if lang in crossed and _LETTER.search(text):
                        w, c = models[half]
                        sides = (features(text) @ w + c) * own[crossed.index(lang)] > 0
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sides)), pa.array(range(len(sides)), pa.int32()), pa.array(sides.astype(np.int32))], names=["lang", "bit", "ok"])

        by_language = map_batches(rows, right, "lang string, bit int, ok int").groupBy("bit", "lang").agg(F.avg("ok").alias("ok"), F.count("*").alias("n"))
        for r in by_language.groupBy("bit").agg(F.avg("ok").alias("ok"), F.sum("n").alias("n")).collect():
            trust[r.bit] = reliability(r.ok, r.n)
    return LanguageModel(tuple(languages), code, weights, offset, trust / trust.sum())


def reliability(right: float, rows: int) -> float:
    """A bit's weight: half the log odds of being right, as far as so many rows can tell."""
    least = 1 / (rows + 2)
    return max(0.5 * float(np.log((right + least) / (1 - right + least))), 1e-3)


def language_of(text: Column, model: LanguageModel) -> Column:
    """Struct of lang_pred, score and ambiguous."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict([None if t is None or t != t else t for t in texts]), columns=["lang_pred", "score", "ambiguous"])

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    prepare(docs.sparkSession)
    found = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), language_of(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")
