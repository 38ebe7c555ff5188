"""Operator 13: fill-in-middle transformation.

A learned rank index finds the cuts of a text: rank k stands for the end of
its k-th token. Error-bounded linear segments are fitted to the offsets of
all boundaries (shrinking cones), a cut is predicted from its segment, and
the stored residual of its rank, one byte, corrects the prediction exactly.
Form and cuts follow from a hash of the doc_id alone, so lost tasks give the
same rows again.

Null and empty texts have no tokens and stay plain, as do texts that hold a
sentinel. A null doc_id hashes as an empty one. Very long texts are read a
stretch at a time; their index takes a byte for each token and a few numbers
for each segment. Repeated rows give equal results, rows that share a
doc_id are cut each by its own tokens; an empty table gives none. Other
columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80

#: Greatest distance of a boundary from its segment; with rounding it must fit a signed byte.
ERROR = 63
_STRETCH, _STEP = 1 << 20, 16


def boundaries(text: str) -> np.ndarray:
    """0 and the end of every token, in code points: a token is a word with the white space before it, or white space at the end."""
    found, after_word = [np.zeros(1, np.int64)], False
    for a in range(0, len(text), _STRETCH):
        codes = np.frombuffer(text[a : a + _STRETCH].encode("utf-32-le", "surrogatepass"), "<u4")
        word = (codes != 32) & ((codes < 9) | (codes > 13))
        before = np.empty_like(word)
        before[0], before[1:] = after_word, word[:-1]
        found.append(np.flatnonzero(before & ~word) + a)
        after_word = bool(word[-1])
    if text:
        found.append(np.array([len(text)], np.int64))
    return np.concatenate(found)


@dataclass(frozen=True)
class RankIndex:
    """Segments (first rank, its offset, slope) and a residual for each rank."""

    firsts: list[int]
    origins: list[int]
    slopes: list[float]
    residuals: np.ndarray

    @classmethod
    def fit(cls, at: np.ndarray, error: int = ERROR) -> RankIndex:
        firsts, slopes, i, n = [], [], 0, len(at)
        while i < n:
            low, high, j, step = -np.inf, np.inf, i + 1, _STEP
            while j < n:  # narrow the cone of slopes that keep all ranks of the segment within the error
                run = np.arange(j, min(n, j + step))
                rise = at[run] - at[i]
                lows = np.maximum.accumulate(np.maximum((rise - error) / (run - i), low))
                highs = np.minimum.accumulate(np.minimum((rise + error) / (run - i), high))
                fits = int(np.searchsorted(lows > highs, True))
                if fits:
                    low, high = float(lows[fits - 1]), float(highs[fits - 1])
                j += fits
                if fits < len(run):
                    break
                step *= 2
            firsts.append(i)
            slopes.append((low + high) / 2 if j > i + 1 else 0.0)
            i = j
        sizes = np.diff([*firsts, n])
        ranks = np.arange(n) - np.repeat(firsts, sizes)
        guess = np.repeat(at[firsts], sizes) + np.floor(np.repeat(slopes, sizes) * ranks + 0.5).astype(np.int64)
        return cls(firsts, at[firsts].tolist(), slopes, (at - guess).astype(np.int8))

    def predict(self, rank: int) -> int:
        s = bisect_right(self.firsts, rank) - 1
        return self.origins[s] + int(np.floor(self.slopes[s] * (rank - self.firsts[s]) + 0.5))

    def offset(self, rank: int) -> int:
        """End of the token of this rank, exactly."""
        return self.predict(rank) + int(self.residuals[rank])


def transform(text: str | None, h: tuple[int, int, int, int], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, int, str]:
    """(n, form, prefix characters, middle characters, segments, output) of one text."""
    text = text or ""
    at = boundaries(text)
    n = len(at) - 1
    if not text or h[2] % 100 >= fim_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, 0, text
    index = RankIndex.fit(at)
    a, b = (index.offset(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, len(index.firsts), f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, len(index.firsts), f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: doc_id, n, form, prefix_chars, middle_chars, n_segments and the ``output`` text."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    parts = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hashes = b.column(1).to_pylist(), zip(*(b.column(i).to_pylist() for i in range(2, 6)))
            n, form, prefix, middle, segments, output = list(zip(*(transform(t, h, fim_percent, spm_percent) for t, h in zip(texts, hashes)))) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(segments, pa.int64()), pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "n_segments", "output"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *parts)
    return map_batches(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, n_segments long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a form was made from; no text that was cut holds a sentinel, so each occurs once."""
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    end = F.length(output) + 1
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    psm, spm = F.concat(between(p, s), between(m, end), between(s, m)), F.concat(between(p, m), between(m, end), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(cut: DataFrame) -> DataFrame:
    """The contract's columns."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
k as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w, cast('0x' || s[1:8] as bigint) as h1, cast('0x' || s[9:16] as bigint) as h2,
    cast('0x' || s[17:24] as bigint) as h3, cast('0x' || s[25:32] as bigint) as h4 from d),
c as (select doc_id, t, w, cast(len(w) as bigint) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from k),
x as (select *, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:], '') as z from c)
select doc_id, n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || z || '<M>' || m else '<S>' || z || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from x"""
