"""Operator 1: secret scan.

Fixed patterns give the base spans. Beside them every candidate string is
read through a sliding window whose Shannon entropy is kept by incremental
counts, with a threshold for each character class of a window; windows above
the threshold merge into ``entropy`` spans unless the allow-list explains the
whole string, or a part of it that the window holds.

Null and empty texts have no spans. Very long texts are scanned whole, in
time linear in their length. Repeated rows are scanned again, each row gives
one result, an empty table none; a null doc_id stays null. Other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Candidate strings of the entropy scan.
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{WINDOW},}}={{0,2}}")
#: Least entropy in bits of a window of WINDOW characters: all hex, others, without digits.
#: Uniform draws give about 3.5 bits (16 symbols) and 4.0 bits (64 symbols).
#: Windows without digits need more bits and CASE_LEAST letters of either case, which names in code rarely have.
HEX_BITS, MIXED_BITS, LETTER_BITS, CASE_LEAST = 3.0, 3.6, 3.9, 5
_HEX = frozenset("0123456789abcdefABCDEF")
#: Strings that look random but are public by nature.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z"),  # UUID
    re.compile(r"[0-9_=+/-]+\Z"),  # numbers, dates
    re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/=+](?:[A-Za-z]+|[0-9]+))+\Z"),  # slugs and paths of plain words and numbers
)
#: Parts of strings that explain the windows that hold them, and a digest that explains those inside it.
ALLOW_PART = re.compile(r"example|placeholder|changeme|xxxx|0123456789|abcdefgh", re.I)
INTEGRITY = re.compile(r"sha(256|384|512)-[A-Za-z0-9+/]+={0,2}", re.I)  # subresource integrity
_CLOGC = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ordered."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def window_spans(string: str, least: float | None = None) -> list[tuple[int, int]]:
    """Merged windows of ``string`` with ``least`` bits and both a letter and a digit.

    Without ``least`` the window's own class decides, and windows that the
    allow-list explains are left out.
    """
    skip: set[int] = set()
    if least is None:
        for m in ALLOW_PART.finditer(string):
            skip.update(range(max(0, m.end() - WINDOW), m.start() + 1))
        for m in INTEGRITY.finditer(string):
            skip.update(range(m.start(), max(m.start(), m.end() - WINDOW) + 1))
    # entropy >= least  <=>  sum(c log c) <= WINDOW * (log2(WINDOW) - least)
    most = [WINDOW * (math.log2(WINDOW) - x) + 1e-9 for x in ((HEX_BITS, MIXED_BITS, LETTER_BITS) if least is None else (least,) * 3)]
    counts: dict[str, int] = {}
    total, letters, digits, upper, lower, other, out = 0.0, 0, 0, 0, 0, 0, []
    for i, ch in enumerate(string):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _CLOGC[c + 1] - _CLOGC[c]
        letters += ch.isalpha()
        digits += ch.isdigit()
        upper += ch.isupper()
        lower += ch.islower()
        other += ch not in _HEX
        if i >= WINDOW:
            old = string[i - WINDOW]
            c = counts[old]
            counts[old] = c - 1
            total += _CLOGC[c - 1] - _CLOGC[c]
            letters -= old.isalpha()
            digits -= old.isdigit()
            upper -= old.isupper()
            lower -= old.islower()
            other -= old not in _HEX
        start = i - WINDOW + 1
        if start < 0 or start in skip:
            continue
        if (letters and total <= most[other > 0]) if digits else (least is None and upper >= CASE_LEAST and lower >= CASE_LEAST and total <= most[2]):
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        string = m.group()
        if not any(a.match(string) for a in ALLOW):
            out += [(m.start() + a, 3, m.start() + b) for a, b in window_spans(string)]
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None) -> tuple[int, int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    more = entropy_spans(text)
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*n, len(more), _joined(base), _joined(sorted(base + more)))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by kind, ``base`` and ``spans`` as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), *(pa.array(cols[i], pa.int64()) for i in range(4)), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base", "spans"],
            )

    return map_batches(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run,
        "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base string, spans string",
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_entropy")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
