"""Operator 12: filter interaction audit.

Every order of the filters is applied to every document at once: a
document's failures are a mask, and a mask stands for one big integer whose
64-bit fields hold the outcomes of all steps of all orders (600 for five
filters, six counters each). The integers of a part are summed, each times
the number of its documents, and the sum is unpacked. A field holds at most
the part's documents, a Spark long, so no field runs over into the next.

Failures are judged once, where a text is read; from there on rows are some
70 bytes. Documents are counted by text, part and labels before texts meet,
and by mask before parts do, so a text or part that holds a third of all
rows is a few rows for each task. At most 4 rows for each mask meet in a
part's integer.

Null texts count as empty, null parts as empty strings. A null doc_id has no
smaller one and is smaller than none. Rows that repeat a doc_id count each;
they are no duplicates of one another. A doc_id with several labels is good
or toxic if one of them says so. Very long texts are judged whole, and an
empty table has no parts. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, WORD_GAP, prepare

COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD = np.dtype("<u8")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of the contract."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], duplicates: int, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by what they fail; ``duplicates`` is the bit of equal texts of a smaller doc_id."""
    flags = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", "part", flags.cast("int").alias("flags"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("own"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "flags", "own", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    same = ["own", "part", "flags", "good", "toxic"]
    ids = rows.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    texts = ids.groupBy(*same).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    least = F.min("first").over(Window.partitionBy("own"))  # over a few rows for each part
    once = F.col("without_id") + F.when(F.col("first") == least, F.col("n_first")).otherwise(0)
    split = texts.withColumn("once", once).select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("flags").alias("mask"), F.col("once").alias("n")), F.struct(F.col("flags").bitwiseOR(1 << duplicates).alias("mask"), (F.col("n") - F.col("once")).alias("n")))))
    return split.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=8)
def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """By order and step: the filter's bit, and the bits of the filters before it."""
    bit = 1 << np.array(list(permutations(range(n))), np.int64).reshape(-1, n)
    return bit, np.cumsum(bit, 1) - bit


@lru_cache(maxsize=256)
def packed(n: int, mask: int, good: bool, toxic: bool) -> int:
    """The integer of one document: field (order, step, counter), least first."""
    bit, before = _steps(n)
    fails, earlier = (mask & bit) > 0, (mask & before) > 0
    removed = fails & ~earlier
    fields = np.stack([~fails & ~earlier, removed, fails & earlier, mask == bit, removed & good, removed & toxic], -1)
    return int.from_bytes(fields.astype(FIELD).tobytes(), "little")


def unpacked(n: int, total: int) -> np.ndarray:
    """(order, step, counter) of a sum of packed integers."""
    bit, _ = _steps(n)
    return np.frombuffer(total.to_bytes(bit.size * len(COUNTERS) * FIELD.itemsize, "little"), FIELD).reshape(*bit.shape, -1).astype(np.int64)


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, duplicates: str = "E", doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, the counters and shapley: a row for each part, order and step.

    ``filters`` maps letters to failure conditions on the column ``_text``
    (the text, never null); ``duplicates`` is the letter of the filter that
    removes texts of a smaller doc_id.
    """
    prepare(docs.sparkSession)
    filters = text_filters(F.col("_text")) if filters is None else filters
    letters = [*filters, duplicates]
    n, orders = len(letters), ["".join(p) for p in permutations(letters)]
    counts = mask_counts(docs, labels, filters, len(filters), doc_id, text, part)

    def run(rows: pa.Table) -> pa.Table:
        got = rows.to_pydict()
        total = sum(c * packed(n, m, g, t) for m, g, t, c in zip(got["mask"], got["good"], got["toxic"], got["n"]))
        fields, (bit, _) = unpacked(n, total), _steps(n)
        removed = fields[..., COUNTERS.index("removed")]
        shapley = sum(np.where(bit == 1 << f, removed[bit == 1 << f].sum(), 0) for f in range(n))
        cols = {"part": [got["part"][0]] * bit.size, "filter_order": np.repeat(orders, n).tolist(), "step": pa.array(np.tile(np.arange(1, n + 1), len(orders)), pa.int32())}
        cols |= {name: fields[..., i].ravel() for i, name in enumerate(COUNTERS)}
        return pa.table(cols | {"shapley": shapley.ravel()})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley"))
    return counts.groupBy("part").applyInArrow(run, schema)


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d, coalesce(w.doc_id > min(w.doc_id) over (partition by t), false) as e from w left join l on w.doc_id = l.doc_id),
g as (select part, good, toxic, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as failed, count(*) as n from m group by all),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from (select unnest(['A', 'B', 'C', 'D', 'E']) as f) a, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) b, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) c,
    (select unnest(['A', 'B', 'C', 'D', 'E']) as f) d, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, cast(step as int) as step, filter_order[step:step] as f, filter_order[1:step - 1] as before from o, range(1, 6) r(step)),
x as (select part, filter_order, step, f, good, toxic, n, contains(failed, f) as fails, translate(failed, before, '') <> failed as earlier, failed = f as alone from g, s),
y as (select part, filter_order, step, f, cast(sum(case when not fails and not earlier then n else 0 end) as bigint) as kept, cast(sum(case when fails and not earlier then n else 0 end) as bigint) as removed,
    cast(sum(case when fails and earlier then n else 0 end) as bigint) as redundant, cast(sum(case when alone then n else 0 end) as bigint) as unique_fails,
    cast(sum(case when fails and not earlier then n * good else 0 end) as bigint) as good_lost, cast(sum(case when fails and not earlier then n * toxic else 0 end) as bigint) as toxic_lost from x group by part, filter_order, step, f)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from y"""
