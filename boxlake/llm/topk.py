"""Operator 8: exact top-k inner products by norm buckets.

Vectors are dealt by ranges of their length, longest first, and packed into
buckets of neighbours in length; queries likewise into blocks. A block meets a
range of buckets in one task, which walks the range from its longest bucket.
For a query, the score to beat divided by both lengths is the bucket's local
cosine threshold. Over one, the bucket is skipped. If it is high, only vectors
whose value at the query's largest coordinate can still reach that cosine are
kept (coordinate pruning); if it is low, only vectors long enough (length
pruning). What is left is verified by exact products. The scores to beat start
from the longest vectors of all, a sample of fixed size, so buckets that no
query of a block can use are left out before anything of them moves.

Blocks and buckets meet by a join on their numbers: the plan is the same for
any number of queries, and neither side passes the driver. Components become
floor(256 * x). Vectors that are null, empty, or hold null or non-finite
components, and null ids, take no part. Vectors of another dimension than the
query's are not compared with it, whatever their length. If rows with
different vectors repeat a query's id, the least of these vectors (compared
component by component) asks. Rows with the query's own id are its own row.
Ties go to the smaller vec_id; equal (vec_id, score) rows of repeated vectors
each take a place. Products are exact whatever the components: in floating
point where that is exact, else in 64 bits, else in integers of any width.
What no long can hold, a component or one of the best scores, is an error, as
the result has no place for it. An empty table, or one without queries, gives
an empty result. Other columns are ignored.

Of long vectors fewer make a block (:data:`BLOCK_BYTES`), so a block's memory
is bounded; the more queries a block takes, the less often buckets move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_batches

K, QUERY_STEP = 5, 50
BUCKET_ROWS, BLOCK_QUERIES, SEEDS = 1024, 32_768, 512
#: Most bytes of a block's vectors, eight for each component; most queries whose products with a bucket are held at once.
BLOCK_BYTES, TILE = 16 << 20, 4096
#: Parts by which blocks meet buckets, and by which a query's best rows meet before they meet as a whole.
PARTS = 16
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM = 0.6
_SLACK = 1 + 1e-9


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, ``v`` (array of long), and ``norm2`` of the vectors that take part."""
    big = F.lit(float("inf"))
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    whole = lambda x: F.when(F.abs(x.cast("double")) < 2.0**55, F.floor(F.lit(256.0) * x.cast("double"))).otherwise(F.raise_error(F.lit("a component times 256 exceeds 64 bits")).cast("long"))
    out = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))
    return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


class _Queries:
    """Queries of one dimension, with the k best so far of each."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.x = q.astype(np.float64)
        self.norm = np.sqrt((self.x**2).sum(1))
        self.unit = self.x / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.abs(self.unit).argmax(1)
        self.least = np.full(len(ids), -np.inf)  # score to beat, ties included
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.most = float(np.abs(self.x).max(initial=0))

    def products(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Exact integer products, by floating point where it is exact, by integers of any width where 64 bits may not do."""
        most = self.most * float(np.abs(rows.astype(np.float64)).max(initial=0)) * rows.shape[1]
        if most < 2**53:
            return rows.astype(np.float64) @ self.x[of].T
        return rows @ self.q[of].T if most < 2**62 else rows.astype(object) @ self.q[of].T.astype(object)

    def offer(self, which: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray) -> None:
        """Take hits (query position, vec_id, score), any order."""
        order = np.argsort(which, kind="stable")
        which, vec_ids, scores = which[order], vec_ids[order], scores[order]
        for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.diff(which, prepend=-1, append=-1)))):
            i = int(which[a])
            mine = self.best[i] + [(-int(s), int(v)) for s, v in zip(scores[a:b], vec_ids[a:b]) if v != self.ids[i]]
            mine.sort()
            self.best[i] = mine[: self.k]
            if mine and -(2**63) >= min(mine[0][0], -self.best[i][-1][0]):
                raise OverflowError(f"a score of query {self.ids[i]} exceeds 64 bits")
            if len(self.best[i]) == self.k:
                self.least[i] = max(self.least[i], -self.best[i][-1][0])

    def bucket(self, vec_ids: np.ndarray, rows: np.ndarray) -> None:
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norms, kind="stable")
        vec_ids, rows, norms = vec_ids[order], rows[order], norms[order]
        reach = self.norm * norms[0] * _SLACK
        open_ = np.flatnonzero(reach >= self.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, self.least / reach, -np.inf)
        by_coordinate = open_[(local[open_] >= COORDINATE_FROM) & (norms[-1] > 0)]
        by_length = open_[~((local[open_] >= COORDINATE_FROM) & (norms[-1] > 0))]
        if len(by_coordinate):
            unit = rows / norms[:, None]
            lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i in by_coordinate:
                f, t = int(self.focus[i]), min(float(local[i]), 1.0)
                if f not in lists:
                    place = np.argsort(unit[:, f])
                    lists[f] = place, unit[place, f]
                place, values = lists[f]
                # Angles to the axis differ by no more than the angle between the vectors.
                apart, axis = np.arccos(t), np.arccos(np.clip(self.unit[i, f], -1, 1))
                low, high = np.cos(min(np.pi, axis + apart)) - 1e-9, np.cos(max(0.0, axis - apart)) + 1e-9
                keep = place[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]
                keep = keep[norms[keep] * self.norm[i] * _SLACK >= self.least[i]]
                if len(keep):
                    s = self.products(rows[keep], np.array([i]))[:, 0]
                    hit = s >= self.least[i]
                    self.offer(np.full(hit.sum(), i), vec_ids[keep[hit]], s[hit])
        if len(by_length):
            # Lengths fall within the bucket: each query needs a prefix of it.
            for at in range(0, len(by_length), TILE):
                some = by_length[at : at + TILE]
                need = np.where(self.least[some] > 0, self.least[some] / np.maximum(self.norm[some] * _SLACK, 1e-300), -np.inf)
                ends = np.searchsorted(-norms, -need, "right")
                n = int(ends.max())
                if n:
                    s = self.products(rows[:n], some)
                    r, c = np.nonzero((s >= self.least[some]) & (np.arange(n)[:, None] < ends))
                    self.offer(some[c], vec_ids[r], s[r, c])


def _grouped(ids: np.ndarray, vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (ids, vectors) of the rows of a batch, in their order."""
    flat, ends = np.asarray(vectors.flatten()), np.cumsum(np.asarray(vectors.value_lengths()))
    size = np.diff(ends, prepend=0)
    out = {}
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        out[d] = ids[rows], flat[(ends[rows] - d)[:, None] + np.arange(d)]
    return out


def _pack(n: int, seeds: list | None, k: int):
    """Function over batches of (vec_id, v), longest first, giving packs of ``n`` vectors at most.

    With seeds these are blocks of queries, of no more than :data:`BLOCK_BYTES`: ``least`` holds each query's score
    to beat, ``reach`` the least length of a vector that any of them can use.
    Else they are buckets, and ``reach`` is their greatest length.
    """

    def pack(d: int, ids: np.ndarray, rows: np.ndarray, at: int) -> pa.RecordBatch:
        if seeds is None:
            least, reach = None, float(np.sqrt((rows[:1].astype(np.float64) ** 2).sum(1))[0])
        else:
            q = _Queries(ids, rows, k)
            same = [(i, v) for i, v in seeds if len(v) == d]
            if same:
                q.bucket(np.array([i for i, _ in same], np.int64), np.array([v for _, v in same], np.int64))
            bound = np.where((q.least > 0) & (q.norm > 0), q.least / np.maximum(q.norm, 1e-300), -np.inf)
            least, reach = q.least.tobytes(), float(bound.min())
        most = int(np.abs(rows).max(initial=0))
        code = next((c for c, top in (("<i2", 1 << 15), ("<i4", 1 << 31)) if most < top), "<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([at], pa.int32()), pa.array([d], pa.int32()), pa.array([reach]),
             pa.array([ids.tobytes()]), pa.array([code]), pa.array([rows.astype(code).tobytes()]), pa.array([least], pa.binary())],
            names=["range", "at", "dim", "reach", "ids", "code", "rows", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        at = 0
        for b in batches:
            for d, part in _grouped(np.asarray(b.column(0)), b.column(1)).items():
                held.setdefault(d, []).append(part)
                most = n if seeds is None else max(1, min(n, BLOCK_BYTES // (8 * d)))
                if sum(len(ids) for ids, _ in held[d]) >= most:
                    ids, rows = (np.concatenate([p[i] for p in held[d]]) for i in (0, 1))
                    while len(ids) >= most:
                        yield pack(d, ids[:most], rows[:most], at)
                        ids, rows, at = ids[most:], rows[most:], at + 1
                    held[d] = [(ids, rows)]
        for d, parts in held.items():
            ids, rows = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            if len(ids):
                yield pack(d, ids, rows, at)
                at += 1

    return run


def _walk(k: int):
    """Function over a block's row and then its buckets, for each (block, range) in turn, giving their best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Queries | None = None

        def best() -> Iterator[pa.RecordBatch]:
            out = [(int(state.ids[i]), v, -n) for i, rows in enumerate(state.best) for n, v in rows] if state is not None else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                dim, ids, code, rows, least = (b.column(c)[i].as_py() for c in range(5))
                ids, rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, code).reshape(-1, dim).astype(np.int64)
                if least is not None:
                    yield from best()
                    state = _Queries(ids, rows, k)
                    state.least = np.frombuffer(least, "<f8").copy()
                else:
                    state.bucket(ids, rows)
        yield from best()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of every query."""
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = quantised(vectors)
    seeds = [(r.vec_id, r.v) for r in vectors.orderBy(F.desc("norm2"), "vec_id", "v").limit(SEEDS).select("vec_id", "v").collect()]
    longest = [F.desc("norm2"), F.col("vec_id")]

    def packed(df: DataFrame, rows: int, with_seeds: list | None) -> DataFrame:
        dealt = df.repartitionByRange(n, *longest).sortWithinPartitions(*longest).select("vec_id", "v")
        return checkpointed(map_batches(dealt, _pack(rows, with_seeds, k), "range int, at int, dim int, reach double, ids binary, code string, rows binary, least binary"))

    asking = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm2")).alias("q")).select("vec_id", "q.*")
    blocks = packed(asking, BLOCK_QUERIES, seeds).withColumn("block", F.col("range").cast("long") * 2**32 + F.col("at")).drop("range", "at")
    buckets = packed(vectors, BUCKET_ROWS, None)
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    wanted = blocks.select("block", "dim", F.col("reach").alias("need"), F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int").alias("part"))
    pairs = buckets.select("range", "at", "dim", "reach", part).join(wanted, ["dim", "part"]).where(F.col("reach") * _SLACK >= F.col("need")).select("block", "range", "at")
    pack = ["dim", "ids", "code", "rows", "least"]
    asked = pairs.select("block", "range").distinct().join(blocks, "block").select("block", "range", F.lit(-1).alias("at"), *pack)
    offered = pairs.join(buckets, ["range", "at"]).select("block", "range", "at", *pack)
    met = asked.unionByName(offered).repartition(n, "block", "range").sortWithinPartitions("block", "range", "at").select(*pack)
    best = map_batches(met, _walk(k), "query_id long, vec_id long, score long")
    order = [F.desc("score"), F.col("vec_id")]
    some = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id, min(v) as v from v where vec_id % 50 = 0 group by vec_id),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from q join v c on c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
