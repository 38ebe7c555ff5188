"""Incremental ingest: new files become typed rows, touched partitions are rebuilt.

A table that is merged into keeps an index of its keys, ``<path>/_keys``: the
partition that holds each key. A batch is joined with it, so a key that
comes again under another partition value leaves its old one, and only the
partitions that rows enter or leave are read and written. Data are written
before the index: a batch that is run again after a failure in between
finds the old places and does the same again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.raw import exists, has_data, latest_snapshot, remove, same_keys, shared_folder, staged, write_interim

Transform = Callable[[DataFrame], DataFrame]

#: Folders of a key index; a batch reads and rewrites those its keys fall into.
INDEX_BUCKETS = 64


def stored(spark: SparkSession, path: str, partition: str, kind: T.DataType) -> DataFrame | None:
    """A partitioned table, its partition column of the given type; None if there is none or it has no rows.

    Left to itself, Spark guesses the type of partition values, and a text
    like 007 becomes the number 7.
    """
    if not has_data(spark, path):
        return None
    fields = [T.StructField(f.name, kind) if f.name == partition else f for f in spark.read.parquet(path).schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(INDEX_BUCKETS)).cast("int").alias("_bucket")


def _among(c: str, values: Sequence) -> Column:
    """``isin`` that knows null; Spark prunes partitions by it."""
    some = [v for v in values if v is not None]
    return F.col(c).isin(some) | (F.col(c).isNull() if None in values else F.lit(False))


def _index(spark: SparkSession, path: str, keys: Sequence[str], partition: str, old: DataFrame, buckets: Sequence[int], unique: bool = False) -> DataFrame:
    """The index rows of these buckets; a table without an index gets one from its key columns, which may be known to be ``unique``."""
    at = f"{path.rstrip('/')}/_keys"
    own = old.select(*keys, F.col(partition).alias("_at"), _bucket(keys))
    if not exists(spark, at):
        (own if unique else own.distinct()).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(at)
    return spark.read.schema(own.schema).parquet(at).where(F.col("_bucket").isin(list(buckets)))


def merge_batch(batch: DataFrame, path: str, keys: Sequence[str], partition: str, order: Sequence[str] = (), deletes: DataFrame | None = None) -> None:
    """Upsert a batch into the partitions that its rows enter or leave; the others are neither read nor written.

    If the batch repeats a key, its row of the greatest ``order`` counts (by
    default, and on ties, the greatest row). Keys are compared as values:
    nulls equal one another. ``deletes`` holds keys to take out; those that
    are in the batch too stay. An empty partition string is stored as null,
    as Spark does. Columns that only one side has stay, null in the other's
    rows. A dynamic overwrite replaces a partition whole, so what stays of
    it is staged first; a partition that loses all its rows is removed.
    """
    spark = batch.sparkSession
    kind = batch.schema[partition].dataType
    if isinstance(kind, T.StringType):
        batch = batch.withColumn(partition, F.nullif(F.col(partition), F.lit("")))
    batch = latest_snapshot(batch, keys, [*order, *[c for c in batch.columns if c not in (*keys, *order)]])
    old = stored(spark, path, partition, kind)
    if old is None:  # written at once, as nothing else reads the batch
        remove(spark, f"{path.rstrip('/')}/_keys")
        write_interim(batch, path, partition)
        if (old := stored(spark, path, partition, kind)) is not None:
            _index(spark, path, keys, partition, old, [], unique=True)
        return
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    out = batch.select(*keys) if deletes is None else batch.select(*keys).unionByName(deletes.select(*keys)).distinct()
    try:
        # Staged, as the keys to delete may come from the very files that are replaced below.
        with staged(out.withColumn("_bucket", _bucket(keys)), "out") as out:
            _replace(batch, out, old, path, keys, partition)
    finally:
        batch.unpersist()


def _replace(batch: DataFrame, out: DataFrame, old: DataFrame, path: str, keys: Sequence[str], partition: str) -> None:
    """Rewrite the partitions that rows of ``batch`` enter or rows of the keys in ``out`` leave, then the index."""
    spark, index_at = batch.sparkSession, f"{path.rstrip('/')}/_keys"
    buckets = [r[0] for r in out.select("_bucket").distinct().collect()]  # at most INDEX_BUCKETS
    index, gone = _index(spark, path, keys, partition, old, buckets), out.drop("_bucket")
    left = index.join(gone, same_keys(index, gone, keys), "left_semi").select("_at")
    touched = [r[0] for r in batch.select(F.col(partition).alias("_at")).union(left).distinct().collect()]  # partition values
    there = old.where(_among(partition, touched))
    folders = {r[0]: r[1] for r in there.select(partition, F.regexp_extract("_metadata.file_path", "^(.*)/", 1)).distinct().collect()}
    stays = there.join(gone, same_keys(there, gone, keys), "left_anti")
    with staged(batch.unionByName(stays, allowMissingColumns=True), "merge") as whole:
        held = {r[0] for r in whole.select(partition).distinct().collect()}
        if held:
            write_interim(whole, path, partition)
    for value, folder in folders.items():
        if value not in held:
            remove(spark, folder, is_uri=True)
    fresh = index.join(gone, same_keys(index, gone, keys), "left_anti").unionByName(batch.select(*keys, F.col(partition).alias("_at"), _bucket(keys)))
    with staged(fresh, "keys") as rows:
        kept = {r[0] for r in rows.select("_bucket").distinct().collect()}
        if kept:
            write_interim(rows, index_at, "_bucket")
    for b in set(buckets) - kept:
        remove(spark, f"{index_at}/_bucket={b}")


def ingest_incremental(spark: SparkSession, source: str, out: str, checkpoint: str, schema: T.StructType, transform: Transform, keys: Sequence[str], partition: str = "season", glob: str = "*.parquet", after: Callable[[DataFrame], None] | None = None, order: Sequence[str] = ()) -> None:
    """Take all files not seen before, then stop; a run without new files changes nothing."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    files = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)

    def each(batch: DataFrame, _: int) -> None:
        rows = transform(batch)
        merge_batch(rows, out, keys, partition, order)
        if after is not None:
            after(rows)

    files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def refresh_affected(batch: DataFrame, interim: str, features: str, entity: str, date: str, partition: str, build: Transform, game: str = "game_id") -> None:
    """Rebuild what a merged batch can change: all rows of the touched entities from their earliest touched date.

    Touched are the batch's entities, and those whose features hold one of
    its games under another date or entity (a corrected header); the earlier
    of both dates counts, and what a game left behind goes. Windows reach
    back over partitions, so an entity's whole history feeds ``build``; rows
    before the touched date keep their values. Rows without a date change
    nobody's values but are rebuilt with their entity.
    """
    spark = batch.sparkSession
    keys = [c for c in (entity, game) if c in batch.columns]
    kind = batch.schema[partition].dataType
    held = stored(spark, features, partition, kind)
    touched = batch.select(entity, date)
    if held is not None and game in batch.columns:
        touched = touched.unionByName(held.join(batch.select(game).distinct(), game, "left_semi").select(entity, date))
    with staged(touched.groupBy(entity).agg(F.min(date).alias("_since")), "touched") as touched:
        late = (F.col(date) >= F.col("_since")) | F.col(date).isNull()
        history = stored(spark, interim, partition, kind).join(touched.select(entity), entity, "left_semi")
        fresh = build(history).join(touched, entity).where(late).drop("_since")
        stale = None if held is None else held.join(touched, entity).where(late).select(*keys)
        merge_batch(fresh, features, keys if game in batch.columns else [entity, date], partition, deletes=stale if game in batch.columns else None)
