"""Sources and sinks: cached payload files in, partitioned tables out."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Position of a data set among an endpoint's payload files.
DATASETS = {("boxscoretraditional", "player"): 0, ("boxscoretraditional", "team"): 2, ("boxscoreadvanced", "player"): 0, ("boxscoreadvanced", "team"): 1}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where none is set and all runs on one machine, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    base = shared_folder(spark)
    base = base if re.match(r"[a-z0-9]+:", base) else f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spark_path(spark: SparkSession) -> Callable[[str], str]:
    """Turns an escaped URI, as in file metadata, into a path."""
    jvm = spark.sparkContext._jvm
    return lambda uri: jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()


def _file_system(spark: SparkSession, at):
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return _file_system(spark, at).exists(at)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder holds files or partitions; names in _ and . are not data."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = _file_system(spark, at)
    return fs.exists(at) and any(f.getPath().getName()[0] not in "_." for f in fs.listStatus(at))


def remove(spark: SparkSession, path: str, is_uri: bool = False) -> None:
    """Delete a folder, given as a path or, as in file metadata, as an escaped URI."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if is_uri else path)
    _file_system(spark, at).delete(at, True)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written to a fresh shared folder and read back, which cuts its lineage; the folder goes when the block ends."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def read_raw(spark: SparkSession, root: str, endpoint: str, dataset: str, schema: T.StructType) -> DataFrame:
    """Every cached payload of one data set of an endpoint, as one table.

    ``root`` is the cache folder itself: a folder above it would hide names
    that begin with a dot from the listing.
    """
    n = next((i for (e, d), i in DATASETS.items() if endpoint.lower().startswith(e) and d == dataset), 0)
    return spark.read.schema(schema).option("pathGlobFilter", f"*.{n:02d}.parquet").option("recursiveFileLookup", "true").parquet(f"{root}/{endpoint}")


def move_payloads(spark: SparkSession, written: str, folder: str, dataset: int) -> None:
    """Give the files of a written table the names of cached payloads, ``<hash>.<NN>.parquet``; one rename for each file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(written).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for f in fs.listStatus(path(written)):
        name = f.getPath().getName()
        if name.endswith(".parquet"):
            fs.rename(f.getPath(), path(f"{folder}/{name.split('.')[0]}.{dataset:02d}.parquet"))


def conform(df: DataFrame, schema: T.StructType, extra: str = "ignore") -> DataFrame:
    """Known columns cast to their type (null if they can't be), missing ones null, unknown ones dropped or kept (``extra="allow"``)."""
    have = set(df.columns)
    known = [(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    rest = [F.col(c) for c in df.columns if c not in schema.names] if extra == "allow" else []
    return df.select(*known, *rest)


def raw_inventory(df: DataFrame) -> DataFrame:
    """Files, rows and bytes by endpoint (the folder that holds a file); files without rows count too."""
    spark, at = df.sparkSession, spark_path(df.sparkSession)
    found = [re.sub(r"([\\\[\]{}*?])", r"\\\1", at(f)) for f in df.inputFiles()]  # names, not patterns
    if not found:
        return spark.createDataFrame([], "endpoint string, files long, rows long, bytes long")
    files = spark.read.format("binaryFile").load(found).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    rows = df.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    both = files.join(rows, "path", "left")
    return both.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("endpoint")).agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum("size").alias("bytes"))


def latest_snapshot(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row for each key, by partial aggregation: a hot key costs one row for each task."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def write_interim(df: DataFrame, path: str, partition: str = "season") -> None:
    """Idempotent: each partition that ``df`` holds is replaced whole, others stay.

    Rows meet by partition before they are written, so that tasks do not each
    write a file into every partition; large partitions are split again.
    """
    df.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    write_interim(df, path, "split")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> Column:
    """Join condition under which null keys equal one another; ``names`` are the keys' names on the right."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[n]) for k, n in zip(keys, names or keys)])
