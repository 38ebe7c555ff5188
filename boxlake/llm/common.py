"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Rows and bytes of an Arrow batch, whichever is reached first; one row is never split.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package within reach of the Python workers.

    The batch settings hold for the session from here on; one that has a
    value already keeps it. Workers start with the driver's PYTHONPATH or in
    its folder; where neither leads to the package, it is sent along once, as
    ``--py-files`` would.
    """
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    package = Path(__file__).resolve().parents[1]
    near = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if sc.applicationId not in _SENT and not any(p and Path(p).resolve() == package.parent for p in near):
        _SENT.add(sc.applicationId)
        archive = Path(tempfile.mkdtemp(prefix="py-files-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(archive))


_SENT: set[str] = set()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most :data:`BATCH_ROWS` rows and about :data:`BATCH_BYTES`."""
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words of a text, A-Z lower-cased on demand; no words for null."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER_BYTES) if lower else raw).split()


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    while name.lower() in map(str.lower, taken):
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where none is set and all runs on one machine, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder, as a URI, below the shared folder."""
    base = shared_folder(spark)
    if not re.match(r"[a-z0-9]+:", base):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`shared_dir`."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; operators take any such path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
