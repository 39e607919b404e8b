"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Upper bounds of one Arrow batch handed to Python, whatever the text lengths are.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: What a task holds of a Parquet file: bytes of a row group that it writes (and later reads), rows that it decodes at once.
GROUP_BYTES = 16 << 20
READ_ROWS = 512

_MADE: list[str] = []
_CLEAR: dict[str, Callable[[], None]] = {}
_SHIPPED: set[str] = set()


def hold(name: str, clear: Callable[[], None]) -> None:
    """Called in a worker by the operator whose caches are to stay; those of other operators are emptied,
    as workers live on from one operator to the next."""
    for other, empty in _CLEAR.items():
        if other != name:
            empty()
    _CLEAR[name] = clear


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path for a written table in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``; only on a single machine where that is unset (tests)
    a temporary folder takes its place. :func:`release` removes it unless ``keep``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/kindred-{uuid.uuid4().hex[:12]}/{name}"
    if not keep:
        _MADE.append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    bounded_groups(spark)
    path = scratch(spark, name, keep)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    _remove(df.sparkSession, df.written_to)


def made() -> list[str]:
    """Paths of the tables written so far, but for those to keep and those removed."""
    return list(_MADE)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove written tables: only when what was made from them is written too. Empties the list."""
    while paths:
        _remove(spark, paths.pop())


def _remove(spark: SparkSession, path: str) -> None:
    if path in _MADE:
        _MADE.remove(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bounded_groups(spark: SparkSession) -> None:
    """Bound the row groups that tasks write and the rows that they decode at once, as each task of a JVM holds its own: by
    Spark's defaults these are 128 MB and 4,096 texts, however long."""
    spark.conf.set("parquet.block.size", str(GROUP_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def shipped(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application: they may run where it is not on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='kindred-')}/{top.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(top.rglob("*.py")):
            packed.write(source, str(source.relative_to(top.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that a helper's columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_of(column: str | Column = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
