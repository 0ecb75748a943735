"""Where intermediate tables go, and how lineage is cut.

Everything that has to outlive one plan is written as Parquet below the
folder that the cluster shares (``spark.checkpoint.dir``), so that a lost
executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; where a local session names none (tests), one is made and removed at the end."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        found = tempfile.mkdtemp(prefix="corvane-checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: What the blocks of ``scratch`` that are open have written, the innermost last.
_OPEN: list[list[str]] = []


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. ``keep``: not removed by ``scratch``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


#: Rows of a side of a join that is broadcast at most (about 140 bytes each in memory). Left to itself Spark goes by the size of files, and rows of ids take ten times as much in memory.
BROADCAST_ROWS = 50_000


def beside(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join: broadcast if it has few rows (counted where ``rows`` is not given), else both sides go by key."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df.hint("merge")


def among(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``few``, which is sent and not ``df``: for a large table that a few rows look up."""
    return df.join(beside(few.select(key).distinct()), key, "left_semi")


#: Tables of texts up to so many bytes are dealt out to all cores: as one row group they would be one task's work.
SMALL_BYTES = 64 * 1024 * 1024
TEXTS = ("documents", "pages")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of ``folder``; larger ones, and those without long texts, are read as they are cut."""
    path = f"{folder}/{name}.parquet"
    rows = spark.read.parquet(path)
    if name not in TEXTS:
        return rows
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return rows.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_BYTES else rows


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells a table's state: the names, lengths and times of its files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


def _remove(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote for ``df``: for a state that the next one, already written, replaces."""
    _remove(df.sparkSession, df.written_at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are removed at the end, but for those to keep: the result must be one of these."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _remove(spark, path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of ``rows`` rows for the Python functions of the jobs that run inside; long texts fill a batch soon."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go as each ends; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
