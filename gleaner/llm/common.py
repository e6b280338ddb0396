"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import ensure_checkpoint_dir

#: the word rule shared by several operators: maximal runs of anything but these blanks
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A deployment ships the package (``--py-files`` or an installed wheel); this covers
    sessions started elsewhere, such as tests run from another folder.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (paths, root) if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps of a long loop.

    Its cleaner acts when the driver's JVM collects garbage, which a mostly idle driver
    may put off for half an hour while the executors' disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key() -> Column:
    """A unique key per scanned row, for use within one scan.

    It follows from the file splits, and another scan may cut the files otherwise (the
    split size depends on the cores registered at that moment): results of an earlier
    job join back to the table by ``file_row``.
    """
    return F.monotonically_increasing_id()


def file_row() -> Column:
    """A unique key per row of a stored table: (hash of the file's path, row number in the file).

    Tables may repeat a doc_id; joins back to the text use this key instead. It does not
    depend on file splits, so every job and every re-run sees the same keys. On a table
    that is not read from files the key cannot be resolved and the query fails.
    """
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


_kept: dict[str, object] = {}


def worker_keeps(name: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task (a tokenizer with the words it knows).

    Spark uses its workers again for other stages, so a worker keeps one operator's
    object at a time: another name, or ``worker_lets_go``, gives the memory back."""
    if name not in _kept:
        worker_lets_go()
        _kept[name] = make()
    return _kept[name]


def worker_lets_go() -> None:
    """Drop what earlier stages left in this Python worker; for tasks that need its memory themselves."""
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory for the worker otherwise
        trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_interval(*cols) -> Column:
    """A reproducible draw strictly inside (0, 1) from the hash of the given columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))
