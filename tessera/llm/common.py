"""Shared pieces of the pipeline operators: reading tables and cutting lineage in shared storage."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import shared_dir

ARROW_ROWS = 2000
_scopes: list[set[str]] = []
WS = r"\x20\x09-\x0D"
"""Body of the character class that separates words."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new name in the folder of this application's intermediate tables, which all executors share."""
    return f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tessera/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that were not written elsewhere go with them."""
    _delete(spark, _folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _frugal(spark: SparkSession) -> Iterator[None]:
    """Settings for a query planned and run within, put back afterwards. Arrow batches have at most ARROW_ROWS rows: rows
    hold whole texts, and batches of the usual 10,000 take much memory outside the heap on both sides. Shuffle files go
    when the query ends: else they lie until the driver happens to collect its garbage, which on a large input, where few
    objects come and go beside many bytes, can be after the last step."""
    before = {k: spark.conf.get(k) for k in (_BATCH, _CLEANUP)}
    rows = int(before[_BATCH])
    spark.conf.set(_BATCH, str(ARROW_ROWS if rows <= 0 else min(rows, ARROW_ROWS)))
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so later stages don't repeat its work
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    if _scopes:
        _scopes[-1].add(path)
    with _frugal(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables materialized within, but for those handed to what it yields. For work whose
    result is written before the end."""
    made: set[str] = set()
    _scopes.append(made)

    def keep(df: DataFrame) -> DataFrame:
        made.discard(df._tessera_path)
        return df

    try:
        yield keep
    finally:
        _scopes.remove(made)
        for path in made:
            _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            _delete(df.sparkSession, path)


LINGER = 2.0
"""Seconds that a worker keeps what it remembers after a task."""
_lock, _caches, _turn = threading.Lock(), set(), 0


def emptied(batches: Iterator[pa.RecordBatch], *caches: Callable[[], None]) -> Iterator[pa.RecordBatch]:
    """The batches of a task. If no other task follows within LINGER, its worker empties the caches and gives the memory
    back: workers live on, and what one stage remembers must not add to what the next one needs."""
    global _turn
    with _lock:
        _turn += 1
        _caches.update(caches)
    try:
        yield from batches
    finally:
        timer = threading.Timer(LINGER, _give_back, [_turn])
        timer.daemon = True
        timer.start()


def _give_back(turn: int) -> None:
    with _lock:
        if turn != _turn:  # another task has begun
            return
        for clear in _caches:
            clear()
        _caches.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
