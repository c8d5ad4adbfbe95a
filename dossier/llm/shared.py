"""What the operators share: shared-folder tables that cut lineage, size-checked broadcasts, document access."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.session import shared_dir

#: Bytes and rows up to which a side may be broadcast; a larger side is joined by a shuffle.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew if it has fewer partitions than the session has cores, as a single small file does; unchanged otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class _Scopes(threading.local):
    """The open scopes of a thread, the innermost last: operators in two threads don't remove each other's tables."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


#: Rows and bytes of an Arrow batch while whole texts or packed rows go to Python workers: bounds what a worker and its executor hold at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def _stored(spark: SparkSession, path: str) -> tuple:
    """A path's file system and the path, as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the application ends (what a lazy result still reads can't go before)."""
    files, where = _stored(spark, path)
    files.deleteOnExit(where)
    return path


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session have at most ``BATCH_ROWS`` rows and, but for one row's, ``BATCH_BYTES`` bytes from now on: what a lazy result sends to Python is cut up when it runs, after its operator."""
    rows, size = int(spark.conf.get(_BATCH)), spark.conf.get(_BYTES, None)
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if not size or not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives freed memory back: Spark keeps it for other tasks, and allocators keep what a task freed, so an executor would hold the most that each worker ever took."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)

    return whole


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go when it ends, but for those written with ``keep``, which belong to the scope around it (or stay).

    Arrow batches inside have at most ``BATCH_ROWS`` rows and, but for one row's, ``BATCH_BYTES`` bytes.
    """
    rows, size = spark.conf.get(_BATCH), spark.conf.get(_BYTES, None)
    spark.conf.set(_BATCH, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
    spark.conf.set(_BYTES, str(BATCH_BYTES))
    _SCOPES.open.append([])
    try:
        yield
    finally:
        spark.conf.set(_BATCH, rows)
        spark.conf.set(_BYTES, size) if size else spark.conf.unset(_BYTES)
        for path in _SCOPES.open.pop():
            files, where = _stored(spark, path)
            files.delete(where, True)


def written(df: DataFrame, name: str, keep: bool = False, narrow: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends here, and a lost executor costs no recomputation beyond it. It goes with its scope, or else with the application.

    ``narrow``: a table of ids or counts, written by an eighth of the partitions (the session's cores at least), as each file costs more than its rows.
    """
    if narrow:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, partitions(df.sparkSession) // 8))
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.open[:-1] if keep else _SCOPES.open
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    if not scopes:
        until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(spark: SparkSession, name: str, content: bytes) -> str:
    """The path of a file of ``content`` in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}"
    files, where = _stored(spark, path)
    out = files.create(where)
    out.write(content)
    out.close()
    return until_exit(spark, path)


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its measured size is at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes, unchanged otherwise. ``df`` is best a written table, as it is read for that."""
    fixed, sizes = 8 * (len(df.schema) + 1), []
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)))
    row = F.lit(fixed) if not sizes else sum(sizes, F.lit(fixed))
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(row.cast("long"))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def apart(columns: list[str], name: str = "own") -> str:
    """A column name that isn't among ``columns``, in whatever case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
