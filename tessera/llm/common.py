"""Shared helpers of the corpus operators.

Intermediate tables that are read more than once are written as Parquet into the
folder all machines share (``spark.checkpoint.dir``), so a lost executor costs a
re-read and nothing is recomputed from an unstable source.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once, whatever the size of a document batch.
SLICE_BYTES = 16 << 20

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a table is written: shuffle files go when the query ends, and Python workers get batches of bounded bytes.
_WHILE_WRITING = {_FILE_CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(SLICE_BYTES)}
_ours: list[tuple[SparkSession, str]] = []
_path_of: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset, and never on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            current = spark.sparkContext.getCheckpointDir()
        configured = current
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage, survives lost executors)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _files_go(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _ours.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[id(out)] = path
    return out


@contextlib.contextmanager
def _files_go(spark: SparkSession) -> Iterator[None]:
    """Settings of the queries inside, whose results are tables when they end."""
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(table: DataFrame, part: str = "") -> None:
    """Delete a table of ``materialize``, or one folder (``column=value``) of it, that nothing reads any more."""
    if part:
        for spark, path in _ours:
            if path == _path_of.get(id(table)):
                _delete(spark, f"{path}/{part}")
        return
    path = _path_of.pop(id(table), None)
    for entry in [e for e in _ours if e[1] == path]:
        _ours.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean_scratch() -> None:
    """Delete the shared tables written by this process. Results that still read them become invalid."""
    while _ours:
        _delete(*_ours.pop())


atexit.register(clean_scratch)


def small_side(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small, else unchanged (a shuffled join then)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Bits of the filter of ``maybe_among``: at most 2 ** 20 words of 64 bits are broadcast, whatever the number of ids.
FILTER_BITS = 1 << 26


def maybe_among(rows: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only if ``key`` is not in the one column of ``ids``.

    Of the other rows about ``len(ids) / FILTER_BITS`` are true as well. A null key is
    hashed like any other.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = ids.select(place(F.col(f"`{ids.columns[0]}`")).alias("__place")).distinct()
    bits = bits.select(F.shiftright("__place", 6).alias("__word"), F.expr("shiftleft(1L, cast(__place % 64 as int))").alias("__bit"))
    bits = bits.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    asked = rows.withColumn("__place", place(F.col(f"`{key}`"))).withColumn("__word", F.shiftright("__place", 6))
    hit = F.expr("coalesce(shiftright(__bits, cast(__place % 64 as int)) & 1, 0) = 1")
    return asked.join(F.broadcast(bits), "__word", "left").withColumn(flag, hit).select(*rows.columns, flag)


#: Keys with more than this share of all rows are hot; there are at most its inverse of them.
HOT_SHARE = 1e-4


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join with ``right``, whose ``keys`` are unique and whose column ``size`` counts their rows in ``left``.

    Keys that hold more than HOT_SHARE of the ``total`` rows are few by arithmetic;
    they are broadcast and their rows never meet in one task. No other key has more.
    """
    hot = right.where(F.col(size) > F.lit(total * HOT_SHARE))
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(right.where(F.col(size) <= F.lit(total * HOT_SHARE)), keys))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the strings of ``column`` stay below ``limit`` bytes a piece (one row at least)."""
    for start, n in _cuts(batch.column(column), limit):
        yield batch.slice(start, n)


def pieces(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The strings of a column in pieces below ``limit`` bytes (one row at least)."""
    for start, n in _cuts(texts, limit):
        yield texts.slice(start, n)


def _cuts(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    if texts.nbytes <= limit or len(texts) < 2:
        yield 0, len(texts)
        return
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if held and held + n > limit:
            yield start, i - start
            start, held = i, 0
        held += n
    yield start, len(texts) - start


def release_memory() -> None:
    """Give memory that a Python worker has freed back to the machine; workers live on and run other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def train_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def sample_below(key: Column, rate: float) -> Column:
    """True for a hash-chosen share ``rate`` of the keys; the same keys on every run."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(min(1.0, rate) * (1 << 30)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
