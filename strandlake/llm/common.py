"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.storage import shared_dir

_C = ctypes.CDLL(None)
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Byte map for words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: A-Z to a-z, separators to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII characters; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of anything but ASCII white space; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, every other character kept."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows (of a few numbers) up to which a counted table is broadcast instead of shuffled.
BROADCAST_ROWS = 300_000

#: Paths of tables that stored() wrote, by application and thread, the newest stage's last; see stage_tables.
_written: dict[tuple[str, int], list[str]] = {}


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        with contextlib.suppress(Exception):  # the session may have ended before the process
            remove(spark, paths[-1])
        paths.pop()


def _own_tables(spark: SparkSession) -> list[str]:
    """The tables that this thread wrote; they are deleted when the process ends, if not before."""
    key = spark.sparkContext.applicationId, threading.get_ident()
    if key not in _written:
        _written[key] = []
        atexit.register(_remove_all, spark, _written[key])
    return _written[key]


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed as long as a query runs; those that cannot be changed stay."""
    was = {name: spark.conf.get(name) for name in values if spark.conf.isModifiable(name)}
    for name in was:
        spark.conf.set(name, values[name])
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


#: A query's shuffle files go when it ends; what it wrote is all that is read later.
_SHUFFLES_CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows of some MB each are read and handed to Python one by one.
_ROW_BY_ROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}


def stored(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage.

    Lost executors cost nothing already written; later reads prune columns. The table lasts as long as the
    process, or in a pipeline until the next stage. large_rows: the rows that df reads have some MB each.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake/{uuid.uuid4().hex}"
    with _settings(spark, _SHUFFLES_CLEANED | (_ROW_BY_ROW if large_rows else {})):
        df.write.parquet(path)
    _own_tables(spark).append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table that stored() gave, at once: nothing may still be read from it."""
    _own_tables(table.sparkSession).remove(table.stored_at)
    remove(table.sparkSession, table.stored_at)


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """df, stored and counted, with a broadcast hint if it has BROADCAST_ROWS rows at most; for narrow rows."""
    table = stored(df)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def new_stage(spark: SparkSession) -> None:
    """Deletes the tables that this thread stored for the stage before, whose result has been written by now, and frees
    what its functions still hold in the driver: models and broadcast tables."""
    _remove_all(spark, _own_tables(spark))
    gc.collect()
    hand_back()


def masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """docs under columns c0, c1, ..., which no helper column clashes with; the new name of each old one; and
    what selects and names the columns as they were."""
    names = docs.columns
    new = [f"c{i}" for i in range(len(names))]
    return docs.toDF(*new), dict(zip(names, new, strict=True)), lambda df: df.select(*[F.col(n).alias(o) for n, o in zip(new, names, strict=True)])


def remainder(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def hand_back() -> None:
    """A worker that waits for the next stage holds no freed memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text_at: int, max_bytes: int = 2_500_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into smaller ones of about max_bytes of text (a row is never cut)."""
    for batch in batches:
        lo, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > max_bytes:
                yield batch.slice(lo, i - lo)
                lo, size = i, 0
            size += n
        if lo < batch.num_rows:
            yield batch.slice(lo)
    hand_back()
