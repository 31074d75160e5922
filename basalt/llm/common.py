"""What several operators share: shipping the code, the shared folder, byte-balanced batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group of intermediate tables, and of the tables that are broadcast at most.
ROW_GROUP, BROADCAST_BYTES = 16 << 20, 32 << 20
PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_basalt_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="basalt")
    path = os.path.join(folder, "basalt_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._basalt_shipped = True


@functools.cache
def _libc():
    """The C library, with large blocks set to go back to the system as soon as they are freed."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        return None
    return libc


def lean(run):
    """A function of batches for mapInArrow, after which its worker, which Spark keeps for later tasks, gives
    freed memory back to the system."""

    @functools.wraps(run)
    def wrapped(batches):
        libc = _libc()
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            if libc:
                libc.malloc_trim(0)

    return wrapped


def lean_group(run):
    """The same for a function of one group's table, for applyInArrow."""

    whole = lean(lambda tables: map(run, tables))

    @functools.wraps(run)
    def wrapped(table: pa.Table) -> pa.Table:
        (out,) = whole([table])
        return out

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset on
    one machine (as in tests), a folder of our own. A cluster without the setting is refused, since
    its executors would write to disks of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_basalt_shared", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="basalt-shared")
        spark.sparkContext._basalt_shared = path
    return path.rstrip("/")


_open = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that saved() writes inside are deleted when the block ends, but for those to keep, which
    then belong to the block around it, if there is one."""
    outer = getattr(_open, "tables", None)
    _open.tables = own = []
    try:
        yield
    finally:
        _open.tables = outer
        for path, keep in own:
            if not keep:
                delete(spark, path)
            elif outer is not None:
                outer.append((path, False))


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so a lost
    executor costs no recomputation of what came before. Row groups are small and hashes aren't
    looked up in dictionaries, so that writers need little memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/basalt/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "tables", None) is not None:
        _open.tables.append((path, keep))
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("parquet.enable.dictionary", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._basalt_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_saved(df: DataFrame) -> None:
    """Delete a table that saved() wrote, once nothing reads it any more."""
    delete(df.sparkSession, df._basalt_path)


def small(rows: DataFrame) -> DataFrame:
    """The same rows, marked for broadcast if they are measured to take at most BROADCAST_BYTES: strings
    and binaries by their bytes, and 24 bytes a value besides."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in rows.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = F.lit(24 * len(rows.columns)).cast("long")
    for w in wide:
        size = size + w
    total = rows.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a string column, nulls empty, and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return b"", np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (memoryview(data)[at[0] : at[-1]].tobytes() if data is not None else b""), at - at[0]


def byte_groups(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    if not len(column):
        return
    at = utf8_offsets(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


def utf8_offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return at[column.offset : column.offset + len(column) + 1].astype(np.int64)


def slices(data: bytes, starts: np.ndarray) -> pa.Array:
    """The byte strings between consecutive offsets (`starts` includes the end), without copying."""
    if len(data) < 2**31 - 1:
        kind, dtype = pa.binary(), np.int32
    else:
        kind, dtype = pa.large_binary(), np.int64
    return pa.Array.from_buffers(kind, len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, dtype)), pa.py_buffer(data)])


#: Rows of the bitmaps below, of 64 bits each: so much is broadcast at most.
BITMAP_WORDS = 1 << 18


def _bit(key: Column, n_words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(64 * n_words))


def bitmap(rows: DataFrame, key: Column, n_words: int = BITMAP_WORDS) -> DataFrame:
    """A table of at most n_words rows with a bit set for the hash of each key."""
    bits = rows.select(_bit(key, n_words).alias("bit"))
    return bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word_")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits_"))


def maybe_in(rows: DataFrame, key: Column, bits: DataFrame, n_words: int = BITMAP_WORDS) -> DataFrame:
    """The rows whose key is in a bitmap's table, and some others: what is left is joined exactly, but
    fewer rows are shuffled for it. The bitmap has a fixed size, so it can be broadcast."""
    columns = rows.columns
    at = rows.withColumn("bit_", _bit(key, n_words)).withColumn("word_", F.shiftright("bit_", 6).cast("int"))
    return at.join(F.broadcast(bits), "word_").where("shiftright(bits_, cast(bit_ & 63 as int)) & 1 = 1").select(*(F.col(f"`{c}`") for c in columns))
