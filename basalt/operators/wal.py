"""A write-ahead log as a table, and recovery as aggregations over it."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("BEGIN", "COMMIT", "ABORT", "INSERT", "UPDATE", "DELETE")
DATA_KINDS = ("INSERT", "UPDATE", "DELETE")
PAGE_BYTES = 4076  # of an image that are applied
SCHEMA = T.StructType([T.StructField("lsn", T.LongType(), False), T.StructField("txn_id", T.LongType(), False), T.StructField("type", T.StringType(), False), T.StructField("page_id", T.IntegerType()), T.StructField("before_image", T.BinaryType()), T.StructField("after_image", T.BinaryType())])


class WriteAheadLog:
    """Records with rising numbers (lsn, from 1; a reopened log goes on after its last). Records are
    kept until flush(), which writes them as one Parquet folder of the log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.guard = threading.Lock()
        self.waiting: list[tuple] = []
        last = self._written().agg(F.max("lsn")).first()[0]
        self.next_lsn = (last or 0) + 1

    def _written(self) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        exists = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        if not exists:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def append(self, txn_id: int, kind: str, page_id: int | None = None, before: bytes | None = None, after: bytes | None = None) -> int:
        if kind not in KINDS:
            raise ValueError(f"not a log record type: {kind}")
        with self.guard:
            lsn = self.next_lsn
            self.next_lsn += 1
            self.waiting.append((lsn, txn_id, kind, page_id, before, after))
            return lsn

    def flush(self) -> None:
        with self.guard:
            if self.waiting:
                frame = self.spark.createDataFrame(self.waiting, SCHEMA).coalesce(1)
                frame.write.parquet(f"{self.path}/{self.waiting[0][0]:020d}-{uuid.uuid4().hex}")
                self.waiting = []

    def frame(self) -> DataFrame:
        """All records, also those not yet flushed."""
        rows = self._written()
        return rows.union(self.spark.createDataFrame(self.waiting, SCHEMA)) if self.waiting else rows

    def read_all(self) -> DataFrame:
        return self.frame().orderBy("lsn")

    def read(self, lsn: int) -> DataFrame:
        return at_lsn(self.frame(), lsn)


def at_lsn(log: DataFrame, lsn: int) -> DataFrame:
    return log.where(F.col("lsn") == lsn)


def of_data(log: DataFrame) -> DataFrame:
    return log.where(F.col("type").isin(*DATA_KINDS))


def analysed_transactions(log: DataFrame) -> DataFrame:
    """txn_id, last_lsn, active and committed. A data record makes its transaction active again, so
    the last record decides; committed tells whether there was a COMMIT at all."""
    last = F.max_by("type", "lsn")
    return log.groupBy("txn_id").agg(F.max("lsn").alias("last_lsn"), (~last.isin("COMMIT", "ABORT")).alias("active"), F.bool_or(F.col("type") == "COMMIT").alias("committed"))


def dirty_pages(log: DataFrame) -> DataFrame:
    """page_id and first_lsn of each page that a data record names."""
    return of_data(log).groupBy("page_id").agg(F.min("lsn").alias("first_lsn"))


def redone(log: DataFrame) -> DataFrame:
    """page_id, image (the last after-image that isn't empty) and n_redone (data records). All
    transactions count, whether they committed or not."""
    shown = F.when(F.length("after_image") > 0, F.col("lsn"))
    return of_data(log).groupBy("page_id").agg(F.max_by("after_image", shown).alias("image"), F.count(F.lit(1)).alias("n_redone"))


def undone(log: DataFrame) -> DataFrame:
    """page_id, image (the earliest before-image that isn't empty) and n_undone, over the data records of
    transactions that are still active."""
    losers = analysed_transactions(log).where("active").select("txn_id")
    shown = F.when(F.length("before_image") > 0, F.col("lsn"))
    return of_data(log).join(losers, "txn_id", "left_semi").groupBy("page_id").agg(F.min_by("before_image", shown).alias("image"), F.count(F.lit(1)).alias("n_undone"))


def recovered(log: DataFrame) -> DataFrame:
    """page_id and image of each touched page after redo and undo: what undo put back, else what redo
    left; null where neither has an image."""
    after, before = redone(log).select("page_id", F.col("image").alias("after")), undone(log).select("page_id", F.col("image").alias("before"))
    return after.join(before, "page_id", "left").select("page_id", F.coalesce("before", "after").alias("image"))


def apply_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages (page_id, data) with images laid over the start of their data, PAGE_BYTES at most. Empty
    images change nothing, and images of missing pages are dropped."""
    image = F.substring("image", 1, PAGE_BYTES)
    rest = F.expr("substring(data, length(image_) + 1)")
    laid = pages.join(images.select("page_id", image.alias("image_")), "page_id", "left")
    data = F.when(F.length("image_") > 0, F.concat("image_", F.when(F.length("data") > F.length("image_"), rest).otherwise(F.lit(b"")))).otherwise(F.col("data"))
    return laid.select("page_id", data.alias("data"))


def recover(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Analysis, redo and undo: pages as they are after a crash that left them and the log behind."""
    return apply_images(pages, recovered(log))
