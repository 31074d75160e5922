"""Keyed tables and heaps, a batch of rows at a time.

Functions take and give DataFrames; nothing is changed in place. KeyedTable keeps such a table in
the catalog and publishes a new version for each change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.plans.syntax import ColumnSpec
from basalt.sources.catalog import Catalog, Index

ROW_ID = "_row_id"


def first_of_each(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The first row of each non-null key, in the given order (or that of arrival). Rows of a key are
    reduced to one in each task before they are shuffled, so a frequent key costs no more than others."""
    order = F.monotonically_increasing_id() if order is None else order
    whole = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), order.alias("_order"), F.struct(*rows.columns).alias("_row"))
    kept = whole.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row"))
    return kept.select("_row.*")


def index_size(rows: DataFrame, key: str) -> DataFrame:
    """n: the keys of a unique index on rows."""
    return rows.agg(F.count_distinct(key).alias("n"))


def insert(table: DataFrame, rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """table and those of rows whose key it doesn't have; of several rows with a key, the first."""
    return table.unionByName(fresh(table, rows, key, order))


def fresh(table: DataFrame, rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    return first_of_each(rows, key, order).join(table.select(key), key, "left_anti").select(*table.columns)


def search(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the rows whose key is among `keys` (a column of the same name)."""
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def update(table: DataFrame, rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Whole rows replaced by key; rows with unknown keys do nothing."""
    new = first_of_each(rows, key, order).select(F.col(key), F.struct(*table.columns).alias("_new"))
    joined = table.join(new, key, "left")
    return joined.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in table.columns))


def heap_get(heap: DataFrame, row_id: int) -> DataFrame:
    return heap.where(F.col(ROW_ID) == row_id)


def heap_delete(heap: DataFrame, row_ids: list[int]) -> DataFrame:
    return heap.where(~F.col(ROW_ID).isin(*row_ids))


def heap_update(heap: DataFrame, row_id: int, **values) -> DataFrame:
    """Named columns of one row replaced; it keeps its id."""
    return heap.select(*(F.when(F.col(ROW_ID) == row_id, F.lit(values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in heap.schema.fields))


def tuple_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n"))


class Heap:
    """Rows with surrogate ids in the catalog. Changes rewrite the table and then publish it."""

    def __init__(self, catalog: Catalog, name: str, columns: tuple[ColumnSpec, ...] = ()):
        self.catalog, self.name = catalog, name
        self.columns = [c.name for c in columns] or [f.name for f in catalog.tables[name].to_schema().fields[1:]] if columns or name in catalog.tables else []
        self.last: tuple = (None, 0)  # the folders that were read last, and the largest id in them
        catalog.create_table(name, (ColumnSpec(ROW_ID, "INTEGER"), *columns))

    def rows(self) -> DataFrame:
        return self.catalog.rows(self.name)

    def insert(self, *rows: tuple) -> list[int]:
        with self.catalog.lock:
            folders = self.catalog.tables[self.name].folders
            last = self.last[1] if self.last[0] == folders else self.rows().agg(F.max(ROW_ID)).first()[0] or 0
            ids = list(range(last + 1, last + 1 + len(rows)))
            frame = self.catalog.spark.createDataFrame([(i, *r) for i, r in zip(ids, rows, strict=True)], self.catalog.tables[self.name].to_schema())
            self.catalog.publish(self.name, add=(self.catalog.write(self.name, frame, few=True),))
            self.last = (self.catalog.tables[self.name].folders, last + len(rows))
            return ids

    def get(self, row_id: int) -> tuple | None:
        row = heap_get(self.rows(), row_id).first()
        return None if row is None else tuple(row)[1:]

    def delete(self, row_id: int) -> bool:
        with self.catalog.lock:
            if self.get(row_id) is None:
                return False
            self._rewrite(heap_delete(self.rows(), [row_id]))
            return True

    def update(self, row_id: int, values: tuple) -> bool:
        with self.catalog.lock:
            if self.get(row_id) is None:
                return False
            self._rewrite(heap_update(self.rows(), row_id, **dict(zip(self.columns, values, strict=True))))
            return True

    def tuple_count(self) -> int:
        return self.rows().count()

    def _rewrite(self, rows: DataFrame) -> None:
        self.catalog.publish(self.name, instead=(self.catalog.write(self.name, rows),))


class KeyedTable:
    """A table with a unique INTEGER key in the catalog. strict_tombstones: a deleted key can't be
    inserted again while this object lives."""

    def __init__(self, catalog: Catalog, name: str, columns: tuple[ColumnSpec, ...] = (), key: str | None = None, strict_tombstones: bool = False):
        self.catalog, self.name = catalog, name
        if catalog.create_table(name, tuple(columns)):
            catalog.add_index(name, Index(f"{name}_key", key or columns[0].name))
        self.key = catalog.tables[name].indexes[0].column
        self.dead: set[int] | None = set() if strict_tombstones else None

    def rows(self) -> DataFrame:
        return self.catalog.rows(self.name)

    def _frame(self, rows) -> DataFrame:
        return rows if isinstance(rows, DataFrame) else self.catalog.spark.createDataFrame(list(rows), self.catalog.tables[self.name].to_schema())

    def insert(self, rows) -> int:
        """Insert rows (a DataFrame or tuples) with new, non-null keys; how many went in."""
        with self.catalog.lock:
            new = fresh(self.rows(), self._frame(rows), self.key)
            if self.dead:
                new = delete(new, self.catalog.spark.createDataFrame([(k,) for k in self.dead], f"`{self.key}` int"), self.key)
            folder = self.catalog.write(self.name, new, (self.key,))
            n = self.catalog.spark.read.parquet(folder).count()
            if n:
                self.catalog.publish(self.name, add=(folder,))
            return n

    def search(self, key: int) -> tuple | None:
        row = search(self.rows(), self.key, key).first()
        return None if row is None else tuple(row)

    def delete(self, key: int) -> bool:
        with self.catalog.lock:
            if self.search(key) is None:
                return False
            self._rewrite(self.rows().where(F.col(self.key) != key))
            if self.dead is not None:
                self.dead.add(key)
            return True

    def update(self, key: int, row: tuple) -> bool:
        """Replace a row; the new row must have the same key."""
        at = self.catalog.tables[self.name].position(self.key)
        with self.catalog.lock:
            if row[at] != key or self.search(key) is None:
                return False
            self._rewrite(update(self.rows(), self._frame([row]), self.key))
            return True

    def size(self) -> int:
        return self.rows().count()

    def empty(self) -> bool:
        return self.rows().isEmpty()

    def _rewrite(self, rows: DataFrame) -> None:
        self.catalog.publish(self.name, instead=(self.catalog.write(self.name, rows, (self.key,)),))
