"""Registered queries of the engine's own operators, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import rid
from basalt.operators import keyed, wal
from basalt.operators.engine import Engine, scan
from basalt.plans.syntax import ColumnSpec
from basalt.sources.catalog import Catalog, Index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select(name: str, engine_sql: str, oracle: str | None = None) -> None:
    """Register a SELECT of the engine; the oracle is the same text if not given."""
    where = engine_sql.split(" FROM ")[1].split()[0]
    QUERIES[name] = lambda spark, sf_dir: scan(table(spark, sf_dir, where), engine_sql)
    SQL[name] = oracle or engine_sql


def query(oracle: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = oracle
        return f

    return register


PART = "SELECT p_partkey, p_brand, p_size FROM part WHERE "
LINE = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
ORDER = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE "

select("flagship", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 30")
select("scan_all", "SELECT * FROM nation")
select("project_cols", "SELECT n_name, n_nationkey FROM nation")
select("filter_eq_int", ORDER + "o_custkey = 370")
select("filter_lit_left", ORDER + "370 = o_custkey")
select("filter_eq_str", ORDER + "o_orderstatus = 'P'")
select("filter_ne_str", ORDER + "o_orderstatus <> 'P'")
select("filter_lt", LINE + "l_linenumber < 3")
select("filter_gt", LINE + "l_linenumber > 3")
select("filter_le", LINE + "l_linenumber <= 3")
select("filter_ge", LINE + "l_linenumber >= 3")
select("filter_and", PART + "p_size > 10 AND p_size <= 20")
select("filter_or", PART + "p_size = 1 OR p_brand = 'Brand#2'")
select("filter_not", PART + "NOT (p_size > 25)")
select("filter_neg", PART + "p_size > -5 + 20")
select("arith_add", PART + "p_size + 3 > 40")
select("arith_sub", PART + "p_size - 3 > 40")
select("arith_mul", PART + "p_size * 3 > 100")
select("arith_div", PART + "p_size / 4 = 5", PART + "p_size // 4 = 5")
select("div_zero_drops", PART + "100 / (p_size - 7) > 5", PART + "p_size <> 7 AND 100 // nullif(p_size - 7, 0) > 5")
select("strict_or", PART + "p_size = 7 OR 100 / (p_size - 7) > 5", PART + "p_size <> 7 AND (p_size = 7 OR 100 // nullif(p_size - 7, 0) > 5)")
select("precedence", PART + "p_size + 2 * 3 > 20 AND p_size < 40 OR p_size = 1")
select("not_binds_tight", PART + "NOT p_size = 5", PART + "false")
select("overflow_drops", PART + "p_size * 100000000 > 0", PART + "p_size::BIGINT * 100000000 BETWEEN 1 AND 2147483647")
select("type_mismatch_eq", PART + "p_brand = 5", PART + "false")
select("str_order_undefined", PART + "p_brand < 'X'", PART + "false")
select("type_mismatch_ne", PART + "p_brand <> 5", PART + "true")

_HOLES = "(SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS p_size FROM part)"


def _holes(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    size = F.when(F.col("p_size") > 40, None).otherwise(F.col("p_size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", size.alias("p_size"))
    return scan(rows, f"SELECT p_partkey, p_size FROM holes WHERE {condition}")


for _name, _condition, _oracle in (
    ("null_eq", "p_size = NULL", "p_size IS NULL"),
    ("null_ne", "p_size <> 5", "p_size IS DISTINCT FROM 5"),
    ("null_lt", "p_size < 5", "p_size < 5"),
    ("null_not_lt", "NOT (p_size < 5)", "p_size >= 5"),
):
    QUERIES[_name] = lambda spark, sf_dir, c=_condition: _holes(spark, sf_dir, c)
    SQL[_name] = f"SELECT p_partkey, p_size FROM {_HOLES} WHERE {_oracle}"


def warehouse(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.startswith("local["):
        return "file://" + tempfile.mkdtemp(prefix="basalt")
    return f"{(shared or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/basalt-engine/{uuid.uuid4().hex}"


def engine(spark: SparkSession, *statements: str, log: bool = False) -> Engine:
    """An engine in a folder of its own, after these statements."""
    path = warehouse(spark)
    out = Engine(spark, path, wal.WriteAheadLog(spark, path + "/_log") if log else None)
    for sql in statements:
        out.execute(sql)
    return out


_PARTS_TABLE = "CREATE TABLE part (p_partkey INTEGER, p_name VARCHAR(60), p_size INTEGER)"


@query("SELECT p_partkey::INTEGER AS p_partkey, p_name, p_size::INTEGER AS p_size FROM part WHERE p_partkey = 42 UNION ALL SELECT 42, 'late', 7")
def index_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE, rows, CREATE INDEX, an INSERT and a lookup of its key."""
    e = engine(spark, _PARTS_TABLE)
    e.load("part", _parts(spark, sf_dir))
    e.execute("CREATE INDEX part_key ON part (p_partkey)")
    e.execute("INSERT INTO part VALUES (42, 'late', 7)")
    return e.execute("SELECT * FROM part WHERE p_partkey = 42").frame


@query("SELECT r_regionkey::INTEGER AS r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def insert_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, "CREATE TABLE region (r_regionkey INTEGER, r_name VARCHAR)")
    e.load("region", table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    e.execute("INSERT INTO region VALUES (90 + 9, 'ATLANTIS')")
    return e.execute("SELECT * FROM region").frame


@query("SELECT n_nationkey::INTEGER AS n_nationkey, n_name, n_regionkey::INTEGER AS n_regionkey FROM nation UNION ALL SELECT 99, 'LEMURIA', NULL")
def insert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, "CREATE TABLE nation (n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER)")
    e.load("nation", table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    e.execute("INSERT INTO nation (n_name, n_nationkey) VALUES ('LEMURIA', 99)")
    return e.execute("SELECT * FROM nation").frame


_INCOMING = "(SELECT p_partkey * 3 AS p_partkey, 'new' AS p_name, p_size FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")


@query(f"SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT * FROM {_INCOMING} i WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = i.p_partkey)")
def keyed_insert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return keyed.insert(parts, parts.select((F.col("p_partkey") * 3).alias("p_partkey"), F.lit("new").alias("p_name"), "p_size"), "p_partkey", F.col("p_size"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey = 17")
def keyed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.search(_parts(spark, sf_dir), "p_partkey", 17)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey * 5 FROM part)")
def keyed_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return keyed.delete(parts, parts.select((F.col("p_partkey") * 5).alias("p_partkey")), "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'changed' ELSE p_name END AS p_name, CASE WHEN p_partkey % 4 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part")
def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    changes = parts.where("p_partkey % 4 = 0").select("p_partkey", F.lit("changed").alias("p_name"), (F.col("p_size") + 100).alias("p_size"))
    return keyed.update(parts, changes, "p_partkey")


def _heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias(keyed.ROW_ID), "p_name", "p_size")


@query("SELECT p_partkey AS _row_id, p_name, p_size FROM part WHERE p_partkey = 9")
def heap_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.heap_get(_heap(spark, sf_dir), 9)


@query("SELECT p_partkey AS _row_id, p_name, p_size FROM part WHERE p_partkey NOT IN (3, 5, 8)")
def heap_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.heap_delete(_heap(spark, sf_dir), [3, 5, 8])


@query("SELECT p_partkey AS _row_id, CASE WHEN p_partkey = 9 THEN 'renamed' ELSE p_name END AS p_name, p_size FROM part")
def heap_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.heap_update(_heap(spark, sf_dir), 9, p_name="renamed")


@query("SELECT count(*) AS n FROM part")
def tuple_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.tuple_count(table(spark, sf_dir, "part"))


@query("SELECT count(DISTINCT l_orderkey) AS n FROM lineitem")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a unique index over repeated keys: the first row of each stays."""
    return keyed.index_size(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT p_partkey, ((p_partkey & 65535) << 16) | (p_size & 65535) AS rid, p_partkey & 65535 AS page, (p_size & 65535)::BIGINT AS slot FROM part")
def rid_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ids keep their lower 16 bits."""
    packed = table(spark, sf_dir, "part").select("p_partkey", rid.pack(F.col("p_partkey"), F.col("p_size")).alias("rid"))
    return packed.select("p_partkey", "rid", rid.page_of(F.col("rid")).alias("page"), rid.slot_of(F.col("rid")).alias("slot"))


def _catalog(spark: SparkSession) -> Catalog:
    catalog = Catalog(spark, warehouse(spark))
    catalog.create_table("users", (ColumnSpec("id", "INTEGER", nullable=False), ColumnSpec("name", "VARCHAR", 50), ColumnSpec("active", "BOOLEAN")))
    catalog.create_table("orders", (ColumnSpec("id", "INTEGER"),))
    catalog.create_table("scratch", (ColumnSpec("id", "INTEGER"),))
    catalog.drop_table("scratch")
    catalog.add_index("users", Index("idx_id", "id"))
    return catalog


@query("SELECT * FROM (VALUES ('orders'), ('users')) t(table_name)")
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark).tables_frame()


@query("SELECT * FROM (VALUES ('id', 'INTEGER', false, 0, 'idx_id'), ('name', 'VARCHAR', true, 1, NULL), ('active', 'BOOLEAN', true, 2, NULL)) t(column_name, data_type, nullable, position, index_name)")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark).describe("users")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made from the events: users are transactions, and their events are records."""
    kind = F.create_map(*map(F.lit, ("signup", "BEGIN", "purchase", "COMMIT", "error", "ABORT", "click", "INSERT", "view", "UPDATE")))
    data = F.col("event_type").isin("click", "view")
    image = lambda side: F.when(data, F.concat(F.lit(side), F.col("event_id").cast("string"))).cast("binary")
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("lsn"), F.col("user_id").alias("txn_id"), kind[F.col("event_type")].alias("type"),
        F.when(data, F.col("event_id") % 50).cast("int").alias("page_id"), image("b").alias("before_image"), image("a").alias("after_image"),
    )


_WAL = """WITH wal AS (
  SELECT event_id + 1 AS lsn, user_id AS txn_id,
         CASE event_type WHEN 'signup' THEN 'BEGIN' WHEN 'purchase' THEN 'COMMIT' WHEN 'error' THEN 'ABORT' WHEN 'click' THEN 'INSERT' WHEN 'view' THEN 'UPDATE' END AS type,
         CASE WHEN event_type IN ('click', 'view') THEN (event_id % 50)::INTEGER END AS page_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'b' || event_id END AS before_image,
         CASE WHEN event_type IN ('click', 'view') THEN 'a' || event_id END AS after_image
  FROM events),
data AS (SELECT * FROM wal WHERE type IN ('INSERT', 'UPDATE', 'DELETE')),
txns AS (SELECT txn_id, max(lsn) AS last_lsn, arg_max(type, lsn) NOT IN ('COMMIT', 'ABORT') AS active, bool_or(type = 'COMMIT') AS committed FROM wal GROUP BY txn_id),
redo AS (SELECT page_id, arg_max(after_image, lsn) AS image, count(*) AS n_redone FROM data GROUP BY page_id),
undo AS (SELECT page_id, arg_min(before_image, lsn) AS image, count(*) AS n_undone FROM data WHERE txn_id IN (SELECT txn_id FROM txns WHERE active) GROUP BY page_id)
"""


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "binary" else f.name for f in rows.schema.fields))


@query(_WAL + "SELECT lsn, txn_id, type, page_id, before_image, after_image FROM wal ORDER BY lsn")
def wal_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(event_log(spark, sf_dir)).orderBy("lsn")


@query(_WAL + "SELECT lsn, txn_id, type, page_id, before_image, after_image FROM wal WHERE lsn = 77")
def wal_read_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(wal.at_lsn(event_log(spark, sf_dir), 77))


@query(_WAL + "SELECT * FROM txns")
def recovery_analysis_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.analysed_transactions(event_log(spark, sf_dir))


@query(_WAL + "SELECT page_id, min(lsn) AS first_lsn FROM data GROUP BY page_id")
def recovery_analysis_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.dirty_pages(event_log(spark, sf_dir))


@query(_WAL + "SELECT * FROM redo")
def recovery_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(wal.redone(event_log(spark, sf_dir)))


@query(_WAL + "SELECT * FROM undo")
def recovery_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(wal.undone(event_log(spark, sf_dir)))


@query(_WAL + "SELECT r.page_id, coalesce(u.image, r.image) AS image FROM redo r LEFT JOIN undo u USING (page_id)")
def recovery_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(wal.recovered(event_log(spark, sf_dir)))
