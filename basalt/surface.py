"""Registered queries of what has no rows of the test tables behind it: parser, catalog, transactions,
log, locks and shell. Each does the work and returns what came of it as rows (fact, value); its SQL
states what has to come of it."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.cli import Shell
from basalt.operators import keyed, wal
from basalt.operators.engine import Engine
from basalt.operators.transactions import EXCLUSIVE, SHARED, LockManager, TransactionManager
from basalt.plans.syntax import Binary, ColumnSpec, CreateIndex, CreateTable, Insert, Literal, Name, Select, SyntaxProblem, Unary, parse, tokenize
from basalt.queries import _WAL, QUERIES, SQL, engine, event_log, query, warehouse
from basalt.sources.catalog import Catalog, Index


def text(value) -> str:
    if value is None:
        return "NULL"
    return str(value).lower() if isinstance(value, bool) else str(value)


def facts(**want):
    """Register f, which gives a dict of facts, with what they should be."""
    cells = ", ".join(f"('{k}', '{str(v).replace(chr(39), 2 * chr(39))}')" for k, v in want.items())

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: spark.createDataFrame([(k, text(v)) for k, v in f(spark).items()], "fact string, value string")
        SQL[f.__name__] = f"SELECT * FROM (VALUES {cells}) t(fact, value)"
        return f

    return register


def shown(e) -> str:
    """An expression with all its brackets."""
    if isinstance(e, Literal):
        return f"'{e.value}'" if isinstance(e.value, str) else text(e.value)
    if isinstance(e, Name):
        return e.column
    if isinstance(e, Unary):
        return f"({e.op} {shown(e.operand)})"
    return f"({shown(e.left)} {e.op} {shown(e.right)})" if isinstance(e, Binary) else repr(e)


def where(condition: str) -> str:
    return shown(parse(f"SELECT * FROM t WHERE {condition}").where)


def problem(sql: str, lenient: bool = False) -> str:
    try:
        return type(parse(sql, lenient)).__name__
    except SyntaxProblem as e:
        return str(e).removeprefix("Parse error at ")


def kinds(sql: str) -> str:
    return " ".join(t.kind for t in tokenize(sql)[:-1])


@facts(create="Table created: t", index="Index created: i", insert="INSERT completed", select="SELECT completed (sequential scan)", none="Null statement", nonsense="Unknown statement type")
def statement_dispatch(spark):
    e = engine(spark)
    found = [e.execute(s) for s in ("CREATE TABLE t (a INTEGER)", "CREATE INDEX i ON t (a)", "INSERT INTO t VALUES (1)", "SELECT * FROM t", None, 7)]
    return dict(zip(("create", "index", "insert", "select", "none", "nonsense"), (r.message for r in found), strict=True))


@facts(upper="SELECT FROM", lower="name name", mixed="name", types="INTEGER VARCHAR BOOLEAN NULL")
def parser_keywords(spark):
    return {"upper": kinds("SELECT FROM"), "lower": kinds("select from"), "mixed": kinds("Select"), "types": kinds("INTEGER VARCHAR BOOLEAN NULL")}


@facts(plain="name", underscore="name", digit_first="number name", case="false")
def parser_identifiers(spark):
    return {"plain": kinds("abc9"), "underscore": kinds("_a_1"), "digit_first": kinds("9abc"), "case": Name("a") == Name("A")}


@facts(largest="2147483647", beyond="line 1, column 25: Integer out of range: 2147483648", zeros="7", point="number invalid number")
def parser_numbers(spark):
    return {"largest": where("2147483647"), "beyond": problem("SELECT * FROM t WHERE a=2147483648"), "zeros": where("007"), "point": kinds("1.5")}


@facts(single="'it'", double="'it'", other_quote="'a\"b'", empty="''", open="invalid", comment_inside="'a--b'")
def parser_strings(spark):
    return {"single": where("'it'"), "double": where('"it"'), "other_quote": where("'a\"b'"), "empty": where("''"), "open": kinds("'never closed"), "comment_inside": where("'a--b'")}


@facts(all="= <> <> < > <= >= + - * / ( ) , ;", tight="(a <= 1)")
def parser_operators(spark):
    return {"all": kinds("= <> != < > <= >= + - * / ( ) , ;"), "tight": where("a<=1")}


@facts(comment="(a = 1)", blank="name name", only_comment="line 1, column 11: Empty input")
def parser_comments(spark):
    return {"comment": where("a -- of a\n = 1 -- the end"), "blank": kinds("a \t\r\n b"), "only_comment": problem("-- nothing")}


@facts(strict="line 1, column 17: Unexpected '?' after statement", lenient="Select", trailing="line 1, column 17: Unexpected 'more' after statement", trailing_lenient="Select", semicolon="Select")
def parser_lenient(spark):
    return {"strict": problem("SELECT * FROM t ?"), "lenient": problem("SELECT * FROM t ?", True), "trailing": problem("SELECT * FROM t more"), "trailing_lenient": problem("SELECT * FROM t more", True), "semicolon": problem("SELECT * FROM t;")}


@facts(integer="5", string="'s'", null="NULL", true="true", column="c", brackets="((1 + 2) * 3)", minus="(- (- x))", negation="(NOT (NOT b))", binds="((NOT a) = b)", levels="((a OR (b AND (c = (d < 2)))) OR e)", left="((1 - 2) - 3)")
def parser_expressions(spark):
    cases = {"integer": "5", "string": "'s'", "null": "NULL", "true": "true", "column": "c", "brackets": "(1 + 2) * 3", "minus": "- - x", "negation": "NOT NOT b", "binds": "NOT a = b", "levels": "a OR b AND c = d < 2 OR e", "left": "1 - 2 - 3"}
    return {k: where(v) for k, v in cases.items()}


@facts(first="line 1, column 1: Expected CREATE, SELECT, or INSERT", later="line 2, column 3: Expected FROM in SELECT statement", create="line 1, column 8: Expected TABLE or INDEX after CREATE", type="line 1, column 19: Expected type name (INTEGER, VARCHAR, or BOOLEAN)", values="line 1, column 15: Expected VALUES in INSERT statement", empty="line 1, column 1: Empty input")
def parser_first_error(spark):
    cases = {"first": "DROP x y z", "later": "SELECT a\n  b c", "create": "CREATE VIEW v", "type": "CREATE TABLE t (a DATE, b DATE)", "values": "INSERT INTO t 1", "empty": ""}
    return {k: problem(v) for k, v in cases.items()}


@facts(create="t 2 INTEGER VARCHAR 9", index="i t a", insert="t ('b', 'a') 2", select="t ('a',) None")
def parser_statements(spark):
    c, i, n, s = (parse(x) for x in ("CREATE TABLE t (a INTEGER, b VARCHAR(9))", "CREATE INDEX i ON t (a)", "INSERT INTO t (b, a) VALUES (1, 2)", "SELECT a FROM t"))
    assert isinstance(c, CreateTable) and isinstance(i, CreateIndex) and isinstance(n, Insert) and isinstance(s, Select)
    return {"create": f"{c.table} {len(c.columns)} {c.columns[0].type} {c.columns[1].type} {c.columns[1].max_length}", "index": f"{i.index} {i.table} {i.column}", "insert": f"{n.table} {n.columns} {len(n.values)}", "select": f"{s.table} {s.columns} {s.where}"}


@facts(equal="SELECT completed (index scan)", turned="SELECT completed (index scan)", none="SELECT completed (index scan, no match)", range="SELECT completed (sequential scan)", both="SELECT completed (sequential scan)", string="SELECT completed (sequential scan)", rows="3")
def index_or_scan(spark):
    e = engine(spark, "CREATE TABLE t (a INTEGER, b VARCHAR)", *(f"INSERT INTO t VALUES ({i}, 'x{i}')" for i in (1, 2, 3)), "CREATE INDEX i ON t (a)", "CREATE INDEX j ON t (b)")
    run = lambda c: e.execute(f"SELECT * FROM t WHERE {c}")
    return {"equal": run("a = 2").message, "turned": run("2 = a").message, "none": run("a = 9").message, "range": run("a > 1").message, "both": run("a = 1 AND a = 1").message, "string": run("b = 'x1'").message, "rows": e.execute("SELECT * FROM t").rows_affected}


def _heap(spark) -> keyed.Heap:
    return keyed.Heap(Catalog(spark, warehouse(spark)), "h", (ColumnSpec("a", "INTEGER"), ColumnSpec("b", "VARCHAR")))


@query("SELECT * FROM (VALUES (1, 10, 'x'), (2, 20, NULL), (3, 30, 'z'), (4, 40, 'late')) t(_row_id, a, b)")
def heap_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _heap(spark)
    h.insert((10, "x"), (20, None), (30, "z"))
    keyed.Heap(h.catalog, "h").insert((40, "late"))
    return h.rows()


@query("SELECT * FROM (VALUES (1, 'one'), (3, 'three')) t(k, v)")
def keyed_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table after it was closed and opened again, its keys still unique."""
    path = warehouse(spark)
    keyed.KeyedTable(Catalog(spark, path), "k", (ColumnSpec("k", "INTEGER"), ColumnSpec("v", "VARCHAR"))).insert([(1, "one"), (2, "two")])
    again = keyed.KeyedTable(Catalog(spark, path), "k")
    again.insert([(1, "again"), (3, "three")])
    again.delete(2)
    return keyed.KeyedTable(Catalog(spark, path), "k").rows()


@query("SELECT * FROM (VALUES (7, 'seven')) t(a, b)")
def index_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by an index that another engine on the same folder made."""
    e = engine(spark, "CREATE TABLE t (a INTEGER, b VARCHAR)", "INSERT INTO t VALUES (7, 'seven')", "INSERT INTO t VALUES (8, 'eight')", "CREATE INDEX i ON t (a)")
    again = Engine(spark, e.catalog.warehouse)
    found = again.execute("SELECT * FROM t WHERE a = 7")
    assert found.point
    return found.frame


@facts(create="true", twice="false", get="t", missing="NULL", index="true", index_twice="false", index_nowhere="false", reopened="t", schema="id:int,email:string", length="100", remove="true", remove_twice="false", drop="true", drop_twice="false", left="0")
def catalog_calls(spark):
    c = Catalog(spark, warehouse(spark))
    columns = (ColumnSpec("id", "INTEGER", nullable=False), ColumnSpec("email", "VARCHAR", 100))
    out = {"create": c.create_table("t", columns), "twice": c.create_table("t", columns), "get": c.get_table("t").name, "missing": c.get_table("u")}
    out |= {"index": c.add_index("t", Index("i", "id")), "index_twice": c.add_index("t", Index("i", "id")), "index_nowhere": c.add_index("u", Index("i", "id"))}
    again = Catalog(spark, c.warehouse)
    schema = again.get_table("t").to_schema()
    out |= {"reopened": ",".join(again.list_tables()), "schema": ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema), "length": schema["email"].metadata["max_length"]}
    out |= {"remove": again.remove_index("t", "i"), "remove_twice": again.remove_index("t", "i"), "drop": again.drop_table("t"), "drop_twice": again.drop_table("t")}
    return out | {"left": len(Catalog(spark, c.warehouse).list_tables())}


@facts(both="a,b", tables="2")
def catalog_of_two_processes(spark):
    """Neither of two catalogs on one folder loses the other's table."""
    path = warehouse(spark)
    a, b = Catalog(spark, path), Catalog(spark, path)
    a.create_table("a", (ColumnSpec("x", "INTEGER"),))
    b.create_table("b", (ColumnSpec("x", "INTEGER"),))
    return {"both": ",".join(Catalog(spark, path).list_tables()), "tables": len(b.tables)}


@query("SELECT * FROM (VALUES ('t', 1), ('t', 2), ('u', 3)) x(table_name, a)")
def commit_publishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a transaction left in two tables, and none of a transaction that was aborted."""
    e = engine(spark, "CREATE TABLE t (a INTEGER)", "CREATE TABLE u (a INTEGER)", log=True)
    kept, lost = e.begin(), e.begin()
    for sql, txn in (("t VALUES (1)", kept), ("t VALUES (2)", kept), ("u VALUES (3)", kept), ("t VALUES (8)", lost), ("u VALUES (9)", lost)):
        e.execute(f"INSERT INTO {sql}", txn)
    e.abort(lost)
    e.commit(kept)
    of = lambda t: e.execute(f"SELECT * FROM {t}").frame.select(F.lit(t).alias("table_name"), "a")
    return of("t").union(of("u"))


@facts(ids="1 2", next="3", active="2", commit="true", commit_twice="false", abort="true", abort_none="false", gone="NULL", after="0", closed="aborted", log="BEGIN BEGIN COMMIT ABORT BEGIN ABORT")
def transaction_calls(spark):
    log = wal.WriteAheadLog(spark, warehouse(spark) + "/log")
    m = TransactionManager(log)
    a, b = m.begin(), m.begin()
    out = {"ids": f"{a.id} {b.id}", "next": m.next_id, "active": m.active_count, "commit": m.commit(a), "commit_twice": m.commit(a), "abort": m.abort(b), "abort_none": m.abort(None), "gone": m.get(1), "after": m.active_count}
    c = m.begin()
    m.close()
    return out | {"closed": c.state, "log": " ".join(r.type for r in log.read_all().collect())}


@facts(appended="1 2 3", reopened="4", next="4", read="b", missing="0", unknown="ValueError", kinds="BEGIN COMMIT ABORT INSERT UPDATE DELETE")
def log_calls(spark):
    log = wal.WriteAheadLog(spark, warehouse(spark) + "/log")
    out = {"appended": " ".join(str(log.append(1, *x)) for x in (("BEGIN",), ("UPDATE", 3, b"a", b"b"), ("COMMIT",)))}
    log.flush()
    again = wal.WriteAheadLog(spark, log.path)
    out |= {"reopened": again.next_lsn, "next": again.append(2, "BEGIN"), "read": again.read(2).first()["after_image"].decode(), "missing": again.read(99).count()}
    try:
        again.append(1, "CHECKPOINT")
    except ValueError as e:
        out["unknown"] = type(e).__name__
    return out | {"kinds": " ".join(wal.KINDS)}


@query(_WAL + """, images AS (SELECT r.page_id, coalesce(u.image, r.image) AS image FROM redo r LEFT JOIN undo u USING (page_id)),
pages AS (SELECT page_id::INTEGER AS page_id, repeat('.', (5 * (page_id % 4))::INTEGER) AS data FROM range(60) t(page_id))
SELECT page_id, CASE WHEN length(image) > 0 THEN image || substr(data, length(image) + 1) ELSE data END AS data FROM pages LEFT JOIN images USING (page_id)""")  # fmt: skip
def recovery_apply_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of several lengths, also ones that the log doesn't touch, after recovery."""
    pages = spark.range(60).select(F.col("id").cast("int").alias("page_id"), F.expr("cast(repeat('.', cast(5 * (id % 4) as int)) as binary)").alias("data"))
    return wal.recover(pages, event_log(spark, sf_dir)).select("page_id", F.col("data").cast("string").alias("data"))


@facts(shared="true", shared_by_two="true", upgrade_of_two="timeout", unlock="true", unlock_twice="false", upgrade="true", holds="true", exclusive_elsewhere="timeout", released="false", not_held="false", ended="false")
def lock_calls(spark):
    m = TransactionManager(locks=LockManager(timeout=0.05))
    locks, a, b = m.locks, m.begin(), m.begin()

    def tried(f, *args):
        try:
            return f(*args)
        except RuntimeError:
            return "timeout"

    out = {"shared": locks.lock_shared(a, 1), "shared_by_two": locks.lock_shared(b, 1), "upgrade_of_two": tried(locks.lock_upgrade, a, 1), "unlock": locks.unlock(b, 1), "unlock_twice": locks.unlock(b, 1)}
    out |= {"upgrade": locks.lock_upgrade(a, 1), "holds": locks.holds_lock(a, 1, EXCLUSIVE), "exclusive_elsewhere": tried(locks.lock_exclusive, b, 1)}
    locks.unlock_all(a)
    out |= {"released": locks.holds_lock(a, 1, SHARED), "not_held": locks.lock_upgrade(a, 1)}
    m.commit(a)
    return out | {"ended": locks.lock_shared(a, 2)}


@facts(tables="No tables found.", several_lines="Table created.", string_with_dashes="1 row inserted.", rows="a | b/1 | a--b;/1 row returned.", desc="index i on column 0", help="Commands:", unknown="Unknown command: \\what/Type \\help for help.", quit="")
def shell_session(spark):
    def said(shell, *lines):
        shell.out = io.StringIO()
        shell.run(lines)
        return [x for x in shell.out.getvalue().split("\n") if x and not x.endswith(" ms)")]

    shell = Shell(engine(spark))
    out = {"tables": said(shell, "\\tables"), "several_lines": said(shell, "CREATE TABLE t (a INTEGER, -- one; two", "b VARCHAR(9));"), "string_with_dashes": said(shell, "INSERT INTO t VALUES (1, 'a--b;');")}
    out |= {"rows": said(shell, "SELECT * FROM t;")}
    said(shell, "CREATE INDEX i ON t (a);")
    out |= {"desc": [x.strip() for x in said(shell, "\\desc t")][-1:], "help": said(shell, "\\help")[:1], "unknown": said(shell, "\\what"), "quit": said(shell, "\\q", "\\tables")}
    return {k: "/".join(v) for k, v in out.items()}
