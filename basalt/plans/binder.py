"""Expressions as Spark columns.

An expression has a static type, a value, and a condition that tells where it is defined. Undefined
is not NULL: it arises from operands of the wrong type, NULL in arithmetic or order comparisons,
division by zero and overflow, and it spreads through every operator (AND and OR too). Equality is
two-valued: NULL equals NULL and nothing else. A row passes WHERE if the condition is defined,
boolean and true.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.plans.syntax import Binary, Literal, Name, Unary

NUMBER, BOOLEAN, VARCHAR = "number", "boolean", "varchar"
COMPARE = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
FLIPPED = {"=": "=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True)
class Bound:
    """family: NUMBER, BOOLEAN, VARCHAR or the name of another Spark type; null is typed as a number.
    wide: a Spark type of numbers (int, bigint or double). ok is never NULL."""

    family: str
    value: Column
    ok: Column
    wide: str = "int"


def family_of(kind: T.DataType) -> tuple[str, str]:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return NUMBER, "int"
    if isinstance(kind, T.LongType):
        return NUMBER, "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return NUMBER, "double"
    if isinstance(kind, T.BooleanType):
        return BOOLEAN, ""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return VARCHAR, ""
    return kind.simpleString(), ""


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve(schema: T.StructType, name: str) -> T.StructField | None:
    """The first column of exactly that name."""
    return next((f for f in schema.fields if f.name == name), None)


def undefined(family: str = BOOLEAN) -> Bound:
    value = {NUMBER: F.lit(None).cast("int"), BOOLEAN: F.lit(None).cast("boolean")}.get(family, F.lit(None).cast("string"))
    return Bound(family, value, F.lit(False))


def bind(e, schema: T.StructType) -> Bound:
    if isinstance(e, Literal):
        return literal(e)
    if isinstance(e, Name):
        field = resolve(schema, e.column)
        if field is None:
            return undefined(NUMBER)
        family, wide = family_of(field.dataType)
        return Bound(family, quoted(e.column), F.lit(True), wide or "int")
    if isinstance(e, Unary):
        x = bind(e.operand, schema)
        if e.op == "NOT":
            return Bound(BOOLEAN, ~x.value, x.ok & x.value.isNotNull()) if x.family == BOOLEAN else undefined()
        return arithmetic("-", Bound(NUMBER, F.lit(0), F.lit(True)), x)
    left, right = bind(e.left, schema), bind(e.right, schema)
    if e.op in ("=", "<>"):
        same = left.value.eqNullSafe(right.value) if left.family == right.family else left.value.isNull() & right.value.isNull()
        return Bound(BOOLEAN, same if e.op == "=" else ~same, left.ok & right.ok)
    if e.op in COMPARE:
        if not left.family == right.family == NUMBER:
            return undefined()
        return Bound(BOOLEAN, COMPARE[e.op](left.value, right.value), both(left, right))
    if e.op in ("AND", "OR"):
        if not left.family == right.family == BOOLEAN:
            return undefined()
        return Bound(BOOLEAN, left.value & right.value if e.op == "AND" else left.value | right.value, both(left, right))
    return arithmetic(e.op, left, right)


def literal(e: Literal) -> Bound:
    if e.value is None:
        return Bound(NUMBER, F.lit(None).cast("int"), F.lit(True))
    family = BOOLEAN if isinstance(e.value, bool) else NUMBER if isinstance(e.value, int) else VARCHAR
    return Bound(family, F.lit(e.value), F.lit(True))


def both(left: Bound, right: Bound) -> Column:
    return left.ok & right.ok & left.value.isNotNull() & right.value.isNotNull()


def arithmetic(op: str, left: Bound, right: Bound) -> Bound:
    """Exact in a wider type, then back: an overflow is NULL there, so undefined, and no ANSI error
    can arise even where Spark evaluates the value of an undefined row."""
    if not left.family == right.family == NUMBER:
        return undefined(NUMBER)
    wide = max(left.wide, right.wide, key=["int", "bigint", "double"].index)
    up = {"int": "bigint", "bigint": "decimal(38,0)", "double": "double"}[wide]
    a, b = left.value.cast(up), right.value.cast(up)
    if op == "/":
        b = F.nullif(b, F.lit(0).cast(up))
        if wide == "bigint":  # a quotient of decimals is bigint, which overflows for one pair only
            b = F.when((a == F.lit(-(2**63)).cast(up)) & (b == F.lit(-1).cast(up)), None).otherwise(b)
        value = a / b if wide == "double" else F.call_function("div", a, b)
    else:
        value = a + b if op == "+" else a - b if op == "-" else a * b
    value = value.try_cast(wide)
    return Bound(NUMBER, value, both(left, right) & value.isNotNull(), wide)


def conjuncts(e) -> list:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Binary) and e.op == "AND" else [e]


def condition(e, schema: T.StructType) -> Column:
    """The filter of a WHERE expression. At its root, undefined, NULL and false all drop a row, so the
    conjuncts are filters of their own, and a column compared to a literal is left in the plain
    form that Parquet readers can push down."""
    out = None
    for part in conjuncts(e):
        c = pushable(part, schema)
        if c is None:
            bound = bind(part, schema)
            c = F.coalesce(bound.ok & bound.value, F.lit(False)) if bound.family == BOOLEAN else F.lit(False)
        out = c if out is None else out & c
    return out


def pushable(e, schema: T.StructType) -> Column | None:
    if not isinstance(e, Binary) or e.op not in COMPARE:
        return None
    op, left, right = e.op, e.left, e.right
    if isinstance(left, Literal):
        op, left, right = FLIPPED[op], right, left
    if not isinstance(left, Name) or not isinstance(right, Literal) or right.value is None:
        return None
    field = resolve(schema, left.column)
    family = literal(right).family
    if field is None or family_of(field.dataType)[0] != family or (op != "=" and family != NUMBER):
        return None
    return COMPARE[op](quoted(left.column), F.lit(right.value))


def constant(e) -> Bound:
    """A VALUES expression: it sees no row, and a name stands for NULL."""
    if isinstance(e, Name):
        return literal(Literal(None))
    if isinstance(e, Unary):
        e = Unary(e.op, named_null(e.operand))
    elif isinstance(e, Binary):
        e = Binary(e.op, named_null(e.left), named_null(e.right))
    return bind(e, T.StructType())


def named_null(e):
    if isinstance(e, Name):
        return Literal(None)
    if isinstance(e, Unary):
        return Unary(e.op, named_null(e.operand))
    if isinstance(e, Binary):
        return Binary(e.op, named_null(e.left), named_null(e.right))
    return e
