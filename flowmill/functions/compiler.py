"""Expressions as pairs of columns: the value, and whether evaluating it failed.

Evaluation fails on overflow, division by zero, operands of wrong types, null or wrong arguments of
some functions and a `when` without a matching branch. A failed row is no error of the query: what
happens to it depends on where the expression stands. `failed` is None where failure is impossible,
so that plans hold flags only for what can fail.

Two logics: in FILTER (where) `==` and and/or are SQL's; in ROW (select, validate) `==` and `!=` take
null for a value, and and/or give null if either side is null.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.lang.syntax import Array, Binary, Call, DocumentError, Expr, Literal, Name, NullTest, PluginCall, When

#: Fixed value: floats closer than this are equal.
EPSILON = 2.220446049250313e-16
UNICODE_SPACE = r"[\s\p{Z}\x{85}]+"


class Mode(Enum):
    FILTER = "filter"
    ROW = "row"


@dataclass(frozen=True)
class Compiled:
    value: Column
    dtype: T.DataType
    failed: Column | None = None
    #: the literal's Python value where the expression is one
    constant: object = None
    literal: bool = False


def either(*flags: Column | None) -> Column | None:
    """Whether any of the flags is set; None if none can be."""
    real = [f for f in flags if f is not None]
    return reduce(lambda a, b: a | b, real) if real else None


def kind(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.FractionalType):
        return "decimal" if isinstance(t, T.DecimalType) else "float"
    names = {T.StringType: "string", T.BooleanType: "bool", T.DateType: "date", T.NullType: "null"}
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return next((n for c, n in names.items() if isinstance(t, c)), "other")


def literal(value: object) -> Compiled:
    types = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType(), date: T.DateType(), datetime: T.TimestampNTZType()}
    t = types[type(value)]
    return Compiled(F.lit(value).cast(t) if value is not None else F.lit(None), t, None, value, True)


def failure(t: T.DataType | None = None) -> Compiled:
    t = t or T.NullType()
    return Compiled(F.lit(None).cast(t) if not isinstance(t, T.NullType) else F.lit(None), t, F.lit(True))


NUMERIC = {"int", "float", "decimal"}
TIMED = {"date", "timestamp"}
_WIDE = T.DecimalType(38, 18)


class Compiler:
    """Compiles expressions over what `resolve` knows: from a path to a compiled column, or None."""

    def __init__(self, resolve: Callable[[tuple[str, ...]], Compiled | None], mode: Mode = Mode.ROW, define: dict[str, Expr] | None = None, env: dict[str, str] | None = None, plugin: Callable[[PluginCall, Compiler], Compiled] | None = None, strict: bool = False):
        self.resolve, self.mode, self.define, self.plugin, self.strict = resolve, mode, define or {}, plugin, strict
        self.env = os.environ if env is None else env

    def compile(self, e: Expr) -> Compiled:
        match e:
            case Literal():
                return literal(e.value)
            case Name():
                return self._name(e)
            case Binary(op, left, right) if op in ("and", "or"):
                return self._logic(op, self.compile(left), self.compile(right))
            case Binary(op, left, right):
                if self.mode is Mode.FILTER and op in ("==", "!=") and Literal(None) in (left, right):
                    raise DocumentError(f"{op} null is never true in where; write `is null` or `is not null`")
                a, b = self.compile(left), self.compile(right)
                return self._arithmetic(op, a, b) if op in "+-*/%" else self._comparison(op, a, b)
            case NullTest(operand, negated):
                x = self.compile(operand)
                null = x.value.isNull() if x.failed is None else x.value.isNull() | x.failed
                return Compiled(~null if negated else null, T.BooleanType())
            case When():
                return self._when(e)
            case Call():
                if self.strict and self.mode is Mode.FILTER and e.name != "env":
                    raise DocumentError(f"where takes no function ({e.name})")
                return self._call(e)
            case PluginCall():
                if self.plugin is None:
                    raise DocumentError(f"plugin {e.plugin} can't be called here")
                return self.plugin(e, self)
            case Array():
                raise DocumentError("arrays have no value in expressions")
        raise DocumentError(f"unknown expression {e!r}")

    def _name(self, e: Name) -> Compiled:
        if e.path[0] == "define" and len(e.path) == 2:
            if e.path[1] not in self.define:
                raise DocumentError(f"define {e.path[1]} isn't declared")
            return self.compile(self.define[e.path[1]])
        found = self.resolve(e.path)
        if found is None:
            raise DocumentError(f"there is no column {e}")
        return found

    # -- operators

    def _logic(self, op: str, a: Compiled, b: Compiled) -> Compiled:
        if {kind(a.dtype), kind(b.dtype)} - {"bool", "null"}:
            return failure(T.BooleanType())
        x, y = a.value.cast("boolean"), b.value.cast("boolean")
        both = x & y if op == "and" else x | y
        if self.mode is Mode.ROW:
            both = F.when(x.isNotNull() & y.isNotNull(), both)
        return Compiled(both, T.BooleanType(), either(a.failed, b.failed))

    def _arithmetic(self, op: str, a: Compiled, b: Compiled) -> Compiled:
        ka, kb = kind(a.dtype), kind(b.dtype)
        failed = either(a.failed, b.failed)
        if "null" in (ka, kb):
            return Compiled(F.lit(None), T.NullType(), failed)
        if op == "+" and ka == kb == "string":
            return Compiled(F.concat(a.value, b.value), T.StringType(), failed)
        if not {ka, kb} <= NUMERIC:
            return failure()
        if "decimal" in (ka, kb):
            return self._decimal(op, a, b, failed)
        if ka == kb == "int":
            x, y = a.value.cast("long"), b.value.cast("long")
            present = x.isNotNull() & y.isNotNull()
            if op in "/%":
                bad = present & ((y == 0) | ((x == F.lit(-(2**63))) & (y == -1)) if op == "/" else y == 0)
                # try_divide gives a double; the guard makes integer division safe
                value = F.call_function("div", x, F.when(~bad, y)) if op == "/" else x % F.when(~bad, y)
            else:
                value = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
                bad = present & value.isNull()
            return Compiled(value, T.LongType(), either(failed, bad))
        x, y = a.value.cast("double"), b.value.cast("double")
        if op == "/":
            zero = F.when((x == 0) | F.isnan(x) | F.isnan(y), F.lit(float("nan"))).when(F.signum(x) == self._sign(y), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            value = F.when(x.isNotNull() & (y == 0), zero).otherwise(F.try_divide(x, y))
        elif op == "%":
            value = F.when(x.isNotNull() & (y == 0), F.lit(float("nan"))).otherwise(x % F.when(y != 0, y))
        else:
            value = {"+": x + y, "-": x - y, "*": x * y}[op]
        return Compiled(value, T.DoubleType(), failed)

    @staticmethod
    def _sign(y: Column) -> Column:
        """1, or -1 also for minus zero."""
        return F.when(F.substring(y.cast("string"), 1, 1) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))

    @staticmethod
    def _decimal(op: str, a: Compiled, b: Compiled, failed: Column | None) -> Compiled:
        x, y = (c.value if kind(c.dtype) == "decimal" else c.value.cast("decimal(20,0)") if kind(c.dtype) == "int" else c.value.try_cast(_WIDE) for c in (a, b))
        present = a.value.isNotNull() & b.value.isNotNull()
        value = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide, "%": F.try_mod}[op](x, y)
        return Compiled(value, T.DecimalType(38, 18) if op == "/" else _WIDE, either(failed, present & value.isNull()))

    def _comparison(self, op: str, a: Compiled, b: Compiled) -> Compiled:
        ka, kb = kind(a.dtype), kind(b.dtype)
        failed = either(a.failed, b.failed)
        if self.mode is Mode.FILTER:
            a, b = self._typed_by_column(a, b)
            ka, kb = kind(a.dtype), kind(b.dtype)
        elif ka != kb and {ka, kb} & TIMED and {ka, kb} <= TIMED | {"string"}:
            to = next(c.dtype for c in (a, b) if kind(c.dtype) in TIMED)
            a, b = (c if kind(c.dtype) in TIMED else Compiled(c.value.try_cast(to), to, c.failed) for c in (a, b))
            ka, kb = kind(a.dtype), kind(b.dtype)
        fine = ka == kb or "null" in (ka, kb) or {ka, kb} <= NUMERIC or {ka, kb} <= TIMED
        if not fine:
            return failure(T.BooleanType())
        x, y = a.value, b.value
        floats = "float" in (ka, kb) and {ka, kb} <= NUMERIC
        if floats:
            x, y = x.cast("double"), y.cast("double")
        if op in ("==", "!="):
            if floats and self.mode is Mode.ROW:
                close = (F.abs(x - y) < F.lit(EPSILON)) & ~F.isnan(x) & ~F.isnan(y)
                same = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(close)
            else:
                same = x == y if self.mode is Mode.FILTER else x.eqNullSafe(y)
            value = same if op == "==" else ~same
        else:
            value = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return Compiled(value, T.BooleanType(), failed)

    @staticmethod
    def _typed_by_column(a: Compiled, b: Compiled) -> tuple[Compiled, Compiled]:
        """A literal beside a column takes the column's type, as a database types a bound text; whole
        numbers beside floats and the like stay comparable as they are."""

        def like(lit: Compiled, other: Compiled) -> Compiled:
            kl, ko = kind(lit.dtype), kind(other.dtype)
            if not lit.literal or other.literal or kl == ko or {kl, ko} <= NUMERIC:
                return lit
            return Compiled(F.lit(str(lit.constant)).try_cast(other.dtype), other.dtype)

        return like(a, b), like(b, a)

    def _when(self, e: When) -> Compiled:
        if not e.branches:
            return self.compile(e.otherwise) if e.otherwise is not None else failure()
        conditions = []
        for c, _ in e.branches:
            x = self.compile(c)
            holds = F.coalesce(x.value.cast("boolean"), F.lit(False)) if kind(x.dtype) in ("bool", "null") else F.lit(False)
            conditions.append(holds if x.failed is None else holds & ~x.failed)
        values = [self.compile(v) for _, v in e.branches]
        last = self.compile(e.otherwise) if e.otherwise is not None else None
        t = self.common([*values, *([last] if last else [])])
        value, failed = None, None
        can_fail = last is None or any(v.failed is not None for v in [*values, last] if v)
        for c, v in zip(conditions, values, strict=True):
            x, bad = self.as_type(v, t), v.failed if v.failed is not None else F.lit(False)
            value = F.when(c, x) if value is None else value.when(c, x)
            failed = F.when(c, bad) if failed is None else failed.when(c, bad)
        if last is not None:
            value = value.otherwise(self.as_type(last, t))
            failed = failed.otherwise(last.failed if last.failed is not None else F.lit(False))
        else:
            failed = failed.otherwise(F.lit(True))
        return Compiled(value, t, failed if can_fail else None)

    @staticmethod
    def common(items: list[Compiled]) -> T.DataType:
        kinds = {kind(c.dtype) for c in items} - {"null"}
        if not kinds:
            return T.NullType()
        if len(kinds) == 1:
            k = kinds.pop()
            return T.LongType() if k == "int" else T.DoubleType() if k == "float" else next(c.dtype for c in items if kind(c.dtype) == k)
        if kinds <= NUMERIC:
            return T.DoubleType() if "float" in kinds else _WIDE
        if kinds <= TIMED:
            return T.TimestampNTZType()
        return T.StringType()

    @staticmethod
    def as_type(c: Compiled, t: T.DataType) -> Column:
        if isinstance(t, T.NullType) or c.dtype == t:
            return c.value
        return display(c) if kind(t) == "string" and kind(c.dtype) != "null" else c.value.cast(t)

    # -- functions

    def _call(self, e: Call) -> Compiled:
        maker = getattr(self, f"_fn_{e.name}", None)
        if maker is None:
            raise DocumentError(f"there is no function {e.name}")
        return maker([*e.args]) if e.name == "env" else maker([self.compile(a) for a in e.args])

    @staticmethod
    def _one(name: str, args: list[Compiled]) -> Compiled:
        if len(args) != 1:
            raise DocumentError(f"{name} takes one argument")
        return args[0]

    def _text(self, name: str, args: list[Compiled], make: Callable[[Column], Column], null_fails: bool) -> Compiled:
        x = self._one(name, args)
        if kind(x.dtype) == "null" and not null_fails:
            return Compiled(F.lit(None).cast("string"), T.StringType(), x.failed)
        if kind(x.dtype) != "string":
            return failure(T.StringType())
        return Compiled(make(x.value), T.StringType(), either(x.failed, x.value.isNull() if null_fails and not x.literal else None))

    def _fn_lower(self, args):
        return self._text("lower", args, F.lower, True)

    def _fn_upper(self, args):
        return self._text("upper", args, F.upper, True)

    def _fn_trim(self, args):
        return self._text("trim", args, lambda c: F.regexp_replace(c, rf"\A{UNICODE_SPACE}|{UNICODE_SPACE}\z", ""), False)

    def _fn_concat(self, args):
        texts = [F.coalesce(display(a), F.lit("")) for a in args if kind(a.dtype) != "null"]
        return Compiled(F.concat(*texts) if texts else F.lit(""), T.StringType(), either(*[a.failed for a in args]))

    def _fn_coalesce(self, args):
        if not args:
            raise DocumentError("coalesce takes arguments")
        t = self.common(args)
        return Compiled(F.coalesce(*[self.as_type(a, t) for a in args]), t, either(*[a.failed for a in args]))

    def _dated(self, name: str, args: list[Compiled], make: Callable[[Column], Column], t: T.DataType) -> Compiled:
        x = self._one(name, args)
        if kind(x.dtype) not in TIMED | {"null"}:
            return failure(t)
        return Compiled(make(x.value.cast("date") if kind(x.dtype) == "null" else x.value).cast(t), t, x.failed)

    def _fn_date(self, args):
        return self._dated("date", args, lambda c: c.cast("date"), T.DateType())

    def _fn_year(self, args):
        return self._dated("year", args, F.year, T.LongType())

    def _fn_month(self, args):
        return self._dated("month", args, F.month, T.LongType())

    def _fn_quarter(self, args):
        return self._dated("quarter", args, F.quarter, T.LongType())

    def _fn_now(self, args):
        if args:
            raise DocumentError("now takes no argument")
        return Compiled(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"), T.TimestampNTZType())

    def _fn_env(self, args):
        return literal(read_env([a.value if isinstance(a, Literal) else None for a in args], self.env))


def read_env(args: list, env: dict[str, str]) -> object:
    """A variable's value as the type of the default; without one it is a text, and must be set."""
    if not 1 <= len(args) <= 2 or not isinstance(args[0], str):
        raise DocumentError("env takes a name and perhaps a default")
    raw = env.get(args[0])
    if raw is None:
        if len(args) == 1:
            raise DocumentError(f"environment variable {args[0]} isn't set")
        return args[1]
    default = args[1] if len(args) == 2 else ""
    try:
        if isinstance(default, bool):
            return {"true": True, "false": False}[raw.strip().lower()]
        return type(default)(raw) if isinstance(default, (int, float)) else raw
    except (KeyError, ValueError) as e:
        raise DocumentError(f"environment variable {args[0]} is no {type(default).__name__}: {raw!r}") from e


def display(c: Compiled) -> Column:
    """The text of a value: whole floats without a fraction, booleans in lower case, ISO times."""
    if kind(c.dtype) == "float":
        x = c.value.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))
    return c.value.cast("string")
