"""The compiled columns against a small interpreter of rows."""

import datetime
import math
import random

import pytest
from flowmill.functions.compiler import Compiled, Compiler, Mode, read_env
from flowmill.lang.parser import parse
from flowmill.lang.syntax import Binary, Call, DocumentError, Literal, Name, NullTest, When
from pyspark.sql import functions as F

SCHEMA = "i long, j long, x double, y double, s string, t string, b boolean, c boolean, d date"
ROWS = [
    (1, 2, 1.5, 2.5, "a", " b \t", True, False, datetime.date(2024, 2, 29)),
    (0, 0, 0.0, -0.0, "", "É", None, True, datetime.date(1970, 1, 1)),
    (None, 5, None, 1e300, None, "z", False, None, None),
    (2**63 - 1, -(2**63), float("inf"), float("nan"), "long " * 50, None, True, True, datetime.date(9999, 12, 31)),
    (-7, 2, 1e-17, 0.0, "7", "a", None, None, datetime.date(2000, 6, 1)),
]
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


class Fail(Exception):
    pass


def div(a, b):
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def evaluate(e, row):
    match e:
        case Literal(v):
            return v
        case Name(path):
            return row[path[-1]]
        case NullTest(x, negated):
            try:
                null = evaluate(x, row) is None
            except Fail:
                null = True
            return null != negated
        case When(branches, otherwise):
            for c, v in branches:
                try:
                    holds = evaluate(c, row) is True
                except Fail:
                    holds = False
                if holds:
                    return evaluate(v, row)
            if otherwise is None:
                raise Fail
            return evaluate(otherwise, row)
        case Call(name, args):
            values = [evaluate(a, row) for a in args]
            if name in ("lower", "upper"):
                if not isinstance(values[0], str):
                    raise Fail
                return getattr(values[0], name)()
            if name == "trim":
                return None if values[0] is None else values[0].strip()
            if name == "coalesce":
                return next((v for v in values if v is not None), None)
            if name == "year":
                return None if values[0] is None else values[0].year
        case Binary(op, left, right):
            a, b = evaluate(left, row), evaluate(right, row)
            if op in ("and", "or"):
                return None if a is None or b is None else (a and b if op == "and" else a or b)
            if op in ("==", "!="):
                if a is None or b is None:
                    same = a is None and b is None
                elif isinstance(a, float) or isinstance(b, float):
                    same = abs(float(a) - float(b)) < 2.220446049250313e-16
                else:
                    same = a == b
                return same if op == "==" else not same
            if a is None or b is None:
                return None
            if op in ("<", "<=", ">", ">="):
                # Spark orders NaN above all other numbers
                ka, kb = ((math.isnan(v), 0 if math.isnan(v) else v) if isinstance(v, float) else (False, v) if not isinstance(v, (str, bool)) else v for v in (a, b))
                return {"<": ka < kb, "<=": ka <= kb, ">": ka > kb, ">=": ka >= kb}[op]
            if isinstance(a, str):
                return a + b
            if isinstance(a, int) and isinstance(b, int):
                if op == "/" and b == 0:
                    raise Fail
                v = {"+": a + b, "-": a - b, "*": a * b, "/": div(a, b) if b else 0}[op]
                if not -(2**63) <= v < 2**63:
                    raise Fail
                return v
            a, b = float(a), float(b)
            if op == "/":
                if b == 0:
                    return float("nan") if a == 0 or math.isnan(a) else math.copysign(float("inf"), a) * math.copysign(1, b)
                return a / b
            return {"+": a + b, "-": a - b, "*": a * b}[op]
    raise AssertionError(e)


def make(rng, kind, depth):
    leaf = depth == 0 or rng.random() < 0.25
    if kind == "int":
        return Name((rng.choice("ij"),)) if leaf and rng.random() < 0.7 else Literal(rng.choice([0, 1, 2, -3, 10**18])) if leaf else Binary(rng.choice("+-*/"), make(rng, "int", depth - 1), make(rng, "int", depth - 1)) if rng.random() < 0.7 else choice(rng, kind, depth)
    if kind == "float":
        return Name((rng.choice("xy"),)) if leaf and rng.random() < 0.7 else Literal(rng.choice([0.0, 1.5, -2.0])) if leaf else Binary(rng.choice("+-*/"), make(rng, rng.choice(["int", "float"]), depth - 1), make(rng, "float", depth - 1)) if rng.random() < 0.7 else choice(rng, kind, depth)
    if kind == "string":
        return Name((rng.choice("st"),)) if leaf else rng.choice([lambda: Call(rng.choice(["lower", "upper", "trim"]), (make(rng, "string", depth - 1),)), lambda: Binary("+", make(rng, "string", depth - 1), make(rng, "string", depth - 1)), lambda: choice(rng, kind, depth)])()
    if leaf:
        return Name((rng.choice("bc"),))
    of = rng.choice(["int", "float", "string"])
    return rng.choice([
        lambda: Binary(rng.choice(["and", "or"]), make(rng, "bool", depth - 1), make(rng, "bool", depth - 1)),
        lambda: Binary(rng.choice(["==", "!=", "<", "<=", ">", ">="]), make(rng, of, depth - 1), make(rng, of, depth - 1)),
        lambda: NullTest(make(rng, of, depth - 1), rng.random() < 0.5),
    ])()


def choice(rng, kind, depth):
    one, two = make(rng, kind, depth - 1), make(rng, kind, depth - 1)
    if rng.random() < 0.5:
        return Call("coalesce", (one, two))
    return When(((make(rng, "bool", depth - 1), one),), two if rng.random() < 0.6 else None)


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)) and not isinstance(b, bool):
        return math.isnan(a) and math.isnan(b) or a == b or math.isclose(a, b, rel_tol=1e-12)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def compiler(df, mode=Mode.ROW):
    types = {f.name: f.dataType for f in df.schema.fields}
    return Compiler(lambda p: Compiled(F.col(p[-1]), types[p[-1]]) if p[-1] in types else None, mode)


def test_random_expressions(spark):
    rng, df = random.Random(11), table(spark)
    c = compiler(df)
    exprs = [make(rng, rng.choice(["int", "float", "string", "bool"]), 3) for _ in range(120)]
    compiled = [c.compile(e) for e in exprs]
    for at in range(0, len(exprs), 40):
        columns = [F.struct(x.value.alias("v"), (F.lit(False) if x.failed is None else F.coalesce(x.failed, F.lit(False))).alias("f")).alias(f"c{k}") for k, x in enumerate(compiled[at : at + 40])]
        for row, got in zip(ROWS, df.select(*columns).collect(), strict=True):
            for e, cell in zip(exprs[at : at + 40], got, strict=True):
                try:
                    want = evaluate(e, dict(zip(NAMES, row, strict=True)))
                except Fail:
                    assert cell["f"], (e, row, cell)
                    continue
                assert not cell["f"] and same(cell["v"], want), (e, row, cell, want)


def one(spark, text, mode=Mode.ROW):
    df = table(spark)
    x = compiler(df, mode).compile(parse("define { q = %s }" % text).define["q"])
    rows = df.select(x.value.alias("v"), (F.lit(False) if x.failed is None else F.coalesce(x.failed, F.lit(False))).alias("f")).collect()
    return ["fail" if r["f"] else r["v"] for r in rows]


def test_single_cases(spark):
    assert one(spark, "i / 0") == ["fail", "fail", None, "fail", "fail"]
    assert one(spark, "i + s") == ["fail"] * 5 and one(spark, "lower(i)") == ["fail"] * 5
    assert one(spark, 'concat(x, "|", b, "|", i)') == ["1.5|true|1", "0||0", "|false|", "Infinity|true|9223372036854775807", "1.0E-17||-7"]
    assert one(spark, "trim(t)")[:2] == ["b", "É"]
    assert one(spark, "year(d) * 100 + month(d)") == [202402, 197001, None, 999912, 200006]
    assert one(spark, "quarter(d)") == [1, 1, None, 4, 2]
    assert one(spark, 'd < "2000-01-01"') == [False, True, None, False, False]
    assert one(spark, "(i / 0) is null") == [True] * 5
    assert one(spark, "when { i / 0 > 1 then 1 i == 1 then 2 }") == [2, "fail", "fail", "fail", "fail"]
    assert one(spark, "x == i", Mode.FILTER)[2] is None and one(spark, "b and c", Mode.FILTER)[2] is False
    assert one(spark, 'i == "1"', Mode.FILTER)[:3] == [True, False, None]


def test_refusals(spark):
    for text in ("[1]", "nosuch(1)", "nothing", "define.no", "lower(s, t)", "plugin.p({ a: i })"):
        with pytest.raises(DocumentError):
            one(spark, text)
    with pytest.raises(DocumentError):
        one(spark, "i == null", Mode.FILTER)


def test_env():
    env = {"N": "7", "B": "TRUE", "F": "2", "S": "x"}
    assert read_env(["N", 1], env) == 7 and read_env(["B", False], env) is True and read_env(["F", 0.5], env) == 2.0
    assert read_env(["S"], env) == "x" and read_env(["NO", 3], env) == 3
    for args in (["NO"], ["S", 1], []):
        with pytest.raises(DocumentError):
            read_env(args, env)
