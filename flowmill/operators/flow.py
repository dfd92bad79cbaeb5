"""One pipeline as lazy frames: source, where, joins, select, validation, and four outcomes.

Every input's columns are called `table.column` inside, so names never clash. Computed columns see
the columns above them. Validation sees source, joined and output columns, selected or not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.compiler import Compiled, Compiler, Mode, either, kind
from flowmill.lang.syntax import Binary, Call, Check, DocumentError, Expr, Join, Literal, Name, NullTest, PluginCall

STAGE, RULE, REASON = "__stage", "__rule", "__reason"


@dataclass
class Outcome:
    """Rows that pass, dead letters, skipped rows, and rows that were warned of (and pass). Not yet computed.

    All four are parts of `staged`, which is None where no row can fail: then `ok` has all rows. `over`
    takes them from a stored copy of it instead."""

    ok: DataFrame
    dead: DataFrame
    skipped: DataFrame
    warned: DataFrame
    stops: bool = False
    staged: DataFrame | None = None
    over: Callable[[DataFrame], Outcome] | None = None
    counts: list[Column] = field(default_factory=list)


@dataclass
class Flow:
    """What a pipeline does to its frames. `plugins` are (inputs) -> (value column, failed, type)."""

    table: str
    where: list[Expr] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    select: list[tuple[str, Expr]] | None = None
    checks: list[Check] = field(default_factory=list)
    define: dict[str, Expr] = field(default_factory=dict)
    env: dict[str, str] | None = None
    plugin: Callable[[PluginCall, Compiler], Compiled] | None = None
    name: str = ""
    strict: bool = False
    independent_rules: bool = False

    # -- names

    def _known(self, frame: DataFrame) -> dict[tuple[str, str], Compiled]:
        out = {}
        for f in frame.schema.fields:
            table, _, column = f.name.partition(".")
            out[table.lower(), column.lower()] = Compiled(F.col(f"`{f.name}`"), f.dataType)
        return out

    def _resolver(self, known: dict[tuple[str, str], Compiled], outputs: dict[str, Compiled]) -> Callable[[tuple[str, ...]], Compiled | None]:
        def resolve(path: tuple[str, ...]) -> Compiled | None:
            low = [p.lower() for p in path]
            if len(low) > 1:
                return known.get((low[-2], low[-1]))
            if low[0] in outputs:
                return outputs[low[0]]
            if (self.table.lower(), low[0]) in known:
                return known[self.table.lower(), low[0]]
            found = [c for (_, column), c in known.items() if column == low[0]]
            return found[0] if len(found) == 1 else None

        return resolve

    def compiler(self, known: dict, outputs: dict[str, Compiled], mode: Mode) -> Compiler:
        return Compiler(self._resolver(known, outputs), mode, self.define, self.env, self.plugin, self.strict)

    # -- steps

    def joined(self, source: DataFrame, tables: Callable[[str], DataFrame]) -> DataFrame:
        """The source with its joins, before where."""
        frame = named(source, self.table)
        for j in self.joins:
            left, right = join_keys(j, self.table)
            other = named(tables(j.table), j.alias)
            lk, rk = self._known(frame).get(left), self._known(other).get(right)
            if lk is None or rk is None:
                raise DocumentError(f"join {j.alias}: there is no column {'.'.join(left if lk is None else right)}")
            frame = frame.join(other, lk.value == rk.value, j.how)
        return frame

    def filtered(self, frame: DataFrame) -> DataFrame:
        compiler = self.compiler(self._known(frame), {}, Mode.FILTER)
        for e in self.where:
            if self.strict and not plain_condition(e):
                raise DocumentError("where takes comparisons of a column with a constant, null tests, and and or alone")
            c = compiler.compile(e)
            if kind(c.dtype) not in ("bool", "null"):
                raise DocumentError("where takes conditions")
            frame = frame.where(c.value if c.failed is None else c.value & ~c.failed)
        return frame

    def build(self, source: DataFrame, tables: Callable[[str], DataFrame]) -> Outcome:
        frame = self.filtered(self.joined(source, tables))
        known = self._known(frame)
        outputs: dict[str, Compiled] = {}
        columns: list[tuple[str, Compiled]] = []
        if self.select is None:
            columns = [(f.name, known[self.table.lower(), f.name.lower()]) for f in source.schema.fields]
        for name, e in self.select or []:
            c = self.compiler(known, outputs, Mode.ROW).compile(e)
            columns = [(n, x) for n, x in columns if n.lower() != name.lower()] + [(name, c)]
            if not isinstance(e, Name) or len(e.path) == 1:
                outputs[name.lower()] = c
        for name, c in columns:
            outputs.setdefault(name.lower(), c)
        failed = either(*[c.failed for _, c in columns])
        rule, reason, checks = self._checks(known, outputs)
        fields = [F.col(f"`{f}`").alias(f) for f in frame.columns]
        plain = failed is None and rule is None
        if plain:
            ok = frame.select(*[c.value.alias(n) for n, c in columns])
            none = ok.where(F.lit(False))
            return Outcome(ok, self._dead(none, none.columns, {}, None), none, none)
        errors = [F.when(c.failed, F.lit(f"column {n} can't be computed")) for n, c in columns if c.failed is not None]
        stage = F.coalesce(*errors) if errors else F.lit(None).cast("string")
        staged = frame.select(
            *[c.value.alias(n) for n, c in columns],
            stage.alias(STAGE),
            (rule if rule is not None else F.lit(None).cast("int")).alias(RULE),
            (reason if reason is not None else F.lit(None).cast("string")).alias(REASON),
            F.struct(*fields).alias("__original"),
        )
        actions = {i: action(c) for i, c in enumerate(checks)}
        by = lambda a: F.col(RULE).isin([i for i, x in actions.items() if x == a])
        good = F.col(STAGE).isNull()
        names = [n for n, _ in columns]
        fails = good & F.coalesce(by("fail"), F.lit(False))
        passes = good & (F.col(RULE).isNull() | by("warn"))
        messages = {i: (c.message or c.name) for i, c in enumerate(checks)}
        counted = {"rows": passes, "failed": ~good | fails, "stopping": fails, "skipped": good & by("skip"), "warned": good & by("warn")}

        def over(rows: DataFrame) -> Outcome:
            return Outcome(
                rows.where(passes).select(*[F.col(f"`{n}`") for n in names]),
                self._dead(rows.where(~good | fails), names, messages, rows),
                rows.where(good & by("skip")).select(*[F.col(f"`{n}`") for n in names]),
                rows.where(good & by("warn")).select(*[F.col(f"`{n}`") for n in names]),
                any(a == "fail" for a in actions.values()),
                rows,
                over,
                [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counted.items()],
            )

        return over(staged)

    def _checks(self, known: dict, outputs: dict[str, Compiled]) -> tuple[Column | None, Column | None, list[Check]]:
        """The number of the first check that a row fails, and a plugin's reason. Unless rules are taken
        as independent, that check alone decides; else the first of the severest action does."""
        if not self.checks:
            return None, None, []
        checks = sorted(self.checks, key=lambda c: ("fail", "skip", "warn").index(action(c))) if self.independent_rules else self.checks
        compiler = self.compiler(known, outputs, Mode.ROW)
        rule, reason = None, None
        for i, check in enumerate(checks):
            c = compiler.compile(check.check)
            why = F.lit(None).cast("string")
            passed = c.value
            if isinstance(c.dtype, T.StructType):
                passed, why = c.value["ok"], c.value["reason"]
            elif kind(c.dtype) not in ("bool", "null"):
                passed = F.lit(False)
            passed = F.coalesce(passed.cast("boolean"), F.lit(False))
            if c.failed is not None:
                passed = passed & ~c.failed
            rule = F.when(~passed, F.lit(i)) if rule is None else rule.when(~passed, F.lit(i))
            reason = F.when(~passed, why) if reason is None else reason.when(~passed, why)
        return rule, reason, checks

    def _dead(self, rows: DataFrame, names: list[str], messages: dict[int, str], staged: DataFrame | None) -> DataFrame:
        """Dead letters: pipeline, table, stage, error, original_data (JSON of all input columns)."""
        if staged is None:
            return rows.select(*[F.lit(None).cast("string").alias(c) for c in ("pipeline", "table", "stage", "error", "original_data")])
        said = F.coalesce(*[F.when(F.col(RULE) == i, F.lit(m)) for i, m in messages.items()], F.lit("")) if messages else F.lit("")
        return rows.select(
            F.lit(self.name).alias("pipeline"),
            F.lit(self.table).alias("table"),
            F.when(F.col(STAGE).isNotNull(), "transform").otherwise("validate").alias("stage"),
            F.coalesce(F.col(STAGE), F.col(REASON), said).alias("error"),
            F.to_json("__original").alias("original_data"),
        )


def action(c: Check) -> str:
    """skip, fail or warn; warn where none is given, even for assert."""
    given = (c.action or "warn").lower()
    if given not in ("skip", "fail", "warn", "continue"):
        raise DocumentError(f"{c.kind} {c.name}: there is no action {given}")
    return "warn" if c.kind == "warn" or given == "continue" else given


def plain_condition(e: Expr) -> bool:
    """Whether a condition is made of comparisons of a column with a constant and null tests alone."""
    if isinstance(e, NullTest):
        return isinstance(e.operand, Name)
    if not isinstance(e, Binary):
        return False
    if e.op in ("and", "or"):
        return plain_condition(e.left) and plain_condition(e.right)
    constant = lambda x: isinstance(x, Literal) or isinstance(x, Name) and x.path[0] == "define" or isinstance(x, Call) and x.name == "env"
    sides = (e.left, e.right) if isinstance(e.left, Name) else (e.right, e.left)
    return e.op in ("==", "!=", "<", "<=", ">", ">=") and isinstance(sides[0], Name) and constant(sides[1])


def named(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{table}.{c}") for c in df.columns])


def join_keys(j: Join, table: str) -> tuple[tuple[str, str], tuple[str, str]]:
    """(table, column) of the side before and of the joined table, from `a.x == b.y`."""
    e = j.condition
    if not isinstance(e, Binary) or e.op != "==" or not isinstance(e.left, Name) or not isinstance(e.right, Name) or min(len(e.left.path), len(e.right.path)) < 2:
        raise DocumentError(f"join {j.alias} needs a condition of the form a.x == b.y")
    a, b = (tuple(p.lower() for p in n.path[-2:]) for n in (e.left, e.right))
    if b[0] == j.alias.lower():
        return a, b
    if a[0] == j.alias.lower():
        return b, a
    raise DocumentError(f"join {j.alias}: its condition doesn't name it")


def for_table(e: Expr, tables: set[str], table: str) -> Expr | None:
    """The part of a condition that speaks of these tables alone; what speaks of others is dropped."""
    if isinstance(e, Binary) and e.op in ("and", "or"):
        left, right = for_table(e.left, tables, table), for_table(e.right, tables, table)
        return Binary(e.op, left, right) if left and right else left or right
    sides = [e.left, e.right] if isinstance(e, Binary) else [e.operand] if isinstance(e, NullTest) else [e]
    used = {n.path[-2].lower() if len(n.path) > 1 and n.path[0] != "define" else table.lower() for n in sides if isinstance(n, Name) and n.path[0] != "define"}
    return e if used <= tables else None
