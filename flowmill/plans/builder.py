"""From a checked document to plans: constants, connections, fan-out, and a frame for each pipeline."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from flowmill.functions import plugins as plugin_calls
from flowmill.functions.compiler import Compiled, Compiler, read_env
from flowmill.functions.plugins import Plugin
from flowmill.lang import checks
from flowmill.lang.parser import parse
from flowmill.lang.syntax import Array, Call, Document, DocumentError, Expr, Literal, Name, Pipeline, PluginCall
from flowmill.operators import cascade
from flowmill.operators.flow import Flow, Outcome, for_table
from flowmill.sources import jdbc
from flowmill.sources.registry import Catalog, Connection


@dataclass
class Settings:
    batch_size: int = 1000
    create_missing_tables: bool = False
    create_missing_columns: bool = False
    skip_pk: bool = False
    skip_fk: bool = False
    skip_idx: bool = False
    skip_seq: bool = False
    skip_unique: bool = False
    skip_check: bool = False
    lanes: int = 1
    ignore_constraints: bool = False
    independent_rules: bool = False


@dataclass
class Step:
    """A pipeline with all its constants known."""

    name: str
    pipeline: Pipeline
    source: Connection
    target: Connection
    table: str
    target_table: str
    mode: str
    on_conflict: str | None
    settings: Settings
    after: list[str]
    references: dict[str, Any] | None = None
    paginate: dict[str, Any] | None = None
    retry: dict[str, Any] = field(default_factory=dict)
    failed_rows: dict[str, Any] | None = None


@dataclass
class Plan:
    spark: SparkSession
    document: Document
    steps: dict[str, Step]
    execution: dict[str, Any]
    issues: list[checks.Issue]
    env: dict[str, str]
    plugins: dict[str, Plugin]
    run_id: str = ""
    strict: bool = False

    def levels(self) -> list[list[str]]:
        return cascade.levels({n: s.after for n, s in self.steps.items()})

    def flow(self, step: Step, table: str | None = None, select: list | None = None, where: list[Expr] | None = None) -> Flow:
        p = step.pipeline
        conditions = [e for _, es in p.where for e in es]

        def plugin(e: PluginCall, compiler: Compiler) -> Compiled:
            if e.plugin not in self.plugins:
                raise DocumentError(f"plugin {e.plugin} isn't there")
            return plugin_calls.call(self.plugins[e.plugin], e, compiler)

        return Flow(table or step.table, conditions if where is None else where, p.joins if table in (None, step.table) else [], p.select if table is None else select, p.checks if table is None else [], self.document.define, self.env, plugin, step.name, self.strict, step.settings.independent_rules)

    def outcome(self, name: str) -> Outcome:
        """The pipeline's frames; nothing runs."""
        step = self.steps[name]
        return self.flow(step).build(self.source(step), step.source.read)

    def source(self, step: Step) -> DataFrame:
        info = step.source.catalog.get(step.table)
        if step.settings.lanes > 1 and info and len(info.primary_key) == 1 and not step.pipeline.where and not step.pipeline.joins:
            return step.source.lanes(step.table, info.primary_key[0], step.settings.lanes)
        return step.source.read(step.table)

    def family(self, name: str) -> dict[str, Outcome]:
        """Outcomes by table for a pipeline `with references`; `schema_only` keeps no rows of the others."""
        step = self.steps[name]
        if step.references is None:
            return {step.target_table: self.outcome(name)}
        r, catalog, p = step.references, step.source.catalog, step.pipeline
        reached = cascade.reachable(step.table, catalog, r["depth"], r["exclude"])
        flow = self.flow(step)
        root = flow.filtered(flow.joined(step.source.read(step.table), step.source.read))
        from pyspark.sql import functions as F

        root = root.select(*[F.col(f"`{step.table}.{c}`").alias(c) for c in step.source.read(step.table).columns])
        tables = {t: step.source.read(t) for t in reached}
        kept = cascade.closure(step.table, root.distinct() if p.joins else root, tables, catalog)
        if r["data"] == "schema_only":
            kept = {t: df if t == step.table else df.limit(0) for t, df in kept.items()}
        out = {}
        for t in cascade.write_order(list(kept), catalog):
            select = p.named_selects.get(t) or (p.select if t == step.table else None)
            own = [] if t == step.table else [x for _, es in p.where for e in es if (x := for_table(e, {t}, step.table))]
            out[p.table_map.get(t, t)] = self.flow(step, t, select, own).build(kept[t], step.source.read)
        return out


class Builder:
    def __init__(self, spark: SparkSession, env: dict[str, str] | None = None, catalogs: dict[str, Catalog] | None = None, frames: dict[str, dict[str, DataFrame]] | None = None, plugins: dict[str, Any] | None = None, strict: bool = False):
        """`strict` lets where have comparisons with constants, null tests, and and or alone."""
        self.strict = strict
        self.spark, self.env = spark, dict(os.environ) if env is None else env
        self.catalogs, self.handed, self.plugins = catalogs or {}, frames or {}, dict(plugins or {})

    def build(self, text: str) -> Plan:
        doc = parse(text)
        issues = checks.check(doc)
        if errors := [i for i in issues if i.severity == "error"]:
            raise DocumentError("; ".join(i.message for i in errors))
        define = {n: self.constant(e, doc) for n, e in doc.define.items()}
        plain = replace(doc, define={n: Literal(v) if not isinstance(v, list) else Array(tuple(map(Literal, v))) for n, v in define.items()})
        for name, block in doc.plugins.items():
            if name not in self.plugins and "path" in block.attributes and str(path := self.constant(block.attributes["path"], plain)).endswith(".py"):
                self.plugins[name] = plugin_calls.load(str(path))
        connections = {n: Connection(self.spark, n, {k: self.constant(v, plain) for k, v in c.attributes.items()}, self.catalogs.get(n, {}), self.handed.get(n, {}), self.plugins) for n, c in doc.connections.items()}
        for c in connections.values():
            c.catalog = c.introspected() | c.catalog if c.driver in ("parquet", *jdbc.DRIVERS) else c.catalog
        steps: dict[str, Step] = {}
        groups: dict[str, list[str]] = {}
        for p in doc.pipelines:
            made = [self.step(q, plain, connections) for q in fan_out(p, lambda e: self.constant(e, plain))]
            groups[p.name] = [s.name for s in made]
            steps |= {s.name: s for s in made}
        for s in steps.values():
            s.after = [x for d in s.after for x in groups[d]]
        return Plan(self.spark, plain, steps, self.execution(plain), issues, self.env, self.plugins, run_id(plain), self.strict)

    def constant(self, e: Expr | None, doc: Document) -> Any:
        match e:
            case None:
                return None
            case Literal():
                return e.value
            case Array():
                return [self.constant(x, doc) for x in e.items]
            case Call("env", args):
                return read_env([self.constant(a, doc) for a in args], self.env)
            case Name(("define", name)):
                return self.constant(doc.define[name], doc)
            case Name():
                return str(e)
        raise DocumentError("only constants can stand here")

    def execution(self, doc: Document) -> dict[str, Any]:
        out = {"strategy": "sequential", "max_concurrency": 1, "on_failure": "fail_fast"} | {k: self.constant(v, doc) for k, v in doc.execution.items()}
        if out["strategy"] not in ("sequential", "parallel") or out["on_failure"] not in ("fail_fast", "continue"):
            raise DocumentError("execution: strategy is sequential or parallel, on_failure is fail_fast or continue")
        if out["strategy"] == "parallel" and not ("max_concurrency" in doc.execution and isinstance(out["max_concurrency"], int) and 1 <= out["max_concurrency"] <= 100):
            raise DocumentError("execution: parallel needs max_concurrency from 1 to 100")
        return out

    def step(self, p: Pipeline, doc: Document, connections: dict[str, Connection]) -> Step:
        value = lambda e: self.constant(e, doc)
        source = connections[checks.reference(p.source.attributes["connection"], "connection") or ""]
        target = connections[checks.reference(p.target.attributes["connection"], "connection") or ""]
        table = value(p.source.attributes.get("table")) or ""
        if not table and source.driver not in ("csv", "wasm", "python"):
            raise DocumentError(f"pipeline {p.name} names no source table")
        table = table or p.name
        mode = {"insert": "append"}.get(m := value(p.target.attributes.get("mode")) or "append", m)
        if mode not in ("append", "replace"):
            raise DocumentError(f"pipeline {p.name}: mode is append or replace, not {mode}")
        conflict = value(p.target.attributes.get("on_conflict"))
        conflict = {"replace": "do_update", "ignore": "do_nothing", "default": None}.get(conflict, conflict)
        if conflict not in (None, "do_update", "do_nothing"):
            raise DocumentError(f"pipeline {p.name}: there is no on_conflict {conflict}")
        aim = value(p.target.attributes.get("table")) or table
        if conflict and mode == "append" and aim not in target.catalog:
            raise DocumentError(f"pipeline {p.name}: on_conflict needs the keys of {aim}; nothing is known of it (give a catalog)")
        raw = {k: value(v) for k, v in p.settings.items()}
        known = {f.name for f in fields(Settings)}
        settings = Settings(**{k: v for k, v in raw.items() if k in known})
        settings.lanes = max(1, min(32, settings.lanes))
        page = None if p.paginate is None else {"strategy": "default", "cursor": "id", "tiebreaker": None, "timezone": "UTC"} | {k: value(v) for k, v in p.paginate.items()}
        failed = p.on_error.blocks.get("failed_rows")
        where = {k: {a: value(v) for a, v in b.attributes.items()} for k, b in failed.blocks.items()} if failed else None
        if where and where.get("file", {}).get("format", "json") != "json":
            raise DocumentError(f"pipeline {p.name}: failed rows go to json files only")
        retry = {"max_attempts": 3, "delay_ms": 1000} | ({k: value(v) for k, v in p.on_error.blocks["retry"].attributes.items()} if "retry" in p.on_error.blocks else {})
        return Step(p.name, p, source, target, table, aim, mode, conflict, settings, checks.depends_on(p), reference_options(p, value), page, retry, where)


def reference_options(p: Pipeline, value) -> dict[str, Any] | None:
    if p.references is None:
        return None
    got = {"data": "schema_only", "depth": "all", "exclude": [], "drop_constraints": False} | {k: value(v) for k, v in p.references.items()}
    if got["data"] not in ("cascade", "schema_only"):
        raise DocumentError(f"pipeline {p.name}: references bring data by cascade or schema_only")
    if got["depth"] == "all":
        got["depth"] = None
    elif not isinstance(got["depth"], int) or got["depth"] < 1:
        raise DocumentError(f"pipeline {p.name}: depth is all or a positive number")
    return got


def fan_out(p: Pipeline, value) -> list[Pipeline]:
    """`tables = [...]` makes one pipeline `name:table` for each table."""
    if "tables" not in p.source.attributes:
        if p.named_selects and p.references is None:
            raise DocumentError(f"pipeline {p.name}: a named select needs tables or references")
        return [p]
    tables = value(p.source.attributes["tables"])
    for there, what in (("table" in p.source.attributes or "table" in p.target.attributes, "table"), (p.references is not None, "references"), (p.joins, "with"), (p.select is not None, "an unnamed select"), (p.where, "where"), (p.checks, "validate")):
        if there:
            raise DocumentError(f"pipeline {p.name}: tables can't go with {what}")
    if not tables or len(set(tables)) != len(tables):
        raise DocumentError(f"pipeline {p.name}: tables are named once each, one at least")
    if unknown := [t for t in [*p.named_selects, *p.table_map] if t not in tables]:
        raise DocumentError(f"pipeline {p.name}: {', '.join(unknown)} isn't among its tables")
    out = []
    for t in tables:
        source = replace(p.source, attributes={k: v for k, v in p.source.attributes.items() if k != "tables"} | {"table": Literal(t)})
        target = replace(p.target, attributes=p.target.attributes | {"table": Literal(p.table_map.get(t, t))})
        out.append(replace(p, name=f"{p.name}:{t}", source=source, target=target, select=p.named_selects.get(t), named_selects={}, table_map={}))
    return out


def plain(x: Any) -> Any:
    """Dataclasses as lists and dicts, for hashing."""
    if is_dataclass(x):
        return {type(x).__name__: {f.name: plain(getattr(x, f.name)) for f in fields(x) if f.name != "line"}}
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def run_id(doc: Document) -> str:
    """The same for equal documents with equal constants."""
    return "run-" + hashlib.sha256(json.dumps(plain(doc), sort_keys=True, default=str).encode()).hexdigest()[:16]
