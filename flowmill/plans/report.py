"""What a plan would do, without writing: tables, columns, filters, joins, estimates, samples, diagnostics."""

from __future__ import annotations

import re
import time
from dataclasses import fields, is_dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.compiler import Mode
from flowmill.lang.syntax import Name, PluginCall
from flowmill.operators.flow import action, join_keys, named
from flowmill.plans.builder import Plan, Step
from flowmill.plans.calibration import Calibration
from flowmill.sources import jdbc, sinks
from flowmill.sources.registry import TableInfo
from flowmill.sources.types import conversion

#: Rows a second by driver to begin with, and what joins and computed columns leave of that.
RATES = {"postgres": 100_000, "mysql": 75_000}
OTHER_RATE = 10_000
JOIN_FACTORS = (1.0, 0.9, 0.8, 0.7, 0.5)
#: Parts of names whose values aren't shown.
HIDDEN = ("password", "passwd", "secret", "token", "api_key", "key_hash", "ssn", "credit_card", "card_number", "cvv", "private")


def masked(df: DataFrame, n: int) -> list[dict[str, Any]]:
    rows = df.limit(n).collect()
    hide = {c for c in df.columns if any(h in c.lower() for h in HIDDEN)}
    return [{c: "***" if c in hide and v is not None else v for c, v in r.asDict().items()} for r in rows]


def hook_kind(statement: str) -> str:
    """ddl, dml, query, maintenance or other, by the first word."""
    first = (re.match(r"\s*(\w+)", statement) or [""])[0].strip().upper()
    kinds = {"ddl": ("CREATE", "ALTER", "DROP", "TRUNCATE"), "dml": ("INSERT", "UPDATE", "DELETE", "MERGE"), "query": ("SELECT", "WITH", "SHOW", "DESCRIBE"), "maintenance": ("ANALYZE", "VACUUM", "OPTIMIZE", "REFRESH", "SET")}
    return next((k for k, words in kinds.items() if first in words), "other")


def estimate(rows: int, step: Step, measured: Calibration | None = None) -> dict[str, Any]:
    """From the rate measured for the pair of drivers, or else the fixed one."""
    first = RATES.get(step.source.driver, OTHER_RATE)
    rate = (measured.rate(step.source.driver, step.target.driver, first) if measured else first) * JOIN_FACTORS[min(len(step.pipeline.joins), 4)]
    computed = sum(not isinstance(e, Name) for _, e in step.pipeline.select or [])
    rate *= max(0.7, 1 - 0.02 * computed)
    size = step.settings.batch_size
    rate *= 0.5 if size < 100 else 0.8 if size < 500 else 1.0 if size <= 5000 else 1.15
    return {"rows": rows, "rows_per_second": round(rate), "seconds": round(rows / rate, 3), "batches": -(-rows // max(1, size))}


def selectivity(plan: Plan, step: Step) -> DataFrame:
    """total_rows, filtered_rows and selectivity in one pass over the joined source."""
    flow = plan.flow(step)
    frame = flow.joined(step.source.read(step.table), step.source.read)
    keep = F.lit(True)
    for e in flow.where:
        keep = keep & F.coalesce(flow.compiler(flow._known(frame), {}, Mode.FILTER).compile(e).value, F.lit(False))
    counts = frame.agg(F.count("*").alias("total_rows"), F.count_if(keep).alias("filtered_rows"))
    return counts.withColumn("selectivity", F.when(F.col("total_rows") > 0, F.col("filtered_rows") / F.col("total_rows")).otherwise(F.lit(1.0)))


def check_rates(plan: Plan, step: Step, sample: int | None = None) -> DataFrame:
    """For each check the rows (of `sample` at most, if given) that fail it, taken alone: check, failed, sampled. Filters don't count."""
    flow = plan.flow(step)
    frame = flow.joined(step.source.read(step.table), step.source.read)
    frame = frame if sample is None else frame.limit(sample)
    known, outputs = flow._known(frame), {}
    for name, e in flow.select or []:
        outputs[name.lower()] = flow.compiler(known, outputs, Mode.ROW).compile(e)
    tests = []
    for c in flow.checks:
        x = flow.compiler(known, outputs, Mode.ROW).compile(c.check)
        ok = F.coalesce((x.value["ok"] if "ok" in getattr(x.dtype, "names", []) else x.value).cast("boolean"), F.lit(False))
        tests.append(F.struct(F.lit(c.name).alias("check"), F.count_if(~(ok & ~x.failed if x.failed is not None else ok)).alias("failed"), F.count("*").alias("sampled")))
    if not tests:
        return frame.sparkSession.createDataFrame([], "check string, failed long, sampled long")
    return frame.agg(F.array(*tests).alias("t")).select(F.explode("t").alias("t")).select("t.*")


def mapping(step: Step, schema: T.StructType) -> list[dict[str, Any]]:
    """For each column what it comes from (copied or computed), its type, and what the target makes of it."""
    given = {n.lower(): e for n, e in step.pipeline.select or []}
    target = existing_schema(step)
    types = {f.name.lower(): f.dataType for f in target.fields} if target else {}
    out = []
    for f in schema.fields:
        e = given.get(f.name.lower())
        kind = "copied" if e is None or isinstance(e, Name) else "computed"
        made = {"name": f.name, "type": f.dataType.simpleString(), "kind": kind}
        out.append(made | {"conversion": conversion(f.dataType, types[f.name.lower()]) if f.name.lower() in types else None})
    return out


def existing_schema(step: Step) -> T.StructType | None:
    """The target table's schema, if it is there."""
    if step.target.driver == "parquet" and step.target.exists(step.target_table):
        return step.target.read(step.target_table).schema
    if step.target.driver in jdbc.DRIVERS and step.target_table in step.target.catalog:
        return step.target.read(step.target_table).schema
    return None


def reached(step: Step) -> dict[str, Any]:
    """Whether the source can be read, and after how long its schema was there."""
    began = time.perf_counter()
    try:
        step.source.read(step.table).schema  # noqa: B018
        return {"ok": True, "milliseconds": round(1000 * (time.perf_counter() - began))}
    except Exception as error:
        return {"ok": False, "error": str(error).split("\n")[0]}


def join_rates(plan: Plan, step: Step) -> list[dict[str, Any]]:
    """For each join the joined table's rows and the share of the source's rows that find one."""
    out, flow = [], plan.flow(step)
    for i, j in enumerate(flow.joins):
        part = replace(flow, joins=flow.joins[: i + 1], where=[])
        before = replace(part, joins=part.joins[:-1]).joined(step.source.read(step.table), step.source.read)
        left, right = join_keys(j, flow.table)
        other = named(step.source.read(j.table), j.alias)
        keys = part._known(before)[left].value, part._known(other)[right].value
        matched, total = before.join(other, keys[0] == keys[1], "left_semi").count(), before.count()
        out.append({"alias": j.alias, "table": j.table, "rows": step.source.read(j.table).count(), "matched": matched / total if total else 1.0})
    return out


def names_in(e: Any) -> list[tuple[str, ...]]:
    """The columns that an expression speaks of."""
    if isinstance(e, Name):
        return [e.path]
    if is_dataclass(e):
        return [n for f in fields(e) for n in names_in(getattr(e, f.name))]
    return [n for x in e for n in names_in(x)] if isinstance(e, (list, tuple)) else []


def indexed(info: TableInfo | None, column: str) -> bool:
    """Whether a key or index begins with the column; true where nothing is known of any."""
    if info is None or not (info.primary_key or info.indexes):
        return True
    return any(c and c[0].lower() == column.lower() for c in (info.primary_key, *info.unique, *info.indexes.values()))


#: From where on something is worth a word.
LIMITS = {"latency_ms": 1000, "large_rows": 10_000_000, "very_large_rows": 100_000_000, "joins": 5, "computed": 20, "page_rows": 1_000_000, "check_rows": 100_000, "memory_mb": 8192, "long_s": 3600, "very_long_s": 86_400, "selective": 0.01, "matched": 0.5}


def diagnose(plan: Plan, step: Step, schema: T.StructType, counts: dict, joins: list[dict], expected: dict, connection: dict) -> list[dict[str, str]]:
    """What is worth knowing before the run, by severity and code."""
    out: list[dict[str, str]] = []
    note = lambda severity, code, text: out.append({"severity": severity, "code": code, "message": text})
    p, info, most = step.pipeline, step.source.catalog.get(step.table), LIMITS
    total, kept = counts["total_rows"], counts["filtered_rows"]
    if connection["milliseconds"] > most["latency_ms"]:
        note("warning", "HIGH_LATENCY", f"{step.source.name} took {connection['milliseconds']} ms to answer")
    if step.target.driver in jdbc.DRIVERS and not step.target.catalog:
        note("info", "CONNECTION_UNTESTED", f"nothing was read from {step.target.name}")
    # source
    if info is not None and not info.primary_key:
        note("warning", "NO_PRIMARY_KEY", f"{step.table} has no primary key")
    if total == 0:
        note("warning", "EMPTY_SOURCE", f"{step.table} has no rows")
    elif kept == 0:
        note("warning", "EMPTY_AFTER_FILTER", "no row passes where")
    if total >= most["very_large_rows"]:
        note("warning", "VERY_LARGE_DATASET", f"{step.table} has {total} rows")
    elif total >= most["large_rows"]:
        note("info", "LARGE_DATASET", f"{step.table} has {total} rows")
    # target
    there = existing_schema(step)
    if step.mode == "replace":
        note("warning", "DESTRUCTIVE_MODE", f"{step.target_table} loses its rows")
        if there is not None and (rows := step.target.read(step.target_table).count()) >= most["large_rows"]:
            note("warning", "LARGE_TRUNCATE", f"{rows} rows of {step.target_table} are replaced")
    if there is None and step.target.driver in ("parquet", *jdbc.DRIVERS):
        note("info", "TABLE_WILL_BE_CREATED", f"{step.target_table} isn't there yet")
    if step.on_conflict and not step.target.catalog.get(step.target_table, TableInfo()).primary_key:
        note("error" if step.target_table not in step.target.catalog else "warning", "MISSING_CONFLICT_KEYS", "on_conflict without a primary key appends")
    if there is not None and not step.settings.create_missing_columns:
        have = {f.name.lower() for f in there.fields}
        for f in schema.fields:
            if f.name.lower() not in have:
                note("warning", "COLUMN_DROPPED", f"{step.target_table} has no column {f.name}")
    # where and joins
    used = [n for _, es in p.where for e in es for n in names_in(e)]
    own = {n[-1] for n in used if len(n) == 1 or n[-2].lower() == step.table.lower()}
    if own and not any(indexed(info, c) for c in own):
        note("warning", "UNINDEXED_FILTER", f"no key or index of {step.table} begins with {', '.join(sorted(own))}")
    if not p.where:
        note("info", "FULL_SCAN", "there is no where: the whole table is read")
    elif total and 0 < counts["selectivity"] < most["selective"]:
        note("info", "HIGHLY_SELECTIVE_FILTER", f"{counts['selectivity']:.2%} of the rows pass where")
    if len(joins) >= most["joins"]:
        note("warning", "MANY_JOINS", f"there are {len(joins)} joins")
    for j, about in zip(p.joins, joins, strict=True):
        other = step.source.catalog.get(j.table)
        if other is None:
            note("info", "UNKNOWN_JOIN_KEY", f"nothing is known of keys of {j.table}; a join may repeat rows")
        elif not indexed(other, join_keys(j, step.table)[1][1]):
            note("warning", "UNINDEXED_JOIN", f"no key or index of {j.table} begins with {join_keys(j, step.table)[1][1]}")
        if about["rows"] >= most["large_rows"]:
            note("warning", "LARGE_LOOKUP_TABLE", f"{j.table} has {about['rows']} rows")
        if about["matched"] < most["matched"]:
            note("warning", "LOW_JOIN_MATCH_RATE", f"{about['matched']:.1%} of the rows find one in {j.table}")
    # columns
    columns = mapping(step, schema)
    for c in columns:
        if c["conversion"] and not c["conversion"]["safe"]:
            note("warning", "UNSAFE_TYPE_CONVERSION", f"{c['name']}: {c['conversion']['note']}")
    if (computed := sum(c["kind"] == "computed" for c in columns)) >= most["computed"]:
        note("info", "MANY_COMPUTED_COLUMNS", f"{computed} columns are computed")
    # pages, lanes
    if step.paginate is None and kept >= most["page_rows"]:
        note("warning", "MISSING_PAGINATION", f"{kept} rows are loaded in one go")
    if step.paginate is not None:
        if step.paginate["strategy"] == "default":
            note("info", "OFFSET_PAGINATION", "pages without a key: every run reads the whole table")
        elif not indexed(info, step.paginate["cursor"]):
            note("warning", "UNINDEXED_CURSOR", f"no key or index of {step.table} begins with {step.paginate['cursor']}")
    if step.settings.lanes > 1 and (info is None or len(info.primary_key) != 1 or p.where or p.joins):
        note("info", "SINGLE_LANE", "lanes need one integer key, no where and no joins; Spark splits the scan itself")
    # resources
    row = sum(getattr(f.dataType, "length", 0) or {"string": 64, "binary": 256, "array": 256, "struct": 256, "map": 256}.get(f.dataType.typeName(), 8) for f in schema.fields)
    if (memory := row * step.settings.batch_size * step.settings.lanes >> 20) >= most["memory_mb"]:
        note("warning", "HIGH_MEMORY_USAGE", f"batches of {memory} MB are held at once")
    if expected["seconds"] >= most["very_long_s"]:
        note("warning", "VERY_LONG_MIGRATION", f"about {expected['seconds'] / 3600:.0f} hours")
    elif expected["seconds"] >= most["long_s"]:
        note("info", "LONG_MIGRATION", f"about {expected['seconds'] / 60:.0f} minutes")
    # checks
    if not p.checks and kept >= most["check_rows"]:
        note("info", "NO_VALIDATIONS", f"{kept} rows are written without a check")
    if step.failed_rows is None:
        note("warning", "NO_ERROR_HANDLING", "failed rows are counted and not kept")
    if any(action(c) == "warn" for c in p.checks[:-1]):
        note("warning", "WARN_MASKS", "a check that warns hides later checks of the same row")
    return out


def plugin_issues(plan: Plan, step: Step) -> list[dict[str, str]]:
    """Plugins that the pipeline names and that aren't there."""
    called = {e.plugin for e in calls_in([step.pipeline.select, step.pipeline.checks, step.pipeline.where])}
    return [{"severity": "error", "code": "PLUGIN_MISSING", "message": f"plugin {name} isn't there"} for name in sorted(called - set(plan.plugins))]


def calls_in(x: Any) -> list[PluginCall]:
    own = [x] if isinstance(x, PluginCall) else []
    if is_dataclass(x):
        return own + [c for f in fields(x) for c in calls_in(getattr(x, f.name))]
    return own + [c for y in x for c in calls_in(y)] if isinstance(x, (list, tuple)) else own


def sample_statistics(df: DataFrame, n: int) -> dict[str, Any]:
    """Of the first n rows: for each column its nulls, distinct values, least and greatest."""
    rows = df.limit(n)
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "struct", "array", "variant")]
    hide = [c for c in plain if any(h in c.lower() for h in HIDDEN)]
    named_ = lambda c: F.struct(F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), F.count_distinct(F.col(f"`{c}`")).alias("distinct"), F.min(F.col(f"`{c}`")).cast("string").alias("least"), F.max(F.col(f"`{c}`")).cast("string").alias("greatest"))
    got = rows.agg(F.count("*").alias("n"), *[named_(c).alias(f"c{i}") for i, c in enumerate(plain)]).first()
    about = {c: got[f"c{i}"].asDict() for i, c in enumerate(plain)}
    for c in hide:
        about[c] |= {"least": "***", "greatest": "***"}
    return {"rows": got["n"], "columns": about}


def build(plan: Plan, samples: int = 0, measured: Calibration | None = None) -> dict[str, Any]:
    pipelines = {}
    for name, step in plan.steps.items():
        connection = reached(step)
        if not connection["ok"]:
            text = f"{step.source.name}/{step.table}: {connection['error']}"
            pipelines[name] = {"source": {"connection": step.source.name, "table": step.table}, "connection": connection, "diagnostics": [{"severity": "error", "code": "CONNECTION_FAILED", "message": text}]}
            continue
        if missing := plugin_issues(plan, step):
            pipelines[name] = {"source": {"connection": step.source.name, "table": step.table}, "connection": connection, "diagnostics": missing}
            continue
        outcome = plan.outcome(name)
        counts = selectivity(plan, step).first().asDict()
        there = existing_schema(step)
        existing = there.names if there is not None else None
        joins, expected = join_rates(plan, step), estimate(counts["filtered_rows"], step, measured)
        pipelines[name] = {
            "source": {"connection": step.source.name, "table": step.table, "rows": counts["total_rows"]},
            "connection": connection,
            "target": {"connection": step.target.name, "table": step.target_table, "mode": step.mode, "exists": existing is not None},
            "columns": mapping(step, outcome.ok.schema),
            "filter": counts,
            "joins": joins,
            "checks": [r.asDict() | {"rate": r["failed"] / r["sampled"] if r["sampled"] else 0.0} for r in check_rates(plan, step).collect()],
            "paginate": step.paginate,
            "hooks": [{"when": w, "statement": s, "kind": hook_kind(s)} for w, items in (("before", step.pipeline.before), ("after", step.pipeline.after)) for s in items],
            "ddl": sinks.ddl(step.target_table, outcome.ok.schema, step.target.catalog.get(step.target_table, TableInfo()), step.settings, step.pipeline.table_map, existing),
            "estimate": expected,
            "diagnostics": diagnose(plan, step, outcome.ok.schema, counts, joins, expected, connection),
            "sample": masked(outcome.ok, samples) if samples else [],
            "sample_statistics": sample_statistics(outcome.ok, samples) if samples else {},
        }
    issues = [{"severity": i.severity, "code": i.code, "message": i.message} for i in plan.issues]
    stopped = [x for p in pipelines.values() for x in p["diagnostics"] if x["severity"] == "error"]
    return {"run_id": plan.run_id, "execution": plan.execution, "levels": plan.levels(), "pipelines": pipelines, "issues": issues, "executable": not stopped}
