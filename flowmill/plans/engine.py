"""Runs plans: levels of pipelines, retries, dead letters, receipts, and a state that resumes."""

from __future__ import annotations

import json
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowmill.operators import integrity, merge, pages
from flowmill.plans import report
from flowmill.plans.builder import Builder, Plan, Step
from flowmill.plans.calibration import Calibration
from flowmill.sources import jdbc, sinks


class PipelineFailed(RuntimeError):
    """Rows failed a check whose action is fail; they are among the dead letters."""


@dataclass
class Result:
    pipeline: str
    status: str
    rows: int = 0
    failed: int = 0
    skipped: int = 0
    warned: int = 0
    seconds: float = 0.0
    error: str | None = None


@dataclass
class Run:
    run_id: str
    results: dict[str, Result] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return all(r.status in ("completed", "already completed") for r in self.results.values())


class State:
    """One JSON file for each run, written whole and moved into place."""

    def __init__(self, folder: str):
        self.folder, self.lock = folder, threading.Lock()
        os.makedirs(folder, exist_ok=True)

    def path(self, run_id: str) -> str:
        return os.path.join(self.folder, f"{run_id}.json")

    def load(self, run_id: str) -> dict[str, Any]:
        try:
            with open(self.path(run_id)) as f:
                return {"done": {}, "control": {}} | json.load(f)
        except FileNotFoundError:
            return {"pipelines": {}, "receipts": {}, "cursors": {}, "done": {}, "control": {}}

    def update(self, run_id: str, part: str, name: str, value: Any) -> None:
        with self.lock:
            state = self.load(run_id)
            state[part][name] = value
            handle, temporary = tempfile.mkstemp(dir=self.folder)
            with os.fdopen(handle, "w") as f:
                json.dump(state, f, default=str)
            os.replace(temporary, self.path(run_id))

    def reset(self, run_id: str) -> None:
        if os.path.exists(self.path(run_id)):
            os.remove(self.path(run_id))


class Engine(Builder):
    """`apply`, `plan`, `verify`, `status` and `reset` for documents. `listeners` get (event, details)."""

    def __init__(self, *args, state_dir: str | None = None, integrity_on: bool = False, **more):
        super().__init__(*args, **more)
        self.state = State(state_dir or tempfile.mkdtemp(prefix="flowmill-state-"))
        self.integrity_on = integrity_on
        self.calibration = Calibration(os.path.join(self.state.folder, "calibration.json"))
        self.listeners: list[Callable[[str, dict], None]] = []

    def tell(self, event: str, **details) -> None:
        for listener in self.listeners:
            listener(event, details)

    def frames(self, text: str) -> dict[str, DataFrame]:
        """Each pipeline's passing rows, not computed yet."""
        plan = self.build(text)
        return {n: plan.outcome(n).ok for n in plan.steps}

    def plan(self, text: str, samples: int = 0) -> dict:
        return report.build(self.build(text), samples, self.calibration)

    def status(self, text: str) -> dict[str, Any]:
        return self.state.load(self.build(text).run_id)

    def reset(self, text: str) -> None:
        self.state.reset(self.build(text).run_id)

    def pause(self, text: str) -> None:
        """A run of the document, here or in another process, stops before its next pipeline."""
        self.state.update(self.build(text).run_id, "control", "paused", True)

    def resume(self, text: str) -> Run:
        """Goes on with a run that was paused or failed: what is done isn't done again."""
        self.state.update(self.build(text).run_id, "control", "paused", False)
        return self.apply(text)

    def paused(self, run_id: str) -> bool:
        return bool(self.state.load(run_id)["control"].get("paused"))

    # -- apply

    def apply(self, text: str) -> Run:
        plan = self.build(text)
        run, before = Run(plan.run_id), self.state.load(plan.run_id)["pipelines"]
        workers = plan.execution["max_concurrency"] if plan.execution["strategy"] == "parallel" else 1
        self.tell("run_started", run_id=plan.run_id)
        stop = False
        for level in plan.levels():
            todo = []
            for name in level:
                blocked = [d for d in plan.steps[name].after if run.results[d].status in ("failed", "skipped", "paused")]
                if before.get(name) == "completed" and not plan.steps[name].paginate:
                    run.results[name] = Result(name, "already completed")
                elif stop or blocked:
                    run.results[name] = Result(name, "skipped", error=f"{blocked[0]} failed" if blocked else "the run stopped")
                else:
                    todo.append(name)
            with ThreadPoolExecutor(workers) as pool:
                stopping = threading.Event()

                def one(name: str) -> Result:
                    if stopping.is_set():
                        return Result(name, "skipped", error="the run stopped")
                    if self.paused(plan.run_id):
                        self.tell("pipeline_paused", pipeline=name)
                        return Result(name, "paused")
                    result = self.run_step(plan, plan.steps[name])
                    if result.status == "failed" and plan.execution["on_failure"] == "fail_fast":
                        stopping.set()
                    return result

                for result in pool.map(one, todo):
                    run.results[result.pipeline] = result
            stop = stop or stopping.is_set()
        self.tell("run_finished", run_id=plan.run_id, ok=run.ok)
        return run

    def run_step(self, plan: Plan, step: Step) -> Result:
        """Hooks, the load with its retries, and the result. What an attempt has committed - tables, dead
        letters, receipts - is kept in the state and isn't done again, neither by the next attempt nor by
        the next run of a document that failed."""
        began = time.time()
        self.tell("pipeline_started", pipeline=step.name)
        result, done = Result(step.name, "completed"), self.state.load(plan.run_id)["done"].get(step.name, {})
        attempts = int(step.retry["max_attempts"]) if "retry" in step.pipeline.on_error.blocks else 1
        try:
            if not done:
                self.hooks(step, step.pipeline.before)
            for attempt in range(attempts):
                try:
                    self.load(plan, step, done)
                    break
                except PipelineFailed:
                    raise
                except Exception as error:
                    if attempt + 1 == attempts:
                        raise
                    self.tell("pipeline_retried", pipeline=step.name, attempt=attempt + 1, error=str(error).split("\n")[0])
                    time.sleep(step.retry["delay_ms"] / 1000 * 2**attempt)
            self.hooks(step, step.pipeline.after)
        except Exception as error:
            result.status, result.error = "failed", str(error).split("\n")[0]
        for counts in done.get("tables", {}).values():
            for name in ("rows", "failed", "skipped", "warned"):
                setattr(result, name, getattr(result, name) + counts[name])
        result.seconds = time.time() - began
        self.state.update(plan.run_id, "done", step.name, {} if result.status == "completed" or done.get("stopped") else done)
        self.state.update(plan.run_id, "pipelines", step.name, result.status)
        if result.status == "completed":
            self.calibration.observe(step.source.driver, step.target.driver, result.rows + result.failed + result.skipped, result.seconds)
        self.tell("pipeline_finished", **asdict(result))
        return result

    def hooks(self, step: Step, statements: list[str]) -> None:
        """Statements before and after the data: on the target itself where it is a database, else in Spark."""
        for statement in statements:
            if step.target.driver in jdbc.DRIVERS:
                step.target.execute(statement)
            else:
                self.spark.sql(statement)

    def load(self, plan: Plan, step: Step, done: dict[str, Any]) -> None:
        """Writes a pipeline's tables. All or nothing where a check fails: dead letters are written, rows aren't.

        Where rows can fail, the pipeline's rows are computed once, into a staging folder, and counted and
        written from there. A table counts as done once its one write has been committed; an end of the process
        between that and the state's update is the one gap."""
        note = lambda: self.state.update(plan.run_id, "done", step.name, done)
        paging = step.paginate and step.references is None
        if paging and "bound" not in done:
            done["bound"] = self.newest(plan, step)
        outcomes = {step.target_table: self.paged(plan, step, done["bound"])} if paging else plan.family(step.name)
        tables, stopped = done.setdefault("tables", {}), False
        for table, outcome in outcomes.items():
            if table not in tables:
                counts = {"rows": 0, "failed": 0, "skipped": 0, "warned": 0}
                stage = None
                try:
                    if outcome.staged is not None:
                        stage = self.staging(step, table)
                        outcome.staged.write.parquet(stage)
                        outcome = outcome.over(self.spark.read.schema(outcome.staged.schema).parquet(stage))
                        counts = outcome.staged.agg(*outcome.counts).first().asDict()
                        stopped = bool(counts.pop("stopping")) and outcome.stops
                        if stopped:
                            counts["rows"] = 0
                    if counts["failed"] and table not in done.get("buried", []):
                        self.bury(plan, step, outcome.dead)
                        done.setdefault("buried", []).append(table)
                        note()
                    if not stopped:
                        counted = Observation()
                        rows = outcome.ok if outcome.staged is not None else outcome.ok.observe(counted, F.count(F.lit(1)).alias("rows"))
                        # a view outlives the staging folder
                        sinks.write(step.target, table, plan.family(step.name)[table].ok if step.target.driver == "view" else rows, step.mode, step.on_conflict, step.settings.create_missing_columns)
                        if outcome.staged is None:
                            counts["rows"] = self.observed(step, counted, outcome.ok)
                    tables[table] = counts
                    note()
                    self.tell("table_written", pipeline=step.name, table=table, **counts)
                finally:
                    if stage:
                        sinks.remove(self.spark, stage)
            if stopped:
                done["stopped"] = True
                raise PipelineFailed(f"{step.name}: rows failed a check whose action is fail")
            if self.integrity_on and table not in done.get("receipts", []):
                self.receipt(plan, step, table)
                done.setdefault("receipts", []).append(table)
                note()
        if paging and done["bound"] is not None:
            self.state.update(plan.run_id, "cursors", step.name, done["bound"])

    def receipt(self, plan: Plan, step: Step, table: str) -> None:
        known = step.target.catalog.get(table) or step.source.catalog.get(step.table)
        written = step.target.read(table)
        got = integrity.receipt(written, step.name, table, [k for k in (known.primary_key if known else ()) if k in written.columns])
        if got:
            self.state.update(plan.run_id, "receipts", f"{step.name}/{table}", got)

    def staging(self, step: Step, table: str) -> str:
        """A new folder that all executors see: in `spark.checkpoint.dir`, or beside the target's tables, or in the warehouse."""
        where = self.spark.conf.get("spark.checkpoint.dir", None) or (str(step.target.options["url"]) if step.target.driver == "parquet" else self.spark.conf.get("spark.sql.warehouse.dir"))
        return f"{where.rstrip('/')}/_staging/{table}-{uuid.uuid4().hex}"

    @staticmethod
    def observed(step: Step, counted: Observation, ok: DataFrame) -> int:
        return ok.count() if step.target.driver == "view" else int(counted.get["rows"])

    def bury(self, plan: Plan, step: Step, dead: DataFrame) -> None:
        for kind, where in (step.failed_rows or {}).items():
            letters = sinks.dead_letters(dead)
            if kind == "file":
                letters.write.mode("append").json(str(where["path"]))
            elif kind == "table":
                name = str(where.get("connection", "")).removeprefix("connection.")
                target = next((c for s in plan.steps.values() for c in (s.source, s.target) if c.name == name), step.target)
                sinks.write(target, str(where["table"]), letters)

    # -- pages

    @staticmethod
    def page_keys(step: Step) -> list[str]:
        return pages.keys_of(step.paginate["strategy"], step.paginate["cursor"], step.paginate["tiebreaker"])

    def newest(self, plan: Plan, step: Step) -> list[Any] | None:
        """The last keys of the source as it is now: what the load reads, and the cursor it leaves. Times are kept in UTC."""
        keys, source = self.page_keys(step), plan.source(step)
        if not keys:
            return None
        last = source.dropna(subset=keys).agg(F.max(F.struct(*keys)).alias("m")).select("m.*")
        zone = step.paginate["timezone"]
        if zone != "UTC" and source.schema[keys[0]].dataType.typeName() == "timestamp_ntz":
            last = last.withColumn(keys[0], F.to_utc_timestamp(keys[0], zone).cast("timestamp_ntz"))
        row = last.select(*[F.col(k).cast("string") if t.startswith("time") or t.startswith("date") else F.col(k) for k, t in last.dtypes]).first()
        return None if row[0] is None else list(row)

    def paged(self, plan: Plan, step: Step, bound: list[Any] | None):
        """The rows after the cursor that the last run of the same document left, up to `bound`: rows that
        come while the load runs are the next run's. Rows with a null key belong to the first run."""
        keys, source = self.page_keys(step), plan.source(step)
        saved = self.state.load(plan.run_id)["cursors"].get(step.name)
        if keys:
            types = {f.name: f.dataType for f in source.schema.fields}
            typed = lambda values: [F.lit(v).cast(types[k]) for k, v in zip(keys, values, strict=True)]
            zone = step.paginate["timezone"] if types[keys[0]].typeName() == "timestamp_ntz" else None
            null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
            if saved:
                source = source.where(pages.after(keys, typed(saved), zone))
            if bound:
                to = pages.up_to(keys, typed(bound), zone)
                source = source.where(to if saved else to | null)
            elif not saved:
                source = source.where(null)
        return plan.flow(step).build(source, step.source.read)

    # -- verify

    def verify(self, text: str) -> dict[str, dict[str, Any]]:
        """Rereads written tables against their receipts; where a root differs, the keys that differ are
        counted against the pipeline's own rows."""
        plan, out = self.build(text), {}
        receipts = self.state.load(plan.run_id)["receipts"]
        for step in plan.steps.values():
            mine = {k.split("/", 1)[1]: r for k, r in receipts.items() if k.split("/", 1)[0] == step.name}
            if not mine:
                out[step.name] = {"status": "no prior run"}
            for table, r in mine.items():
                actual = step.target.read(table)
                root = integrity.merkle_root(actual.select(*[c for c in actual.columns if c in r["columns"]]), r["keys"]) if set(r["columns"]) <= set(actual.columns) else ""
                if root == r["root"]:
                    out[f"{step.name}/{table}"] = {"status": "match", "rows": r["rows"]}
                    continue
                expected = plan.family(step.name)[table].ok
                keys = r["keys"] or sorted(expected.columns)
                counts = {x["status"]: x["count"] for x in merge.difference(expected, actual.select(*expected.columns), keys).groupBy("status").count().collect()}
                out[f"{step.name}/{table}"] = {"status": "mismatch"} | {k: counts.get(k, 0) for k in ("missing", "extra", "changed")}
        return out
