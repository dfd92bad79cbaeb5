"""Command line: `python -m flowmill.cli plan|apply|verify|status|resume|reset|pause|ping DOCUMENT [-e ENV_FILE]`,
and `plugin FILE` for a Python plugin: what it takes and gives, and with `--input` what it makes of values."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

import pandas as pd
from pyspark.sql import SparkSession

from flowmill.functions.plugins import check_plugin, load
from flowmill.lang.syntax import DocumentError
from flowmill.plans.engine import Engine
from flowmill.sources.registry import catalog_of


def env_file(path: str) -> dict[str, str]:
    """NAME=value lines; blank lines and those that begin with # say nothing, quotes around a value go."""
    out = {}
    with open(path) as f:
        for line in f:
            name, mark, value = line.strip().partition("=")
            if mark and not name.startswith("#"):
                out[name.removeprefix("export ").strip()] = value.strip().strip("\"'")
    return out


def ping(engine: Engine, text: str) -> dict[str, str]:
    """Whether each pipeline's source can be read."""
    out = {}
    for step in engine.build(text).steps.values():
        try:
            step.source.read(step.table).schema  # noqa: B018
            out[f"{step.source.name}/{step.table}"] = "ok"
        except Exception as error:
            out[f"{step.source.name}/{step.table}"] = str(error).split("\n")[0]
    return out


def plugin(path: str, values: str | None) -> int:
    """Loads and checks a plugin file; with values it is run on them."""
    try:
        found = load(path)
        problems = check_plugin(found)
        out = {"kind": found.kind, "returns": "bool" if found.kind == "filter" else found.returns, "inputs": found.inputs, "problems": problems}
        if values and not problems:
            got = found.run(**{n: pd.Series(v) for n, v in json.loads(values).items()})
            ok, reasons = got if isinstance(got, tuple) else (got, None)
            out["result"] = pd.Series(ok).tolist()
            if reasons is not None:
                out["reasons"] = pd.Series(reasons).tolist()
    except Exception as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    print(json.dumps(out, indent=2, default=str))
    return 1 if problems else 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="flowmill")
    parser.add_argument("command", choices=["plan", "apply", "verify", "status", "resume", "reset", "pause", "ping", "plugin"])
    parser.add_argument("document")
    parser.add_argument("-e", "--env", help="a file of NAME=value lines")
    parser.add_argument("--state", default=".flowmill", help="folder of run states and receipts")
    parser.add_argument("--integrity", action="store_true", help="keep receipts that verify checks")
    parser.add_argument("--samples", type=int, default=0, help="rows of each pipeline that plan shows")
    parser.add_argument("--catalog", help="a JSON file: for each connection its tables' keys")
    parser.add_argument("--input", help="for plugin: a JSON object of lists, one for each argument")
    given = parser.parse_args(args)
    if given.command == "plugin":
        return plugin(given.document, given.input)
    env = dict(os.environ) | (env_file(given.env) if given.env else {})
    with open(given.document) as f:
        text = f.read()
    spark = spark or SparkSession.builder.appName("flowmill").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    catalogs = {}
    if given.catalog:
        with open(given.catalog) as f:
            catalogs = {name: catalog_of(tables) for name, tables in json.load(f).items()}
    engine = Engine(spark, env=env, catalogs=catalogs, state_dir=given.state, integrity_on=given.integrity)
    try:
        match given.command:
            case "plan":
                out, ok = engine.plan(text, given.samples), True
            case "apply" | "resume":
                run = engine.apply(text) if given.command == "apply" else engine.resume(text)
                out, ok = {"run_id": run.run_id, "results": {n: asdict(r) for n, r in run.results.items()}}, run.ok
            case "verify":
                out = engine.verify(text)
                ok = all(v["status"] == "match" for v in out.values())
            case "status":
                out, ok = engine.status(text), True
            case "pause":
                engine.pause(text)
                out, ok = {"paused": True}, True
            case "reset":
                engine.reset(text)
                out, ok = {"reset": True}, True
            case _:
                out = ping(engine, text)
                ok = set(out.values()) <= {"ok"}
    except DocumentError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    print(json.dumps(out, indent=2, default=str))
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
