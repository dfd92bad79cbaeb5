"""Plugins: batch functions in Python, called on Arrow batches. A batch that raises fails as a whole."""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.functions.compiler import Compiled, Compiler, either
from flowmill.lang.syntax import DocumentError, PluginCall

#: Types that plugins may take and give, by name.
TYPES = {"bool": "boolean", "i64": "long", "u64": "decimal(20,0)", "f64": "double", "decimal": "decimal(38,18)", "string": "string", "bytes": "binary", "date": "date", "timestamp": "timestamp_ntz", "json": "string", "uuid": "string"}


@dataclass
class Plugin:
    """A transform gives a series of `returns`; a filter gives a series of booleans, or (booleans,
    reasons). `inputs` names the arguments and their types, where they are to be checked."""

    run: Callable[..., Any]
    kind: str = "transform"
    returns: str = "string"
    inputs: dict[str, str] | None = None


def load(path: str) -> Plugin:
    """The plugin that a Python file names `plugin`."""
    spec = importlib.util.spec_from_file_location("flowmill_plugin", path)
    if spec is None or spec.loader is None:
        raise DocumentError(f"plugin file {path} can't be read")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, "plugin", None)
    if not isinstance(found, Plugin):
        raise DocumentError(f"{path} has no Plugin named plugin")
    return found


def check_plugin(plugin: Plugin) -> list[str]:
    """What is wrong with a plugin's own description."""
    out = [] if plugin.kind in ("transform", "filter") else [f"there is no kind {plugin.kind}"]
    out += [] if plugin.returns in TYPES else [f"returns {plugin.returns}, which is no type"]
    for name, t in (plugin.inputs or {}).items():
        out += [] if t in TYPES else [f"{name} is {t}, which is no type"]
    if not callable(plugin.run):
        return [*out, "run can't be called"]
    takes = inspect.signature(plugin.run).parameters
    if plugin.inputs is not None and not any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        out += [f"run has no argument {n}" for n in plugin.inputs if n not in takes]
    return out


def compatible(have: T.DataType, want: str) -> bool:
    """Whether a column of one type can be given where another is wanted: equal, or widened."""
    wanted = T._parse_datatype_string(TYPES.get(want, want)) if not isinstance(want, T.DataType) else want
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    ranks = [next((i for i, c in enumerate(order) if isinstance(t, c)), None) for t in (have, wanted)]
    if None not in ranks:
        return ranks[0] <= ranks[1]
    return type(have) is type(wanted) or isinstance(wanted, T.DecimalType) and isinstance(have, T.IntegralType) or isinstance(wanted, T.StringType)


def call(plugin: Plugin, e: PluginCall, compiler: Compiler) -> Compiled:
    inputs = [(name, compiler.compile(n)) for name, n in e.inputs]
    if plugin.inputs is not None:
        if {n for n, _ in inputs} != set(plugin.inputs):
            raise DocumentError(f"plugin {e.plugin} takes {', '.join(plugin.inputs)}")
        for name, c in inputs:
            if not compatible(c.dtype, plugin.inputs[name]):
                raise DocumentError(f"plugin {e.plugin}: {name} is {c.dtype.simpleString()}, {plugin.inputs[name]} is wanted")
    names, run, is_filter = [n for n, _ in inputs], plugin.run, plugin.kind == "filter"
    value = T.BooleanType() if is_filter else T._parse_datatype_string(TYPES.get(plugin.returns, plugin.returns))
    shape = T.StructType([T.StructField("value", value), T.StructField("failed", T.BooleanType()), T.StructField("reason", T.StringType())])

    def batch(*columns: pd.Series) -> pd.DataFrame:
        n = len(columns[0])
        try:
            got = run(**dict(zip(names, columns, strict=True)))
            ok, reason = got if isinstance(got, tuple) else (got, pd.Series([None] * n, dtype=object))
            return pd.DataFrame({"value": pd.Series(ok).reset_index(drop=True), "failed": False, "reason": pd.Series(reason).reset_index(drop=True)})
        except Exception as error:  # the contract: all rows of the batch fail, with the reason
            return pd.DataFrame({"value": pd.Series([None] * n, dtype=object), "failed": True, "reason": f"{type(error).__name__}: {error}"})

    batch.__annotations__ = {"return": pd.DataFrame}
    out = F.pandas_udf(batch, shape, F.PandasUDFType.SCALAR)(*[c.value for _, c in inputs])
    failed = either(*[c.failed for _, c in inputs], F.coalesce(out["failed"], F.lit(True)))
    if is_filter:
        both = F.struct((F.coalesce(out["value"], F.lit(False)) & ~failed).alias("ok"), out["reason"].alias("reason"))
        return Compiled(both, T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("reason", T.StringType())]))
    return Compiled(out["value"], value, failed)
