"""CSV files: read as text, typed by a sample of rows, values that don't parse become null."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_ROWS = 50
# Types from narrow to wide. JSON is kept as text with sorted keys.
LADDER = ("smallint", "int", "bigint", "double", "boolean", "date", "timestamp_ntz", "json", "string")
_INT_BITS = {"smallint": 15, "int": 31, "bigint": 63}


def column_name(raw: str) -> str:
    """Lower case, words joined by underscores."""
    return re.sub(r"\W+", "_", raw.strip()).strip("_").lower() or "column"


def value_type(text: str) -> str:
    if re.fullmatch(r"[+-]?\d{1,19}", text):
        n = int(text)
        return next((t for t, bits in _INT_BITS.items() if -(1 << bits) <= n < 1 << bits), "double")
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return "double"
    if text.lower() in ("true", "false"):
        return "boolean"
    for kind, read in (("date", date.fromisoformat), ("timestamp_ntz", datetime.fromisoformat)):
        try:
            read(text)
        except ValueError:
            continue
        if kind == "timestamp_ntz" or re.fullmatch(r"\d{4}-\d\d-\d\d", text):
            return kind
    if text[0] in '{["':
        try:
            json.loads(text)
            return "json"
        except ValueError:
            pass
    return "string"


def widest(types: Iterable[str]) -> str:
    """The least type that holds all of them; nothing seen is text."""
    seen = set(types)
    if not seen:
        return "string"
    if len(seen) == 1 or seen <= {"smallint", "int", "bigint", "double"} or seen <= {"date", "timestamp_ntz"}:
        return max(seen, key=LADDER.index)
    return "json" if "json" in seen and seen <= {"json", "smallint", "int", "bigint", "double", "boolean"} else "string"


def infer(rows: list[tuple]) -> list[str]:
    """A type for each column. 0 and 1 are booleans beside true and false, and numbers elsewhere."""
    out = []
    for column in zip(*rows, strict=True):
        values = [v for v in column if v not in (None, "")]
        words = {v.lower() for v in values}
        out.append("boolean" if words & {"true", "false"} and words <= {"true", "false", "0", "1"} else widest(map(value_type, values)))
    return out


def typed(column: Column, kind: str) -> Column:
    present = F.when(column != "", column)
    if kind == "json":
        return F.to_json(F.try_parse_json(present))
    return present if kind == "string" else present.try_cast(kind)


def read(spark: SparkSession, options: dict[str, Any]) -> DataFrame:
    """`url`, `delimiter` (","), `has_headers` (true), `pk_column` (noted by the catalog)."""
    delimiter = str(options.get("delimiter", ",")).replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r")
    headed = options.get("has_headers", True) is not False
    raw = spark.read.csv(str(options["url"]), sep=delimiter, header=headed, inferSchema=False, multiLine=bool(options.get("multi_line", False)), escape='"', emptyValue="")
    names: list[str] = []
    for i, c in enumerate(raw.columns):
        n = column_name(c) if headed else f"column_{i + 1}"
        names.append(n if n not in names else f"{n}_{i + 1}")
    raw = raw.toDF(*names)
    kinds = infer([tuple(r) for r in raw.limit(SAMPLE_ROWS).collect()]) if names else []
    return raw.select(*[typed(F.col(n), k).alias(n) for n, k in zip(names, kinds or ["string"] * len(names), strict=True)])
