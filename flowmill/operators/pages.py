"""Ordered pages: what comes after a cursor, by primary key, number, time or several keys."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.lang.syntax import DocumentError

STRATEGIES = ("default", "pk", "numeric", "timestamp")


def keys_of(strategy: str = "default", cursor: str = "id", tiebreaker: str | None = None) -> list[str]:
    """Columns that order a page."""
    if strategy not in STRATEGIES:
        raise DocumentError(f"there is no paginate strategy {strategy}")
    if strategy in ("numeric", "timestamp") and not tiebreaker:
        raise DocumentError(f"paginate by {strategy} needs a tiebreaker")
    return [] if strategy == "default" else [cursor, *([tiebreaker] if tiebreaker else [])]


def _literals(values: list[Any], timezone: str | None) -> list[Column]:
    if any(v is None for v in values):
        raise DocumentError("a cursor can't be null")
    lits = [F.lit(v) for v in values]
    if timezone and timezone != "UTC":
        lits[0] = F.from_utc_timestamp(lits[0], timezone).cast("timestamp_ntz")
    return lits


def _together(columns: list[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])


def after(keys: list[str], values: list[Any], timezone: str | None = None) -> Column:
    """Rows whose keys come after the values, in lexicographic order. The first key is also compared
    alone, a condition that scans can use to leave out files. Times are UTC, rendered in the timezone."""
    lits = _literals(values, timezone)
    if len(keys) == 1:
        return F.col(keys[0]) > lits[0]
    return (F.col(keys[0]) >= lits[0]) & (_together([F.col(k) for k in keys]) > _together(lits))


def up_to(keys: list[str], values: list[Any], timezone: str | None = None) -> Column:
    """Rows whose keys come no later than the values: the other side of `after`."""
    lits = _literals(values, timezone)
    if len(keys) == 1:
        return F.col(keys[0]) <= lits[0]
    return (F.col(keys[0]) <= lits[0]) & (_together([F.col(k) for k in keys]) <= _together(lits))


def page(df: DataFrame, keys: list[str], size: int, cursor: list[Any] | None = None, timezone: str | None = None) -> DataFrame:
    rows = df if cursor is None else df.where(after(keys, cursor, timezone))
    return rows.orderBy(*keys).limit(size)


def offset_page(df: DataFrame, keys: list[str], size: int, offset: int) -> DataFrame:
    return df.orderBy(*keys).offset(offset).limit(size)


def lanes(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """n half-open ranges of [lo, hi], with sizes that differ by one at most."""
    n = max(1, min(n, 32, hi - lo + 1))
    each, more = divmod(hi - lo + 1, n)
    out, at = [], lo
    for i in range(n):
        to = at + each + (i < more)
        out.append((at, to))
        at = to
    return out


def sample(df: DataFrame, how: str = "first", n: int = 10, key: str | None = None, ids: list | None = None, seed: int | None = None) -> DataFrame:
    match how:
        case "first":
            return df.limit(n)
        case "random":
            return df.orderBy(F.rand(seed)).limit(n)
        case "by_id":
            return df.where(F.col(key).isin(ids or []))
    raise DocumentError(f"there is no {how} sampling")
