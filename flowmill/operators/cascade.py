"""Closure over foreign keys: the rows of other tables that filtered root rows need or own."""

from __future__ import annotations

from collections import deque
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.sources.registry import Catalog


def excluded(table: str, patterns: list[str]) -> bool:
    """Patterns are exact, `a*`, `*a`, `*a*` or `*`."""
    for p in patterns:
        head, tail, core = p.startswith("*"), p.endswith("*"), p.strip("*")
        if p == "*" or table == p or head and tail and core in table or head and not tail and table.endswith(core) or tail and not head and table.startswith(core):
            return True
    return False


def reachable(root: str, catalog: Catalog, depth: int | None = None, exclude: list[str] | None = None) -> list[str]:
    """Tables reached over foreign keys in either direction, nearest first; excluded ones aren't crossed."""
    out, todo = [root], deque([(root, 0)])
    while todo:
        table, d = todo.popleft()
        if depth is not None and d >= depth:
            continue
        info = catalog.get(table)
        near = [k.table for k in info.foreign_keys] if info else []
        near += [t for t, i in catalog.items() if any(k.table == table for k in i.foreign_keys)]
        for t in near:
            if t not in out and not excluded(t, exclude or []):
                out.append(t)
                todo.append((t, d + 1))
    return out


def write_order(tables: list[str], catalog: Catalog) -> list[str]:
    """Referenced tables first. Keys to a table itself don't count; of a circle, tables come by name."""
    left = {t: {k.table for k in catalog[t].foreign_keys if k.table in tables and k.table != t} if t in catalog else set() for t in tables}
    out: list[str] = []
    while left:
        free = sorted(t for t, needs in left.items() if not needs - set(out)) or sorted(left)[:1]
        for t in free:
            out.append(t)
            del left[t]
    return out


def _key(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(columns)])


def _semi(df: DataFrame, columns: tuple[str, ...], keys: list[DataFrame]) -> DataFrame:
    """Rows whose columns are among the keys. One semi-join; Spark chooses how."""
    all_keys = reduce(DataFrame.union, keys).dropna().distinct()
    return df.join(all_keys, reduce(lambda x, y: x & y, [F.col(f"`{c}`") == F.col(f"__k{i}") for i, c in enumerate(columns)]), "left_semi")


def closure(root: str, rows: DataFrame, tables: dict[str, DataFrame], catalog: Catalog) -> dict[str, DataFrame]:
    """The root's rows and what each other table keeps, in rounds: a table is ready once a table that it
    refers to, or that refers to it, is there. If its own key leads to a kept table, the rows that own the kept ones
    are taken; else those that kept rows of any table refer to. Tables that nothing reaches come whole."""
    kept = {root: rows}
    waiting = [t for t in tables if t != root]
    while waiting:
        ready = []
        for t in waiting:
            owns = [k for k in catalog[t].foreign_keys if k.table in kept] if t in catalog else []
            needed = [(s, k) for s in kept for k in (catalog[s].foreign_keys if s in catalog else []) if k.table == t]
            if owns or needed:
                ready.append((t, owns, needed))
        if not ready:
            break
        new = {}
        for t, owns, needed in ready:
            if owns:
                k = owns[0]
                new[t] = _semi(tables[t], k.columns, [_key(kept[k.table], k.target)])
            else:
                by: dict[tuple[str, ...], list[DataFrame]] = {}
                for s, k in needed:
                    by.setdefault(k.target, []).append(_key(kept[s], k.columns))
                parts = [_semi(tables[t], columns, keys) for columns, keys in by.items()]
                new[t] = parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).distinct()
        kept |= new
        waiting = [t for t in waiting if t not in new]
    return kept | {t: tables[t] for t in waiting}


def levels(after: dict[str, list[str]]) -> list[list[str]]:
    """Pipelines in levels, each of which needs only those before."""
    sorter = TopologicalSorter(after)
    sorter.prepare()
    out = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out.append(ready)
        sorter.done(*ready)
    return out
