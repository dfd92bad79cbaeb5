"""Connections and the tables behind them.

Drivers: `parquet` (a folder with a Parquet file or folder for each table; reads and writes), `csv`
(one file; reads), `view` (temporary views of the session, and frames handed over in Python),
`mysql`/`postgres`/`jdbc` (Spark's JDBC source, where a driver jar is there) and `wasm`/`python` (a plugin
registered in Python that reads or writes).

Keys of tables are found out by `introspected`: from the database, or for Parquet from `catalog.json`
beside the tables. A catalog that is handed over comes first.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.lang.syntax import DocumentError
from flowmill.sources import csv_files, jdbc, plugin_tables


@dataclass
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    target: tuple[str, ...]


@dataclass
class TableInfo:
    """What Parquet doesn't say of a table: keys, and columns that are never written."""

    primary_key: tuple[str, ...] = ()
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    generated: tuple[str, ...] = ()
    unique: list[tuple[str, ...]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: columns with a sequence of their own, and the values that columns are limited to
    sequences: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)


Catalog = dict[str, TableInfo]


def catalog_of(tables: dict[str, dict[str, Any]]) -> Catalog:
    """A catalog from plain data: for each table primary_key, foreign_keys (columns, table, target) and so on."""
    many = lambda x: tuple([x] if isinstance(x, str) else x)
    out = {}
    for name, t in tables.items():
        if unknown := set(t) - {f.name for f in fields(TableInfo)}:
            raise DocumentError(f"catalog of {name}: there is no {', '.join(sorted(unknown))}")
        plain = {k: many(t[k]) for k in ("primary_key", "generated", "sequences") if k in t}
        pairs = {k: {n: many(v) for n, v in t[k].items()} for k in ("indexes", "enums") if k in t}
        keys = [ForeignKey(many(k["columns"]), k["table"], many(k["target"])) for k in t.get("foreign_keys", [])]
        out[name] = TableInfo(**plain, **pairs, foreign_keys=keys, unique=[many(u) for u in t.get("unique", [])], checks=list(t.get("checks", [])))
    return out


@dataclass
class Connection:
    spark: SparkSession
    name: str
    options: dict[str, Any]
    catalog: Catalog = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    plugins: dict[str, Any] = field(default_factory=dict)

    @property
    def driver(self) -> str:
        return str(self.options.get("driver", ""))

    def path(self, table: str) -> str:
        return f"{str(self.options['url']).rstrip('/')}/{table}.parquet"

    def exists(self, table: str) -> bool:
        if self.driver == "parquet":
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(self.path(table))
            return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return table in self.frames or self.spark.catalog.tableExists(table)

    def read(self, table: str) -> DataFrame:
        if table in self.frames:
            return self.frames[table]
        match self.driver:
            case "parquet":
                return self.spark.read.parquet(self.path(table))
            case "csv":
                return csv_files.read(self.spark, self.options)
            case "view":
                return self.spark.table(table)
            case "mysql" | "postgres" | "jdbc":
                return self.spark.read.format("jdbc").options(**jdbc.options(self.options), dbtable=jdbc.qualified(self.options, table)).load()
            case "wasm" | "python":
                plugin = self.plugins.get(str(self.options.get("plugin")))
                if plugin is not None and hasattr(plugin, "fetch"):
                    return plugin_tables.paged(self.spark, plugin, self.options)
                if plugin is None or not hasattr(plugin, "read"):
                    raise DocumentError(f"plugin {self.options.get('plugin')} reads no table")
                return plugin.read(self.spark, self.options)
        raise DocumentError(f"connection {self.name}: there is no driver {self.driver}")

    def lanes(self, table: str, column: str, n: int) -> DataFrame:
        """A JDBC table in n ranges of an integer key; elsewhere Spark splits the scan by itself."""
        if self.driver not in jdbc.DRIVERS:
            return self.read(table)
        lo, hi = self.read(table).agg(F.min(column), F.max(column)).first()
        split = {"partitionColumn": column, "lowerBound": lo or 0, "upperBound": (hi or 0) + 1, "numPartitions": n}
        return self.spark.read.format("jdbc").options(**jdbc.options(self.options), dbtable=jdbc.qualified(self.options, table), **split).load()

    def execute(self, statement: str) -> None:
        jdbc.execute(self.spark, self.options, [statement])

    def introspected(self) -> Catalog:
        """What the tables' home says of their keys; nothing where it says nothing."""
        if self.driver in jdbc.DRIVERS:
            return jdbc.introspect(self.spark, self.options)
        if self.driver == "parquet":
            where = f"{str(self.options['url']).rstrip('/')}/catalog.json"
            path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
            if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
                return catalog_of(json.loads("\n".join(r["value"] for r in self.spark.read.text(where, wholetext=True).collect())))
        return {}
