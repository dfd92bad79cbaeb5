"""Databases over JDBC: options, statements, keys from the driver's own metadata, and upserts.

Rows to upsert go to a staging table first; one transaction then merges it and drops it, so a task that
Spark repeats changes nothing that is seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

DRIVERS = ("mysql", "postgres", "jdbc")
#: Rows that a read fetches and a write sends at a time.
FETCH, BATCH = 10_000, 5_000


def options(given: dict[str, Any]) -> dict[str, str]:
    """Options of Spark's JDBC source: url, user, password, driver class and sizes of transfers."""
    url = str(given["url"])
    out = {"url": url if url.startswith("jdbc:") else f"jdbc:{url}", "fetchsize": str(given.get("fetch_size", FETCH)), "batchsize": str(given.get("batch_size", BATCH))}
    for name, key in (("user", "user"), ("username", "user"), ("password", "password"), ("driver_class", "driver")):
        if given.get(name):
            out[key] = str(given[name])
    return out


def qualified(given: dict[str, Any], table: str) -> str:
    return f"{given['schema']}.{table}" if given.get("schema") else table


@contextmanager
def connected(spark: SparkSession, given: dict[str, Any]) -> Iterator[Any]:
    o = options(given)
    if o.get("driver"):
        spark._jvm.java.lang.Class.forName(o["driver"])
    properties = spark._jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in o:
            properties.setProperty(name, o[name])
    connection = spark._jvm.java.sql.DriverManager.getConnection(o["url"], properties)
    try:
        yield connection
    finally:
        connection.close()


def execute(spark: SparkSession, given: dict[str, Any], statements: list[str]) -> None:
    """All statements in one transaction."""
    with connected(spark, given) as connection:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            for text in statements:
                statement.execute(text)
            connection.commit()
        except Exception:
            connection.rollback()
            raise


def rows(result: Any, *columns: str) -> list[tuple]:
    out = []
    while result.next():
        out.append(tuple(result.getObject(c) for c in columns))
    return out


def introspect(spark: SparkSession, given: dict[str, Any]) -> dict[str, Any]:
    """What the database says of its tables: keys, foreign keys, indexes and generated columns."""
    from flowmill.sources.registry import ForeignKey, TableInfo

    schema, out = given.get("schema"), {}
    with connected(spark, given) as connection:
        about = connection.getMetaData()
        catalog = connection.getCatalog()
        kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        for owner, table in rows(about.getTables(catalog, schema, "%", kinds), "TABLE_SCHEM", "TABLE_NAME"):
            key = sorted(rows(about.getPrimaryKeys(catalog, owner, table), "KEY_SEQ", "COLUMN_NAME"))
            links: dict[str, list] = {}
            for name, n, column, other, target in rows(about.getImportedKeys(catalog, owner, table), "FK_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME"):
                links.setdefault(name or f"{other}", []).append((n, column, other, target))
            found: dict[str, list] = {}
            single: set[str] = set()
            for name, n, column, repeated in rows(about.getIndexInfo(catalog, owner, table, False, True), "INDEX_NAME", "ORDINAL_POSITION", "COLUMN_NAME", "NON_UNIQUE"):
                if name and column:
                    found.setdefault(name, []).append((n, column))
                    single |= set() if repeated in (True, 1, "true") else {name}
            primary = tuple(c for _, c in key)
            indexes = {name: tuple(c for _, c in sorted(columns)) for name, columns in found.items()}
            made = rows(about.getColumns(catalog, owner, table, "%"), "COLUMN_NAME", "IS_GENERATEDCOLUMN", "IS_AUTOINCREMENT")
            out[table] = TableInfo(
                primary,
                [ForeignKey(tuple(c for _, c, _, _ in sorted(k)), k[0][2], tuple(t for _, _, _, t in sorted(k))) for k in links.values()],
                tuple(c for c, generated, automatic in made if generated == "YES" and automatic != "YES"),
                [c for n, c in indexes.items() if n in single and c != primary],
                [],
                {n: c for n, c in indexes.items() if n not in single},
                tuple(c for c, _, automatic in made if automatic == "YES"),
            )
    return out


def upsert_statements(driver: str, table: str, stage: str, columns: list[str], keys: list[str], how: str) -> list[str]:
    """The merge of a staging table, and its end."""
    names, rest = ", ".join(columns), [c for c in columns if c not in keys]
    update = how == "do_update" and rest
    if driver == "mysql":
        sets = ", ".join(f"{c} = VALUES({c})" for c in rest)
        merge = f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} ON DUPLICATE KEY UPDATE {sets}" if update else f"INSERT IGNORE INTO {table} ({names}) SELECT {names} FROM {stage}"
    elif driver == "postgres":
        sets = ", ".join(f"{c} = EXCLUDED.{c}" for c in rest)
        merge = f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} ON CONFLICT ({', '.join(keys)}) DO {'UPDATE SET ' + sets if update else 'NOTHING'}"
    else:
        on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
        matched = "WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{c} = s.{c}" for c in rest) + " " if update else ""
        merge = f"MERGE INTO {table} t USING {stage} s ON {on} {matched}WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{c}' for c in columns)})"
    return [merge, f"DROP TABLE {stage}"]


def write(df: DataFrame, given: dict[str, Any], table: str, mode: str, keys: list[str], how: str | None) -> None:
    """Appends, replaces, or upserts by a staging table."""
    spark, driver, name = df.sparkSession, str(given.get("driver")), qualified(given, table)
    put = lambda where, how: df.write.format("jdbc").options(**options(given), dbtable=where, truncate="true").mode(how).save()
    if mode == "replace":
        put(name, "overwrite")
    elif how and keys:
        stage = qualified(given, f"{table}_{uuid.uuid4().hex[:12]}")
        put(stage, "overwrite")
        execute(spark, given, upsert_statements(driver, name, stage, df.columns, keys, how))
    else:
        put(name, "append")
