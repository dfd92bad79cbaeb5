"""Writing a pipeline's rows: append, replace, upsert; dead letters; and what Spark doesn't enforce."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.lang.syntax import DocumentError
from flowmill.operators import merge
from flowmill.sources import jdbc, plugin_tables
from flowmill.sources.registry import Connection, TableInfo
from flowmill.sources.types import coerced


def swap(connection: Connection, table: str, df: DataFrame) -> None:
    """Writes beside the table and moves the new folder into its place, so that the table may be read
    while it is written, and a failed write leaves it as it was."""
    spark, path = connection.spark, connection.path(table)
    stage = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(stage)
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(path), hadoop.Path(stage)
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    if files.exists(old) and not files.rename(old, kept):
        raise OSError(f"{path} can't be moved")
    if not files.rename(new, old):
        files.rename(kept, old)
        raise OSError(f"{stage} can't be moved into place")
    if files.exists(kept):
        files.delete(kept, True)


def remove(spark, path: str) -> None:
    """Deletes a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write(connection: Connection, table: str, df: DataFrame, mode: str = "append", on_conflict: str | None = None, create_missing_columns: bool = False) -> None:
    if connection.driver in ("wasm", "python"):
        plugin = connection.plugins.get(str(connection.options.get("plugin")))
        if plugin is not None and hasattr(plugin, "write_batch"):
            plugin_tables.stepped(df, plugin, table, mode, dict(connection.options))
            return
        if plugin is None or not hasattr(plugin, "write"):
            raise DocumentError(f"plugin {connection.options.get('plugin')} writes no table")
        plugin.write(df, table, mode)
        return
    if connection.driver in jdbc.DRIVERS:
        info = connection.catalog.get(table, TableInfo())
        df = merge.fitting(df, df.columns, (*info.generated,))
        if on_conflict and info.primary_key:
            df = merge.latest(df, list(info.primary_key))
        jdbc.write(df, connection.options, table, mode, list(info.primary_key), on_conflict)
        return
    if connection.driver == "view":
        df.createOrReplaceTempView(table)
        return
    if connection.driver != "parquet":
        raise DocumentError(f"connection {connection.name} ({connection.driver}) can't be written to")
    info = connection.catalog.get(table, TableInfo())
    if not connection.exists(table):
        df = merge.fitting(df, df.columns, info.generated)
        if on_conflict and info.primary_key and mode == "append":
            df = merge.latest(df, list(info.primary_key))
        df.write.parquet(connection.path(table))
        return
    old = connection.read(table)
    columns = old.columns + ([c for c in df.columns if c.lower() not in {x.lower() for x in old.columns}] if create_missing_columns else [])
    types = {f.name.lower(): f.dataType for f in old.schema.fields}
    df = merge.fitting(df, columns, info.generated)
    df = df.select(*[coerced(F.col(f"`{c}`"), df.schema[c].dataType, types[c.lower()]).alias(c) if c.lower() in types else F.col(f"`{c}`") for c in df.columns])
    if mode == "replace":
        swap(connection, table, df)
    elif on_conflict and info.primary_key:
        swap(connection, table, merge.upsert(old, df, list(info.primary_key), on_conflict))
    elif len(columns) > len(old.columns):
        swap(connection, table, old.unionByName(df, allowMissingColumns=True))
    else:
        missing = [F.lit(None).cast(types[c.lower()]).alias(c) for c in old.columns if c not in df.columns]
        df.select("*", *missing).select(*old.columns).write.mode("append").parquet(connection.path(table))


def truncate(connection: Connection, table: str) -> None:
    """Takes all rows away and leaves the table."""
    if connection.driver in jdbc.DRIVERS:
        connection.execute(f"TRUNCATE TABLE {jdbc.qualified(connection.options, table)}")
    else:
        swap(connection, table, connection.read(table).limit(0))


def drop(connection: Connection, table: str, if_exists: bool = False) -> None:
    """Takes a table away. One that isn't there is an error unless `if_exists`."""
    if connection.driver == "view":
        there = connection.spark.catalog.dropTempView(table)
    elif connection.driver in jdbc.DRIVERS:
        there = table in connection.introspected()
        if there:
            connection.execute(f"DROP TABLE {jdbc.qualified(connection.options, table)}")
    else:
        there = connection.exists(table)
        if there:
            remove(connection.spark, connection.path(table))
    if not there and not if_exists:
        raise DocumentError(f"connection {connection.name} has no table {table}")


def dead_letters(rows: DataFrame) -> DataFrame:
    """Failed rows as they are kept: with an id and the time."""
    return rows.select(F.expr("uuid()").alias("id"), "*", F.current_timestamp().alias("failed_at"))


#: Reports of statements that Parquet doesn't know; DDL types by Spark type.
_DDL = {T.LongType: "BIGINT", T.IntegerType: "INT", T.ShortType: "SMALLINT", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.BooleanType: "BOOLEAN", T.StringType: "STRING", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP_NTZ", T.TimestampType: "TIMESTAMP", T.BinaryType: "BINARY"}


def ddl(table: str, schema: T.StructType, info: TableInfo, settings, renamed: dict[str, str] | None = None, existing: list[str] | None = None) -> list[dict]:
    """What creating the table takes, in order: phase (pre or post the data), statement, and whether
    Spark enforces it. Keys to columns that aren't written go; keys to renamed tables are renamed."""
    renamed, names = renamed or {}, {f.name for f in schema.fields}
    kind = lambda t: _DDL.get(type(t), t.simpleString().upper())
    out: list[dict] = []
    say = lambda phase, statement, enforced=False: out.append({"phase": phase, "statement": statement, "enforced": enforced})
    listed = lambda columns: ", ".join(columns)
    if existing is not None:
        for f in schema.fields:
            if f.name not in existing:
                say("pre", f"ALTER TABLE {table} ADD COLUMNS ({f.name} {kind(f.dataType)})", True)
        return out
    for column, values in info.enums.items():
        if column in names:
            say("pre", f"CREATE TYPE {table}_{column} AS ENUM ({listed(repr(v) for v in values)})")
    say("pre", f"CREATE TABLE {table} ({listed(f'{f.name} {kind(f.dataType)}' for f in schema.fields)}) USING parquet", True)
    if not settings.skip_seq:
        for column in info.sequences:
            if column in names:
                say("pre", f"CREATE SEQUENCE {table}_{column}_seq OWNED BY {table}.{column}")
    if info.primary_key and set(info.primary_key) <= names and not settings.skip_pk:
        say("post", f"ALTER TABLE {table} ADD PRIMARY KEY ({listed(info.primary_key)})")
    if not settings.skip_idx:
        for name, columns in info.indexes.items():
            if set(columns) <= names:
                say("post", f"CREATE INDEX {name} ON {table} ({listed(columns)})")
    if not settings.skip_fk:
        for k in info.foreign_keys:
            if set(k.columns) <= names:
                say("post", f"ALTER TABLE {table} ADD FOREIGN KEY ({listed(k.columns)}) REFERENCES {renamed.get(k.table, k.table)} ({listed(k.target)})")
    if not settings.skip_unique:
        for u in info.unique:
            if set(u) <= names:
                say("post", f"ALTER TABLE {table} ADD UNIQUE ({listed(u)})")
    if not settings.skip_check:
        for c in info.checks:
            say("post", f"ALTER TABLE {table} ADD CHECK ({c})")
    return out


def violations(df: DataFrame, info: TableInfo, read) -> DataFrame:
    """Rows against the keys that nothing enforces: constraint and the number of violations."""
    found = []
    for what, keys in [("primary_key", info.primary_key), *[("unique", u) for u in info.unique]]:
        if keys:
            found.append(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).select(F.lit(f"{what}({','.join(keys)})").alias("constraint"), "violations"))
    for k in info.foreign_keys:
        target = read(k.table).select(*[F.col(t).alias(c) for t, c in zip(k.target, k.columns, strict=True)])
        orphans = df.dropna(subset=list(k.columns)).join(target, list(k.columns), "left_anti")
        found.append(orphans.agg(F.count("*").alias("violations")).select(F.lit(f"foreign_key({','.join(k.columns)})").alias("constraint"), "violations"))
    for column, values in info.enums.items():
        found.append(df.agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*values)).alias("violations")).select(F.lit(f"enum({column})").alias("constraint"), "violations"))
    for c in info.checks:
        found.append(df.agg(F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias("violations")).select(F.lit(f"check({c})").alias("constraint"), "violations"))
    out = found[0] if found else df.sparkSession.createDataFrame([], "constraint string, violations long")
    for f in found[1:]:
        out = out.union(f)
    return out
