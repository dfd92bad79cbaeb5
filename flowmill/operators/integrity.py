"""Hashes of rows, and one Merkle root for a table, whatever its order and partitions.

A value's bytes are a tag and a text form of its own (`ENCODING`), so equal values have equal bytes across tables that
were written apart. Rows and leaves are hashed in Spark. The tree is folded in key order, whole blocks of
`BLOCK` by their tasks, level after level; the driver folds 65,536 roots at most.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODING = "flowmill-1"
BLOCK = 1 << 16
#: Rows from which on 65,536 ranges of keys are numbered apart, not 4,096.
MANY = 1_000_000_000
EMPTY = hashlib.sha256(b"").hexdigest()


def encoded(column: Column, t: T.DataType) -> Column:
    """Tag and text of a value: n null, i whole number, f float, d decimal, s text, b bytes, t time, j others."""
    if isinstance(t, (T.IntegralType, T.BooleanType)):
        text = F.concat(F.lit("i"), column.cast("long").cast("string"))
    elif isinstance(t, T.DecimalType):
        plain = column.cast("string")
        trimmed = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, r"0+\z", ""), r"\.\z", "")).otherwise(plain)
        text = F.concat(F.lit("d"), F.when(trimmed == "-0", F.lit("0")).otherwise(trimmed))
    elif isinstance(t, T.FractionalType):
        x = column.cast("double")
        text = F.when(~F.isnan(x), F.concat(F.lit("f"), (x + F.lit(0.0)).cast("string")))
    elif isinstance(t, T.BinaryType):
        text = F.concat(F.lit("b"), F.hex(column))
    elif isinstance(t, T.StringType):
        text = F.concat(F.lit("s"), column)
    elif isinstance(t, T.DateType):
        text = F.concat(F.lit("t"), F.unix_date(column).cast("string"))
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit("t"), F.unix_micros(column.cast("timestamp")).cast("string"))
    else:
        text = F.concat(F.lit("j"), F.to_json(F.struct(column.alias("v"))))
    full = F.coalesce(text, F.lit("n"))
    return F.concat(F.length(full).cast("string"), F.lit(":"), full)


def row_bytes(df: DataFrame, columns: list[str]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.concat(*[encoded(F.col(f"`{c}`"), types[c]) for c in columns]) if columns else F.lit("")


def hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    """row_key and row_hash (hex). Columns count in the order of their names; without keys the hash is the key."""
    full = F.sha2(row_bytes(df, sorted(df.columns)).cast("binary"), 256)
    rows = df.select((row_bytes(df, keys) if keys else full).alias("row_key"), full.alias("row_hash"))
    return rows if keys else rows.distinct()


def leaf() -> Column:
    """Hash of a zero byte, the key's length in four bytes (little-endian), the key, and the row's hash."""
    key = F.col("row_key").cast("binary")
    size = F.lpad(F.hex(F.length(key)), 8, "0")
    turned = F.unhex(F.concat(*[F.substring(size, i, 2) for i in (7, 5, 3, 1)]))
    return F.sha2(F.concat(F.lit(b"\x00"), turned, key, F.unhex("row_hash")), 256)


def fold(leaves: list[bytes]) -> bytes:
    """Root of a level: pairs are hashed, a last one without a partner goes up as it is."""
    if not leaves:
        return bytes.fromhex(EMPTY)
    while len(leaves) > 1:
        up = [hashlib.sha256(b"\x01" + leaves[i] + leaves[i + 1]).digest() for i in range(0, len(leaves) - 1, 2)]
        leaves = up + ([leaves[-1]] if len(leaves) % 2 else [])
    return leaves[0]


def numbered(rows: DataFrame, digits: int = 3) -> DataFrame:
    """Rows in the order of their key with their number from 0. A row's number is its rank among the keys
    with its first hash digits and the count of those with lesser ones, so no task sees all rows."""
    spread = rows.withColumn("sort", F.sha2(F.col("row_key").cast("binary"), 256)).withColumn("part", F.conv(F.substring("sort", 1, digits), 16, 10).cast("int"))
    counts = spread.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("sort", "row_hash")) - 1
    return spread.withColumn("local", local).join(F.broadcast(base), "part").select("row_key", "row_hash", (F.col("base") + F.col("local")).alias("number"))


def merkle_root(df: DataFrame, keys: list[str], rows: int | None = None) -> str:
    """Root over the rows in the order of their keys' hashes; `rows` is their number, if it is known. Leaves are
    hashed in Spark; blocks of BLOCK numbers are folded to one until few are left, and those on the driver."""

    def block(part: pa.Table) -> pa.Table:
        part = part.sort_by("number")
        root = fold([bytes.fromhex(h) for h in part["hash"].to_pylist()]).hex()
        return pa.table({"number": pa.array([part["number"][0].as_py() // BLOCK], pa.int64()), "hash": [root]})

    rows = df.count() if rows is None else rows
    level = numbered(hashed(df, keys), 3 if rows < MANY else 4).select("number", leaf().alias("hash"))
    while True:
        level = level.groupBy(F.expr(f"number div {BLOCK}").alias("block")).applyInArrow(block, "number long, hash string")
        rows = -(-rows // BLOCK)
        if rows <= BLOCK:
            break
    return fold([bytes.fromhex(r["hash"]) for r in sorted(level.collect())]).hex()


def receipt(df: DataFrame, pipeline: str, table: str, keys: list[str]) -> dict | None:
    """What verifies a written table later; none for a table without rows."""
    n = df.count()
    if not n:
        return None
    return {"pipeline": pipeline, "table": table, "rows": n, "root": merkle_root(df, keys, n), "keys": keys, "columns": sorted(df.columns), "encoding": ENCODING}
