"""Appending, replacing and upserting, as frames; and the keyed difference of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key: the one with the greatest `order`, then with the greatest values of the other
    columns, so that runs agree. Nulls are least; map columns don't count."""
    rest = [c for c in df.columns if c not in keys and c != order and df.schema[c].dataType.typeName() not in ("map", "variant")]
    by = F.struct(*[F.col(f"`{c}`") for c in ([order] if order else []) + rest])
    others = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    if not rest and not order:
        return df.dropDuplicates(keys)
    best = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(*others), by).alias("__row"))
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__row.`{c}`") for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], how: str = "do_update", order: str | None = None) -> DataFrame:
    """`do_update` lets new rows take the place of old ones with their key, `do_nothing` leaves those.
    Without keys the rows are appended."""
    if not keys:
        return old.unionByName(new, allowMissingColumns=True)
    fresh = latest(new, keys, order)
    if how == "do_update":
        return fresh.unionByName(old.join(fresh, keys, "left_anti"), allowMissingColumns=True)
    return old.unionByName(fresh.join(old, keys, "left_anti"), allowMissingColumns=True)


def fitting(new: DataFrame, columns: list[str], generated: tuple[str, ...] = ()) -> DataFrame:
    """The columns that the destination has and that aren't generated there."""
    have = {c.lower(): c for c in new.columns}
    return new.select(*[F.col(f"`{have[c.lower()]}`").alias(c) for c in columns if c.lower() in have and c not in generated])


def difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with `status` missing, extra or changed. Repeats of a key count once, by the row of greatest hash.

    Both sides go through one aggregation by key: a row travels as its key and 128 bits of a hash of its
    other columns, taken as the types of `expected`, so the rows themselves are never shuffled."""
    types = {f.name: f.dataType for f in expected.schema.fields}
    rest = [c for c in expected.columns if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        value = lambda c: F.col(f"`{c}`").cast(types[c]) if types[c].typeName() not in ("map", "variant") else F.to_json(F.col(f"`{c}`"))
        # a null and a value next to it must not change places unseen: hashes skip nulls, so these are told apart
        columns = [x for c in rest for x in (F.col(f"`{c}`").isNull(), value(c))]
        mark = F.struct(F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns, F.lit(3)))
        return df.select(*[F.col(f"`{k}`").cast(types[k]).alias(k) for k in keys], *[(mark if name == n else F.lit(None).cast("struct<col1: bigint, col2: bigint>")).alias(n) for n in ("__e", "__a")])

    both = side(expected, "__e").unionByName(side(actual, "__a"))
    parts = [F.max(F.col(f"{n}.col{i}")).alias(f"{n}{i}") for n in ("__e", "__a") for i in (1, 2)]
    met = both.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*parts)
    differ = (F.col("__e1") != F.col("__a1")) | (F.col("__e2") != F.col("__a2"))
    status = F.when(F.col("__a1").isNull(), "missing").when(F.col("__e1").isNull(), "extra").when(differ, "changed")
    return met.withColumn("status", status).where("status is not null").select(*[F.col(f"`{k}`") for k in keys], "status")
