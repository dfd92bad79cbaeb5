"""Helpers that several operators share: scratch tables, ranges of keys, words of a batch."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: list[str] = []
#: Ranges of a key that are made at most; a range may be as large as its task's disk allows.
MOST_RANGES = 4096


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: `spark.checkpoint.dir` where it is set.

    Where it is unset, a local master gets a temporary folder of its own and any other master
    gets a folder in the warehouse, which all its executors see.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="flowmill-"))
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[0], ignore_errors=True)
    return "file://" + _LOCAL_SCRATCH[0]


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_scratch() -> None:
    """Deletes the intermediate tables that this process wrote. Results that read them are gone by then:
    it runs at the end of the process, or when its caller has stored what it wanted."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
        except Exception:  # the JVM has ended before; the folder is the cluster's to clear
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: lineage ends there,
    so that a lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, n: int = 1, *more: DataFrame) -> list[str]:
    """Column names that none of the frames has, whatever the case of letters."""
    have = {c.lower() for one in (df, *more) for c in one.columns}
    names = (f"_{i}" for i in itertools.count())
    return list(itertools.islice((x for x in names if x not in have), n))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending values of `key` that are in `df` and cut it into even ranges.

    One pass over the key column alone; the driver gets n numbers.
    """
    if n < 2:
        return []
    n = min(n, MOST_RANGES)
    at = F.lit([i / n for i in range(1, n)])
    row = df.select(F.percentile_approx(key, at, max(10_000, 20 * n)).alias("b"), F.min(key).alias("m")).first()
    return sorted({int(b) for b in row["b"] or []} - {row["m"]})


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at or below the key (null: 0), found in two steps of about the
    square root of their number each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    rest = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    below = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.get(rest, below - 1), lambda b: b <= key))
    return F.when(key.isNull() | (below == 0), F.lit(0)).otherwise((below - 1) * F.lit(step) + inside).cast("int")


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A batch's texts with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.Array, most_bytes: int = 1 << 22) -> list[pa.Array]:
    """A batch's texts in runs of at most so many bytes, or of a single text."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    out, at = [], 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        out.append(texts.slice(at, to - at))
        at = to
    return out


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pieces of texts between ASCII white space: where each text's pieces begin (and an end),
    each piece's number among the distinct ones, and those. Some pieces are empty."""
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    begin = np.asarray(split.offsets, dtype=np.int64)
    return begin - begin[0], np.asarray(coded.indices), coded.dictionary


_RNG = np.random.default_rng(20_250_101)
_BYTE_BASE, _SPREAD = (_RNG.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)


def stir(x: np.ndarray) -> np.ndarray:
    """Lets all bits of 64-bit numbers bear on all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word's bytes (a polynomial in their places, stirred), and its length in bytes."""
    words = words.cast(pa.large_binary())
    sizes = np.asarray(pc.binary_length(words), np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(words), np.uint64), sizes
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    powers = np.full(int(sizes.max()), _BYTE_BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    real = np.flatnonzero(sizes)
    starts = np.cumsum(sizes) - sizes
    terms = (raw + np.uint64(1)) * powers[np.arange(total) - np.repeat(starts, sizes)]
    out = np.zeros(len(words), np.uint64)
    out[real] = np.add.reduceat(terms, starts[real]) + sizes[real].astype(np.uint64) * _SPREAD
    return stir(out), sizes


class BoundedMemo(dict):
    """A dict that a batch may fill; `trim` empties it once it holds too much."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    kind = np.int32 if total + int(starts.max()) < 1 << 31 else np.int64
    ends = np.cumsum(lengths)
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out
