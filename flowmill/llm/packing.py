"""Best-fit packing planned over a histogram of lengths.

Documents are cut into pieces of at most `capacity` ids. The driver sees one count for each
length - never more than `capacity` numbers - and runs best-fit decreasing over those counts: equal
bins move together as a run of sequence numbers, so the plan has few rows however many pieces there
are. A planned row says that the pieces of one length with ranks in a range lie, `per_bin` to a
sequence, from some offset on. Pieces get their rank within their length and join the plan.

No task sees a whole length: ranks are taken within (length, bucket), and what the buckets before
hold is added from a small table; the join's key is the length and a block of ranks.

Defined cases: very long texts are cut into pieces, all of which are packed; of bins with the same room the
one opened last is filled first; pieces of one length are dealt out in the order of doc_id and piece; a null text is empty and has its end id alone; an empty table gives no rows; repeated
rows and repeated or null doc_ids are packed as rows of their own; columns other than `doc_id` and
`text` are ignored, so their names can't clash.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.encoding import encoder
from flowmill.llm.shared import materialize, partitions, texts_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANK_BLOCK = 1024


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document: its place in the document, length and checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, end_id)
        for batch in batches:
            ids, begin = coder.encode(texts_of(batch.column(1)))
            raw, step = memoryview(ids.astype("<u4").tobytes()), 4
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, a, b in zip(batch.column(0).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                for k, at in enumerate(range(a, b, capacity)):
                    to = min(at + capacity, b)
                    for column, value in zip(rows, (doc, k, at - a, to - at, zlib.crc32(raw[at * step : to * step])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of lengths. Rows (length, rank from, rank to, first
    sequence, pieces a sequence, offset), and the number of sequences.

    Placing pieces of one length one by one, best fit keeps filling the fullest bin that still has
    room until it has none, then goes to the next; so a run of n equal bins with room r takes
    r // length pieces each, and at most one bin is left partly filled.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    bins = 0

    def put(r: int, first: int, n: int) -> None:
        if r and n:
            if r not in room:
                room[r] = []
                bisect.insort(rooms, r)
            room[r].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                r = rooms[at]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r], rooms[at]
            else:
                r, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            per = r // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, rank + full * per, first, per, capacity - r))
                put(r - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < n:
                plan.append((length, rank, rank + left, first + full, left, capacity - r))
                put(r - left * length, first + full, 1)
                rank, full, left = rank + left, full + 1, 0
            put(r, first + full, n - full)
    return plan, bins


def ranked(cut: DataFrame) -> DataFrame:
    """Each piece's rank (from 0) within its length, in an order that depends on the rows alone."""
    spark = cut.sparkSession
    buckets = max(64, partitions(spark))
    salted = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = salted.withColumn("local", F.row_number().over(inside) - 1)
    return local.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("local")).drop("bucket", "base", "local")


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds `sequence_id` and `offset` to a table of pieces with a `length` of at most `capacity`."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = plan_best_fit(counts, capacity)
    slots = spark.createDataFrame(plan, "length long, from long, to long, first long, per long, at long")
    slots = slots.withColumn("block", F.explode(F.sequence(F.expr("from div 1024"), F.expr("(to - 1) div 1024"))))
    p = ranked(cut).withColumn("block", F.expr("rank div 1024")).alias("p")
    s = slots.alias("s")
    on = (F.col("p.length") == F.col("s.length")) & (F.col("p.block") == F.col("s.block")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    nth = F.col("rank") - F.col("from")
    return p.join(s, on).select(
        *[f"p.{c}" for c in cut.columns],
        (F.col("first") + F.expr("(rank - from) div per")).alias("sequence_id"),
        (F.col("at") + nth % F.col("per") * F.col("p.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenizes whole documents and packs their pieces into sequences of at most `capacity` ids."""
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def sequences_needed(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences than this."""
    return max(-(-int(lengths.sum()) // capacity), int((lengths > capacity // 2).sum())) if len(lengths) else 0
