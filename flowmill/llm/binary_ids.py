"""Token ids in files of Simple-8b frames, in ascending doc_id order.

A file is a run of frames, each followed by the 8 bytes of `TRAILER`. A frame holds whole documents,
about `FRAME_IDS` ids of them, little-endian and in 64-bit fields:

    magic, key range, number in the range, documents, ids, blocks, words, raw values
    doc_id of each document | its number of ids (-1 - n where the doc_id is null)
    words before each block, and in all | words | raw values

(Key range, number in the range) orders the frames of all files. Spark's own file writer puts the
frames down, so its commit protocol holds: a task that is lost or run twice leaves no part behind.
Files are read as binary files, a few frames each.

Defined cases: a null text is empty and has its end id alone; null doc_ids come first; rows with
equal doc_ids are ordered by text; an empty table makes a folder without frames; other columns are
ignored, so their names can't clash. A document longer than a frame makes a frame of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.llm import simple8b
from flowmill.llm.encoding import encoder
from flowmill.llm.shared import key_bounds, materialize, partitions, range_bucket, texts_of

MAGIC = int.from_bytes(b"FMIDS8B1", "little")
TRAILER = "#ENDFRM\n"
FRAME_IDS = 1 << 18
FRAMES_A_FILE = 32
HEAD = 8


def frame(key_range: int, number: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets, raw = simple8b.encode(ids)
    head = np.array([MAGIC, key_range, number, len(doc_ids), len(ids), len(offsets) - 1, len(words), len(raw)], "<i8")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    signed = np.array([-1 - n if d is None else n for d, n in zip(doc_ids, lengths, strict=True)], "<i8")
    return b"".join([head.tobytes(), keys.tobytes(), signed.tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes(), raw.astype("<u8").tobytes()])


def frames(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """Key range, number, doc_ids, lengths and ids of each frame of a file."""
    at = 0
    while at < len(content):
        magic, key_range, number, docs, n, blocks, words, raws = np.frombuffer(content, "<i8", HEAD, at).tolist()
        if magic != MAGIC:
            raise ValueError("this is no file of token ids")
        at += 8 * HEAD
        parts = []
        for kind, count in (("<i8", docs), ("<i8", docs), ("<i8", blocks + 1), ("<u8", words), ("<u8", raws)):
            parts.append(np.frombuffer(content, kind, count, at))
            at += 8 * count
        keys, signed, offsets, packed, raw = parts
        if content[at : at + len(TRAILER)] != TRAILER.encode():
            raise ValueError("a frame of token ids is cut short")
        at += len(TRAILER)
        doc_ids = [None if s < 0 else k for k, s in zip(keys.tolist(), signed.tolist(), strict=True)]
        yield key_range, number, doc_ids, np.where(signed < 0, -1 - signed, signed), simple8b.decode(packed, offsets, raw, n)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes whole texts and writes their ids, in ascending doc_id order, to files below `path`."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = key_bounds(keyed, "doc_id", partitions(spark))
    ordered = keyed.withColumn("part", range_bucket(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, end_id)
        part, number, keys, lengths, held, total = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([frame(part, number, keys, lengths, np.concatenate(held))], pa.binary())], ["frame"])

        for batch in batches:
            ids, begin = coder.encode(texts_of(batch.column(1)))
            for doc, p, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                if keys and (p != part or total >= FRAME_IDS):
                    yield flush()
                    number, keys, lengths, held, total = number + 1, [], [], [], 0
                if p != part:
                    part, number = p, 0
                keys.append(doc)
                lengths.append(b - a)
                held.append(ids[a:b])
                total += b - a
        if keys:
            yield flush()

    coded = ordered.mapInArrow(write, "frame binary")
    coded.select(F.col("frame").cast("string")).write.option("lineSep", TRAILER).option("maxRecordsPerFile", FRAMES_A_FILE).text(path)


ROWS = "part int, number int, nth int, doc_id long, before long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: its frame, the ids before it in the frame, its
    number of ids and their checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for content in batch.column(0):
                for part, number, doc_ids, lengths, ids in frames(content.as_py()):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    ends = np.cumsum(lengths)
                    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                    n = len(doc_ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([part] * n, [number] * n, range(n), doc_ids, ends - lengths, lengths, sums), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, ROWS)


def with_starts(rows: DataFrame) -> DataFrame:
    """The ids of all documents before each: within its frame, its key range, and the ranges before."""
    by_frame = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    by_part = by_frame.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = by_part.select("part", earlier(Window.orderBy("part")).alias("parts_before"))
    heads = by_frame.select("part", "number", earlier(Window.partitionBy("part").orderBy("number")).alias("frames_before"))
    start = F.col("parts_before") + F.col("frames_before") + F.col("before")
    return rows.join(heads.join(parts, "part"), ["part", "number"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of whole documents and reads the files back."""
    write_ids(docs, path, tokenizer, end_id)
    return with_starts(materialize(read_ids(docs.sparkSession, path), "ids_read"))
