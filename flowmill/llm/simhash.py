"""SimHash fingerprints of word shingles and near-duplicate groups by multi-index hashing.

Two 64-bit fingerprints with at most 2 differing bits differ by at most 1 in one of their halves. So
each fingerprint is entered in two tables under its halves, and looked up under every half within
one bit of its own; of two halves that differ by one bit, one is the other with a set bit cleared, so
clearing bits finds each pair from one side. Fetched pairs are verified over all 64 bits.

Copies share a fingerprint and count once. Where one half holds more than `CROWD` fingerprints - a
large group of near copies does that - fetching all pairs would grow with the square of the group.
The fingerprints that would meet there are linked without pairs: two fingerprints are within 2 bits
of each other exactly if some 64-bit value is within 1 bit of both, so each goes under its 65 such
values, and all under one value are linked to the least of them. No link between components is lost.

No table that grows with the corpus is broadcast for the size of its files: Parquet stores copies without ids in
next to nothing, and the driver would hold all their rows.

That is the query's contract. For a corpus, `keep_one` takes one of each class of texts that are alike by
0.8 or more over five-word shingles. Such texts differ in too many bits of a shingle fingerprint to be
looked up, but in few bits of a fingerprint over their distinct words (6 % of the bits on average, 9 % at
most, in the supplied tables; unlike texts in 40 %). That fingerprint has `SEGMENTS` segments of `WIDTH` bits,
and is looked up in the table of each segment under all values within one bit. What is fetched is verified by the
complete distance, then by the true similarity (`classes`). Two texts that differ in a share p of their
bits are missed if no segment of theirs is within one bit: 0.4 % at p = 6 %, 8 % at 9 %.

Defined cases: very long texts are read whole; null, empty and blank texts have fingerprint zero and are linked like any other;
repeated rows and repeated doc_ids are rows of their own; a null doc_id is its component's id only
if no other is there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.classes import AT_LEAST, classes, keyed_texts, node_of, shingle_sets, text_key
from flowmill.llm.components import components
from flowmill.llm.shared import batch_words, materialize, slices, stir, texts_of, unused, word_codes

CROWD = 64
#: Fingerprints of words: segments, the bits of each, the longs they are cut from, and how many bits may differ.
SEGMENTS, WIDTH, LONGS, FAR = 8, 28, 4, 44


def fingerprint(text: str, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the word shingles."""
    have = text.encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not have:
        return 0
    n = max(1, len(have) - words + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(have[i : i + words]), 42) for i in range(n)), np.uint64, n)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, a hash of the whole text, and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in texts_of(batch.column(2)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "text_key", "fp"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return read.mapInArrow(run, "doc_id long, text_key long, fp long")


def _half(fp: Column, which: int) -> Column:
    return (F.shiftrightunsigned(fp, 32) if which else fp.bitwiseAND(F.lit(0xFFFFFFFF))).cast("long")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def links(prints: DataFrame) -> DataFrame:
    """Pairs u, v of the distinct fingerprints in column fp, enough to connect all that lie within
    2 bits of each other, each pair itself within 2 bits."""
    both = F.array(*[F.struct(F.lit(k).alias("which"), _half(F.col("fp"), k).alias("half")) for k in (0, 1)])
    entries = materialize(prints.select("fp", F.explode(both).alias("e")).select("fp", "e.which", "e.half"), "halves")
    crowded = entries.groupBy("which", "half").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("which", "half", F.lit(True).alias("crowded"))
    cleared = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("half").bitwiseAND(_bit(i)) != 0),
        lambda i: F.col("half").bitwiseXOR(_bit(i)),
    )
    lookups = entries.select("which", F.col("fp").alias("u"), F.explode(F.concat(F.array("half"), cleared)).alias("half"))
    table = entries.select("which", "half", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    met = lookups.join(crowded, ["which", "half"], "left").where("crowded is null").join(table.hint("merge"), ["which", "half"]).where((F.col("u") != F.col("v")) & near).select("u", "v")
    # a semi join: an inner one may broadcast the lookups, which are many more than their files' size tells
    meeting = lookups.join(crowded, ["which", "half"], "left_semi").select(F.col("u").alias("fp")).distinct()
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_bit(i))))
    placed = materialize(meeting.select("fp", F.explode(around).alias("centre")), "centres")
    least = placed.groupBy("centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("centre", "v")
    shared = placed.join(least.hint("merge"), "centre").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return met.union(shared)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """For each row doc_id, text_key, fp, component (its least fingerprint) and component_id (the
    least doc_id reachable over links of at most 2 bits)."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "prints")
    found = components(links(prints.select("fp")))
    grouped = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(heads, "component").select("fp", "component_id", "component")
    # each row has its match; an outer join can broadcast no more than the distinct fingerprints
    return rows.join(named, "fp", "left").select("doc_id", "text_key", "fp", "component_id", "component")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def word_prints(texts: pa.Array) -> np.ndarray:
    """Each text's fingerprint over its distinct lower-cased words: SEGMENTS numbers of WIDTH bits. A bit
    is 1 if it is set in over half of the words' hashes; texts without words have zeros."""
    return np.concatenate([np.zeros((0, SEGMENTS), np.int32), *[_word_prints(part) for part in slices(texts)]])


def _word_prints(texts: pa.Array) -> np.ndarray:
    begin, index, found = batch_words(texts)
    lowered = pc.utf8_lower(found).dictionary_encode()
    index = np.asarray(lowered.indices, np.int64)[index] if len(index) else np.zeros(0, np.int64)
    once, long = word_codes(lowered.dictionary)
    distinct = max(len(once), 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    pair = np.unique(owner * distinct + index)
    owner, index = pair // distinct, pair % distinct
    real = (long > 0)[index]
    owner, index = owner[real], index[real]
    raw = np.stack([stir(once * np.uint64(2 * k + 1) + np.uint64(k)) for k in range(1, LONGS + 1)], axis=1)
    sizes = np.bincount(owner, minlength=len(texts))
    # 16-bit lanes of a long count four bits at once; no run is longer than a lane can count
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    runs = np.unique(np.concatenate([starts, np.arange(0, len(owner), 1 << 15)]))
    counts = np.zeros((len(texts), LONGS, 4, 16), np.int64)
    if len(runs):
        lanes = np.uint64(0x0001000100010001)
        for k in range(LONGS):
            for j in range(16):
                sums = np.add.reduceat(((raw[:, k] >> np.uint64(j)) & lanes)[index], runs)
                np.add.at(counts[:, k, :, j], owner[runs], (sums[:, None] >> np.arange(0, 64, 16, dtype=np.uint64) & np.uint64(0xFFFF)).astype(np.int64))
    bits = counts.reshape(len(texts), LONGS * 64) * 2 > sizes[:, None]
    return (np.packbits(bits, axis=1, bitorder="little").view("<u4")[:, :SEGMENTS] & np.uint32((1 << WIDTH) - 1)).astype(np.int32)


def near_texts(docs: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """For each row doc_id, text_key, component and component_id: classes of texts whose five-word
    shingles have a Jaccard similarity of `at_least` or more, among those whose fingerprints of words agree
    in a segment but for one bit and in all but `FAR` bits."""
    keyed = keyed_texts(docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            sets = shingle_sets(texts)
            prints = pa.FixedSizeListArray.from_arrays(pa.array(word_prints(texts).ravel(), pa.int32()), SEGMENTS).cast(pa.list_(pa.int32()))
            columns = [batch.column(0), batch.column(1), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), prints]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n", "print"])

    rows = materialize(keyed.mapInArrow(read, "doc_id long, text_key long, node long, n int, print array<int>"), "prints")
    texts = materialize(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("print").alias("print")), "texts")
    place = lambda i, x: i.cast("long") * F.lit(1 << 32) + x.cast("long")
    held = texts.select("node", F.explode(F.transform("print", lambda x, i: place(i, x))).alias("key"))
    ball = F.transform("print", lambda x, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda b: x.bitwiseAND(_flag(b)) != 0), lambda b: place(i, x.bitwiseXOR(_flag(b)))))
    asked = texts.select("node", F.explode(F.flatten(ball)).alias("key"))
    fetched = materialize(asked.join(held.select("key").distinct(), "key", "left_semi"), "fetched")
    shared = held.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key").union(fetched.select("key")).distinct()
    hits = held.join(shared, "key", "left_semi").select("key", "node", F.lit(True).alias("held")).union(fetched.select("key", "node", F.lit(False)))
    entries = hits.join(texts, "node").select("key", "node", "n", "print", "held")
    apart = F.aggregate(F.zip_with("print", "other_print", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    return classes(keyed, rows, entries, at_least, apart <= FAR)


def _flag(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), i)


def keep_one(docs: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """The documents with one row of each class of near texts: that of the least doc_id (nulls last),
    then of the least hash of the text. All columns stay."""
    return keep_first(docs, materialize(near_texts(docs, at_least), "groups"))


def keep_first(docs: DataFrame, named: DataFrame) -> DataFrame:
    """`keep_one` for groups that are given: `named` has doc_id, text_key and component of each row."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = named.groupBy("component").agg(F.min(order).alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    ends = named.join(first, "component").withColumn("kept", kept)
    doc, key = unused(docs, 2)
    gone = ends.where("not kept").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (text_key(docs["text"]) == F.col(key))
    left = docs.join(gone, same, "left_anti")
    if ends.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return left
    return left.withColumn(key, text_key(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key)
