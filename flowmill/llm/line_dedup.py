"""Removes lines that repeat across and within documents, exactly or but for one word.

A line is compared by its words. Two lines are near if one word changed, added or dropped turns one
into the other. A line that is near an earlier one goes, as do all later occurrences of a line; earliest
is by (doc_id, line number), null doc_ids last. Lines without words stay and count for nothing. The edit
bound is one word; it is near from `near_words` words on (by default 5, where one word is a fifth), and
shorter lines go as exact repeats alone. The unit is the word: by characters a line has as many keys as
characters, and by two words half the square of its words.

Equal lines are first made one by a 128-bit hash. Near ones meet in a deletion neighbourhood: each
line emits a hash of its words and of its words without each one in turn. Lines whose hashes without
word p are equal differ in that word at most; a line whose words equal another's without one is that
line but for a word. In a group of lines with one key, all are near each other (with the same p) or near
the whole line, so each is held against the group's earliest alone - pairs stay as few as keys - and each
pair's edit distance is verified over the words. Hot groups cost no more: the least is an aggregate.

Emitting is for few lines. Near lines of n or n - 1 words agree in their first or last (n - 1) / 2
words, so a line whose first and last halves no other line shares has no near one and emits nothing.
This leaves out no pair.

Defined cases: null and empty texts have no lines to remove; repeated rows count as one document if
doc_id and text are equal, and its lines stay in all of them; rows with equal doc_ids and other texts
are ordered by a hash of their texts; of equal lines in one document the first stays; very long texts
and lines are read whole; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from flowmill.llm.shared import batch_words, materialize, slices, texts_of, unused, word_codes

#: The fewest words of a line that may go as a near one: one word in five leaves a similarity of 0.8.
NEAR_WORDS = 5
#: Occurrences from which on a line may be told to all tasks instead of being gathered in one.
COMMON_LINE = 1000
_RNG = np.random.default_rng(77)
_BASE = (_RNG.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
#: Powers of each base, modulo 2^64, for hashes of word sequences; long lines take them anew.
_POWERS = np.ones((2, 1 << 12), np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if _POWERS[0, 1] == 1 or n > _POWERS.shape[1]:
        m = max(n, _POWERS.shape[1])
        _POWERS = np.ones((2, m), np.uint64)
        with np.errstate(over="ignore"):
            _POWERS[:, 1:] = np.multiply.accumulate(np.repeat(_BASE[:, None], m - 1, axis=1), axis=1)
    return _POWERS


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the lines, and where each line's begin, with an end."""
    begin, index, found = batch_words(lines)
    once, size = word_codes(found)
    real = (size > 0)[index]
    return once[index][real], np.concatenate([[0], np.cumsum(real)])[begin]


def _prefixes(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Running sums of word * base^(place in its line), for both bases; a row more than words."""
    place = np.arange(len(words)) - np.repeat(begin[:-1], np.diff(begin))
    terms = words * _powers(int(np.diff(begin).max(initial=1)) + 1)[:, place]
    return np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(terms, axis=1)], axis=1)


def line_keys(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line two hashes of its words, and four keys of its halves: the first and the last
    (n - 1) // 2 and n // 2 words. Lines of n and of n - 1 words have one such length in common."""
    n = np.diff(begin)
    sums = _prefixes(words, begin)
    first, last = begin[:-1], begin[1:]
    power = _powers(int(n.max(initial=1)) + 1)
    whole = _stir(sums[:, last] - sums[:, first] + n.astype(np.uint64))
    keys = []
    for half in ((n - 1) // 2, n // 2):
        head = sums[0, first + np.maximum(half, 0)] - sums[0, first]
        # the last words as if they began at place 0 of a line: divided by a power, by its inverse
        tail = (sums[0, last] - sums[0, last - np.maximum(half, 0)]) * _inverse(power, last - half - first)
        keys += [_stir(head + half.astype(np.uint64)), _stir(_stir(tail) + half.astype(np.uint64) + np.uint64(1 << 40))]
    return whole, np.stack(keys)


def _inverse(power: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inverses modulo 2^64 of powers of the first base, by Newton's steps."""
    p = power[0, np.maximum(at, 0)]
    x = p.copy()
    for _ in range(6):
        x = x * (np.uint64(2) - p * x)
    return x


def variants(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line the hash of its words without each one in turn (by place), then of all; and where
    each line's begin, with an end."""
    n = np.diff(begin)
    sums = _prefixes(words, begin)[0]
    line = np.repeat(np.arange(len(n)), n)
    first, last, at = begin[:-1][line], begin[1:][line], np.arange(len(words))
    step = _inverse(_powers(2), np.ones(1, np.int64))[0]
    without = sums[at] - sums[first] + (sums[last] - sums[at + 1]) * step + (n[line] - 1).astype(np.uint64)
    ends = begin + np.arange(len(begin))
    out = np.zeros(len(words) + len(n), np.uint64)
    out[at + line] = without
    out[ends[1:] - 1] = sums[begin[1:]] - sums[begin[:-1]] + n.astype(np.uint64)
    return _stir(out), ends


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word changed, added or dropped (or nothing) turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


LINES = "doc_id long, text_key long, line int, h1 long, h2 long, n int, keys array<long>"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def read_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """One row for each line that counts: where it is, its hash, and its halves' keys if it may be near others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(texts_of(batch.column(2))):
                split = pc.split_pattern(texts, "\n")
                offsets = np.asarray(split.offsets, np.int64)
                owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
                number = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
                words, begin = word_hashes(split.flatten())
                n = np.diff(begin)
                whole, keys = line_keys(words, begin)
                take = np.flatnonzero(n > 0)
                near = n[take] >= near_words
                flat = keys[:, take[near]].T.ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(near, 4, 0))]), pa.int32()), _signed(np.ascontiguousarray(flat)))
                rows = pa.array(owner[take] + at)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number[take], pa.int32()), _signed(whole[0, take]), _signed(whole[1, take]), pa.array(n[take], pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in LINES.split(", ")])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text").mapInArrow(run, LINES)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _joined(docs: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """`docs` with what `marked` (doc_id, text_key, ...) says of each."""
    doc, key = unused(docs, 2, marked)
    m = marked.withColumnRenamed("doc_id", doc).withColumnRenamed("text_key", key)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (text_key(docs["text"]) == F.col(key))
    return docs.join(m, same, how).drop(doc, key)


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows whose `key` another row has too."""
    twice = keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    return keyed.join(twice, "key")


ORDER = "struct(doc_id is null as none, doc_id, text_key, line)"


def near_lines(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2 of the lines that are near an earlier one. `distinct` has h1, h2, keys and first (the
    earliest occurrence)."""
    halves = distinct.where("size(keys) > 0").select("h1", F.explode(F.array_distinct("keys")).alias("key"))
    possible = _shared(halves).select("h1").distinct()
    asked = distinct.drop("keys").join(possible, "h1")
    by_doc = asked.groupBy("first.doc_id", "first.text_key").agg(F.collect_list(F.struct("first.line", "h1", "h2")).alias("asked"))
    texts = _joined(docs.select("doc_id", "text"), by_doc, "inner")
    schema = "h1 long, h2 long, doc_id long, text_key long, line int, words string, places array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc, text, key, asked_lines in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "text_key", "asked")], strict=True):
                lines = text.split("\n")
                for a in asked_lines:
                    normal = b" ".join(lines[a["line"]].encode().split()).decode()  # bytes: ASCII white space alone
                    for column, value in zip(columns, (a["h1"], a["h2"], doc, key, a["line"], normal), strict=True):
                        column.append(value)
            places, ends = variants(*word_hashes(pa.array(columns[5], pa.large_string())))
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(places))], [f.split()[0] for f in schema.split(", ")])

    sent = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"), "asked")
    candidates = materialize(sent.mapInArrow(run, schema).dropDuplicates(["h1", "h2"]).withColumn("first", F.expr(ORDER)).drop("doc_id", "text_key", "line"), "near_lines")
    # keys travel with 8 bytes of their line; what names the line joins those that meet
    met = _shared(candidates.select("h1", F.posexplode("places").alias("place", "key")))
    named = candidates.select("h1", "h2", "first", F.size("places").alias("n"))
    emitted = materialize(met.join(named, "h1").withColumn("whole", F.expr("place = n - 1")).drop("n"), "variants")
    us, them = F.struct("first", "h1", "h2"), "struct<first: struct<none: boolean, doc_id: bigint, text_key: bigint, line: int>, h1: bigint, h2: bigint>"
    deleted = emitted.where("not whole")
    # changed: the same key without the same place
    best = deleted.groupBy("key", "place").agg(F.min(us).alias("e"), F.count("*").alias("k")).where("k > 1").select("key", "place", "e")
    changed = deleted.join(best, ["key", "place"]).select("h1", "h2", "first", "e")
    # added or dropped: the whole line of one is another's without a place; each side is held against the other's earliest
    whole = emitted.where("whole")
    sides = deleted.groupBy("key").agg(F.min(us).alias("e")).join(whole.groupBy("key").agg(F.min(us).alias("w")), "key")
    longer = deleted.join(sides.select("key", F.col("w").alias("e")), "key").select("h1", "h2", "first", "e")
    shorter = whole.join(sides.select("key", "e"), "key").select("h1", "h2", "first", "e")
    pairs = changed.union(longer).union(shorter).where(F.col("e").cast(them)["first"] < F.col("first")).select("h1", "h2", F.col("e.h1").alias("g1"), F.col("e.h2").alias("g2")).distinct()
    words = candidates.select("h1", "h2", "words")
    both = pairs.join(words, ["h1", "h2"]).join(words.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("other")), ["g1", "g2"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one(a.split(" "), b.split(" ")) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("h1", "h2", "words", "other").mapInArrow(verify, "h1 long, h2 long").distinct()


def repeated_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, text_key and the numbers of the lines that go, for documents that lose any."""
    lines = materialize(read_lines(docs, near_words), "lines")
    distinct = lines.groupBy("h1", "h2").agg(F.min(F.expr(ORDER)).alias("first"), F.count("*").alias("times"), F.first("keys").alias("keys"))
    distinct = materialize(distinct, "distinct_lines")
    near = near_lines(distinct.select("h1", "h2", "first", "keys"), docs).withColumn("near", F.lit(True))
    told = materialize(distinct.select("h1", "h2", "first", "times").join(near, ["h1", "h2"], "left").where("times > 1 or near"), "told")
    # lines that are a ten-thousandth of all or more are ten thousand at most: they are broadcast, the rest is shuffled
    total = distinct.agg(F.sum("times")).first()[0] or 0
    often = F.col("times") > max(COMMON_LINE, total // 10_000)
    hot, places = F.broadcast(told.where(often)), lines.select("h1", "h2", "doc_id", "text_key", "line")
    gone = places.join(hot, ["h1", "h2"]).unionByName(places.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(told.where(~often), ["h1", "h2"]))
    gone = gone.where(f"near or first < {ORDER}")
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("removed_lines"))


def _marked(docs: DataFrame, near_words: int, name: str) -> DataFrame:
    """The documents with `text` without its repeated lines, and their numbers (or null) in column `name`."""
    gone = materialize(repeated_lines(docs, near_words), "removed").withColumnRenamed("removed_lines", name)
    place = F.col(name)
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(place, i)), "\n")
    return _joined(docs, gone, "left").withColumn("text", F.when(place.isNull(), F.col("text")).otherwise(kept))


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """The documents with `text` without its repeated lines, and the array `removed_lines` (which takes
    the place of a column of that name). Near lines of under `near_words` words stay."""
    docs = docs.drop("removed_lines")
    return _marked(docs, near_words, "removed_lines").withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast(ArrayType(IntegerType()))))


def keep_first_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """`dedup_lines` for a pipeline: the columns of `docs`, without documents of which no line is left."""
    (name,) = unused(docs)
    out, lost = _marked(docs, near_words, name), F.col(name).isNotNull()
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.where(~lost | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns])
