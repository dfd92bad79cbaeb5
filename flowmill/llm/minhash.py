"""MinHash fingerprints of word shingles: signatures in numpy; near-duplicate classes by true Jaccard.

A signature holds, for each of `PERMUTATIONS` universal hashes a * x + b (mod 2^64, a odd), the least
value over a text's shingles of five lower-cased words; shorter texts are one shingle, texts without
words have none. A fingerprint keeps 8 bits of each minimum; equal bits by chance are allowed for in
the likeness of two fingerprints.

Near duplicates: `similar` joins bands of the signatures in Spark and verifies true similarities.

Defined cases: very long texts are read whole, in pieces of bounded size; null texts are empty; empty and blank texts share a fingerprint and have likeness 1
to each other; repeated rows are rows of their own; rows with equal doc_ids follow in the order of
their texts; null doc_ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.shared import batch_words, key_bounds, materialize, partitions, range_bucket, slices, texts_of, word_codes

PERMUTATIONS = 128
WORDS = 5
#: Bands of a signature for candidates, and the minima in each.
BANDS, ROWS = 32, 4
CHUNK = 1 << 15
_RNG = np.random.default_rng(20_240_607)
_MULTIPLY = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_PLACE = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NONE = np.uint64(2**64 - 1)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Hashes of the shingles of a batch of texts."""

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All shingle hashes, and where each text's begin, with an end."""
        begin, index, found = batch_words(texts)
        once, long = word_codes(pc.utf8_lower(found))
        real = (long > 0)[index]
        begin = np.concatenate([[0], np.cumsum(real)])[begin]
        word = once[index][real]
        sizes = np.diff(begin)
        counts = np.where(sizes == 0, 0, np.maximum(1, sizes - WORDS + 1))
        out = np.zeros(int(counts.sum()), np.uint64)
        at = np.concatenate([[0], np.cumsum(counts)])
        if len(word) >= WORDS:
            run = np.zeros(len(word) - WORDS + 1, np.uint64)
            for k in range(WORDS):
                run += word[k : len(run) + k] * _PLACE[k]
            inside = np.ones(len(word), bool)
            for k in range(1, WORDS):
                inside[np.maximum(begin[1:] - k, 0)[sizes >= WORDS]] = False
            short = np.repeat(sizes < WORDS, sizes)
            out[np.repeat(sizes >= WORDS, counts)] = _stir(run)[(inside & ~short)[: len(run)]]
        for d in np.flatnonzero((sizes > 0) & (sizes < WORDS)):
            w = word[begin[d] : begin[d + 1]]
            out[at[d]] = _stir(np.array([(w * _PLACE[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))[0]
        return out, at

    def signatures(self, texts: pa.Array) -> np.ndarray:
        """One row of minima for each text."""
        none = np.zeros((0, PERMUTATIONS), np.uint64)
        return np.concatenate([none, *[self._signatures(part) for part in slices(texts)]])

    def _signatures(self, texts: pa.Array) -> np.ndarray:
        hashes, at = self.hashes(texts)
        out = np.full((len(texts), PERMUTATIONS), NONE, np.uint64)
        full = np.flatnonzero(np.diff(at))
        for a in range(0, len(hashes), CHUNK):
            x = hashes[a : a + CHUNK]
            touched = full[np.searchsorted(at[full + 1], a, "right") : np.searchsorted(at[full], a + len(x))]
            starts = np.maximum(at[touched] - a, 0)
            value = np.empty_like(x)
            for k in range(PERMUTATIONS):
                np.multiply(x, _MULTIPLY[k], out=value)
                np.add(value, _ADD[k], out=value)
                out[touched, k] = np.minimum(out[touched, k], np.minimum.reduceat(value, starts))
        return out


def short_print(signatures: np.ndarray) -> np.ndarray:
    """8 bits of each minimum."""
    return (signatures >> np.uint64(48)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of short prints: equal shares less what chance makes."""
    same = (a == b).mean(axis=1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """The last quarter of the text's characters replaced by as many first ones of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints every text and its edited text, in one pass over ranges of doc_id.

    The ranges' bounds are doc_ids of the table, so the first document of a range is known by its
    id: it is sent to the range before as well, where it ends the order. The table's first document
    ends the last range. Texts are shuffled once.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = key_bounds(keyed, "doc_id", partitions(spark))
    ends = keyed.agg(F.min("doc_id").alias("least"), (F.count("*") > F.count("doc_id")).alias("nulls")).first()
    first = F.lit(None).cast("long") if ends["nulls"] else F.lit(ends["least"]).cast("long")
    part = range_bucket(F.col("doc_id"), bounds)
    bound = F.col("doc_id").isin(bounds) if len(bounds) < 50 else F.array_contains(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("doc_id"))
    places = F.array_compact(
        F.array(
            F.struct(part.alias("part"), F.lit(0).alias("extra")),
            F.when(bound, F.struct((part - 1).alias("part"), F.lit(1).alias("extra"))) if bounds else F.lit(None),
            F.when(F.col("doc_id").eqNullSafe(first), F.struct(F.lit(len(bounds)).alias("part"), F.lit(1).alias("extra"))),
        )
    )
    dealt = keyed.withColumn("place", F.explode(places)).select("place.part", "place.extra", "doc_id", "text")
    ordered = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        waiting: tuple | None = None
        for batch in batches:
            pairs = []
            for part, extra, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if waiting is not None:
                    pairs.append((waiting[1], waiting[2], text))
                waiting = None if extra else (part, doc, text)
            if pairs:
                yield judged(shingler, pairs)

    return ordered.mapInArrow(run, SCHEMA)


def judged(shingler: Shingler, pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Rows for documents given with their text and the next one's."""
    docs, texts, after = zip(*pairs, strict=True)
    changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
    chained = all(texts[i + 1] is after[i] for i in range(len(texts) - 1))
    own = short_print(shingler.signatures(pa.array([*texts, after[-1]], pa.large_string())))
    following = own[1:] if chained else short_print(shingler.signatures(pa.array(after, pa.large_string())))
    own = own[:-1]
    other = short_print(shingler.signatures(pa.array(changed, pa.large_string())))
    columns = [
        pa.array(docs, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array([row.tobytes().hex() for row in own]),
        pa.array([row.tobytes().hex() for row in other]),
        pa.array(likeness(own, other)),
        pa.array(likeness(own, following)),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])


def similar(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Near-duplicate classes: for each row doc_id, text_key, component and component_id (the least
    doc_id reachable), for texts whose shingle sets have a Jaccard similarity of `at_least` or more.

    Signature bands of `ROWS` minima are the buckets; a pair at similarity s is in none with a chance of
    (1 - s^ROWS)^BANDS, 5 in 100 million at 0.8. What meets is verified over whole sets."""
    from flowmill.llm import classes  # which takes this module's shingles

    keyed = classes.keyed_texts(docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            sets = classes.shingle_sets(texts)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(Shingler().signatures(texts)).ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), pa.array([classes.node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n", "bands"])

    rows = materialize(keyed.mapInArrow(read, "doc_id long, text_key long, node long, n int, bands array<long>"), "signatures")
    texts = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    entries = texts.select(F.explode("bands").alias("key"), "node", "n", F.lit(None).cast("int").alias("print"), F.lit(True).alias("held"))
    return classes.classes(keyed, rows, entries, at_least)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A hash of each band's number and minima."""
    out = np.zeros((len(signatures), BANDS), np.uint64)
    for r in range(ROWS):
        out = _stir(out * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r::ROWS][:, :BANDS] + np.arange(BANDS, dtype=np.uint64))
    return out
