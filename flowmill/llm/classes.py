"""Classes of near-duplicate texts from candidate buckets, by the true Jaccard similarity of shingle sets.

An operator says which texts may be alike by putting them into buckets: `entries` has key, node (a
hash of a text's set of five-word shingles), n (the set's size), print (any sketch, or null) and held.
Two nodes are candidates if they share a key, one of the two entries is held, the sizes allow the
similarity and `close` - a condition on the columns print and other_print - is true. Candidates are verified over
their whole sets, and linked if their similarity is `at_least` or more.

No bucket is expanded into all its pairs at once. First a bucket's members are held against the member
whose buckets are largest - the text that the others are copies of - then against eight members by hash, then
eight times as many, and so on; what is linked by
then meets no more among itself, and a bucket whose members are one class, or have all been heads, is
done. So a large group of near copies costs about its size, and no link between two classes is lost:
the rounds go on until every candidate pair is verified or has its two sides in one class.

Defined cases: texts without words have one empty set and are alike; a text of under five words is one
shingle; repeated rows and repeated or null doc_ids are rows of their own; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.components import components
from flowmill.llm.minhash import Shingler
from flowmill.llm.shared import materialize, slices, texts_of

AT_LEAST = 0.8
GROWTH = 8
_NEAR_ZERO = 1e-9


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    out = []
    for part in slices(texts):
        hashes, at = Shingler().hashes(part)
        out += [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def node_of(shingles: np.ndarray) -> int:
    """The name of a set of shingles, as a signed long."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sets(keyed: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles of the wanted nodes, read from one text of each."""
    at = rows.join(wanted, "node").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("at"))
    at = at.select("node", F.col("at.doc_id").alias("at_doc"), F.col("at.text_key").alias("at_key"))
    found = keyed.join(at, keyed["doc_id"].eqNullSafe(F.col("at_doc")) & (keyed["text_key"] == F.col("at_key"))).select("node", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(texts_of(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return found.mapInArrow(read, "node long, shingles array<long>")  # repeated rows repeat links, which does no harm


def _alike(pairs: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """The pairs u, v whose sets are alike."""
    first = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    other = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(first, "u").join(other, "v")
    same = F.size(F.array_intersect("a", "b"))
    return both.where(same >= (F.size("a") + F.size("b") - same) * F.lit(at_least) - _NEAR_ZERO).select("u", "v")


def _pairs(members: DataFrame, heads: DataFrame, at_least: float, close: Column) -> DataFrame:
    """Candidate pairs of members and heads of their buckets, of different classes."""
    other = heads.select("key", *[F.col(c).alias(f"other_{c}") for c in ("node", "n", "print", "held", "component")])
    n, m = F.col("n"), F.col("other_n")
    fitting = (n >= m * at_least - _NEAR_ZERO) & (m >= n * at_least - _NEAR_ZERO) & (F.col("held") | F.col("other_held"))
    met = members.join(other, "key").where((F.col("component") != F.col("other_component")) & fitting & close)
    return met.select(F.greatest("node", "other_node").alias("u"), F.least("node", "other_node").alias("v")).distinct()


def _bucketed(members: DataFrame) -> DataFrame:
    """`members` of the buckets that hold more than one class, with the bucket's `times`."""
    mixed = members.groupBy("key").agg(F.count("*").alias("times"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key", "times")
    return members.drop("times").join(mixed, "key")


def classes(keyed: DataFrame, rows: DataFrame, entries: DataFrame, at_least: float = AT_LEAST, close: Column | None = None) -> DataFrame:
    """For each of `rows` (doc_id, text_key, node) its component (the least node of its class) and
    component_id (the class's least doc_id). `keyed` has the texts, `entries` the buckets."""
    close = F.lit(True) if close is None else close
    members = _bucketed(entries.withColumn("component", F.col("node")))
    # what many are copies of is in most of their buckets
    weights = members.where("held").groupBy("node").agg(F.sum("times").alias("weight"))
    members = materialize(members.join(weights, "node", "left").fillna(0, ["weight"]), "members")
    # a bucket of few is held against all of itself at once; of larger ones all members may be asked for
    few = members.where(F.col("times") <= GROWTH)
    pairs = materialize(_pairs(few, few, at_least, close), "pairs")
    many = members.where(F.col("times") > GROWTH)
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(many.select("node")).distinct()
    sets = materialize(_sets(keyed, rows, wanted), "sets")
    links = materialize(_alike(pairs, sets, at_least), "alike")
    heads, left = 1, many
    while True:
        known = materialize(components(links), "known")
        left = left.drop("component").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        left = materialize(_bucketed(left), "left")
        if left.isEmpty():
            break
        if heads == 1:
            first = F.max_by(F.struct("node", "n", "print", "held", "component"), F.struct("weight", "node"))
            chosen = left.groupBy("key").agg(first.alias("first")).select("key", "first.*")
        else:
            chance = (F.xxhash64(F.lit(heads), "node") / F.lit(2.0**64) + 0.5) * F.col("times")
            chosen = left.where((chance < heads) | (F.col("times") <= heads))
        pairs = _pairs(left, chosen, at_least, close)
        links = links.union(materialize(_alike(pairs, sets, at_least), "alike"))
        left = left.where(F.col("times") > heads)
        heads *= GROWTH
    named = rows.select("doc_id", "text_key", "node").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "text_key", "component", "component_id")
