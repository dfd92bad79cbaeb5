"""Mixes sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a shuffled order (by a seeded hash) and repeated end to end; the
words are cut into blocks of one size. Slot t of the schedule has the golden-ratio point frac(t / phi);
the source whose span of cumulated target shares holds it owns the slot, so every stretch of the
schedule has each source's share to within a few slots. A slot's rank among its source's slots names
the block that fills it. A source is done when its blocks cover its target; what a source still
lacks after the schedule's length (a few slots at most) is appended.

Targets share out all words by weight. No source goes beyond `most` times its own size; the excess is
shared out again by weight among the others.

The driver sees one row for each source - so much is taken to be bounded: sources are few beside
documents - and nothing else. Running sums are taken within (source, range of the hash) and joined
with what the ranges before hold, so a source with a third of all rows is no task's burden alone.

Defined cases: very long texts are counted whole, and cut where a target ends in them; of equal hashes
the lesser doc_id comes first; a null text has size 0, and a document of size 0 is never taken; null is a source of
its own, last in order; repeated rows are rows of their own; an empty table gives no rows; the
columns needed are doc_id, text and source, and others are ignored.
"""

from __future__ import annotations

import itertools
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from flowmill.llm.shared import materialize, unused

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 1024
#: Ranges of the hash a source at least, and the rows of one if it had all.
RANGES, ROWS_A_RANGE = 256, 200_000
CHUNK = 4096
#: The golden ratio as an odd fraction of the period: whole-number arithmetic, exact for any number of slots.
PERIOD = 1 << 31
STEP = round((math.sqrt(5) - 1) / 2 * PERIOD) | 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight, each at most `most` times its size."""
    out, open_ = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0 and sizes[i] > 0]
    left = float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and a seeded hash of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD.pattern)).cast("long").alias("size"),
        F.xxhash64(F.lit(17), F.col("doc_id").cast("long"), text).alias("hash"),
    )


class Mix:
    """A mix of documents. `documents` has doc_id, hash, size, source, source_size, target, quota (words
    the source gives), n (the source's number) and place (its words before the document)."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK_WORDS):
        self.spark, self.block, self.most = docs.sparkSession, block, most
        rows = materialize(sized(docs), "sized")
        ranges = max(RANGES, rows.count() // ROWS_A_RANGE)
        spots = rows.withColumn("range", F.expr(f"cast(floor((hash / 9223372036854775808D + 1) * {ranges / 2}D) as int)"))
        by_range = materialize(spots.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
        totals = by_range.groupBy("source").agg(F.sum("words").alias("words")).collect()
        totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["words"] for r in totals]
        wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
        self.sources = [(r["source"], i, n, t, min(most * n, math.floor(t + 0.5))) for i, (r, n, t) in enumerate(zip(totals, sizes, wanted, strict=True))]
        about = self.spark.createDataFrame(self.sources, "source string, n int, source_size long, target double, quota long")
        earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        base = by_range.select("source", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
        base = base.alias("b").join(F.broadcast(about).alias("a"), F.col("b.source").eqNullSafe(F.col("a.source"))).select("a.*", "range", "base")
        inside = Window.partitionBy("source", "range").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        local = spots.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        same = F.col("l.source").eqNullSafe(F.col("b.source")) & (F.col("l.range") == F.col("b.range"))
        placed = local.alias("l").join(base.alias("b"), same)
        self.documents = materialize(placed.select("l.doc_id", "l.hash", "l.size", "l.source", "b.source_size", "b.target", "b.quota", "b.n", (F.col("base") + F.col("local")).alias("place")), "placed")

    def schedule(self) -> DataFrame:
        """slot, n, rank: which source's block of which rank fills each slot."""
        spark, total = self.spark, sum(s[4] for s in self.sources)
        need = [-(-s[4] // self.block) for s in self.sources]
        slots = sum(need)
        edges, at = [], 0.0
        for s in self.sources:
            at += s[4] / max(total, 1)
            edges.append(at)
        point = F.expr(f"(id % {PERIOD}L) * {STEP}L % {PERIOD}L / {PERIOD}D")
        owner = F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda n, e: n + F.when(F.col("point") >= e, 1).otherwise(0)) if edges else F.lit(0)
        drawn = spark.range(slots).withColumn("point", point).select("id", F.least(owner, F.lit(max(len(need) - 1, 0))).alias("n"))
        drawn = drawn.withColumn("chunk", F.expr(f"id div {CHUNK}"))
        counts = materialize(drawn.groupBy("n", "chunk").agg(F.count("*").alias("k")), "chunks")
        earlier = Window.partitionBy("n").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.select("n", "chunk", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("base"))
        local = drawn.withColumn("local", F.row_number().over(Window.partitionBy("n", "chunk").orderBy("id")) - 1)
        ranked = local.join(base, ["n", "chunk"]).select(F.col("id").alias("slot"), "n", (F.col("base") + F.col("local")).alias("rank"))
        got = {r["n"]: r["k"] for r in counts.groupBy("n").agg(F.sum("k").alias("k")).collect()}
        limits = spark.createDataFrame([(i, n, got.get(i, 0)) for i, n in enumerate(need)], "n int, need long, got long")
        ranked = ranked.join(F.broadcast(limits), "n").where("rank < need").select("slot", "n", "rank")
        lacking = limits.where("got < need").select("n", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
        return ranked.unionByName(lacking.select((F.lit(slots) + F.col("rank")).alias("slot"), "n", "rank"))

    def segments(self) -> DataFrame:
        """slot, n, place, epoch, from, words: the words of each document that each slot takes."""
        d = self.documents.where("size > 0").select("n", "place", "size", "source_size", "quota")
        turns = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(self.most - 1)))).withColumn("begin", F.expr("epoch * source_size + place"))
        turns = turns.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota"))).where("begin < end")
        cut = turns.withColumn("rank", F.explode(F.expr(f"sequence(begin div {self.block}, (end - 1) div {self.block})")))
        lo, hi = F.greatest("begin", F.col("rank") * self.block), F.least("end", (F.col("rank") + 1) * self.block)
        parts = cut.select("n", "rank", "place", "epoch", (lo - F.col("begin")).alias("from"), (hi - lo).alias("words"))
        return parts.join(self.schedule(), ["n", "rank"]).select("slot", "n", "place", "epoch", "from", "words")

    def taken(self) -> DataFrame:
        """`documents` with `epochs` (the words taken of it in each round of its source, and the first slot that takes
        them), `taken`, and the schedule's `first_slot` and `last_slot` for it (null where nothing is taken)."""
        rounds = self.segments().groupBy("n", "place", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"), F.max("slot").alias("last"))
        epochs = F.array_sort(F.collect_list(F.struct("epoch", "words", "slot"))).alias("epochs")
        used = rounds.groupBy("n", "place").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("last").alias("last_slot"), epochs)
        both = self.documents.alias("d").join(used.alias("u"), (F.col("d.n") == F.col("u.n")) & (F.col("d.place") == F.col("u.place")) & (F.col("d.size") > 0), "left")
        return both.select("d.*", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot", "epochs")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each round in which a document is taken, all columns kept. The
    one document of a source at which its target ends is cut after the words taken. The rows of every
    partition, and so of every file written from it, are in the order of the schedule's slots."""
    taken = Mix(docs, **options).taken()
    key, doc, source, hashed, size, turns, turn = unused(docs, 7)
    # identical rows share their key here; the epochs of all are dealt out to one and dropped from the others
    chosen = taken.where("taken > 0").select("doc_id", "hash", "source", "size", F.explode("epochs").alias("e")).groupBy("doc_id", "hash", "source")
    chosen = chosen.agg(F.max("size").alias(size), F.collect_list(F.struct("e.slot", "e.words")).alias(turns))
    chosen = chosen.withColumnsRenamed({"doc_id": doc, "hash": hashed, "source": source})
    one = docs.withColumn(key, F.xxhash64(F.lit(17), F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    repeated = one.groupBy(key, "doc_id", "source").count().where("count > 1")
    if not repeated.isEmpty():
        one = one.dropDuplicates([key, "doc_id", "source"])
    same = F.col(key).eqNullSafe(F.col(hashed)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & one["source"].cast("string").eqNullSafe(F.col(source))
    out = one.join(chosen, same).withColumn(turn, F.explode(turns)).sortWithinPartitions(f"{turn}.slot", hashed)
    words, cut = F.col(f"{turn}.words"), F.col(f"{turn}.words") < F.col(size)
    text = F.when(cut, first_words(F.when(cut, F.col("text")), words)).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


@F.pandas_udf(StringType())
def first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """Texts up to the end of their so-manieth word."""

    def cut(text: str, n: int) -> str:
        ends = [m.end() for m in itertools.islice(WORD.finditer(text), int(n))]
        return text[: ends[-1]] if ends else ""

    # no text where nothing is cut
    return pd.Series([t and cut(t, n) for t, n in zip(texts, counts, strict=True)], dtype=object)
