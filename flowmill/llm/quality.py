"""Text quality by a sparse ensemble of rules.

Statistics of whole texts are taken in numpy. Small boosted trees are grown on a bounded sample of
labelled rows (`MOST_ROWS`, those of least hash), every path from a root is read as a conjunctive rule over
the statistics, and a logistic model with an L1 penalty weighs the rules, most of them at zero. What
is left is compiled into Spark column expressions, so scoring is a sum of CASE WHENs.

Held-out rows - crc32 of the doc_id as text divisible by 5 - are never learnt from, and labels, lang,
source and doc_id are never inputs of a score.

Defined cases: very long texts are read whole; a null text is empty, and has all statistics zero; a null doc_id counts as the empty
text, so it is held out; labels other than 0 and 1 are ignored; without labels of both kinds every
score is the share of ones, or 0.5 with no labels at all; repeated rows are rows of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flowmill.llm.shared import batch_words, materialize, slices, texts_of

THRESHOLD = 0.3
MOST_ROWS = 20_000
TREES, DEPTH, BINS, LEAST = 60, 3, 32, 20
PENALTY = 2e-3

UPPER, LOWER, DIGIT, SPACE, LINE, STOP, BANG, BAR, ODD, QUOTE, LEAD, TRAIL = range(12)
_CLASS = np.full(256, ODD)
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = UPPER
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = LOWER
_CLASS[[ord(c) for c in "0123456789"]] = DIGIT
_CLASS[[9, 11, 12, 13, 32]] = SPACE
_CLASS[10] = LINE
_CLASS[[ord(c) for c in ".,;:"]] = STOP
_CLASS[[ord(c) for c in "!?"]] = BANG
_CLASS[ord("|")] = BAR
_CLASS[[ord(c) for c in "'\"()-"]] = QUOTE
_CLASS[128:192] = TRAIL
_CLASS[192:] = LEAD

NAMES = ["chars", "words", "lines", "word_length", "line_words", "upper", "digits", "stops", "bangs", "bars", "odd", "quotes", "wide", "distinct_words", "top_word", "distinct_lines", "long_words", "spaces"]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text, in the order of NAMES."""
    return np.concatenate([np.zeros((0, len(NAMES))), *[_statistics(part) for part in slices(texts)]])


def _statistics(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    sizes = np.asarray(pc.binary_length(texts), np.int64)
    raw = np.frombuffer(b"".join(x.as_buffer() if (x := t) is not None else b"" for t in texts), np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    counts = np.bincount(doc * 12 + _CLASS[raw], minlength=n * 12).reshape(n, 12).astype(np.float64)
    chars = sizes - counts[:, TRAIL]
    begin, index, found = batch_words(texts)
    lengths = np.asarray(pc.utf8_length(found), np.int64) if len(found) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), np.diff(begin))
    real = lengths[index] > 0 if len(index) else np.zeros(0, bool)
    owner, index = owner[real], index[real]
    words = np.bincount(owner, minlength=n).astype(np.float64)
    key, times = np.unique(owner * max(len(found), 1) + index, return_counts=True)
    of = key // max(len(found), 1)
    top = np.zeros(n)
    np.maximum.at(top, of, times)
    split = pc.split_pattern(texts, "\n")
    lines = np.asarray(split.offsets, np.int64)
    line_owner = np.repeat(np.arange(n), np.diff(lines))
    coded = split.flatten().dictionary_encode()
    line_key = np.unique(line_owner * max(len(coded.dictionary), 1) + np.asarray(coded.indices, np.int64))
    distinct_lines = np.bincount(line_key // max(len(coded.dictionary), 1), minlength=n)
    line_count = np.diff(lines).astype(np.float64)
    long_words = np.bincount(owner, weights=(lengths[index] > 14).astype(float), minlength=n)
    letters = np.bincount(owner, weights=lengths[index].astype(float), minlength=n)
    per = lambda x, whole: np.divide(x, whole, out=np.zeros(n), where=whole > 0)
    share = lambda k: per(counts[:, k], chars.astype(float))
    columns = [
        np.log1p(chars), np.log1p(words), np.log1p(counts[:, LINE]), per(letters, words), np.log1p(per(words, line_count)),
        share(UPPER), share(DIGIT), share(STOP), share(BANG), share(BAR), share(ODD), share(QUOTE), share(LEAD),
        per(np.bincount(of, minlength=n).astype(float), words), per(top, words), per(distinct_lines.astype(float), line_count) * (chars > 0),
        per(long_words, words), share(SPACE),
    ]
    return np.stack(columns, axis=1)


Test = tuple[int, bool, float]
Rule = tuple[Test, ...]


def grow(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules of boosted trees: for each node but the roots, the tests on the path to it.

    A test is (statistic, whether it is to be above, value)."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin, rules = np.full(len(y), np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))), {}
    rng = np.random.default_rng(5)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-6
        drawn = rng.random(len(y)) < 0.5
        allowed = rng.permutation(x.shape[1])[: max(1, x.shape[1] * 2 // 3)]
        todo: list[tuple[Rule, np.ndarray]] = [((), np.ones(len(y), bool))]
        step = np.zeros(len(y))
        while todo:
            path, here = todo.pop()
            rows = np.flatnonzero(here & drawn)
            best = (1e-3, None, None)
            if len(path) < DEPTH and len(rows) >= 2 * LEAST:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f in allowed:
                    if not len(edges[f]):
                        continue
                    cg = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
                    ch = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
                    cn = np.cumsum(np.bincount(binned[rows, f], minlength=len(edges[f]) + 1))[:-1]
                    gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                    gain[(cn < LEAST) | (len(rows) - cn < LEAST)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), int(f), k)
            if best[1] is None:
                step[here] = g[here & drawn].sum() / (h[here & drawn].sum() + 1)
                continue
            _, f, k = best
            value = float(edges[f][k])
            for above in (False, True):
                rule = (*path, (f, above, value))
                rules[tuple(sorted(rule))] = None
                todo.append((rule, here & ((x[:, f] > value) == above)))
        margin += 0.3 * step
    return list(rules)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for f, above, value in rule:
            out[:, j] *= (x[:, f] > value) == above
    return out


def lasso(a: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient; the intercept is free."""
    mean = a.mean(axis=0)
    a = a - mean
    scale = np.maximum(a.std(axis=0), 0.05)
    a = a / scale
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 * len(y) / (float(np.linalg.norm(a @ v) ** 2) + len(y) + 1e-9)
    w, last, b, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))), 1.0
    z, c = w.copy(), b
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(a @ z.astype(np.float32) + c))) - y
        last, last_b = w, b
        w = z - rate * (a.T @ error.astype(np.float32)) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        b = c - rate * error.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, c = w + (before - 1) / t * (w - last), b + (before - 1) / t * (b - last_b)
    w = w / scale
    return float(b - w @ mean), w


class Model:
    """Weighted rules, and a score from statistics either in numpy or as a Spark column."""

    def __init__(self, intercept: float, weighted: list[tuple[Rule, float]]):
        self.intercept, self.weighted = intercept, weighted

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Model:
        if len(y) == 0 or len(np.unique(y)) < 2:
            p = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 0.5
            return cls(float(np.log(p / (1 - p))), [])
        rules = grow(x, y)
        if not rules:
            return cls(float(np.log(y.mean() / (1 - y.mean()))), [])
        intercept, weights = lasso(holds(rules, x), y)
        return cls(intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w])

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = self.intercept + holds([r for r, _ in self.weighted], x) @ np.array([w for _, w in self.weighted])
        return 1 / (1 + np.exp(-margin))

    def column(self, prefix: str = "") -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in self.weighted:
            fits = F.lit(True)
            for f, above, value in rule:
                stat = F.col(prefix + NAMES[f])
                fits = fits & ((stat > value) if above else (stat <= value))
            margin = margin + F.when(fits, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


#: The beginning of the statistics' names.
STATISTICS = "q_"


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with a column for each statistic of the column `text` behind its own."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(texts_of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in stats.T]], [*batch.schema.names, *[STATISTICS + n for n in NAMES]])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(STATISTICS + n, DoubleType()) for n in NAMES]]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows that are not held out. `measured` has doc_id and the statistics."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("double").alias("y"))
    sample = measured.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("labelled"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", *[STATISTICS + n for n in NAMES], "y").limit(MOST_ROWS)
    rows = sample.select("y", *[STATISTICS + n for n in NAMES]).toArrow()
    columns = [np.asarray(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c, np.float64) for c in rows.columns]
    return Model.fit(np.stack(columns[1:], axis=1), columns[0])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    measured = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    measured = materialize(measured, "statistics")
    scored = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), fit(measured, labels).column(STATISTICS).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, all columns kept. Statistics are taken of labelled
    documents to learn, then of all; nothing is shuffled but labelled documents."""
    ids = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id"))).join(ids, "doc_id", "left_semi")
    model = fit(materialize(with_statistics(read).drop("text"), "statistics"), labels)
    # columns go by their place, so that no name can clash
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = with_statistics(docs.toDF(*names), names[docs.columns.index("text")]).where(model.column(STATISTICS) >= THRESHOLD)
    return kept.select(*names).toDF(*docs.columns)
