import zlib

import numpy as np
import pyarrow as pa
from flowmill.llm import quality, registry
from pyspark.sql import functions as F


def slow(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    lines = text.split("\n")
    n = len(text)
    return {
        "chars": np.log1p(n), "words": np.log1p(len(words)), "lines": np.log1p(text.count("\n")),
        "word_length": np.mean([len(w) for w in words]) if words else 0, "line_words": np.log1p(len(words) / len(lines)),
        "upper": sum("A" <= c <= "Z" for c in text) / n if n else 0, "wide": sum(ord(c) > 127 for c in text) / n if n else 0,
        "distinct_words": len(set(words)) / len(words) if words else 0, "top_word": max(map(words.count, words)) / len(words) if words else 0,
        "distinct_lines": len(set(lines)) / len(lines) if n else 0, "bars": text.count("|") / n if n else 0,
    }


def test_statistics():
    texts = ["", "a", "One two, two!\nOne two, two!\nTHREE | é 12", "x " * 3000, "\n\n", "日本 語"]
    got = quality.statistics(pa.array(texts, pa.large_string()))
    for row, text in zip(got, texts, strict=True):
        for name, value in slow(text).items():
            assert abs(row[quality.NAMES.index(name)] - value) < 1e-9, (text, name)
    assert not got[0].any() and quality.statistics(pa.array([], pa.large_string())).shape == (0, len(quality.NAMES))


def test_rules_and_lasso_find_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.NAMES)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.6)).astype(float)
    model = quality.Model.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    assert 0 < len(model.weighted) < 150


def test_few_labels():
    x = np.zeros((4, len(quality.NAMES)))
    assert quality.Model.fit(x[:0], np.zeros(0)).scores(x).tolist() == [0.5] * 4
    assert (quality.Model.fit(x, np.ones(4)).scores(x) > 0.99).all()
    assert np.allclose(quality.Model.fit(x, np.array([0.0, 1, 1, 1])).scores(x), 0.75)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.op3_quality_rules(spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in registry.table(spark, sf, "labels").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    tried = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(tried) > 50 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in tried]) >= 0.95


def test_column_is_the_model(spark):
    docs = registry.table(spark, "/root/testdata/sf0.001", "documents")
    measured = quality.with_statistics(docs.select("doc_id", "text"))
    model = quality.fit(measured, registry.table(spark, "/root/testdata/sf0.01", "labels"))
    rows = measured.select(*[quality.STATISTICS + n for n in quality.NAMES], model.column(quality.STATISTICS).alias("s")).collect()
    assert np.allclose(model.scores(np.array([r[:-1] for r in rows])), [r["s"] for r in rows])


def test_held_out_rows_teach_nothing(spark):
    docs = registry.table(spark, "/root/testdata/sf0.001", "documents")
    labels = registry.table(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(tuple, quality.score_documents(docs, x).collect())) for x in (labels, turned))
    assert one == two


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "some text", 1), (1, None, 1), (1, None, 1), (2, "", 1), (3, "long " * 40_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 5 and {r["score"] for r in rows} == {0.5} and [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "text of a row " * i, 1, 2, 3, 4) for i in range(8)], "doc_id long, text string, q0_chars int, y int, labelled int, `a.b` int")
    labels = spark.createDataFrame([(i, i % 2, 9, 9) for i in range(8)], "doc_id long, quality int, text int, q_chars int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and set(kept.collect()) <= set(docs.collect())
    assert quality.score_documents(docs, labels).count() == 8
