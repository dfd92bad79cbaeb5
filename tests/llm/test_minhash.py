import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from flowmill.llm import minhash, registry


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query(spark, sf_dir):
    rows = sorted(registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in registry.op9_minhash_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    prints, off = {}, []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 4
        changed, r = text[: len(text) - n] + after[:n], got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        off += [r["near_edited"] - jaccard(text, changed), r["near_next"] - jaccard(text, after)]
    assert abs(np.mean(off)) < 0.01 and np.max(np.abs(off)) < 0.2


@pytest.mark.parametrize("parts", [1, 3])
def test_odd_rows(spark, parts):
    texts = [None, "", " \n", "one", "one two three four five six seven", "ä" * 9, "w " * 40_000, "one two three four five six seven"]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = minhash.fingerprint_edits(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    line = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [(d, len(t), hashlib.sha256(minhash.edited(t, a).encode()).hexdigest()) for (d, t), (_, a) in zip(line, line[1:] + line[:1], strict=True)]
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["fingerprint"] == by[6]["fingerprint"] and by[12]["fingerprint"] == by[21]["fingerprint"]
    assert minhash.fingerprint_edits(docs.limit(0)).collect() == []


def test_signatures_do_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 40, 900]))) for _ in range(150)]
    texts += ["  ".join(["q"] * 40_000)]
    s = minhash.Shingler()
    together = s.signatures(pa.array(texts, pa.large_string()))
    alone = np.concatenate([s.signatures(pa.array([t], pa.large_string())) for t in texts])
    assert (together == alone).all()
    for t in texts[:40]:
        hashes, _ = s.hashes(pa.array([t], pa.large_string()))
        assert len(set(hashes.tolist())) == len(shingles(t))


def test_similar(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(120)] for _ in range(12)]
    texts = [" ".join(b) for b in base] * 2 + [" ".join([*b[:60], word(), *b[61:]]) for b in base] + [" ".join(b[:60] + [word() for _ in range(60)]) for b in base] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.similar(docs).collect()}
    want = {i: i % 12 for i in range(36)} | {i: i for i in range(36, 48)} | {48: 48, 49: 48}
    assert got == want
    assert minhash.similar(docs.limit(0)).count() == 0


def test_similar_chains_and_stars(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(100)]
        one, two = list(base), list(base)
        one[30], two[70] = word(), word()
        one[50], two[90] = word(), word()
        texts += [" ".join(x) for x in (one, base, two)]  # the outer ones are not alike
    assert all(jaccard(a, b) >= 0.8 > jaccard(a, c) for a, b, c in zip(texts[::3], texts[1::3], texts[2::3], strict=True))
    got = {r["doc_id"]: r["component_id"] for r in minhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i // 3 * 3 for i in range(120)}
