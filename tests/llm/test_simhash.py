import random
import re

import pytest
import xxhash
from flowmill.llm import registry, simhash
from flowmill.llm.components import components
from pyspark.sql import functions as F

SPACE = "[^\x20\x09-\x0d]+"


def slow_fingerprint(text):
    words = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_query_against_brute_force(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs}
    ids = sorted(fps)
    want = groups([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], ids)
    got = registry.op10_simhash_near_duplicates(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    assert len(got) == len(ids)


@pytest.mark.parametrize("crowd", [0, 3, 10**6])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1, 1 << 63]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(25)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    assert all(near(r["u"], r["v"]) for r in found)
    assert groups([(r["u"], r["v"]) for r in found], signed) == groups([(a, b) for a in signed for b in signed if a < b and near(a, b)], signed)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 1000 + i) for i in range(50)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(1, 1), (None, 4), (3, 2), (2, 3)]
    got = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    want = groups(real, sorted({x for p in real for x in p}))
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "One two", "d"), (5, "one TWO", "e"), (6, "x " * 30_000, "f"), (6, "other words here", "g"), (None, "one two", "h"), (None, "alone in the world", "i"), (7, "alone in the world too", "j"), (7, "alone in the world too", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(i, 0, 1) for i in (1, 2, 3)} <= got
    assert {r[2] for r in got if r[0] in (4, 5)} == {4} and {r[2] for r in got if r[0] is None} == {4, None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["fp"] for r in kept.collect()) == ["a", "d", "f", "g", "i", "j"]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def most_broadcast(plan):
    """Rows of the largest broadcast in a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_broadcast(plan.executedPlan())
    inner = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if kind == "BroadcastExchangeExec" else 0
    return max([own, *map(most_broadcast, inner)])


def test_copies_are_not_gathered_on_the_driver(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a text like number "), F.md5((F.col("id") % 50).cast("string"))).alias("text"))
    found = simhash.near_duplicates(docs)
    assert len(found.collect()) == 100_000
    assert most_broadcast(found._jdf.queryExecution().executedPlan()) <= 50


@pytest.mark.parametrize("crowd", [0, 10**6])
def test_links_broadcast_no_fingerprints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    found = simhash.links(spark.createDataFrame([(i << 40 | i * 7,) for i in range(300)], "fp long"))
    found.collect()
    assert most_broadcast(found._jdf.queryExecution().executedPlan()) < (300 if crowd else 1200)


def test_lookups_of_crowds_are_on_the_side_that_is_never_broadcast(spark, monkeypatch):
    plans, real = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().sparkPlan().toString()}) or real(df, name))
    simhash.links(spark.createDataFrame([(i << 40 | i * 7,) for i in range(300)], "fp long"))
    assert "LeftSemi" in plans["centres"] and "Inner" not in plans["centres"]


def test_fingerprint_is_as_defined():
    for text in ["", "a", "A b", "É è Ü", "a\x0bb\x0cc d", "a\x85b c d e", "x y z " * 50]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_hexadecimal(spark):
    df = spark.createDataFrame([(0,), (-1,), (255,)], "fp long")
    assert [r[0] for r in df.select(simhash.hexadecimal(F.col("fp"))).collect()] == ["0" * 16, "f" * 16, "0" * 14 + "ff"]
