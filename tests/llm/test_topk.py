import math
import random

import numpy as np
import pytest
from flowmill.llm import registry, topk
from pyspark.sql import functions as F


def brute(rows, every, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for query in sorted({i for i, _ in fine if i % every == 0}):
        v = min(v for i, v in fine if i == query)
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != query and len(w) == len(v))
        out += [(query, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in registry.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, registry.op8_exact_top_k(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rows, 50)


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:
        for name, value in (("CHUNK", 40), ("QUERIES_A_CHUNK", 3), ("TOGETHER", 2), ("SAMPLE", 60), ("PIVOTS", 5), ("LEAF", 4)):
            monkeypatch.setattr(topk, name, value)
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)] + [(1000, [0.5] * 6), (20, [0.1] * 6)]
    rows += [(2000, None), (2001, []), (2002, [None] * 6), (2020, [math.nan] * 6), (2040, [math.inf, *[0.0] * 5]), (None, [1.0] * 6), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3020, [5.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == brute(rows, 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "line", "sphere", "copies"])
def test_cover_tree(kind, monkeypatch):
    """Levels cover, separate and nest; the search finds what brute force finds, and leaves out what bounds allow."""
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(4)
    shape = {"clusters": lambda n: rng.normal(0, 3, (n, 6)) + 300 * rng.integers(-3, 4, (n, 1)), "line": lambda n: np.linspace(1, 9000, n)[:, None] * [1.0, 2.0], "sphere": lambda n: 256 * rng.normal(0, 1, (n, 64)), "copies": lambda n: np.tile([[5.0, 7.0]], (n, 1))}[kind]
    data = topk.CoverTree(np.arange(800), np.floor(shape(800)))
    a, b, centre, first, last = data.nodes.T
    assert sorted(data.ids.tolist()) == list(range(800)) and (a[0], b[0]) == (0, 800)
    for n in range(len(a)):
        if last[n]:
            kids = np.arange(first[n], last[n])
            assert centre[kids[0]] == centre[n]  # nesting
            assert a[kids].tolist() == [a[n], *b[kids[:-1]]] and b[kids[-1]] == b[n]
            apart = topk.distances(data.points[centre[kids[1:]]], data.points[centre[n]])
            reach = [r for r in data.radii if (apart > r).all()]
            assert reach and (apart <= topk.BASE * max(reach) + 1e-6).any()  # separation, and covering by the level above
        assert topk.distances(data.points[a[n] : b[n]], data.centre[n]).max() <= data.radius[n]
    queries = topk.CoverTree(np.arange(1000, 1060), np.floor(shape(60)))
    again = topk.CoverTree.unpack(data.pack())
    assert (again.points == data.points).all() and (again.nodes == data.nodes).all()
    scores = queries.points @ data.points.T
    want = [sorted(((s, -i) for s, i in zip(row.tolist(), data.ids.tolist(), strict=True)), reverse=True)[:5] for row in scores]
    found = topk.Search(queries, again, 5, np.full(60, -np.inf))
    assert found.found == want
    known = topk.Search(queries, data, 5, np.array([w[-1][0] for w in want]))
    assert known.found == want and known.scored <= known.pairs
    if kind in ("clusters", "line"):
        assert max(found.scored, known.scored) < 0.5 * known.pairs


def test_large_components_are_exact():
    a = np.array([[2.0**40, 3.0], [1.0, -1.0]])
    assert topk.dot(a, a).tolist() == [[2**63 - 1, 2**40 - 3], [2**40 - 3, 2]]
