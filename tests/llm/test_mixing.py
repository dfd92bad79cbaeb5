import random
import re

import pytest
from flowmill.llm import mixing, registry

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.targets([1000, 10, 10], [1, 5, 5])
    assert got == [960.0, 30.0, 30.0]
    assert mixing.targets([0, 5], [5, 2]) == [0.0, 5.0] and mixing.targets([], []) == []
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randrange(0, 10 ** rng.randrange(1, 6)) for _ in range(rng.randrange(1, 30))]
        out = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert abs(sum(out) - sum(sizes)) < 1e-6 * (1 + sum(sizes))
        assert all(t <= 3 * n + 1e-9 for t, n in zip(out, sizes, strict=True))


def check(rows, docs, block):
    """rows: of `taken`. Sizes, targets and limits; each source's words come within one of its target."""
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    assert len(rows) == len(docs)
    assert sorted((r["doc_id"], r["size"], r["source"]) for r in rows) == sorted(((d, len(WORD.findall(t or "")), s) for d, t, s in docs), key=lambda r: r) if None not in sizes else True
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(abs(r["target"] - want[s]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


@pytest.mark.parametrize("block", [7, 1024])
def test_odd_rows(spark, block):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "é", "Z", None, "hot", "hot", "hot"])) for i in range(150)]
    docs += [(500, None, "a"), (501, "", "only empty"), (502, "x\x0by\xa0z ", "tiny"), (503, "v " * 20_000, "b"), (7, "same row", "b"), (7, "same row", "b"), (7, "same row", "b"), (7, "other text", "b")]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, source string, size int")
    mix = mixing.Mix(df, block=block)
    rows = mix.taken().collect()
    check(rows, docs, block)
    again = mixing.Mix(df.repartition(3), block=block).taken().collect()
    key = lambda rs: sorted((str(r["source"]), str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(rows) == key(again)
    out = mixing.mixed_documents(df, block=block)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
    want = {}
    for r in rows:
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    assert words == {s: n for s, n in want.items() if n}


def test_schedule_interleaves_sources(spark):
    docs = [(i, "w " * 100, "abc"[i % 3]) for i in range(300)]
    mix = mixing.Mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), block=25)
    slots = mix.schedule().orderBy("slot").collect()
    quota = {s[1]: -(-s[4] // 25) for s in mix.sources}
    total = sum(quota.values())
    assert len(slots) == total
    for n, k in quota.items():
        ranks = [r["rank"] for r in slots if r["n"] == n]
        assert sorted(ranks) == list(range(k))
        seen = 0
        for i, r in enumerate(slots[: total - 20]):
            seen += r["n"] == n
            assert abs(seen - (i + 1) * k / total) < 6
    segments = mix.segments().collect()
    filled = {}
    for r in segments:
        filled[r["slot"]] = filled.get(r["slot"], 0) + r["words"]
    assert all(v <= 25 for v in filled.values()) and sum(v == 25 for v in filled.values()) >= len(filled) - 3


def test_another_schedule_gives_other_slots(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * 40, "abc"[i % 3]) for i in range(120)], "doc_id long, text string, source string")
    slots = lambda: {r["doc_id"]: (r["first_slot"], r["last_slot"]) for r in mixing.Mix(docs, block=25).taken().collect()}
    first = slots()
    assert first == slots() and all((a is None) == (b is None) and (a is None or a <= b) for a, b in first.values())
    monkeypatch.setattr(mixing, "STEP", mixing.STEP // 3 | 1)
    assert first != slots()


def test_files_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 40, "abc"[i % 3], 1, 2) for i in range(120)], "doc_id long, text string, source string, `__s` int, `_0` int")
    first = {r["doc_id"]: [e["slot"] for e in r["epochs"] or []] for r in mixing.Mix(docs, block=25).taken().collect()}
    out = mixing.mixed_documents(docs, block=25)
    assert out.columns == docs.columns
    for part in out.rdd.glom().collect():
        left, last = {d: list(s) for d, s in first.items()}, -1
        for r in part:
            assert left[r["doc_id"]][0] >= last
            last = left[r["doc_id"]].pop(0)


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text", "source").collect()]
    source = {d: s for d, _, s in docs}
    rows = [r.asDict() | {"source": source[r["doc_id"]]} for r in registry.op6_mixing_sources(spark, sf_dir).collect()]
    check(rows, docs, mixing.BLOCK_WORDS)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    assert mixing.Mix(df).taken().count() == 0 and mixing.mixed_documents(df).count() == 0
