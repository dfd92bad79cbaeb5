import random

import pyarrow as pa
import pytest
from flowmill.llm import line_dedup, registry
from hypothesis import given, settings
from hypothesis import strategies as st


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def split(line):
    return [w for w in line.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]


def brute(docs):
    """Numbers of removed lines by (doc_id, text), for rows whose doc_ids differ."""
    lines = [(d is None, d or 0, i, split(x), (d, t)) for d, t in docs for i, x in enumerate((t or "").split("\n"))]
    lines = sorted((x for x in lines if x[3]), key=lambda x: x[:3])
    out = {}
    for k, (_, _, i, words, doc) in enumerate(lines):
        for _, _, _, other, _ in lines[:k]:
            near = min(len(words), len(other)) >= line_dedup.NEAR_WORDS and abs(len(words) - len(other)) <= 1
            if words == other or near and line_dedup.within_one(words, other):
                out.setdefault(doc, []).append(i)
                break
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=7), st.lists(st.sampled_from("ab"), max_size=7))
def test_within_one(a, b):
    assert line_dedup.within_one(a, b) == (distance(a, b) <= 1)


def test_keys_meet_for_near_lines():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(10, 20))]
        b, p = list(a), rng.randrange(len(a))
        kind = rng.randrange(3)
        b[p : p + (kind != 1)] = [rng.choice("xyz")] * (kind != 2)
        words, begin = line_dedup.word_hashes(pa.array([" ".join(a), " ".join(b)], pa.large_string()))
        _, keys = line_dedup.line_keys(words, begin)
        assert set(keys[:, 0].tolist()) & set(keys[:, 1].tolist()), (a, b)
        found, ends = line_dedup.variants(words, begin)
        va, vb = (found[ends[i] : ends[i + 1]].tolist() for i in (0, 1))
        assert va[p] == vb[p] if kind == 0 else va[-1] in vb[:-1] if kind == 1 else vb[-1] in va[:-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") * rng.randrange(1, 3) for _ in range(rng.choice([1, 4, 5, 9, 10, 11, 14, 30]))] for _ in range(14)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(words) + 1)
            words[p : p + rng.randrange(2)] = [rng.choice("qrs")] * rng.randrange(2)
        return rng.choice([" ", "  ", "\t"]).join(words)

    docs = [(None if i == 3 else i * 7 % 60, "\n".join(line() for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "w " * 300 + "\n" + "w " * 301)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, line int")
    rows = line_dedup.dedup_lines(df).collect()
    want = brute(docs)
    assert len(rows) == len(docs) and len(want) > 20
    for r in rows:
        text = next(t for d, t in docs if d == r["doc_id"])
        gone = want.get((r["doc_id"], text), [])
        assert r["removed_lines"] == gone, (r["doc_id"], text)
        assert r["text"] == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))


def test_repeated_rows_and_pipeline_form(spark):
    long_line = " ".join(f"word{i}" for i in range(60))
    docs = [(1, f"own line of this text one\n{long_line}", 9), (2, long_line, 9), (2, long_line, 9), (3, f"{long_line}\nanother line of five words", 9), (4, "", 0), (5, "five words are in this\nfive words are in this", 9), (6, "first of all this one", 1), (6, "first of all this one", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    kept = line_dedup.keep_first_lines(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(1, docs[0][1], 9), (3, "another line of five words", 26), (4, "", 0), (5, "five words are in this", 22), (6, "first of all this one", 1), (6, "first of all this one", 1)]
    assert line_dedup.keep_first_lines(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    """All lines of the query's own table by brute force."""
    docs = [tuple(r) for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows, want, texts = registry.op2_line_dedup(spark, sf_dir).collect(), brute(docs), dict(docs)
    assert len(rows) == len(docs) and len(want) > 20
    for r in rows:
        gone = want.get((r["doc_id"], texts[r["doc_id"]]), [])
        assert r["removed_lines"] == gone and r["n_removed"] == len(gone)
        assert r["text"] == "\n".join(x for i, x in enumerate(texts[r["doc_id"]].split("\n")) if i not in gone)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "Same\nline", 5, 6, 7, 8, 9), (2, "Same\nother", 5, 6, 7, 8, 9)], "doc_id long, text string, removed_lines int, `_0` int, `_1` int, `__doc` int, `a.b` int")
    kept = line_dedup.keep_first_lines(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(1, "Same\nline", 5, 6, 7, 8, 9), (2, "other", 5, 6, 7, 8, 9)]
    assert sorted(r["removed_lines"] for r in line_dedup.dedup_lines(df).collect()) == [[], [0]]


def test_least_words_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "a b c d e f g"), (4, "a b c d e f x")], "doc_id long, text string")
    removed = lambda n: [r["removed_lines"] for r in sorted(line_dedup.dedup_lines(df, n).collect())]
    assert removed(2) == [[], [0], [], [0]] and removed(5) == [[], [], [], [0]] and removed(8) == [[], [], [], []]


def test_short_lines(spark):
    nine = "one two three four five six seven eight nine"
    docs = [(1, f"Word\n \na b c d\n{nine}\nk l m n o"), (2, f"Word\n \n a  b c d\nword\n{nine} ten\nk l m n x\nk l m n\na b c x"), (3, "Word")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: [], 2: [0, 2, 4, 5], 3: [0]}
