import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from flowmill.llm import minhash, shared, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, at_least=0.8):
    """component_id by doc_id, over all pairs."""
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] | sets[b])
            if a < b and (not both or len(sets[a] & sets[b]) / both >= at_least):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def texts(seed):
    """Chains and stars of edits, short texts, copies and a phrase that many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    phrase, out = [word() for _ in range(8)], []

    def edit(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = word()
        return words

    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 12, 60, 120, 200]))] + phrase * rng.randrange(2)
        chain = [base]
        for _ in range(4):
            chain.append(edit(chain[-1], rng.randrange(1, max(2, len(base) // 40 + 1))))
        out += chain + [edit(base, max(1, len(base) // 45)) for _ in range(3)]
    return [" ".join(w) for w in out] + ["", None, " ", "one two", "One TWO", "one"]


def classed(found):
    return {r["doc_id"]: r["component_id"] for r in found.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_bands_find_all_that_brute_force_finds(spark, seed):
    rows = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(rows)
    want = brute(rows)
    assert classed(minhash.similar(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert len(set(want.values())) < len(rows) - 40


@pytest.mark.parametrize("seed", [3, 4])
def test_fingerprints_of_words_find_nearly_all(spark, seed):
    rows = list(enumerate(texts(seed)))
    got, want = classed(simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string"))), brute(rows)
    joined = [d for d in want if want[d] != d]
    assert sum(got[d] == want[d] for d in joined) >= 0.9 * len(joined)
    assert all(want[d] == want[got[d]] for d in got)  # and nothing else


def test_large_group_is_not_expanded(spark):
    """A star of near copies, of which few are alike among themselves, and a phrase that all share."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]

    def copy():
        words = list(base)
        for place in rng.sample(range(0, 150, 6), 3):
            words[place] = word()
        return " ".join(words)

    rows = [(i, copy()) for i in range(1, 120)] + [(500, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert classed(minhash.similar(docs)) == brute(rows)
    assert classed(simhash.near_texts(docs)) == brute(rows)


def test_word_codes():
    words = ["", "a", "b", "aa", "a\0", "ab", "ba", "a" * 5000, "a" * 4999, "é", ""]
    codes, sizes = shared.word_codes(pa.array(words, pa.large_string()).slice(1))
    assert sizes.tolist() == [len(w.encode()) for w in words[1:]] and len(set(codes.tolist())) == 10
    assert codes[0] == shared.word_codes(pa.array(["a"]))[0][0]
    assert len(np.unique(shared.word_codes(pa.array([f"{i:x}" for i in range(200_000)]))[0])) == 200_000


def test_word_prints():
    lines = pa.array(["", " ", "a b c a", "c b A", "x " * 70_000, "y" * 300_000, " ".join(map(str, range(70_000)))], pa.large_string())
    got = simhash.word_prints(lines)
    assert got.shape == (7, simhash.SEGMENTS) and not got[:2].any() and (got[2] == got[3]).all() and got.max() < 1 << simhash.WIDTH
    for row, words in zip(got[2:], [["a", "b", "c"], ["a", "b", "c"], ["x"], ["y" * 300_000], list(map(str, range(70_000)))], strict=True):
        votes = np.zeros(256, int)
        for code in shared.word_codes(pa.array(words, pa.large_string()))[0]:
            raw = np.array([shared.stir(code * np.uint64(2 * k + 1) + np.uint64(k)) for k in range(1, 5)])
            votes += np.unpackbits(raw.view(np.uint8), bitorder="little")
        bits = np.packbits(votes * 2 > len(words), bitorder="little").view("<u4")
        assert (row == bits & ((1 << simhash.WIDTH) - 1)).all()


def test_pipeline_stage_leaves_one_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    other = list(base)
    other[40], other[90] = "changed", "too"  # Jaccard 106 / 126
    docs = spark.createDataFrame([(1, " ".join(base), "en"), (2, " ".join(other), "en"), (3, "quite another text", "en"), (None, " ".join(other), "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), "").count() == 0
