import zlib

import numpy as np
import pytest
from flowmill.llm import packing
from flowmill.llm.registry import WORD_BPE, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st


def check(rows, capacity):
    """Pieces lie in their sequences without gaps or overlaps; gives the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            fit = capacity
        else:
            rooms.remove(fit)
        rooms.append(fit - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = dict(zip(*[x.tolist() for x in np.unique(np.array(lengths, int), return_counts=True)], strict=True))
    plan, bins = packing.plan_best_fit(counts, capacity)
    rows = [{"length": n, "sequence_id": first + i // per, "offset": at + i % per * n} for n, a, b, first, per, at in plan for i in range(b - a)]
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    assert check(rows, capacity) == bins == best_fit(lengths, capacity)


def test_documents(spark):
    texts = ["", None, "one two three", "hello " * 5000, "x " * 4095, "same text", "same text", "y " * 4096]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(5, "same text", 2), (None, "no id", 0)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs, vocabulary(WORD_BPE)).collect()
    check(rows, 4096)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(WORD_BPE))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for i, x in [*enumerate(texts), (5, "same text"), (-1, "no id")]:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, k * 4096, len(part), zlib.crc32(part.tobytes())) for k, part in enumerate(np.split(ids, range(4096, len(ids), 4096)))]
    assert got == sorted(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, vocabulary(WORD_BPE)).collect() == []


@pytest.mark.parametrize("lengths", [[4096] * 3, [2049] * 4, [1] * 5000])
def test_bound(spark, lengths):
    cut = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").selectExpr("doc_id", "0 piece", "0L start", "length", "doc_id ids_crc32")
    assert check(packing.pack(cut).collect(), 4096) == packing.sequences_needed(np.array(lengths), 4096)


def test_query(spark, sf_dir):
    """The query over its own table, ids by the tokenizer's own calls."""
    from flowmill.llm import registry
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(vocabulary(WORD_BPE)), []
    for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r["doc_id"], k, k * 4096, len(part), zlib.crc32(part.tobytes())) for k, part in enumerate(np.split(ids, range(4096, len(ids), 4096)))]
    rows = registry.op1_best_fit_packing(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert check(rows, 4096) <= best_fit([n for *_, n, _ in want], 4096)
