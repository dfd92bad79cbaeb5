import zlib

import numpy as np
import pytest
from flowmill.llm import binary_ids, simple8b
from flowmill.llm.registry import WORD_BPE, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(values):
    given_values = np.array(values, np.uint64)
    words, offsets, raw = simple8b.encode(given_values)
    assert (simple8b.decode(words, offsets, raw, len(values)) == given_values).all()


def test_simple8b_packs_as_tightly_as_greedy():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << rng.integers(0, 20, 5000))
    n = 0
    for block in np.split(values, range(512, 5000, 512)):
        at = 0
        while at < len(block):
            at += next(int(c) for c, w in zip(simple8b.COUNTS[1:], simple8b.WIDTHS[1:], strict=True) if (block[at : at + c] < 1 << int(w)).all())
            n += 1
    assert len(simple8b.encode(values)[0]) == n


@pytest.mark.parametrize("rows", [0, 60])
def test_round_trip(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(binary_ids, "FRAME_IDS", 300)
    texts = [None if i % 9 == 0 else "" if i % 11 == 0 else "some words, " * (i % 7) + "z" * (i % 5 * 300) for i in range(rows)]
    data = [(None if i == 5 else (i * 37) % 53, t, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, start int")
    path = f"file://{tmp_path}/ids"
    got = [tuple(r) for r in binary_ids.round_trip(docs, path, vocabulary(WORD_BPE)).collect()]
    from tokenizers import Tokenizer

    t, want, start = Tokenizer.from_file(vocabulary(WORD_BPE)), [], 0
    for doc, text, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_damage_is_seen():
    content = binary_ids.frame(0, 0, [1], [3], np.array([5, 6, 7])) + binary_ids.TRAILER.encode()
    assert [x[4].tolist() for x in binary_ids.frames(content)] == [[5, 6, 7]]
    with pytest.raises(ValueError):
        list(binary_ids.frames(content[:-8] + b"........"))
    with pytest.raises(ValueError):
        list(binary_ids.frames(b"." * 64))


def test_query(spark, sf_dir):
    """The query over its own table, ids by the tokenizer's own calls."""
    from flowmill.llm import registry
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(vocabulary(WORD_BPE)), 0
    got = {r["doc_id"]: tuple(r) for r in registry.op4_binary_token_ids(spark, sf_dir).collect()}
    docs = sorted(map(tuple, registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect()))
    for doc, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert got[doc] == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)
