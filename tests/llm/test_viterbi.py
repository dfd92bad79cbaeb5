import random

import pytest
from flowmill.llm import registry, viterbi
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers


def tokenizer(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    return t


FULL = viterbi.zipf_scores(registry.vocabulary("piece_bpe_32k.model"))
COUNTER, REAL = viterbi.UnigramCounter(FULL), tokenizer(FULL, True)
ODD = ["", " ", "a\ufdd0b \x1c", "\x1fa\u2003b\x85c\x1d", "a\x1cb  c", "x▁y ▁▁z ▁", "日本語 Ω≈ç √ 🙂🙂", "<0x41> <s> <unk>", "é ́", "a\xa0b　c", "\x00\x01", "supercalifragilistic" * 200]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("abcdeé ▁\n🙂", max_size=40)))
def test_counts_are_the_tokenizers_own(text):
    assert COUNTER.text(text) == len(REAL.encode(text).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert COUNTER.text(text) == len(REAL.encode(text).ids)


def test_ties_and_unknowns_in_small_vocabularies():
    rng = random.Random(3)
    for round_ in range(60):
        pieces = {"".join(rng.choice("▁abc") for _ in range(rng.randrange(1, 4))) for _ in range(12)}
        vocabulary = [("<unk>", 0.0)] + [(p, float(-rng.randrange(1, 4))) for p in sorted(pieces)]
        counter, real = viterbi.UnigramCounter(vocabulary), tokenizer(vocabulary, round_ % 2 == 0)
        for _ in range(20):
            text = "".join(rng.choice("abcd ") for _ in range(14))
            assert counter.text(text) == len(real.encode(text).ids), (vocabulary, text)


def test_query(spark, sf_dir):
    got = {r["doc_id"]: r["n_tokens"] for r in registry.op7_token_counts(spark, sf_dir).collect()}
    rows = registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    real = REAL.encode_batch([r["text"] for r in rows])
    assert got == {r["doc_id"]: len(e.ids) for r, e in zip(rows, real, strict=True)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "one two", 5), (2, "one two", 5), (2, "one two", 5)], "doc_id long, text string, n_tokens int")
    n = len(REAL.encode("one two").ids)
    assert sorted(map(tuple, viterbi.token_counts(docs, FULL).collect()), key=str) == sorted([(1, 0), (None, n), (2, n), (2, n)], key=str)
    assert viterbi.token_counts(docs.limit(0), FULL).count() == 0
