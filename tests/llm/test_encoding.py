import pyarrow as pa
from flowmill.llm import encoding
from flowmill.llm.registry import WORD_BPE, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st

ENCODER = encoding.WordEncoder(vocabulary(WORD_BPE), 1)
ODD = ["", " ", "a\x1cb  c", "don't we'll <|endoftext|> x<|startoftext|>y", "İstanbul ΑΣ Σ. É é ́x", "a\xa0b c　", "x" * 3000 + " 123.5 ok", "‍ a‍b 你好 世界。", "Hi!! you.. a,b .", "ªº, ǅ. "]


def check(texts):
    ids, begin = ENCODER.encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("aB'.,!? \n\tsé́İ0", max_size=30)), max_size=8))
def test_ids_are_the_tokenizers_own(texts):
    check(texts)


def test_odd_texts_and_full_memory(monkeypatch):
    check(ODD)
    monkeypatch.setattr(encoding, "MOST_KEYS", 5)
    for _ in range(3):
        check(ODD * 2)
