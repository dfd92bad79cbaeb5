"""The pipeline, each stage against a brute-force version over the stage's own input."""

import re

import corpus_pipeline
import pytest
from flowmill.llm import quality, registry
from tests.llm.test_classes import brute as near_classes
from tests.llm.test_line_dedup import brute as repeated_lines
from tokenizers import Tokenizer

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Rows after each stage, the table itself first."""
    docs = registry.table(spark, sf_dir, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        out.append(got.collect())
        docs = spark.createDataFrame(out[-1], got.schema)
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources", "best-fit packing"]


def test_quality(spark, sf_dir, steps):
    scored = {r["doc_id"]: r for r in quality.score_documents(registry.table(spark, sf_dir, "documents"), registry.table(spark, sf_dir, "labels")).collect()}
    assert {r["doc_id"] for r in steps[1]} == {d for d, r in scored.items() if r["score"] >= 0.3}
    assert set(steps[1]) <= set(steps[0]) and steps[1]


def test_lines(steps):
    gone = repeated_lines([(r["doc_id"], r["text"]) for r in steps[1]])
    want = {}
    for r in steps[1]:
        lost = gone.get((r["doc_id"], r["text"]), [])
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in lost)
        if not lost or WORD.search(text):
            want[r["doc_id"]] = (text, len(text) if lost else r["n_chars"], r["lang"], r["source"])
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["lang"], r["source"]) for r in steps[2]} == want and gone


def test_near_duplicates(steps):
    classes = near_classes([(r["doc_id"], r["text"]) for r in steps[2]])
    heads, kept = set(classes.values()), {r["doc_id"] for r in steps[3]}
    doubles = len(classes) - len(heads)
    assert heads <= kept and len(kept) - len(heads) <= 0.1 * doubles
    assert set(steps[3]) <= set(steps[2])


def test_mix(steps):
    size = lambda rows: {s: sum(len(WORD.findall(r["text"])) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}}
    had, got = size(steps[3]), size(steps[4])
    assert abs(sum(had.values()) - sum(got.values())) <= len(had)
    assert all(got.get(s, 0) <= 3 * n for s, n in had.items())
    texts = {r["doc_id"]: r for r in steps[3]}
    cut = [r for r in steps[4] if r["text"] != texts[r["doc_id"]]["text"]]
    assert all(texts[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in cut) and len(cut) <= len(had)


def test_packing(steps):
    coder = Tokenizer.from_file(registry.vocabulary("word_bpe_49k.json"))
    want = sorted((r["doc_id"], len(coder.encode(r["text"], add_special_tokens=False).ids) + 1) for r in steps[4])
    assert sum(n for _, n in want) == sum(r["length"] for r in steps[5])
    assert sorted((d, n) for d, n in want if n <= 4096) == sorted((r["doc_id"], r["length"]) for r in steps[5] if r["length"] < 4096 and r["start"] == 0 and (r["doc_id"], r["length"]) in set(want))
    bins = {}
    for r in steps[5]:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_is_its_stages(spark, sf_dir, steps):
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, sf_dir).collect()) == key(steps[5])
