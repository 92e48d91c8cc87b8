import sys
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from test_decontamination import brute as hits  # noqa: E402
from test_parity_join import brute as classes  # noqa: E402

from wordloom.llm.common import read_table  # noqa: E402
from wordloom.llm.words import ascii_words  # noqa: E402
from wordloom.session import stage  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """Documents, then what each stage made of them."""
    docs = [read_table(spark, SF_DIR, "documents")]
    for _, function in corpus_pipeline.STAGES:
        docs.append(stage(function(spark, docs[-1], SF_DIR), "test"))
    return docs


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(results):
    assert [len(corpus_pipeline.STAGES), len({s for s, _ in corpus_pipeline.STAGES})] == [5, 5]
    for df in results[1:-1]:
        assert df.schema.simpleString() == results[0].schema.simpleString()


def test_quality_keeps_good_and_rejects_junk(spark, results):
    labels = {r.doc_id: r.quality for r in read_table(spark, SF_DIR, "labels").collect()}
    kept = rows(results[1])
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.3 * (len(labels) - len(good))
    before = rows(results[0])
    assert all(before[d] == r for d, r in kept.items())


def test_one_document_of_each_class_stays(results):
    before = rows(results[1])
    expected = {low for _, _, low in classes([(d, r.text) for d, r in before.items()])}
    after = rows(results[2])
    assert set(after) == expected and all(before[d] == r for d, r in after.items())


def test_benchmark_passages_go(spark, results):
    before, after = rows(results[2]), rows(results[3])
    items = [(str(r.item_id), r.text) for r in read_table(spark, SF_DIR, "benchmark").collect()]
    found = dict(zip(before, hits([r.text for r in before.values()], items), strict=True))
    assert any(hit for _, hit, _ in found.values())
    for d, (n, hit, _) in found.items():
        if len(hit) == n and n:
            assert d not in after
            continue
        words = ascii_words(before[d].text.encode())
        assert ascii_words(after[d].text.encode()) == [w for i, w in enumerate(words) if i not in hit]
        assert after[d].n_chars == len(after[d].text) and (hit or before[d] == after[d])


def test_secrets_are_redacted(results):
    from test_secrets import brute

    before, after = rows(results[3]), rows(results[4])
    assert set(before) == set(after)
    for d, r in after.items():
        assert not brute(r.text) and (r.text == before[d].text or "[redacted]" in r.text)
        assert r.n_chars == len(r.text)


def test_all_that_is_left_is_packed(results):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {d: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for d, r in rows(results[4]).items()}
    found = {}
    for r in sorted(results[5].collect(), key=lambda r: (r.doc_id, r.start)):
        ids = found.setdefault(r.doc_id, [])
        assert r.start == len(ids)
        ids += memoryview(r.ids).cast("I").tolist()
    assert found == wanted


def test_run_is_the_stages_in_order(spark, results):
    assert corpus_pipeline.run(spark, SF_DIR).count() == results[-1].count()
