"""The pipeline's stages: each on its predecessor's rows, its decisions and its columns."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from ferrule.llm.queries import tokenizer_file
from tests.conftest import SF
from tests.llm.test_set_operators import WORD, lower, near_brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, SF).write.parquet(str(at / name))
        docs = spark.read.parquet(str(at / name))
        out.append(docs)
    return out


def test_stages_are_in_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash", "mixing", "packing"]
    assert all(sorted(d.columns) == sorted(stages[0].columns) for d in stages[1:5])


def test_language_stage_drops_only_what_has_no_letters(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept == {r.doc_id for r in stages[0].collect() if any(c.isalpha() for c in r.text or "")}


def test_exact_stage_keeps_one_of_equal_texts(stages):
    before: dict[str, int] = {}
    for r in stages[1].collect():
        before[lower(r.text)] = max(before.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(before.values())


def test_near_stage_keeps_one_of_each_group(stages):
    want = near_brute([(r.doc_id, r.text, r.source) for r in stages[2].collect()], 5)[1]
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(i for i in want if want[i] == i)


def test_mixing_stage_takes_known_documents_three_times_at_most(stages):
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    rows = stages[4].collect()
    assert all(texts[r.doc_id] == r.text and WORD.search(r.text) for r in rows)
    assert max(np.unique([r.doc_id for r in rows], return_counts=True)[1]) <= 3


def test_packing_stage_holds_every_token(stages):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    want = sorted(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    rows = stages[5].collect()
    assert sum(r.length for r in rows) == sum(want)
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == want
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    ends = np.cumsum([n for _, _, n in places])
    assert [s * 2048 + o for s, o, _ in places] == [0, *ends[:-1]]
