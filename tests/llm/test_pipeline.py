"""The corpus pipeline stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from helpers import EDGE, SF, documents
from test_duplicates import slow_groups

from millrace.llm import bpe, quality
from millrace.llm.queries import GOOD, held_out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage takes and returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, SF).write.parquet(path)
        done = spark.read.parquet(path)
        out.append((docs, done))
        docs = done
    return out


def test_all_but_the_last_keep_the_columns(spark, stages):
    for docs, done in stages[:-1]:
        assert done.dtypes == docs.dtypes


def test_rejected_documents_go(spark, stages):
    docs, done = stages[0]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~held_out()))
    rows = docs.collect()
    p = model.probabilities(quality.Features(), [r["text"] for r in rows])[:, model.classes.index(1)]
    assert sorted(r["doc_id"] for r in done.collect()) == sorted(r["doc_id"] for r, x in zip(rows, p, strict=True) if x >= GOOD)


def test_one_document_of_each_group_stays(stages):
    docs, done = stages[1]
    rows = docs.collect()
    least = {}
    for r, g in zip(rows, slow_groups([r["text"] for r in rows]), strict=True):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in done.collect()) == sorted(least.values())


def test_mixing_keeps_all_and_repeats_within_the_limit(stages):
    docs, done = stages[2]
    before, after = Counter(map(tuple, docs.collect())), Counter(map(tuple, done.collect()))
    assert before.keys() == after.keys() and max(after.values()) <= 2


def test_tokens_are_those_of_the_library(stages):
    docs, done = stages[3]
    ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter((r["doc_id"], tuple(ranks.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in done.collect()) == want
    assert done.filter("not round_trip").count() == 0


def test_stages_on_edge_cases_and_on_nothing(spark):
    docs = documents(spark, EDGE)
    for some in (docs, docs.filter("doc_id < 0")):
        for i, (name, f) in enumerate(corpus_pipeline.STAGES):
            done = f(spark, some, SF)
            assert done.count() <= 2 * len(EDGE), name
            if i < 3:
                assert done.columns == docs.columns
