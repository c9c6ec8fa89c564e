"""The pipeline's stages on a small table, each judged on its own input."""

import re
from collections import Counter

import pytest
from helpers import linked

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from wavetable.session import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialise(stage(spark, docs, SF), name)
    return {k: v.toPandas() for k, v in out.items()}


def test_columns(stages):
    names = list(stages["documents"].columns)
    for k in list(stages)[:-1]:
        assert list(stages[k].columns) == names
    assert set(names) | {"shard", "slot", "size"} == set(stages["shards"].columns)


def test_clean_documents_pass_the_language_stage(stages):
    before, after = stages["documents"], stages["language"]
    assert set(after.doc_id) <= set(before.doc_id) and len(after) >= 0.99 * len(before[before.text.str.contains("[a-z]", na=False)])


def test_one_document_of_each_group_stays(stages):
    docs = list(stages["language"][["doc_id", "text"]].itertuples(index=False, name=None))
    assert sorted(stages["near_copies"].doc_id) == sorted({c for _, _, c in linked(docs)})


def test_benchmark_items_go(stages, spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = stages["near_copies"], stages["benchmark"]
    holds = before.text.apply(lambda x: any(t in x for t in items))
    assert set(after.doc_id) <= set(before.doc_id[~holds]) and len(after) >= (~holds).sum() - 2


def test_mixture_and_shards(stages):
    mixed, placed = stages["mixture"], stages["shards"]
    assert set(mixed.doc_id) <= set(stages["benchmark"].doc_id)
    assert Counter(mixed.doc_id) == Counter(placed.doc_id) and placed.shard.between(0, 23).all()
    assert placed.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()


def test_edge_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (None, "Word " * 40, "en", "s", 3), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "x" * 100_000, "fr", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            # a source of a few bytes is repeated often to reach its weight
            assert stage(spark, docs, SF).count() <= (10_000 if name == "mixture" else len(rows))
    assert re.match("[a-z]", corpus_pipeline.STAGES[0][0])
