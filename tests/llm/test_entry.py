import pytest

import corpus_pipeline
from treeline.llm import registry

NUMBERS = [int(n[2:].split("_")[0]) for n in registry.QUERIES]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(agree, name):
    agree(registry.QUERIES[name], registry.ORACLES[name])


def test_one_query_each():
    assert sorted(NUMBERS) == list(range(1, 11))


def test_stages_keep_the_columns_and_the_pipeline_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == names
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] >= kept[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    again = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted((r.doc_id, r.n_tokens, tuple(r.token_ids)) for r in df.collect())
    assert key(out) == key(again)
    assert all(r.round_trip for r in again.select("round_trip").distinct().collect())
