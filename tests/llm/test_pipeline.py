import os

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from fixtures import odd_documents
from tokenizers import Tokenizer

from tallyglass.llm import decontamination, mixing, near_duplicates, quality_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert {r["doc_id"] for r in docs.collect()} <= {None, 1, 6, 9}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_run_is_its_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality_rules.clean(docs)
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    kept = near_duplicates.drop_near_duplicates(kept)
    kept = decontamination.drop_leaks(kept, spark.read.parquet(f"{SF}/benchmark.parquet"))
    kept = mixing.mixed(queries.with_domain(kept), queries.mix_plan(1.0)).select("doc_id", "text").collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r["doc_id"], len(plain.encode(r["text"], add_special_tokens=False).ids) + 1) for r in kept)
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == want
    assert [r["start"] for r in got] == [0, *np.cumsum([n for _, n in want])[:-1].tolist()]
