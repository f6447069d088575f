"""Registered queries against their SQL, and the pipeline against plain versions of its stages."""

import os
from collections import Counter

import pytest
from oracle import compare, connect

import corpus_pipeline
from tableworks.llm import minhash, passages, pieces, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == []


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_stages_do_their_work(spark, tmp_path):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = docs
    left = dict(rows)
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, SF)
        path = str(tmp_path / name.replace(" ", "-"))
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        after = {r["doc_id"]: r for r in kept.collect()}
        assert len(after) == kept.count() and set(after) <= set(left)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
        if "quality" in name:
            model = quality.fit(docs, spark.read.parquet(os.path.join(SF, "labels.parquet")))
            import numpy as np

            accepted = {i for i, r in rows.items() if model.score(np.array([quality.features(r["text"])]))[0] >= quality.THRESHOLD}
            assert set(after) == accepted
        elif "MinHash" in name:
            parts = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(before).collect()}
            assert Counter(parts[i] for i in after) == Counter(set(parts.values()))
        elif "substring" in name:
            assert passages.repeated(kept).where("removed").count() <= passages.repeated(before).where("removed").count()
            assert all(len(after[i]["text"]) <= len(left[i]["text"]) and after[i]["n_chars"] == len(after[i]["text"]) for i in after)
        elif "Sentence" in name:
            own = pieces.Pieces()
            assert all(own.decode(r["ids"]) == left[i]["text"] and r["decoded_same"] for i, r in after.items())
            assert set(after) == set(left)
        left = after
    assert corpus_pipeline.run(spark, SF).count() == len(left) > 0
