import zlib

import pytest

import corpus_pipeline
from gatewright.llm import quality
from gatewright.llm.queries import ORACLES, QUERIES

from oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - {"op13_whitening"}))
def test_query_covers_the_table(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = QUERIES[name](spark, SF)
    assert got.select("doc_id").distinct().count() == n and (name == "op3_packing" or got.count() == n)


def test_scores_are_never_learned_from_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    open_ = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert quality.fit_quality(docs, labels) == quality.fit_quality(docs, labels.where(labels.doc_id.isin(open_)))


def test_pipeline(spark):
    """Each stage against what it says, on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "personal", "packing"]
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).toPandas(), docs.schema)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    texts = {r.doc_id: r.text for r in now.collect()}
    assert not any("@mail" in t for t in texts.values()) and all(r.n_chars == len(r.text) for r in now.collect())
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == texts.keys()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(d, 1) for d in texts)
