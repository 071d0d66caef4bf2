"""Each stage of the pipeline on nulls, empty and repeated rows, ties, clashing column names and empty tables."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, th string, row string, score double, component long, clean string"
EXTRA = (7, "x", "y", 0.5, 1, "z")


def prose(r, n):
    return " ".join("".join(r.choice("aeiourstln") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def given(spark):
    r = random.Random(2)
    long = prose(r, 4000)
    rows = [(None, None), (None, ""), (1, None), (2, ""), (3, " \n"), (4, long), (5, long), (6, long + " "), (7, "mail a@b.co now"), (7, "mail a@b.co now"), (8, prose(r, 200)), (None, prose(r, 50)), (None, "no id")]
    return rows, spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), *EXTRA) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def kept(stage, spark, docs, sf_dir):
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_quality_without_labels_keeps_every_row(spark, given, sf_dir):
    rows, docs = given
    assert kept(corpus_pipeline.quality, spark, docs, sf_dir) == sorted(rows, key=str)


def test_exact_keeps_the_longest_then_the_smallest_id(spark, given, sf_dir):
    rows, docs = given
    found = kept(corpus_pipeline.exact, spark, docs, sf_dir)
    assert len(found) == 6
    assert (3, " \n") in found and (6, rows[7][1]) in found and (7, "mail a@b.co now") in found and (None, "no id") in found


def test_near_keeps_one_of_the_smallest_id(spark, given, sf_dir):
    rows, docs = given
    found = kept(corpus_pipeline.near, spark, docs, sf_dir)
    assert len(found) == 6
    assert (4, rows[5][1]) in found and (7, "mail a@b.co now") in found and (None, "no id") in found
    assert sum(d is None and not t for d, t in found) == 1  # texts without words are one group, of no id


def test_personal_keeps_all_rows_and_nulls(spark, given, sf_dir):
    rows, docs = given
    found = kept(corpus_pipeline.personal, spark, docs, sf_dir)
    assert found == sorted(((d, t and t.replace("a@b.co", "[EMAIL]")) for d, t in rows), key=str)
    assert {r.n_chars for r in corpus_pipeline.personal(spark, docs, sf_dir).where("text IS NULL").collect()} == {0}


def test_packing_packs_every_row(spark, given, sf_dir):
    rows, docs = given
    out = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    assert sum(r.length for r in out if r.start + r.length == r.doc_tokens) > 0
    assert sum(r.start == 0 for r in out) == len(rows) and sum(r.doc_id is None and r.start == 0 for r in out) == 4


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, given, sf_dir, name, stage):
    assert stage(spark, given[1].limit(0), sf_dir).count() == 0


def test_only_the_last_result_stays(spark):
    import glob

    home = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{home}/pipeline-*"))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    (mine,) = set(glob.glob(f"{home}/pipeline-*")) - before
    assert glob.glob(f"{mine}/*") == [f"{mine}/packing"] and out.count() > 0
