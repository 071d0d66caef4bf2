"""The near stage of the corpus against brute force over all pairs."""

import random

import corpus_pipeline
from gatewright.llm.near_texts import alike_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return ["".join(r.choice("aeiourstln") for _ in range(r.randint(3, 9))) for _ in range(n)]


def shingled(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) * 5 >= len(a | b) * 4


def families(seed):
    """Texts with some words changed, at similarities on both sides of 0.8; chains, short and empty texts."""
    r = random.Random(seed)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for _ in range(25):
        base = words(r, r.choice([20, 60, 200, 1500]))
        texts.append(" ".join(base))
        for _ in range(r.randint(1, 7)):
            now = list(base)
            for i in r.sample(range(len(now)), max(1, int(len(now) * r.choice([0.005, 0.015, 0.022, 0.03, 0.05])))):
                now[i] = "".join(words(r, 1))
            texts.append(" ".join(now))
            base = now if r.random() < 0.3 else base
    return list(enumerate(texts))


def components_of(rows):
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def test_near_stage_merges_all_that_is_alike_and_nothing_else(spark):
    rows = families(3)
    want = components_of(rows)
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA).repartition(3)
    assert {r.did: r.component for r in alike_groups(docs).collect()} == dict(enumerate(want))
    left = corpus_pipeline.near(spark, docs, "")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))


def test_near_stage_of_an_empty_table(spark):
    assert corpus_pipeline.near(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_large_groups_are_compared_whole_in_blocks(spark, monkeypatch):
    """Some texts alike to none of their group, and clusters that meet only far from the hub, over many small blocks."""
    from gatewright.llm import near_texts

    monkeypatch.setattr(near_texts, "BLOCK", 7)
    monkeypatch.setattr(near_texts, "PIECE", 16)
    r = random.Random(9)
    base, texts = words(r, 120), []
    for _ in range(12):
        now = list(base)
        for i in r.sample(range(120), 4):
            now[i] = "".join(words(r, 1))
        for _ in range(r.randint(1, 6)):
            texts.append(" ".join(now))
            now[r.randrange(120)] = "".join(words(r, 1))
    rows = list(enumerate(texts))
    want = components_of(rows)
    assert 1 < len(set(want)) < len(rows)
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA).repartition(3)
    assert {x.did: x.component for x in alike_groups(docs).collect()} == dict(enumerate(want))


def test_a_large_group_does_not_meet_in_every_block(spark, monkeypatch):
    """Copies about one original, on both sides of 0.8: once judged whole they are not met again, and none of their links is lost."""
    from gatewright.llm import near_texts

    met, write = [], near_texts.durable

    def counted(df):
        out = write(df)
        if {"key", "th"} <= set(out.columns):
            met.append(out.count())
        return out

    monkeypatch.setattr(near_texts, "durable", counted)
    r = random.Random(12)
    base, texts = words(r, 150), []
    for _ in range(300):
        now = list(base)
        for i in r.sample(range(150), r.randint(2, 6)):
            now[i] = "".join(words(r, 1))
        texts.append(" ".join(now))
    rows = list(enumerate(texts))
    want = components_of(rows)
    assert 1 < len(set(want)) < 300
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA).repartition(3)
    assert {x.did: x.component for x in alike_groups(docs).collect()} == dict(enumerate(want))
    assert 0 < sum(met) < 300 * 200, met
