"""Substring dedup of passages of fifty words that have few bytes or a period."""

import random

import pytest

from gatewright.llm.cdc import least_cuts
from gatewright.llm.substring_dedup import substring_dedup


def words(r, n, least, most):
    return " ".join("".join(r.choice("aeiourstlnmdpcbgf") for _ in range(r.randint(least, most))) for _ in range(n))


def planted(r, passage):
    return " ".join([words(r, 60, 2, 9), passage, words(r, 60, 2, 9)])


def removed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()}


def test_fifty_short_words_are_a_passage(spark):
    r = random.Random(4)
    texts = []
    for _ in range(200):
        passage = words(r, 51, 2, 4)
        texts += [planted(r, passage), planted(r, passage)]
    got = removed(spark, texts)
    assert all(got[d] == 0 for d in range(0, 400, 2))
    assert sum(got[d] > 0 for d in range(1, 400, 2)) >= 190


def test_phrases_are_left_alone(spark):
    r = random.Random(6)
    phrase = words(r, 9, 2, 9)
    assert not any(removed(spark, [planted(r, phrase) for _ in range(60)]).values())


@pytest.mark.parametrize("period", ["x", "ab", "lorem ipsum ", "one two three four five "])
def test_periodic_passages_are_cut_and_removed(spark, period):
    r = random.Random(8)
    passage = (period * 480)[:480]
    got = removed(spark, [planted(r, passage), planted(r, passage)])
    assert got[1] > 240
    own = least_cuts([planted(r, passage).encode()], 24)[0].tolist()
    assert all(24 < b - a < 250 for a, b in zip(own, own[1:-1]))
