"""The repeats operator against the corpus order of prefix-free parsing, and that against plain sorting."""

import random

import numpy as np
import prefix_free

from gatewright.llm.repeats import remove_repeats


def corpus(seed):
    r = random.Random(seed)
    text = lambda n, a="abcdefgh ": "".join(r.choice(a) for _ in range(n))
    shared = [text(n) for n in (150, 400, 401, 650, 1200)] + [text(7) * 90, "z" * 700]
    out = []
    for _ in range(30):
        parts = [text(r.randint(0, 400))] + [x for p in r.choices(shared, k=r.randint(0, 3)) for x in (p[r.randint(0, 40) :], text(r.randint(0, 200)))]
        out.append("".join(parts).encode())
    return out + [b"", b"a", out[3]]


def test_the_order_is_that_of_all_suffixes():
    for seed in range(3):
        texts = [t[:300] for t in corpus(seed)]
        whole, starts, ends = prefix_free.parsed(texts)
        order, _ = prefix_free.corpus_order(whole, starts, ends)
        plain = sorted(range(len(whole)), key=lambda i: whole[i:].tolist())
        assert order.tolist() == plain


def test_repeats_equal_the_corpus_order(spark):
    texts = corpus(5)
    want = {}
    for d, (t, at) in enumerate(zip(texts, prefix_free.repeated_starts(texts, 400))):
        gone = np.zeros(len(t), bool)
        for i in at:
            gone[i : i + 400] = True
        want[d] = (int(gone.sum()), bytes(np.frombuffer(t, np.uint8)[~gone]))
    docs = spark.createDataFrame([(d, t.decode()) for d, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in remove_repeats(docs).collect()} == want
    assert sum(n for n, _ in want.values()) > 5000
