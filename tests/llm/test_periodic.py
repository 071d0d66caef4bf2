"""Periodic runs against a search for every period at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gatewright.llm.periodic import Suffixes, blocks, periodic_runs, runs


def plain(words, shortest):
    """(start, length, period) of every maximal stretch, by its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items() if b >= shortest)


def row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain(words, 12)
    dropped = {i for a, b, q in found for i in range(a + q, a + b)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    told = "".join(f"{a},{b},{q}\n" for a, b, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("shortest", [2, 4, 12])
def test_runs_equal_a_plain_search(shortest):
    r = random.Random(shortest)
    for _ in range(1500):
        n = r.randint(0, 70)
        w = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(n)]
        if n and r.random() < 0.4:
            a = r.randrange(n)
            p = r.randint(1, n - a)
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
        assert list(zip(*(x.tolist() for x in runs(np.array(w, np.int64), shortest)))) == plain(w, shortest), w


def test_blocks_are_the_longest_earlier_strings():
    r = random.Random(1)
    for _ in range(300):
        w = [r.randrange(3) for _ in range(r.randint(1, 40))]
        cut, i = [], 0
        while i < len(w):
            cut.append(i)
            i += max(1, max((next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i) for j in range(i)), default=0))
        assert blocks(Suffixes(np.array(w, np.int64))).tolist() == [*cut, len(w)]


def test_long_sequences_take_linear_time():
    n = 100_000
    fib = [0], [0, 1]
    while len(fib[1]) < n:
        fib = fib[1], fib[1] + fib[0]
    assert [x.tolist() for x in runs(np.zeros(n, np.int64))] == [[0], [n], [1]]
    assert [x.tolist() for x in runs(np.tile(np.arange(n // 4), 4))] == [[0], [n], [n // 4]]
    start, length, period = runs(np.array(fib[1][:n]))
    assert len(start) > n / 10 and (length >= np.maximum(12, 2 * period)).all() and start[0] == 0
    assert not len(runs(np.arange(n))[0])


def test_operator_equals_its_contract(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "b", "ü", "word"]) for _ in range(r.randint(0, 90))) for _ in range(150)]
    texts += [" ".join(f"w{i % 7}" for i in range(5000)), "\t\x0b one\ntwo \x1c \xa0 ", "x " * 40, "", None, None]
    rows_ = [(i, t, "en", -1, "n") for i, t in enumerate(texts)] + [(None, "y " * 30, None, 3, "x"), (7, texts[7], "en", -1, "n"), (10**15, None, None, None, None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, did long, n_runs string")
    got = sorted((tuple(x) for x in periodic_runs(docs, tails=True, with_text=False).collect()), key=str)
    assert got == sorted((row(x[0], x[1]) for x in rows_), key=str)
    assert periodic_runs(docs.where("false")).collect() == []
    full = {x.doc_id: x for x in periodic_runs(docs).collect()}
    assert full[150].collapsed == " ".join(f"w{i}" for i in range(7)) and [tuple(x) for x in full[150].runs] == [(0, 5000, 7)] and full[150].exponent_milli == 714285
    assert full[154].collapsed == "" and full[154].start is None and full[154].runs == []


def test_query_equals_its_contract(spark):
    from gatewright.llm.queries import QUERIES

    docs = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = {x.doc_id: tuple(x) for x in QUERIES["op11_periodic"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == docs.keys()
    short = [d for d, t in docs.items() if len((t or "").split()) <= 1500]
    assert len(short) > 150 and all(got[d] == row(d, docs[d]) for d in short)
