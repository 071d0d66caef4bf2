"""The mix against water filling and a sort of each source, one document at a time."""

import hashlib
import math
from collections import defaultdict

import pytest

from gatewright.llm import mixing
from gatewright.llm.mixing import budgets, mix_sources


def filled(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Targets: what is over the bounds is reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > epochs * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        target |= {s: epochs * sizes[s] for s in over}
        left -= sum(epochs * sizes[s] for s in over)
        open_ -= over
    return target


def plain(rows, quality, **how):
    sized = [(d, s, len((t or "").encode().split()), hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()) for d, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in sized:
        sizes[s] += n
    target, out = filled(sizes, **how), []
    for s in sizes:
        own = sorted((-math.log((int(h[:13], 16) + 0.5) / 16**13) / quality.get(d, 1.0), h, d, n) for d, t, n, h in sized if t == s)
        epochs = min(how.get("epochs", 2), target[s] // sizes[s]) if sizes[s] else 0
        left = math.floor(target[s]) - epochs * sizes[s]
        for _, _, d, n in own:
            got = min(n, left)
            left -= got
            out.append((d, s, n, sizes[s], round(target[s], 6), int(epochs * n + got)))
    return sorted(out, key=str)


def rows_of(n, seed=0):
    made = []
    for i in range(n):
        k = (i * 7919 + seed) % 23
        made.append((i, " ".join(["w\x0b"] * (k * k % 60)) + "\n\t", None if i % 11 == 0 else f"s{i % 4}" if i % 3 else "hot"))
    return made + [(None, "a b c", "s1"), (None, "a b c", "s1"), (5, None, "nothing"), (6, "", "nothing"), (3, "x y", "hot"), (3, "x y", "hot"), (3, "x z", "hot"), (9, "Ω \x1c b", "ß")]


@pytest.mark.parametrize("grains", [1, 3, 4096])
def test_mix_equals_a_plain_one(spark, monkeypatch, grains):
    monkeypatch.setattr(mixing, "GRAINS", grains)
    rows = rows_of(400)
    quality = {i: 0.25 + i % 5 for i in range(0, 400, 2)}
    docs = spark.createDataFrame([(*r, "n", 2) for r in rows], "doc_id long, text string, source string, size string, n long")
    known = spark.createDataFrame([*quality.items(), (2, 0.01), (None, 5.0), (8, None)], "doc_id long, weight double")
    got = sorted(((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mix_sources(docs, known).collect()), key=str)
    assert got == plain(rows, quality)
    by = defaultdict(int)
    for _, s, n, _, t, taken in got:
        by[s, t] += taken
        assert 0 <= taken <= 2 * n
    assert all(math.floor(t) == taken for (_, t), taken in by.items())


def test_one_row_in_three_is_the_same(spark):
    """Equal rows are numbered by counting, whatever their number."""
    rows = [(1, "a b c d", "x")] * 300 + [(i, "a b", "xyz"[i % 3]) for i in range(2, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mix_sources(docs).collect()), key=str)
    assert got == plain(rows, {})


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 0, "b": 7}, {"a": 5}, {None: 3, "z": 4, "A": 900, "é": 1, "b": 0}, {"a": 0}])
@pytest.mark.parametrize("share", [0.0, 0.4, 1.5, 2.0, 3.0])
def test_budgets_fill_up(spark, sizes, share):
    got = {r.source: r.target for r in budgets(spark.createDataFrame([*sizes.items()], "source string, source_size long"), share=share).collect()}
    assert got == pytest.approx(filled(sizes, share=share))


def test_better_documents_come_first_and_reruns_agree(spark):
    rows = [(i, "a b c d e", "one") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 4.0) for i in range(0, 3000, 2)], "doc_id long, weight double")
    mix = lambda: {r.doc_id: r.taken for r in mix_sources(docs, quality, share=0.3).collect()}
    once = mix()
    good, rest = (sum(t for d, t in once.items() if d % 2 == k) for k in (0, 1))
    assert once == mix() and good + rest == 4500 and good > 2.5 * rest > 0


def test_an_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
