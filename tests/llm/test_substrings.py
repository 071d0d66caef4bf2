"""Substring dedup against the definition, chunk by chunk and without hashes of chunks."""

import random
from collections import defaultdict

import pytest

from gatewright.llm.cdc import GEAR, WINDOW
from gatewright.llm.common import NULL_ID
from gatewright.llm.substring_dedup import FEWEST, RADIUS, SHORTEST, substring_dedup

SCHEMA = "doc_id long, text string, h1 long, drop string"


def chunks(text):
    """Cuts after bytes whose rolling hash is least within RADIUS on both sides, over RADIUS apart."""
    h = [sum(int(GEAR[text[i - k]]) << k for k in range(min(WINDOW, i + 1))) % 2**32 for i in range(len(text))]
    ends = []
    for i in range(RADIUS + WINDOW, len(text) - RADIUS):
        if h[i] <= min(h[i - RADIUS : i] + h[i + 1 : i + RADIUS + 1]) and (not ends or i + 1 - ends[-1] > RADIUS):
            ends.append(i + 1)
    ends = [*ends, len(text)] if text else []
    return [text[i:j] for i, j in zip([0, *ends], ends)]


def plain(rows):
    holders = defaultdict(set)
    for d, t in rows:
        for c in chunks((t or "").encode()):
            if len(c) > RADIUS:
                holders[c].add(NULL_ID if d is None else d)
    for d, t in rows:
        text, own, seen = (t or "").encode(), NULL_ID if d is None else d, set()
        gone, at, run = bytearray(len(text)), 0, None
        marks = []
        for c in chunks(text):
            known = len(c) > RADIUS and (min(holders[c]) < own or c in seen)
            marks.append((at, at + len(c), known))
            seen.add(c)
            at += len(c)
        for a, b, known in [*marks, (at, at, False)]:
            if known:
                run = a if run is None else run
                continue
            if run is not None and (a - run >= SHORTEST or len(text[run:a].split()) >= FEWEST):
                gone[run:a] = b"\x01" * (a - run)
            run = None
        # A code point that is cut in two goes whole.
        at = 0
        for ch in (t or ""):
            n = len(ch.encode())
            if any(gone[at : at + n]):
                gone[at : at + n] = b"\x01" * n
            at += n
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield d, len(text), sum(gone), spans, bytes(x for x, g in zip(text, gone) if not g).decode()


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_equals_the_definition(spark, seed):
    r = random.Random(seed)
    prose = lambda n, a="etaoinshrdlu": " ".join("".join(r.choice(a) for _ in range(r.randint(1, 8))) for _ in range(n))
    passages = [prose(n) for n in (12, 25, 40, 60, 120)] + [prose(40, "漢字語文éß"), "tick tock " * 40, "a" * 300, "yes " * 60]
    rows = [(None, None), (None, passages[4]), (1, ""), (2, "short"), (2, passages[3]), (2, passages[3])]
    for d in range(3, 40):
        parts = [prose(r.randint(0, 60))] + [x for p in r.choices(passages, k=r.randint(0, 3)) for x in (p, prose(r.randint(0, 30), r.choice(["etaoin", "漢字é"])))]
        rows.append((r.choice([d, d, d, None]), " ".join(parts)))
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(4)
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_text) for x in substring_dedup(docs).collect()]
    want = list(plain(rows))
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(x[2] for x in want) > 1000


def test_rows_without_ids_are_told_apart_by_their_texts(spark):
    """Of texts without ids that share passages one keeps each; equal texts are one holder and keep what it keeps."""
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))
    shared = [prose(60) for _ in range(10)]
    texts = [f"{prose(30)} {shared[i % 10]} {prose(30)}" for i in range(60)]
    texts += texts[:5]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(4, shared[0])], "doc_id long, text string").repartition(3)
    assert sum(x.n_removed for x in substring_dedup(docs).where("doc_id IS NULL").collect()) == 0
    got = substring_dedup(docs, by_text=True).collect()
    whole = [x.kept_text for x in got if x.doc_id is None and x.n_removed == 0]
    assert len(set(whole)) == 10 and all(sum(whole.count(t) for t in {w for w in whole if p in w}) >= 1 for p in shared)
    assert len([x for x in got if x.n_removed > 200]) == len(texts) + 1 - len(whole)
    assert [x.n_removed for x in got if x.doc_id == 4] > [200]


def test_many_rows_of_one_id_have_lists_of_their_own(spark):
    from gatewright.llm import substring_dedup as module

    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))
    passages = [prose(60) for _ in range(40)]
    docs = spark.createDataFrame([(1, p) for p in passages] + [(2, f"{prose(20)} {p}") for p in passages], "doc_id long, text string")
    assert all(x.n_removed > 200 for x in module.substring_dedup(docs).where("doc_id = 2").collect())
    base = module.keyed(docs)
    found = module.in_arrow(base.selectExpr("did", "0L AS holder", "th", "text"), lambda it: module._digests(it, module.RADIUS), "did long, holder long, th long, h1 long, h2 long")
    sizes = [x["count"] for x in module._held_before(found).groupBy("did", "th").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 30
