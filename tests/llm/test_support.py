"""What can be alike to anything, components, and names of sets, each against a plain count."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_near_texts import SCHEMA, components_of, words

from gatewright.llm import block_balls, components, near_texts, support


def plain_shared(sets):
    holders = {}
    for sid, own in sets:
        for h in own:
            holders.setdefault(h, set()).add(sid)
    out = {}
    for sid, own in sets:
        n = sum(len(holders[h]) > 1 for h in own)
        if n:
            out[sid] = out.get(sid, 0) + n
    return out


@pytest.mark.parametrize("held, tasks, parts", [(10**6, 1, 1), (40, 1, 5), (40, 3, 5), (1, 4, 7), (200, 2, 64)])
def test_shared_members_equal_a_plain_count(monkeypatch, held, tasks, parts):
    monkeypatch.setattr(support, "HELD", held)
    r = random.Random(held + tasks)
    pool = [r.randrange(2**63) for _ in range(300)]
    sets = [(r.randrange(-(2**63), 2**63), sorted({7, *r.sample(pool, r.randint(0, 12)), *(r.randrange(2**63) for _ in range(r.randint(0, 9)))})) for _ in range(120)]
    sets += [sets[0], sets[1]]  # sets that come twice are no others
    by_part = {}
    for t in range(tasks):
        for batch in support.send(((sid, np.array(own, np.uint64)) for sid, own in sets[t::tasks]), parts):
            for row in batch.to_pylist():
                by_part.setdefault(row["part"], []).append(row)
    schema = pa.schema([("part", pa.int32()), ("told", pa.bool_()), ("rows", pa.binary())])
    summed = {}
    for p in sorted(by_part):
        for batch in support._received([pa.RecordBatch.from_pylist(by_part[p], schema=schema)], parts):
            for row in batch.to_pylist():
                summed.setdefault(row["part"], []).append(row)
    got = {}
    for p in sorted(summed):
        for batch in support._summed([pa.RecordBatch.from_pylist(summed[p], schema=pa.schema([("part", pa.int32()), ("rows", pa.binary())]))]):
            got |= dict(zip(*(c.to_pylist() for c in batch.columns)))
    want = plain_shared(sets)
    assert {k: v for k, v in got.items() if v} == want
    assert held > 300 or sum(len(b) for rows in by_part.values() for b in [x["rows"] for x in rows if not x["told"]]) // 16 <= sum(len(set(own)) for _, own in sets)


def test_members_joined_by_runs_are_written_once():
    r = np.random.default_rng(2)
    for _ in range(50):
        key = r.integers(0, 12, 30)
        sid = r.integers(-20, 20, 30) * 1_000_003
        group, who, size = block_balls.joined(key, sid)
        root = {s: s for s in set(sid.tolist())}

        def up(x):
            while root[x] != x:
                x = root[x]
            return x

        for k in set(key.tolist()):
            own = sid[key == k].tolist()
            for s in own[1:]:
                root[up(s)] = up(own[0])
        want = {}
        for s in root:
            want.setdefault(up(s), set()).add(s)
        got = {}
        for g, s, n in zip(group.tolist(), who.tolist(), size.tolist()):
            got.setdefault((g, n), set()).add(s)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and all(n == len(v) for (_, n), v in got.items())
        assert len(who) == len(root)


@pytest.mark.parametrize("links_of_a_task", [10**6, 40, 7])
def test_components_over_one_task_or_many(spark, monkeypatch, links_of_a_task):
    monkeypatch.setattr(components, "LINKS", links_of_a_task)
    r = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(130)] + [(1000, x) for x in range(-40, 0)] + [(5, 5), (3, 2)]
    r.shuffle(links)
    root = {x: x for pair in links for x in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert {n: got.get(n, n) for n in root} == root and all(got[n] != n for n in got)


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    """With names of four bits nearly all sets clash, and the groups stay as they were."""
    named = near_texts._named

    def short(texts, width):
        sets, sid, alt = named(texts, width)
        return sets, pa.array(sid.to_numpy() % 16), alt

    monkeypatch.setattr(near_texts, "_named", short)
    r = random.Random(7)
    texts = []
    for _ in range(12):
        base = words(r, 60)
        texts += [" ".join(base), " ".join(base[:-2]), " ".join(base).upper(), " ".join(words(r, 60))]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA).repartition(3)
    assert {x.did: x.component for x in near_texts.alike_groups(docs).collect()} == dict(enumerate(components_of(rows)))
