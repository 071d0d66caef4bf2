"""Every pair of texts of a table at a similarity of 0.8 or more is joined by the near stage, and nothing else is."""

from collections import Counter, defaultdict

from gatewright.llm.near_texts import alike_groups, shingles

SF = "/root/testdata/sf0.1"


def alike_pairs(sets):
    """All such pairs, through the rarest shingles of each set: of two sets alike, each has one among its rarest fifth and one more."""
    held = Counter(h for s in sets for h in s)
    where, pairs = defaultdict(list), set()
    for i, s in enumerate(sets):
        own = sorted(s, key=lambda h: (held[h], h))[: len(s) // 5 + 1]
        near = {j for h in own for j in where[h]}
        pairs |= {(j, i) for j in near if 5 * len(s & sets[j]) >= 4 * len(s | sets[j])}
        for h in own:
            where[h].append(i)
    return pairs


def test_all_pairs_of_a_table_are_joined(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    distinct = defaultdict(list)
    for d, t in texts.items():
        distinct[frozenset(shingles((t or "").encode()).tolist())].append(d)
    sets = [s for s in distinct if s]
    pairs = alike_pairs(sets)
    assert len(pairs) > 40
    root = list(range(len(sets)))

    def up(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in pairs:
        a, b = sorted((up(i), up(j)))
        root[b] = a
    least = defaultdict(lambda: 2**63)
    for i, s in enumerate(sets):
        least[up(i)] = min(least[up(i)], *distinct[s])
    want = {d: least[up(i)] for i, s in enumerate(sets) for d in distinct[s]}
    want |= {d: min(own) for own in [distinct.get(frozenset(), [])] for d in own}
    assert {r.did: r.component for r in alike_groups(docs).collect()} == want
