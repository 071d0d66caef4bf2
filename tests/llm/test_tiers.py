"""Routing to tiers: every window is opened by a piece of its tier, full, and filled from shorter ones; groups of a tier have even work."""

import random
from collections import defaultdict

import numpy as np
import pytest

from gatewright.llm.packing import Packer


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("buffer", [300, 20_000, 262_144])
def test_windows_are_opened_by_their_tier_and_filled_from_shorter_ones(seed, buffer):
    r = random.Random(seed)
    packer, docs, out = Packer(1024, 16, buffer, 8192, 7), {}, []
    for d in range(400):
        n = r.choice([1, 5, 16, 17, 100, 513, 1024, 1025, r.randint(1, 3000), r.randint(1, 400)])
        docs[d] = np.arange(n, dtype=np.uint32) + d * 10_000
        packer.add((d, n), docs[d])
        if packer.full():
            out += packer.flush()
    ended = len(out)
    out += packer.flush(last=True)
    got = {d: np.full(len(i), -1, np.int64) for d, i in docs.items()}
    odd, opened, work = 0, 0, defaultdict(lambda: defaultdict(list))
    for at, (_, group, tier, pieces) in enumerate(out):
        n = sum(len(p[2]) for p in pieces)
        assert at >= ended or n == tier
        odd += n & (n - 1) != 0
        assert n == tier or n < 16
        opened += len(pieces[0][2]) > tier // 2
        assert all(len(p[2]) <= tier for p in pieces)
        work[tier][group].append(sum(len(p[2]) ** 2 for p in pieces))
        for (d, total), start, ids in pieces:
            assert total == len(docs[d]) and (got[d][start : start + len(ids)] == -1).all()
            got[d][start : start + len(ids)] = ids
    assert odd <= 1 and all((got[d] == docs[d]).all() for d in docs)
    assert opened >= len(out) - 12, "but for what remains at the end"
    assert len({s for s, *_ in out}) == len(out) and len(work) > 1
    for tier, groups in work.items():
        assert all(len(g) <= 8192 // tier for g in groups.values())
        full = [sum(g) for g in groups.values() if len(g) == 8192 // tier]
        assert buffer < 10**5 or len(full) < 3 or max(full) < 1.3 * min(full), tier
