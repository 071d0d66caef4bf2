"""Periodic runs of words, by the tandem repeats of Gusfield and Stoye.

A run is a maximal stretch with smallest period q and two periods or more. Texts of a batch are
searched together, each word numbered within its text, so nothing matches across texts:

1. Prefix doubling gives the suffix array and, for each power of two, the name of the string of that
   length at each position; two names tell in a few steps how far two positions agree, either way.
2. The Lempel-Ziv blocks of the texts. A square whose leftmost occurrence has its centre in a block
   reaches into the next one at most; two queries for each block and root length give a set of
   squares that covers all leftmost occurrences (start, root) by moves to the right.
3. The suffix link of the locus of a square at i is that of i + 1 in the suffix array. Walks from the
   covering set along these links, as long as the rotation is a square, complete the vocabulary; a
   locus that was met before ends a walk. Only squares with a primitive root are followed.
4. The leaves below each locus are the occurrences. Consecutive ones of one root length are a run.

All of it is numpy over arrays of the batch; there are O(n log n) occurrences of primitive squares in
n words. A run of `shortest` words or more repeats some GRAM words, so a text in which no GRAM words
stand twice has none and is not searched (GRAM is half of `shortest`).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import ints, rows
from gatewright.session import in_arrow

#: Words of the shortest run, and words that are searched together (a longer text is searched alone).
SHORTEST, AT_ONCE = 12, 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as whole numbers, equal for equal words, and the text of each."""
    flat = [w for words in texts for w in words]
    known = dict.fromkeys(flat)
    known = dict(zip(known, range(len(known))))
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    return np.fromiter(map(known.__getitem__, flat), np.int64, len(flat)), owner


def with_repeats(word: np.ndarray, owner: np.ndarray, gram: int) -> np.ndarray:
    """The texts in which some `gram` words stand twice; now and then one in which they don't."""
    n = len(word) - gram + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(gram):
        h = (h ^ (word[i : i + n].astype(np.uint64) + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    low = np.uint64(int(owner[-1]).bit_length() or 1)
    own = owner[:n][owner[:n] == owner[gram - 1 :]].astype(np.uint64)
    h = np.sort(h[owner[:n] == owner[gram - 1 :]] >> low << low | own)
    return np.unique(h[1:][h[1:] == h[:-1]] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


class Suffixes:
    """The suffix array of a sequence of numbers, and names of its strings of 1, 2, 4, ... numbers."""

    def __init__(self, key: np.ndarray):
        n = self.n = len(key)
        self.sa = np.argsort(key, kind="stable")
        slots, fresh = np.arange(n), np.append(True, np.diff(key[self.sa]) != 0)
        rank, self.names = np.empty(n, np.int32), []
        while True:
            # A name is the first place in the array of what begins so.
            rank[self.sa[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
            self.names.append(rank.copy())
            several = ~(fresh & np.append(fresh[1:], True))
            slots = slots[several]
            if not len(slots):
                return
            step = 1 << len(self.names) - 1
            at = self.sa[slots]
            after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
            both = rank[at].astype(np.int64) * (n + 1) + after + 1
            order = np.argsort(both, kind="stable")
            self.sa[slots] = at[order]
            fresh = np.append(True, np.diff(both[order]) != 0)

    def alike(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many numbers agree from i and j on (each 0 to n - 1), or back from them, both included. i and j differ."""
        total = np.zeros(len(i), np.int64)
        left, top = np.arange(len(i)), []
        for k, name in enumerate(self.names):
            a, b = (i[left] - (1 << k) + 1, j[left] - (1 << k) + 1) if back else (i[left], j[left])
            same = (a >= 0) & (b >= 0)
            same[same] = name[a[same]] == name[b[same]]
            left = left[same]
            if not len(left):
                break
            top.append(left)
        for k in range(len(top) - 1, -1, -1):
            left = top[k]
            done = total[left]
            a, b = (i[left] - done - (1 << k) + 1, j[left] - done - (1 << k) + 1) if back else (i[left] + done, j[left] + done)
            same = (a >= 0) & (b >= 0) & (a < self.n) & (b < self.n)
            same[same] = self.names[k][a[same]] == self.names[k][b[same]]
            total[left[same]] += 1 << k
        return total

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the strings of `size` numbers at i and j are equal; that at i lies within the sequence."""
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = (size <= 0) | (i == j)
        for k in np.unique(level[~out]).tolist():
            if k < len(self.names):
                at, name = np.flatnonzero(~out & (level == k)), self.names[k]
                a, b, more = i[at], j[at], size[at] - (1 << k)
                fits = b + more < self.n
                b = np.where(fits, b, 0)
                out[at] = fits & (name[a] == name[b]) & (name[a + more] == name[np.where(fits, b + more, 0)])
        return out

    def locus(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the suffix array in which the string of `size` numbers at i stands."""
        rank = self.names[-1][i].astype(np.int64)  # all names are unique by now
        low, high = rank.copy(), rank.copy()
        for sign, edge in ((-1, low), (1, high)):
            reach = np.full(len(i), sign, np.int64)
            left = np.arange(len(i))
            while len(left):  # further each time, as long as it is the same string
                at = edge[left] + reach[left]
                ok = (at >= 0) & (at < self.n)
                ok[ok] = self.equal(i[left[ok]], self.sa[at[ok]], size[left[ok]])
                left = left[ok]
                edge[left] += reach[left]
                reach[left] *= 2
            reach //= 2 if sign > 0 else 1
            reach = np.abs(reach)
            while reach.any():  # then in halves
                left = np.flatnonzero(reach)
                at = edge[left] + sign * reach[left]
                ok = (at >= 0) & (at < self.n)
                ok[ok] = self.equal(i[left[ok]], self.sa[at[ok]], size[left[ok]])
                edge[left[ok]] += sign * reach[left[ok]]
                reach[left] //= 2
        return low, high + 1


def blocks(s: Suffixes) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin: each is the longest string that begins earlier too, or one new number. n is last."""
    n, rank = s.n, s.names[-1].tolist()
    lower, upper = list(range(-1, n - 1)), list(range(1, n + 1))
    low, high = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):  # what is left in the array around a suffix began before it
        r = rank[i]
        low[i], high[i] = a, b = lower[r], upper[r]
        if a >= 0:
            upper[a] = b
        if b < n:
            lower[b] = a
    longest = np.zeros(n, np.int64)
    for near in (np.array(low, np.int64), np.array(high, np.int64)):
        at = np.flatnonzero((near >= 0) & (near < n))
        longest[at] = np.maximum(longest[at], s.alike(at, s.sa[near[at]]))
    after = (np.arange(n) + np.maximum(longest, 1)).tolist()
    found, i = [], 0
    while i < n:
        found.append(i)
        i = after[i]
    return np.array([*found, n])


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes 2, 3: which 0 0 1 1 1, and count 0 1 0 1 2."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def covering(s: Suffixes, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root) of squares: each square's leftmost occurrence is one of these, or some moves right of one, all of them squares."""
    first, size = cut[:-1], np.diff(cut)
    found = []
    # The left half ends in the block and the right one behind it.
    which, k = _counted(size)
    k = k + 1
    h, q = cut[which + 1], cut[which + 1] - k
    ok = h < s.n
    h, q, k = h[ok], q[ok], k[ok]
    fore = s.alike(h, q)
    h, q, k, fore = (x[fore > 0] for x in (h, q, k, fore))
    back = np.zeros(len(h), np.int64)
    back[q > 0] = s.alike(h[q > 0] - 1, q[q > 0] - 1, True)
    start = np.maximum(q - back, q - k + 1)
    ok = fore + back >= k
    found.append((start[ok], k[ok]))
    # The left half begins before the block and ends in it.
    which, k = _counted(size + np.append(size[1:], 0))
    k = k + 1
    h, end, q = first[which], cut[which + 1], first[which] + k
    ok = (q < s.n) & (h > 0)
    h, end, q, k = h[ok], end[ok], q[ok], k[ok]
    back = s.alike(h - 1, q - 1, True)
    h, end, q, k, back = (x[back > 0] for x in (h, end, q, k, back))
    fore = s.alike(h, q)
    start = np.maximum(h - back, h - k + 1)
    ok = (fore + back >= k) & (fore > 0) & (start + k <= end)
    found.append((start[ok], k[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _least_factors(most: int) -> np.ndarray:
    """The smallest prime factor of each number up to `most`."""
    out = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if out[p] == p:
            own = out[p * p :: p]
            own[own == np.arange(p * p, most + 1, p)] = p
    return out


def _primitive(s: Suffixes, at: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether the root at a place is no repetition of a shorter string: by a prime factor of its length, each in turn."""
    out = np.ones(len(root), bool)
    if not len(root):
        return out
    factor, rest = _least_factors(int(root.max())), root.copy()
    while (left := np.flatnonzero(out & (rest > 1))).size:
        p = factor[rest[left]]
        shorter = root[left] // p
        out[left] = ~s.equal(at[left], at[left] + shorter, root[left] - shorter)
        rest[left] //= p
    return out


def runs(key: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of the runs of a sequence of numbers, by start and period."""
    none = np.empty(0, np.int64)
    if len(key) < 2:
        return none, none, none
    s = Suffixes(key)
    start, root = covering(s, blocks(s))
    whole = _primitive(s, start, root)
    start, root = start[whole], root[whole]
    # A walk ends where the run does, or where it has come round.
    turns = s.alike(start, start + root) - root
    end = start + turns
    order = np.lexsort((start, end, root))
    start, root, end = start[order], root[order], end[order]
    once = np.append(True, (np.diff(root) != 0) | (np.diff(end) != 0))[: len(root)]
    start, root, turns = start[once], root[once], (end - start)[once]
    which, step = _counted(np.minimum(turns, root - 1) + 1)
    at, k = start[which] + step, root[which]
    low, high = s.locus(at, 2 * k)
    _, once = np.unique(low * (s.n + 1) + k, return_index=True)  # the vocabulary: each locus once
    which, leaf = _counted((high - low)[once])
    at, k = s.sa[low[once][which] + leaf], k[once][which]
    key = np.sort(k * (s.n + 1) + at)
    ends = np.append(np.diff(key) != 1, True)[: len(key)]
    begins = np.append(True, ends[:-1])[: len(key)]
    k, at = key[begins] // (s.n + 1), key[begins] % (s.n + 1)
    length = key[ends] % (s.n + 1) - at + 2 * k
    long = length >= shortest
    order = np.lexsort((k[long], at[long]))
    return at[long][order], length[long][order], k[long][order]


def periodic_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a tail made periodic for one id in ten, by the checksum of the id; a row without an id stays as it is."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _found(ids: pa.Array, texts: list[list[bytes]], shortest: int, with_text: bool) -> pa.RecordBatch:
    word, owner = numbered(texts)
    some = with_repeats(word, owner, shortest // 2)
    inside = np.isin(owner, some)
    place = np.flatnonzero(inside)
    at, length, period = runs((owner * (len(word) + 1) + word)[inside], shortest)
    text = owner[place[at]] if len(at) else at
    first = np.cumsum([0, *map(len, texts)])
    start = place[at] - first[text] if len(at) else at
    gone = np.zeros(len(word) + 1, np.int64)
    np.add.at(gone, place[at] + period if len(at) else at, 1)
    np.add.at(gone, place[at] + length if len(at) else at, -1)
    gone = np.cumsum(gone)[:-1] > 0
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    out = [[] for _ in NAMES[1:]]
    lists, kept = [], []
    for i, words in enumerate(texts):
        own = list(zip(*(x[cut[i] : cut[i + 1]].tolist() for x in (start, length, period))))
        best = max(own, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        if own:
            stay = ~gone[first[i] : first[i + 1]]
            words = [w for w, s in zip(words, stay.tolist()) if s]
        left = b" ".join(words)
        told = "".join(f"{a},{b},{c}\n" for a, b, c in own)
        cells = (len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
        for c, x in zip(out, cells):
            c.append(x)
        if with_text:
            lists.append([{"start": a, "length": b, "period": c} for a, b, c in own])
            kept.append(left.decode())
    arrays = [ids, *(pa.array(c, pa.int64()) for c in out[:5]), *(pa.array(c, pa.string()) for c in out[5:])]
    names = list(NAMES)
    if with_text:
        arrays += [pa.array(lists, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(kept, pa.string())]
        names += ["runs", "collapsed"]
    return pa.RecordBatch.from_arrays(arrays, names)


def _searched(batches, shortest: int, tails: bool, with_text: bool):
    for batch in batches:
        for part, texts in rows(batch):
            words = [t.split() for t in texts]
            if tails:
                words = [periodic_tail(w, d) for w, d in zip(words, ints(part, "did"))]
            of = np.cumsum([len(w) for w in words]) // AT_ONCE
            cut = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(words)]
            for x, y in zip(cut, cut[1:]):
                if x < y:
                    yield _found(part.column(0).slice(x, y - x), words[x:y], shortest, with_text)


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, tails: bool = False, with_text: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text, ...): doc_id, n_runs, the greatest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256.

    with_text adds runs (start, length, period of each) and collapsed (the words without what runs
    repeat, joined by one space). Words are what stands between [\\x20\\x09-\\x0D], numbered from 0. A run
    has `shortest` words at least. tails makes the end of some texts periodic first, see periodic_tail.
    A null text is empty and has no run: four nulls. Repeated rows are searched one by one; a null
    doc_id is kept, and its text as it is; extra columns are ignored. One scan, no shuffle; a text is
    searched whole, with some 4 bytes a word for each doubling of its longest repeat.
    """
    given = docs.select("doc_id", F.col("doc_id").cast("long").alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    more = ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" * with_text
    return in_arrow(given, lambda it: _searched(it, shortest, tails, with_text), schema + more)
