"""Prefix-free parsing of a corpus in one process: dictionary, parse, their suffix arrays, and the corpus order.

A second way to the result of the repeats operator, for tests and to measure what the order costs.
"""

import numpy as np

#: Bytes of a trigger, and one in how many places is one.
TRIGGER, EVERY = 8, 64


def ranks_of(symbols, left):
    """Ranks of the suffixes of symbols by prefix doubling, each up to `left` symbols further; equal ones share a rank."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while len(left) and reach <= left.max() and rank.max() < len(rank) - 1:
        after = np.full(len(rank), -1, np.int64)
        goes = np.flatnonzero(left >= reach)
        after[goes] = rank[goes + reach]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1]
        reach *= 2
    return rank


def parsed(texts):
    """The corpus as numbers, a separator of its own after each text; where phrases start and end. Phrases overlap by a trigger."""
    parts = []
    for k, t in enumerate(texts):
        parts += [np.frombuffer(t, np.uint8).astype(np.int64), [256 + k]]
    corpus = np.concatenate(parts) if parts else np.empty(0, np.int64)
    h = np.zeros(max(0, len(corpus) - TRIGGER + 1), np.uint64)
    for i in range(TRIGGER):
        h = h * np.uint64(0x9E3779B97F4A7C15) + corpus[i : len(corpus) - TRIGGER + 1 + i].astype(np.uint64)
    h ^= h >> np.uint64(29)
    cut = np.flatnonzero(h % np.uint64(EVERY) == 0)
    starts = np.unique(np.concatenate([[0], cut]))
    ends = np.append(starts[1:] + TRIGGER, len(corpus))
    return corpus, starts, ends


def corpus_order(corpus, starts, ends):
    """(order, sizes): places of the corpus in the order of their suffixes, and the symbols of corpus, dictionary and parse."""
    phrases = [corpus[i:j].tobytes() for i, j in zip(starts, ends)]
    dictionary = sorted(set(phrases), key=lambda p: np.frombuffer(p, np.int64).tolist())
    number = {p: k for k, p in enumerate(dictionary)}
    parse = np.array([number[p] for p in phrases])
    # The parse: its suffixes in order; the phrases are numbered in their own.
    after = np.append(ranks_of(parse, np.arange(len(parse))[::-1]), -1)
    # The dictionary: one text, a least symbol after each phrase, at which comparison ends. Suffixes of over a trigger are prefix-free.
    sizes = np.array([len(p) // 8 for p in dictionary])
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.full(at[-1], -1, np.int64)
    for p, i, n in zip(dictionary, at, sizes):
        flat[i : i + n] = np.frombuffer(p, np.int64)
    named = ranks_of(flat, np.repeat(at[1:] - 1, sizes + 1) - np.arange(at[-1]))
    # Each place belongs to the phrase whose suffix from there is longer than a trigger.
    k = np.searchsorted(starts, np.arange(len(corpus)), "right") - 1
    place = at[parse[k]] + np.arange(len(corpus)) - starts[k]
    return np.lexsort((after[k + 1], named[place])), (len(corpus), int(sizes.sum()), len(parse))


def repeated_starts(texts, length):
    """For each text the starts of windows of `length` bytes that start anywhere else too, told by neighbours in the corpus order."""
    corpus, starts, ends = parsed(texts)
    order, _ = corpus_order(corpus, starts, ends)
    twice = np.zeros(len(corpus), bool)
    for i, j in zip(order, order[1:]):
        a, b = corpus[i : i + length], corpus[j : j + length]
        if len(a) == len(b) == length and (a == b).all() and a.max() < 256:
            twice[i] = twice[j] = True
    at, out = 0, []
    for t in texts:
        out.append(np.flatnonzero(twice[at : at + len(t)]))
        at += len(t) + 1
    return out
