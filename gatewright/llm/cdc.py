"""Content-defined chunking with a gear rolling hash, over many texts in one numpy pass."""

from __future__ import annotations

import numpy as np

#: The gear hash of a byte sees this many bytes: itself and those before it.
WINDOW = 16
GEAR = np.random.default_rng(20_240_229).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """For each byte of data (uint8), the sum of GEAR[data[i - k]] << k for k < WINDOW, by doubling."""
    h = GEAR[data]
    reach = 1
    while reach < WINDOW:
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h = longer
        reach *= 2
    return h


def cuts(texts: list[bytes], bits: int, least: int, most: int) -> list[list[int]]:
    """For each text the ends of its chunks: after a byte whose hash has `bits` high zero bits, once
    `least` bytes are in the chunk, else at `most` bytes or the end. An empty text has no chunk.

    A cut depends on the bytes of its own text alone, as `least` is at least WINDOW.
    """
    assert WINDOW <= least <= most
    data = np.frombuffer(b"".join(texts), np.uint8)
    where = np.flatnonzero(gear(data) < np.uint32(1 << (32 - bits))) + 1 if len(data) else np.empty(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    first = np.searchsorted(where, ends - sizes, "right")
    last = np.searchsorted(where, ends, "right")
    out = []
    for size, end, i, j in zip(sizes.tolist(), ends.tolist(), first.tolist(), last.tolist()):
        base, start, own = end - size, 0, []
        for at in (where[i:j] - base).tolist():
            while at - start > most:
                start += most
                own.append(start)
            if at - start >= least:
                start = at
                own.append(at)
        while size - start > most:
            start += most
            own.append(start)
        if size > start:
            own.append(size)
        out.append(own)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i that has so many, by doubling."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def least_cuts(texts: list[bytes], radius: int) -> list[np.ndarray]:
    """For each text the ends of its chunks: after a byte whose gear hash is the least within `radius` bytes, and the end.

    Of equal least hashes, which repeat with the text, each is a cut that lies over `radius` after
    the cut before: periodic text is cut at one place of its period, into equal chunks.

    A cut needs `radius` bytes after it and `radius` + WINDOW before it in its text, and sees no
    others, so equal passages are cut alike inside. Chunks are over `radius` long and about twice
    that on average; there is no longest chunk, and so no cut that depends on where a text starts.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    where = np.empty(0, np.int64)
    if len(data) > 2 * radius + 1:
        h = gear(data)
        least = sliding_min(h, radius)
        middle = np.arange(radius, len(data) - radius)
        where = middle[(h[middle] <= least[: len(middle)]) & (h[middle] <= least[radius + 1 :][: len(middle)])]
    of = np.searchsorted(ends, where, "right")
    fits = (where - (ends - sizes)[of] >= radius + WINDOW) & (ends[of] - where > radius)
    where, of = where[fits] + 1, of[fits]
    close = np.flatnonzero((np.diff(where) <= radius) & (np.diff(of) == 0)) + 1
    if len(close):
        stays, last, before = np.ones(len(where), bool), 0, -1
        for k in close.tolist():
            last = last if k - 1 == before else where[k - 1]
            stays[k] = where[k] - last > radius
            last, before = where[k] if stays[k] else last, k
        where, of = where[stays], of[stays]
    first, last = np.searchsorted(of, np.arange(len(texts))), np.searchsorted(of, np.arange(len(texts)), "right")
    return [np.append(where[i:j] - (end - size), size) if size else where[:0] for size, end, i, j in zip(sizes.tolist(), ends.tolist(), first.tolist(), last.tolist())]
