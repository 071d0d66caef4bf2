"""Ball hashing of long SimHashes in blocks: which fingerprints lie close in some block.

A fingerprint has BLOCKS blocks of BITS bits, each bit set if it is set in over half the hashed
shingles. Two that differ in at most two bits of a block have a neighbour within one bit of each:
every fingerprint emits its block with each bit flipped, one with an even count of bits the block
itself too (an odd one meets it there), so no pair within the radius is lost. What shares a
variant is a run; of a run stay those that have another one in it within RADIUS bits of the two
blocks that follow, which is what keeps fingerprints out that meet by chance.

Fingerprints may have labels: those of one label need not meet any more. A run of one label goes, of
any other one stay those that have one of another label so near in it.

Runs of one block and part that have members in common are written as one set of those members, each
once, however many of its variants a fingerprint has met others by.

The share of differing bits is that of the angle between two texts, acos(2J / (1 + J)) / pi for a
Jaccard similarity J: 0.148 at 0.8. README.md has the measured share of pairs that meet.

Variants move in packed rows of 28 bytes, sorted and cut by numpy, some blocks at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import written
from gatewright.session import in_arrow

BLOCKS, BITS, RADIUS = 72, 28, 15
#: A run longer than LONG is searched for fingerprints that met by chance only if at most LONG are not of its main label; else all of it stays.
LONG = 256
#: Variants of a group that is sorted at once, variants of a round, and the blocks a round has at least.
GROUP, AT_ONCE, ROUND = 500_000, 8_000_000, 8
ROW = np.dtype([("key", "<u4"), ("sid", "<i8"), ("label", "<i8"), ("check", "<u8")])

_DRAWN = np.random.default_rng(20_261_126).integers(0, 2**63, (2, -(-BLOCKS * BITS // 64)), dtype=np.uint64)
FLIP, FACTOR, MIX = _DRAWN[0], _DRAWN[1] << np.uint64(1) | np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
FLIPS = np.uint32(1) << np.arange(BITS, dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x *= MIX
    return x ^ x >> np.uint64(29)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The blocks (uint32) of a set of 64-bit hashes: a bit is 1 if it is in over half of them."""
    ones = np.zeros(64 * len(FLIP), np.int64)
    for i in range(0, len(found), 128):
        words = _mixed((found[i : i + 128, None] ^ FLIP) * FACTOR)
        ones += np.unpackbits(words.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return (2 * ones > len(found))[: BLOCKS * BITS].reshape(BLOCKS, BITS) @ FLIPS


def _variants(batches, low: int, high: int, parts: int):
    """Blocks low to high of each fingerprint as packed rows, in parts by the hash of the variant. Without labels each has its own."""
    for batch in batches:
        sid = batch.column(batch.schema.get_field_index("sid")).to_numpy()
        label = batch.column(at).to_numpy() if (at := batch.schema.get_field_index("label")) >= 0 else sid
        prints = batch.column(batch.schema.get_field_index("print")).to_pylist()
        values = np.frombuffer(b"".join(prints), "<u4").reshape(len(sid), BLOCKS)
        each = np.arange(len(sid), dtype=np.uint64)
        for block in range(low, high):
            value = values[:, block]
            after, then = (values[:, (block + i) % BLOCKS].astype(np.uint64) for i in (1, 2))
            check = after << np.uint64(BITS) | then
            even = np.bitwise_count(value) % 2 == 0
            key = np.concatenate([(value[:, None] ^ FLIPS).ravel(), value[even]])
            key = key * np.uint32(0x9E3779B1) & np.uint32(2**BITS - 1)  # one to one; any range of it has its share
            packed = np.sort(key.astype(np.uint64) << np.uint64(32) | np.concatenate([np.repeat(each, BITS), each[even]]))
            key, who = packed >> np.uint64(32), (packed & np.uint64(2**32 - 1)).astype(np.int64)
            out = np.empty(len(key), ROW)
            out["key"], out["sid"], out["label"], out["check"] = key, sid[who], label[who], check[who]
            cut = np.searchsorted(key * np.uint64(parts) >> np.uint64(BITS), np.arange(parts + 1, dtype=np.uint64))
            blobs = pa.Array.from_buffers(pa.binary(), parts, [None, pa.py_buffer((cut * ROW.itemsize).astype(np.int32)), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(parts, block, np.int32)), pa.array(np.arange(parts, dtype=np.int32)), blobs], ["block", "part", "rows"])


def _long(stay: np.ndarray, label: np.ndarray, check: np.ndarray) -> None:
    """Sets stay for what a run longer than LONG keeps."""
    kinds, of, count = np.unique(label, return_inverse=True, return_counts=True)
    others = np.flatnonzero(of != np.argmax(count))
    if len(others) > LONG:
        stay[:] = True
        return
    for x in others:
        near = (np.bitwise_count(check ^ check[x]) <= RADIUS) & (label != label[x])
        stay |= near
        stay[x] |= near.any()


def runs(given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, sid and size of the runs of ROWs, each set of members once; the key names the members."""
    packed = np.sort(given["key"].astype(np.uint64) << np.uint64(32) | np.arange(len(given), dtype=np.uint64))
    key, label = packed >> np.uint64(32), given["label"][(packed & np.uint64(2**32 - 1)).astype(np.int64)]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    several = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first) if len(key) else np.empty(0, bool)
    met = np.repeat(several, np.diff(np.append(first, len(key))))
    if not met.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    at, key, label = (packed[met] & np.uint64(2**32 - 1)).astype(np.int64), key[met], label[met]
    run = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    sid, check, size = given["sid"][at], given["check"][at], np.bincount(run)
    stay, ends = np.zeros(len(run), bool), np.cumsum(size)
    for r in np.flatnonzero(size > LONG).tolist():
        i, j = ends[r] - size[r], ends[r]
        _long(stay[i:j], label[i:j], check[i:j])
    left, step = np.flatnonzero(size[run] <= LONG), 1
    while len(left):
        left = left[left + step < len(run)]
        left = left[run[left + step] == run[left]]
        near = left[(np.bitwise_count(check[left] ^ check[left + step]) <= RADIUS) & (label[left] != label[left + step])]
        stay[near] = stay[near + step] = True
        step += 1
    sid, run = sid[stay], run[stay]
    if not len(sid):
        return sid, sid, sid
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    size = np.diff(np.append(first, len(run)))
    name = np.add.reduceat(_mixed(_mixed((sid.view(np.uint64) ^ FLIP[0]) * FACTOR[0]) * FACTOR[1]), first)
    once = np.zeros(len(first), bool)
    once[np.unique(name, return_index=True)[1]] = True
    once = np.repeat(once, size)
    return np.repeat(name, size)[once].view(np.int64), sid[once], np.repeat(size, size)[once]


def joined(key: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, sid and size of what runs (key, sid) with common members make together, each member once: a fingerprint that lies in 29 runs is written once."""
    if not len(key):
        return key, sid, key
    _, run = np.unique(key, return_inverse=True)
    order = np.argsort(run, kind="stable")
    run, own = run[order], sid[order]
    who, member = np.unique(own, return_inverse=True)
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    of = np.arange(len(first))
    while True:
        least = np.full(len(who), len(first))
        np.minimum.at(least, member, of[run])
        new = np.minimum.reduceat(least[member], first)
        new = new[new]
        if (new == of).all():
            break
        of = new
    order = np.argsort(least, kind="stable")
    group, sid = least[order], who[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(group)))
    name = np.add.reduceat(_mixed(_mixed((sid.view(np.uint64) ^ FLIP[0]) * FACTOR[0]) * FACTOR[1]), first)
    return np.repeat(name, size).view(np.int64), sid, np.repeat(size, size)


def _runs(batches):
    """What the runs of each group of rows (block, part) make together; the rows of a group stand one behind the other."""
    held, group = [], None

    def ended():
        key, sid, _ = runs(np.frombuffer(b"".join(held), ROW))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in joined(key, sid)], ["key", "sid", "size"])

    for batch in batches:
        for block, part, blob in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "part", "rows"))):
            if held and group != (block, part):
                yield ended()
                held = []
            group = block, part
            held.append(blob)
    if held:
        yield ended()


def meetings(prints: DataFrame) -> Callable[[int, int, DataFrame | None], DataFrame]:
    """A function of (low, high, labels) for the fingerprints (sid, print; sid once): (key, sid, size), each once, of those that lie close together, or in a chain of such, in some of the blocks low to high, and how many under that key.

    Those of one label (labels: sid, label; each sid once) do not meet; one that has none is labelled by its sid.
    The function runs jobs when it is called: the variants of some blocks are written, met and deleted before the next ones.
    """
    least, rows = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() * (BITS + 1)
    parts, each = max(1, -(-rows // GROUP)), max(ROUND, AT_ONCE // max(1, rows))

    def between(low: int, high: int, labels: DataFrame | None = None) -> DataFrame:
        given = prints
        if labels is not None:
            given = written(prints.join(labels, "sid", "left").select("sid", "print", F.coalesce("label", "sid").alias("label")))
        met = None
        for i in range(low, high, each):
            j = min(high, i + each)
            dealt = in_arrow(given, partial(_variants, low=i, high=j, parts=parts), "block int, part int, rows binary")
            grouped = dealt.repartition(max(least, rows * (j - i) // GROUP), "block", "part").sortWithinPartitions("block", "part")
            found = written(in_arrow(grouped, _runs, "key long, sid long, size long").distinct())
            met = found if met is None else met.unionByName(found)
        return met.distinct()

    return between
