"""Which sets of hashes can be alike to another one at all: those most of whose members others have too.

Of sets A and B with a Jaccard similarity of 0.8 or more, at most a fifth of A is not in B. So of the
members of A below HALF, of which B has the same ones, all but a fifth of A at most must occur in other
sets. What does not is alike to none; nothing that could be is left out.

A task counts what its own sets share by itself and sends each hash once, so a hash that a third of all
sets have is as many rows as tasks have buffers. Rows are packed by range of the hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gatewright.session import in_arrow

#: Hashes below it are counted: half of them.
HALF = np.uint64(1 << 63)
#: Hashes that a task holds before it sends them, and that a range has.
HELD, RANGE = 2_000_000, 1_000_000
#: The top bit of a hash says that its sender has it in several sets, which have been told already.
ROW = np.dtype([("hash", "<u8"), ("sid", "<i8")])


def counted(found: np.ndarray) -> np.ndarray:
    """Those of a sorted set that are counted."""
    return found[: np.searchsorted(found, HALF)]


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows by hash, where each hash begins, and whether several sets have it."""
    rows = rows[np.argsort(rows["hash"] & ~HALF, kind="stable")]
    hashes = rows["hash"] & ~HALF
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(rows) else np.empty(0, np.int64)
    if not len(rows):
        return rows, first, np.empty(0, bool)
    known = np.logical_or.reduceat(rows["hash"] >= HALF, first) & (np.diff(np.append(first, len(rows))) > 1)
    return rows, first, known | (np.minimum.reduceat(rows["sid"], first) != np.maximum.reduceat(rows["sid"], first))


def _told(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sid and how many of its hashes others have; those marked as known have been told."""
    rows, first, several = _groups(rows)
    shared = np.repeat(several, np.diff(np.append(first, len(rows)))) & (rows["hash"] < HALF)
    return np.unique(rows["sid"][shared], return_counts=True)


def packed(hashes: list[np.ndarray], sids: list[int], parts: int) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray]]:
    """Rows by range of the hash, each hash once, and (sid, count) of what is shared here."""
    rows = np.empty(sum(map(len, hashes)), ROW)
    rows["hash"], rows["sid"] = np.concatenate(hashes), np.repeat(np.array(sids, np.int64), [len(h) for h in hashes])
    told = _told(rows)
    rows, first, several = _groups(rows)
    out = rows[first]
    at = (out["hash"] >> np.uint64(31)) * np.uint64(parts) >> np.uint64(32)
    out["hash"] |= np.where(several, HALF, np.uint64(0))
    cut = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))
    return [out[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], told


def send(sets, parts: int):
    """Record batches (part, told, rows) of sets, an iterator of (sid, counted hashes). Told rows have a count in place of a hash."""
    held, sids, size, turn = [], [], 0, 0

    def flush():
        blobs, (sid, count) = packed(held, sids, parts)
        tell = np.empty(len(sid), ROW)
        tell["hash"], tell["sid"] = count, sid
        some = [p for p, b in enumerate(blobs) if b]
        return pa.RecordBatch.from_arrays(
            [pa.array([*some, turn % parts], pa.int32()), pa.array([*[False] * len(some), True]), pa.array([*[blobs[p] for p in some], tell.tobytes()], pa.binary())], ["part", "told", "rows"]
        )

    for sid, hashes in sets:
        if not len(hashes):
            continue
        if not held:
            turn = int(hashes[0] & np.uint64(0x7FFFFFFF))  # some part
        held.append(hashes), sids.append(sid)
        size += len(hashes)
        if size >= HELD:
            yield flush()
            held, sids, size = [], [], 0
    if held:
        yield flush()


def _dealt(sid: np.ndarray, count: np.ndarray, parts: int) -> pa.RecordBatch:
    """Counts of sets, packed by range of the sid."""
    order = np.argsort(sid.view(np.uint64), kind="stable")
    rows = np.empty(len(sid), ROW)
    rows["hash"], rows["sid"] = count[order], sid[order]
    cut = np.searchsorted(rows["sid"].view(np.uint64) >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
    some = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[cut[p] : cut[p + 1]].tobytes() for p in some.tolist()], pa.binary())], ["part", "rows"])


def _received(batches, parts: int):
    """Of rows by range of the hash, one range behind the other: how many hashes of a set others have, by range of the sid."""
    held, part = [], None

    def ended():
        return _dealt(*_told(np.frombuffer(b"".join(held), ROW)), parts)

    for batch in batches:
        for p, told, blob in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "told", "rows"))):
            if told:
                rows = np.frombuffer(blob, ROW)
                yield _dealt(rows["sid"].copy(), rows["hash"], parts)
                continue
            if held and p != part:
                yield ended()
                held = []
            part = p
            held.append(blob)
    if held:
        yield ended()


def _summed(batches):
    """(sid, shared) of rows by range of the sid, one range behind the other."""
    held, part = [], None

    def ended():
        rows = np.frombuffer(b"".join(held), ROW)
        sid, own = np.unique(rows["sid"], return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(np.bincount(own, rows["hash"]).astype(np.int64))], ["sid", "shared"])

    for batch in batches:
        for p, blob in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "rows"))):
            if held and p != part:
                yield ended()
                held = []
            part = p
            held.append(blob)
    if held:
        yield ended()


def shared_members(docs: DataFrame, sets_of, total: int) -> DataFrame:
    """(sid, shared): at least as many of each set's counted members as other sets have; sets that share none are left out.

    sets_of turns Arrow batches of docs into (sid, counted members); a set that comes twice is counted twice.
    total is how many members there are, about.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    dealt = in_arrow(docs, lambda it: send(sets_of(it), parts), "part int, told boolean, rows binary")
    grouped = dealt.repartitionById(parts, "part").sortWithinPartitions("part")
    counts = in_arrow(grouped, lambda it: _received(it, parts), "part int, rows binary")
    return in_arrow(counts.repartitionById(parts, "part").sortWithinPartitions("part"), _summed, "sid long, shared long")
