"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, phrases of phrases, and so on. On each level runs of one symbol
become one symbol; deterministic coin tossing against the left neighbour turns symbols into
labels below six within four rounds; a phrase begins at each local maximum of the labels and is
named by a hash of its symbols. Boundaries depend on a few neighbours alone, so equal
substrings are parsed alike inside, whatever stands before them. The fingerprint keeps the
smallest hashes of all names from the second level up, and likeness is the share of common
names among the smallest of two fingerprints.

All texts of a batch are parsed in one numpy pass; the first symbol of a text tosses against
its own complement, so no text sees another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import ints, keyed, public_id
from gatewright.session import in_arrow

U = np.uint64
#: Powers of an odd number, for the place of a symbol in its phrase.
POWER = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, U), dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _toss_table(n: int) -> np.ndarray:
    """[a, b] -> twice the lowest bit in which a and b differ, plus a's bit there; for a, b < n."""
    a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    low = np.bitwise_count(((a ^ b) & -(a ^ b)) - 1) * (a != b)
    return (2 * low + ((a >> low) & 1)).astype(np.uint8)


TOSS = _toss_table(256)
#: Names of bytes, which are the symbols of the first level.
BYTES = mix(np.arange(256, dtype=U))


def _settled(label: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """Labels after so many rounds of tossing small labels, of which neighbours in a text differ."""
    for _ in range(rounds):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ 1
        label = TOSS[label, left]
    return label


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 of symbols x, of which neighbours in a text differ; first: where texts begin."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]
    differ = x ^ left
    low = np.bitwise_count((differ & (~differ + U(1))) - U(1)).astype(U)
    label = (low.astype(np.uint8) << 1) | ((x >> low) & U(1)).astype(np.uint8)
    return _settled(label, first, 3)  # 128 -> 14 -> 8 -> 6


def parse(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of symbols x (bytes or 64-bit names) and where each text's phrases start.

    starts: where each text starts in x, and len(x) at the end; an empty text starts where the next does.
    """
    if not len(x):
        return x.astype(U), starts
    first = np.zeros(len(x), bool)
    first[starts[:-1][starts[:-1] < starts[1:]]] = True
    # Runs.
    head = first.copy()
    head[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(head)
    size = np.diff(at, append=len(x))
    starts = np.searchsorted(at, starts)
    first, symbols = first[at], x[at]
    # Neighbouring runs are of different symbols, so those can be tossed as they are.
    label = _settled(symbols, first, 3) if symbols.dtype == np.uint8 else _labels(symbols, first)
    x = BYTES[symbols] if symbols.dtype == np.uint8 else symbols
    longer = size > 1
    x[longer] = mix(x[longer] + size[longer].astype(U) * U(0xD6E8FEB86659FD93))
    # Phrases.
    begin = first.copy()
    if len(x) > 2:
        begin[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:] & ~first[:-2]
    at = np.flatnonzero(begin)
    size = np.diff(at, append=len(x))
    place = np.arange(len(x)) - np.repeat(at, size)
    names = mix(np.add.reduceat(x * POWER[place], at) + size.astype(U))
    return names, np.searchsorted(at, starts)


def sketches(texts: list[bytes], size: int = 64) -> list[np.ndarray]:
    """Fingerprint of each text: at most `size` smallest 32-bit hashes of its names, ascending; none for an empty text."""
    x = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    x, starts = parse(x, starts)
    keys, live = [], np.arange(len(texts))
    level = 2
    while len(live):
        x, starts = parse(x, starts)
        count = np.diff(starts)
        owner = np.repeat(live, count)
        keys.append((owner.astype(U) << U(32)) | (mix(x + U(level)) >> U(32)))
        more = count > 1
        if not more.any():
            break
        x = x[np.repeat(more, count)]
        live, starts, level = live[more], np.concatenate([[0], np.cumsum(count[more])]), level + 1
    keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, U)
    ends = np.searchsorted(keys, (np.arange(len(texts) + 1).astype(U)) << U(32))
    low = (keys & U(0xFFFFFFFF)).astype(np.uint32)
    return [low[i : min(i + size, j)] for i, j in zip(ends[:-1], ends[1:])]


def likeness(a: np.ndarray, b: np.ndarray, size: int = 64) -> float:
    """Estimate of the Jaccard likeness of the names of two texts: the common share of the smallest of both; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    new = np.concatenate([[True], ~twice])
    rank = np.cumsum(new)
    return float(np.count_nonzero(twice & (rank[1:] <= size)) / min(size, rank[-1]))


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first code points of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket_of(did: np.ndarray, th: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The last of the ranges, given by their first keys (did, th) in order, that begins at a key or before it."""
    low, high = np.searchsorted(firsts[0], did, "left"), np.searchsorted(firsts[0], did, "right")
    out = low - 1
    one = np.flatnonzero(high - low == 1)
    out[one] += th[one] >= firsts[1][low[one]]
    for i in np.unique(low[high - low > 1]).tolist():  # ids with several ranges
        own = np.flatnonzero((low == i) & (high - low > 1))
        out[own] += np.searchsorted(firsts[1][i : high[own[0]]], th[own], "right")
    return np.maximum(out, 0)


def _dealt(batches, shared):
    """Rows with their bucket; a first row of a bucket also goes to the one before it, as a guest (1), the very first to the last (2)."""
    firsts = shared.value
    sent: set[tuple[int, int]] = set()  # of rows that are equal, each task sends one
    for batch in batches:
        did, th = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("did", "th"))
        own = _bucket_of(did, th, firsts)
        leads = np.flatnonzero((did == firsts[0][own]) & (th == firsts[1][own]))
        take, bucket, guest = [np.arange(len(did))], [own], [np.zeros(len(did), np.int32)]
        for i in leads.tolist():
            key = int(did[i]), int(th[i])
            if key not in sent:
                sent.add(key)
                take.append([i]), bucket.append([own[i] - 1 if own[i] else len(firsts[0]) - 1]), guest.append([1 if own[i] else 2])
        rows = batch.take(pa.array(np.concatenate(take).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(bucket).astype(np.int64)), pa.array(np.concatenate(guest).astype(np.int32))], ["did", "th", "text", "bucket", "guest"])


#: Bytes of text that are parsed in one pass, and that one task has in all.
AT_ONCE, RANGE = 300_000, 64_000_000


def _fingerprints(batches, with_text: bool):
    """Of rows by bucket and order: each row that is no guest, with the one after it."""
    names = ["did", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] + ["edited"] * with_text

    def run(held: list):
        texts = [r[0].decode() for r in held]
        pairs = [i for i in range(len(held) - 1) if held[i][1] == held[i + 1][1] and not held[i][2]]
        changed = [edited(texts[i], texts[i + 1]).encode() for i in pairs]
        found = sketches([r[0] for r in held] + changed)
        own, new = found[: len(held)], found[len(held) :]
        cols = [
            pa.array([held[i][3] for i in pairs], pa.int64()), pa.array([len(texts[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()), pa.array([written(own[i]) for i in pairs], pa.string()), pa.array([written(s) for s in new], pa.string()),
            pa.array([likeness(own[i], s) for i, s in zip(pairs, new)], pa.float64()), pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
        ]
        if with_text:
            cols.append(pa.array([c.decode() for c in changed], pa.string()))
        return pa.RecordBatch.from_arrays(cols, names)

    held, size = [], 0
    for batch in batches:
        text, bucket, guest, did = batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), batch.column(4).to_pylist(), ints(batch, "did")
        for i in range(batch.num_rows):
            held.append((text[i].as_py(), bucket[i], guest[i], did[i]))
            size += len(held[-1][0])
            if size >= AT_ONCE and len(held) > 1:
                yield run(held)
                held, size = held[-1:], len(held[-1][0])
    if held:
        yield run(held)


def fingerprint_documents(docs: DataFrame, buckets: int | None = None, with_text: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text, ...): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (and with_text, edited).

    The edited text has its last half replaced by the head of the next document, by ascending
    doc_id; after the last comes the first. A null doc_id comes before all others, repeated rows
    of a doc_id follow each other by their texts' hashes. A null text is empty; the likeness of
    two empty texts is 1, of an empty and another 0. Extra columns are ignored.

    Rows are dealt to ranges of some RANGE bytes of text, by doc_id and hash of the text; keys alone are ordered
    first, to find where ranges begin. Each text moves once; the first row of a range is also sent to the range
    before it, as that one's last next. What the driver sends to tasks is the first key of each range, 16 bytes
    for every RANGE of text (25 MB for 100 TB). Jobs that find them run when this is called.
    """
    base, spark = keyed(docs), docs.sparkSession
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    ranges = base.select("did", "th").repartitionByRange(n, "did", "th").groupBy(F.spark_partition_id().alias("i")).agg(F.min(F.struct("did", "th")).alias("r"))
    first = sorted((r.r.did, r.r.th) for r in ranges.collect())  # one row a range
    shared = spark.sparkContext.broadcast(np.array(first, np.int64).reshape(-1, 2).T.copy())
    dealt = in_arrow(base, lambda it: _dealt(it, shared), "did long, th long, text string, bucket long, guest int")
    sorted_rows = dealt.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", "did", "th")
    schema = "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = in_arrow(sorted_rows, lambda it: _fingerprints(it, with_text), schema + ", edited string" * with_text)
    return out.select(public_id().alias("doc_id"), *[c for c in out.columns if c != "did"])
