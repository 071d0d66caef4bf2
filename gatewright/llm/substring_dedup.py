"""Substring dedup: content-defined chunks, each kept once in the corpus.

Cuts stand where a gear rolling hash is least within a radius, so they move with the text and an
insertion changes the chunks around it only. Chunks are known by a 128-bit digest. A digest in
several documents stays in the smallest doc_id that holds it; of repeats in one document the
first stays. Runs of dropped chunks that are short in bytes and in words are kept, so that a phrase
which two documents share by chance is left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.cdc import least_cuts
from gatewright.llm.common import NULL_ID, ints, keyed, public_id, rows, skew_join
from gatewright.session import in_arrow

#: Bytes on either side of a cut among which its hash is least: chunks of 49 bytes on average.
RADIUS = 24
#: Bytes of the shortest run of chunks that is dropped: a passage of fifty words has over twice as many, a stock line fewer.
SHORTEST = 120
#: Words of a run that is dropped however few bytes it has: what is left of fifty short words once both ends are lost to cuts that see other bytes.
FEWEST = 15


def chunk_digests(texts: list[bytes], radius: int = RADIUS) -> list[tuple[list[int], list[bytes]]]:
    """The ends of each text's chunks, and their digests."""
    digest = xxhash.xxh3_128_digest
    out = []
    for text, ends in zip(texts, least_cuts(texts, radius)):
        own = ends.tolist()
        out.append((own, [digest(text[i:j]) for i, j in zip([0, *own], own)]))
    return out


def _as_longs(digests: list[bytes]) -> list[np.ndarray]:
    h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [h[:, 0], h[:, 1]]


def _digests(batches, radius: int):
    """(did, holder, th, h1, h2), each digest once a row; chunks no longer than the radius are too common to tell anything."""
    names = ("did", "holder", "th")
    for batch in batches:
        for part, texts in rows(batch):
            sets = [{h for h, i, j in zip(own, [0, *ends], ends) if j - i > radius} for ends, own in chunk_digests(texts, radius)]
            which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            keys = [part.column(part.schema.get_field_index(c)).take(pa.array(which)) for c in names]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, _as_longs([h for s in sets for h in s]))], [*names, "h1", "h2"])


def kept_ranges(text: bytes, ends: list[int], digests: list[bytes], shared: set[bytes], radius: int, shortest: int, fewest: int) -> list[tuple[int, int]]:
    """Byte ranges that stay: all but runs, of `shortest` bytes or `fewest` words or more, of chunks that are shared or were met before in the text."""
    kept, seen, start, run = [], set(), 0, None
    goes = lambda i, j: j - i >= shortest or len(text[i:j].split()) >= fewest
    for h, i, j in zip(digests, [0, *ends], ends):
        if h in shared or h in seen:
            run = i if run is None else run
        else:
            if run is not None and goes(run, i):
                kept.append((start, run))
                start = i
            run = None
        if j - i > radius:
            seen.add(h)
    size = ends[-1] if ends else 0
    if run is not None and goes(run, size):
        return [*kept, (start, run)]
    return [*kept, (start, size)]


def _whole(text: bytes, i: int, j: int) -> tuple[int, int]:
    """The range without the bytes of a code point that is cut in two; those go."""
    while i < j and text[i] & 0xC0 == 0x80:
        i += 1
    k = j
    while k > i and j < len(text) and text[j] & 0xC0 == 0x80 and text[k - 1] & 0xC0 == 0x80:
        k -= 1
    if k > i and j < len(text) and text[j] & 0xC0 == 0x80:
        k -= 1
    return i, k


def _reassembled(batches, radius: int, shortest: int, fewest: int):
    for batch in batches:
        for part, texts in rows(batch):
            at = part.schema.get_field_index("drop")
            size, removed, spans, kept = [], [], [], []
            for text, (ends, digests), drop in zip(texts, chunk_digests(texts, radius), part.column(at).to_pylist()):
                shared = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in drop or ()}
                ranges = [_whole(text, i, j) for i, j in kept_ranges(text, ends, digests, shared, radius, shortest, fewest)]
                ranges = [(i, j) for i, j in ranges if i < j]
                left = b"".join([text[i:j] for i, j in ranges])
                size.append(len(text))
                removed.append(len(text) - len(left))
                gaps = [ranges[0][0] > 0, *(a[1] < b[0] for a, b in zip(ranges, ranges[1:])), ranges[-1][1] < len(text)] if ranges else [len(text) > 0]
                spans.append(sum(gaps))
                kept.append(left.decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ints(part, "did"), pa.int64()), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(kept, pa.string())],
                ["did", "n_bytes", "n_removed", "n_spans", "kept_text"],
            )


def _held_before(found: DataFrame) -> DataFrame:
    """Of (did, holder, th, h1, h2): the digests (did, th, h1, h2) that a smaller (did, holder) has too."""
    whose = F.struct("did", "holder")
    keepers = found.groupBy("h1", "h2").agg(F.min(whose).alias("keeper"), F.max(whose).alias("other"))
    shared = keepers.where("keeper < other").select("h1", "h2", "keeper")
    return skew_join(found, shared, ["h1", "h2"]).where(whose > F.col("keeper")).select("did", "th", "h1", "h2")


def substring_dedup(docs: DataFrame, radius: int = RADIUS, shortest: int = SHORTEST, fewest: int = FEWEST, by_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_text of each row of docs (doc_id, text, ...), in UTF-8 bytes.

    A null or empty text stays empty. Repeated rows of one doc_id count as one holder of their
    chunks, so all of them keep what that doc_id keeps; a null doc_id counts as the smallest. Rows without
    an id are one holder as well, or, with by_text, one for each text, by the text's hash. A code point
    cut in two by a removed run is removed whole. Extra columns are ignored. Digests go back to the texts
    they are of, so no list has more of them than its text.
    """
    base = keyed(docs)
    holder = F.when((F.col("did") == NULL_ID) & F.lit(by_text), F.col("th")).otherwise(F.lit(0).cast("long"))
    found = in_arrow(base.select("did", holder.alias("holder"), "th", "text"), lambda it: _digests(it, radius), "did long, holder long, th long, h1 long, h2 long")
    drops = _held_before(found).groupBy("did", "th").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
    out = base.join(drops, ["did", "th"], "left").mapInArrow(
        lambda it: _reassembled(it, radius, shortest, fewest), "did long, n_bytes long, n_removed long, n_spans long, kept_text string"
    )
    return out.select(public_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_text")
