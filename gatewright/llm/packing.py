"""Packing: documents as token sequences of several context sizes, without padding but for a few tokens a task.

Each task reads its documents, encodes them and packs as it goes, so nothing is shuffled and
memory is bounded by a buffer. Whole windows of the longest context leave at once. What is left
of a document is routed to a tier: the least power of two that holds it. Each tier is packed into
windows of its size, the longest tier first: its longest piece opens a window, the gap is filled with the
longest pieces of shorter tiers that fit, and at last with the head of a piece that is cut, whose rest is
routed anew. Windows of a tier are then dealt to step groups of equal token count so that attention
work (the sum of squared lengths) is even.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_right, insort
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import rows
from gatewright.session import in_arrow

#: Texts of these characters only are split alike by both libraries, whatever their Unicode tables.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")


@lru_cache(4)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def _fast(path: str):
    """The same vocabulary in tiktoken, if the rank file lies beside it: equal ids at a fifth of the time."""
    import public_tokenizers
    import tiktoken

    beside = re.sub(r"\.json$", ".tiktoken", path)
    if beside == path or not os.path.exists(beside):
        return None
    with open(beside, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _special(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in _slow(path).get_added_tokens_decoder().values())


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of text by the tokenizer file at path, without added special tokens."""
    fast = _fast(path)
    if fast is not None and PLAIN.fullmatch(text) and not any(s in text for s in _special(path)):
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its pattern runs out of stack on very long runs of blanks
            pass
    return np.array(_slow(path).encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Packs pieces (document, start, ids) into windows; see the module's text."""

    def __init__(self, window: int, smallest: int, buffer: int, step_tokens: int, first_id: int):
        self.window, self.smallest, self.buffer, self.step_tokens = window, smallest, buffer, step_tokens
        self.next_sequence = self.next_group = first_id
        self.held, self.waiting, self.order, self.ready = 0, 0, 0, []
        #: Tier: its pieces (length, order, document, start, ids), by length.
        self.tiers: dict[int, list] = {}
        size = window
        while size >= smallest:
            self.tiers[size] = []
            size //= 2

    def add(self, document, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for i in range(0, whole, self.window):
            self.ready.append((self.window, [(document, i, ids[i : i + self.window])]))
        self._route(document, whole, ids[whole:])
        self.held += len(ids)

    def _tier(self, length: int) -> int:
        return max(self.smallest, 1 << (length - 1).bit_length())

    def _route(self, document, start: int, ids: np.ndarray) -> None:
        if len(ids):
            self.order += 1
            self.waiting += 1
            insort(self.tiers[self._tier(len(ids))], (len(ids), self.order, document, start, ids))

    def _take(self, tier: int, at: int, gap: int) -> tuple:
        """A piece of a tier, or its head where it is longer than the gap."""
        _, _, document, start, ids = self.tiers[tier].pop(at)
        self.waiting -= 1
        self._route(document, start + gap, ids[gap:])
        return document, start, ids[:gap]

    def _filler(self, tier: int, gap: int) -> tuple | None:
        """The longest piece of shorter tiers that fits, or the head of the shortest one, or of the shortest of the tier itself."""
        size = min(tier // 2, self._tier(gap))
        while size >= self.smallest:
            if (at := bisect_right(self.tiers[size], (gap, float("inf"))) - 1) >= 0:
                return self._take(size, at, gap)
            size //= 2
        size = self.smallest
        while size <= tier:
            if self.tiers[size]:
                return self._take(size, 0, gap)
            size *= 2
        return None

    def _opened(self, tier: int) -> tuple[list, int]:
        """A window of a tier: its pieces, and the gap that is left when nothing waits any more."""
        pieces = [self._take(tier, -1, tier)]
        gap = tier - len(pieces[0][2])
        while gap and (piece := self._filler(tier, gap)) is not None:
            pieces.append(piece)
            gap -= len(piece[2])
        return pieces, gap

    def _last(self, pieces: list) -> None:
        """What remains at the end of a task goes to full windows of powers of two, and one of fewer than `smallest` ids."""
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = min(left, max(self.smallest, 1 << (left.bit_length() - 1)))
            left, own = left - size, []
            while size:
                document, start, ids = pieces.pop(0)
                if len(ids) > size:
                    pieces.insert(0, (document, start + size, ids[size:]))
                own.append((document, start, ids[:size]))
                size -= len(own[-1][2])
            self.ready.append((self._tier(sum(len(x[2]) for x in own)), own))

    def full(self) -> bool:
        return self.held >= self.buffer

    def flush(self, last: bool = False):
        """Windows as (sequence, group, tier, pieces); without `last`, pieces of the shorter tiers may stay for later gaps."""
        reserve = 0 if last else self.buffer // 256
        for tier, queue in self.tiers.items():
            while queue and (tier == self.window or self.waiting > reserve):
                pieces, gap = self._opened(tier)
                if not gap:
                    self.ready.append((tier, pieces))
                elif last:
                    self._last(pieces)
                else:
                    for piece in pieces:
                        self._route(*piece)
                    break
        out = []
        for tier in sorted({t for t, _ in self.ready}, reverse=True):
            own = sorted((p for t, p in self.ready if t == tier), key=lambda p: -sum(len(x[2]) ** 2 for x in p))
            size = max(1, self.step_tokens // tier)
            groups = [(0, self.next_group + i, size) for i in range(-(-len(own) // size))]
            self.next_group += len(groups)
            heapify(groups)
            for pieces in own:  # the heaviest window to the lightest group with room
                work, group, room = heappop(groups)
                out.append((self.next_sequence, group, tier, pieces))
                self.next_sequence += 1
                if room > 1:
                    heappush(groups, (work + sum(len(x[2]) ** 2 for x in pieces), group, room - 1))
        self.held, self.ready = sum(p[0] for queue in self.tiers.values() for p in queue), []
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _pack(batches, path: str, window: int, smallest: int, buffer: int, step_tokens: int, end_id: int, with_ids: bool):
    packer = Packer(window, smallest, buffer, step_tokens, TaskContext.get().partitionId() << 40)

    def batch_of(windows):
        cols: list[list] = [[] for _ in range(9)]
        ids = []
        for sequence, group, tier, pieces in windows:
            offset = 0
            for (doc, total), start, own in pieces:
                for c, v in zip(cols, (doc, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), total, sequence, offset, tier, group)):
                    c.append(v)
                ids.append(own)
                offset += len(own)
        arrays = [pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(cols)]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        if with_ids:
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), flat))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for part, texts in rows(batch, 64):
            for doc, text in zip(part.column(0).to_pylist(), texts):
                ids = np.append(token_ids(text.decode(), path), np.uint32(end_id))
                packer.add((doc, len(ids)), ids)
            if packer.full():
                yield batch_of(packer.flush())
    yield batch_of(packer.flush(last=True))


def pack_documents(
    docs: DataFrame, path: str, window: int = 1024, smallest: int = 16, buffer: int = 262_144, step_tokens: int = 8192, end_id: int = 0, with_ids: bool = True
) -> DataFrame:
    """Pieces of docs (doc_id, text, ...) in their windows: SCHEMA, and with_ids the ids.

    A document's ids are those of the tokenizer file at `path`, then end_id; a null text counts
    as empty. Each id lies in one piece; `start` counts the ids of its document before it,
    `offset` those of its sequence. A sequence is full, or a power of two long, but for one of
    fewer than `smallest` ids a task. sequence_id and step_group are unique over the corpus. A
    null doc_id is kept; repeated rows are documents of their own; extra columns are ignored.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return in_arrow(given, 
        lambda it: _pack(it, path, window, smallest, buffer, step_tokens, end_id, with_ids), SCHEMA + ", ids array<int>" * with_ids
    )
