"""Repeated strings: bytes covered by a long string that also starts anywhere else.

A text is parsed at triggers. The trigger of a window (a start and LENGTH bytes) is the last of
its least rolling hashes, so equal windows have it at the same offset, each window has one, and
the windows of a text fall into runs that share one: the phrases. What the corpus order of all
suffixes would tell (which starts have a neighbour with LENGTH bytes in common) is settled for
whole groups of windows by names (hashes) of strings around their trigger, counted over the
corpus, from coarse to fine:

0. the string common to all windows of half a phrase; if it is unique, so are they;
1. for SUB windows at a time, the string common to them (inner) and the string that spans them
   (outer): a unique inner string settles them as unique, a repeated outer one as repeated;
2. the windows that remain, one by one, against each other and against one copy of every outer
   string that was settled as repeated and has an inner string in common with them.

So unique text costs two rows a phrase, repeated text two a phrase and two for each SUB windows,
and only the surroundings of edits are looked at byte by byte. Every count combines on the map
side and every join lets Spark split a skewed key: a passage that is everywhere is in no single task.

Counts over the corpus rest on 128 bits; repeats within one text, the look-up of what was counted, and
the coarse filters, where a clash costs work only, on 64.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.cdc import WINDOW, gear, sliding_min
from gatewright.llm.common import NULL_ID, durable, ints, keyed, public_id, rows, shared_folder, shuffles_freed, skew_join
from gatewright.llm.phrases import mix
from gatewright.session import in_arrow

U = np.uint64
LENGTH, SUB = 400, 32
#: Starts whose triggers are sought in one numpy pass.
AT_ONCE = 1 << 18
TABLES = [np.random.default_rng(seed).integers(0, 2**64, 256, dtype=U) for seed in (101, 202)]
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base, and of its inverse, mod 2**64."""
    if which not in _powers or len(_powers[which][0]) <= n:
        size = max(1 << 16, 2 * n)
        out = []
        for b in (BASES[which], pow(BASES[which], -1, 2**64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _powers[which] = tuple(out)
    return _powers[which]


class Names:
    """Names of substrings of a text, by prefix sums of a polynomial hash."""

    def __init__(self, data: np.ndarray, which: int):
        self.up, down = _power(which, len(data))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(TABLES[which][data] * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size: int, tag) -> np.ndarray:
        h = (self.sums[start + size] - self.sums[start]) * self.up[start]
        return mix(h ^ mix(np.atleast_1d(np.asarray(tag, U)) + U(size << 8)))


class Phrases:
    """Runs of windows of texts that share a trigger: their text, trigger, and least and greatest offset of it in them.

    The texts lie one behind the other in `data`; places are counted there, and windows do not
    leave their text.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.data, self.length = np.frombuffer(b"".join(texts), np.uint8), length
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.salt = mix(np.arange(len(texts), dtype=U) + U(1))
        width = length - WINDOW + 1
        parts = []
        starts = len(self.data) - length + 1
        for i in range(0, max(0, starts), AT_ONCE):
            h = gear(self.data[i : min(i + AT_ONCE, starts) + length - 1])[WINDOW - 1 :]
            place = np.arange(len(h), dtype=U)
            least = sliding_min((h.astype(U) << U(32)) | (U(0xFFFFFFFF) - place), width)
            parts.append((U(0xFFFFFFFF) - (least & U(0xFFFFFFFF))).astype(np.int64) + i)
        trigger = np.concatenate(parts) if parts else np.empty(0, np.int64)
        inside = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(self.begins.tolist(), self.ends.tolist()) if e - b >= length] or [np.empty(0, np.int64)])
        trigger = trigger[inside]
        first = np.flatnonzero(np.diff(trigger, prepend=-1))
        self.trigger = trigger[first]
        self.high = self.trigger - inside[first]  # offset of the trigger in the first window of the run
        self.low = self.trigger - inside[np.append(first[1:], len(trigger))[: len(first)] - 1]
        self.text = np.searchsorted(self.ends, self.trigger, "right")
        self._names: dict[int, Names] = {}

    def names(self, which: int) -> Names:
        if which not in self._names:
            self._names[which] = Names(self.data, which)
        return self._names[which]

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, half, name): for each run and half of the offsets that it has, the string common to all windows of that half."""
        half = (self.length - WINDOW) // 2 // SUB * SUB
        out = []
        for k, (a, b) in enumerate(((0, half - 1), (half, self.length - WINDOW))):
            run = np.flatnonzero((self.low <= b) & (self.high >= a))
            name = self.names(0).of(self.trigger[run] - a, self.length - (b - a), k)
            out.append((run, np.full(len(run), k), name))
        return tuple(np.concatenate(x) for x in zip(*out))

    def blocks(self, known: "Known", outers: int = 1) -> tuple[np.ndarray, ...]:
        """(text, trigger, low, high, inner, outer...) of blocks of SUB offsets in halves whose name is known to repeat.

        low and high are the offsets of the run in the block; the outer names are 0 where the outer string leaves the text.
        """
        half = (self.length - WINDOW) // 2 // SUB * SUB
        run, k, name = self.halves()
        good = known.has(self, self.text[run], name)
        run, k = run[good], k[good]
        low = np.maximum(self.low[run], k * half)
        high = np.minimum(self.high[run], np.where(k == 0, half - 1, self.length))
        first, count = low // SUB, high // SUB - low // SUB + 1
        at = np.repeat(np.arange(len(run)), count)
        block = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        text, trigger = self.text[run][at], self.trigger[run][at]
        low, high = np.maximum(low[at], block * SUB), np.minimum(high[at], block * SUB + SUB - 1)
        inner = self.names(0).of(trigger - block * SUB, self.length - SUB + 1, 16 + block)
        begin = trigger - (block * SUB + SUB - 1)
        fits = (begin >= self.begins[text]) & (begin + self.length + SUB - 1 <= self.ends[text])
        outer = []
        for which in range(outers):
            o = np.zeros(len(begin), U)
            o[fits] = self.names(which).of(begin[fits], self.length + SUB - 1, 64 + block[fits])
            outer.append(np.where(fits & (o == 0), U(1), o))
        return text, trigger, low, high, inner, *outer

    def windows(self, starts: np.ndarray, outers: int = 2) -> list[np.ndarray]:
        return [self.names(which).of(starts, self.length, 0) for which in range(outers)]

    def distinct(self, text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each distinct key of each text first stands, and 1 or, if it stands there more often, 2."""
        _, first, count = np.unique(keys + self.salt[text], return_index=True, return_counts=True)
        return first, np.minimum(count, 2)


class Known:
    """Sets of names, one for each text."""

    def __init__(self, part: pa.RecordBatch, name: str):
        lists = part.column(part.schema.get_field_index(name))
        lists = lists.fill_null([]) if lists.null_count else lists
        self.sizes, self.names = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy().view(U)

    def has(self, phrases: Phrases, text: np.ndarray, names: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(names), bool)
        return np.isin(names + phrases.salt[text], self.names + np.repeat(phrases.salt, self.sizes))


def _spread(text: np.ndarray, trigger: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and starts of the windows of blocks."""
    count = high - low + 1
    at = np.repeat(np.arange(len(count)), count)
    return text[at], (trigger - high)[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)


def _block_key(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """A block's name within its text: that of its outer string, which holds the inner one, if it has one."""
    return np.where(outer == 0, inner, outer)


#: Bytes of text taken at a time.
BYTES = 300_000


def _parts(batch: pa.RecordBatch):
    """Slices of a batch of some BYTES of text, with the texts."""
    size = pc.coalesce(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
    of = np.cumsum(size) // BYTES
    cut = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cut, cut[1:]):
        if j > i:
            yield from rows(batch.slice(i, j - i), j - i)


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == U else c.astype(np.int64)) for c in columns]


def _half_rows(batches, length: int):
    """(rid, h, c): names of halves, each once a text, with 2 if it is there more often."""
    for batch in batches:
        for part, texts in _parts(batch):
            phrases = Phrases(texts, length)
            run, _, name = phrases.halves()
            text = phrases.text[run]
            first, count = phrases.distinct(text, name)
            rid = np.array(ints(part, "rid"), np.int64)[text[first]]
            yield pa.RecordBatch.from_arrays(_longs(rid, name[first], count), ["rid", "h", "c"])


def _block_rows(batches, length: int):
    """(rid, inner, o1, o2, c) of blocks in repeated halves, each once a text."""
    for batch in batches:
        for part, texts in _parts(batch):
            phrases = Phrases(texts, length)
            text, _, _, _, inner, o1, o2 = phrases.blocks(Known(part, "halves"), 2)
            first, count = phrases.distinct(text, _block_key(inner, o1))
            rid = np.array(ints(part, "rid"), np.int64)[text[first]]
            yield pa.RecordBatch.from_arrays(_longs(rid, inner[first], o1[first], o2[first], count), ["rid", "inner", "o1", "o2", "c"])


def _window_rows(batches, length: int):
    """(rid, h1, h2, c, open): windows of open blocks, each once a text; and of blocks this text speaks for, with 2."""
    for batch in batches:
        for part, texts in _parts(batch):
            phrases = Phrases(texts, length)
            text, trigger, low, high, inner, o1 = phrases.blocks(Known(part, "halves"))
            key = _block_key(inner, o1)
            for name in ("opened", "spoken"):
                here = Known(part, name).has(phrases, text, key)
                of, starts = _spread(text[here], trigger[here], low[here], high[here])
                h1, h2 = phrases.windows(starts)
                first, count = phrases.distinct(of, h1)
                rid = np.array(ints(part, "rid"), np.int64)[of[first]]
                is_open = np.full(len(first), name == "opened")
                yield pa.RecordBatch.from_arrays([*_longs(rid, h1[first], h2[first], np.where(is_open, count, 2)), pa.array(is_open)], ["rid", "h1", "h2", "c", "open"])


def repeated_bytes(texts: list[bytes], length: int, part: pa.RecordBatch) -> list[np.ndarray]:
    """Which bytes of each text are covered by repeated windows."""
    phrases = Phrases(texts, length)
    text, trigger, low, high, inner, o1 = phrases.blocks(Known(part, "halves"))
    key = _block_key(inner, o1)
    here = Known(part, "settled").has(phrases, text, key)
    starts = _spread(text[here], trigger[here], low[here], high[here])[1]
    here = Known(part, "opened").has(phrases, text, key)
    of, left = _spread(text[here], trigger[here], low[here], high[here])
    left = left[Known(part, "windows").has(phrases, of, phrases.windows(left, 1)[0])]
    edge = np.zeros(len(phrases.data) + 1, np.int32)
    edge[starts] += 1  # each start is there once
    edge[left] += 1
    edge[starts + length] -= 1
    edge[left + length] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return [covered[b:e] for b, e in zip(phrases.begins.tolist(), phrases.ends.tolist())]


RESULT = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(texts: list[bytes], masks: list, did: list, with_bytes: bool) -> pa.RecordBatch:
    removed, spans, kept = [], [], []
    for text, mask in zip(texts, masks):
        if mask is None or not mask.any():
            removed.append(0), spans.append(0), kept.append(text)
        else:
            removed.append(int(mask.sum()))
            spans.append(int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])))
            kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes())
    arrays = [*(pa.array(x, pa.int64()) for x in (did, [len(t) for t in texts], removed, spans)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
    return pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * with_bytes, [f.split()[0] for f in RESULT.split(", ")] + ["kept"] * with_bytes)


def _sorted_out(batches, with_bytes: bool):
    """Texts without a repeated half are done; of the others the text goes on."""
    for batch in batches:
        for part, texts in rows(batch):
            halves = part.column(part.schema.get_field_index("halves"))
            suspect = halves.is_valid().to_pylist()
            done = _result(texts, [None] * len(texts), ints(part, "did"), with_bytes)
            text = pa.array([t.decode() if s else None for t, s in zip(texts, suspect)], pa.string())
            rid = part.column(part.schema.get_field_index("rid"))
            yield pa.RecordBatch.from_arrays([*done.columns, rid, text, halves], [*done.schema.names, "rid", "text", "halves"])


def _final(batches, length: int, with_bytes: bool):
    for batch in batches:
        for part, texts in _parts(batch):
            yield _result(texts, repeated_bytes(texts, length, part), ints(part, "did"), with_bytes)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs (doc_id, text, ...), and with_bytes the kept bytes.

    Each byte covered by a string of `length` UTF-8 bytes that also starts elsewhere, in the
    same row or another, is removed; matches do not cross rows and are judged on the input. A
    null text is empty; a text shorter than `length` is kept. Repeated rows are each other's
    repeats. Extra columns are ignored; a null doc_id is kept.
    """
    assert length >= 4 * SUB + WINDOW
    stage = f"{shared_folder(docs.sparkSession)}/repeats-{uuid.uuid4().hex}"
    # Rows without an id go by their text, so that they are not one key. What is told of a key holds wherever its text stands.
    key = F.when(F.col("did") == NULL_ID, F.col("th")).otherwise(F.col("did")).alias("rid")
    with shuffles_freed(docs.sparkSession):
        _stage_suspects(keyed(docs).select("did", key, "text"), length, with_bytes, stage)
    staged = docs.sparkSession.read.parquet(stage)
    texts = staged.where("text IS NOT NULL").select("did", "rid", "text", "halves")
    told = _settle_blocks(texts, length)
    found = _settle_windows(texts, told, length)
    last = texts.join(told.drop("spoken"), "rid", "left").join(found, "rid", "left")
    out = in_arrow(last, lambda it: _final(it, length, with_bytes), RESULT + ", kept binary" * with_bytes)
    out = out.unionByName(staged.where("text IS NULL").drop("rid", "text", "halves"))
    return out.select(public_id().alias("doc_id"), *[c for c in out.columns if c != "did"])


def _stage_suspects(base: DataFrame, length: int, with_bytes: bool, path: str) -> None:
    """Write every row: done if it has no repeated half, else with its text and the names of those."""
    halves = in_arrow(base, lambda it: _half_rows(it, length), "rid long, h long, c long")
    common = halves.groupBy("h").agg(F.sum("c").alias("n")).where("n > 1").select("h")
    suspects = skew_join(halves.select("rid", "h"), common, ["h"]).groupBy("rid").agg(F.collect_set("h").alias("halves"))
    schema = RESULT + ", kept binary" * with_bytes + ", rid long, text string, halves array<long>"
    in_arrow(base.join(suspects, "rid", "left"), lambda it: _sorted_out(it, with_bytes), schema).write.parquet(path)


def _settle_blocks(texts: DataFrame, length: int) -> DataFrame:
    """(rid, settled, opened, spoken): names of blocks that repeat as a whole, that remain open, and that this rid speaks for."""
    blocks = in_arrow(texts, lambda it: _block_rows(it, length), "rid long, inner long, o1 long, o2 long, c long")
    outer = blocks.groupBy("inner", "o1", "o2").agg(F.sum("c").alias("n"), F.min("rid").alias("speaker"))
    inner = outer.groupBy("inner").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    whole = (F.col("n") > 1) & (F.col("o1") != 0)
    state = outer.join(inner.where("all > 1"), "inner").select(
        "inner", "o1", "o2", whole.alias("whole"), F.when(whole & (F.col("kinds") > 1), F.col("speaker")).alias("speaker")
    )
    key = F.when(F.col("o1") != 0, F.col("o1")).otherwise(F.col("inner"))
    facts = skew_join(blocks.drop("c"), state, ["inner", "o1", "o2"]).withColumn("key", key)
    return durable(
        facts.groupBy("rid").agg(
            F.collect_set(F.when(F.col("whole"), F.col("key"))).alias("settled"),
            F.collect_set(F.when(~F.col("whole"), F.col("key"))).alias("opened"),
            F.collect_set(F.when(F.col("speaker") == F.col("rid"), F.col("key"))).alias("spoken"),
        )
    )


def _settle_windows(texts: DataFrame, told: DataFrame, length: int) -> DataFrame:
    """(rid, windows): names of windows of open blocks that repeat."""
    some = told.where("size(opened) > 0 OR size(spoken) > 0").drop("settled")
    windows = in_arrow(texts.join(some, "rid"), lambda it: _window_rows(it, length), "rid long, h1 long, h2 long, c long, open boolean")
    again = windows.groupBy("h1", "h2").agg(F.sum("c").alias("n"), F.bool_or("open").alias("asked")).where("n > 1 AND asked").select("h1", "h2")
    open_ones = windows.where("open").select("rid", "h1", "h2")
    return durable(skew_join(open_ones, again, ["h1", "h2"]).groupBy("rid").agg(F.collect_set("h1").alias("windows")))
