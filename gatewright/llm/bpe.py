"""Byte-level BPE by DuckDB recursion in each partition.

A text is split into words by the pattern; a word that is a token is done, as in the library. The
others, each distinct one once, become rows (word, position, token, and the rank of the pair with
the next token by the merge table). A recursive query contracts the leftmost pair of least rank in
each word, and looks up the two pairs that are new, until no word has a pair left. A recursion
keeps what each of its steps made, so it runs in strides of STEPS steps, of which only the last
state goes on, over words of at most some BYTES together: memory is bounded for words of any length.

A worker remembers the ids of words, so a frequent word costs one look-up. Texts are decoded from
their ids alone, by an ordered aggregation over the bytes of the tokens.

A step visits each token of a word once, so a word of n bytes costs time in proportion to n * n.
Words of over LONGEST bytes contract the same pairs in the same order from a heap.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import rows
from gatewright.session import in_arrow

LONGEST = 4096
#: Steps of one recursive query, bytes of words and number of tokens to decode that one takes.
STEPS, BYTES, TOKENS = 32, 250_000, 1_000_000
#: Words, and ids and characters of words, that a worker remembers.
REMEMBERED, HELD = 800_000, 16_000_000
#: Words of a long text that are coded at a time.
WORDS = 500_000
#: White space as tiktoken's regex library has it; Python's \s holds U+001C to U+001F as well.
SPACES = r"\t-\r \x85\xa0  -     　"

PAIRED = """
CREATE OR REPLACE TABLE state AS
SELECT s.*, m.rank
FROM (SELECT w, pos, tok, lead(pos) OVER o AS next, lead(tok) OVER o AS after FROM words WINDOW o AS (PARTITION BY w ORDER BY pos)) s
LEFT JOIN merges m ON m.a = s.tok AND m.b = s.after
"""

CONTRACTED = f"""
CREATE OR REPLACE TABLE state AS
WITH RECURSIVE t(w, pos, tok, next, after, rank, step) AS (
  SELECT w, pos, tok, next, after, rank, 0 FROM state
  UNION ALL
  (
    WITH best AS MATERIALIZED (
      SELECT w, (min(k) % 65536)::INTEGER AS place, (min(k) // 65536)::INTEGER AS made, arg_min(next, k) AS gone
      FROM (SELECT w, next, rank::BIGINT * 65536 + pos AS k FROM t WHERE rank IS NOT NULL AND step < {STEPS}) GROUP BY w
    ), met AS MATERIALIZED (
      SELECT b.w, place, made, gone, max(r.next) FILTER (r.pos = gone) AS beyond, max(r.after) FILTER (r.pos = gone) AS follows,
             max(r.tok) FILTER (r.next = place) AS leads
      FROM best b JOIN t r ON r.w = b.w WHERE r.pos = gone OR r.next = place GROUP BY ALL
    ), found AS MATERIALIZED (
      SELECT met.*, x.rank AS rank_made, y.rank AS rank_before
      FROM met LEFT JOIN merges x ON x.a = made AND x.b = follows LEFT JOIN merges y ON y.a = leads AND y.b = made
    )
    SELECT t.w, pos, CASE WHEN pos = place THEN made ELSE tok END, CASE WHEN pos = place THEN beyond ELSE next END,
           CASE WHEN pos = place THEN follows WHEN next = place THEN made ELSE after END,
           CASE WHEN pos = place THEN rank_made WHEN next = place THEN rank_before ELSE rank END, step + 1
    FROM t JOIN found f ON t.w = f.w WHERE pos <> gone
  )
), last AS (SELECT w, max(step) AS step FROM t GROUP BY w)
SELECT t.* EXCLUDE (step) FROM t JOIN last ON t.w = last.w AND t.step = last.step
"""

DECODED = """
SELECT d, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary USING (tok) GROUP BY d ORDER BY d
"""


class Lists:
    """A growing row of lists of numbers, one behind the other."""

    def __init__(self, kind: type):
        self.flat, self.start, self.size = np.empty(1 << 16, kind), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.n = self.used = 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(sizes) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(sizes)] = sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of that number one behind the other, and where each ends."""
        size = self.size[which]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Coder:
    """Encodes and decodes words by the ranks in a file of `base64 rank` lines."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([c])] for c in range(256)], np.int32)
        self.pattern = regex.compile(pattern.replace(r"[^\s", "[^" + SPACES).replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]"))
        get = self.ranks.get
        self.pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "400MB", "temp_directory": ""})
        a, b = np.array(list(self.pairs), np.int32).reshape(-1, 2).T
        merges = pa.table({"a": a.copy(), "b": b.copy(), "rank": np.fromiter(self.pairs.values(), np.int32, len(self.pairs))})
        vocabulary = pa.table({"tok": pa.array(list(self.bytes), pa.int32()), "hex": [t.hex() for t in self.bytes.values()]})
        self.db.register("m", merges), self.db.register("v", vocabulary)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m; CREATE TABLE vocabulary AS SELECT * FROM v")
        self.db.unregister("m"), self.db.unregister("v")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # word -> its number in the lists
        self.ids, self.chars = Lists(np.uint32), 0

    def _remember(self, words: list[str], ids: np.ndarray, n_ids: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ids.append(ids, n_ids)
        self.chars += sum(map(len, words))

    def _contract(self, words: list[str]) -> None:
        """Ids of distinct words by recursive queries."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw])
        which = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        tokens = pa.table({"w": which, "pos": pos, "tok": self.single[np.frombuffer(b"".join(raw), np.uint8)]})
        self.db.register("words", tokens)
        self.db.execute(PAIRED)
        self.db.unregister("words")
        while self.db.execute("SELECT count(rank) FROM state").fetchall()[0][0]:
            self.db.execute(CONTRACTED)
        ids = self.db.sql("SELECT list(tok ORDER BY pos) AS ids FROM state GROUP BY w ORDER BY w").to_arrow_table().combine_chunks()["ids"].combine_chunks()
        self._remember(words, ids.flatten().to_numpy(), ids.value_lengths().to_numpy())

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of lists of ids that lie one behind the other and end at `ends`; at most TOKENS ids at a time, of however long a list."""
        out: list[list[bytes]] = [[] for _ in ends]
        for low in range(0, len(ids), TOKENS):
            some = ids[low : low + TOKENS].astype(np.int32)
            pos = np.arange(len(some), dtype=np.int32)
            own = np.searchsorted(ends, pos + low, "right")
            self.db.register("ids", pa.table({"d": own, "pos": pos, "tok": some}))
            got = self.db.sql(DECODED).to_arrow_table()
            self.db.unregister("ids")
            for d, text in zip(got["d"].to_pylist(), got["hex"].to_pylist()):
                out[d].append(bytes.fromhex(text))
        return [b"".join(parts) for parts in out]

    def _contract_long(self, text: str) -> None:
        """The same contractions, leftmost pair of least rank first, from a heap."""
        word = text.encode()
        tok = self.single[np.frombuffer(word, np.uint8)].tolist()
        n, get = len(tok), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get((tok[i], tok[i + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if tok[i] is None or j >= n or get((tok[i], tok[j])) != rank:
                continue
            tok[i], tok[j] = rank, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((rank, tok[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get((tok[h], rank))) is not None:
                heappush(heap, (r, h))
        ids = [t for t in tok if t is not None]
        self._remember([text], np.array(ids, np.uint32), np.array([len(ids)]))

    def learn(self, words: set[str]) -> None:
        tokens: list[str] = []
        new: list[str] = []
        for word in words:
            if word.encode() in self.ranks:
                tokens.append(word)
            elif 4 * len(word) > LONGEST and len(word.encode()) > LONGEST:
                self._contract_long(word)
            else:
                new.append(word)
        self._remember(tokens, np.array([self.ranks[w.encode()] for w in tokens], np.uint32), np.ones(len(tokens), np.int64))
        end = np.cumsum([len(w.encode()) for w in new]) // BYTES if new else np.empty(0, np.int64)
        cut = [0, *(np.flatnonzero(np.diff(end)) + 1).tolist(), len(new)]
        for i, j in zip(cut, cut[1:]):
            if j > i:
                self._contract(new[i:j])

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one behind the other, and where each word's end."""
        if len(self.known) > REMEMBERED or self.chars + self.ids.used > HELD:
            self.forget()
        new = set(words) - self.known.keys()
        if new:
            self.learn(new)
        return self.ids.take(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and where each text's end. Of a long text some WORDS words are in hand at a time."""
        if len(texts) == 1 and len(texts[0]) > WORDS:
            found, parts = map(methodcaller("group"), self.pattern.finditer(texts[0])), []
            while words := list(islice(found, WORDS)):
                parts.append(self._coded(words)[0])
            flat = np.concatenate(parts or [np.empty(0, np.uint32)])
            return flat, np.array([len(flat)])
        split = [self.pattern.findall(t) for t in texts]
        last = np.cumsum([0, *map(len, split)])
        flat, ends = self._coded(list(chain.from_iterable(split)))
        return flat, np.concatenate([[0], ends])[last[1:]]


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


#: Characters of text coded at a time.
CHARACTERS = 4_000_000


def _encode(batches, path: str, pattern: str, with_ids: bool):
    own = coder(path, pattern)
    for batch in batches:
        for part, raw in rows(batch, 1024):
            texts = [t.decode() for t in raw]
            of = np.cumsum([len(t) for t in texts]) // CHARACTERS
            cut = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(texts)]
            for x, y in zip(cut, cut[1:]):
                if y == x:
                    continue
                ids, ends = own.encode(texts[x:y])
                decoded = own.decode(ids, ends)
                sizes = np.diff(ends, prepend=0)
                told = ids.astype("<u4", copy=False)
                arrays = [
                    part.column(0).slice(x, y - x), pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(told[e - n : e]).hexdigest() for e, n in zip(ends.tolist(), sizes.tolist())]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays += [pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids.astype(np.int32)), pa.array(decoded, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text, ...), and with_ids the ids and the decoded bytes.

    `path` is a file of base64 tokens and ranks, `pattern` splits texts into words. A null text
    is empty and has no ids. Repeated rows are coded one by one; a null doc_id is kept; extra
    columns are ignored.
    """
    given = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return in_arrow(given, lambda it: _encode(it, path, pattern, with_ids), schema + ", ids array<int>, decoded binary" * with_ids)
