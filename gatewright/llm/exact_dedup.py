"""Exact dedup by content-defined chunk recipes.

A text without its blanks is cut by content; each chunk is named by a keyed 128-bit digest. A
first pass moves every chunk once, after dropping those its task has met, and checks that no
two different chunks share a name; should two ever do, the names are drawn anew. From then on
a text is the ordered list of its chunks' names, its recipe, and only recipes move. Equal
recipes are equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.cdc import cuts
from gatewright.llm.common import durable, ints, keyed, public_id, rows, stay_only
from gatewright.session import in_arrow

BLANKS = b" \t\n\x0b\x0c\r"
#: Chunks of 1 to 16 kB, 4 kB beyond the least on average.
BITS, LEAST, MOST = 12, 1024, 16384
#: Names of chunks that a task remembers, to move a repeated chunk once only.
REMEMBERED = 100_000

Name = Callable[[bytes, int], bytes]


def digest(chunk: bytes, salt: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16, salt=salt.to_bytes(8, "little")).digest()


def _chunks(texts: list[bytes]):
    bare = [t.translate(None, BLANKS) for t in texts]
    for text, ends in zip(bare, cuts(bare, BITS, LEAST, MOST)):
        yield text, [text[i:j] for i, j in zip([0, *ends], ends)]


def _named_chunks(batches, salt: int, name: Name):
    seen: set[bytes] = set()
    for batch in batches:
        for _, texts in rows(batch):
            names, chunks = [], []
            for _, own in _chunks(texts):
                for chunk in own:
                    n = name(chunk, salt)
                    check = n + hashlib.sha256(chunk).digest()[:8]
                    if check in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(check)
                    names.append(n)
                    chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(chunks, pa.binary())], ["name", "chunk"])


def _clashes(batches):
    """Of chunks sorted by name: how many differ from the one before them that has their name."""
    last = (None, None)
    for batch in batches:
        n = 0
        for now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n += now[0] == last[0] and now[1] != last[1]
            last = now
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["clashes"])


def _recipes(batches, salt: int, name: Name):
    for batch in batches:
        for part, texts in rows(batch):
            recipes, shas = [], []
            for text, own in _chunks(texts):
                recipes.append(b"".join(name(c, salt) for c in own))
                shas.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ints(part, "did"), pa.int64()), pa.array(ints(part, "th"), pa.int64()), pa.array(ints(part, "n_chars"), pa.int32()), pa.array(recipes, pa.binary()), pa.array(shas)],
                ["did", "th", "n_chars", "recipe", "text_sha256"],
            )


def verified_salt(base: DataFrame, name: Name = digest) -> int:
    """The first salt under which different chunks have different names, found by comparing their bytes."""
    salt = 0
    while True:
        named = in_arrow(base.select("text"), lambda it, s=salt: _named_chunks(it, s, name), "name binary, chunk binary")
        found = named.repartition("name").sortWithinPartitions("name").mapInArrow(_clashes, "clashes long").agg(F.sum("clashes")).first()[0]
        if not found:
            return salt
        salt += 1


def exact_groups(docs: DataFrame, name: Name = digest) -> DataFrame:
    """One row for each row of docs (doc_id, text, ...): did, th, copy, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks ([\\x20\\x09-\\x0D]); a null text is
    empty. Of equal texts the row with the most code points stays, then the smallest doc_id (a
    null doc_id counts as the smallest). Of repeated rows of one doc_id and text, `copy` numbers
    them from 1, and only the first can stay. Extra columns are ignored.
    """
    base = keyed(docs).withColumn("n_chars", F.length("text"))
    salt = verified_salt(base, name)
    recipes = durable(in_arrow(base, lambda it: _recipes(it, salt, name), "did long, th long, n_chars int, recipe binary, text_sha256 string"))
    # Repeated rows of one doc_id and text meet here: as many as the input repeats one id.
    rows_of = recipes.groupBy("did", "th", "n_chars", "recipe", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    best = F.max(F.struct("n_chars", (-1 - F.col("did")).alias("order"), "th"))
    groups = rows_of.groupBy("recipe").agg(best.alias("best"), F.sum("copies").alias("group_size"))
    # On a longer key both sides are shuffled for the join itself, so that a recipe with very many rows can be split.
    longer = lambda df: df.withColumn("key", F.concat("recipe", F.lit(bytearray(b".")))).drop("recipe")
    out = longer(rows_of).join(longer(groups), "key").select(
        "did", "th", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        (-1 - F.col("best.order")).alias("keep"), F.col("best.th").alias("keep_th"), "group_size", "text_sha256",
    )
    return out.select(
        "did", "th", "copy", public_id().alias("doc_id"), public_id("keep").alias("keep_id"), "group_size",
        ((F.col("did") == F.col("keep")) & (F.col("th") == F.col("keep_th")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )


def exact_dedup(docs: DataFrame, name: Name = digest) -> DataFrame:
    """docs, all columns, with one row left of each group of equal texts (see exact_groups).

    Of repeated rows of one doc_id and text, any one stays.
    """
    return stay_only(docs, exact_groups(docs, name).where("kept").select("did", "th"))
