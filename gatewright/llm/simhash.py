"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at three or fewer differing bits have a common neighbour within two bits of one
and one bit of the other: a bucket. Every distinct fingerprint emits its variants within half
the radius, buckets are formed by a shuffle on the variant, and all that share a bucket with
some fingerprint within one bit of it are linked to the smallest such fingerprint. Any two that
lie in three bits meet in a bucket; any link made there is within three bits. So a bucket of k
fingerprints yields k - 1 links, never pairs, and a bucket holds no more than a ball's worth of
distinct fingerprints however many copies the corpus has.

Variants are thinned without loss. Of three differing bits two lie in one half word, so double
flips stay inside a half; and as one or three differing bits change the parity of the bit
count, only even fingerprints emit double flips. Before that, the same is done on half words at
radius one: fingerprints that share no half within one bit with another have no link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.llm.common import durable, ints, keyed, public_id, rows, skew_join, stay_only
from gatewright.llm.components import components
from gatewright.session import in_arrow

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42


def simhash(text: bytes, width: int = 3) -> int:
    """64 bits, bit i set if it is set in over half the XXH64 of the word shingles; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    h = np.array([digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)))], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches, width: int):
    for batch in batches:
        for part, texts in rows(batch):
            fp = np.array([simhash(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ints(part, "did"), pa.int64()), pa.array(ints(part, "th"), pa.int64()), pa.array(fp)], ["did", "th", "fp"])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


HALVES = (range(32), range(32, 64))
SINGLE = [1 << i for i in range(64)]
DOUBLE = [1 << i | 1 << j for half in HALVES for i in half for j in half if i < j]


def _variants(value: Column, parity: Column, even: list[int], odd: list[int]) -> Column:
    """value ^ mask for the masks of its parity, exploded."""
    masks = [F.array(*[F.lit(_signed(m)) for m in each]) for each in (even, odd)]
    return F.explode(F.transform(F.when(parity % 2 == 0, masks[0]).otherwise(masks[1]), lambda m: value.bitwiseXOR(m)))


def _with_near_half(fps: DataFrame) -> DataFrame:
    """Of distinct fingerprints (fp), those that share a half word, up to one bit, with another."""
    halves = fps.select(
        "fp", F.explode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32)))).alias("half")
    )
    # d(half, half) = 1 changes the parity: the even one stands still, the odd one flips each bit.
    ones = F.bit_count(F.col("half").bitwiseAND(F.lit(0xFFFFFFFF)))
    keys = halves.select("fp", _variants(F.col("half"), ones, [0], [0, *SINGLE[:32]]).alias("key"))
    by_key = Window.partitionBy("key").orderBy("fp")
    met = keys.select("fp", (F.lag("fp").over(by_key).isNotNull() | F.lead("fp").over(by_key).isNotNull()).alias("met"))
    return met.where("met").select("fp").distinct()


def _dealt(rows: DataFrame, each: int) -> DataFrame:
    """rows (written already) in parts of at most some `each`: what is exploded next is far larger than what is read."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // each)), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) that connect just those within three bits, directly or in chains.

    Runs jobs when it is called: what is dealt out for an explosion is written and counted first.
    """
    near = durable(_with_near_half(_dealt(durable(fps), 50_000)))
    balls = _dealt(near, 5_000).select("fp", _variants(F.col("fp"), F.bit_count("fp"), [0, *SINGLE, *DOUBLE], SINGLE).alias("bucket"))
    far = (F.bit_count(F.col("fp").bitwiseXOR(F.col("bucket"))) > 1).alias("far")
    first = F.first(F.struct("far", "fp")).over(Window.partitionBy("bucket").orderBy("far", "fp").rowsBetween(Window.unboundedPreceding, 0))
    met = balls.select("bucket", "fp", far).select("fp", first.alias("c"))
    return met.where(~F.col("c.far") & (F.col("c.fp") != F.col("fp"))).select(F.col("fp").alias("a"), F.col("c.fp").alias("b")).distinct()


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """did, th, fp, root and component (the smallest did reachable) of each row of docs (doc_id, text, ...).

    root tells components apart where the smallest did does not, since it is null or repeated.

    Words are what stands between [\\x20\\x09-\\x0D] after A-Z are lower-cased; shingles have
    `width` words, repeats count; a shorter text is one shingle; a text without words (or null)
    has fingerprint 0 and links like any other. A null doc_id counts as the smallest id.
    Repeated rows are rows of their own. Extra columns are ignored. Jobs run when it is called.
    """
    found = durable(in_arrow(keyed(docs), lambda it: _fingerprints(it, width), "did long, th long, fp long"))
    smallest = found.groupBy("fp").agg(F.min("did").alias("least"))
    roots = components(links(smallest.select("fp")))
    named = smallest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return found.join(skew_join(named, least, ["root"]).select("fp", "root", "component"), "fp")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row; see near_groups."""
    return near_groups(docs, width).select(public_id().alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), public_id("component").alias("component_id"))


def near_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs, all columns, with one row left of each component: one of its smallest doc_id."""
    stay = near_groups(docs, width).groupBy("root").agg(F.min(F.struct("did", "th")).alias("r"))
    return stay_only(docs, stay.select("r.did", "r.th"))


