"""Near dedup by likeness of texts: Jaccard similarity of five-word shingles, 0.8 or more.

Candidates are texts whose SimHashes lie in one ball, found by meet-in-the-middle ball hashing as in
simhash.py, but over a long fingerprint in blocks, since at 0.8 too many bits differ for a ball
around 64 of them (block_balls.py). Candidates are then judged exactly, on their whole shingle sets
(64-bit hashes of shingles). Fingerprints are made of those texts only that can be alike to
another one, as most of their shingles occur elsewhere (support.py); that leaves out no link.

Equal sets are one node, named by 64 bits, or by others where 128 bits of two differ under one name; a
bucket is what shares variants of a block. Each text is first held against
the one hub that meets most others of all its buckets' hubs, so a group of k texts about one original
costs k - 1 comparisons; then against the hubs of those buckets that still have several components.
What is left goes to tasks in blocks of at most some BLOCK sets, each block with each other one of
its bucket, or of all components that buckets connect (a region) if that is less. A task counts what
its sets have in common by products of incidence matrices and gives on only links that join
components: no candidate is left out, and no table holds the pairs of a group.

Blocks of the fingerprint are judged in ROUNDS, few at first. A large group is found
by any few of them: then texts of one component, or of one region that was judged whole, need not meet
in the other blocks, and a text costs the buckets of few blocks, not of all. A region is judged
whole if that costs no more than its buckets would, over all blocks at the rate of those met.

What a step has written is deleted with the step; only the groups stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.llm.block_balls import BLOCKS, fingerprint, meetings
from gatewright.llm.common import Scratch, ints, keyed, rows, scratch, skew_join, stay_only, written
from gatewright.llm.components import components
from gatewright.llm.simhash import LOWER, SEED
from gatewright.llm.support import counted, shared_members
from gatewright.session import in_arrow

WIDTH = 5
#: A block of a bucket has some BLOCK sets or SHINGLES shingles; a row PIECE of them, an incidence matrix COLUMNS.
BLOCK, SHINGLES, PIECE, COLUMNS = 512, 1_000_000, 2048, 8192
#: Blocks of the fingerprint that are met and judged before the next ones are; to move a set into a bucket counts as so many pairs judged.
ROUNDS, MOVE = (2, 8, BLOCKS), 16


def durable(df: DataFrame) -> DataFrame:
    return written(df)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 of the word shingles, sorted; words are those of simhash. A shorter text is one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)))], np.uint64))


def _named(texts: list[bytes], width: int) -> tuple[list[np.ndarray], pa.Array, pa.Array]:
    """The shingles of each text, their name, and 64 more bits of it."""
    sets = [shingles(t, width) for t in texts]
    name = [xxhash.xxh3_128_intdigest(s.tobytes(), SEED) for s in sets]
    low, high = (np.array([n >> shift & 2**64 - 1 for n in name], np.uint64).view(np.int64) for shift in (0, 64))
    return sets, pa.array(low), pa.array(high)


def _names(batches, width: int):
    for batch in batches:
        for part, texts in rows(batch):
            sets, sid, alt = _named(texts, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ints(part, "did"), pa.int64()), pa.array(ints(part, "th"), pa.int64()), sid, alt, pa.array([len(s) for s in sets], pa.int64()), pa.array([len(counted(s)) for s in sets], pa.int64())],
                ["did", "th", "sid", "alt", "n", "m"],
            )


def _counted(batches, width: int):
    for batch in batches:
        for _, texts in rows(batch):
            sets, sid, _ = _named(texts, width)
            yield from zip(sid.to_pylist(), map(counted, sets))


def _sets(batches, width: int):
    """sid, found and print of rows (sid, text)."""
    for batch in batches:
        for part, texts in rows(batch):
            sets = [shingles(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("sid")), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([fingerprint(s).astype("<u4").tobytes() for s in sets], pa.binary())],
                ["sid", "found", "print"],
            )


def _can(n: str, m: str):
    """Sets of these sizes may have a similarity of 0.8."""
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of sids those with a similarity of 0.8 or more: |A & B| / |A | B| >= 4 / 5 in whole numbers."""
    one = skew_join(pairs, sets.select(F.col("sid").alias("a"), F.col("found").alias("x")), ["a"])
    both = skew_join(one, sets.select(F.col("sid").alias("b"), F.col("found").alias("y")), ["b"])
    return both.where(F.size(F.array_intersect("x", "y")) * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b")


def _joining(sid: np.ndarray, root: np.ndarray, sizes: np.ndarray, owner: np.ndarray, found: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) of alike sets that join different roots, no more than it takes to join them.

    owner says to which of the sets each shingle of found belongs.
    """
    _, column, count = np.unique(found, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = (np.cumsum(count > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sid), len(sid)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(sid), int(column[j - 1]) + 1 - low), np.float32)
        has[owner[i:j], column[i:j] - low] = 1
        common += has @ has.T
    alike = np.triu(common * 9 >= 4 * (sizes[:, None] + sizes), 1) & (root[:, None] != root)
    top: dict[int, int] = {}

    def up(r: int) -> int:
        while r in top:
            r = top[r]
        return r

    links = []
    for x, y in np.argwhere(alike).tolist():
        r, t = up(int(root[x])), up(int(root[y]))
        if r != t:
            top[max(r, t)] = min(r, t)
            links.append((int(sid[x]), int(sid[y])))
    return links


def _blockwise(batches):
    """Links in groups of rows (key, i, j, sid, root, n, found), the rows of a group and of a set one behind the other."""

    def ended(rows_: list[pa.RecordBatch]):
        group = pa.Table.from_batches(rows_).combine_chunks()
        own = group["sid"].to_numpy()
        first = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
        lists = group["found"].combine_chunks()
        owner = np.repeat(np.searchsorted(first, np.arange(len(own)), "right") - 1, lists.value_lengths().to_numpy())
        return _joining(own[first], group["root"].to_numpy()[first], group["n"].to_numpy()[first], owner, lists.flatten().to_numpy())

    held, name, links = [], None, []
    for batch in batches:
        at = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "i", "j")])
        cut = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cut, cut[1:]):
            if y == x:
                continue
            if held and name != tuple(at[:, x].tolist()):
                links += ended(held)
                held = []
            name = tuple(at[:, x].tolist())
            held.append(batch.slice(x, y - x))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])
            links = []
    if held and (links := ended(held)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])


def _gathered(rooted: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """Buckets (key, sid, n, root) of several roots, and regions (sid, region; sid once) that stand for theirs.

    A region has all sets of the components that such buckets connect. It takes the place of its buckets
    where judging them costs, over rate times as many, no less than judging all pairs of the region.
    """
    mixed = rooted.groupBy("key").agg(F.min("root").alias("whole"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("whole < high")
    left = durable(skew_join(rooted, mixed.select("key", "size", "whole"), ["key"]))
    joined = components(left.select(F.col("root").alias("a"), F.col("whole").alias("b"))).select(F.col("root").alias("region"), F.col("node").alias("root"))
    region = durable(joined.unionByName(joined.select("region", F.col("region").alias("root")).distinct()))
    placed = durable(skew_join(left.drop("whole"), region, ["root"]))
    inside = durable(skew_join(rooted.select("sid", "n", "root").distinct(), region, ["root"]))
    cost = placed.groupBy("region").agg(F.sum(F.col("size").cast("double") + MOVE).alias("cost"))
    sets = inside.groupBy("region").agg(F.count(F.lit(1)).cast("double").alias("sets"))
    less = durable(cost.join(sets, "region").select("region", (F.col("sets") * F.col("sets") <= F.col("cost") * rate).alias("less")))
    buckets = skew_join(placed, less.where("NOT less").select("region"), ["region"]).select("key", "sid", "n", "root")
    regions = durable(skew_join(inside, less.where("less").select("region"), ["region"]))
    return durable(buckets.unionByName(regions.select(F.col("region").alias("key"), "sid", "n", "root"))), regions.select("sid", "region")


def _across(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between roots of one bucket (key, sid, n, root), of which each set is held against each other one."""
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("all"))
    blocks = mixed.where("low < high AND size > 2").select("key", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("all") / SHINGLES)).alias("blocks"))
    mine = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    dealt = skew_join(rooted, blocks, ["key"]).select("key", "sid", "n", "root", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    placed = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "sid", "root", "n")
    whole = skew_join(placed, sets, ["sid"])
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.size("found") - 1) / PIECE).cast("int")))
    pieces = whole.withColumn("at", piece).withColumn("found", F.slice("found", F.col("at") * PIECE + 1, F.lit(PIECE))).select("key", "i", "j", "sid", "root", "n", "found")
    return in_arrow(pieces.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "sid"), _blockwise, "a long, b long").distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of each sid: its own where roots (node, root) has none."""
    return rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def _judged(met: DataFrame, sets: DataFrame, known: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """roots (node, root) after the buckets met (key, sid, n, size), before which they were known, and regions (sid, region) of which all pairs were judged."""
    links = known.select(F.col("node").alias("a"), F.col("root").alias("b"))
    met = durable(_rooted(met, known))
    # A set is in some buckets of each block, so a window of one set is small.
    weighed = met.select("sid", "n", "root", "key", F.sum("size").over(Window.partitionBy("sid")).alias("meets"))
    hubs = weighed.groupBy("key").agg(F.max(F.struct("meets", "sid", "n", "root")).alias("hub")).select("key", "hub")
    held = skew_join(weighed.select(F.col("sid").alias("a"), "n", "root", "key"), hubs, ["key"]).where((F.col("root") != F.col("hub.root")) & _can("n", "hub.n"))
    to_hub = durable(held.select("a", F.struct("hub.meets", "hub.sid").alias("hub")).distinct())
    nearest = durable(_alike(to_hub.groupBy("a").agg(F.max("hub").alias("hub")).select("a", F.col("hub.sid").alias("b")), sets))
    one, two = (F.coalesce(f"{c}_root", c) for c in "ab")
    roots = components(links.unionByName(nearest))
    across = to_hub.select("a", F.col("hub.sid").alias("b"))
    for c in "ab":
        across = across.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    first = links.unionByName(nearest).unionByName(durable(_alike(across.where(one != two).select("a", "b"), sets)))
    rooted = durable(_rooted(met.select("sid", "n", "key"), components(first)))
    gathered, regions = _gathered(rooted, rate)
    return components(first.unionByName(durable(_across(gathered, sets)))), regions


def alike_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """did, th, root and component (the smallest did reachable) of each row of docs (doc_id, text, ...).

    root tells components apart where the smallest did does not, since it is null or repeated.

    Texts are linked at a Jaccard similarity of 0.8 or more; texts without words (or null) are
    alike. A null doc_id counts as the smallest id. Extra columns are ignored. Jobs run when it is called.
    """
    spark, base = docs.sparkSession, keyed(docs)
    with scratch(spark):
        found = durable(in_arrow(base, lambda it: _names(it, width), "did long, th long, sid long, alt long, n long, m long"))
        named = found.groupBy("sid", "alt").agg(F.min_by(F.struct("did", "th", "n", "m"), F.struct("did", "th")).alias("r"))
        # Where two sets have one name, it stays with the first; there are as good as none.
        told = named.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("alt", "r"))).alias("of")).select(F.col("sid").alias("name"), F.posexplode("of").alias("i", "of"))
        nodes = durable(told.select("name", "of.alt", F.when(F.col("i") == 0, F.col("name")).otherwise(F.xxhash64("name", "of.alt")).alias("sid"), "of.r.*"))

        total = nodes.agg(F.sum("m")).first()[0] or 0
        shared = shared_members(base, lambda it: _counted(it, width), total).withColumnRenamed("sid", "name")
        most = nodes.join(shared, "name", "left").where((F.col("n") > 0) & (F.coalesce("shared", F.lit(0)) >= F.col("m") - F.floor(F.col("n") / 5)))
        able = durable(most.select("sid", "did", "th", "n"))
        texts = skew_join(base, able.select("sid", "did", "th"), ["did", "th"]).select("sid", "text")
        sets = durable(in_arrow(texts, lambda it: _sets(it, width), "sid long, found array<long>, print binary").dropDuplicates(["sid"]))
        between = meetings(durable(sets.select("sid", "print")))
        sets = sets.drop("print")

        roots, labels, before = spark.createDataFrame([], "node long, root long"), None, Scratch(spark)
        for low, high in zip((0, *ROUNDS), ROUNDS):
            after = Scratch(spark)
            with scratch(spark):
                met = durable(skew_join(between(low, high, labels), able, ["sid"]))
                roots, regions = _judged(met.select("sid", "n", "key", "size"), sets, roots, BLOCKS / (high - low))
                # hashed, as a region has texts that are not of the component it is called by, which comes to have others
                settled = roots.withColumnRenamed("node", "sid").join(regions, "sid", "full")
                labels = after.write(settled.select("sid", F.when(F.col("region").isNotNull(), F.xxhash64("region")).otherwise(F.col("root")).alias("label")))
            before.clear()
            before = after

        rooted = _rooted(nodes.select("sid", "name", "alt", F.col("did").alias("least")), roots)
        least = rooted.groupBy("root").agg(F.min("least").alias("component"))
        rooted = skew_join(rooted, least, ["root"]).select(F.col("name").alias("sid"), "alt", "root", "component")
        groups = Scratch(spark).write(skew_join(found.select("did", "th", "sid", "alt"), rooted, ["sid", "alt"]).select("did", "th", "root", "component"))
        before.clear()
    return groups


def alike_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, all columns, with one row left of each component: one of its smallest doc_id."""
    stay = alike_groups(docs, width).groupBy("root").agg(F.min(F.struct("did", "th")).alias("r"))
    return stay_only(docs, stay.select("r.did", "r.th"))
