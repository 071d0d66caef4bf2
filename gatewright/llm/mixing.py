"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is exponential: -ln(u) / w, u uniform by the MD5 of its id and text, w its quality
weight; in the order of their keys documents are a weighted sample without replacement. A source's
budget is met by complete epochs of all its documents first, and a fraction of one more: documents
in the order of their keys until the sizes add up to what is left, the last one in part.

No source is sorted whole. Where the budget ends is found by counting sizes in GRAINS ranges of the
key, then in as many ranges of that range (both with partial sums before the shuffle); only the
documents of the last range, one in GRAINS ** 2, are sorted and summed one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.llm.common import NULL_ID, durable, public_id

#: Ranges of exp(-key) that are counted at a time.
GRAINS = 4096
#: Source weights by rank of the source, repeating; the share of all sizes that is mixed; epochs of a source at most.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2


def words(text: Column) -> Column:
    """How many `[^\\x20\\x09-\\x0D]+` a text has; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def budgets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size, each source once, null being one) with target: its part of `share` times all sizes.

    The source of rank i by code point (null last, from 0) weighs weights[i % len(weights)]. A target is at
    most `epochs` times its source's size; what is over is shared by weight among the others, until none is
    above. So a target is the least of its bound and its weight times one level for all, which is found in
    the order of bound over weight. One row a source; the windows over them are the only ones without a key.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", w.alias("w"), (F.lit(float(epochs)) * F.col("source_size")).alias("bound"))
    every = Window.partitionBy()
    upward = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    met, gone = (F.coalesce(F.sum(c).over(upward), F.lit(0.0)) for c in ("bound", "w"))
    level = (total - met) / (F.sum("w").over(every) - gone)  # if those before are at their bounds, and no other is
    leveled = ranked.withColumn("level", level)
    # The first that the level leaves under its bound sets it for all after; if there is none, all are at their bounds.
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.struct((F.col("bound") / F.col("w")).alias("at"), F.col("source").isNull().alias("none"), "source", "level"))).over(every)
    return leveled.withColumn("free", free["level"]).select("source", "source_size", F.when(F.col("free").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("free") * F.col("w"))).alias("target"))


def _met(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of by_source (one row a source, a null one too)."""
    return rows.join(by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _reached(counted: DataFrame, grain: str) -> DataFrame:
    """(source, grain, left): of sizes by grain (source, grain, size, budget) the grain in which the budget ends, and what is left of it there."""
    before = F.sum("size").over(Window.partitionBy("source").orderBy(grain)) - F.col("size")
    placed = counted.withColumn("before", before).where("before < budget")
    last = placed.groupBy("source").agg(F.max(F.struct(grain, (F.col("budget") - F.col("before")).alias("left"))).alias("r"))
    return last.select("source", f"r.{grain}", "r.left")


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row of docs (doc_id, text, source, ...): how many words the mix takes of it, repeats counted.

    quality (doc_id, weight): weights over 0 of documents; 1 for those it does not name, the greatest for
    those it names twice. A document of twice the weight comes before one of the simple weight two times in three.
    size is the number of words. A source's taken words add up to its target, rounded down. Null sources are
    one source, the last; a null text has no words and nothing is taken of it; rows with a null doc_id take
    part by their texts. Repeated rows (one id, text and source) have one key and are taken one after the
    other. Reruns agree. Extra columns are ignored. What is read of the texts is written once when this is
    called; the rest is planned from there.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    drawn = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"), drawn.alias("drawn"))
    weight = F.lit(1.0)
    if quality is not None:
        named = quality.where("doc_id IS NOT NULL AND weight > 0").groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        given, weight = given.join(named, "did", "left"), F.coalesce("weight", F.lit(1.0))
    u = (F.conv(F.substring("drawn", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))
    base = durable(given.select("did", "source", "size", "drawn", (-F.log(u) / weight).alias("key")))

    targets = budgets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    shares = durable(targets.withColumn("epochs", whole).withColumn("budget", F.floor("target") - F.col("epochs") * F.col("source_size")))
    fine = F.floor(F.exp(-F.col("key")) * F.lit(float(GRAINS * GRAINS))).cast("long")
    place = F.lit(GRAINS * GRAINS - 1) - F.least(fine, F.lit(GRAINS * GRAINS - 1))  # rises with the key
    placed = base.withColumns({"grain": F.floor(place / GRAINS).cast("long"), "part": (place % GRAINS).cast("long")})

    counted = placed.groupBy("source", "grain").agg(F.sum("size").alias("size"))
    first = durable(_reached(_met(counted, shares.select("source", "budget")), "grain").withColumnsRenamed({"grain": "at", "left": "budget"}))
    inner = _met(placed, first).where("grain = at").groupBy("source", "part", "budget").agg(F.sum("size").alias("size"))
    second = durable(_reached(inner, "part"))
    ends = _met(_met(shares.drop("budget"), first.drop("budget"), "left"), second.withColumnsRenamed({"part": "at_part", "left": "rest"}), "left")
    ends = durable(ends.withColumn("end", F.col("at") * GRAINS + F.col("at_part")).drop("at", "at_part"))

    rows = _met(placed, ends).withColumn("place", F.col("grain") * GRAINS + F.col("part"))
    columns = ("did", "source", "size", "source_size", "target")
    clear = rows.where(F.col("end").isNull() | (F.col("place") != F.col("end"))).select(*columns, (F.col("epochs") * F.col("size") + F.when(F.col("place") < F.col("end"), F.col("size")).otherwise(0)).alias("taken"))
    # Equal rows are one here, and told apart at the end.
    close = rows.where(F.col("place") == F.col("end")).groupBy(*columns, "key", "drawn", "epochs", "rest").agg(F.count(F.lit(1)).alias("n"))
    mine = F.col("n") * F.col("size")
    before = F.sum(mine).over(Window.partitionBy("source").orderBy("key", "drawn", "did", "size")) - mine
    part = close.withColumn("got", F.least(F.greatest(F.col("rest") - before, F.lit(0).cast("long")), mine))
    each = part.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    own = F.least(F.greatest(F.col("got") - F.col("i") * F.col("size"), F.lit(0).cast("long")), F.col("size"))
    out = clear.unionByName(each.select(*columns, (F.col("epochs") * F.col("size") + own).alias("taken")))
    return out.select(public_id().alias("doc_id"), *columns[1:], "taken")
