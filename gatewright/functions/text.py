"""Bags of words: tokens, counts, cosine of pairs, and TF-IDF fitted on strictly earlier years."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.session import in_arrow, ship

#: A term: a run of two or more ASCII letters, after lower-casing.
TERM = "[a-z]{2,}"
MIN_DOCS, MIN_DF = 50, 5
#: Blocks of documents that get the weights of their terms together.
BLOCKS = 128


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): how often each document has each term. Partial sums are made before the shuffle."""
    terms = docs.select(key, F.explode(tokens(F.col(text))).alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def norms(counts: DataFrame, key: str) -> DataFrame:
    """(key, norm2): the squared length of each document's vector of counts, a whole number."""
    return counts.groupBy(key).agg(F.sum(F.col("n") * F.col("n")).alias("norm2"))


def term_bags(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bag): the terms of each document, repeats included, sorted and joined by spaces; rows of one key are one document.

    A bag is made within its row and moves once, as one string: no task holds counts of more than one document.
    """
    bag = F.array_join(F.sort_array(tokens(F.col(text))), " ")
    return docs.select(key, bag.alias("bag")).groupBy(key).agg(F.array_join(F.collect_list(F.when(F.col("bag") != "", F.col("bag"))), " ").alias("bag"))


def bags(counts: DataFrame, key: str) -> DataFrame:
    """(key, bag) of counts (key, term, n), or of bags themselves."""
    if "bag" in counts.columns:
        return counts
    return counts.groupBy(key).agg(F.array_join(F.flatten(F.collect_list(F.array_repeat("term", F.col("n").cast("int")))), " ").alias("bag"))


def _products(batches):
    for batch in batches:
        at = batch.schema.get_field_index
        found = []
        for a, b in zip(batch.column(at("bag_a")), batch.column(at("bag_b"))):
            x, y = Counter(a.as_py().split()), Counter(b.as_py().split())
            less, more = (x, y) if len(x) < len(y) else (y, x)
            found.append((sum(n * more[t] for t, n in less.items() if t in more), sum(n * n for n in x.values()), sum(n * n for n in y.values())))
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(at("a")), batch.column(at("b")), *columns], ["a", "b", "dot", "na2", "nb2"])


def pair_cosine(pairs: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """pairs (a, b, ...) with score: the cosine of their counts, null if either has no terms.

    counts: (key, term, n) or, without a row for each term, (key, bag). Bags meet by id, and what they have in common is
    counted within the pair, so a bag moves twice and its terms never do.
    """
    held = bags(counts, key)
    both = pairs.select("a", "b").distinct().join(held.select(F.col(key).alias("a"), F.col("bag").alias("bag_a")), "a").join(held.select(F.col(key).alias("b"), F.col("bag").alias("bag_b")), "b")
    kinds = {c: both.schema[c].dataType.simpleString() for c in ("a", "b")}
    products = in_arrow(both, _products, f"a {kinds['a']}, b {kinds['b']}, dot long, na2 long, nb2 long")
    score = F.when((F.col("na2") > 0) & (F.col("nb2") > 0), F.col("dot") / (F.sqrt("na2") * F.sqrt("nb2")))
    return pairs.join(products.select("a", "b", score.alias("score")), ["a", "b"], "left")


def expanding_idf(counts: DataFrame, years: DataFrame, key: str, min_docs: int = MIN_DOCS, min_df: int = MIN_DF) -> DataFrame:
    """(year, term, idf) from the rows of strictly earlier years.

    years: (key, year, fits), one row for each filing; a document filed twice counts twice, and
    only rows with `fits` are learned from. A year with fewer than min_docs earlier rows has no
    terms, nor has a term in fewer than min_df of them. idf = ln((1 + n) / (1 + df)) + 1.
    """
    base = years.where("fits").groupBy("year").agg(F.count(F.lit(1)).alias("c"))
    every = years.select("year").distinct().join(base, "year", "left")
    before = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # one row a year
    sizes = every.select("year", F.sum(F.coalesce("c", F.lit(0))).over(before).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    held = years.join(bags(counts, key).where("bag <> ''"), key).select("year", "fits", F.explode(F.array_distinct(F.split("bag", " "))).alias("term"))
    by_year = held.groupBy("term", "year").agg(F.count_if("fits").alias("df")).where("df > 0")
    own = Window.partitionBy("term").orderBy("year")
    # A sum holds from the year after its own to the next year that has the term, whether or not the years between have it.
    summed = by_year.select("term", (F.col("year") + 1).alias("first"), F.lead("year").over(own).alias("next"), F.sum("df").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("df"))
    last = sizes.agg(F.max("year").alias("last")).where("last IS NOT NULL")  # one row
    spans = summed.where(F.col("df") >= min_df).join(F.broadcast(last)).withColumn("until", F.least(F.coalesce("next", "last"), F.col("last"))).where("first <= until")
    known = spans.select("term", "df", F.explode(F.sequence("first", "until")).alias("year"))
    return known.join(sizes, "year").select("year", "term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def _terms(batches):
    for batch in batches:
        found = defaultdict(set)
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
        places = list(zip(column("block").to_pylist(), column("year").to_pylist()))
        for name in batch.schema.names:
            if name.startswith("bag"):
                for place, bag in zip(places, column(name)):
                    found[place].update(bag.as_py().split())
        rows = [(block, year, term) for (block, year), terms in found.items() for term in terms]
        kinds = {"block": pa.int32(), "year": batch.schema.field("year").type, "term": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))


def weighed(rows: DataFrame, idf: DataFrame, by: str, function, schema: str) -> DataFrame:
    """What `function(rows, weights)` gives for each block of rows (year, bag..., ...) and the weights {year: {term: idf}} of its terms.

    Blocks are dealt by the column `by`. Only the distinct terms of a block and year meet the weights, and only these go back to
    it; entries of single documents never move. A block is one group in Python, 1 / BLOCKS of the bags.
    """
    ship(rows.sparkSession)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(by), F.lit(BLOCKS)).cast("int")).repartition("block")
    # All columns are read, so that this is the exchange which the blocks use as well.
    needed = in_arrow(dealt, _terms, f"block int, year {rows.schema['year'].dataType.simpleString()}, term string").distinct()
    known = needed.join(idf, ["year", "term"]).select("block", "year", "term", "idf")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        weights = defaultdict(dict)
        for year, term, w in zip(*(right.column(c).to_pylist() for c in ("year", "term", "idf"))):
            weights[year][term] = w
        return function(left, weights)

    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(both, schema)


def _tfidf(pairs: pa.Table, weights: dict) -> pa.Table:
    scores = []
    for year, a, b in zip(*(pairs.column(c) for c in ("year", "bag_a", "bag_b"))):
        w = weights.get(year.as_py(), {})
        x, y = ({t: n * w[t] for t, n in Counter(bag.as_py().split()).items() if t in w} for bag in (a, b))
        score = sum(v * y[t] for t, v in x.items() if t in y) / (math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))) if x and y else None
        scores.append(score)
    return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "year": pairs.column("year"), "score": pa.array(scores, pa.float64())})


def pair_tfidf(pairs: DataFrame, counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """pairs (a, b, year, ...) with score: the cosine of their TF-IDF vectors under the idf of the pair's year; null if either is empty.

    counts: (key, term, n) or (key, bag), as for pair_cosine.
    """
    held = bags(counts, key)
    ids = pairs.select("a", "b", "year").distinct()
    met = ids.join(held.select(F.col(key).alias("a"), F.col("bag").alias("bag_a")), "a").join(held.select(F.col(key).alias("b"), F.col("bag").alias("bag_b")), "b")
    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("a", "b", "year"))
    return pairs.join(weighed(met, idf, "b", _tfidf, f"{kinds}, score double"), ["a", "b", "year"], "left")
