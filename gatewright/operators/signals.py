"""Further text signals: tone, novelty, and distance of embeddings."""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.text import term_counts, weighed


def tone(docs: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_terms, n_hits, rate): the share of a document's terms that are in the lexicon (term); null without terms.

    The lexicon is joined, so its size does not matter; only counts are shuffled.
    """
    counts = term_counts(docs, key, text)
    hit = lexicon.select("term").distinct().withColumn("hit", F.lit(True))
    marked = counts.join(hit, "term", "left")
    rates = marked.groupBy(key).agg(F.sum("n").alias("n_terms"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("n_hits"))
    out = docs.select(key).join(rates, key, "left").fillna(0, ["n_terms", "n_hits"])
    return out.withColumn("rate", F.try_divide("n_hits", "n_terms"))


def sentences(text: Column) -> Column:
    """Distinct sentences of a text, normalised: lower case, single spaces."""
    parts = F.split(text, r"[.!?\n]+")
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), r"\s+", " ")))
    return F.array_distinct(F.filter(clean, lambda s: s != ""))


def novelty(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """pairs (a, b) with n_sentences, n_new, novel_share: sentences of a that its predecessor b lacks; null without sentences.

    Sentences travel as 64-bit hashes.
    """
    hashes = docs.select(key, F.explode(sentences(F.col(text))).alias("s")).select(key, F.xxhash64("s").alias("h"))
    mine = pairs.select("a", "b").join(hashes.withColumnRenamed(key, "a"), "a")
    theirs = hashes.select(F.col(key).alias("b"), "h", F.lit(True).alias("old"))
    counted = mine.join(theirs, ["b", "h"], "left").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("old").isNull()).alias("n_new"))
    out = pairs.join(counted, ["a", "b"], "left").fillna(0, ["n_sentences", "n_new"])
    return out.withColumn("novel_share", F.try_divide("n_new", "n_sentences"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine of two arrays; null if either is null or nil."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Entries of a hashed vector.
WIDTH = 256


def _hashed(key: str, width: int):
    def vectors(docs: pa.Table, weights: dict) -> pa.Table:
        places, keys, found = {}, [], []
        for k, year, bag in zip(*(docs.column(c) for c in (key, "year", "bag"))):
            w = weights.get(year.as_py(), {})
            counts = {t: n for t, n in Counter(bag.as_py().split()).items() if t in w}
            if counts:
                vector = [0.0] * width
                for t, n in counts.items():
                    if t not in places:
                        digest = hashlib.md5(t.encode()).hexdigest()
                        places[t] = int(digest[:8], 16) % width, 1.0 if digest[8] < "8" else -1.0
                    entry, sign = places[t]
                    vector[entry] += sign * n * w[t]
                keys.append(k)
                found.append(vector)
        column = pa.array([k.as_py() for k in keys], docs.schema.field(key).type)
        return pa.table({key: column, "vector": pa.array(found, pa.list_(pa.float64()))})

    return vectors


def hashed_vectors(held: DataFrame, key: str, weights: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, vector): documents as arrays of `width` entries, by signed feature hashing of their terms.

    held: (key, year, bag), a row a document, see term_bags; weights: (year, term, idf), by which counts are multiplied. A term
    without a weight is left out, a document without terms has no row. The MD5 of a term gives its entry and
    its sign, so the dot product of two vectors is that of their terms, give or take collisions that cancel
    on average. A document moves as one bag and goes on as `width` numbers.
    """
    kind = held.schema[key].dataType.simpleString()
    return weighed(held.select(key, "year", "bag"), weights, key, _hashed(key, width), f"{key} {kind}, vector array<double>")


def vector_distances(pairs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """pairs (a, b, ...) with distance: 1 less the cosine of their vectors; null if either has none."""
    side = lambda c: vectors.select(F.col(key).alias(c), F.col("vector").alias(f"_{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.select(*pairs.columns, cosine_distance(F.col("_a"), F.col("_b")).alias("distance"))
