"""A corpus in five stages: quality, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. The result of a stage is written
as Parquet and read again as the next one's docs, so a lost executor costs one stage at most; what
the stage before wrote is then deleted. All but the last return the columns of documents, whatever
those are and are called.

In every stage a null text counts as empty, and stays null where the row stays; an empty table
gives an empty one. Whether rows without an id and repeated rows stay is said with each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm.common import remove_folder, shared_folder, shuffles_freed, table
from gatewright.llm.exact_dedup import exact_dedup
from gatewright.llm.near_texts import alike_dedup
from gatewright.llm.packing import pack_documents
from gatewright.llm.pii import find_pii
from gatewright.llm.quality import fit_quality, score_quality
from gatewright.llm.queries import QUALITY_BOUND, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score QUALITY_BOUND or more; the others go.

    Each row is judged by its text alone: repeated rows stay or go together, also those without
    an id. An empty text has a score too. Without labels all rows stay.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where(F.col("score") >= QUALITY_BOUND).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without blanks: the longest, of those the smallest doc_id.

    A null doc_id counts as the smallest. Empty and null texts are one group. Of repeated rows one stays.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a similarity of 0.8 or more: one of its smallest doc_id.

    A null doc_id counts as the smallest. Texts without words are alike. Of repeated rows one stays.
    """
    return alike_dedup(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by their kinds; n_chars is that of the new text (0 for null).

    Each row is taken by itself, so repeated rows and those without an id stay as many.
    """
    found = find_pii(docs)
    changed = {"text": F.when(F.col("row.text").isNotNull(), F.col("clean")), "n_chars": F.length("clean").cast("long")}
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their ids.

    A document without text is its end id alone; repeated rows, and those without an id, are packed one by one.
    """
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("personal", personal), ("packing", packing)]

#: SQL has neither the fitted rules nor the field of the personal-data stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, in the shared checkpoint folder between them. Runs when it is called; only the last result is kept there."""
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with shuffles_freed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{home}/{name}"
    return docs
