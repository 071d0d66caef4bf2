"""The year-over-year similarity signal: filings and their texts in, one aligned row a filing out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.functions.sections import DEFAULT_SECTIONS, extract_all
from gatewright.functions.text import expanding_idf, pair_cosine, pair_tfidf, term_bags
from gatewright.functions.timeops import align
from gatewright.operators.documents import MAX_GAP_DAYS, MIN_GAP_DAYS, with_gap, with_previous
from gatewright.schemas import require

WEIGHTINGS = ("count", "tfidf")
COLUMNS = ("ticker", "accession", "prev_accession", "period_end", "acceptance_datetime", "signal_date", "score", "extraction_failed", "failure_reason", "gap_days", "gap_ok")


@dataclass(frozen=True)
class Signal:
    """An aligned frame, its parameters, and a lazy one-row table of diagnostics."""

    aligned: DataFrame
    params: dict = field(default_factory=dict)
    diagnostics: DataFrame | None = None

    def usable(self) -> DataFrame:
        return self.aligned.where(~F.col("extraction_failed") & F.col("gap_ok"))


def section_bodies(filings: DataFrame, texts: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """(accession, body, section_failed, failure_reason), once for each accession of the filings; a missing text is a failure."""
    wanted = filings.select("accession").distinct()
    found = extract_all(wanted.join(texts.select("accession", "text"), "accession", "left"), "text", sections)
    missing = F.col("text").isNull()
    return found.select(
        "accession", "body", (missing | F.col("section_failed")).alias("section_failed"),
        F.when(missing, F.lit("text unavailable")).otherwise(F.col("failure_reason")).alias("failure_reason"),
    )


def score_filings(filings: DataFrame, bodies: DataFrame, weighting: str = "count") -> DataFrame:
    """filings (ticker, accession, period_end, acceptance_datetime) with the previous filing, gaps, flags and score.

    The previous filing is found by id; bodies meet only as bags of terms.
    """
    if weighting not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {weighting!r}; known: {WEIGHTINGS}")
    rows = filings.join(bodies.select("accession", "section_failed", "failure_reason"), "accession", "left")
    rows = with_previous(rows, "ticker", ("acceptance_datetime", "accession"), ("accession", "section_failed", "acceptance_datetime"), F.year("acceptance_datetime"))
    rows = with_gap(rows, "acceptance_datetime", "prev_acceptance_datetime")
    fit = ~F.coalesce("section_failed", F.lit(True)) & ~F.coalesce("prev_section_failed", F.lit(True))
    pairs = rows.where(fit).select(F.col("accession").alias("a"), F.col("prev_accession").alias("b"), F.year("acceptance_datetime").alias("year")).distinct()
    read = bodies.where(~F.col("section_failed"))
    if weighting == "count":
        scored = pair_cosine(pairs.select("a", "b").distinct(), term_bags(read, "accession", "body"), "accession")
        on = (F.col("accession") == F.col("a")) & (F.col("prev_accession") == F.col("b")) & fit
    else:
        counts = term_bags(read, "accession", "body")
        years = rows.select("accession", F.year("acceptance_datetime").alias("year"), (~F.col("section_failed")).alias("fits"))
        scored = pair_tfidf(pairs, counts, expanding_idf(counts, years, "accession"), "accession")
        on = (F.col("accession") == F.col("a")) & (F.col("prev_accession") == F.col("b")) & (F.year("acceptance_datetime") == F.col("year")) & fit
    return rows.join(scored, on, "left").drop("a", "b", "year")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with extraction_failed: it or the one before failed, there is none before, or no score. No row is dropped."""
    failed = F.coalesce("section_failed", F.lit(True)) | F.coalesce("prev_section_failed", F.lit(True)) | F.col("score").isNull()
    return rows.withColumn("extraction_failed", failed)


def diagnostics(rows: DataFrame) -> DataFrame:
    """One row of counts and rates over the scored rows (with section_failed, extraction_failed, gap_ok)."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_filings"),
        F.count_distinct("accession").alias("n_documents"),
        F.count_if(F.col("prev_accession").isNull()).alias("n_first_filing_no_prior"),
        rate("section_failed").alias("section_failure_rate"),
        rate("extraction_failed").alias("pair_failure_rate"),
        F.count_if(~F.col("gap_ok")).alias("gap_rejected"),
        F.count_if(~F.col("extraction_failed") & F.col("gap_ok")).alias("n_usable"),
        F.avg("score").alias("score_mean"),
        F.stddev_samp("score").alias("score_std"),
    )


def build(
    filings: DataFrame,
    texts: DataFrame,
    calendar: DataFrame,
    sections: tuple[str, ...] = DEFAULT_SECTIONS,
    alignment: str = "acceptance",
    weighting: str = "count",
    embargo_days: int = 1,
) -> Signal:
    """The signal of a filings index (ticker, accession, period_end, acceptance_datetime) and its texts (accession, text)."""
    require(filings, "ticker", "accession", "period_end", "acceptance_datetime")
    scored = score_filings(filings.select("ticker", "accession", "period_end", "acceptance_datetime"), section_bodies(filings, texts, sections), weighting)
    rows = flagged(align(scored, calendar, alignment, embargo_days))
    params = {
        "sections": list(sections), "alignment": alignment, "weighting": weighting, "embargo_days": embargo_days,
        "min_gap_days": MIN_GAP_DAYS, "max_gap_days": MAX_GAP_DAYS,
    }
    return Signal(rows.select(*COLUMNS), params, diagnostics(rows))
