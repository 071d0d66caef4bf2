"""Filings as a stream. Batch has no need of it; it is here for feeds that never end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewright.operators.audit import gap_rows
from gatewright.schemas import FILINGS


def filings_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New parquet files of filings at path, as they come."""
    return spark.readStream.schema(FILINGS).option("maxFilesPerTrigger", max_files).parquet(path)


def first_seen(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """The first row of each accession, as long as copies come within the delay of each other; state is dropped after it."""
    return stream.withWatermark("acceptance_datetime", delay).dropDuplicatesWithinWatermark(["accession"])


def late_signals(stream: DataFrame, embargo_days: float = 1) -> DataFrame:
    """Aligned rows (signal_date, acceptance_datetime) that breach the embargo, as they come."""
    return gap_rows(stream).where(f"gap < {float(embargo_days)}")
