"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import DataFrame

FILINGS = "cik STRING, ticker STRING, form STRING, accession STRING, period_end DATE, filing_date DATE, acceptance_datetime TIMESTAMP, primary_document STRING"
TEXTS = "accession STRING, text STRING"
STORED_TEXTS = TEXTS + ", parser_version INT"
PAGES = "accession STRING, html STRING"
ALIGNED = (
    "ticker STRING, accession STRING, prev_accession STRING, period_end DATE, acceptance_datetime TIMESTAMP, signal_date DATE, "
    "score DOUBLE, extraction_failed BOOLEAN, failure_reason STRING, gap_days BIGINT, gap_ok BOOLEAN"
)
PANEL = "date DATE, symbol STRING, value DOUBLE"
FF5 = "date DATE, mkt_rf DOUBLE, smb DOUBLE, hml DOUBLE, rmw DOUBLE, cma DOUBLE, rf DOUBLE"
MOMENTUM = "date DATE, mom DOUBLE"
MEMBERSHIP = "symbol STRING, index_name STRING, valid_from DATE, valid_to DATE"
CLASSIFICATIONS = "symbol STRING, sector STRING, quoteType STRING"
TRIAL = "STRUCT<family: STRING, signal: STRING, params: STRING, universe: STRING, start: STRING, end: STRING, note: STRING, recorded_at: STRING>"
LEDGER = f"index BIGINT, prev_hash STRING, trial {TRIAL}, outcome STRING, amends BIGINT, entry_hash STRING"
STEPS = "ordinal INT, gate STRING, sharpe DOUBLE, passed BOOLEAN, detail STRING, give_up DOUBLE, found DOUBLE"


class SchemaMismatch(ValueError):
    """A table does not have the columns that an operator needs."""


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaMismatch(f"missing columns {missing}; found {df.columns}")
    return df
