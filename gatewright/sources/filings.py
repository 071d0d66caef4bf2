"""Filings and their texts: the index feed, the ticker map, read-through stores, a paced HTTP client."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.functions.html import PARSER_VERSION, html_to_text
from gatewright.operators.documents import archive_url
from gatewright.schemas import FILINGS

REQUESTS_PER_SECOND = 8
RETRIED = frozenset({403, 429, 500, 502, 503})
#: The parallel arrays of a block of the feed, and what they become.
BLOCK = "struct<form:array<string>,accessionNumber:array<string>,reportDate:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,primaryDocument:array<string>>"


class SourceMissing(FileNotFoundError):
    """An input is not there; the library never makes up data in its place."""


class Pacer:
    """At most so many calls a second in this process."""

    def __init__(self, per_second: float = REQUESTS_PER_SECOND, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.gap, self.clock, self.sleep, self.last = 1 / per_second, clock, sleep, float("-inf")

    def wait(self) -> None:
        left = self.last + self.gap - self.clock()
        if left > 0:
            self.sleep(left)
        self.last = self.clock()


def fetch(url: str, agent: str, pacer: Pacer, retries: int = 4, opener: Callable = urllib.request.urlopen) -> bytes:
    """Body of url. Busy answers are tried again after 2, 4, 8, ... seconds; other refusals are raised at once."""
    for attempt in range(retries):
        pacer.wait()
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": agent})) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED:
                raise
            pacer.sleep(2 * 2**attempt)
    raise RuntimeError(f"gave up on {url} after {retries} tries")


def ticker_map(raw: DataFrame, column: str = "value") -> DataFrame:
    """(ticker, cik) from the JSON object of rows that lists companies."""
    rows = F.explode(F.map_values(F.from_json(column, "map<string,struct<cik_str:bigint,ticker:string,title:string>>"))).alias("r")
    return raw.select(rows).select(F.upper("r.ticker").alias("ticker"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"))


def resolve(tickers: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticker, cik) of each ticker, null where unknown; and the unknown ones."""
    asked = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    return asked.join(known, "ticker", "left"), asked.join(known, "ticker", "left_anti")


def unpack(feed: DataFrame, forms: Iterable[str], recent: str = "recent", overflow: str = "overflow") -> DataFrame:
    """Filings from (ticker, cik, recent, overflow): structs of parallel arrays, the second an array of such.

    Forms match exactly, so amendments are left out; rows without a document are dropped.
    """
    blocks = feed.select("ticker", "cik", F.explode(F.concat(F.array(recent), F.coalesce(overflow, F.array().cast(f"array<{BLOCK}>")))).alias("b"))
    zipped = F.arrays_zip(*[F.col(f"b.{n}") for n in ("form", "accessionNumber", "reportDate", "filingDate", "acceptanceDateTime", "primaryDocument")])
    rows = blocks.select("ticker", "cik", F.inline(zipped))
    return rows.where(F.col("form").isin(*forms) & (F.coalesce("primaryDocument", F.lit("")) != "")).select(
        "cik", "ticker", "form", F.col("accessionNumber").alias("accession"),
        F.expr("try_to_date(reportDate)").alias("period_end"), F.expr("try_to_date(filingDate)").alias("filing_date"),
        F.expr("try_to_timestamp(acceptanceDateTime)").alias("acceptance_datetime"), F.col("primaryDocument").alias("primary_document"),
    )


def accepted_between(index: DataFrame, start: str, end: str, column: str = "acceptance_datetime") -> DataFrame:
    """Rows whose acceptance date, as written (first ten characters), is in the closed range."""
    return index.where(F.substring(F.col(column).cast("string"), 1, 10).between(start, end))


def filings_frame(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), FILINGS)


def with_url(index: DataFrame) -> DataFrame:
    return index.withColumn("url", archive_url(F.col("cik"), F.col("accession"), F.col("primary_document")))


def write_index(index: DataFrame, path: str) -> None:
    """The index, rewritten whole; an empty one is an error."""
    if index.isEmpty():
        raise ValueError("no filings to write")
    index.orderBy("ticker", "acceptance_datetime", "accession").write.mode("overwrite").parquet(path)


def not_stored(index: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct documents of the index that a store (accession, ...) lacks: what is left to fetch or to parse."""
    return index.select("accession").distinct().join(store.select("accession"), "accession", "left_anti")


def add_texts(pages: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """Parse the pages (accession, html) that the text store lacks, append them under this parser's version, and return them with errors."""
    new = html_to_text(pages.join(texts.where(F.col("parser_version") == PARSER_VERSION).select("accession"), "accession", "left_anti"), "accession", "html")
    new.where("text IS NOT NULL").withColumn("parser_version", F.lit(PARSER_VERSION)).write.mode("append").partitionBy("parser_version").parquet(path)
    return new


def build_report(outcomes: DataFrame) -> DataFrame:
    """Counts of a corpus build from (ticker, accession, error): rows, documents, tickers, done and failed."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("accession").alias("n_documents"), F.count_distinct("ticker").alias("n_tickers"),
        F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def index_summary(index: DataFrame, date: str = "acceptance_datetime") -> DataFrame:
    """One row: rows, documents and tickers of an index, and its first and last date."""
    day = F.col(date).cast("date")
    return index.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("accession").alias("n_documents"), F.count_distinct("ticker").alias("n_tickers"),
        F.min(day).alias("first_date"), F.max(day).alias("last_date"),
    )
