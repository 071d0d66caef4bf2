"""Market tables: parquet with stated schemas, wide panels, and the text of a factor file."""

from __future__ import annotations

import io
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.sources.filings import SourceMissing

#: What the vendor writes for a missing value, in per cent.
MISSING = (-99.99, -999.0)


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A parquet table with the stated columns; SourceMissing if there is none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SourceMissing(path) from e
        raise
    if schema is None:
        return df
    fields = spark.createDataFrame([], schema).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def from_wide(wide: DataFrame, date: str = "date") -> DataFrame:
    """(date, symbol, value) of a panel with one column a symbol; absent cells are not rows."""
    symbols = [c for c in wide.columns if c != date]
    long = wide.select(F.to_date(date).alias("date"), *symbols).unpivot("date", symbols, "symbol", "value")
    return long.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))


def parse_momentum(lines: DataFrame, column: str = "value") -> DataFrame:
    """(date, mom) from the lines of a factor file: two fields, the first of eight digits; per cent become shares, missing codes null."""
    parts = F.transform(F.split(column, ","), lambda p: F.trim(p))
    rows = lines.select(parts.alias("p")).where((F.size("p") == 2) & F.col("p")[0].rlike("^[0-9]{8}$"))
    value = F.expr("try_cast(p[1] AS double)")
    return rows.select(F.to_date(F.col("p")[0], "yyyyMMdd").alias("date"), F.when(~value.isin(*MISSING), value / 100.0).alias("mom"))


def read_momentum(spark: SparkSession, path: str) -> DataFrame:
    """The factor file at path, as text or as the first member of a zip; one without any row is an error.

    A zip has one row a trading date, some megabyte in all, and is opened on the driver.
    """
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(spark.read.format("binaryFile").load(path).select("content").first().content)) as z:
            text = z.read(z.namelist()[0]).decode("latin-1")
        lines = spark.createDataFrame([(x,) for x in text.splitlines()], "value string")
    else:
        lines = spark.read.text(path)
    out = parse_momentum(lines)
    if out.isEmpty():
        raise ValueError(f"no momentum rows in {path}")
    return out


def stored_momentum(spark: SparkSession, source: str, path: str) -> DataFrame:
    """The factor kept as Parquet at path; if there is none, it is read from source and written there first."""
    try:
        return read_parquet(spark, path, "date DATE, mom DOUBLE")
    except SourceMissing:
        read_momentum(spark, source).coalesce(1).write.parquet(path)
        return read_parquet(spark, path, "date DATE, mom DOUBLE")
