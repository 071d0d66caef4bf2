"""Rows of documents: the first of each, the one before, annual gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.functions.timeops import whole_days

MIN_GAP_DAYS, MAX_GAP_DAYS = 250, 550


def first_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the stated order. The whole row travels as one aggregate, so each task sends one row a key."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def _stretched(df: DataFrame, stretch: Column) -> DataFrame:
    return df.withColumn("_stretch", F.coalesce(stretch.cast("long"), F.lit(-(2**63))))


def with_previous(df: DataFrame, key: str, order: tuple[str, ...], columns: tuple[str, ...], stretch: Column | None = None) -> DataFrame:
    """df with prev_<column> of the row before in its key; a null key has no row before.

    With stretch, a number that never falls along the order, rows are ordered stretch by stretch, and the first
    of a stretch follows the last one of the stretch before: no task orders all rows of a key.
    """
    if stretch is None:
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumns({f"prev_{c}": F.when(F.col(key).isNotNull(), F.lag(c).over(w)) for c in columns})
    rows = _stretched(df, stretch)
    own = Window.partitionBy(key, "_stretch").orderBy(*order)
    lasts = rows.groupBy(key, "_stretch").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    before = lasts.select(key, "_stretch", F.lag("_last").over(Window.partitionBy(key).orderBy("_stretch")).alias("_before"))
    placed = rows.withColumns({f"prev_{c}": F.lag(c).over(own) for c in columns} | {"_at": F.row_number().over(own)}).join(before, [key, "_stretch"], "left")
    found = {f"prev_{c}": F.when(F.col(key).isNotNull(), F.when(F.col("_at") == 1, F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}"))) for c in columns}
    return placed.withColumns(found).select(*df.columns, *found)


def numbered(df: DataFrame, key: str, order: tuple[str, ...], out: str, stretch: Column) -> DataFrame:
    """df with `out`: the number of each row in its key, from 1; rows are ordered stretch by stretch, see with_previous."""
    rows = _stretched(df, stretch)
    sizes = rows.groupBy(key, "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(key, "_stretch", (F.sum("_n").over(Window.partitionBy(key).orderBy("_stretch")) - F.col("_n")).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(key, "_stretch").orderBy(*order))
    return rows.withColumn("_own", own).join(offsets, [key, "_stretch"], "left").withColumn(out, (F.col("_own") + F.col("_offset")).cast("int")).select(*df.columns, out)


def with_gap(df: DataFrame, now: str, before: str) -> DataFrame:
    """df with gap_days, and gap_ok: whether it is a year, give or take."""
    gap = whole_days(F.col(now), F.col(before))
    return df.withColumn("gap_days", gap).withColumn("gap_ok", gap_ok(F.col("gap_days")))


def gap_ok(gap: Column) -> Column:
    return F.coalesce(gap.between(MIN_GAP_DAYS, MAX_GAP_DAYS), F.lit(False))


def archive_url(cik: Column, accession: Column, document: Column, base: str = "https://www.sec.gov/Archives/edgar/data") -> Column:
    """Address of a filing's document: the cik without leading zeros, the accession without dashes."""
    return F.concat_ws("/", F.lit(base), cik.cast("bigint").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)
