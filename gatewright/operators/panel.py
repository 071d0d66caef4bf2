"""Long market panels (date, symbol, value): returns, liquidity, coverage, membership, universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingSymbols(KeyError):
    """Symbols were asked for that the panel does not have."""


def in_range(panel: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Rows with start <= date <= end; an open side is not filtered."""
    if start is not None:
        panel = panel.where(F.col(date) >= F.lit(start).cast("date"))
    return panel if end is None else panel.where(F.col(date) <= F.lit(end).cast("date"))


def missing_symbols(asked: DataFrame, panel: DataFrame) -> DataFrame:
    """Symbols that are asked for and absent from the panel."""
    return asked.select("symbol").distinct().join(panel.select("symbol").distinct(), "symbol", "left_anti")


def load_prices(panel: DataFrame, symbols: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The panel of the symbols in the range; absent symbols are an error, not silence."""
    if symbols is not None:
        absent = [r[0] for r in missing_symbols(symbols, panel).orderBy("symbol").limit(5).collect()]
        if absent:
            raise MissingSymbols(f"absent from the price panel, for example {absent}")
        panel = panel.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return in_range(panel, start, end)


def load_dollar_adv(panel: DataFrame, symbols: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """As load_prices, but absent symbols are left out."""
    if symbols is not None:
        panel = panel.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return in_range(panel, start, end)


def densified(panel: DataFrame) -> DataFrame:
    """One row for each symbol and each date of the panel, null where it has none. Dates are collected as one array: a calendar."""
    dates = panel.agg(F.sort_array(F.collect_set("date")).alias("dates"))
    cells = panel.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("date", "value"))).alias("m"))
    grid = cells.join(F.broadcast(dates))  # one row of one array
    return grid.select("symbol", F.explode("dates").alias("date"), "m").select("date", "symbol", F.try_element_at("m", F.col("date")).alias("value"))


def returns(panel: DataFrame, start: str | None = None, end: str | None = None, fill: bool = True, pad_days: int = 10) -> DataFrame:
    """(date, symbol, ret): value over the one before, less one; the range is cut after the change is taken.

    Each symbol is densified over all dates of the panel; with fill, gaps carry the last value
    forward first.
    """
    padded = panel
    if start is not None:
        padded = panel.where(F.col("date") >= F.date_sub(F.lit(start).cast("date"), pad_days))
    if end is not None:
        padded = in_range(padded, None, end)
    w = Window.partitionBy("symbol").orderBy("date")
    grid = densified(padded)
    if fill:
        grid = grid.withColumn("value", F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = grid.select("date", "symbol", (F.try_divide("value", F.lag("value").over(w)) - 1).alias("ret"))
    return in_range(out, start, end)


def dollar_adv(volume: DataFrame, window: int = 21) -> DataFrame:
    """(date, symbol, value): mean dollar volume over the last `window` rows of a symbol."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - window, 0)
    return volume.select("date", "symbol", F.avg("value").over(w).alias("value"))


def coverage(panel: DataFrame) -> DataFrame:
    """(symbol, coverage): the share of the panel's dates on which a symbol has a value."""
    dates = panel.agg(F.count_distinct("date").alias("n_dates"))
    have = panel.groupBy("symbol").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("date"))).alias("n"))
    return have.join(F.broadcast(dates)).select("symbol", (F.col("n") / F.col("n_dates")).alias("coverage"))  # one row


def live(day: Column) -> Column:
    return (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))


def members_on(membership: DataFrame, day: str, index_name: str = "sp500") -> DataFrame:
    """Symbols in the index on a day; intervals hold both ends, a null end is open."""
    return membership.where((F.col("index_name") == index_name) & live(F.lit(day).cast("date"))).select("symbol").distinct()


def members_by_date(membership: DataFrame, dates: DataFrame, index_name: str = "sp500") -> DataFrame:
    """(date, symbol) of the members on each date of a table (date): a point-in-time universe.

    Intervals are cut to months and joined by month, so no range join is needed.
    """
    last = dates.agg(F.max("date").alias("last"))
    spans = membership.where(F.col("index_name") == index_name).join(F.broadcast(last)).where("valid_from <= last")
    months = spans.withColumn("month", F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc(F.least(F.coalesce("valid_to", "last"), F.col("last")), "month"), F.expr("interval 1 month")))) \
        .select("symbol", "valid_from", "valid_to", "month")
    asked = dates.select("date", F.trunc("date", "month").alias("month")).distinct()
    return asked.join(months, "month").where(live(F.col("date"))).select("date", "symbol").distinct()


def overlapping(membership: DataFrame, start: str, end: str, index_name: str = "sp500") -> DataFrame:
    """Symbols whose membership meets the window."""
    hit = (F.col("valid_from") <= F.lit(end).cast("date")) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(start).cast("date")))
    return membership.where((F.col("index_name") == index_name) & hit).select("symbol").distinct()


def common_stocks(classifications: DataFrame) -> DataFrame:
    return classifications.where("quoteType = 'EQUITY'").select("symbol").distinct()


def sectors(classifications: DataFrame) -> DataFrame:
    return classifications.select("symbol", "sector")


def liquid_universe(
    adv: DataFrame, prices: DataFrame, membership: DataFrame, classifications: DataFrame, start: str, end: str, top_n: int = 200, index_name: str | None = "sp500"
) -> DataFrame:
    """(symbol, median_adv) of the top_n by median dollar volume over the window, most liquid first, ties by symbol.

    One list for the whole window: members at some time in it, ordinary equity, priced on over
    half of its dates. Not point in time, on purpose; members_by_date is.
    """
    pool = in_range(adv, start, end)
    if index_name:
        pool = pool.join(overlapping(membership, start, end, index_name), "symbol", "left_semi").join(common_stocks(classifications), "symbol", "left_semi")
    covered = coverage(in_range(prices, start, end)).where("coverage > 0.5").select("symbol")
    ranked = pool.join(covered, "symbol", "left_semi").where("value IS NOT NULL").groupBy("symbol").agg(F.median("value").alias("median_adv"))
    return ranked.orderBy(F.desc("median_adv"), "symbol").limit(top_n)


def factors(ff5: DataFrame, momentum: DataFrame) -> DataFrame:
    """Five factors and momentum on their common dates."""
    return ff5.join(momentum, "date")


def former_tickers(tickers: DataFrame, names: DataFrame) -> DataFrame:
    """tickers (ticker, date) with the cik that used the ticker on the date, by names (ticker, cik, valid_from, valid_to); null if none did.

    A row for each one asked, whatever its name's intervals: of several that hold on the date the one that
    began last counts, of those the greatest cik. A ticker's intervals are one row, so dates meet them
    by ticker alone, not by range.
    """
    spans = names.where("ticker IS NOT NULL").groupBy("ticker").agg(F.collect_list(F.struct("valid_from", "valid_to", "cik")).alias("spans"))
    holds = F.filter("spans", lambda s: (s["valid_from"] <= F.col("date")) & (s["valid_to"].isNull() | (s["valid_to"] >= F.col("date"))))
    last = F.array_max(F.transform(holds, lambda s: F.struct(s["valid_from"].alias("valid_from"), s["cik"].alias("cik"))))
    return tickers.join(spans, "ticker", "left").select("ticker", "date", last["cik"].alias("cik"))
