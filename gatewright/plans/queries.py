"""Queries over the driver's tables, each through the library's operators. Tables stand in for filings and markets as named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewright.functions.html import html_to_text
from gatewright.functions.sections import extract_all
from gatewright.functions.text import expanding_idf, norms, pair_cosine, pair_tfidf, term_bags, term_counts
from gatewright.functions.timeops import align, weekdays
from gatewright.operators import panel
from gatewright.operators.asof import scores_as_of, universe_by_date
from gatewright.operators.audit import gap_rows, twin_audit
from gatewright.operators.documents import archive_url, first_per, numbered, with_gap, with_previous
from gatewright.operators.lazy_prices import build, diagnostics, flagged, score_filings
from gatewright.operators import traits as stock_traits
from gatewright.operators.signals import hashed_vectors, novelty, tone, vector_distances
from gatewright.plans import gates, holdings
from gatewright.plans.ledger import GENESIS, link_check, trial_counts
from gatewright.plans.verdict import fold, give_ups
from gatewright.sources.filings import BLOCK, accepted_between, index_summary, unpack
from gatewright.sources.market import from_wide, parse_momentum

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Events as filings: ticker is the user, acceptance the event's time in UTC, the period ends 45 days earlier.


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("ticker"), F.col("event_id").cast("string").alias("accession"),
        F.col("ts").cast("timestamp").alias("acceptance_datetime"), F.date_sub(F.col("ts").cast("date"), 45).alias("period_end"),
    )


def calendar(rows: DataFrame) -> DataFrame:
    day = F.col("acceptance_datetime").cast("date")
    return weekdays(rows.agg(F.date_sub(F.min(day), 10).alias("a"), F.date_add(F.max(day), 10).alias("b")))


@query
def pit_audit_twin(spark, sf_dir):
    rows = filings(spark, sf_dir)
    return rounded(twin_audit(rows, calendar(rows)), "pct_lookahead", "median_gap_days", "min_gap_days")


@query
def align_acceptance(spark, sf_dir):
    rows = filings(spark, sf_dir)
    return align(rows, calendar(rows)).select("accession", "ticker", "signal_date")


@query
def pit_gap_rows(spark, sf_dir):
    rows = filings(spark, sf_dir)
    return rounded(gap_rows(align(rows, calendar(rows))).select("accession", "gap"), "gap")


@query
def annual_gap_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    before = with_previous(orders, "o_custkey", ("at", "o_orderkey"), ("o_orderkey", "at"))
    return with_gap(before, "at", "prev_at").select("o_orderkey", "prev_o_orderkey", "gap_days", "gap_ok")


@query
def filing_index_summary(spark, sf_dir):
    return index_summary(accepted_between(filings(spark, sf_dir), "2024-01-03", "2024-01-20"))


# Documents as texts: ticker is the source, order is doc_id, a filing a day.


@query
def tokenize_counts(spark, sf_dir):
    return term_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query
def doc_norms(spark, sf_dir):
    return norms(term_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id")


def by_thousands(name: str) -> Column:
    """Stretches of an id, so that no task orders all rows of a hot source."""
    return F.floor(F.col(name) / 10_000)


def document_pairs(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    before = with_previous(docs, "source", ("doc_id",), ("doc_id",), by_thousands("doc_id"))
    return before.where("prev_doc_id IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("prev_doc_id").alias("b"))


@query
def lazy_cosine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rounded(pair_cosine(document_pairs(spark, sf_dir), term_bags(docs, "doc_id", "text"), "doc_id"), "score", digits=9)


def document_filings(docs: DataFrame) -> DataFrame:
    """Documents as filings 300 days apart within a source."""
    order = F.col("order")
    index = numbered(docs.select("source", "doc_id"), "source", ("doc_id",), "order", by_thousands("doc_id")).withColumn("at", F.timestamp_seconds(F.lit(1_000_000_000) + F.pmod(order * 300, F.lit(9000)).cast("long") * 86_400 + order))
    return index.select(F.col("source").alias("ticker"), F.col("doc_id").alias("accession"), F.date_sub(F.col("at").cast("date"), 45).alias("period_end"), F.col("at").alias("acceptance_datetime"))


def scored_documents(spark, sf_dir) -> DataFrame:
    """Scores of those filings; bodies under 1,000 characters have failed."""
    docs = table(spark, sf_dir, "documents")
    rows = document_filings(docs)
    failed = F.length("text") < 1000
    bodies = docs.select(F.col("doc_id").alias("accession"), F.col("text").alias("body"), failed.alias("section_failed"), F.when(failed, "short").otherwise("").alias("failure_reason"))
    return flagged(align(score_filings(rows, bodies), calendar(rows)))


@query
def lazy_build(spark, sf_dir):
    names = ("ticker", "accession", "prev_accession", "period_end", "signal_date", "score", "extraction_failed", "failure_reason", "gap_days", "gap_ok")
    return rounded(scored_documents(spark, sf_dir).select(*names), "score", digits=9)


@query
def signal_build(spark, sf_dir):
    """The signal from the texts on: a document is the section between two headings, of which some reports have none."""
    docs = table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 11 == 0, "About us\n").otherwise("Item 7.\n")
    texts = docs.select(F.col("doc_id").alias("accession"), F.concat(head, F.col("text"), F.lit("\nItem 8. Statements\n")).alias("text"))
    rows = document_filings(docs)
    out = build(rows, texts, calendar(rows), sections=("item_7",)).aligned
    names = ("ticker", "accession", "prev_accession", "period_end", "signal_date", "score", "extraction_failed", "failure_reason", "gap_days", "gap_ok")
    return rounded(out.select(*names), "score", digits=9)


@query
def lazy_usable(spark, sf_dir):
    rows = scored_documents(spark, sf_dir)
    return rounded(rows.where(~F.col("extraction_failed") & F.col("gap_ok")).select("ticker", "accession", "signal_date", "score"), "score", digits=9)


@query
def signal_diagnostics(spark, sf_dir):
    return rounded(diagnostics(scored_documents(spark, sf_dir)), "section_failure_rate", "pair_failure_rate", "score_mean", "score_std")


@query
def tfidf_expanding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    years = docs.select("doc_id", (F.lit(2012) + F.col("doc_id") % 10).cast("int").alias("year"), F.lit(True).alias("fits"))
    counts = term_bags(docs, "doc_id", "text")
    pairs = document_pairs(spark, sf_dir).withColumn("year", (F.lit(2012) + F.col("a") % 10).cast("int"))
    return rounded(pair_tfidf(pairs, counts, expanding_idf(counts, years, "doc_id"), "doc_id"), "score")


@query
def html_visible_text(spark, sf_dir):
    found = html_to_text(table(spark, sf_dir, "pages"), "page_id", "html")
    return found.select("page_id", F.regexp_replace("text", r"\n+", "\n").alias("text"), "error")


@query
def section_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = F.col("doc_id")
    contents = F.lit("Item 1A. 3\nItem 1B. 9\nItem 7. 12\n")
    filed = F.concat(
        contents, F.when(d % 3 == 0, "Item 7A. 20\n").otherwise(""), F.lit("Item 8. 30\n"),
        F.when(d % 7 != 0, "Item 1A: Risk Factors\n").otherwise("About risk\n"), F.col("text"), F.lit("\n ITEM 1B - Comments\nnone\nitem 7. Discussion\nsee Item 7A below. "), F.col("text"),
        F.when(d % 3 == 0, "\nItem 7A. Market risk\n").otherwise("\n"), F.lit("Item 8. Statements\n"),
    )
    return extract_all(docs.select("doc_id", filed.alias("filed")), "filed").select(
        "doc_id", F.length("body").cast("long").alias("n_body"), F.sha2("body", 256).alias("body_sha256"), "section_failed", F.col("failure_reason").contains("item_1a").alias("names_1a")
    )


@query
def archive_url_(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cik = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    accession = F.concat(cik, F.lit("-"), F.date_format("o_orderdate", "yy"), F.lit("-"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    return orders.select("o_orderkey", archive_url(cik, accession, F.lit("doc.htm")).alias("url"))


QUERIES["archive_url"] = QUERIES.pop("archive_url_")


@query
def parallel_arrays_inline(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    one = F.struct(
        F.col("o_orderstatus").alias("form"), F.col("o_orderkey").cast("string").alias("accessionNumber"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("reportDate"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("acceptanceDateTime"),
        F.when(F.col("o_orderpriority").startswith("5"), "").otherwise("doc.htm").alias("primaryDocument"),
    )
    rows = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(one)).alias("r"))
    names = ("form", "accessionNumber", "reportDate", "filingDate", "acceptanceDateTime", "primaryDocument")
    block = lambda r: F.struct(*[r[n].alias(n) for n in names]).cast(BLOCK)  # noqa: E731  an array of structs, turned into arrays
    feed = rows.select(
        F.col("o_custkey").cast("string").alias("ticker"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        block(F.slice("r", 1, 5)).alias("recent"), F.array(block(F.slice("r", F.lit(6), F.size("r")))).alias("overflow"),
    )
    return unpack(feed, ["F", "O"]).select("cik", "ticker", "form", "accession", "period_end", "filing_date", "primary_document")


@query
def dedup_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"))
    return first_per(docs, "text_sha256", "doc_id")


# Suppliers as symbols, weeks as dates, unit prices and order values as prices and dollar volume.


def cents(name: str) -> Column:
    """A number of two decimals as a whole one: sums of those do not depend on their order."""
    return F.round(F.col(name) * 100).cast("long")


def mean(total: Column) -> Column:
    return F.sum(total).cast("double") / F.count(F.lit(1))


def weekly(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).cast("date").alias("date"))
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.sum(cents("l_extendedprice")).alias("cents"))
    )


def priced(spark, sf_dir) -> DataFrame:
    return weekly(spark, sf_dir).select("date", "symbol", F.col("px").alias("value"))


def volume(spark, sf_dir) -> DataFrame:
    return weekly(spark, sf_dir).select("date", "symbol", F.col("cents").alias("value"))


@query
def panel_returns(spark, sf_dir):
    return rounded(panel.returns(priced(spark, sf_dir), "1996-01-01", "1997-12-31"), "ret")


@query
def dollar_adv_21(spark, sf_dir):
    return panel.dollar_adv(volume(spark, sf_dir))


@query
def coverage(spark, sf_dir):
    return rounded(panel.coverage(priced(spark, sf_dir)).where("coverage > 0.5"), "coverage")


def membership(spark, sf_dir) -> DataFrame:
    """Customers in an index from their first order to their last, open if that is recent."""
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("valid_from"), F.max(F.col("o_orderdate").cast("date")).alias("last"))
    return spans.select(
        F.col("o_custkey").cast("string").alias("symbol"), F.when(F.col("o_custkey") % 4 == 0, "other").otherwise("sp500").alias("index_name"), "valid_from",
        F.when(F.col("last") <= F.lit("2001-01-01").cast("date"), F.col("last")).alias("valid_to"),
    )


@query
def members_on(spark, sf_dir):
    return panel.members_on(membership(spark, sf_dir), "1995-06-01")


@query
def members_by_date(spark, sf_dir):
    dates = spark.sql("SELECT explode(sequence(DATE'1995-03-01', DATE'1996-03-01', INTERVAL 3 MONTHS)) AS date")
    return panel.members_by_date(membership(spark, sf_dir), dates)


@query
def membership_overlap(spark, sf_dir):
    return panel.overlapping(membership(spark, sf_dir), "1995-01-01", "1995-04-01")


def supplier_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier")
    symbol = F.col("s_suppkey").cast("string").alias("symbol")
    member = s.select(symbol, F.lit("sp500").alias("index_name"), F.lit("1990-01-01").cast("date").alias("valid_from"), F.when(F.col("s_suppkey") % 10 == 3, F.lit("1994-01-01").cast("date")).alias("valid_to"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kinds = s.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(symbol, F.col("r_name").alias("sector"), F.when(F.col("s_acctbal") > 0, "EQUITY").otherwise("ETF").alias("quoteType"))
    return member, kinds


@query
def former_tickers(spark, sf_dir):
    names = membership(spark, sf_dir).select(F.col("symbol").alias("ticker"), F.concat(F.lit("cik"), "symbol").alias("cik"), "valid_from", "valid_to")
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ticker"), F.lit("1995-09-01").cast("date").alias("date"))
    return panel.former_tickers(asked, names)


@query
def names_by_date(spark, sf_dir):
    """Orders as names that a customer uses for 400 days, many at a time: the last one taken up by a date."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    names = o.select(F.col("o_custkey").cast("string").alias("ticker"), F.col("o_orderkey").cast("string").alias("cik"), day.alias("valid_from"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, 400)).alias("valid_to"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ticker"), F.explode(F.array(*[F.lit(d).cast("date") for d in ("1995-09-01", "1999-02-28")])).alias("date"))
    return panel.former_tickers(asked, names)


@query
def wide_to_long(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return from_wide(wide)


@query
def momentum_lines(spark, sf_dir):
    """Order values as a factor file: two fields with a date of eight digits, among headers, short dates and missing codes."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    value = F.when(k % 50 == 7, "-99.99").otherwise((k % 1000).cast("string"))
    line = F.when(k % 10 == 3, F.concat(F.lit("x"), day, F.lit(","), value)).when(k % 10 == 4, F.concat(day, F.lit(","), value, F.lit(",1"))).otherwise(F.concat(day, F.lit(",  "), value))
    return parse_momentum(table(spark, sf_dir, "orders").select(line.alias("value")))


@query
def liquid_universe(spark, sf_dir):
    member, kinds = supplier_tables(spark, sf_dir)
    adv = panel.dollar_adv(volume(spark, sf_dir))
    top = panel.liquid_universe(adv, priced(spark, sf_dir), member, kinds, "1996-01-01", "1998-12-31", 20)
    return top


@query
def universe_at_dates(spark, sf_dir):
    """The most traded suppliers on two dates between which some join the index and others leave it."""
    _, kinds = supplier_tables(spark, sf_dir)
    key, day = F.col("s_suppkey"), F.lit("1997-01-01").cast("date")
    member = table(spark, sf_dir, "supplier").select(
        key.cast("string").alias("symbol"), F.lit("sp500").alias("index_name"), F.when(key % 7 == 1, day).otherwise(F.lit("1990-01-01").cast("date")).alias("valid_from"), F.when(key % 10 == 3, day).alias("valid_to")
    )
    dates = spark.sql("SELECT explode(array(DATE'1996-06-28', DATE'1998-06-26')) AS date")
    return universe_by_date(panel.dollar_adv(volume(spark, sf_dir)), priced(spark, sf_dir), member, kinds, dates, 20)


@query
def sector_map(spark, sf_dir):
    return panel.sectors(supplier_tables(spark, sf_dir)[1])


def daily_factors(spark, sf_dir) -> DataFrame:
    day = lambda c: F.col(c).cast("date").alias("date")
    a = table(spark, sf_dir, "orders").groupBy(day("o_orderdate")).agg((mean(cents("o_totalprice")) / 1e8).alias("mkt_rf"))
    b = table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate")).agg(mean(cents("l_discount")).alias("mom"), (mean(cents("l_extendedprice")) / 1e8).alias("ret"))
    return panel.factors(a, b)


@query
def factor_join(spark, sf_dir):
    return daily_factors(spark, sf_dir)


@query
def missing_symbols(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("symbol"))
    return panel.missing_symbols(asked, table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("symbol")))


# The ledger and the scorecard, from events.


@query
def ledger_chain_verify(spark, sf_dir):
    """All events as ledgers, one a user: each entry is linked to the hash of the one before; some contents were changed afterwards."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("content"))
    stored = e.select("user_id", (F.row_number().over(own) - 1).cast("long").alias("index"), "event_id", "content", F.sha2("content", 256).alias("entry_hash"))
    linked = stored.withColumn("prev_hash", F.coalesce(F.lag("entry_hash").over(Window.partitionBy("user_id").orderBy("index")), F.lit(GENESIS)))
    changed = linked.withColumn("content", F.when(F.col("event_id") % 499 == 57, "forged").otherwise(F.col("content")))
    return link_check(changed, F.sha2("content", 256), "user_id")


@query
def ledger_n_variance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    done = F.col("event_id") % 3 == 2
    entries = e.select(
        F.col("event_id").alias("index"), F.concat(F.lit("family"), (F.floor(F.col("event_id") / 3) % 700).cast("string")).alias("family"),
        F.when(done, F.col("event_id") - 2).alias("amends"), F.when(done & (F.col("event_type") != "error"), F.col("value")).alias("sharpe"),
    )
    return rounded(trial_counts(entries), "sharpe_variance")


def steps(spark, sf_dir) -> DataFrame:
    """All events, each seven in a row of one user a trial."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, sf_dir, "events").withColumn("n", n).withColumns({"ordinal": F.col("n") % 7, "trial": F.concat_ws("-", "user_id", F.floor(F.col("n") / 7))})
    names = F.array(*[F.lit(g) for g in ("pit", "integrity", "raw", "orthogonalize", "costs", "dsr", "pbo")])
    return e.select("trial", "ordinal", F.get(names, F.col("ordinal")).alias("gate"), F.when(F.col("ordinal") >= 2, F.col("value")).alias("sharpe"), (F.col("event_type") != "error").alias("passed"))


@query
def verdict_fold(spark, sf_dir):
    return fold(steps(spark, sf_dir), "trial")


@query
def verdict_give_up(spark, sf_dir):
    return rounded(give_ups(steps(spark, sf_dir), "trial").select("trial", "ordinal", "give_up"), "give_up")


# Gates, on suppliers by month: scores are last month's dollar volume, weights this month's.


def monthly(spark, sf_dir, ordered: bool = False) -> DataFrame:
    """Suppliers by month. With `ordered`, sums are taken in the order of the table's rows, so that their last digits don't hang on how files are cut into tasks."""
    of = {"px": F.avg(F.col("l_extendedprice") / F.col("l_quantity")), "dollars": F.sum("l_extendedprice"), "volume": F.sum("l_quantity"), "discount": F.avg("l_discount")}
    month = F.trunc("l_shipdate", "month").alias("month")
    if ordered:
        lines = table(spark, sf_dir, "lineitem").select("l_suppkey", month, "l_extendedprice", "l_quantity", "l_discount", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        w = Window.partitionBy("l_suppkey", "month").orderBy("_file", "_row")
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        ends = lines.select("l_suppkey", "month", *[c.over(so_far).alias(n) for n, c in of.items()], F.lead(F.lit(True)).over(w).isNull().alias("last")).where("last")
        rows = ends.select(F.col("l_suppkey").cast("string").alias("symbol"), "month", *of)
    else:
        rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol"), month).agg(*[c.alias(n) for n, c in of.items()])
    w = Window.partitionBy("symbol").orderBy("month")
    return rows.withColumn("ret", F.col("px") / F.lag("px").over(w) - 1).withColumn("score", F.lag("dollars").over(w))


def ranked_months(spark, sf_dir, neutral: bool = False) -> tuple[DataFrame, DataFrame]:
    m = monthly(spark, sf_dir)
    scores = m.where("score IS NOT NULL").select("month", "symbol", "score")
    if neutral:
        scores = gates.sector_neutral(scores.join(supplier_tables(spark, sf_dir)[1], "symbol")).select("month", "symbol", F.round("score", 4).alias("score"))
    return gates.deciles(scores.withColumn("score", F.round("score", 4))), m.where("ret IS NOT NULL").select("month", "symbol", "ret", F.col("dollars").alias("weight"))


@query
def raw_deciles(spark, sf_dir):
    return rounded(gates.long_short(*ranked_months(spark, sf_dir)), "ew", "vw")


@query
def raw_sharpe(spark, sf_dir):
    return rounded(gates.sharpe(gates.long_short(*ranked_months(spark, sf_dir)), "vw"), "sharpe")


@query
def sector_neutral(spark, sf_dir):
    return rounded(gates.long_short(*ranked_months(spark, sf_dir, True)), "ew", "vw", digits=5)


@query
def breakeven_cost(spark, sf_dir):
    ranked, held = ranked_months(spark, sf_dir)
    legs = ranked.where("decile IN (1, 10)")
    size = F.count(F.lit(1)).over(Window.partitionBy("month", "decile"))
    weights = legs.select("month", "symbol", (F.when(F.col("decile") == 10, 1.0).otherwise(-1.0) / size).alias("weight"))
    gross = gates.long_short(ranked, held).select(F.col("ew").alias("ret"))
    return rounded(gates.breakeven(gross, gates.turnover(weights)), "mean_gross", "mean_turnover", "breakeven_bps", digits=5)


@query
def realised_costs(spark, sf_dir):
    """Break-even of the value-weighted legs, which drift between months, beside the plausible costs of what they trade."""
    ranked, held = ranked_months(spark, sf_dir)
    bands = ((0.0, 25.0, 100.0), (100_000.0, 10.0, 30.0), (250_000.0, 5.0, 15.0))
    out = holdings.realised_breakeven(holdings.value_legs(ranked, held), held.select("month", "symbol", F.col("weight").alias("dollars")), bands)
    return rounded(out, *out.columns)


@query
def scores_by_month(spark, sf_dir):
    """Orders as scores of their customers, pending ones without: at each month's end the last one that is not stale."""
    o = table(spark, sf_dir, "orders")
    return scores_as_of(o.select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").cast("date").alias("signal_date"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("score")))


@query
def hac_alpha(spark, sf_dir):
    got = gates.hac_regression(daily_factors(spark, sf_dir), "ret", ["mkt_rf"], lags=5)
    rows = [(name, *(round(x, 6) for x in values)) for name, values in got.items()]
    return spark.createDataFrame(rows, "name string, coefficient double, error double, t double")


@query
def dsr_moments(spark, sf_dir):
    return rounded(gates.moments(gates.long_short(*ranked_months(spark, sf_dir)), "vw"), "ratio", "skew", "kurtosis", digits=5)


def config_returns(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 10).alias("config"), (F.floor(F.col("event_id") / 10) % 16).alias("block"), (F.col("value") / 100 - 1.5 + (F.col("event_id") % 10) / 50).alias("ret"))


@query
def pbo_cscv(spark, sf_dir):
    return rounded(gates.pbo(gates.pbo_splits(config_returns(spark, sf_dir))), "pbo", digits=4)


@query
def integrity_rules(spark, sf_dir):
    cells = monthly(spark, sf_dir).select("symbol", F.col("month").alias("date"), F.round(F.col("px") / 400).alias("px"), F.when(F.col("volume") > 60, F.col("volume")).otherwise(0.0).alias("volume"))
    out = gates.integrity_rules(cells, stale_rows=3)
    return rounded(out.select("symbol", "date", "ret", "trailing_vol", "split_tick", "stale", "odd_volume"), "ret", "trailing_vol")


@query
def isolation_scores(spark, sf_dir):
    """The tables have no shares outstanding: the quantity of the month stands in for them."""
    cells = monthly(spark, sf_dir).select("symbol", "month", "ret", "volume", "px", F.col("volume").alias("shares"))
    features = ["ret", "volume", "move", "px", "share_change"]
    return rounded(gates.isolation_forest(rounded(gates.isolation_features(cells), *features, digits=9), features, ["symbol", "month"]), "anomaly")


@query
def neutral_residuals(spark, sf_dir):
    m = monthly(spark, sf_dir).where("score IS NOT NULL AND ret IS NOT NULL")
    out = gates.neutralised(m.select("month", "symbol", F.log("score").alias("score"), F.log("volume").alias("size"), "px"), ["size", "px"])
    return out.withColumn("score", F.round("score", 5) + 0.0)


def characteristics(spark, sf_dir, ordered: bool = False) -> DataFrame:
    """Traits of suppliers by month with the return of the next row: account balances are book equity from 1995 on, discounts stand for profits, growing quantities for investment."""
    m = monthly(spark, sf_dir, ordered)
    book = table(spark, sf_dir, "supplier").select(F.lit("1995-01-01").cast("date").alias("month"), F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_acctbal").alias("equity"))
    w = Window.partitionBy("symbol").orderBy("month")
    more = m.select("month", "symbol", "px", F.col("volume").alias("shares"), "ret", F.lead("ret").over(w).alias("next"), "discount", (1 - F.col("volume") / F.lag("volume").over(w)).alias("restraint"))
    own = stock_traits.traits(more.where("month IS NOT NULL AND symbol IS NOT NULL"), book, keep=("next", "discount", "restraint"))
    return own.withColumnRenamed("next", "ret")


def seven_factors(spark, sf_dir) -> DataFrame:
    """Many suppliers have one mean discount in a month: summed in doubles, its last digit sorts them before the symbol does, in SQL too, so sums keep the table's order."""
    legs = {"hml": "value", "rmw": "discount", "cma": "restraint", "mom": "mom", "str": "str"}
    return stock_traits.built_factors(characteristics(spark, sf_dir, ordered=True), legs, "value")


@query
def stock_traits_by_month(spark, sf_dir):
    return rounded(characteristics(spark, sf_dir).select("month", "symbol", "size", "value", "mom", "str"), "size", "value", "mom", "str", digits=5)


@query
def factor_legs(spark, sf_dir):
    names = ("mkt", "smb", "hml", "rmw", "cma", "mom", "str")
    return rounded(seven_factors(spark, sf_dir).select("month", *names), *names)


@query
def seven_factor_alpha(spark, sf_dir):
    """The monthly alpha of the raw spread over market, size, value, profits, investment, momentum and reversal, all built here."""
    names = ["mkt", "smb", "hml", "rmw", "cma", "mom", "str"]
    months = seven_factors(spark, sf_dir).withColumn("month", F.add_months("month", 1))
    series = gates.long_short(*ranked_months(spark, sf_dir)).join(months, "month")
    values = gates.hac_regression(series, "vw", names, lags=5, date="month")["alpha"]
    return spark.createDataFrame([tuple(round(x, 5) for x in values)], "alpha double, error double, t double")


@query
def four_trait_neutral(spark, sf_dir):
    m = monthly(spark, sf_dir).where("score IS NOT NULL").select("month", "symbol", F.log("score").alias("score"))
    given = m.join(characteristics(spark, sf_dir).select("month", "symbol", "size", "value", "mom", "str"), ["month", "symbol"])
    return gates.neutralised(given, ["size", "value", "mom", "str"]).withColumn("score", F.round("score", 4) + 0.0)


# Further signals.


@query
def tone_rate(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("not", "the", "nicht", "les", "erla", "thion")], "term string")
    return rounded(tone(table(spark, sf_dir, "documents").select("doc_id", "text"), words, "doc_id", "text"), "rate")


@query
def novel_share(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text")
    pairs = with_previous(turns, "conv_id", ("turn",), ("id",)).where("prev_id IS NOT NULL").select(F.col("id").alias("a"), F.col("prev_id").alias("b"))
    return rounded(novelty(pairs, turns, "id", "text"), "novel_share")


@query
def text_distance(spark, sf_dir):
    """Distances of consecutive texts of a source, as hashed vectors of their terms by the weights of their years."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    years = docs.select("doc_id", (F.lit(2012) + F.col("doc_id") % 10).cast("int").alias("year"), F.lit(True).alias("fits"))
    held = term_bags(docs, "doc_id", "text")
    vectors = hashed_vectors(held.join(years.select("doc_id", "year").distinct(), "doc_id"), "doc_id", expanding_idf(held, years, "doc_id"))
    return rounded(vector_distances(document_pairs(spark, sf_dir), vectors, "doc_id"), "distance")


@query
def tfidf_build(spark, sf_dir):
    """The signal from the texts on, its scores by the terms' weights in strictly earlier years."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").alias("accession"), F.concat(F.lit("Item 7.\n"), F.col("text"), F.lit("\nItem 8. Statements\n")).alias("text"))
    rows = document_filings(docs)
    out = build(rows, texts, calendar(rows), sections=("item_7",), weighting="tfidf").aligned
    return rounded(out.select("ticker", "accession", "prev_accession", "signal_date", "score", "extraction_failed", "gap_ok"), "score")


@query
def embedding_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # Ids alone are put in order; vectors meet by id.
    before = with_previous(e.select("vec_id", "label"), "label", ("vec_id",), ("vec_id",), by_thousands("vec_id")).select(F.col("vec_id").alias("a"), F.col("prev_vec_id").alias("b"))
    out = vector_distances(before, e.select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    return rounded(out.withColumnsRenamed({"a": "vec_id", "b": "prev_vec_id"}), "distance", digits=5)
