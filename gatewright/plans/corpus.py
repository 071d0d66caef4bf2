"""Building a corpus: universe, index, pages, texts; and the look-ahead report of an index. Also a command line.

    python -m gatewright.plans.corpus build --lake LAKE --out OUT --agent "name mail"
    python -m gatewright.plans.corpus audit --lake LAKE --out OUT
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright import schemas
from gatewright.functions.html import PARSER_VERSION
from gatewright.operators import panel
from gatewright.operators.audit import twin_audit
from gatewright.operators.documents import first_per
from gatewright.plans.runlog import run
from gatewright.session import in_arrow, session
from gatewright.sources import filings as src
from gatewright.sources.market import read_parquet

#: Forms that are taken unless others are named; amendments are forms of their own.
FORMS = ("10-K",)
TICKERS_URL = "https://www.sec.gov/files/company_tickers.json"
INDEX_URL = "https://data.sec.gov/submissions/{}"


def feed_rows(ticker: str, cik: str, get: Callable[[str], bytes]) -> tuple:
    """One row for unpack(): the recent block of a filer and all overflow blocks its answer names."""
    names = [f.split(":")[0] for f in src.BLOCK.removeprefix("struct<").removesuffix(">").replace("array<string>", "").split(",")]
    block = lambda b: tuple(list(b.get(n, [])) for n in names)
    answer = json.loads(get(INDEX_URL.format(f"CIK{cik}.json")))["filings"]
    overflow = [block(json.loads(get(INDEX_URL.format(f["name"])))) for f in answer.get("files", [])]
    return ticker, cik, block(answer["recent"]), overflow


def fetch_index(spark: SparkSession, resolved: DataFrame, get: Callable[[str], bytes], start: str, end: str, forms=FORMS) -> tuple[DataFrame, dict[str, str]]:
    """The filings of (ticker, cik) accepted in the range, and the errors of tickers that failed. The service allows one paced client, so the driver asks."""
    rows, errors = [], {}
    for r in resolved.orderBy("ticker").toLocalIterator():
        if r.cik is None:
            errors[r.ticker] = "unresolved"
            continue
        try:
            rows.append(feed_rows(r.ticker, r.cik, get))
        except Exception as e:  # noqa: BLE001  one filer must not end the build
            errors[r.ticker] = str(e)
    feed = spark.createDataFrame(rows, f"ticker string, cik string, recent {src.BLOCK}, overflow array<{src.BLOCK}>")
    return src.accepted_between(src.unpack(feed, forms), start, end), errors


def _fetched(batches, get: Callable[[str], bytes], per_second: float):
    """(accession, html, error) of rows (accession, url), at most per_second of them a second."""
    pacer = src.Pacer(per_second)
    for batch in batches:
        for row in batch.to_pylist():
            pacer.wait()
            try:
                html, error = get(row["url"]).decode("utf-8", "replace"), None
            except Exception as e:  # noqa: BLE001  one page must not end the build
                html, error = None, str(e) or type(e).__name__
            yield pa.RecordBatch.from_pylist([{"accession": row["accession"], "html": html, "error": error}], schema=FETCHED)


FETCHED = pa.schema([("accession", pa.string()), ("html", pa.string()), ("error", pa.string())])


def fetch_pages(spark: SparkSession, index: DataFrame, store: DataFrame, get: Callable[[str], bytes], path: str, at_once: int = 100, tasks: int = 4, per_second: float = src.REQUESTS_PER_SECOND) -> dict[str, str]:
    """Append the pages (accession, html) that the store lacks; the errors.

    Tasks fetch, each at its share of per_second, which so holds for all of them; pages go from tasks to the
    store and are never on the driver. get is sent to the tasks, so it has no pace of its own. Some at_once
    pages a task are written at a time: a build that was interrupted goes on from what the store has.
    """
    wanted = src.with_url(first_per(index, "accession", "ticker")).join(src.not_stored(index, store), "accession", "left_semi").select("accession", "url")
    wanted.write.mode("overwrite").parquet(f"{path}.wanted")  # the store grows while they are read
    wanted, errors = spark.read.parquet(f"{path}.wanted"), {}
    rounds = -(-wanted.count() // (at_once * tasks))
    for k in range(rounds):
        some = wanted.where(F.pmod(F.xxhash64("accession"), F.lit(rounds)) == k).repartition(tasks)
        # A round is kept whole first, as it gives both pages and errors and must not be fetched twice.
        in_arrow(some, partial(_fetched, get=get, per_second=per_second / tasks), "accession string, html string, error string").write.mode("overwrite").parquet(f"{path}.round")
        got = spark.read.schema("accession string, html string, error string").parquet(f"{path}.round")
        got.where("html IS NOT NULL").select("accession", "html").write.mode("append").parquet(path)
        errors |= {r.accession: r.error for r in got.where("html IS NULL").select("accession", "error").collect()}
    return errors


def pit_report(audit: DataFrame) -> str:
    """The twin audit (two rows) as a Markdown table."""
    heads = ("alignment", "n", "n_impossible", "n_lookahead", "pct_lookahead", "median_gap_days", "min_gap_days")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads)]
    lines += ["| " + " | ".join(cell(r[h]) for h in heads) + " |" for r in audit.orderBy("alignment").collect()]
    return "\n".join(lines) + "\n"


def audit_index(index: DataFrame, prices: DataFrame) -> DataFrame:
    """The twin audit of an index's distinct documents against the dates of the price panel."""
    documents = first_per(index.select("accession", "ticker", "period_end", "acceptance_datetime"), "accession", "ticker")
    return twin_audit(documents, prices.select(F.col("date").alias("d")).distinct())


def _build(spark: SparkSession, args, get: Callable[[str], bytes], page: Callable[[str], bytes], record) -> None:
    """get asks for lists, on the driver; page, unpaced, for pages, in tasks."""
    lake, out = args.lake.rstrip("/"), args.out.rstrip("/")
    load = lambda name, schema: read_parquet(spark, f"{lake}/{name}.parquet", schema)
    top = panel.liquid_universe(
        load("dollar_adv", schemas.PANEL), load("prices", schemas.PANEL), load("membership", schemas.MEMBERSHIP), load("classifications", schemas.CLASSIFICATIONS),
        args.start, args.end, args.top_n, args.index_name,
    )
    known = src.ticker_map(spark.createDataFrame([(get(TICKERS_URL).decode(),)], "value string"))
    resolved, _ = src.resolve(top.select(F.col("symbol").alias("ticker")), known)
    index, errors = fetch_index(spark, resolved, get, args.start, args.end, tuple(x.strip() for x in args.forms.split(",")))
    src.write_index(index, f"{out}/index")
    record["outputs"].append(f"{out}/index")
    index = spark.read.parquet(f"{out}/index")
    if not args.no_text:
        try:
            store = read_parquet(spark, f"{out}/pages", schemas.PAGES)
        except src.SourceMissing:
            store = spark.createDataFrame([], schemas.PAGES)
        missed = fetch_pages(spark, index, store, page, f"{out}/pages")
        try:
            held = read_parquet(spark, f"{out}/texts", schemas.STORED_TEXTS)
        except src.SourceMissing:
            held = spark.createDataFrame([], schemas.STORED_TEXTS)
        # Pages whose text this version of the parser has written are not parsed again.
        src.add_texts(read_parquet(spark, f"{out}/pages", schemas.PAGES), held, f"{out}/texts")
        record["outputs"].append(f"{out}/texts")
        errors |= missed
        stored = spark.read.schema(schemas.STORED_TEXTS).parquet(f"{out}/texts").where(F.col("parser_version") == PARSER_VERSION).select("accession").distinct()
        outcomes = index.select("ticker", "accession").join(stored.withColumn("there", F.lit(True)), "accession", "left")
        told = src.build_report(outcomes.select("ticker", "accession", F.when(F.col("there").isNull(), "no text").alias("error"))).first()
        print(", ".join(f"{k} {v}" for k, v in told.asDict().items()))
    for name, why in sorted(errors.items()):
        print(f"failed: {name}: {why}")
    print(", ".join(f"{k} {v}" for k, v in src.index_summary(index).first().asDict().items()))


def _page(url: str, agent: str) -> bytes:
    return src.fetch(url, agent, src.Pacer(float("inf")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gatewright.plans.corpus")
    p.add_argument("what", choices=("build", "audit"))
    p.add_argument("--lake", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--agent", default="")
    p.add_argument("--top-n", type=int, default=200)
    p.add_argument("--start", default="2012-01-01")
    p.add_argument("--end", default="2025-12-31")
    p.add_argument("--forms", default=",".join(FORMS), help="comma-separated")
    p.add_argument("--index-name", default="sp500")
    p.add_argument("--no-text", action="store_true")
    p.add_argument("--logs", default="logs")
    return p


def main(argv: list[str] | None = None, get: Callable[[str], bytes] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session("corpus")
    page = get or partial(_page, agent=args.agent)
    pacer = src.Pacer()
    get = get or (lambda url: src.fetch(url, args.agent, pacer))
    with run(f"corpus-{args.what}", args.logs, **vars(args)) as record:
        if args.what == "build":
            _build(spark, args, get, page, record)
        else:
            text = pit_report(audit_index(read_parquet(spark, f"{args.out}/index", schemas.FILINGS), read_parquet(spark, f"{args.lake}/prices.parquet", schemas.PANEL)))
            target = Path(args.out) / "pit_check.md"
            target.write_text(text)
            record["outputs"].append(str(target))
            print(text)


if __name__ == "__main__":
    main()
