import io
import json
import urllib.error
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gatewright.functions.html import PARSER_VERSION
from gatewright.functions.timeops import weekdays
from gatewright.operators.documents import archive_url, first_per, with_previous
from gatewright.operators.lazy_prices import COLUMNS, build
from gatewright.schemas import FILINGS
from gatewright.sources import filings as src
from gatewright.streaming.filings import filings_stream, first_seen, late_signals


def answer(codes):
    codes = iter(codes)

    def open_(request):
        code = next(codes)
        if code != 200:
            raise urllib.error.HTTPError(request.full_url, code, "x", {}, io.BytesIO())
        return io.BytesIO(b"body")

    return open_


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def pacer():
    c = Clock()
    return src.Pacer(8, lambda: c.now, c.sleep), c


def test_pacing_and_retries():
    p, c = pacer()
    p.wait(), p.wait()
    assert c.slept == [pytest.approx(0.125)]
    p, c = pacer()
    assert src.fetch("http://x", "me", p, opener=answer([429, 503, 200])) == b"body" and [s for s in c.slept if s >= 1] == [2, 4]
    with pytest.raises(urllib.error.HTTPError):
        src.fetch("http://x", "me", p, opener=answer([404]))
    with pytest.raises(RuntimeError):
        src.fetch("http://x", "me", p, opener=answer([500] * 4))


def test_ticker_map_and_resolution(spark):
    raw = spark.createDataFrame([(json.dumps({"0": {"cik_str": 320193, "ticker": "aapl", "title": "A"}, "1": {"cik_str": 1, "ticker": "B", "title": "B"}}),)], "value string")
    known = src.ticker_map(raw)
    assert {tuple(r) for r in known.collect()} == {("AAPL", "0000320193"), ("B", "0000000001")}
    found, missing = src.resolve(spark.createDataFrame([("aapl",), ("zz",)], "ticker string"), known)
    assert {r.ticker: r.cik for r in found.collect()} == {"AAPL": "0000320193", "ZZ": None} and [r.ticker for r in missing.collect()] == ["ZZ"]


def test_unpacking_parallel_arrays(spark):
    block = lambda *rows: tuple(list(x) for x in zip(*rows)) if rows else ([],) * 6
    one = ("10-K", "0001-23-1", "2022-12-31", "2023-02-15", "2023-02-15T21:50:00.000Z", "a.htm")
    amended = ("10-K/A", "0001-23-2", "2022-12-31", "2023-03-15", "2023-03-15T21:50:00.000Z", "b.htm")
    empty, undated = ("10-K", "0001-22-3", "2021-12-31", "2022-02-15", "2022-02-15T21:50:00.000Z", ""), ("10-K", "0001-21-4", "", "2021-02-15", "2021-02-15T21:50:00.000Z", "d.htm")
    feed = spark.createDataFrame([("A", "0000000001", block(one, amended), [block(empty), block(undated)]), ("B", "0000000002", block(), None)], f"ticker string, cik string, recent {src.BLOCK}, overflow array<{src.BLOCK}>")
    got = {r.accession: r for r in src.unpack(feed, ["10-K"]).collect()}
    assert got.keys() == {"0001-23-1", "0001-21-4"} and got["0001-21-4"].period_end is None and got["0001-23-1"].acceptance_datetime == datetime(2023, 2, 15, 21, 50)
    index = src.unpack(feed, ["10-K"])
    assert src.accepted_between(index, "2023-01-01", "2023-02-15").count() == 1
    url = src.with_url(index).where("accession = '0001-23-1'").first().url
    assert url == "https://www.sec.gov/Archives/edgar/data/1/0001231/a.htm"


def test_stores(spark, tmp_path):
    rows = [("0000000001", t, "10-K", a, date(2022, 12, 31), date(2023, 2, 15), datetime(2023, 2, 15, 21), "a.htm") for t, a in (("A", "1"), ("B", "1"), ("A", "2"))]
    index = src.filings_frame(spark, rows)
    assert index.schema == spark.createDataFrame([], FILINGS).schema
    src.write_index(index, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 3
    with pytest.raises(ValueError):
        src.write_index(index.limit(0), str(tmp_path / "none"))
    assert [r.accession for r in src.not_stored(index, spark.createDataFrame([("1",)], "accession string")).collect()] == ["2"]
    texts = spark.createDataFrame([("1", "old", PARSER_VERSION), ("2", "old", PARSER_VERSION - 1)], "accession string, text string, parser_version int")
    pages = spark.createDataFrame([("1", "<p>x</p>"), ("2", "<p>new</p>"), ("3", "")], "accession string, html string")
    assert {r.accession: r.error is None for r in src.add_texts(pages, texts, str(tmp_path / "texts")).collect()} == {"2": True, "3": False}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "texts")).select("accession", "text", "parser_version").collect()] == [("2", "new", PARSER_VERSION)]
    told = src.build_report(spark.createDataFrame([("A", "1", None), ("B", "1", "x")], "ticker string, accession string, error string")).first()
    assert tuple(told) == (2, 1, 2, 1, 1)


def test_first_and_previous_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "p"), (None, 2, "q")], "k string, o int, v string")
    assert {(r.k, r.v) for r in first_per(df, "k", "o").collect()} == {("a", "y"), (None, "p")}
    got = {(r.k, r.o): r.prev_v for r in with_previous(df, "k", ("o",), ("v",)).collect()}
    assert got == {("a", 1): None, ("a", 2): "y", (None, 1): None, (None, 2): None}
    assert spark.range(1).select(archive_url(F.lit("0000012345"), F.lit("0000-12-345"), F.lit("d.htm"))).first()[0].endswith("/12345/000012345/d.htm")


BODY = "Item 1A. Risk\n{0}\nItem 1B. x\nItem 7. Talk\n{1}\nItem 7A. y\n"


def signal(spark, weighting="count", **kw):
    rows = [(t, f"{t}{y}", date(y - 1, 12, 31), datetime(y, 2, 15, 21)) for t in ("A", "B") for y in (2022, 2023)] + [("C", "A2023", date(2022, 12, 31), datetime(2023, 2, 15, 21))]
    good = BODY.format("risk here " * 200, "sales rose " * 200)
    texts = [("A2022", good), ("A2023", good), ("B2022", good), ("B2023", "nothing of the kind " * 200)]
    cal = weekdays(spark.createDataFrame([(date(2022, 1, 1), date(2023, 12, 31))], "a date, b date"))
    index = spark.createDataFrame(rows, "ticker string, accession string, period_end date, acceptance_datetime timestamp")
    return build(index, spark.createDataFrame(texts, "accession string, text string"), cal, weighting=weighting, **kw)


def test_build_keeps_failures_and_counts_usable_rows(spark):
    s = signal(spark)
    assert s.aligned.columns == list(COLUMNS)
    got = {(r.ticker, r.accession): r for r in s.aligned.collect()}
    assert len(got) == 5 and got["A", "A2023"].score == pytest.approx(1.0) and got["A", "A2023"].gap_days == 365 and got["A", "A2023"].signal_date == date(2023, 2, 17)
    assert got["B", "B2023"].extraction_failed and "item_1a" in got["B", "B2023"].failure_reason
    assert got["A", "A2022"].extraction_failed and got["A", "A2022"].failure_reason == "" and got["A", "A2022"].prev_accession is None
    assert [r.accession for r in s.usable().collect()] == ["A2023"]
    d = s.diagnostics.first()
    assert (d.n_filings, d.n_documents, d.n_first_filing_no_prior, d.n_usable, d.gap_rejected) == (5, 4, 3, 1, 3)
    assert d.section_failure_rate == pytest.approx(1 / 5) and d.pair_failure_rate == pytest.approx(4 / 5)


def test_build_options(spark):
    assert signal(spark, "tfidf").usable().count() == 0  # too few earlier filings to learn from
    assert {r.signal_date for r in signal(spark, alignment="period_end").aligned.collect()} == {date(2021, 12, 31), date(2022, 12, 31)}
    with pytest.raises(ValueError, match="weighting"):
        signal(spark, "other")


def test_a_missing_text_is_a_failure(spark):
    cal = weekdays(spark.createDataFrame([(date(2022, 1, 1), date(2023, 12, 31))], "a date, b date"))
    index = spark.createDataFrame([("A", "1", date(2021, 12, 31), datetime(2022, 2, 15))], "ticker string, accession string, period_end date, acceptance_datetime timestamp")
    r = build(index, spark.createDataFrame([], "accession string, text string"), cal).aligned.first()
    assert r.extraction_failed and r.failure_reason == "text unavailable"


def test_streams(spark, tmp_path):
    rows = [("1", t, "10-K", a, None, None, datetime(2023, 2, 15, h), "a") for t, a, h in (("A", "1", 1), ("B", "1", 2), ("A", "2", 3))]
    src.filings_frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = filings_stream(spark, str(tmp_path / "in"))
    for name, df in (("seen", first_seen(stream)), ("late", late_signals(stream.withColumn("signal_date", F.to_date(F.lit("2023-02-15")))))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.accession for r in spark.table("seen").collect()) == ["1", "2"] and spark.table("late").count() == 3


def test_rows_before_and_numbers_by_stretches(spark):
    """Stretches of any width give what one order gives; null keys and orders, empty stretches, ties by the second column."""
    import random

    from pyspark.sql import functions as F

    from gatewright.operators.documents import numbered, with_previous

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), None if i % 37 == 0 else r.randrange(200), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    want = sorted(map(str, with_previous(df, "k", ("o", "v"), ("v", "o")).collect()))
    for width in (1, 7, 1000):
        assert sorted(map(str, with_previous(df, "k", ("o", "v"), ("v", "o"), F.floor(F.col("o") / width)).collect())) == want
        got = {x.v: x.n for x in numbered(df.where("k IS NOT NULL"), "k", ("o", "v"), "n", F.floor(F.col("o") / width)).collect()}
        for k in "ab":
            own = sorted((x for x in rows if x[0] == k), key=lambda x: (-1 if x[1] is None else x[1], x[2]))
            assert [got[x[2]] for x in own] == [*range(1, len(own) + 1)]
