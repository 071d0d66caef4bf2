from datetime import date

import pytest

from gatewright.operators import panel
from gatewright.schemas import CLASSIFICATIONS, MEMBERSHIP, PANEL, SchemaMismatch, require
from gatewright.sources.filings import SourceMissing
from gatewright.sources.market import from_wide, parse_momentum, read_momentum, read_parquet

D = [date(2023, 1, d) for d in (2, 3, 4, 5)]


def prices(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def test_prices_refuse_and_volumes_drop_absent_symbols(spark):
    p = prices(spark, [(D[0], "A", 1.0), (D[1], "A", 2.0)])
    asked = spark.createDataFrame([("A",), ("Z",)], "symbol string")
    with pytest.raises(panel.MissingSymbols, match="Z"):
        panel.load_prices(p, asked)
    assert panel.load_dollar_adv(p, asked).count() == 2
    assert panel.load_prices(p, asked.where("symbol = 'A'"), "2023-01-03", "2023-01-03").count() == 1


def test_returns_fill_gaps_and_cut_after(spark):
    p = prices(spark, [(D[0], "A", 1.0), (D[2], "A", 2.0), (D[0], "B", 1.0), (D[1], "B", 3.0), (D[2], "B", 3.0)])
    got = {(r.date, r.symbol): r.ret for r in panel.returns(p).collect()}
    assert got[D[0], "A"] is None and got[D[1], "A"] == 0.0 and got[D[2], "A"] == 1.0 and got[D[1], "B"] == 2.0
    bare = {(r.date, r.symbol): r.ret for r in panel.returns(p, fill=False).collect()}
    assert bare[D[1], "A"] is None and bare[D[2], "A"] is None
    cut = {(r.date, r.symbol): r.ret for r in panel.returns(p, "2023-01-04").collect()}
    assert cut == {(D[2], "A"): 1.0, (D[2], "B"): 0.0}


def test_adv_and_coverage(spark):
    p = prices(spark, [(d, "A", float(i + 1)) for i, d in enumerate(D)] + [(D[0], "B", 1.0), (D[1], "B", 1.0)])
    assert [r.value for r in panel.dollar_adv(p, 2).where("symbol = 'A'").orderBy("date").collect()] == [1.0, 1.5, 2.5, 3.5]
    assert {r.symbol: r.coverage for r in panel.coverage(p).collect()} == {"A": 1.0, "B": 0.5}


def member(spark):
    rows = [("A", "sp500", date(2020, 1, 1), None), ("B", "sp500", date(2020, 1, 1), date(2020, 6, 30)), ("C", "other", date(2020, 1, 1), None), ("G", "sp500", date(2020, 1, 1), None)]
    return spark.createDataFrame(rows, MEMBERSHIP)


def names(df):
    return {r.symbol for r in df.collect()}


def test_membership(spark):
    m = member(spark)
    assert names(panel.members_on(m, "2020-01-01")) == {"A", "B", "G"} == names(panel.members_on(m, "2020-06-30"))
    assert names(panel.members_on(m, "2020-07-01")) == {"A", "G"} and names(panel.members_on(m, "2019-12-31")) == set()
    assert names(panel.overlapping(m, "2020-06-30", "2021-01-01")) == {"A", "B", "G"} and names(panel.overlapping(m, "2020-07-01", "2021-01-01")) == {"A", "G"}
    dates = spark.createDataFrame([(date(2020, 6, 30),), (date(2020, 7, 1),)], "date date")
    got = {(r.date, r.symbol) for r in panel.members_by_date(m, dates).collect()}
    assert got == {(d, s) for d in (date(2020, 6, 30), date(2020, 7, 1)) for s in ("A", "B", "G")} - {(date(2020, 7, 1), "B")}


def test_universe(spark):
    kinds = spark.createDataFrame([(s, "x", "ETF" if s == "G" else "EQUITY") for s in "ABCGT"], CLASSIFICATIONS)
    m = member(spark).unionByName(spark.createDataFrame([("T", "sp500", date(2020, 1, 1), None), ("H", "sp500", date(2020, 1, 1), None)], MEMBERSHIP))
    p = prices(spark, [(d, s, 1.0) for d in D for s in "ACGT"] + [(d, "H", 1.0) for d in D[:2]])
    adv = prices(spark, [(d, s, v) for d in D for s, v in (("A", 5.0), ("T", 5.0), ("C", 9.0), ("G", 9.0), ("H", 9.0))])
    top = panel.liquid_universe(adv, p, m, kinds, "2023-01-01", "2023-01-31", 5)
    assert [r.symbol for r in top.collect()] == ["A", "T"]  # not: other index, fund, half covered
    assert [r.symbol for r in panel.liquid_universe(adv, p, m, kinds, "2023-01-01", "2023-01-31", 2, None).collect()] == ["C", "G"]
    assert {r.symbol: r.sector for r in panel.sectors(kinds).collect()}["A"] == "x"


def test_momentum_lines(spark, tmp_path):
    lines = ["Preamble, with comma", "", ",Mom", "20230103,   0.55", "20230104,  -99.99", "202301, 1.0", "20230105, 1, 2", "Copyright"]
    path = tmp_path / "mom.csv"
    path.write_text("\n".join(lines))
    assert {r.date: r.mom for r in read_momentum(spark, str(path)).collect()} == {D[1]: pytest.approx(0.0055), D[2]: None}
    path.write_text("nothing")
    with pytest.raises(ValueError):
        read_momentum(spark, str(path))
    assert parse_momentum(spark.createDataFrame([], "value string")).count() == 0


def test_sources(spark, tmp_path):
    with pytest.raises(SourceMissing):
        read_parquet(spark, str(tmp_path / "none"))
    wide = spark.createDataFrame([(D[0], 1.0, None), (D[1], 2.0, 3.0)], "date date, A double, B double")
    wide.write.parquet(str(tmp_path / "w"))
    long = from_wide(read_parquet(spark, str(tmp_path / "w")))
    assert {tuple(r) for r in long.collect()} == {(D[0], "A", 1.0), (D[1], "A", 2.0), (D[1], "B", 3.0)}
    with pytest.raises(SchemaMismatch):
        require(wide, "symbol")


def test_factors_and_former_tickers(spark):
    f = panel.factors(spark.createDataFrame([(D[0], 1.0), (D[1], 2.0)], "date date, mkt_rf double"), spark.createDataFrame([(D[1], 3.0)], "date date, mom double"))
    assert [tuple(r) for r in f.collect()] == [(D[1], 2.0, 3.0)]
    held = spark.createDataFrame([("META", "1", date(2022, 6, 9), None), ("META", "2", date(2020, 1, 1), date(2022, 6, 8))], "ticker string, cik string, valid_from date, valid_to date")
    asked = spark.createDataFrame([("META", date(2021, 1, 1)), ("META", D[0]), ("ZZZ", D[0])], "ticker string, date date")
    assert {(r.ticker, r.date): r.cik for r in panel.former_tickers(asked, held).collect()} == {("META", date(2021, 1, 1)): "2", ("META", D[0]): "1", ("ZZZ", D[0]): None}


def test_momentum_from_a_zip_is_kept_as_parquet(spark, tmp_path):
    import zipfile

    from gatewright.sources.market import read_momentum, stored_momentum

    source, kept = str(tmp_path / "mom.zip"), str(tmp_path / "mom.parquet")
    with zipfile.ZipFile(source, "w") as z:
        z.writestr("mom.csv", "Caf\xe9\n,Mom\n20200102,  1.50\n20200103,-99.99\n2020,3\n".encode("latin-1"))
    rows = sorted((str(r.date), r.mom) for r in read_momentum(spark, source).collect())
    assert rows == [("2020-01-02", 0.015), ("2020-01-03", None)]
    assert sorted((str(r.date), r.mom) for r in stored_momentum(spark, source, kept).collect()) == rows
    assert sorted((str(r.date), r.mom) for r in stored_momentum(spark, "gone", kept).collect()) == rows
