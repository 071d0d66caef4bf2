import json
from datetime import date, timedelta

import pytest

from gatewright import schemas
from gatewright.plans import corpus


@pytest.fixture
def lake(spark, tmp_path):
    days = [date(2023, 1, 2) + timedelta(i) for i in range(60) if (date(2023, 1, 2) + timedelta(i)).weekday() < 5]
    tables = {
        "prices": ([(d, s, 1.0) for d in days for s in ("AA", "BB", "ZZ")], schemas.PANEL),
        "dollar_adv": ([(d, s, v) for d in days for s, v in (("AA", 3.0), ("BB", 2.0), ("ZZ", 1.0))], schemas.PANEL),
        "membership": ([(s, "sp500", date(2020, 1, 1), None) for s in ("AA", "BB", "ZZ")], schemas.MEMBERSHIP),
        "classifications": ([(s, "x", "EQUITY") for s in ("AA", "BB", "ZZ")], schemas.CLASSIFICATIONS),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"lake/{name}.parquet"))
    return tmp_path


def block(*rows):
    names = ("form", "accessionNumber", "reportDate", "filingDate", "acceptanceDateTime", "primaryDocument")
    return dict(zip(names, ([r[i] for r in rows] for i in range(6))))


def service(log):
    answers = {
        corpus.TICKERS_URL: json.dumps({"0": {"cik_str": 1, "ticker": "AA", "title": "a"}, "1": {"cik_str": 2, "ticker": "BB", "title": "b"}}),
        corpus.INDEX_URL.format("CIK0000000001.json"): json.dumps(
            {"filings": {"recent": block(("10-K", "0-23-1", "2022-12-31", "2023-02-01", "2023-02-01T21:30:00.000Z", "a.htm"), ("8-K", "0-23-2", "", "2023-02-01", "2023-02-01T21:30:00.000Z", "b.htm")), "files": [{"name": "old.json"}]}}
        ),
        corpus.INDEX_URL.format("old.json"): json.dumps(block(("10-K", "0-23-3", "2021-12-31", "2023-01-20", "2023-01-20T14:00:00.000Z", "c.htm"), ("10-K", "0-11-3", "2010-12-31", "2011-01-20", "2011-01-20T14:00:00.000Z", "c.htm"))),
    }

    def get(url):
        log.append(url)
        if url.endswith("a.htm"):
            return b"<p>Item 7. Text</p>"
        return answers[url].encode()  # BB's index and one page are missing

    return get


def test_build_then_audit(spark, lake, capsys):
    base = ["--lake", str(lake / "lake"), "--out", str(lake / "out"), "--logs", str(lake / "logs")]
    log = []
    corpus.main(["build", *base], service(log))
    out = capsys.readouterr().out
    assert "n_rows 2, n_documents 2, n_tickers 1, done 1, failed 1" in out
    assert "failed: BB" in out and "failed: ZZ: unresolved" in out and "failed: 0-23-3" in out
    index = spark.read.parquet(str(lake / "out/index"))
    assert sorted(r.accession for r in index.collect()) == ["0-23-1", "0-23-3"]
    assert [tuple(r) for r in spark.read.parquet(str(lake / "out/texts")).select("accession", "text").collect()] == [("0-23-1", "Item 7. Text")]
    log.clear()
    corpus.main(["build", *base], service(log))
    assert not any(u.endswith("a.htm") for u in log)  # pages are fetched once
    assert spark.read.parquet(str(lake / "out/texts")).count() == 1  # and parsed once
    corpus.main(["audit", *base])
    table = (lake / "out/pit_check.md").read_text().splitlines()
    assert table[2].startswith("| acceptance | 2 | 0 | 0 | 0 |") and table[3].startswith("| period_end | 2 | 2 | 2 | 100 |")
    assert [json.loads(x)["status"] for x in (lake / "logs/index.jsonl").read_text().splitlines()] == ["ok"] * 3


def test_arguments():
    args = corpus.parser().parse_args(["build", "--lake", "a", "--out", "b"])
    assert (args.top_n, args.start, args.end, args.index_name, args.no_text) == (200, "2012-01-01", "2025-12-31", "sp500", False)


def test_an_interrupted_fetch_goes_on_where_it_stopped(spark, tmp_path):
    """One page ends its task for good at first: what earlier rounds wrote stays and is not asked for again."""
    import os
    import uuid

    from gatewright.sources.filings import SourceMissing
    from gatewright.sources.market import read_parquet

    asked, stop, path = tmp_path / "asked", tmp_path / "stop", str(tmp_path / "pages")
    asked.mkdir()
    stop.touch()

    def get(url, asked=str(asked), stop=str(stop)):
        name = url.rsplit("/", 1)[1]
        open(f"{asked}/{name}-{uuid.uuid4().hex}", "w").close()
        if name == "d7.htm" and os.path.exists(stop):
            raise SystemExit(1)
        if name == "d3.htm":
            raise OSError("gone")
        return f"<p>{name} caf\xe9</p>".encode()

    rows = [(str(i % 3).zfill(10), "T", "10-K", f"{i:010}-23-{i:06}", None, None, None, f"d{i}.htm") for i in range(20)]
    index = spark.createDataFrame(rows, schemas.FILINGS)
    store = lambda: read_parquet(spark, path, schemas.PAGES)
    fetch = lambda held: corpus.fetch_pages(spark, index, held, get, path, at_once=2, tasks=2, per_second=1000)
    with pytest.raises(Exception, match="SystemExit|exited|crashed"):
        fetch(spark.createDataFrame([], schemas.PAGES))
    try:
        kept = {r.accession for r in store().collect()}
    except SourceMissing:
        kept = set()
    stop.unlink()
    before = {f.split("-")[0] for f in os.listdir(asked)}
    errors = fetch(store() if kept else spark.createDataFrame([], schemas.PAGES))
    got = {r.accession: r.html for r in store().collect()}
    assert len(got) == 19 and store().count() == 19 and got[f"{0:010}-23-{0:06}"] == "<p>d0.htm caf\xe9</p>"
    assert list(errors.values()) == ["gone"]
    times = {n: sum(f.startswith(f"{n}-") for f in os.listdir(asked)) for n in before}
    assert all(times[f"d{int(a[:10])}.htm"] == 1 for a in kept)
    assert fetch(store()) == {f"{3:010}-23-{3:06}": "gone"} and store().count() == 19
