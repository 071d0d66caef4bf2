"""Factors of a table that is cut into many files equal their SQL, which adds up in the table's order when one thread runs it."""

import os

import duckdb
import pytest

from gatewright.plans.catalog import ORACLES, QUERIES

from oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    """The tables of SF, lineitem in the same order in 40 files."""
    home = tmp_path_factory.mktemp("cut")
    for name in os.listdir(SF):
        if name != "lineitem.parquet":
            os.symlink(f"{SF}/{name}", home / name)
    (home / "lineitem.parquet").mkdir()
    db = duckdb.connect()
    db.sql(f"CREATE TABLE l AS SELECT * FROM read_parquet('{SF}/lineitem.parquet', file_row_number = true)")
    n = db.sql("SELECT count(*) FROM l").fetchall()[0][0]
    for k in range(40):
        db.sql(f"COPY (SELECT * EXCLUDE file_row_number FROM l WHERE file_row_number * 40 // {n} = {k} ORDER BY file_row_number) TO '{home}/lineitem.parquet/part-{k:04}.parquet'")
    return str(home)


@pytest.mark.parametrize("name", ["factor_legs", "seven_factor_alpha"])
def test_factors_do_not_hang_on_how_files_are_cut(spark, cut, name):
    db = connect(cut)
    db.sql("SET threads = 1")
    assert_same(QUERIES[name](spark, cut), db, ORACLES[name])
    assert_same(QUERIES[name](spark, SF), db, ORACLES[name])
