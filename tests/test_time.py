from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gatewright.functions.timeops import align, session_table, utc_instant, weekdays, whole_days
from gatewright.operators.audit import audit, exact_median, gap_rows, twin_audit
from gatewright.operators.documents import gap_ok

Q1 = [(date(2023, 1, 1), date(2023, 3, 31))]


@pytest.fixture(scope="module")
def calendar(spark):
    return weekdays(spark.createDataFrame(Q1, "a date, b date"))


def rows(spark, *pairs):
    return spark.createDataFrame([(s, a) for s, a in pairs], "signal_date date, accepted string").select("signal_date", F.to_timestamp("accepted").alias("acceptance_datetime"))


def signal(spark, calendar, accepted, **kw):
    df = spark.createDataFrame([(accepted, date(2022, 12, 31))], "a string, period_end date").withColumn("acceptance_datetime", F.to_timestamp("a"))
    return align(df, calendar, **kw).first().signal_date


def test_trading_at_the_period_end_precedes_publication(spark):
    r = audit(rows(spark, (date(2022, 12, 31), "2023-02-15 21:50:00"))).first()
    assert (r.n, r.n_impossible, r.n_lookahead, r.pct_lookahead) == (1, 1, 1, 100.0)


def test_a_day_after_publication_is_clean(spark):
    r = audit(rows(spark, (date(2023, 2, 16), "2023-02-15 14:00:00"))).first()
    assert r.n_lookahead == 0 and 1.0 < r.min_gap_days < 1.5


def test_same_day_is_late_but_possible(spark):
    r = audit(rows(spark, (date(2023, 2, 15), "2023-02-15 20:00:00"))).first()
    assert (r.n_impossible, r.n_lookahead) == (0, 1)


def test_impossible_and_late_are_counted_apart(spark):
    at = "2023-02-15 21:50:00"
    r = audit(rows(spark, (date(2022, 12, 31), at), (date(2023, 2, 16), at), (date(2023, 3, 1), at))).first()
    assert (r.n, r.n_impossible, r.n_lookahead) == (3, 1, 2)


def test_a_missing_date_leaves_other_rows_alone(spark):
    at = "2023-02-15 14:00:00"
    df = rows(spark, (None, at), (date(2023, 2, 16), at))
    assert audit(df).first().n == 2 and audit(df).first().n_lookahead == 0
    gaps = sorted(r.gap is None or round(r.gap, 3) for r in gap_rows(df).collect())
    assert gaps == [True, round(31 / 24, 3)] or gaps == [1, 1.292]


def test_empty_audit(spark):
    r = audit(rows(spark).limit(0)).first()
    assert r.n == 0 and r.pct_lookahead is None


def test_midnight_is_judged_row_by_row(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2023-02-15 00:00:00' AS t UNION ALL SELECT TIMESTAMP_NTZ'2023-02-15 09:30:00'")
    got = sorted(str(r[0]) for r in df.select(utc_instant(df, "t", at_close=True).cast("string")).collect())
    assert got == ["2023-02-15 14:30:00", "2023-02-15 21:00:00"]


@pytest.mark.parametrize(
    "accepted, expected",
    [
        ("2023-02-15 14:00:00", date(2023, 2, 16)),
        ("2023-02-15 23:30:00", date(2023, 2, 17)),
        ("2023-02-15 21:00:00", date(2023, 2, 17)),  # 16:00:00 in New York
        ("2023-02-15 20:59:59", date(2023, 2, 16)),
        ("2023-02-17 23:00:00", date(2023, 2, 21)),  # Friday evening
        ("2023-03-15 20:00:00", date(2023, 3, 17)),  # summer time: 16:00
        ("2023-03-31 12:00:00", None),  # the embargo session is not there
        ("2023-05-01 12:00:00", None),
        ("1980-01-01 12:00:00", date(2023, 1, 3)),
        (None, None),
    ],
)
def test_alignment(spark, calendar, accepted, expected):
    assert signal(spark, calendar, accepted) == expected


def test_clip_keeps_the_last_bar_but_not_beyond_it(spark, calendar):
    assert signal(spark, calendar, "2023-03-31 12:00:00", clip=True) == date(2023, 3, 31)
    assert signal(spark, calendar, "2023-05-01 12:00:00", clip=True) is None


def test_period_end_is_returned_as_it_is(spark, calendar):
    assert signal(spark, calendar, "2023-02-15 14:00:00", alignment="period_end") == date(2022, 12, 31)


def test_unknown_alignment_and_zoneless_acceptance_are_refused(spark, calendar):
    with pytest.raises(ValueError, match="alignment"):
        signal(spark, calendar, "2023-02-15 14:00:00", alignment="other")
    df = spark.sql("SELECT TIMESTAMP_NTZ'2023-02-15 09:30:00' AS acceptance_datetime, DATE'2022-12-31' AS period_end")
    with pytest.raises(ValueError, match="time zone"):
        align(df, calendar)


def test_empty_calendar(spark, calendar):
    assert session_table(calendar.limit(0), 1).count() == 0


def test_honest_alignment_never_precedes_publication(spark, calendar):
    df = spark.range(200).select(
        F.timestamp_seconds(F.lit(int(datetime(2023, 1, 3).timestamp())) + F.col("id") * 30_011).alias("acceptance_datetime"), F.lit(date(2022, 12, 31)).alias("period_end")
    )
    got = {r.alignment: r for r in twin_audit(df, calendar).collect()}
    assert got["acceptance"].n_lookahead == 0 and got["period_end"].n_impossible == 200


@pytest.mark.parametrize("days, good", [(249, False), (250, True), (550, True), (551, False), (None, False)])
def test_annual_gap(spark, days, good):
    assert spark.createDataFrame([(days,)], "g bigint").select(gap_ok(F.col("g"))).first()[0] is good


def test_days_are_elapsed_not_midnights(spark):
    df = spark.sql("SELECT TIMESTAMP'2023-01-02 01:00:00' AS b, TIMESTAMP'2023-01-01 23:00:00' AS a")
    assert df.select(whole_days(F.col("b"), F.col("a")), whole_days(F.col("a"), F.col("b"))).first()[:] == (0, -1)


def test_exact_median(spark):
    import random
    from statistics import median

    r = random.Random(2)
    groups = {"a": [r.choice([-1.5, 0.0, 0.01, 2.0, 2.0, r.random()]) for _ in range(200)], "b": [3.0] * 7, "c": [1.0, 2.0], "d": [-0.001, 0.001, 100.0], "e": [None]}
    df = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own], "k string, v double")
    got = {x.k: x.median for x in exact_median(df, ["k"], "v", 1 / 24).collect()}
    assert got == {k: median(own) for k, own in groups.items() if k != "e"}
