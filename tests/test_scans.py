"""Scans with bounds, the report, vendor bars, news and monitors."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import SF, TABLES, rows

from quotemill.operators import candles, listings, quality, scanners
from quotemill.plans import scans
from quotemill.plans.queries import ORACLES, QUERIES
from quotemill.sources import model

DAY = datetime.date(2024, 3, 4)  # a Monday


@pytest.mark.parametrize("name", ["scan_atr_gap_down_bounded", "scan_daily_parabolic_down_bounded", "scan_day2_gap_bounded", "scan_report_full", "normalise_bars", "news_as_of", "unseen_today", "round_robin_by_sources", "arrival_spread", "delivery_latency"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in [*TABLES, "nation", "region"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    for c in got.columns:
        if str(want[c].dtype).startswith("datetime"):
            got[c] = got[c].astype(want[c].dtype)
        elif want[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype(float).round(5) + 0.0, want[c].round(5) + 0.0
    assert rows(got) == rows(want)


def test_unknown_values_and_bounds(spark):
    days = spark.createDataFrame([(k, DAY + datetime.timedelta(d)) for k in range(1, 6) for d in range(6)], "symbol long, date date")
    caps = spark.createDataFrame([(1, DAY, 10.0), (2, DAY, 50.0), (3, DAY, 10.0), (4, DAY, 10.0)], "symbol long, date date, value double")
    earnings = spark.createDataFrame([(1, DAY - datetime.timedelta(2)), (2, DAY), (3, DAY)], "symbol long, date date")
    static = spark.createDataFrame([(1, DAY - datetime.timedelta(400)), (3, DAY - datetime.timedelta(3))], "symbol long, ipo_date date")
    of = lambda **b: {(r["symbol"], (r["date"] - DAY).days) for r in scanners.day_bounds(days, caps, earnings, static, **b).collect()}
    every = {(k, d) for k in range(1, 6) for d in range(6)}
    assert of() == every
    assert of(max_market_cap=20) == {(k, d) for k, d in every if k in (1, 3, 4)}
    assert of(max_market_cap=20, include_null_market_cap=True) == {(k, d) for k, d in every if k != 2}
    assert of(min_days_since_ipo=5) == {(k, d) for k, d in every if k != 3 or d >= 2}
    assert of(min_days_from_earnings=1, max_days_from_earnings=4) == {(1, d) for d in range(3)} | {(k, d) for k in (2, 3) for d in range(1, 5)}
    assert of(days_of_week=[0, 5]) == {(k, d) for k, d in every if d in (0, 5)}


def test_bounds_leave_rows_of_a_scan_as_they_are(spark):
    plain = {tuple(r) for r in QUERIES["scan_parabolic_up"](spark, SF).collect()}
    bounded = {tuple(r) for r in QUERIES["scan_parabolic_up_bounded"](spark, SF).collect()}
    assert bounded <= plain and scans.YEARS == 24


def test_vendor_bars_without_open_go(spark):
    raw = spark.createDataFrame([("A", 0, None, 2.0), ("A", 60_000, 3.0, 4.0), ("A", 120_000, 5.0, 6.0), ("A", 900_000, None, 1.0)], "symbol string, t long, o double, h double")
    out = candles.normalise_bars(raw.withColumns({"l": F.col("o"), "c": F.col("o"), "v": F.lit(1)}), "15min").collect()
    assert [(r["symbol"], r["ts"], r["open"], r["high"]) for r in out] == [("A", datetime.datetime(1970, 1, 1), 3.0, 4.0)]


def test_scores_hold_from_their_time_on_and_for_the_day(spark):
    at = lambda d, h: datetime.datetime(2024, 3, 4 + d, h)
    bars = spark.createDataFrame([("A", at(d, h).date(), at(d, h)) for d in (0, 1) for h in (9, 10, 11)], "symbol string, date date, ts timestamp_ntz")
    scored = spark.createDataFrame([("A", at(0, 10), 70), ("A", at(0, 11), 40), ("B", at(0, 9), 99)], "symbol string, published_at timestamp_ntz, score int")
    got = {r["ts"]: r["news_confidence"] for r in listings.news_as_of(bars, scored).collect()}
    assert got == {at(0, 9): None, at(0, 10): 70, at(0, 11): 70, at(1, 9): None, at(1, 10): None, at(1, 11): None}


def test_arrivals_of_an_older_bar_are_ignored(spark):
    t = lambda s: datetime.datetime(2024, 3, 4, 10, s // 60, s % 60)
    rows_ = [(t(0), t(62)), (t(0), t(65)), (t(60), t(121)), (t(0), t(130)), (t(60), t(124))]
    got = {r["ts"]: (r["delay_s"], r["spread_s"]) for r in quality.arrival_spread(spark.createDataFrame(rows_, "ts timestamp_ntz, arrived timestamp_ntz"), 60).collect()}
    assert got == {t(0): (2, 3), t(60): (1, 3)}


def test_days_of_a_bounded_scan_are_computed_once(spark):
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")
    assert reads(model.shipments(spark, SF)) == 1
    for side in ("up", "down"):  # the days within the other bounds come from a written table
        assert reads(QUERIES[f"scan_daily_parabolic_{side}_bounded"](spark, SF)) == 0
        assert reads(QUERIES[f"scan_daily_parabolic_{side}"](spark, SF)) == 2  # once more for unknown symbols, of which there are none


def test_days_as_their_own_target(spark):
    from quotemill.operators import blocks

    days = spark.createDataFrame([(k, DAY + datetime.timedelta(d), 1.0) for k in (1, 2, None) for d in range(3)], "symbol long, date date, close double")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(blocks.spine(days, days)) == key(blocks.spine(days, days.select("*"))) and blocks.spine(days, days).count() == 10
