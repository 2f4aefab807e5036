import datetime as dt
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import candles, indicators, quality, registry
from quotemill.plans.streams import ORACLES, q
from quotemill.sources import model, storage
from quotemill.streaming import buckets, running
from test_oracles import rows

SF = "/root/testdata/sf0.001"
BARS = "symbol long, ts timestamp, open double, high double, low double, close double, volume long"
QUERIES_WITH_SQL = [
    "indicators_by_name", "prev_day_calendar", "daily_anchored", "atr_5h", "market_open", "next_session_time", "covering_ranges", "active_by_exchange", "dq_source_issues", "dq_duplicate_times",
    "dq_issue_details", "score_changes", "score_totals", "candle_events", "subscription_triggers", "subscribed_values", "stream_scan_atr_gap_up", "stream_scan_atr_parabolic_down", "stream_scan_low_range_gap_down",
    "stream_scan_small_cap_up", "stream_indicators", "stream_complete_bars", "stream_live_forms", "stream_warm_start", "stream_subscription_triggers", "stream_unseen_headlines", "stream_delivery_latency", "subscribed_sets",
    "store_manifest", "stream_sink",
]


@pytest.mark.parametrize("name", QUERIES_WITH_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "events lineitem documents customer supplier".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = q.QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    for c in got.columns:
        if str(want[c].dtype).startswith("datetime"):
            got[c] = got[c].astype(want[c].dtype)
        elif want[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype(float).round(5) + 0.0, want[c].round(5) + 0.0
    assert len(got) and rows(got) == rows(want)


def test_all_indicators_have_names(spark):
    bars, daily = model.bars(spark, SF), model.daily(spark, SF)
    caps = model.market_caps(spark, SF)
    shares = caps.select("symbol", F.to_json(F.struct("date", "value")).alias("payload"))
    scores = caps.select("symbol", F.col("date").cast("timestamp_ntz").alias("published_at"), F.col("value").alias("score"))
    tables = registry.Tables(daily, bars, model.earnings(spark, SF), caps, model.static(spark, SF), shares, scores)
    given = {"col": "high", "op": "max", "period": 3, "n": 2}
    for name, make in registry.INDICATORS.items():
        asked = make.__code__.co_varnames[2 : make.__code__.co_argcount - len(make.__defaults__ or ())]
        out = registry.indicate(bars, tables, [(name, {p: given[p] for p in asked})])
        assert len(out.columns) > len(bars.columns), name
    assert len(registry.INDICATORS) == 23
    with pytest.raises(ValueError, match="unknown indicator"):
        registry.indicate(bars, tables, [("nothing", {})])
    with pytest.raises(ValueError, match="unknown mode"):
        registry.indicate(bars, tables, [("prev_day", dict(col="close", mode="x"))])
    with pytest.raises(ValueError, match="no live scan"):
        running.marked("day2_gap", bars, daily)


def walk(n, seed=3):
    """Bars of every 7 minutes from 08:00 on, over two days, with a missing low."""
    r = np.random.default_rng(seed)
    at = [dt.datetime(2024, 1, d, 8) + dt.timedelta(minutes=7 * i) for d in (2, 3) for i in range(n)]
    p = 50 + r.normal(size=len(at)).cumsum()
    return pd.DataFrame({"symbol": 1, "ts": at, "open": p, "high": p + r.random(len(at)), "low": np.where(np.arange(len(at)) == 4, np.nan, p - 1), "close": p + 0.1, "volume": r.integers(1, 9, len(at))})


@pytest.mark.parametrize("cuts", [[], [1], [5, 20, 31], list(range(1, 60))])
def test_running_values_do_not_depend_on_batches(spark, cuts):
    bars, want = walk(30), running.Running((("volume", "sum"), ("low", "min")), (("high", "max"),), 5, (("low", 1), ("low", 3), ("close", 2)))
    parts, held = [], None
    for part in np.split(np.arange(len(bars)), cuts):
        out, held = running.advance(bars.iloc[part], held, want)
        parts.append(out)
    got = pd.concat(parts)
    late, again = running.advance(bars.iloc[3:9], held, want)
    assert late is None and again == held
    df = spark.createDataFrame(bars.replace({np.nan: None}), BARS).withColumn("date", F.to_date("ts"))
    df = indicators.cumulative(indicators.cumulative_daily_volume(df), "low", "min")
    df = indicators.shift(indicators.shift(indicators.shift(indicators.premarket_cumulative(df, "high", "max"), "low", 1), "low", 3), "close", 2)
    df = indicators.day_open(df, candles.daily_bars(df.drop("date"), "09:30", "16:00"))
    expected = indicators.atr(df, 5).orderBy("ts").toPandas()
    for name in want.names():
        np.testing.assert_allclose(got[name].to_numpy(float), expected[name].to_numpy(float), err_msg=name)


def test_warm_start_goes_on_from_a_snapshot(spark):
    bars, want = walk(30), running.Running(atr=5, shifts=(("low", 2),))
    all_bars = spark.createDataFrame(bars.dropna(), BARS)
    cut = dt.datetime(2024, 1, 3, 9, 45)
    one = running.to_table(running.running(running.replay(all_bars), want)).filter(F.col("ts") >= F.lit(cut))
    two = running.to_table(running.running(running.replay(all_bars.filter(F.col("ts") >= F.lit(cut))), want, all_bars.filter(F.col("ts") < F.lit(cut))))
    a, b = (x.orderBy("ts").toPandas() for x in (one, two))
    assert len(a) == len(b) > 5
    pd.testing.assert_frame_equal(a, b)


def base(*minutes):
    return pd.DataFrame([{"start": m * 60 // 300 * 300, "at": m * 60, "open": m, "high": m + 2, "low": m - 2, "close": m + 1, "volume": 1} for m in minutes], dtype=float)


def test_bars_come_out_with_their_last_base_bar_or_a_later_bucket():
    out, held = buckets.advance(base(0, 1), None, 60, 300)
    assert out == [] and held[0] == 0
    out, held = buckets.advance(base(4), held, 60, 300)  # the last base bar
    assert out == [(0, 0, 6, -2, 5, 3)] and held == (None,) * 6 + (0,)
    out, held = buckets.advance(base(3, 6), held, 60, 300)  # 3 is late, 6 opens a bucket
    assert out == [] and held[0] == 300 and held[6] == 0
    out, held = buckets.advance(base(12, 7), held, 60, 300)  # a later bucket ends the open one
    assert out == [(300, 6, 9, 4, 8, 2)] and held[0] == 600
    out, held = buckets.advance(base(8), held, 60, 300)
    assert out == [] and held[0] == 600


def test_open_buckets_come_out_after_their_grace(spark, tmp_path):
    rows_ = [(1, dt.datetime(2024, 1, 2, 10, 0), 1.0, 2.0, 0.5, 1.5, 3)]
    spark.createDataFrame(rows_, BARS).write.parquet(str(tmp_path / "in"))
    stream = buckets.complete_bars(spark.readStream.schema(BARS).parquet(str(tmp_path / "in")), "5min", "1min")
    q = stream.writeStream.format("memory").queryName("grace").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    end = time.time() + 60
    while time.time() < end and not spark.table("grace").count():
        time.sleep(0.5)
    q.stop()
    assert [(r["symbol"], r["ts"], r["close"], r["volume"]) for r in spark.table("grace").collect()] == [(1, dt.datetime(2024, 1, 2, 10, 0), 1.5, 3)]


def test_range_reads_and_refresh(spark, tmp_path):
    path, day = str(tmp_path / "bars"), dt.date(2024, 1, 20)
    bars = model.bars(spark, SF).drop("date")
    storage.backfill(bars, path, ["1h", "1d"], dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))
    with pytest.raises(ValueError, match="2024-01-20 is asked for"):
        storage.read_range(spark, path, None, dt.date(2024, 1, 5), day, "1h", today=day)
    got = storage.read_range(spark, path, [1, 2], dt.date(2024, 1, 5), dt.date(2024, 1, 10), "1h", today=day)
    want = bars.filter("symbol IN (1, 2) AND ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-11'")
    assert got.select("symbol", "ts", "close").exceptAll(want.select("symbol", "ts", "close")).isEmpty() and got.count() == want.count()
    splits = spark.createDataFrame([(1, dt.date(2024, 1, 8), 1, 2), (1, dt.date(2030, 1, 1), 1, 7)], "symbol long, execution_date date, split_from int, split_to int")
    halved = storage.read_range(spark, path, [1], dt.date(2024, 1, 5), dt.date(2024, 1, 10), "1h", splits, today=day).join(want.select("symbol", "ts", F.col("close").alias("was")), ["symbol", "ts"])
    assert {(r["date"] < dt.date(2024, 1, 8), round(r["close"] / r["was"], 6)) for r in halved.collect()} == {(True, 0.5), (False, 1.0)}
    none = spark.createDataFrame([], "symbol long, key string, expires date")
    after = storage.refresh(bars.withColumn("volume", F.col("volume") + 1), path, "1h", none, day)
    assert {(r["key"], r["expires"]) for r in after.filter("key = '2024-01'").collect()} == {("2024-01", dt.date(2024, 1, 21))}
    fresh = storage.read_range(spark, path, None, dt.date(2024, 1, 1), dt.date(2024, 1, 19), "1h", today=day)
    assert fresh.join(bars.select("symbol", "ts", F.col("volume").alias("was")), ["symbol", "ts"]).filter("volume <> was + 1").isEmpty()
    assert storage.read_range(spark, path, None, dt.date(2024, 1, 1), dt.date(2024, 1, 19), "1d", today=day).count() > 0


def test_exported_calculations_are_in_utc(spark, tmp_path):
    df = spark.sql("SELECT 1 AS symbol, timestamp_ntz'2024-01-02 09:30:00' AS ts UNION ALL SELECT 1, timestamp_ntz'2024-07-02 09:30:00'")
    storage.export_calculation(df, str(tmp_path / "c"))
    assert sorted(r["ts"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["2024-01-02 14:30:00", "2024-07-02 13:30:00"]


def test_unreadable_rows_are_issues(spark):
    at = "symbol long, ts timestamp"
    stream = spark.createDataFrame([(1, dt.datetime(2024, 1, 2)), (4, dt.datetime(2024, 1, 2))], at)
    source = spark.createDataFrame([(1, dt.datetime(2024, 1, 2)), (2, dt.datetime(2024, 1, 2)), (4, dt.datetime(2024, 1, 5))], at)
    wanted, bad = spark.createDataFrame([(1,), (2,), (3,), (4,)], "symbol long"), spark.createDataFrame([(1,), (1,), (9,)], "symbol long")
    got = sorted(tuple(r) for r in quality.source_issues(stream, source, wanted, bad, bad.filter("symbol = 9")).collect())
    assert got == [(1, "ERROR_READING_REALTIME"), (2, "MISSING_REALTIME_DATA"), (3, "EMPTY_SOURCE_DATA"), (3, "MISSING_REALTIME_DATA"), (4, "EMPTY_SOURCE_DATA")]
