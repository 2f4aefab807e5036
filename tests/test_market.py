import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.functions.time import seconds
from quotemill.functions.values import human_number
from quotemill.operators import candles, fundamental, scanners
from quotemill.operators.blocks import ewm_mean
from quotemill.operators.indicators import Daily
from quotemill.sources import model
from quotemill.streaming.candles import rebucket, trade_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("period", [1, 2, 14])
def test_ewm_matches_pandas(spark, period):
    x = np.random.default_rng(0).normal(size=900)
    x[[5, 6, 300]] = np.nan
    df = spark.createDataFrame([(1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "symbol int, i int, x double")
    got = ewm_mean(df, F.col("x"), period, "e", ["symbol"], ["i"]).orderBy("i").toPandas()["e"]
    want = pd.Series(x).ewm(alpha=1 / period).mean() if period > 1 else pd.Series(x)
    known = ~np.isnan(x) | (period > 1)
    assert np.allclose(got[known], want[known], atol=1e-9, equal_nan=True)


def test_rolling_min_of_previous_days(spark):
    closes = [(37 * i) % 23 + 0.5 for i in range(17)]
    daily = spark.createDataFrame([("A", dt.date(2021, 6, 1 + i), c) for i, c in enumerate(closes)], "symbol string, date date, close double")
    for c in ("open", "high", "low", "volume"):
        daily = daily.withColumn(c, F.col("close"))
    target = spark.createDataFrame([("A", dt.date(2021, 6, 18))], "symbol string, date date")
    assert Daily(daily, target).rolling(4, "min", "close").join().first()["min_close_4d"] == min(closes[-4:])


def test_market_cap_as_of(spark):
    known = {2: 31.5, 9: 8.25, 20: 77.0}
    caps = spark.createDataFrame([("A", dt.date(2021, 6, d), v) for d, v in known.items()], "symbol string, date date, value double")
    days = spark.createDataFrame([("A", dt.date(2021, 6, d)) for d in range(1, 25)], "symbol string, date date")
    want = [next((known[k] for k in sorted(known, reverse=True) if k <= d), None) for d in range(1, 25)]
    assert [r["market_cap"] for r in fundamental.market_cap(days, caps).orderBy("date").collect()] == want



def test_three_minutes_merge(spark):
    rows = [("A", dt.datetime(2024, 1, 2, 10, m), *v) for m, v in enumerate([(100.0, 105.0, 98.0, 102.0, 500), (102.0, 108.0, 101.0, 107.0, 700), (107.0, 110.0, 105.0, 108.0, 300)])]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")
    r = candles.resample(bars, "3min").first()
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (100, 110, 98, 108, 1500)


def test_number_parse(spark):
    parts = [(7.25, "M", 1e6), (48.0, "k", 1e3), (2.5, "B", 1e9), (613.0, "", 1), (9.5, "m", 1e6)]
    texts = [f"{v}{unit}" for v, unit, _ in parts] + ["8,076,543", "N/A", "", "none at all"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["v"] for r in df.select("i", human_number(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [v * times for v, _, times in parts] + [8076543, None, None, None]


def test_session_offsets(spark):
    cal = candles.trading_calendar(spark, "2023-12-01", "2024-02-01", ["2024-01-01"])
    days = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2023, 12, 31),)], "date date")
    got = {n: [r["session"] for r in candles.session_offset(days, cal, n).orderBy("date").collect()] for n in (-1, 0, 1)}
    assert got[-1] == [dt.date(2023, 12, 29)] * 2
    assert got[0] == [dt.date(2023, 12, 31), dt.date(2024, 1, 2)]
    assert got[1] == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]


def test_unknown_names():
    with pytest.raises(ValueError):
        seconds("3 weeks")
    with pytest.raises(ValueError):
        scanners.scan("nothing", None, None)


def test_stream_equals_batch(spark, tmp_path):
    schema = model.table(spark, SF, "events").schema
    q = rebucket(trade_stream(spark, SF, schema), "1 hour").writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table("bars").select("symbol", "ts", "open", "high", "low", "close", "volume")
    want = candles.trades_to_candles(model.trades(spark, SF), "1h").withColumn("ts", F.col("ts").cast("timestamp")).select(*got.columns)
    assert got.exceptAll(want).isEmpty()
    assert want.count() - got.count() <= 10  # buckets the watermark has not closed
