"""Long histories: the two-pass mean of ranges against pandas, the as-of join and order of arrival against plain loops, one symbol with most rows."""

import bisect
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import blocks, quality


def nullable(spark, df):
    out = spark.createDataFrame(df)
    return out.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@pytest.mark.parametrize("period", [1, 3, 14, 200])
def test_average_range_equals_pandas(spark, period):
    rng = np.random.default_rng(2)
    parts = []
    for symbol, n in ((1, 2500), (2, 1), (3, 40)):  # one symbol has nearly all bars
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(500 * 24 * 60, n, replace=False)), unit="min")
        p = 50 + rng.normal(size=n).cumsum()
        x = pd.DataFrame({"symbol": symbol, "ts": ts, "high": p + rng.random(n), "low": p - rng.random(n), "close": p})
        for c in ("high", "low", "close"):
            x.loc[rng.random(n) < 0.05, c] = np.nan
        before = x["close"].shift()
        span = pd.concat([(x["high"] - x["low"]).abs(), (x["high"] - before).abs(), (x["low"] - before).abs()], axis=1).max(axis=1)
        parts.append(x.assign(want=span.ewm(alpha=1 / period, adjust=True).mean() if period > 1 else span))
    bars = pd.concat(parts)
    for chunk in (F.date_trunc("month", "ts"), F.date_trunc("day", "ts"), F.lit(0)):
        got = blocks.average_range(nullable(spark, bars), period, "got", chunk)
        assert got.columns == [*bars.columns, "got"]
        got = got.toPandas()
        assert len(got) == len(bars)
        np.testing.assert_allclose(got["got"].astype(float), got["want"].astype(float), rtol=1e-9, atol=1e-12)


def test_average_range_is_cut_in_time(spark):
    bars = nullable(spark, pd.DataFrame({"symbol": [1], "ts": [pd.Timestamp("2024-01-01")], "high": [2.0], "low": [1.0], "close": [1.5]}))
    plan = blocks.average_range(bars, 14, "v", F.date_trunc("month", "ts"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line and "high#" not in line.split("], [")[0]]
    by_symbol_alone = [w for w in windows if "], [symbol#" in w and "_chunk#" not in w.split("], [", 1)[1].split("]")[0] and "_k#" in w]
    assert windows and not by_symbol_alone


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("days", [1, 64])
def test_asof_join_with_one_large_symbol(spark, forward, days):
    rng = np.random.default_rng(4)
    day = lambda n: dt.date(2015, 1, 1) + dt.timedelta(days=int(n))
    right = {(int(s), day(n)): float(i) for i, (s, n) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 300), rng.integers(0, 3000, 300), strict=True))}
    left = [(int(s), day(n), i) for i, (s, n) in enumerate(zip(rng.choice([1, 1, 1, 2, 4], 2000), rng.integers(0, 3200, 2000), strict=True))] + [(None, day(5), -1), (1, None, -2), (1, day(7), -3), (1, day(7), -3)]
    rows = [(s, d, v) for (s, d), v in right.items()] + [(None, day(1), 9.0), (1, None, 9.0)]
    got = blocks.asof_join(spark.createDataFrame(left, "symbol long, date date, k long"), spark.createDataFrame(rows, "symbol long, date date, v double"), {"v": "value"}, forward=forward, days=days)
    assert got.columns == ["symbol", "date", "k", "value"]
    known = {s: sorted(d for t, d in right if t == s) for s in (1, 2, 3, 4)}

    def want(s, d):
        if s is None or d is None:
            return None
        i = bisect.bisect_left(known[s], d) if forward else bisect.bisect_right(known[s], d) - 1
        return right[s, known[s][i]] if 0 <= i < len(known[s]) else None

    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((s, d, k, want(s, d)) for s, d, k in left), key=repr)


def test_asof_join_of_empty_sides(spark):
    left, right = spark.createDataFrame([], "symbol long, date date"), spark.createDataFrame([], "symbol long, date date, v double")
    assert blocks.asof_join(left, right, {"v": "x"}).collect() == []
    one = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "symbol long, date date")
    assert [tuple(r) for r in blocks.asof_join(one, right, {"v": "x"}).collect()] == [(1, dt.date(2024, 1, 1), None)]


def test_unsorted_rows_across_stretches(spark):
    rng = np.random.default_rng(6)
    rows = [(int(s), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(i + rng.integers(-2, 3))), i) for i, s in enumerate(rng.choice([1, 1, 2], 400))]
    want = {1: 0, 2: 0}
    for s in want:
        own = [t for k, t, _ in rows if k == s]
        want[s] = sum(b < a for a, b in zip(own, own[1:], strict=False))
    df = spark.createDataFrame(rows, "symbol long, ts timestamp, seq long")
    for stretch in (1, 7, 1 << 20):
        got = quality.unsorted_rows(df, stretch=stretch)
        assert got.columns == df.columns
        assert {r["symbol"]: r["count"] for r in got.groupBy("symbol").count().collect()} == want
