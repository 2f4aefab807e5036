"""State that goes from one micro-batch to the next, and over restarts, against the batch operators."""

import datetime as dt
import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.operators import candles, listings, quality, registry
from quotemill.sources import model
from quotemill.streaming import indicators, live, running

SF = "/root/testdata/sf0.001"
WANTED = [
    ("cumulative_daily_volume", {}), ("premarket_cumulative", dict(col="high", op="max")), ("cumulative", dict(col="low", op="min")), ("atr", dict(period=5)),
    ("position_in_range", dict(n=3)), ("daily_rolling", dict(n=2, op="sum", col="volume")), ("gap", dict(col="close")), ("atr_gap", dict(col="low", period=3)), ("shift", dict(col="close", n=2)),
    ("prev_day", dict(col="open")), ("daily_gap", {}), ("daily_atr", dict(period=3)), ("daily_atr_gap", dict(period=3)), ("adr", dict(period=4)), ("adv", dict(period=4)), ("day_open", {}),
    ("days_to_earnings", {}), ("days_from_earnings", {}), ("market_cap", {}), ("days_since_ipo", {}), ("shares_float", {}), ("news_confidence", {}),
]
COLUMNS = [
    "cumulative_daily_volume", "premarket_highest_high", "lowest_low", "atr_5", "position_in_range_3d", "sum_volume_2d", "gap_close", "atr_gap_low_3", "close_shift_2", "prev_day_open", "daily_gap",
    "daily_atr_3", "daily_atr_gap_3", "adr_4", "adv_4", "day_open", "days_to_earnings", "days_from_earnings", "market_cap", "days_since_ipo", "shares_float", "news_confidence",
]


@pytest.fixture(scope="module")
def tables(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    caps = spark.createDataFrame([(s, day(3 * n), float(s * 10 + n)) for s in range(10) for n in range(12)], "symbol long, date date, value double")
    earnings = spark.createDataFrame([(s, day(7 * n + s)) for s in range(10) for n in range(6)], "symbol long, date date")
    static = spark.createDataFrame([(s, day(s - 100)) for s in range(9)], "symbol long, ipo_date date")
    scores = spark.createDataFrame([(s, dt.datetime(2024, 1, d, h), (s * 7 + d * 13 + h * 5) % 100) for s in range(10) for d in range(1, 28) for h in (3, 9, 10, 17)], "symbol long, published_at timestamp_ntz, score long")
    shares = caps.select("symbol", F.to_json(F.struct("date", "value")).alias("payload"))
    bars = model.bars(spark, SF)
    daily = candles.daily_bars(bars.drop("date"), "09:30", "16:00")  # of the bars that the stream has
    return bars, registry.Tables(daily, bars, earnings, caps, static, shares, scores)


def frame(df):
    out = df.select("symbol", F.col("ts").cast("timestamp"), *[F.col(c).cast("double") for c in COLUMNS]).toPandas()
    return out.sort_values(["symbol", "ts"]).reset_index(drop=True)


def test_all_live_forms_equal_batch_over_batches_and_a_restart(spark, tables, tmp_path):
    bars, t = tables
    assert {n for n, _ in WANTED} == set(registry.INDICATORS) - {"prev_allday"} and len(WANTED) == len(COLUMNS) == 22
    want = frame(registry.indicate(bars, t, WANTED))
    days = bars.select("symbol", "date").distinct()
    source, ends = str(tmp_path / "in"), [dt.datetime(2024, 1, d) for d in (1, 6, 12, 18, 25)] + [dt.datetime(2025, 1, 1)]
    base, seen = bars.drop("date").withColumn("ts", F.col("ts").cast("timestamp")), set()
    for a, b in zip(ends, ends[1:], strict=False):  # each stretch of days is a query of its own, which goes on from the state that the one before left
        base.filter((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))).write.mode("append").parquet(source)
        stream = indicators.live_indicators(spark.readStream.schema(base.schema).parquet(source), WANTED, t, days)
        q = running.start(stream, str(tmp_path / "out"))
        q.awaitTermination()
        seen |= {p["batchId"] for p in q.recentProgress if p["numInputRows"]}
    assert len(seen) >= 5
    got = frame(spark.read.schema(stream.schema).parquet(str(tmp_path / "out" / "rows")))
    assert (got[["symbol", "ts"]].values == want[["symbol", "ts"]].values).all()
    for c in COLUMNS:
        np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-12, err_msg=c)
        assert got[c].notna().any(), c


def test_warm_start_equals_the_whole_history_over_five_batches(spark, tables):
    bars, t = tables
    base, cut = bars.drop("date"), F.lit("2024-01-10 13:00:00").cast("timestamp_ntz")
    wanted = [("cumulative_daily_volume", {}), ("premarket_cumulative", dict(col="low", op="min")), ("atr", dict(period=14)), ("shift", dict(col="high", n=3)), ("shift", dict(col="high", n=1)), ("day_open", {})]
    names = ["cumulative_daily_volume", "premarket_lowest_low", "atr_14", "high_shift_3", "high_shift_1", "day_open"]
    live_bars = running.replay(base.filter(F.col("ts") >= cut), 5)
    got = running.to_table(indicators.live_indicators(live_bars, wanted, t, bars.select("symbol", "date").distinct(), base.filter(F.col("ts") < cut)))
    got = got.select("symbol", "ts", *names).toPandas().sort_values(["symbol", "ts"])
    batch = registry.indicate(bars, t, wanted).filter(F.col("ts") >= cut).select("symbol", F.col("ts").cast("timestamp"), *[F.col(c).cast("double") for c in names])
    want = batch.toPandas().sort_values(["symbol", "ts"])
    assert len(got) == len(want) > 50
    for c in names:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, err_msg=c)


def test_unknown_and_missing_live_forms(spark, tables):
    bars, t = tables
    with pytest.raises(ValueError, match="no live form of 'prev_allday'"):
        indicators.live_indicators(bars, [("prev_allday", dict(col="high"))], t, bars)
    with pytest.raises(ValueError, match="one average range"):
        indicators.live_indicators(bars, [("atr", dict(period=3)), ("atr", dict(period=4))], t, bars)


def test_replay_gives_each_stretch_of_time_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(60)], "symbol long, ts timestamp")
    seen = {}
    q = running.replay(rows, 6).writeStream.foreachBatch(lambda b, n: seen.update({n: sorted(r["ts"] for r in b.collect())})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 6 and sum(map(len, seen.values())) == 60
    assert all(seen[k][-1] < seen[k + 1][0] for k in range(5))
    assert running.replay(rows.limit(0)).schema == rows.schema


def test_triggers_keep_their_counts_across_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(4)), int(rng.integers(2)), "s" if rng.random() < 0.7 else "min", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(i // 2)), i, bool(rng.random() < 0.5)) for i in range(400)]
    changes = spark.createDataFrame(rows, "subscriber long, symbol long, unit string, ts timestamp, seq long, add boolean")
    got = running.to_table(live.live_triggers(running.replay(changes, 6)))
    want = live.subscription_triggers(changes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and want.count() > 20


def test_unseen_titles_in_a_stream(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(1, "a", at(1, 8)), (1, "a", at(1, 20)), (2, "a", at(1, 9)), (1, "a", at(2, 1)), (1, "b", at(2, 2)), (1, "b", at(2, 23)), (None, "b", at(2, 3)), (1, None, at(3, 1)), (1, None, at(3, 2))]
    heads = spark.createDataFrame(rows, "symbol long, title string, published_at timestamp")
    got = running.to_table(live.unseen_stream(running.replay(heads, 5, at="published_at")))
    key = lambda df: sorted((tuple(r) for r in df.select("symbol", "title", F.to_date("published_at")).collect()), key=repr)
    assert key(got) == key(heads.dropDuplicates(["symbol", "title", "published_at"]).select("symbol", "title", F.to_date("published_at").alias("published_at")).distinct())
    seen_before = heads.filter("published_at < timestamp'2024-01-01 10:00:00'")
    fresh = listings.unseen_today(got, seen_before)  # what earlier runs scored goes as in batch
    assert key(fresh) == [x for x in key(got) if x[2] != dt.date(2024, 1, 1)]


def test_monitors_in_a_stream(spark):
    rng = np.random.default_rng(7)
    rows = []
    for m in range(30):
        ts = dt.datetime(2024, 1, 2, 10, m)
        rows += [(ts, ts + dt.timedelta(seconds=60 + int(x))) for x in rng.integers(0, 40, 200)]
    rows.append((dt.datetime(2024, 1, 2, 11), dt.datetime(2024, 1, 2, 11, 2)))  # a later bar, so that the watermark passes all others
    df = spark.createDataFrame(rows, "ts timestamp, arrived timestamp")
    got = running.to_table(live.arrival_spread_stream(running.replay(df, 6), 60)).filter("ts < timestamp'2024-01-02 11:00:00'")
    plain = df.groupBy("ts").agg((F.unix_timestamp(F.min("arrived")) - F.unix_timestamp("ts") - 60).alias("delay_s"), (F.unix_timestamp(F.max("arrived")) - F.unix_timestamp(F.min("arrived"))).alias("spread_s")).filter("ts < timestamp'2024-01-02 11:00:00'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 30
    done = df.withColumnRenamed("arrived", "processed")
    got = running.to_table(live.delivery_latency_stream(running.replay(done, 6))).toPandas().set_index("ts")
    exact = quality.delivery_latency(done).toPandas().set_index("ts").loc[got.index]
    assert (got["last_s"] == exact["last_s"]).all() and (got["n"] == exact["n"]).all()
    values = {ts: np.sort([(b - a).total_seconds() - 60 for a, b in rows if a == ts]) for ts in got.index.to_pydatetime()}
    for ts, r in got.iterrows():  # a value of the rank asked for, give or take one row of 200
        v = values[ts.to_pydatetime()]
        for q, c in ((0.5, "median_s"), (0.95, "p95_s")):
            k = int(np.ceil(q * len(v))) - 1
            assert v[max(k - 1, 0)] <= r[c] <= v[min(k + 1, len(v) - 1)]


def test_only_what_is_asked_for_is_computed(spark, tables):
    bars, t = tables
    known = {"total_volume": ("cumulative", dict(col="volume", op="sum")), "low_shift_2": ("shift", dict(col="low", n=2)), "prev_day_close": ("prev_day", dict(col="close"))}
    subs = [("a", 1, "1h", ["total_volume"]), ("a", 1, "1h", ["low_shift_2", "total_volume"]), ("b", 1, "1h", ["prev_day_close"]), ("b", 2, "1h", ["prev_day_close"]), ("c", 2, "1d", ["total_volume"]), ("d", 99, "1h", ["total_volume"])]
    subscriptions = spark.createDataFrame(subs, "subscription_id string, symbol long, freq string, indicators array<string>")
    asked = []

    def compute(df, freq, names):
        asked.append((freq, names))
        return registry.indicate(df, t, [known[n] for n in names])

    by_freq = {"1h": bars, "1d": candles.resample(bars, "1d").withColumn("date", F.to_date("ts"))}
    got = live.subscribed_indicators(by_freq, subscriptions, compute)
    assert sorted(asked) == [("1d", ("total_volume",)), ("1h", ("low_shift_2", "total_volume")), ("1h", ("prev_day_close",)), ("1h", ("total_volume",))]
    everything = {f: registry.indicate(df, t, list(known.values())) for f, df in by_freq.items()}
    want = live.subscribed_values(everything["1h"].withColumn("freq", F.lit("1h")).unionByName(everything["1d"].withColumn("freq", F.lit("1d"))), subscriptions)
    flat = lambda df: sorted(((r["subscription_id"], r["symbol"], r["freq"], r["ts"], tuple(sorted(r["values"].items()))) for r in df.collect()), key=repr)
    assert flat(got) == flat(want) and len(flat(got)) > 20
    one = live.subscribed_indicators(by_freq, subscriptions.filter("subscription_id = 'c'"), compute)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan and "prev_day_close" not in plan and "Window" in plan


def test_replay_bounds_its_files_but_not_its_batches(spark):
    heads = spark.range(600).selectExpr("id % 7 AS symbol", "repeat(cast(id AS string), 100) AS title", "timestamp'2024-01-01' + make_dt_interval(0, id) AS published_at")
    stream, seen = running.replay(heads, 3, at="published_at", size=10_000), {}
    stream.writeStream.foreachBatch(lambda b, n: seen.update({n: [r[0] for r in b.selectExpr("unix_micros(published_at)").collect()]})).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(map(len, seen.values())) == 600
    assert all(max(seen[n]) < min(seen[n + 1]) for n in range(2))
    folder = stream._jdf.queryExecution().analyzed().toString().split("FileSource[")[1].split("]")[0].removeprefix("file:")
    sizes = [len(spark.read.parquet(str(p)).collect()) for p in sorted(pathlib.Path(folder).glob("*.parquet"))]
    assert len(sizes) > 12 and max(sizes) < 100
