import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quotemill.operators import candles, parsing
from quotemill.sources import model, storage
from quotemill.streaming import live

SF = "/root/testdata/sf0.001"
BARS = "symbol long, ts timestamp, open double, high double, low double, close double, volume long"


def bar(symbol, day, minute, open_, high, low, close, volume):
    return (symbol, dt.datetime(2024, 1, day, 10, minute), float(open_), float(high), float(low), float(close), volume)


def test_scores(spark):
    texts = [
        ('noise [{"idx": 0, "confidence": 55.9}, {"idx": 9, "confidence": 5}] more', 3), ('[{"idx": "1", "confidence": 5}, {"idx": 2, "confidence": 101}]', 3),
        ("no array", 3), ("", 3), (None, 3), ('[{"idx": 1.5, "confidence": 5}, {"idx": 2, "confidence": 0}]', 3), ("[]", 3),
    ]
    got = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, t string, n int").select("i", parsing.parse_scores(F.col("t"), F.col("n")).alias("s")).orderBy("i").collect()
    assert [None if r["s"] is None else [tuple(e) for e in r["s"]] for r in got] == [[(0, 55)], None, None, None, None, [(2, 0)], None]


def test_fundamentals(spark):
    raw = '{"General": {"Type": "ETF", "AddressData": "NA", "Officers": {"0": {"Name": "A", "Title": null}, "1": {"Name": "B", "Title": "Co-ceo"}, "2": {"Name": "C", "Title": "CEO & CFO"}}}, "SharesStats": "NA", "Technicals": {"Beta": "1.5"}}'
    caps = '{"0": {"date": "2024-01-02", "value": 2}, "1": {"date": "2024-01-01", "value": 1}, "2": {"date": "2024-01-02", "value": 3}, "3": {"date": "bad", "value": 9}}'
    df = spark.createDataFrame([(1, raw, caps), (2, None, None), (3, "{", "{")], "i int, raw string, caps string")
    a, b, c = parsing.fundamentals(df).orderBy("i").collect()
    assert (a["type"], a["city"], a["shares_float"], a["beta"], a["ceo_name"], a["cfo_name"]) == ("ETF", None, None, 1.5, "B", "C")
    assert [tuple(x) for x in a["historical_market_cap"]] == [(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 2), 3.0)]
    assert b["type"] is b["historical_market_cap"] is c["type"] is None


def test_headlines_of_pages(spark):
    row = lambda d, t: f'<tr><td width="130">{d}</td><td><a class="tab-link-news">{t}</a></td></tr>'
    html = f'<table id="news-table">{row("09:00AM", "a")}{row("Jan-02-24 08:00AM", "b &lt; c")}{row("07:00AM", "d")}{row("Jan-01-24", "")}</table><table>{row("Jan-09-24", "out")}</table>'
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<table><tr>")], "page_id long, html string")
    assert [tuple(r) for r in parsing.page_headlines(df).orderBy("pos").collect()] == [(1, 0, None, "a"), (1, 1, "Jan-02-24", "b < c"), (1, 2, "Jan-02-24", "d")]


def test_backfill_and_read(spark, tmp_path):
    base = model.bars(spark, SF, "1h").drop("date")
    for _ in range(2):  # a second run replaces, never adds
        storage.backfill(base, str(tmp_path / "b"), ["1h", "1d"], dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))
    bars, _ = storage.read_bars(spark, str(tmp_path / "b"))
    want = candles.resample_multi(base, ["1h", "1d"])
    assert bars.count() == want.count()
    assert bars.filter("freq = '1d'").select("symbol", "ts", "close", "volume").exceptAll(want.filter("freq = '1d'").select("symbol", "ts", "close", "volume")).isEmpty()
    one = next((tmp_path / "b").glob("freq=1d/*/*.parquet"))
    one.write_bytes(b"broken")
    one.with_name(f".{one.name}.crc").unlink(missing_ok=True)
    assert storage.read_bars(spark, str(tmp_path / "b"))[0].count() < want.count()


def test_text_rows_that_do_not_fit(spark, tmp_path):
    folder = tmp_path / "freq=1h" / "key=2024-01"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("1,2024-01-02 10:00:00,1,2,0.5,1.5,10\n1,oops,1\n")
    (folder / "empty.csv").write_text("")
    bars, bad = storage.read_bars(spark, str(tmp_path), "csv")
    assert [r["close"] for r in bars.collect()] == [1.5]
    assert [(r["key"], r["_bad"]) for r in bad.collect()] == [("2024-01", "1,oops,1")]


def test_reports_are_not_overwritten(spark, tmp_path):
    df = spark.range(2)
    path = storage.export_report(df, str(tmp_path), "one")
    with pytest.raises(AnalysisException):
        storage.export_report(df, str(tmp_path), "one")
    assert storage.export_report(df, str(tmp_path)) != path and spark.read.option("header", True).csv(path).count() == 2


def test_universe_scan_and_subscriptions(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([bar(1, 2, 0, 10, 12, 9, 11, 5), bar(2, 2, 3, 10, 12, 9, 9, 5)], BARS).write.parquet(source)
    stream = spark.readStream.schema(BARS).parquet(source)
    seen = []
    q = live.write_active(stream, lambda: spark.createDataFrame([(2,), (2,)], "symbol long"), lambda b, n: seen.extend(r["symbol"] for r in b.collect()), str(tmp_path / "c"), {"availableNow": True})
    assert q.awaitTermination(120) and seen == [2]
    bars = spark.read.parquet(source)
    features = spark.createDataFrame([(2, dt.date(2024, 1, 2), 12.0)], "symbol long, date date, prev_close double")
    assert [(r["symbol"], r["scan_time"]) for r in live.live_scan(live.with_features(bars, features), F.col("close") < F.col("prev_close")).collect()] == [(2, "10:03")]
    slow = spark.createDataFrame([(1, dt.date(2024, 1, 2), 3.0), (1, dt.date(2024, 1, 2), 1.0)], "symbol long, date date, value double")
    assert {r["symbol"]: r["news"] for r in live.slow_features(bars, slow, "news").collect()} == {1: 3.0, 2: None}
    wanted = spark.createDataFrame([("s", 1, "1min"), ("t", 1, "1min"), ("u", 2, "5min")], "subscription_id string, symbol long, freq string")
    assert sorted(r["subscription_id"] for r in live.subscribed(bars.withColumn("freq", F.lit("1min")), wanted).collect()) == ["s", "t"]
