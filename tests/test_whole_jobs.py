"""Queries that an earlier form had cut do the whole job."""

import datetime

from quotemill.operators import candles, listings, quality, scanners
from quotemill.plans import queries
from quotemill.sources import model

T = datetime.datetime(2024, 1, 1, 10)
H = datetime.timedelta(hours=1)


def bars(spark, rows):
    return spark.createDataFrame([(s, T + k * H, 1.0, 2.0, 0.5, c, 10, q) for s, k, c, q in rows], "symbol long, ts timestamp_ntz, open double, high double, low double, close double, volume long, seq long")


def test_issue_summary_counts_all_audits(spark):
    source = bars(spark, [(1, k, 1.5, k) for k in range(5)] + [(2, 0, 1.5, 0), (3, 0, 1.5, 0)])
    # symbol 1: hour 1 lost, hour 2 changed, hour 3 twice, the last arrival early; symbol 2: an hour too many; symbol 3 never came
    stream = bars(spark, [(1, 0, 1.5, 0), (1, 2, 1.7, 1), (1, 3, 1.5, 2), (1, 4, 1.5, 3), (1, 3, 1.5, 4), (2, 0, 1.5, 0), (2, 1, 1.5, 1)])
    got = {r["issue_type"]: (r["n"], r["symbols"]) for r in quality.issue_summary(quality.issue_counts(stream, source)).collect()}
    assert got == dict.fromkeys(["DUPLICATE", "MISMATCH", "MISSING", "EXTRA", "UNSORTED", "MISSING_STREAM"], (1, 1))


def test_every_part_gives_a_split(spark):
    sf = "/root/testdata/sf0.01"
    part, supplier = (model.table(spark, sf, t) for t in ("part", "supplier"))
    got = model.splits(spark, sf)
    assert got.count() == part.count() > 300 and got.select("symbol").distinct().count() == supplier.count()


def test_daily_scans_see_the_newest_session(spark):
    def days(extra):  # Monday 1 January to Friday 19 January 2024, the last day as given
        dates = [datetime.date(2024, 1, d) for d in range(1, 20) if datetime.date(2024, 1, d).weekday() < 5]
        rows = [(1, d, 10.0, 10.6, 9.9, 10.5, 1000) for d in dates[:-1]] + [(1, dates[-1], *extra, 1000)]
        return spark.createDataFrame(rows, "symbol long, date date, open double, high double, low double, close double, volume long")

    calendar = candles.trading_calendar(spark, "2024-01-01", "2024-01-31", [])
    monday = datetime.date(2024, 1, 22)
    d = days((10.0, 12.0, 10.0, 12.0))
    target = scanners.next_sessions(d, calendar)
    assert target.collect() == [(1, monday)]
    hits = lambda **p: [r["date"] for r in scanners.scan("daily_atr_parabolic_up", None, d, min_multiplier=1.5, **p).collect()]
    assert monday not in hits() and hits(target=target) == [*hits(), monday]
    d = days((10.0, 14.0, 10.0, 11.0))
    hits = lambda **p: [r["date"] for r in scanners.scan("day2_gap", None, d, allday=d, min_gap=0.2, min_retrace=0.2, **p).collect()]
    assert hits() == [] and hits(target=target) == [monday]


def test_headlines_are_whole_lines(spark, tmp_path):
    start = "the same opening of a text " * 5
    texts = [start + "one EN\nshort", start + "two\nshort EN", start + "two"]
    spark.createDataFrame([(i, t, "en", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: dict(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
    assert run("new_headlines") == {1: 2, 2: 1}
    assert run("headline_mentions") == {0: 1, 1: 2, 2: 1}


def test_split_maps(spark):
    good = '{"A": [{"execution_date": "2020-08-31", "historical_adjustment_factor": 0.25, "split_from": 1, "split_to": 4}, {"execution_date": null, "split_from": 1, "split_to": 2}], "B": [], "C": [{"execution_date": "2021-01-04", "split_from": 10, "split_to": 1}]}'
    raw = spark.createDataFrame([(good,), ("no map",), (None,), ("{}",), ('["list"]',)], "value string")
    got = listings.load_splits(raw)
    rows = [("A", datetime.date(2020, 8, 31), 1.0, 4.0, 0.25), ("C", datetime.date(2021, 1, 4), 10.0, 1.0, None)]
    assert sorted(map(tuple, got.collect())) == rows
    assert sorted(map(tuple, listings.load_splits(listings.dump_splits(got)).collect())) == rows
    assert listings.load_splits(raw.limit(0)).isEmpty() and listings.dump_splits(got.limit(0)).isEmpty()


def test_headlines_of_a_local_day(spark):
    at = [datetime.datetime(2024, 1, 10, 4, 59), datetime.datetime(2024, 1, 10, 5), datetime.datetime(2024, 1, 11, 4, 59), datetime.datetime(2024, 1, 11, 5), None]
    day = datetime.date(2024, 1, 10)
    naive = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, published_at timestamp_ntz")
    assert [r["i"] for r in listings.on_day(naive, day).orderBy("i").collect()] == [1, 2]
    assert [r["i"] for r in listings.on_day(naive, day, "UTC").orderBy("i").collect()] == [0, 1]
    zone = spark.conf.get("spark.sql.session.timeZone")
    instants = naive.withColumn("published_at", (naive["published_at"].cast("string")).cast("timestamp"))  # in UTC, the session's zone
    try:
        plan = listings.on_day(instants, day).orderBy("i")
        assert [r["i"] for r in plan.collect()] == [1, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_mentions_in_titles_and_summaries(spark):
    rows = [(0, "ab", "Of Ab today", None), (1, "ab", None, "an aB"), (2, "ab", "a", "b"), (3, "a b", "xa", "by"), (4, None, "ab", "ab"), (5, "ab", None, None)]
    df = spark.createDataFrame(rows, "i int, symbol string, title string, summary string")
    assert [r["i"] for r in listings.mentions(df).orderBy("i").collect()] == [0, 1, 3]
    assert [r["i"] for r in listings.mentions(df.drop("summary")).orderBy("i").collect()] == [0]


def test_mentions_in_full_capitals_equal_their_sql(spark, tmp_path):
    import duckdb

    found = [("Straße", "ss"), ("STRASSE", "ß"), ("eße\nx", "es"), ("ﬁn", "fi"), ("ŉ", "N"), ("ɤ", "\ua7cb"), ("a\nb", None), ("a", "b")]
    found += [(f"x{c}y\nz", capital) for c, capital in queries._CAPITALS.items()]
    spark.createDataFrame([(i, *r, 1) for i, r in enumerate(found)], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("headline_mentions", "headline_summary_mentions"):
        got = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.sql(queries.ORACLES[name]).fetchall())
        assert [r[0] for r in got] == [i for i in range(len(found)) if i not in (6, 7)]
