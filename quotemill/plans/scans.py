"""Queries of scans with bounds, the scan report, vendor bars, news and monitors, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.operators import candles, fundamental, listings, quality, scanners
from quotemill.plans import queries as q
from quotemill.plans.queries import D1, FEATURES, H1, SHIP_FEATURES, TRADES, _FUND, _out, _register
from quotemill.sources import model

YEARS = 24  # from the dates of orders to those of events

_BOUNDS = dict(min_market_cap=150_000, max_market_cap=450_000, min_days_since_ipo=9_000, min_days_from_earnings=1, max_days_from_earnings=60, days_of_week=[0, 1, 2, 3])


def _fundamentals(spark, sf_dir, years: int = YEARS):
    later = lambda df, c="date": df.withColumn(c, F.add_months(c, 12 * years))
    return dict(caps=later(model.market_caps(spark, sf_dir)), earnings=later(model.earnings(spark, sf_dir)), static=model.static(spark, sf_dir))


def _fund_sql(days: str, years: int, cap_null: bool = False, b: dict = _BOUNDS) -> list[str]:
    """``fit``: the days of ``days`` within the bounds."""
    shift = f"INTERVAL {years} YEAR"
    return [
        f"mcap AS (SELECT o_custkey % 100 AS symbol, (o_orderdate::DATE + {shift})::DATE AS date, max(o_totalprice) AS value FROM orders GROUP BY 1, 2)",
        f"earned AS (SELECT DISTINCT o_custkey % 100 AS symbol, (o_orderdate::DATE + {shift})::DATE AS date FROM orders WHERE o_orderpriority = '1-URGENT')",
        "listed AS (SELECT l_suppkey AS symbol, min(l_shipdate)::DATE + l_suppkey::INTEGER AS ipo FROM lineitem GROUP BY l_suppkey)",
        f"known AS (SELECT d.symbol, d.date, c.value AS cap, d.date - e.date AS since FROM (SELECT DISTINCT symbol, date FROM {days}) d ASOF LEFT JOIN mcap c ON d.symbol = c.symbol AND d.date >= c.date ASOF LEFT JOIN earned e ON d.symbol = e.symbol AND d.date >= e.date)",
        f"fit AS (SELECT k.symbol, k.date FROM known k LEFT JOIN listed USING (symbol) WHERE (cap BETWEEN {b['min_market_cap']} AND {b['max_market_cap']}{' OR cap IS NULL' if cap_null else ''}) AND (ipo IS NULL OR ipo > k.date OR k.date - ipo >= {b['min_days_since_ipo']}) AND since BETWEEN {b['min_days_from_earnings']} AND {b['max_days_from_earnings']} AND isodow(k.date) <= 4)",
    ]


def _bounded(name: str, scanner: str, columns: list[str], params: dict, sql: str, *ctes: str, cap_null: bool = False):
    @_register(f"{name}_bounded", f"SELECT {', '.join('x.' + c for c in columns)} FROM ({sql}) x JOIN fit ON x.symbol = fit.symbol AND {'x.ts::DATE' if 'ts' in columns else 'x.date'} = fit.date", *ctes, *_fund_sql("bars", YEARS, cap_null))
    def query(spark, sf_dir):
        found = scanners.scan(scanner, model.bars(spark, sf_dir), model.daily(spark, sf_dir), **params, **_fundamentals(spark, sf_dir), **_BOUNDS, include_null_market_cap=cap_null)
        return _out(found, *columns)


_C = [*FEATURES, q._VOL]
_bounded("scan_atr_gap_down", "atr_gap_down", q._KEYS, q._GAPS, q.GAP_DOWN, *_C)
_bounded("scan_atr_gap_up", "atr_gap_up", q._KEYS, q._GAPS, q._GAP_SQL.format(c="high", w=q._W, p="signal > 0 AND close > open"), *_C, cap_null=True)
_bounded("scan_parabolic_down", "atr_parabolic_down", q._KEYS, q._PAR, q._PAR_SQL.format(s="(open - close)", w=q._W, e="abs(lo - low) < 1e-4"), *_C)
_bounded("scan_parabolic_up", "atr_parabolic_up", q._KEYS, q._PAR, q._PAR_SQL.format(s="(close - open)", w=q._W, e="abs(hi - high) < 1e-4"), *_C)
_bounded("scan_high_range_gap_up", "high_range_gap_up", q._KEYS, q._RANGE, q._RANGE_SQL.format(c="high", w=q._W, p="high > max_high_5d"), *_C)
_bounded("scan_low_range_gap_down", "low_range_gap_down", q._KEYS, q._RANGE, q._RANGE_SQL.format(c="low", w=q._W, p="low < min_low_5d"), *_C)
_bounded("scan_small_cap_up", "small_cap_up", ["symbol", "ts", "gap_high", "triggered_alert"], dict(min_gap=0.2, shifts=[1, 2], changes=[0.5, 0.3], min_price=1.0, max_price=1000.0, min_volume=5), q.ORACLES["scan_small_cap_up"].split("\n")[-1], *_C)

_SHIP_BOUNDS = _BOUNDS | dict(min_days_since_ipo=365)
for _side, _s in (("up", "(prev_day_close - prev_day_open)"), ("down", "(prev_day_open - prev_day_close)")):

    @_register(f"scan_daily_parabolic_{_side}_bounded", f"SELECT x.* FROM ({q._DP_SQL.format(s=_s)}) x JOIN fit USING (symbol, date)", *SHIP_FEATURES, *_fund_sql("ship", 0, b=_SHIP_BOUNDS))
    def _daily_bounded(spark, sf_dir, side=_side):
        found = scanners.scan(f"daily_atr_parabolic_{side}", None, model.shipments(spark, sf_dir), **q._DP, **_fundamentals(spark, sf_dir, 0), **_SHIP_BOUNDS)
        return _out(found, "symbol", "date", "signal")


@_register(
    "scan_day2_gap_bounded", "SELECT x.* FROM (" + q.ORACLES["scan_day2_gap"].split("\n")[-1].replace("f JOIN g USING (symbol, date)", "f JOIN g USING (symbol, date) WHERE f.adv_14 >= 10 AND f.adr_14 >= 0.01") + ") x JOIN fit USING (symbol, date)",
    TRADES, *D1, *q.ALLDAY, *q._features("daily", "daily"), *q._features("allday", "daily", "g"), *_fund_sql("daily", YEARS),
)
def scan_day2_gap_bounded(spark, sf_dir):
    d = model.daily(spark, sf_dir)
    found = scanners.scan("day2_gap", None, d, allday=candles.daily_bars(model.bars(spark, sf_dir)), min_gap=0.05, min_retrace=0.1, min_adv=10, min_adr=0.01, **_fundamentals(spark, sf_dir), **_BOUNDS)
    return _out(found, "symbol", "date", "retrace", "gain")


# ---- the report of a scan

RANGES = (2, 5, 10, 20, 50, 100, 200)
_POS = ", ".join(f"min(low) OVER n{n} AS lo{n}, max(high) OVER n{n} AS hi{n}" for n in RANGES)
_WIN = ", ".join(f"n{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in RANGES)
_STATIC = ["name", "nation", "region", "balance"]


@_register(
    "scan_report_full",
    f"""SELECT g.symbol, g.ts, strftime(g.ts + INTERVAL 1 HOUR, '%H:%M') AS scan_time, s.name, s.nation, s.region, s.balance, (e.date - g.date)::DOUBLE AS days_to_earnings, (p.date - g.date)::DOUBLE * -1 AS days_from_earnings, round(daily_atr_14, 4) AS daily_atr_14,
      round(CASE WHEN g.ts::TIME >= TIME '09:30' THEN (day_open - prev_day_close) / prev_day_close END, 4) AS daily_gap, round(CASE WHEN g.ts::TIME >= TIME '09:30' THEN (day_open - prev_day_close) / daily_atr_14 END, 4) AS daily_atr_gap_14,
      {', '.join(f'round((g.close - lo{n}) / nullif(hi{n} - lo{n}, 0), 4) AS position_in_range_{n}d' for n in RANGES)}
    FROM (SELECT * FROM (SELECT symbol, ts, bars.close, bars.date, row_number() OVER (PARTITION BY symbol, bars.date ORDER BY ts) AS k FROM ({q.GAP_DOWN}) JOIN bars USING (symbol, ts)) WHERE k = 1) g
    JOIN f USING (symbol, date) JOIN ranges r USING (symbol, date) LEFT JOIN stat s USING (symbol) ASOF LEFT JOIN earned e ON g.symbol = e.symbol AND g.date <= e.date ASOF LEFT JOIN earned p ON g.symbol = p.symbol AND g.date >= p.date""".replace("\n", " "),
    *_C, f"ranges AS (SELECT symbol, date, {_POS} FROM f_s WINDOW {_WIN})", *_fund_sql("bars", YEARS),
    "stat AS (SELECT s_suppkey AS symbol, s_name AS name, n_name AS nation, r_name AS region, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
)
def scan_report_full(spark, sf_dir):
    d = model.daily(spark, sf_dir)
    hits = scanners.first_match(scanners.atr_gap_scan(model.bars(spark, sf_dir), d, "down", **q._GAPS))
    names = model.table(spark, sf_dir, "supplier").join(model.table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).join(model.table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    static = names.select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("balance"))
    out = scanners.report(hits, d, static, _fundamentals(spark, sf_dir)["earnings"], "1h", RANGES)
    rounded = ["daily_atr_14", "daily_gap", "daily_atr_gap_14", *[f"position_in_range_{n}d" for n in RANGES]]
    return out.select("symbol", "ts", "scan_time", *_STATIC, *[F.col(c).cast("double").alias(c) for c in ("days_to_earnings", "days_from_earnings")], *[F.round(c, 4).alias(c) for c in rounded])


# ---- vendor bars, news, monitors


@_register(
    "normalise_bars",
    "SELECT symbol, b AS ts, open, high, low, close, volume FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS b, row_number() OVER (PARTITION BY symbol, time_bucket(INTERVAL 15 MINUTE, ts) ORDER BY ts) AS k FROM (SELECT user_id % 10 AS symbol, date_trunc('minute', ts) AS ts, max(value) AS open, max(value) + 1 AS high, max(value) - 1 AS low, max(value) AS close, count(*)::DOUBLE AS volume FROM events WHERE event_id % 11 > 0 GROUP BY 1, 2)) WHERE k = 1",
)
def normalise_bars(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    minute = F.unix_millis(F.date_trunc("minute", F.col("ts")).cast("timestamp")).alias("t")
    raw = e.groupBy((F.col("user_id") % 10).alias("symbol"), minute, (F.col("event_id") % 11 == 0).alias("void")).agg(F.max("value").alias("o"), F.count("*").alias("v"))
    raw = raw.withColumn("o", F.when(~F.col("void"), F.col("o")))
    return candles.normalise_bars(raw.select("symbol", "t", "o", (F.col("o") + 1).alias("h"), (F.col("o") - 1).alias("l"), F.col("o").alias("c"), "v"), "15min")


_NEWS = "news AS (SELECT doc_id % 10 AS symbol, source, text AS title, n_chars % 101 AS score, TIMESTAMP '2024-01-01' + (doc_id % 720) * INTERVAL 1 HOUR + INTERVAL 30 MINUTE AS published_at, doc_id FROM documents)"


def _news(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents")
    at = F.lit("2024-01-01 00:30").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("doc_id") % 720).cast("int"))
    return d.select((F.col("doc_id") % 10).alias("symbol"), "source", F.col("text").alias("title"), (F.col("n_chars") % 101).alias("score"), at.alias("published_at"), "doc_id")


@_register("news_as_of", "SELECT b.symbol, b.ts, (SELECT max(score) FROM news n WHERE n.symbol = b.symbol AND n.published_at <= b.ts AND n.published_at::DATE = b.date)::DOUBLE AS news_confidence FROM bars b", *H1, _NEWS)
def news_as_of(spark, sf_dir):
    return listings.news_as_of(model.bars(spark, sf_dir), _news(spark, sf_dir)).select("symbol", "ts", F.col("news_confidence").cast("double").alias("news_confidence"))


@_register("unseen_today", "SELECT doc_id FROM news a WHERE NOT EXISTS (SELECT 1 FROM news b WHERE b.doc_id % 3 = 0 AND a.symbol = b.symbol AND a.title = b.title AND a.published_at::DATE = b.published_at::DATE)", _NEWS)
def unseen_today(spark, sf_dir):
    n = _news(spark, sf_dir)
    return listings.unseen_today(n, n.filter("doc_id % 3 = 0")).select("doc_id")


_SOURCES = ["news", "web", "forum"]


@_register(
    "round_robin_by_sources", f"SELECT doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY turn, coalesce(list_position({_SOURCES!r}, source), 4), source) AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol, source ORDER BY published_at, title) AS turn FROM (SELECT * REPLACE (TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS published_at) FROM news))) WHERE place <= 10", _NEWS
)
def round_robin_by_sources(spark, sf_dir):
    n = _news(spark, sf_dir).withColumn("published_at", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id").cast("int")))
    return fundamental.round_robin_by(n, _SOURCES, 10).select("doc_id", F.col("place").cast("long").alias("place"))


@_register(
    "scoring_outcomes",
    "SELECT symbol, CASE WHEN symbol % 5 = 0 THEN 'fail_open' WHEN n = 0 THEN 'empty' ELSE 'scored' END AS outcome, n AS n_scores FROM (SELECT doc_id // 4 AS symbol, count(*) FILTER (n_chars % 3 = 0) AS n FROM documents GROUP BY 1)",
)
def scoring_outcomes(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents").withColumn("symbol", F.floor(F.col("doc_id") / 4))
    rounds = d.select("symbol").distinct().withColumn("response", F.when(F.col("symbol") % 5 != 0, "[]"))
    return listings.outcomes(rounds, d.filter("n_chars % 3 = 0")).select("symbol", "outcome", F.col("n_scores").cast("long").alias("n_scores"))


@_register("scored_headlines", "SELECT doc_id, n_chars % 101 AS confidence FROM documents WHERE doc_id % 2 = 0 AND n_chars % 101 > 50")
def scored_headlines(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("symbol"), F.floor(F.col("doc_id") / 50).alias("idx"), (F.col("n_chars") % 101).alias("confidence"), "doc_id")
    return listings.scored_headlines(d.filter("doc_id % 2 = 0"), d.drop("confidence")).select("doc_id", "confidence")


_ARRIVED = "arrivals AS (SELECT date_trunc('minute', ts) AS ts, date_trunc('minute', ts) + INTERVAL 60 SECOND + (event_id % 97) * INTERVAL 2 SECOND AS arrived FROM events)"


def _arrivals(spark, sf_dir):
    e = model.table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz"))
    return e.select("ts", (F.col("ts") + F.make_dt_interval(secs=(60 + F.col("event_id") % 97 * 2).cast("int"))).alias("arrived"))


@_register(
    "arrival_spread",
    "SELECT ts, date_diff('second', ts, min(arrived)) - 60 AS delay_s, date_diff('second', min(arrived), max(arrived)) AS spread_s FROM arrivals a WHERE NOT EXISTS (SELECT 1 FROM arrivals b WHERE b.ts > a.ts AND b.ts::DATE = a.ts::DATE AND b.arrived <= a.arrived) GROUP BY ts", _ARRIVED,
)
def arrival_spread(spark, sf_dir):
    return quality.arrival_spread(_arrivals(spark, sf_dir), 60)


@_register("delivery_latency", "SELECT ts, max(s) AS last_s, count(*) AS n, quantile_cont(s, 0.5)::DOUBLE AS median_s, round(quantile_cont(s, 0.95), 6)::DOUBLE AS p95_s FROM (SELECT ts, date_diff('second', ts, arrived) - 60 AS s FROM arrivals) GROUP BY ts", _ARRIVED)
def delivery_latency(spark, sf_dir):
    return quality.delivery_latency(_arrivals(spark, sf_dir).withColumnRenamed("arrived", "processed")).withColumn("p95_s", F.round("p95_s", 6))
