"""Queries of named indicators, sessions, source checks, subscriptions, and scans and bars that run as streams, with their SQL."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from quotemill.functions.time import covering_range
from quotemill.operators import candles, listings, quality, registry, scanners
from quotemill.operators.indicators import Daily
from quotemill.plans import queries as q
from quotemill.plans.queries import D1, FEATURES, H1, ORACLES, SHIPMENTS, TRADES, _CAL, _STREAM, _VOL, _ewm, _features, _out, _register
from quotemill.sources import model, storage, store
from quotemill.streaming import buckets, live, running
from quotemill.streaming import candles as feed
from quotemill.streaming import indicators as live_forms

# ---- indicators by name


@_register(
    "indicators_by_name",
    "SELECT symbol, ts, round(total_volume, 6) AS total_volume, round(low_shift_2, 6) AS low_shift_2, round(prev_day_close, 6) AS prev_day_close, round(adv_14, 6) AS adv_14 FROM (SELECT symbol, ts, date, (sum(volume) OVER d)::DOUBLE AS total_volume, lag(low, 2) OVER (PARTITION BY symbol, date ORDER BY ts) AS low_shift_2 FROM bars WINDOW d AS (PARTITION BY symbol, date ORDER BY ts ROWS UNBOUNDED PRECEDING)) LEFT JOIN f USING (symbol, date)",
    *FEATURES,
)
def indicators_by_name(spark, sf_dir):
    wanted = [("cumulative", dict(col="volume", op="sum")), ("shift", dict(col="low", n=2)), ("prev_day", dict(col="close")), ("adv", dict(period=14))]
    out = registry.indicate(model.bars(spark, sf_dir), registry.Tables(daily=model.daily(spark, sf_dir)), wanted)
    return _out(out.withColumn("total_volume", F.col("total_volume").cast("double")), "symbol", "ts", "total_volume", "low_shift_2", "prev_day_close", "adv_14")


@_register(
    "prev_day_calendar", "SELECT b.symbol, b.ts, round(d.close, 6) AS prev_2day_close FROM bars b LEFT JOIN back s ON s.date = b.date LEFT JOIN daily d ON d.symbol = b.symbol AND d.date = s.session",
    *H1, *D1, *_CAL, "back AS (SELECT x.date, (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM calendar c WHERE is_session AND c.date < x.date) WHERE k = 2) AS session FROM (SELECT DISTINCT date FROM bars) x)",
)
def prev_day_calendar(spark, sf_dir):
    tables = registry.Tables(daily=model.daily(spark, sf_dir), calendar=q._calendar(spark))
    return _out(registry.indicate(model.bars(spark, sf_dir), tables, [("prev_day", dict(col="close", n=2, mode="calendar"))]), "symbol", "ts", "prev_2day_close")


@_register("daily_anchored", "SELECT b.symbol, b.ts, round(daily_atr_14, 6) AS daily_atr_14, round(adv_14, 6) AS adv_14 FROM bars b LEFT JOIN g USING (symbol, date)", *H1, *D1, "late AS (SELECT * FROM daily WHERE date >= DATE '2024-01-10')", *_features("late", "bars", "g"))
def daily_anchored(spark, sf_dir):
    d = Daily(model.daily(spark, sf_dir), model.bars(spark, sf_dir), datetime.date(2024, 1, 10))
    return _out(d.atr(14).adv(14).join(), "symbol", "ts", "daily_atr_14", "adv_14")


@_register(
    "atr_5h", f"SELECT symbol, ts, round({_ewm('l', 14)}, 6) AS atr_14_5h FROM y", TRADES, q._bars("h", "date_trunc('day', ts) + INTERVAL '5 hours' * (hour(ts) // 5)"),
    "x AS (SELECT symbol, b AS ts, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM h WINDOW w AS (PARTITION BY symbol ORDER BY b))",
    "y AS (SELECT symbol, ts, list(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM x)",
)
def atr_5h(spark, sf_dir):
    return _out(registry.indicate(model.bars(spark, sf_dir, "5h"), registry.Tables(), [("atr", dict(period=14, freq="5h"))]), "symbol", "ts", "atr_14_5h")


# ---- sessions and partitions


@_register("market_open", "SELECT c.is_session AND hour(ts) BETWEEN 4 AND 19 AS is_open, count(*) AS n FROM events e JOIN calendar c ON c.date = e.ts::DATE GROUP BY 1", *_CAL)
def market_open(spark, sf_dir):
    return candles.market_open(model.trades(spark, sf_dir), q._calendar(spark)).groupBy("is_open").agg(F.count("*").alias("n"))


@_register(
    "next_session_time",
    "SELECT next_at, count(*) AS n FROM (SELECT CASE WHEN c.is_session AND e.ts::TIME < TIME '09:30' THEN c.date ELSE (SELECT min(date) FROM calendar n WHERE n.is_session AND n.date > c.date) END::TIMESTAMP + INTERVAL '9 hours 30 minutes' AS next_at FROM events e JOIN calendar c ON c.date = e.ts::DATE) GROUP BY 1", *_CAL,
)
def next_session_time(spark, sf_dir):
    return candles.next_time(model.trades(spark, sf_dir), q._calendar(spark), "09:30").groupBy("next_at").agg(F.count("*").alias("n"))


@_register(
    "covering_ranges",
    "SELECT symbol, date_trunc('week', a)::DATE AS week_first, (date_trunc('week', b) + INTERVAL 6 DAY)::DATE AS week_last, date_trunc('month', a)::DATE AS month_first, last_day(b) AS month_last, make_date(year(a), 1, 1) AS year_first, make_date(year(b), 12, 31) AS year_last FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM ship GROUP BY 1)", *SHIPMENTS,
)
def covering_ranges(spark, sf_dir):
    ends = model.shipments(spark, sf_dir).groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    parts = [("week", "1min"), ("month", "1h"), ("year", "1d")]
    ranges = [c.alias(f"{n}_{e}") for n, freq in parts for e, c in zip(("first", "last"), covering_range(F.col("a"), F.col("b"), freq), strict=True)]
    return ends.select("symbol", *ranges)


@_register("active_by_exchange", "SELECT DISTINCT s_suppkey AS symbol FROM supplier WHERE s_acctbal > 0 AND s_nationkey = 3")
def active_by_exchange(spark, sf_dir):
    s = model.table(spark, sf_dir, "supplier")
    return listings.active_by_exchange(s.select(F.col("s_suppkey").alias("symbol"), (F.col("s_acctbal") > 0).alias("active"), F.col("s_nationkey").cast("string").alias("exchange")), "3")


# ---- audits and comparisons


@_register(
    "dq_source_issues",
    "SELECT user_id AS symbol, 'MISSING_REALTIME_DATA' AS issue_type FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT symbol FROM s) UNION ALL SELECT user_id, 'EMPTY_SOURCE_DATA' FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT symbol FROM src WHERE symbol NOT IN (SELECT symbol FROM s)) AND user_id NOT IN (SELECT src.symbol FROM src JOIN (SELECT symbol, min(ts) AS a, max(ts) AS z FROM s GROUP BY 1) e ON e.symbol = src.symbol AND src.ts BETWEEN a AND z)",
    *_STREAM, "src AS (SELECT * FROM bars WHERE symbol % 3 > 0)",
)
def dq_source_issues(spark, sf_dir):
    wanted = model.table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol")).distinct()
    return quality.source_issues(model.streamed(spark, sf_dir), model.bars(spark, sf_dir).filter("symbol % 3 > 0"), wanted)


@_register("dq_duplicate_times", "SELECT symbol, ts, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) > 1", *_STREAM)
def dq_duplicate_times(spark, sf_dir):
    return quality.duplicate_times(model.streamed(spark, sf_dir))


@_register(
    "dq_issue_details", "SELECT symbol, issue_type, ts, position FROM (SELECT symbol, ts, 'DUPLICATE' AS issue_type, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS position FROM (SELECT symbol, ts FROM s GROUP BY 1, 2 HAVING count(*) > 1)) WHERE position <= 20", *_STREAM,
)
def dq_issue_details(spark, sf_dir):
    rows = quality.duplicate_times(model.streamed(spark, sf_dir)).select("symbol", "ts", F.lit("DUPLICATE").alias("issue_type"))
    return quality.issue_details(rows).select("symbol", "issue_type", "ts", F.col("position").cast("long").alias("position"))


def _scores(spark, sf_dir):
    s = q._scored_lines(spark, sf_dir).filter("symbol IS NOT NULL AND title IS NOT NULL")
    return s, s.withColumn("score", F.col("again"))


_KEPT = "k AS (SELECT symbol, title, max(score) AS o, max(again) AS n FROM scored WHERE symbol IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2)"


@_register("score_changes", "SELECT symbol, md5(title) AS title, o AS old_score, n AS new_score, CASE WHEN o > 50 THEN 'only_old' ELSE 'only_new' END AS change FROM k WHERE (o > 50) <> (n > 50)", q._LINES, _KEPT)
def score_changes(spark, sf_dir):
    return listings.score_changes(*_scores(spark, sf_dir)).withColumn("title", F.md5("title"))


@_register(
    "score_totals", "SELECT (count(*) FILTER (o > 50))::BIGINT AS old_kept, (count(*) FILTER (n > 50))::BIGINT AS new_kept, (count(*) FILTER ((o > 50) <> (n > 50)))::BIGINT AS symmetric_difference, count(DISTINCT CASE WHEN (o > 50) <> (n > 50) THEN symbol END) AS symbols_changed FROM k", q._LINES, _KEPT,
)
def score_totals(spark, sf_dir):
    return listings.score_totals(*_scores(spark, sf_dir))


# ---- feeds and subscriptions


@_register(
    "candle_events", "SELECT user_id AS symbol, unit, count(*) AS n, sum(epoch_ms(date_trunc('second', ts)) // 1000)::BIGINT AS at FROM (SELECT *, CASE event_type WHEN 'click' THEN 's' WHEN 'view' THEN 'min' END AS unit FROM events) WHERE unit IS NOT NULL AND event_id % 7 > 0 GROUP BY 1, 2",
)
def candle_events(spark, sf_dir):
    e, price = model.table(spark, sf_dir, "events"), F.col("value")
    kind = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "AM").otherwise(F.col("event_type"))
    start = F.when(F.col("event_id") % 7 > 0, F.unix_timestamp("ts") * 1000)
    raw = e.select(F.col("user_id").alias("symbol"), start.alias("start_ms"), kind.alias("event_type"), *[price.alias(c) for c in candles.OHLC], F.lit(1).alias("volume"))
    return feed.candle_events(raw).groupBy("symbol", "unit").agg(F.count("*").alias("n"), F.sum(F.unix_timestamp("ts")).alias("at"))


_CHANGES = "c AS (SELECT user_id, event_id % 10 AS symbol, CASE WHEN event_id % 2 = 0 THEN 's' ELSE 'min' END AS unit, ts, event_id AS seq, (event_type <> 'error')::INT AS a FROM events)"


@_register(
    "subscription_triggers", "SELECT symbol, unit, seq, CASE WHEN step = 1 THEN 'first' ELSE 'last' END AS trigger FROM n WHERE (n = 1 AND step = 1) OR n = 0",
    _CHANGES, "m AS (SELECT *, a - coalesce(lag(a) OVER (PARTITION BY user_id, symbol, unit ORDER BY ts, seq), 0) AS step FROM c)",
    "n AS (SELECT *, sum(step) OVER (PARTITION BY symbol, unit ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS n FROM m WHERE step <> 0)",
)
def subscription_triggers(spark, sf_dir):
    return live.subscription_triggers(_subscription_changes(spark, sf_dir)).select("symbol", "unit", "seq", "trigger")


def _subscription_changes(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    unit = F.when(F.col("event_id") % 2 == 0, "s").otherwise("min").alias("unit")
    return e.select(F.col("user_id").alias("subscriber"), (F.col("event_id") % 10).alias("symbol"), unit, "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("add"))


@_register(
    "subscribed_values", "SELECT c_custkey AS subscription_id, symbol, ts, CASE WHEN c_custkey % 2 = 0 THEN round(total, 6) END AS total_volume, round(low, 6) AS low FROM customer JOIN (SELECT symbol, ts, low, (sum(volume) OVER (PARTITION BY symbol, date ORDER BY ts ROWS UNBOUNDED PRECEDING))::DOUBLE AS total FROM bars) ON symbol = c_custkey % 10 WHERE c_nationkey = 3", *H1,
)
def subscribed_values(spark, sf_dir):
    subscriptions = _subscriptions(spark, sf_dir)
    bars = registry.indicate(model.bars(spark, sf_dir), registry.Tables(), [("cumulative", dict(col="volume", op="sum"))]).withColumn("freq", F.lit("1h"))
    out = live.subscribed_values(bars, subscriptions)
    return _out(out.select("subscription_id", "symbol", "ts", F.col("values")["total_volume"].alias("total_volume"), F.col("values")["low"].alias("low")), "subscription_id", "symbol", "ts", "total_volume", "low")


def _subscriptions(spark, sf_dir):
    c = model.table(spark, sf_dir, "customer").filter("c_nationkey = 3")
    wanted = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("total_volume"), F.lit("low"))).otherwise(F.array(F.lit("low")))
    return c.select(F.col("c_custkey").alias("subscription_id"), (F.col("c_custkey") % 10).alias("symbol"), F.lit("1h").alias("freq"), wanted.alias("indicators"))


# ---- the same rules in a stream


def _stream_scan(name: str, columns: list[str], features, day: dict, want: running.Running, rule: dict, sql: str, *ctes: str):
    @_register(f"stream_scan_{name}", f"SELECT *, strftime(ts + INTERVAL 1 HOUR, '%H:%M') AS scan_time FROM ({sql})", *(ctes or (*FEATURES, _VOL)))
    def query(spark, sf_dir):
        bars = model.bars(spark, sf_dir)
        days = scanners.surviving_days(features(Daily(model.daily(spark, sf_dir), bars)), **day)
        live_bars = running.running(running.replay(bars.drop("date")), want)
        found = running.to_table(running.matches(name, live_bars, days, "1h", **rule))
        return _out(found.withColumn("ts", F.col("ts").cast("timestamp_ntz")), *columns, "scan_time")


def _sql(name: str) -> str:
    """The batch scan's SQL; a daily range of zero gives no signal."""
    return ORACLES[name].rsplit("\n", 1)[-1].replace("/ daily_atr_14", "/ nullif(daily_atr_14, 0)")


_BASE, _DAY = running.Running(), dict(min_adv=10, min_adr=0.01)
_GAP = {k: v for k, v in q._GAPS.items() if k not in _DAY}
_PAR = {k: v for k, v in q._PAR.items() if k not in _DAY}
_RANGE = {k: v for k, v in q._RANGE.items() if k not in _DAY}
_atr = lambda d: d.adv(14).adr(14).prev_day("close").atr(14)
for _side in ("down", "up"):
    _stream_scan(f"atr_gap_{_side}", q._KEYS, _atr, _DAY, _BASE, _GAP, _sql(f"scan_atr_gap_{_side}"))
    _move, _edge = ("(open - close)", "abs(lo - low) < 1e-4") if _side == "down" else ("(close - open)", "abs(hi - high) < 1e-4")
    _stream_scan(
        f"atr_parabolic_{_side}", q._KEYS, _atr, _DAY, _BASE, _PAR,
        f"SELECT symbol, ts, round(signal, 6) AS signal FROM (SELECT *, {_move} / nullif(daily_atr_14, 0) AS signal FROM v JOIN f USING (symbol, date)) WHERE adv_14 >= 10 AND adr_14 >= 0.01 AND {q._W} AND {_edge} AND signal > 0.2 AND cv >= 5",
    )
for _name, _op, _col in (("high_range_gap_up", "max", "high"), ("low_range_gap_down", "min", "low")):
    _stream_scan(_name, q._KEYS, lambda d, op=_op, col=_col: _atr(d).rolling(5, op, col), dict(min_adv=10), _BASE, _RANGE, _sql(f"scan_{_name}"))
_stream_scan(
    "small_cap_up", ["symbol", "ts", "gap_high", "triggered_alert"], lambda d: d.prev_day("close"), {}, running.Running(shifts=(("low", 1), ("low", 2))),
    dict(min_gap=0.2, shifts=[1, 2], changes=[0.5, 0.3], min_price=1.0, max_price=1000.0, min_volume=5), _sql("scan_small_cap_up"),
)


@_register(
    "stream_indicators",
    f"SELECT symbol, ts, round(cv, 6) AS cumulative_daily_volume, round(pv, 6) AS premarket_total_volume, round(l2, 6) AS low_shift_2, round({_ewm('l', 14)}, 6) AS atr_14 FROM (SELECT symbol, ts, cv::DOUBLE AS cv, pv::DOUBLE AS pv, l2 FROM v) JOIN y USING (symbol, ts)",
    *H1, _VOL, "x AS (SELECT symbol, ts, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))",
    "y AS (SELECT symbol, ts, list(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM x)",
)
def stream_indicators(spark, sf_dir):
    want = running.Running(atr=14, shifts=(("low", 2),))
    out = running.to_table(running.running(running.replay(model.bars(spark, sf_dir).drop("date")), want))
    return _out(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "symbol", "ts", "cumulative_daily_volume", "premarket_total_volume", "low_shift_2", "atr_14")


@_register(
    "stream_live_forms",
    "SELECT symbol, ts, round(cv::DOUBLE, 6) AS cumulative_daily_volume, round((close - prev_day_close) / prev_day_close, 6) AS gap_close, round((low - prev_day_close) / nullif(daily_atr_14, 0), 6) AS atr_gap_low_14, round((close - min_low_5d) / nullif(max_high_5d - min_low_5d, 0), 6) AS position_in_range_5d, round(adr_14, 6) AS adr_14, round(prev_day_open, 6) AS prev_day_open FROM v LEFT JOIN f USING (symbol, date)",
    *FEATURES, _VOL,
)
def stream_live_forms(spark, sf_dir):
    bars = model.bars(spark, sf_dir)
    wanted = [("cumulative_daily_volume", {}), ("gap", dict(col="close")), ("atr_gap", dict(col="low", period=14)), ("position_in_range", dict(n=5)), ("adr", dict(period=14)), ("prev_day", dict(col="open"))]
    out = running.to_table(live_forms.live_indicators(running.replay(bars.drop("date")), wanted, registry.Tables(model.daily(spark, sf_dir)), bars.select("symbol", "date").distinct()))
    names = ["cumulative_daily_volume", "gap_close", "atr_gap_low_14", "position_in_range_5d", "adr_14", "prev_day_open"]
    return _out(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "symbol", "ts", *names)


@_register(
    "stream_warm_start", f"SELECT symbol, ts, round({_ewm('l', 14)}, 6) AS atr_14, round(l2, 6) AS low_shift_2, round(cv::DOUBLE, 6) AS cumulative_daily_volume FROM y JOIN v USING (symbol, ts) WHERE ts >= TIMESTAMP '2024-01-10 13:00'",
    *H1, _VOL, "x AS (SELECT symbol, ts, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))",
    "y AS (SELECT symbol, ts, list(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM x)",
)
def stream_warm_start(spark, sf_dir):
    """A stream that begins within a day and goes on from the state of all bars before it."""
    bars, cut = model.bars(spark, sf_dir).drop("date"), F.lit("2024-01-10 13:00:00").cast("timestamp_ntz")
    live_bars = running.running(running.replay(bars.filter(F.col("ts") >= cut)), running.Running(atr=14, shifts=(("low", 2),)), bars.filter(F.col("ts") < cut))
    return _out(running.to_table(live_bars).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "symbol", "ts", "atr_14", "low_shift_2", "cumulative_daily_volume")


@_register("stream_subscription_triggers", ORACLES["subscription_triggers"].split("\n")[-1], _CHANGES, "m AS (SELECT *, a - coalesce(lag(a) OVER (PARTITION BY user_id, symbol, unit ORDER BY ts, seq), 0) AS step FROM c)", "n AS (SELECT *, sum(step) OVER (PARTITION BY symbol, unit ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS n FROM m WHERE step <> 0)")
def stream_subscription_triggers(spark, sf_dir):
    return running.to_table(live.live_triggers(running.replay(_subscription_changes(spark, sf_dir)))).select("symbol", "unit", "seq", "trigger")


@_register("stream_unseen_headlines", "SELECT DISTINCT symbol, md5(title) AS title, published_at::DATE AS date FROM head", q._HEAD)
def stream_unseen_headlines(spark, sf_dir):
    heads = running.replay(model.headlines(spark, sf_dir), at="published_at")
    return running.to_table(live.unseen_stream(heads)).select("symbol", F.md5(F.col("title").cast("binary")).alias("title"), F.to_date("published_at").alias("date"))


_PROCESSED = "p AS (SELECT date_trunc('hour', ts) AS hour, epoch(date_trunc('second', ts))::BIGINT + event_id % 50 - epoch(date_trunc('hour', ts))::BIGINT - 3600 AS late FROM events)"


@_register("stream_delivery_latency", "SELECT hour AS ts, max(late) AS last_s, count(*) AS n FROM p WHERE hour < (SELECT max(hour) FROM p) GROUP BY 1", _PROCESSED)
def stream_delivery_latency(spark, sf_dir):
    """Hours are given out once the watermark has passed them: all but the newest one."""
    e = model.table(spark, sf_dir, "events")
    done = F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")) + F.col("event_id") % 50)
    rows = e.select(F.date_trunc("hour", "ts").cast("timestamp").alias("ts"), done.alias("processed"))
    out = running.to_table(live.delivery_latency_stream(running.replay(rows), 3600))
    return out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "last_s", "n")


@_register("subscribed_sets", ORACLES["subscribed_values"].split("\n")[-1], *H1)
def subscribed_sets(spark, sf_dir):
    """As ``subscribed_values``; what no subscription of a set asks for is not computed for it."""
    known = {"total_volume": ("cumulative", dict(col="volume", op="sum"))}

    def compute(bars, freq, names):
        return registry.indicate(bars, registry.Tables(), [known[n] for n in names if n in known])

    out = live.subscribed_indicators({"1h": model.bars(spark, sf_dir)}, _subscriptions(spark, sf_dir), compute)
    return _out(out.select("subscription_id", "symbol", "ts", F.col("values")["total_volume"].alias("total_volume"), F.col("values")["low"].alias("low")), "subscription_id", "symbol", "ts", "total_volume", "low")


@_register(
    "stream_complete_bars",
    "SELECT symbol, b AS ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume::DOUBLE AS volume FROM x SEMI JOIN (SELECT symbol AS s, b AS bb FROM x QUALIFY b < max(b) OVER (PARTITION BY symbol) UNION ALL SELECT symbol, b FROM l) ON s = symbol AND bb = b",
    TRADES, q._bars("x", "date_trunc('day', ts) + INTERVAL '5 hours' * (hour(ts) // 5)"),
    "l AS (SELECT DISTINCT symbol, date_trunc('day', ts) + INTERVAL '5 hours' * (hour(ts) // 5) AS b FROM trades WHERE hour(ts) % 5 = 4)",
)
def stream_complete_bars(spark, sf_dir):
    """5h bars with their last hour or the first one of a later bucket; the newest open bucket of a symbol is not out yet."""
    out = running.to_table(buckets.complete_bars(running.replay(model.bars(spark, sf_dir).drop("date")), "5h", "1h"), {"once": True})
    return _out(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "symbol", "ts", *candles.OHLC, "volume")


# ---- storage


def _folder(spark) -> str:
    return f"{storage.shared_folder(spark)}/store-{uuid.uuid4().hex}"


_WEEKS = "w AS (SELECT symbol, strftime(date_trunc('week', ts), '%Y-%m-%d') AS key, date_trunc('week', ts)::DATE + 6 AS last, ts, open, high, low, close, volume FROM (SELECT symbol, b AS ts, open, high, low, close, volume FROM m))"


@_register(
    "store_manifest", "SELECT symbol, key, count(*) AS n, CASE WHEN last >= DATE '2024-01-20' THEN DATE '2024-01-21' END AS expires FROM w GROUP BY ALL",
    TRADES, q._bars("m", "time_bucket(INTERVAL '15 minutes', ts)"), _WEEKS,
)
def store_manifest(spark, sf_dir):
    """The manifest of 15min bars after a refresh, and a second one that finds nothing but the newest weeks to do."""
    s = store.BarStore(spark, _folder(spark), "15min")
    bars, today = model.bars(spark, sf_dir, "15min").drop("date"), datetime.date(2024, 1, 20)
    s.refresh(bars, today)
    return s.refresh(bars, today).select("symbol", "key", "n", "expires")


@_register(
    "store_bars", "SELECT symbol, key, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume + CASE WHEN strftime(date_trunc('week', mx), '%Y-%m-%d') = key THEN 1 ELSE 0 END AS volume FROM w JOIN (SELECT symbol, max(ts) AS mx FROM w GROUP BY 1) USING (symbol)",
    TRADES, q._bars("m", "time_bucket(INTERVAL '15 minutes', ts)"), _WEEKS,
)
def store_bars(spark, sf_dir):
    """The bars that count after a second refresh from changed base bars: weeks that are closed stay as they were."""
    s = store.BarStore(spark, _folder(spark), "15min", 64)
    bars = model.bars(spark, sf_dir, "15min").drop("date")
    s.refresh(bars, datetime.date(2030, 1, 1))
    s.refresh(bars.withColumn("volume", F.col("volume") + 1), datetime.date(2030, 1, 1))
    return _out(s.read(), "symbol", "key", "ts", *candles.OHLC, "volume")


@_register("stream_sink", "SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars", *H1)
def stream_sink(spark, sf_dir):
    """Bars that a stream wrote, after one of its batches was tried again and half of the days were compacted."""
    path, bars = _folder(spark), model.bars(spark, sf_dir).drop("date")
    schema = "symbol long, ts timestamp_ntz, open double, high double, low double, close double, volume long"
    stream = running.replay(bars).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("freq", F.lit("1h"))
    store.write_once(stream, path, f"{path}/checkpoint", {"availableNow": True}).awaitTermination()
    store.write_batch(spark.read.schema(f"{schema}, freq string, date date, batch long").parquet(f"{path}/rows").filter("batch = 2").drop("date", "batch"), path, 2)
    store.compact(spark, path, schema, datetime.date(2024, 1, 15))
    store.drop_packed(spark, path, schema)
    return _out(store.read_sink(spark, path, schema), "symbol", "ts", *candles.OHLC, "volume")
