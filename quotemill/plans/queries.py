"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.time import partition_key, session
from quotemill.functions.values import human_number
from quotemill.operators import candles, fundamental, indicators, listings, parsing, quality, scanners
from quotemill.operators.indicators import Daily
from quotemill.sources import model
from quotemill.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str, *ctes: str):
    ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql

    def wrap(f):
        QUERIES[name] = f
        return f

    return wrap


def _out(df: DataFrame, *cols: str) -> DataFrame:
    """The columns asked for, doubles rounded to 6 places."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in cols])


TRADES = "trades AS (SELECT user_id % 10 AS symbol, ts, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS size FROM events)"
_AGG = "arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(size)::BIGINT AS volume"


def _bars(name: str, bucket: str, where: str = "true") -> str:
    return f"{name} AS (SELECT symbol, {bucket} AS b, {_AGG} FROM trades WHERE {where} GROUP BY 1, 2)"


H1 = [TRADES, _bars("h", "date_trunc('hour', ts)"), "bars AS (SELECT symbol, b AS ts, b::DATE AS date, open, high, low, close, volume FROM h)"]
D1 = [_bars("r", "ts::DATE", "ts::TIME >= TIME '09:30' AND ts::TIME < TIME '16:00'"), "daily AS (SELECT symbol, b AS date, open, high, low, close, volume FROM r)"]
ALLDAY = [_bars("a", "ts::DATE"), "allday AS (SELECT symbol, b AS date, open, high, low, close, volume FROM a)"]
SHIPMENTS = [
    "l AS (SELECT l_suppkey AS symbol, l_shipdate::DATE AS date, l_extendedprice / l_quantity AS price, l_quantity AS size, (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem)",
    "ship AS (SELECT symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(size) AS volume FROM l GROUP BY 1, 2)",
]


def _ewm(values: str, period: int) -> str:
    q = 1 - 1 / period
    return f"list_sum(list_transform(range(len({values})), lambda k: coalesce({values}[k + 1], 0) * pow({q!r}, len({values}) - 1 - k))) / nullif(list_sum(list_transform(range(len({values})), lambda k: CASE WHEN {values}[k + 1] IS NULL THEN 0 ELSE pow({q!r}, len({values}) - 1 - k) END)), 0)"


def _features(daily: str, target: str, name: str = "f") -> list[str]:
    """Daily features on the spine of ``daily`` and the last date of ``target``."""
    s = f"{name}_s"
    return [
        f"{s} AS (SELECT symbol, date, open, high, low, close, volume FROM {daily} UNION ALL SELECT symbol, d, NULL, NULL, NULL, NULL, NULL FROM (SELECT symbol, max(date) AS d FROM {target} GROUP BY 1) t WHERE NOT EXISTS (SELECT 1 FROM {daily} x WHERE x.symbol = t.symbol AND x.date = t.d))",
        f"{name}_t AS (SELECT *, CASE WHEN high IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM {s} WINDOW w AS (PARTITION BY symbol ORDER BY date))",
        f"{name}_l AS (SELECT symbol, date, list(tr) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS l FROM {name}_t)",
        f"{name}_e AS (SELECT symbol, date, {_ewm('l', 14)} AS e FROM {name}_l)",
        f"""{name} AS (SELECT symbol, date, open AS day_open, lag(close) OVER w AS prev_day_close, lag(open) OVER w AS prev_day_open, lag(high) OVER w AS prev_day_high, lag(close, 2) OVER w AS prev_2day_close,
          avg(volume) OVER p AS adv_14, avg((high - low) / nullif(close, 0)) OVER p AS adr_14, lag(e) OVER w AS daily_atr_14,
          min(low) OVER n AS min_low_5d, max(high) OVER n AS max_high_5d, sum(volume) OVER n AS sum_volume_5d
          FROM {s} JOIN {name}_e USING (symbol, date) WINDOW w AS (PARTITION BY symbol ORDER BY date), p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""",
    ]


FEATURES = [*H1, *D1, *_features("daily", "bars")]
SHIP_FEATURES = [*SHIPMENTS, *_features("ship", "ship")]

# ---- candles


def _resample(name: str, freq: str, sql_bucket: str, *extra: str):
    @_register(name, f"SELECT symbol, b AS ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM x", TRADES, _bars("x", sql_bucket))
    def query(spark, sf_dir):
        b = model.bars(spark, sf_dir, "15min").drop("date") if freq != "15min" else None
        out = candles.trades_to_candles(model.trades(spark, sf_dir), freq) if b is None else candles.resample(b, freq)
        return _out(out, "symbol", "ts", "open", "high", "low", "close", "volume")


_resample("trades_to_candles", "15min", "time_bucket(INTERVAL '15 minutes', ts)")
_resample("resample_1h", "1h", "date_trunc('hour', ts)")
_resample("resample_1d", "1d", "date_trunc('day', ts)")
_resample("resample_5h", "5h", "date_trunc('day', ts) + INTERVAL '5 hours' * (hour(ts) // 5)")


@_register(
    "resample_multi", "SELECT '1h' AS freq, symbol, b AS ts, round(open, 6) AS open, round(close, 6) AS close, volume FROM h UNION ALL SELECT '1d', symbol, b, round(open, 6), round(close, 6), volume FROM d",
    TRADES, _bars("h", "date_trunc('hour', ts)"), _bars("d", "date_trunc('day', ts)"),
)
def resample_multi(spark, sf_dir):
    return _out(candles.resample_multi(model.bars(spark, sf_dir, "15min"), ["1h", "1d"]), "freq", "symbol", "ts", "open", "close", "volume")


@_register("allday_bars", "SELECT symbol, date, round(high, 6) AS high, round(low, 6) AS low, volume FROM allday", TRADES, *ALLDAY)
def allday_bars(spark, sf_dir):
    return _out(candles.daily_bars(model.bars(spark, sf_dir)), "symbol", "date", "high", "low", "volume")


@_register("session_filter", "SELECT symbol, ts, round(close, 6) AS close FROM bars WHERE ts::TIME BETWEEN TIME '09:00' AND TIME '12:00'", *H1)
def session_filter(spark, sf_dir):
    return _out(candles.session_filter(model.bars(spark, sf_dir), "09:00", "12:00"), "symbol", "ts", "close")


@_register(
    "session_label",
    "SELECT label, count(*) AS n FROM (SELECT CASE WHEN ts::TIME < TIME '09:30' THEN 'pre' WHEN ts::TIME < TIME '16:00' THEN 'regular' ELSE 'post' END || CASE WHEN isodow(ts) < 6 AND hour(ts) BETWEEN 4 AND 19 THEN '/open' ELSE '/closed' END AS label FROM events) GROUP BY 1",
)
def session_label(spark, sf_dir):
    t = model.trades(spark, sf_dir)
    open_ = (F.weekday("ts") < 5) & F.hour("ts").between(4, 19)
    return t.groupBy(F.concat(session(F.col("ts")), F.when(open_, "/open").otherwise("/closed")).alias("label")).agg(F.count("*").alias("n"))


@_register(
    "partition_keys",
    "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y') AS year, count(*) AS n FROM events GROUP BY ALL",
)
def partition_keys(spark, sf_dir):
    ts = F.col("ts")
    keys = [partition_key(ts, "1min").alias("week"), partition_key(ts, "1h").alias("month"), partition_key(ts, "1d").alias("year")]
    return model.trades(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))


@_register(
    "partition_ranges",
    "SELECT DISTINCT date_trunc('week', ts)::DATE AS week_first, (date_trunc('week', ts) + INTERVAL 6 DAY)::DATE AS week_last, date_trunc('month', ts)::DATE AS month_first, last_day(ts) AS month_last, make_date(year(ts), 12, 31) AS year_last FROM events",
)
def partition_ranges(spark, sf_dir):
    week = F.to_date(F.date_trunc("week", "ts"))
    return model.trades(spark, sf_dir).select(
        week.alias("week_first"), F.date_add(week, 6).alias("week_last"), F.to_date(F.date_trunc("month", "ts")).alias("month_first"),
        F.last_day(F.to_date("ts")).alias("month_last"), F.make_date(F.year("ts"), F.lit(12), F.lit(31)).alias("year_last"),
    ).distinct()


@_register("candles_range", "SELECT symbol, ts, round(close, 6) AS close FROM bars WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'", *H1)
def candles_range(spark, sf_dir):
    b = candles.trades_to_candles(model.trades(spark, sf_dir).filter("ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-11'"), "1h")
    return _out(b, "symbol", "ts", "close")


_PART_SPLITS = "splits AS (SELECT p_partkey % (SELECT count(*) FROM supplier) + 1 AS symbol, DATE '1993-01-01' + (p_size % 25 * 100)::INTEGER AS e, p_size % 3 + 1 AS split_from, p_partkey % 4 + 1 AS split_to FROM part)"


@_register(
    "split_adjust", "SELECT symbol, date, round(close * coalesce(f, 1), 6) AS close, volume FROM (SELECT s.symbol, s.date, any_value(close) AS close, any_value(volume) AS volume, product(split_from / split_to) AS f FROM ship s LEFT JOIN splits p ON s.symbol = p.symbol AND s.date < p.e AND p.e <= DATE '2000-12-31' GROUP BY 1, 2)",
    *SHIPMENTS, _PART_SPLITS,
)
def split_adjust(spark, sf_dir):
    out = candles.split_adjust(model.shipments(spark, sf_dir), model.splits(spark, sf_dir), F.lit("2000-12-31").cast("date"))
    return _out(out, "symbol", "date", "close", "volume")


_HOLIDAYS = ["2024-01-01", "2024-01-15", "2024-02-19"]
_CAL = [
    "days AS (SELECT unnest(range(DATE '2023-12-01', DATE '2024-04-01', INTERVAL 1 DAY))::DATE AS date)",
    "cal AS (SELECT date, isodow(date) < 6 AND date::VARCHAR NOT IN ('2024-01-01', '2024-01-15', '2024-02-19') AS is_session FROM days)",
    "calendar AS (SELECT date, is_session, (sum(is_session::BIGINT) OVER (ORDER BY date))::BIGINT AS tdx FROM cal)",
]


def _calendar(spark):
    return candles.trading_calendar(spark, "2023-12-01", "2024-03-31", _HOLIDAYS)


@_register("trading_calendar", "SELECT c.date, is_session, tdx, count(event_id) AS n FROM calendar c LEFT JOIN events e ON e.ts::DATE = c.date GROUP BY ALL", *_CAL)
def trading_calendar(spark, sf_dir):
    n = model.trades(spark, sf_dir).groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    return _calendar(spark).join(n, "date", "left").select("date", "is_session", "tdx", F.coalesce("n", F.lit(0)).alias("n"))


for _name, _n, _sql in (
    ("lookback_days", -3, "SELECT d.date, (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM calendar c WHERE is_session AND c.date < d.date) WHERE k = 3) AS session FROM (SELECT DISTINCT ts::DATE AS date FROM events) d"),
    ("lookforward_days", 2, "SELECT d.date, (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS k FROM calendar c WHERE is_session AND c.date > d.date) WHERE k = 2) AS session FROM (SELECT DISTINCT ts::DATE AS date FROM events) d"),
    ("next_session_at", 1, "SELECT d.date, (SELECT min(date) FROM calendar c WHERE is_session AND c.date > d.date) AS session FROM (SELECT DISTINCT ts::DATE AS date FROM events) d"),
):

    def _sessions(spark, sf_dir, n=_n):
        return candles.session_offset(model.trades(spark, sf_dir).select(F.to_date("ts").alias("date")).distinct(), _calendar(spark), n)

    _register(_name, _sql, *_CAL)(_sessions)

# ---- intraday indicators


def _intraday(name: str, column: str, make, sql: str, *ctes: str):
    @_register(name, f"SELECT symbol, ts, round({sql}, 6) AS v FROM bars {{}}".format("" if not ctes else "LEFT JOIN f USING (symbol, date)") , *(FEATURES if ctes else H1))
    def query(spark, sf_dir):
        out = make(model.bars(spark, sf_dir), lambda: model.daily(spark, sf_dir))
        return out.select("symbol", "ts", F.round(F.col(column).cast("double"), 6).alias("v"))


_DAY = "OVER (PARTITION BY symbol, date ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_intraday("cumulative_daily_volume", "cumulative_daily_volume", lambda b, d: indicators.cumulative_daily_volume(b), f"(sum(volume) {_DAY})::DOUBLE")
for _op, _col in (("min", "low"), ("max", "high"), ("sum", "volume")):
    _c = f"{indicators.NAMES[_op]}_{_col}"
    _intraday(f"cumulative_{_op}", _c, lambda b, d, o=_op, c=_col: indicators.cumulative(b, c, o), f"({_op}({_col}) {_DAY})::DOUBLE")
    _intraday(f"premarket_cumulative_{_op}", f"premarket_{_c}", lambda b, d, o=_op, c=_col: indicators.premarket_cumulative(b, c, o), f"({_op}(CASE WHEN ts::TIME < TIME '09:30' THEN {_col} END) {_DAY})::DOUBLE")
    _feature = {"min": "min_low_5d", "max": "max_high_5d", "sum": "sum_volume_5d"}[_op]
    _intraday(f"daily_rolling_{_op}", _feature, lambda b, d, o=_op, c=_col: Daily(d(), b).rolling(5, o, c).join(), f"{_feature}::DOUBLE", "f")
_intraday("shift", "low_shift_2", lambda b, d: indicators.shift(b, "low", 2), "lag(low, 2) OVER (PARTITION BY symbol, date ORDER BY ts)")
_REGULAR = "CASE WHEN ts::TIME >= TIME '09:30' THEN {} END"
_intraday("gap", "gap_close", lambda b, d: indicators.gap(b, d(), "close"), "(close - prev_day_close) / prev_day_close", "f")
_intraday("atr_gap", "atr_gap_low_14", lambda b, d: indicators.atr_gap(b, d(), "low", 14), "(low - prev_day_close) / daily_atr_14", "f")
_intraday("position_in_range", "position_in_range_5d", lambda b, d: indicators.position_in_range(b, d(), 5), "(close - min_low_5d) / nullif(max_high_5d - min_low_5d, 0)", "f")
_intraday("prev_day", "prev_day_close", lambda b, d: Daily(d(), b).prev_day("close").join(), "prev_day_close", "f")
_intraday("prev_2day", "prev_2day_close", lambda b, d: Daily(d(), b).prev_day("close", 2).join(), "prev_2day_close", "f")
_intraday("daily_gap", "daily_gap", lambda b, d: indicators.daily_gap(b, d()), _REGULAR.format("(day_open - prev_day_close) / prev_day_close"), "f")
_intraday("day_open", "day_open", lambda b, d: indicators.day_open(b, d()), _REGULAR.format("day_open"), "f")
_intraday("daily_atr", "daily_atr_14", lambda b, d: Daily(d(), b).atr(14).join(), "daily_atr_14", "f")
_intraday("daily_atr_gap", "daily_atr_gap_14", lambda b, d: indicators.daily_atr_gap(b, d(), 14), _REGULAR.format("(day_open - prev_day_close) / daily_atr_14"), "f")
_intraday("adr", "adr_14", lambda b, d: Daily(d(), b).adr(14).join(), "adr_14", "f")
_intraday("adv", "adv_14", lambda b, d: Daily(d(), b).adv(14).join(), "adv_14", "f")


@_register(
    "atr", f"SELECT symbol, ts, round({_ewm('l', 14)}, 6) AS v FROM y", *H1,
    "x AS (SELECT symbol, ts, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))",
    "y AS (SELECT symbol, ts, list(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS l FROM x)",
)
def atr(spark, sf_dir):
    return indicators.atr(model.bars(spark, sf_dir), 14).select("symbol", "ts", F.round("atr_14", 6).alias("v"))


@_register("prev_allday", "SELECT symbol, ts, round(prev_day_high, 6) AS v FROM bars LEFT JOIN f USING (symbol, date)", *H1, *ALLDAY, *_features("allday", "bars"))
def prev_allday(spark, sf_dir):
    b = model.bars(spark, sf_dir)
    return indicators.prev_allday(b, b, "high").select("symbol", "ts", F.round("prev_allday_high", 6).alias("v"))


# ---- fundamentals

_FUND = [
    *SHIPMENTS, "caps AS (SELECT o_custkey % 100 AS symbol, o_orderdate::DATE AS date, max(o_totalprice) AS value FROM orders GROUP BY 1, 2)",
    "earn AS (SELECT DISTINCT o_custkey % 100 AS symbol, o_orderdate::DATE AS date FROM orders WHERE o_orderpriority = '1-URGENT')",
    "ipo AS (SELECT l_suppkey AS symbol, min(l_shipdate)::DATE + l_suppkey::INTEGER AS ipo FROM lineitem GROUP BY l_suppkey)",
]


def _days(spark, sf_dir):
    return model.shipments(spark, sf_dir).select("symbol", "date")


@_register("market_cap", "SELECT s.symbol, s.date, round(c.value, 6) AS market_cap FROM ship s ASOF LEFT JOIN caps c ON s.symbol = c.symbol AND s.date >= c.date", *_FUND)
def market_cap(spark, sf_dir):
    return _out(fundamental.market_cap(_days(spark, sf_dir), model.market_caps(spark, sf_dir)), "symbol", "date", "market_cap")


@_register("days_to_earnings", "SELECT s.symbol, s.date, (e.date - s.date)::DOUBLE AS days_to_earnings FROM ship s ASOF LEFT JOIN earn e ON s.symbol = e.symbol AND s.date <= e.date", *_FUND)
def days_to_earnings(spark, sf_dir):
    return fundamental.days_to_earnings(_days(spark, sf_dir), model.earnings(spark, sf_dir)).withColumn("days_to_earnings", F.col("days_to_earnings").cast("double"))


@_register("days_from_earnings", "SELECT s.symbol, s.date, (s.date - e.date)::DOUBLE AS days_from_earnings FROM ship s ASOF LEFT JOIN earn e ON s.symbol = e.symbol AND s.date >= e.date", *_FUND)
def days_from_earnings(spark, sf_dir):
    return fundamental.days_from_earnings(_days(spark, sf_dir), model.earnings(spark, sf_dir)).withColumn("days_from_earnings", F.col("days_from_earnings").cast("double"))


@_register("days_since_ipo", "SELECT symbol, date, CASE WHEN date >= ipo THEN (date - ipo)::DOUBLE END AS days_since_ipo FROM ship LEFT JOIN ipo USING (symbol)", *_FUND)
def days_since_ipo(spark, sf_dir):
    return fundamental.days_since_ipo(_days(spark, sf_dir), model.static(spark, sf_dir)).select("symbol", "date", F.col("days_since_ipo").cast("double"))


@_register("filter_market_cap", "SELECT s.symbol, s.date FROM ship s ASOF LEFT JOIN caps c ON s.symbol = c.symbol AND s.date >= c.date WHERE c.value BETWEEN 100000 AND 300000 OR c.value IS NULL", *_FUND)
def filter_market_cap(spark, sf_dir):
    return scanners.market_cap_filter(market_cap(spark, sf_dir), 100_000, 300_000, True).select("symbol", "date")


@_register("filter_days_since_ipo", "SELECT symbol, date FROM ship LEFT JOIN ipo USING (symbol) WHERE date - ipo >= 365 OR date < ipo OR ipo IS NULL", *_FUND)
def filter_days_since_ipo(spark, sf_dir):
    return scanners.ipo_filter(days_since_ipo(spark, sf_dir), 365).select("symbol", "date")


@_register("filter_dow", "SELECT symbol, date FROM ship WHERE isodow(date) IN (1, 3)", *SHIPMENTS)
def filter_dow(spark, sf_dir):
    return scanners.weekday_filter(_days(spark, sf_dir), [0, 2])


_HEAD = "head AS (SELECT doc_id % 50 AS symbol, source, text AS title, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS published_at FROM documents)"


@_register(
    "round_robin_headlines", "SELECT symbol, source, published_at, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY turn, source) AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol, source ORDER BY published_at, title) AS turn FROM head)) WHERE place <= 10", _HEAD
)
def round_robin_headlines(spark, sf_dir):
    return fundamental.round_robin(model.headlines(spark, sf_dir), 10).select("symbol", "source", "published_at", F.col("turn").cast("long"), F.col("place").cast("long"))


@_register("headlines_today", "SELECT symbol, published_at FROM head WHERE (published_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE = DATE '2024-01-10'", _HEAD)
def headlines_today(spark, sf_dir):
    return listings.on_day(model.headlines(spark, sf_dir), datetime.date(2024, 1, 10)).select("symbol", "published_at")


@_register("score_thresholds", "SELECT source, count(*) AS n, count(*) FILTER (s > 50) AS kept, count(*) FILTER (s >= 50) AS ge_50, count(*) FILTER (s >= 75) AS ge_75, count(*) FILTER (s >= 90) AS ge_90 FROM (SELECT source, n_chars % 101 AS s FROM documents) GROUP BY 1")
def score_thresholds(spark, sf_dir):
    return fundamental.score_thresholds(model.table(spark, sf_dir, "documents").select("source", (F.col("n_chars") % 101).alias("score")))


@_register(
    "parse_human_number",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE round(n_chars / 10 * [1, 1000, 1000000, 1000000000][doc_id % 5 + 1], 3) END AS v FROM documents",
)
def parse_human_number(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("", "K", "m", "B", "N/A"))), (F.col("doc_id") % 5 + 1).cast("int"))
    text = F.concat(F.format_number(F.col("n_chars") / 10, 1), unit)
    return model.table(spark, sf_dir, "documents").select("doc_id", F.round(human_number(text), 3).alias("v"))


# ---- scanners


def _scan(name: str, columns: list[str], run, sql: str, *ctes: str):
    @_register(name, sql, *(ctes or FEATURES))
    def query(spark, sf_dir):
        return _out(run(spark, sf_dir), *columns)


def _both(scanner: str, **params):
    return lambda s, d: scanners.scan(scanner, model.bars(s, d), model.daily(s, d), **params)


_VOL = f"v AS (SELECT *, sum(volume) {_DAY} AS cv, sum(CASE WHEN ts::TIME < TIME '09:30' THEN volume END) {_DAY} AS pv, min(low) {_DAY} AS lo, max(high) {_DAY} AS hi, lag(low, 1) OVER d AS l1, lag(low, 2) OVER d AS l2 FROM bars WINDOW d AS (PARTITION BY symbol, date ORDER BY ts))"
_W = "ts::TIME BETWEEN TIME '04:00' AND TIME '20:00'"
_KEYS = ["symbol", "ts", "signal"]
_GAPS = dict(min_multiplier=0.2, max_multiplier=5.0, min_volume=5, min_adv=10, min_adr=0.01)
_GAP_SQL = "SELECT symbol, ts, round(signal, 6) AS signal FROM (SELECT *, ({c} - prev_day_close) / daily_atr_14 AS signal FROM v JOIN f USING (symbol, date)) WHERE adv_14 >= 10 AND adr_14 >= 0.01 AND {w} AND cv >= 5 AND abs(signal) BETWEEN 0.2 AND 5 AND {p}"
GAP_DOWN = _GAP_SQL.format(c="low", w=_W, p="signal < 0 AND close < open")
_scan("scan_atr_gap_down", _KEYS, _both("atr_gap_down", **_GAPS), GAP_DOWN, *FEATURES, _VOL)
_scan("scan_atr_gap_up", _KEYS, _both("atr_gap_up", **_GAPS), _GAP_SQL.format(c="high", w=_W, p="signal > 0 AND close > open"), *FEATURES, _VOL)
_PAR_SQL = "SELECT symbol, ts, round(signal, 6) AS signal FROM (SELECT *, sum(volume) OVER (PARTITION BY symbol, date ORDER BY ts ROWS UNBOUNDED PRECEDING) AS mv, {s} / daily_atr_14 AS signal FROM v JOIN f USING (symbol, date) WHERE adv_14 >= 10 AND adr_14 >= 0.01 AND {w} AND {e}) WHERE signal > 0.2 AND mv >= 5"
_PAR = dict(multiplier=0.2, min_volume=5, min_adv=10, min_adr=0.01)
_scan("scan_parabolic_down", _KEYS, _both("atr_parabolic_down", **_PAR), _PAR_SQL.format(s="(open - close)", w=_W, e="abs(lo - low) < 1e-4"), *FEATURES, _VOL)
_scan("scan_parabolic_up", _KEYS, _both("atr_parabolic_up", **_PAR), _PAR_SQL.format(s="(close - open)", w=_W, e="abs(hi - high) < 1e-4"), *FEATURES, _VOL)
_DP_SQL = "SELECT symbol, date, round({s} / daily_atr_14, 6) AS signal FROM f WHERE {s} / daily_atr_14 BETWEEN 0.2 AND 3 AND adv_14 >= 10 AND adr_14 >= 0.001"
_DP = dict(min_multiplier=0.2, max_multiplier=3.0, min_adv=10, min_adr=0.001)
for _side, _s in (("up", "(prev_day_close - prev_day_open)"), ("down", "(prev_day_open - prev_day_close)")):
    _scan(f"scan_daily_parabolic_{_side}", ["symbol", "date", "signal"], lambda s, d, x=_side: scanners.scan(f"daily_atr_parabolic_{x}", None, model.shipments(s, d), **_DP), _DP_SQL.format(s=_s), *SHIP_FEATURES)
_RANGE_SQL = "SELECT symbol, ts, round(signal, 6) AS signal FROM (SELECT *, ({c} - prev_day_close) / daily_atr_14 AS signal FROM v JOIN f USING (symbol, date)) WHERE adv_14 >= 10 AND {w} AND pv >= 2 AND {p} AND signal >= -5"
_RANGE = dict(n_days=5, min_atr_gap=-5.0, min_volume=2, min_adv=10)
_scan("scan_high_range_gap_up", _KEYS, _both("high_range_gap_up", **_RANGE), _RANGE_SQL.format(c="high", w=_W, p="high > max_high_5d"), *FEATURES, _VOL)
_scan("scan_low_range_gap_down", _KEYS, _both("low_range_gap_down", **_RANGE), _RANGE_SQL.format(c="low", w=_W, p="low < min_low_5d"), *FEATURES, _VOL)
_scan(
    "scan_small_cap_up", ["symbol", "ts", "gap_high", "triggered_alert"], _both("small_cap_up", min_gap=0.2, shifts=[1, 2], changes=[0.5, 0.3], min_price=1.0, max_price=1000.0, min_volume=5),
    f"SELECT symbol, ts, round(g, 6) AS gap_high, a AS triggered_alert FROM (SELECT *, (high - prev_day_close) / prev_day_close AS g, CASE WHEN (high - l1) / nullif(l1, 0) > 0.5 THEN 'change_1' WHEN (high - l2) / nullif(l2, 0) > 0.3 THEN 'change_2' END AS a FROM v LEFT JOIN f USING (symbol, date)) WHERE {_W} AND abs(hi - high) < 1e-4 AND close BETWEEN 1 AND 1000 AND cv >= 5 AND g >= 0.2 AND a IS NOT NULL",
    *FEATURES, _VOL,
)
_scan(
    "scan_day2_gap", ["symbol", "date", "retrace", "gain"], lambda s, d: scanners.scan("day2_gap", None, model.daily(s, d), allday=candles.daily_bars(model.bars(s, d)), min_gap=0.05, min_retrace=0.1),
    "SELECT symbol, date, round(rt, 6) AS retrace, round(gn, 6) AS gain FROM (SELECT f.symbol, f.date, (g.prev_day_high - g.prev_day_close) / nullif(g.prev_day_close, 0) AS rt, (g.prev_day_high - f.prev_2day_close) / nullif(f.prev_2day_close, 0) AS gn, g.prev_day_close AS c1 FROM f JOIN g USING (symbol, date)) WHERE rt > 0.1 AND gn > 0.05 AND c1 >= 0",
    TRADES, *D1, *ALLDAY, *_features("daily", "daily"), *_features("allday", "daily", "g"),
)
_NEXT = "SELECT symbol, (SELECT min(date) FROM {c} c WHERE is_session AND c.date > m) AS date FROM (SELECT symbol, max(date) AS m FROM {d} GROUP BY 1)"
_SHIP_NEXT = [*SHIPMENTS, "weekdays AS (SELECT date, isodow(date) < 6 AS is_session FROM (SELECT unnest(range((SELECT min(date) FROM ship), (SELECT max(date) FROM ship) + 15, INTERVAL 1 DAY))::DATE AS date))", f"nxt AS ({_NEXT.format(c='weekdays', d='ship')})", *_features("ship", "nxt")]


def _next_shipment(spark, daily):
    first, last = daily.agg(F.min("date").cast("string"), F.date_add(F.max("date"), 14).cast("string")).first()
    return scanners.next_sessions(daily, candles.trading_calendar(spark, first, last, []))


def _asof_next(spark, sf_dir):
    d = model.shipments(spark, sf_dir)
    target = _next_shipment(spark, d)
    return Daily(d, target).prev_day("close").atr(14).adv(14).frame.join(target, ["symbol", "date"], "left_semi")


def _parabolic_next(side):
    def run(spark, sf_dir):
        d = model.shipments(spark, sf_dir)
        return scanners.scan(f"daily_atr_parabolic_{side}", None, d, target=_next_shipment(spark, d), **_DP)

    return run


def _day2_next(spark, sf_dir):
    d = model.daily(spark, sf_dir)
    return scanners.scan("day2_gap", None, d, allday=candles.daily_bars(model.bars(spark, sf_dir)), min_gap=0.05, min_retrace=0.1, target=scanners.next_sessions(d, _calendar(spark)))


_scan("asof_next_session", ["symbol", "date", "prev_day_close", "daily_atr_14", "adv_14"], _asof_next, "SELECT symbol, date, round(prev_day_close, 6) AS prev_day_close, round(daily_atr_14, 6) AS daily_atr_14, round(adv_14, 6) AS adv_14 FROM f JOIN nxt USING (symbol, date)", *_SHIP_NEXT)
for _side, _s in (("up", "(prev_day_close - prev_day_open)"), ("down", "(prev_day_open - prev_day_close)")):
    _scan(f"scan_daily_parabolic_{_side}_next", ["symbol", "date", "signal"], _parabolic_next(_side), _DP_SQL.format(s=_s), *_SHIP_NEXT)
_scan("scan_day2_gap_next", ["symbol", "date", "retrace", "gain"], _day2_next, ORACLES["scan_day2_gap"].split("\n")[-1], TRADES, *D1, *ALLDAY, *_CAL, f"nxt AS ({_NEXT.format(c='calendar', d='daily')})", *_features("daily", "nxt"), *_features("allday", "nxt", "g"))
_scan("first_match", _KEYS, lambda s, d: scanners.first_match(_both("atr_gap_down", **_GAPS)(s, d)), f"SELECT symbol, ts, signal FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS k FROM ({GAP_DOWN})) WHERE k = 1", *FEATURES, _VOL)
_scan("scan_summary", ["matching_symbols", "rows_per_symbol"], lambda s, d: scanners.scan_summary(_both("atr_gap_down", **_GAPS)(s, d)), f"SELECT count(DISTINCT symbol) AS matching_symbols, round(count(*) / count(DISTINCT symbol), 6) AS rows_per_symbol FROM ({GAP_DOWN})", *FEATURES, _VOL)
_scan("scan_day_symbols", ["symbol"], lambda s, d: _both("atr_gap_down", **_GAPS)(s, d).select("symbol").distinct(), f"SELECT DISTINCT symbol FROM ({GAP_DOWN})", *FEATURES, _VOL)


@_register(
    "scan_report", f"SELECT symbol, ts, strftime(ts + INTERVAL 1 HOUR, '%H:%M') AS scan_time, round(daily_atr_14, 4) AS daily_atr_14, round((close - min_low_5d) / nullif(max_high_5d - min_low_5d, 0), 4) AS position FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ts) AS k FROM ({GAP_DOWN}) JOIN bars USING (symbol, ts)) JOIN f USING (symbol, date) WHERE k = 1", *FEATURES, _VOL
)
def scan_report(spark, sf_dir):
    d = model.daily(spark, sf_dir)
    hits = scanners.first_match(scanners.atr_gap_scan(model.bars(spark, sf_dir), d, "down", **_GAPS))
    out = scanners.with_scan_time(indicators.position_in_range(hits, d, 5), "1h")
    return out.select("symbol", "ts", "scan_time", F.round("daily_atr_14", 4).alias("daily_atr_14"), F.round("position_in_range_5d", 4).alias("position"))


# ---- audit of streamed candles

_STREAM = [
    *H1, "s0 AS (SELECT b.*, q.seq FROM bars b JOIN (SELECT symbol, date_trunc('hour', ts) AS ts, min(seq) AS seq FROM trades GROUP BY 1, 2) q USING (symbol, ts) WHERE seq % 17 <> 0)",
    "s1 AS (SELECT symbol, ts, open, high, low, CASE WHEN seq % 23 = 0 THEN close + 1 ELSE close END AS close, volume, seq FROM s0)",
    "s AS (SELECT * FROM s1 UNION ALL SELECT symbol, ts, open, high, low, close, volume, seq + 1000000000 FROM s1 WHERE seq % 29 = 0)",
]


@_register("dq_duplicates", "SELECT symbol, sum(n)::BIGINT AS n_rows, count(*) AS n_times FROM (SELECT symbol, ts, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1", *_STREAM)
def dq_duplicates(spark, sf_dir):
    return quality.duplicates(model.streamed(spark, sf_dir))


@_register(
    "dq_missing_extra", "SELECT b.symbol, b.ts, 'MISSING' AS issue_type FROM bars b JOIN (SELECT symbol, min(ts) AS a, max(ts) AS z FROM s GROUP BY 1) e ON b.symbol = e.symbol AND b.ts BETWEEN a AND z WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.symbol = b.symbol AND s.ts = b.ts)", *_STREAM
)
def dq_missing_extra(spark, sf_dir):
    return quality.missing_extra(model.streamed(spark, sf_dir), model.bars(spark, sf_dir))


@_register("dq_ohlcv_mismatch", "SELECT symbol, ts, 'close' AS field, round(s.c, 6) AS realtime, round(b.close, 6) AS source FROM (SELECT symbol, ts, arg_min(close, seq) AS c FROM s GROUP BY 1, 2) s JOIN bars b USING (symbol, ts) WHERE abs(s.c - b.close) > 1e-6", *_STREAM)
def dq_ohlcv_mismatch(spark, sf_dir):
    return _out(quality.ohlcv_mismatch(model.streamed(spark, sf_dir), model.bars(spark, sf_dir)), "symbol", "ts", "field", "realtime", "source")


@_register("dq_unsorted", "SELECT symbol, count(*) AS n_violations FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS p FROM s) WHERE p > ts GROUP BY 1", *_STREAM)
def dq_unsorted(spark, sf_dir):
    return quality.unsorted(model.streamed(spark, sf_dir))


_ISSUES_SQL = """SELECT {} FROM (
      SELECT symbol, 'DUPLICATE' AS issue_type FROM s GROUP BY symbol, ts HAVING count(*) > 1
      UNION ALL SELECT s.symbol, 'MISMATCH' FROM (SELECT symbol, ts, arg_min(close, seq) AS c FROM s GROUP BY 1, 2) s JOIN bars b USING (symbol, ts) WHERE abs(s.c - b.close) > 1e-6
      UNION ALL SELECT b.symbol, 'MISSING' FROM bars b JOIN (SELECT symbol, min(ts) AS a, max(ts) AS z FROM s GROUP BY 1) e ON b.symbol = e.symbol AND b.ts BETWEEN a AND z WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.symbol = b.symbol AND s.ts = b.ts)
      UNION ALL SELECT symbol, 'EXTRA' FROM (SELECT DISTINCT symbol, ts FROM s) s WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE s.symbol = b.symbol AND s.ts = b.ts)
      UNION ALL SELECT symbol, 'UNSORTED' FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS p FROM s) WHERE p > ts
      UNION ALL SELECT symbol, 'MISSING_STREAM' FROM (SELECT DISTINCT symbol, date FROM bars) b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.symbol = b.symbol AND s.ts::DATE = b.date)) GROUP BY 1"""


@_register("dq_issue_summary", _ISSUES_SQL.format("issue_type, count(*) AS n, count(DISTINCT symbol) AS symbols"), *_STREAM)
def dq_issue_summary(spark, sf_dir):
    return quality.issue_summary(quality.issue_counts(model.streamed(spark, sf_dir), model.bars(spark, sf_dir)))


@_register("dq_summary", _ISSUES_SQL.format("issue_type, count(*) AS n"), *_STREAM)
def dq_summary(spark, sf_dir):
    return dq_issue_summary(spark, sf_dir).select("issue_type", "n")


@_register("symbols_with_stream", "SELECT DISTINCT symbol FROM s WHERE ts::DATE = DATE '2024-01-08'", *_STREAM)
def symbols_with_stream(spark, sf_dir):
    return model.streamed(spark, sf_dir).filter(F.to_date("ts") == F.lit("2024-01-08").cast("date")).select("symbol").distinct()


# ---- universe, storage and merges

_DAY1, _TODAY = datetime.date(2024, 1, 1), datetime.date(2024, 1, 20)


@_register("symbol_universe", "SELECT DISTINCT p_name AS symbol FROM part WHERE p_size % 6 < 4")
def symbol_universe(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, (*listings.TYPES, "ETF", "WARRANT"))), (F.col("p_size") % 6 + 1).cast("int"))
    return listings.universe(model.table(spark, sf_dir, "part").select(F.col("p_name").alias("symbol"), kind.alias("type")))


@_register(
    "slice_ranges", 'SELECT symbol, s::DATE AS start, least(s::DATE + 364, b) AS "end" FROM (SELECT symbol, b, unnest(generate_series(a, b, INTERVAL 365 DAY)) AS s FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM ship GROUP BY 1))', *SHIPMENTS
)
def slice_ranges(spark, sf_dir):
    return listings.slice_ranges(_days(spark, sf_dir).groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last")), 365)


@_register("rotating_batch", "SELECT c_custkey FROM customer WHERE c_custkey % 7 = 5")
def rotating_batch(spark, sf_dir):
    return listings.rotating_batch(model.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", _TODAY, _DAY1, 7)


@_register(
    "expired_partitions",
    "SELECT symbol, key FROM (SELECT user_id AS symbol, strftime(date_trunc('week', ts), '%Y-%m-%d') AS key, min(event_id) AS k, date_trunc('week', ts)::DATE + 7 AS e FROM events GROUP BY ALL) WHERE k % 3 = 0 OR (k % 2 = 0 AND e <= DATE '2024-01-20')",
)
def expired_partitions(spark, sf_dir):
    e, week = model.table(spark, sf_dir, "events"), F.to_date(F.date_trunc("week", "ts"))
    wanted = e.groupBy(F.col("user_id").alias("symbol"), partition_key(F.col("ts"), "1min").alias("key"), F.date_add(week, 7).alias("end")).agg(F.min("event_id").alias("k"))
    manifest = wanted.filter("k % 3 <> 0").withColumn("expires", F.when(F.col("k") % 2 == 0, F.col("end")))
    return listings.expired_partitions(wanted.select("symbol", "key"), manifest, _TODAY)


@_register(
    "splits_merge", "SELECT symbol, e AS execution_date, split_to::BIGINT AS split_to FROM o WHERE symbol NOT IN (SELECT symbol FROM s) UNION ALL SELECT symbol, e, split_to::BIGINT FROM n WHERE symbol IN (SELECT symbol FROM s)",
    _PART_SPLITS, "o AS (SELECT * FROM splits WHERE e < DATE '1997-07-01')", "n AS (SELECT * FROM splits WHERE split_to > 2)", "s AS (SELECT DISTINCT n.symbol FROM n LEFT JOIN (SELECT symbol, max(e) AS k FROM o GROUP BY 1) USING (symbol) WHERE k IS NULL OR e > k)",
)
def splits_merge(spark, sf_dir):
    s = model.splits(spark, sf_dir).select("symbol", "execution_date", F.col("split_to").cast("long"))
    return listings.merge_splits(s.filter("execution_date < date'1997-07-01'"), s.filter("split_to > 2"))


@_register("splits_load", "SELECT symbol::VARCHAR AS symbol, e AS execution_date, split_from::DOUBLE AS split_from, split_to::DOUBLE AS split_to, count(*) AS n FROM splits GROUP BY ALL", _PART_SPLITS)
def splits_load(spark, sf_dir):
    """Splits as they come back from their JSON map."""
    s = model.splits(spark, sf_dir)
    raw = listings.dump_splits(s.select("symbol", "execution_date", F.col("split_from").cast("double").alias("split_from"), F.col("split_to").cast("double").alias("split_to")))
    return listings.load_splits(raw).groupBy("symbol", "execution_date", "split_from", "split_to").agg(F.count("*").alias("n"))


#: Capitals of several letters (ß is SS) and the newest ones, which DuckDB's upper() leaves as they are.
_CAPITALS = {c: c.upper() for c in map(chr, range(0x10000)) if len(c.upper()) > 1}
_CAPITALS |= {"\u019b": "\ua7dc", "\u0264": "\ua7cb", "\u1c8a": "\u1c89", "\ua7cd": "\ua7cc", "\ua7db": "\ua7da", **{chr(k + 0x20): chr(k) for k in range(0x10D50, 0x10D66)}}


def _upper(value: str) -> str:
    """Full Unicode capitals in SQL, as Spark's (and Python's) upper() has them."""
    out = value
    for c, capital in _CAPITALS.items():
        out = f"replace({out}, '{c}', '{capital}')"
    return f"CASE WHEN regexp_matches({value}, '[{''.join(_CAPITALS)}]') THEN upper({out}) ELSE upper({value}) END"


@_register(
    "headline_summary_mentions", "SELECT doc_id FROM (SELECT doc_id, lang, coalesce(string_split(text, chr(10))[1], '') AS title, coalesce(array_to_string(string_split(text, chr(10))[2:], chr(10)), '') AS summary FROM documents) WHERE contains(" + _upper("(title || ' ' || summary)") + ", " + _upper("lang") + ")",
)
def headline_summary_mentions(spark, sf_dir):
    """The first line of a text is its title, all others are its summary."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    d = model.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("symbol"), F.get(lines, F.lit(0)).alias("title"), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n").alias("summary"))
    return listings.mentions(d).select("doc_id")


@_register(
    "earnings_merge", "SELECT symbol, o.date FROM earn o LEFT JOIN f USING (symbol) WHERE a IS NULL OR o.date < a UNION ALL SELECT * FROM n", *_FUND,
    "n AS (SELECT DISTINCT o_custkey % 100 AS symbol, o_orderdate::DATE AS date FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderdate >= TIMESTAMP '1997-01-01')", "f AS (SELECT symbol, min(date) AS a FROM n GROUP BY 1)",
)
def earnings_merge(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders").filter("o_orderpriority = '2-HIGH' AND o_orderdate >= timestamp_ntz'1997-01-01'")
    return listings.merge_earnings(model.earnings(spark, sf_dir), o.select((F.col("o_custkey") % 100).alias("symbol"), F.to_date("o_orderdate").alias("date")))


@_register("shares_float", "SELECT s.symbol, s.date, round(c.value, 6) AS shares_float FROM ship s LEFT JOIN caps c USING (symbol, date)", *_FUND)
def shares_float(spark, sf_dir):
    payload = F.to_json(F.struct("date", "value")).alias("payload")
    return _out(listings.dated_value(_days(spark, sf_dir), model.market_caps(spark, sf_dir).select("symbol", payload), "shares_float"), "symbol", "date", "shares_float")


_SCORED = "scored AS (SELECT lang AS symbol, text AS title, n_chars % 101 AS score, (n_chars + doc_id) % 101 AS again, doc_id, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS published_at FROM documents)"


def _scored(spark, sf_dir):
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    again = (F.col("n_chars") + F.col("doc_id")) % 101
    return model.table(spark, sf_dir, "documents").select(F.col("lang").alias("symbol"), F.col("text").alias("title"), (F.col("n_chars") % 101).alias("score"), again.alias("again"), "doc_id", at.alias("published_at"))


@_register("news_confidence", "SELECT doc_id, max(score) OVER (PARTITION BY symbol, published_at::DATE ORDER BY published_at) AS news_confidence FROM scored", _SCORED)
def news_confidence(spark, sf_dir):
    return listings.news_confidence(_scored(spark, sf_dir)).select("doc_id", "news_confidence")


_LINES = "scored AS (SELECT lang AS symbol, unnest(string_split(text, chr(10))) AS title, n_chars % 101 AS score, (n_chars + doc_id) % 101 AS again, doc_id FROM documents)"


def _scored_lines(spark, sf_dir):
    """Every line of a text, whole, as a headline."""
    d = model.table(spark, sf_dir, "documents")
    again = (F.col("n_chars") + F.col("doc_id")) % 101
    return d.select(F.col("lang").alias("symbol"), F.explode(F.split("text", "\n")).alias("title"), (F.col("n_chars") % 101).alias("score"), again.alias("again"), "doc_id")


@_register("headline_mentions", f"SELECT doc_id, count(*) AS n FROM scored WHERE contains({_upper('title')}, {_upper('symbol')}) GROUP BY 1", _LINES)
def headline_mentions(spark, sf_dir):
    return listings.mentions(_scored_lines(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))


@_register("new_headlines", "SELECT doc_id, count(*) AS n FROM scored a WHERE NOT EXISTS (SELECT 1 FROM scored b WHERE b.doc_id % 3 = 0 AND a.symbol = b.symbol AND a.title = b.title) GROUP BY 1", _LINES)
def new_headlines(spark, sf_dir):
    s = _scored_lines(spark, sf_dir)
    return listings.new_headlines(s, s.filter("doc_id % 3 = 0")).groupBy("doc_id").agg(F.count("*").alias("n"))


@_register(
    "score_comparison", "SELECT symbol, count(*) FILTER (n = 0) AS only_old, count(*) FILTER (o = 0) AS only_new, count(*) FILTER (o > 0 AND n > 0) AS \"both\" FROM (SELECT symbol, title, count(*) FILTER (score > 50) AS o, count(*) FILTER (again > 50) AS n FROM scored WHERE symbol IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2) WHERE o + n > 0 GROUP BY 1", _LINES
)
def score_comparison(spark, sf_dir):
    s = _scored_lines(spark, sf_dir).filter("symbol IS NOT NULL AND title IS NOT NULL")
    return listings.score_comparison(s, s.withColumn("score", F.col("again")))


@_register("dq_missing_streams", "SELECT DISTINCT symbol, date FROM bars b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.symbol = b.symbol AND s.ts::DATE = b.date)", *_STREAM)
def dq_missing_streams(spark, sf_dir):
    return quality.missing_streams(model.streamed(spark, sf_dir), model.bars(spark, sf_dir))


@_register(
    "parse_scores",
    "SELECT doc_id, (doc_id % 7)::INT AS idx, (n_chars % 130)::INT AS confidence FROM documents WHERE doc_id % 7 < 5 AND n_chars % 130 <= 100 UNION ALL SELECT doc_id, (n_chars % 9)::INT, (doc_id % 100)::INT FROM documents WHERE n_chars % 9 < 5",
)
def parse_scores(spark, sf_dir):
    d = model.table(spark, sf_dir, "documents")
    entry = '{"idx": %s, "confidence": %s}'
    response = F.concat(F.lit("scores:\n"), F.format_string(f"[{entry % ('%d', '%d')}, {entry % ('%d', '%d.5')}] done", F.col("doc_id") % 7, F.col("n_chars") % 130, F.col("n_chars") % 9, F.col("doc_id") % 100))
    return d.select("doc_id", F.explode(parsing.parse_scores(response, F.lit(5))).alias("e")).select("doc_id", "e.idx", "e.confidence")


@_register(
    "fundamentals_parse",
    "SELECT s_suppkey AS symbol, s_name AS city, s_nationkey::VARCHAR AS exchange, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS beta, s_name AS ceo_name, max_by(o_totalprice, o_orderdate) AS last_cap, count(DISTINCT o_orderdate) AS n_caps FROM supplier JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL) ON o_custkey = s_suppkey GROUP BY ALL",
)
def fundamentals_parse(spark, sf_dir):
    s, o = model.table(spark, sf_dir, "supplier"), model.table(spark, sf_dir, "orders")
    o = o.groupBy(F.col("o_custkey").alias("s_suppkey"), F.to_date("o_orderdate").cast("string").alias("date")).agg(F.max("o_totalprice").alias("value"))
    caps = o.groupBy("s_suppkey").agg(F.to_json(F.map_from_arrays(F.collect_list("date"), F.collect_list(F.struct("date", "value")))).alias("caps"))
    officers = F.create_map(F.lit("0"), F.struct(F.lit("x").alias("Name"), F.lit("Chairman").alias("Title")), F.lit("1"), F.struct(F.col("s_name").alias("Name"), F.lit("President & ceo").alias("Title")))
    general = F.struct(F.struct(F.col("s_name").alias("City")).alias("AddressData"), F.col("s_nationkey").cast("string").alias("Exchange"), officers.alias("Officers"))
    raw = F.when(F.col("s_suppkey") % 3 > 0, F.to_json(F.struct(general.alias("General"), F.struct(F.col("s_acctbal").alias("Beta")).alias("Technicals"))))
    raw = F.coalesce(raw, F.to_json(F.struct(general.alias("General"), F.lit("NA").alias("Technicals"))))
    out = parsing.fundamentals(s.join(caps, "s_suppkey").withColumn("raw", raw))
    last = F.element_at("historical_market_cap", -1)["value"]
    return out.select(F.col("s_suppkey").alias("symbol"), "city", "exchange", "beta", "ceo_name", last.alias("last_cap"), F.size("historical_market_cap").cast("long").alias("n_caps"))


@_register(
    "page_headlines",
    "SELECT page_id, k::INT AS pos, CASE WHEN k >= 2 THEN 'Jan-03-24' WHEN page_id % 2 = 0 THEN 'Jan-02-24' END AS date, url || ' & ' || k AS title FROM pages, range(4) t(k) WHERE url IS NOT NULL",
)
def page_headlines(spark, sf_dir):
    """No given page has a news table: one derived from the page's address follows each page's own html."""
    cell = lambda k: F.when((k == 0) & (F.col("page_id") % 2 == 0), "Jan-02-24 09:30AM").when(k == 2, "Jan-03-24 08:00AM").otherwise("10:00AM")
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.concat(F.lit('<tr><td width="130"> '), cell(k), F.lit('</td><td><a class="tab-link-news" href="#">'), "url", F.lit(" &amp; "), k.cast("string"), F.lit("</a></td></tr>")))
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<table><tr><td>x</td></tr></table><table id="news-table">'), F.array_join(rows, "\n"), F.lit("</table>"))
    return parsing.page_headlines(model.table(spark, sf_dir, "pages").withColumn("html", html))


@_register(
    "subscription_counts",
    "SELECT symbol, unit, count(*) AS subscribers FROM (SELECT user_id, event_id % 10 AS symbol, CASE WHEN event_id % 2 = 0 THEN 's' ELSE 'min' END AS unit, max_by(event_type <> 'error', (ts, event_id)) AS add FROM events GROUP BY ALL) WHERE add GROUP BY ALL",
)
def subscription_counts(spark, sf_dir):
    e = model.table(spark, sf_dir, "events")
    unit = F.when(F.col("event_id") % 2 == 0, "s").otherwise("min").alias("unit")
    return live.subscription_counts(e.select(F.col("user_id").alias("subscriber"), (F.col("event_id") % 10).alias("symbol"), unit, "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("add")))
