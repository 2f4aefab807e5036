"""Scanners: filters over daily features, then over intraday bars of the days that survive.

The daily stage works on the small daily table; its survivors are joined to the bars by (symbol, date) before any running
value of a day is computed, so only bars of surviving days reach the windows. Parameters left at None do not filter.

Every scanner takes the bounds of ``day_bounds``: on market cap, days since the listing, days from earnings, weekday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.time import seconds
from quotemill.operators import fundamental
from quotemill.operators.candles import session_filter, session_offset
from quotemill.operators.indicators import Daily, cumulative, cumulative_daily_volume, premarket_cumulative, shift
from quotemill.sources.storage import written


def between(value: Column, low=None, high=None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (value >= low)
    if high is not None:
        out = out & (value <= high)
    return out


def market_cap_filter(df: DataFrame, low=None, high=None, include_null: bool = False, col: str = "market_cap") -> DataFrame:
    known = between(F.col(col), low, high) & F.col(col).isNotNull()
    return df.filter(known | F.col(col).isNull() if include_null else known)


def ipo_filter(df: DataFrame, days: int, col: str = "days_since_ipo") -> DataFrame:
    return df.filter((F.col(col) >= days) | F.col(col).isNull())


def weekday_filter(df: DataFrame, days: list[int], col: str = "date") -> DataFrame:
    """Monday is 0."""
    return df.filter(F.weekday(col).isin(days))


def day_bounds(
    days: DataFrame, caps: DataFrame | None = None, earnings: DataFrame | None = None, static: DataFrame | None = None, min_market_cap=None, max_market_cap=None, include_null_market_cap: bool = False,
    min_days_since_ipo: int | None = None, min_days_from_earnings: int | None = None, max_days_from_earnings: int | None = None, days_of_week: list[int] | None = None,
) -> DataFrame:
    """The days (rows with ``symbol, date``) within the bounds. An unknown market cap passes only if asked for, an unknown listing
    date passes, and unknown earnings fail where a bound is set. As-of joins read their days more than once, so these are written before."""
    names = days.columns
    if days_of_week is not None:
        days = weekday_filter(days, days_of_week)
    if min_days_since_ipo is not None:
        days = ipo_filter(fundamental.days_since_ipo(days, static), min_days_since_ipo)
    if not all(b is None for b in (min_market_cap, max_market_cap, min_days_from_earnings, max_days_from_earnings)):
        days = written(days)
    if min_market_cap is not None or max_market_cap is not None:
        days = market_cap_filter(fundamental.market_cap(days, caps), min_market_cap, max_market_cap, include_null_market_cap)
    if min_days_from_earnings is not None or max_days_from_earnings is not None:
        days = fundamental.days_from_earnings(days, earnings).filter(between(F.col("days_from_earnings"), min_days_from_earnings, max_days_from_earnings))
    return days.select(*names)


def passed(rule: Column) -> Column:
    """A rule as a flag that is never NULL."""
    return F.coalesce(rule, F.lit(False))


def _gap_of(col: str) -> Column:
    return F.try_divide(F.col(col) - F.col("prev_day_close"), F.col("daily_atr_14"))


def atr_gap_rule(side: str, min_multiplier: float, max_multiplier: float | None = None, min_volume: float = 0) -> tuple[Column, Column]:
    """``signal, rule`` on bars with the day's volume, previous close and daily range; batch and stream share it."""
    col, sign = ("low", -1) if side == "down" else ("high", 1)
    signal, moved = _gap_of(col), F.col("close") < F.col("open") if side == "down" else F.col("close") > F.col("open")
    return signal, (F.col("cumulative_daily_volume") >= min_volume) & between(F.abs(signal), min_multiplier, max_multiplier) & (signal * sign > 0) & moved


def parabolic_rule(side: str, multiplier: float, min_volume: float = 0, volume: str = "cum_volume") -> tuple[Column, Column]:
    """``signal, rule`` on bars at an extreme of the day, with the volume up to them."""
    signal = F.try_divide((F.col("open") - F.col("close")) * (1 if side == "down" else -1), F.col("daily_atr_14"))
    return signal, (signal > multiplier) & (F.col(volume) >= min_volume)


def range_gap_rule(side: str, n_days: int, min_atr_gap: float | None = None, min_volume: float = 0) -> tuple[Column, Column]:
    """``signal, rule`` on bars with the premarket volume and the extreme of the n days before."""
    col, op = ("high", "max") if side == "up" else ("low", "min")
    signal, limit = _gap_of(col), F.col(f"{op}_{col}_{n_days}d")
    beyond = F.col(col) > limit if side == "up" else F.col(col) < limit
    return signal, (F.col("premarket_total_volume") >= min_volume) & beyond & between(signal, min_atr_gap)


def small_cap_rule(min_gap: float, shifts: list[int], changes: list[float], min_price: float, max_price: float, min_volume: float = 0) -> tuple[Column, Column, Column]:
    """``gap_high, triggered_alert, rule`` on bars at the day's high, with the lows of k bars ago."""
    alert = F.coalesce(*[F.when(F.try_divide(F.col("high") - F.col(f"low_shift_{k}"), F.col(f"low_shift_{k}")) > c, f"change_{k}") for k, c in zip(shifts, changes, strict=True)])
    gap = F.try_divide(F.col("high") - F.col("prev_day_close"), F.col("prev_day_close"))
    return gap, alert, F.col("close").between(min_price, max_price) & (F.col("cumulative_daily_volume") >= min_volume) & (gap >= min_gap) & alert.isNotNull()


def at_extreme(col: str, extreme: str) -> Column:
    return F.abs(F.col(extreme) - F.col(col)) < 1e-4


def surviving_days(features: Daily, min_adv=None, min_adr=None, max_adr=None, **bounds) -> DataFrame:
    """The symbol-days that pass the daily stage, with the daily features."""
    days = features.frame.select("symbol", "date", *features.names)
    if min_adv is not None:
        days = days.filter(F.col("adv_14") >= min_adv)
    if min_adr is not None or max_adr is not None:
        days = days.filter(between(F.col("adr_14"), min_adr, max_adr))
    return day_bounds(days, **bounds)


def _survivors(bars: DataFrame, features: Daily, **day) -> DataFrame:
    """The bars of the surviving days, with the daily features."""
    return bars.join(surviving_days(features, **day), ["symbol", "date"])


def atr_gap_scan(bars: DataFrame, daily: DataFrame, side: str, min_multiplier: float, max_multiplier: float | None = None, min_volume: float = 0, start: str = "04:00", end: str = "20:00", **day) -> DataFrame:
    """Bars that gap away from the previous close by multiples of the daily range and move on in that direction."""
    f = Daily(daily, bars).adv(14).adr(14).prev_day("close").atr(14)
    out = session_filter(cumulative_daily_volume(_survivors(bars, f, **day)), start, end)
    signal, rule = atr_gap_rule(side, min_multiplier, max_multiplier, min_volume)
    return out.withColumn("signal", signal).filter(rule)


def parabolic_scan(bars: DataFrame, daily: DataFrame, side: str, multiplier: float, min_volume: float = 0, start: str = "04:00", end: str = "20:00", cum_volume_scope: str = "matched", **day) -> DataFrame:
    """Bars in the window that make a new extreme of the day by a large body. ``cum_volume_scope``: volume
    summed over the matching bars, over the window, or over the day."""
    col, op = ("low", "min") if side == "down" else ("high", "max")
    f = Daily(daily, bars).adv(14).adr(14).atr(14)
    out = _survivors(bars, f, **day)
    if cum_volume_scope == "day":
        out = cumulative(out, "volume", "sum", "cum_volume")
    out = session_filter(cumulative(out, col, op, "_extreme"), start, end)
    if cum_volume_scope == "window":
        out = cumulative(out, "volume", "sum", "cum_volume")
    out = out.filter(at_extreme(col, "_extreme")).drop("_extreme")
    if cum_volume_scope == "matched":
        out = cumulative(out, "volume", "sum", "cum_volume")
    signal, rule = parabolic_rule(side, multiplier, min_volume)
    return out.withColumn("signal", signal).filter(rule)


def next_sessions(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """``symbol, date``: the session after the newest one of each symbol, the target of a scan as of tomorrow."""
    last = daily.groupBy("symbol").agg(F.max("date").alias("last"))
    return last.join(session_offset(last.select(F.col("last").alias("date")).distinct(), calendar, 1).withColumnRenamed("date", "last"), "last").select("symbol", F.col("session").alias("date"))


def daily_parabolic_scan(daily: DataFrame, side: str, min_multiplier: float, max_multiplier: float | None = None, min_adv=None, min_adr=None, target: DataFrame | None = None, **bounds) -> DataFrame:
    """The previous session's body in units of the daily range, seen from the next date; with ``next_sessions`` as
    ``target`` also the newest session's, seen from the session to come."""
    f = Daily(daily, daily if target is None else target).adv(14).adr(14).atr(14).prev_day("open").prev_day("close").frame
    body = F.col("prev_day_close") - F.col("prev_day_open") if side == "up" else F.col("prev_day_open") - F.col("prev_day_close")
    f = f.withColumn("signal", F.try_divide(body, F.col("daily_atr_14"))).filter(between(F.col("signal"), min_multiplier, max_multiplier))
    return day_bounds(f.filter(between(F.col("adv_14"), min_adv) & between(F.col("adr_14"), min_adr)), **bounds)


def range_gap_scan(bars: DataFrame, daily: DataFrame, side: str, n_days: int, min_atr_gap: float | None = None, min_volume: float = 0, start: str = "04:00", end: str = "20:00", **day) -> DataFrame:
    """Bars beyond the range of the n days before. The lower bound on the gap is not mirrored for ``down``."""
    col, op = ("high", "max") if side == "up" else ("low", "min")
    f = Daily(daily, bars).adv(14).adr(14).rolling(n_days, op, col).prev_day("close").atr(14)
    out = session_filter(premarket_cumulative(_survivors(bars, f, **day), "volume", "sum"), start, end)
    signal, rule = range_gap_rule(side, n_days, min_atr_gap, min_volume)
    return out.withColumn("signal", signal).filter(rule)


def small_cap_scan(bars: DataFrame, daily: DataFrame, min_gap: float, shifts: list[int], changes: list[float], min_price: float, max_price: float, min_volume: float = 0, start: str = "04:00", end: str = "20:00", **day) -> DataFrame:
    """New highs of the day within a price range, up from the previous close, whose high rose over the low k
    bars ago by more than that shift's change; the first such shift names the alert."""
    out = cumulative(cumulative_daily_volume(_survivors(bars, Daily(daily, bars).prev_day("close"), **day)), "high", "max", "_top")
    for k in shifts:
        out = shift(out, "low", k)
    out = session_filter(out, start, end)
    gap, alert, rule = small_cap_rule(min_gap, shifts, changes, min_price, max_price, min_volume)
    return out.filter(at_extreme("high", "_top")).withColumn("gap_high", gap).withColumn("triggered_alert", alert).filter(rule).drop("_top")


def day2_scan(daily: DataFrame, allday: DataFrame, min_gap: float, min_retrace: float, min_price: float = 0, min_adv=None, min_adr=None, target: DataFrame | None = None, **bounds) -> DataFrame:
    """Days after a day that gained and then gave back part of its high (highs and closes of all sessions,
    the close before it of the regular session)."""
    target = daily if target is None else target
    f = Daily(daily, target).prev_day("close", 2).adv(14).adr(14)
    a = Daily(allday, target).prev_day("close").prev_day("high").frame.select("symbol", "date", F.col("prev_day_close").alias("c1"), F.col("prev_day_high").alias("h1"))
    out = f.frame.join(a, ["symbol", "date"]).withColumn("retrace", F.try_divide(F.col("h1") - F.col("c1"), F.col("c1"))).withColumn("gain", F.try_divide(F.col("h1") - F.col("prev_2day_close"), F.col("prev_2day_close")))
    out = out.filter((F.col("retrace") > min_retrace) & (F.col("gain") > min_gap) & (F.col("c1") >= min_price))
    return day_bounds(out.filter(between(F.col("adv_14"), min_adv) & between(F.col("adr_14"), min_adr)), **bounds)


def first_match(matches: DataFrame) -> DataFrame:
    """The first row of each symbol and date, whole."""
    w = Window.partitionBy("symbol", "date").orderBy("ts")
    return matches.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def scan_summary(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count_distinct("symbol").alias("matching_symbols"), F.try_divide(F.count("*"), F.count_distinct("symbol")).alias("rows_per_symbol"))


def with_scan_time(matches: DataFrame, freq: str) -> DataFrame:
    """When the bar was complete, as HH:mm."""
    return matches.withColumn("scan_time", F.date_format(F.col("ts") + F.make_dt_interval(secs=F.lit(seconds(freq))), "HH:mm"))


def report(hits: DataFrame, daily: DataFrame, static: DataFrame, earnings: DataFrame, freq: str, ranges: tuple[int, ...] = (2, 5, 10, 20, 50, 100, 200), period: int = 14) -> DataFrame:
    """Hits with the columns of a scan report: when the bar was complete, the symbol's static columns, days to and from
    earnings, the day's gap, also in units of the daily range, and the close's position in the ranges of the days before.
    All daily features are columns of one spine, which is joined once."""
    d = Daily(daily, hits).prev_day("close").day_open().atr(period)
    for n in ranges:
        d = d.rolling(n, "min", "low").rolling(n, "max", "high")
    new = d.frame.select("symbol", "date", *[c for c in d.names if c not in hits.columns])
    out = hits.join(new, ["symbol", "date"], "left").join(static, "symbol", "left")
    out = fundamental.days_from_earnings(fundamental.days_to_earnings(out, earnings), earnings)
    gap = F.try_divide(F.col("day_open") - F.col("prev_day_close"), F.col("prev_day_close"))
    out = out.withColumn("daily_gap", F.when(F.date_format("ts", "HH:mm") >= "09:30", gap))
    out = out.withColumn(f"daily_atr_gap_{period}", F.try_divide(F.col("daily_gap") * F.col("prev_day_close"), F.col(f"daily_atr_{period}")))
    for n in ranges:
        low, high = F.col(f"min_low_{n}d"), F.col(f"max_high_{n}d")
        out = out.withColumn(f"position_in_range_{n}d", F.when(high != low, (F.col("close") - low) / (high - low))).drop(f"min_low_{n}d", f"max_high_{n}d")
    return with_scan_time(out, freq)


SCANNERS = {
    "atr_gap_down": lambda b, d, **p: atr_gap_scan(b, d, "down", **p),
    "atr_gap_up": lambda b, d, **p: atr_gap_scan(b, d, "up", **p),
    "atr_parabolic_down": lambda b, d, **p: parabolic_scan(b, d, "down", **p),
    "atr_parabolic_up": lambda b, d, **p: parabolic_scan(b, d, "up", **p),
    "daily_atr_parabolic_up": lambda b, d, **p: daily_parabolic_scan(d, "up", **p),
    "daily_atr_parabolic_down": lambda b, d, **p: daily_parabolic_scan(d, "down", **p),
    "high_range_gap_up": lambda b, d, **p: range_gap_scan(b, d, "up", **p),
    "low_range_gap_down": lambda b, d, **p: range_gap_scan(b, d, "down", **p),
    "small_cap_up": small_cap_scan,
    "day2_gap": lambda b, d, **p: day2_scan(d, **p),
}


def scan(name: str, bars: DataFrame | None, daily: DataFrame, **params) -> DataFrame:
    if name not in SCANNERS:
        raise ValueError(f"unknown scanner {name!r}; known: {', '.join(SCANNERS)}")
    return SCANNERS[name](bars, daily, **params)

