"""Indicators by name. Each takes the frame, the tables it needs as ``Tables``, and its own parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions.time import time_of_day
from quotemill.operators import fundamental, indicators, listings
from quotemill.operators.indicators import OPEN, Daily


@dataclass(frozen=True)
class Tables:
    """Daily bars, bars of all sessions, and tables of fundamentals and news; None where no indicator asks for one."""

    daily: DataFrame | None = None
    allday: DataFrame | None = None
    earnings: DataFrame | None = None
    caps: DataFrame | None = None
    static: DataFrame | None = None
    shares: DataFrame | None = None
    scores: DataFrame | None = None
    anchor: object = None
    calendar: DataFrame | None = None


def _prev_day(df, t, col, n=1, mode="bar"):
    """``mode``: the n-th bar before, or the bar of the n-th session before in the calendar."""
    if mode not in ("bar", "calendar"):
        raise ValueError(f"unknown mode {mode!r}; known: bar, calendar")
    return indicators.prev_session(df, t.daily, col, t.calendar, n) if mode == "calendar" else Daily(t.daily, df, t.anchor).prev_day(col, n).join()


INDICATORS = {
    "cumulative_daily_volume": lambda df, t: indicators.cumulative_daily_volume(df),
    "premarket_cumulative": lambda df, t, col, op: indicators.premarket_cumulative(df, col, op),
    "cumulative": lambda df, t, col, op: indicators.cumulative(df, col, op),
    "atr": lambda df, t, period, freq="1min": indicators.atr(df, period, freq),
    "position_in_range": lambda df, t, n: indicators.position_in_range(df, t.daily, n, anchor=t.anchor),
    "daily_rolling": lambda df, t, n, op, col: Daily(t.daily, df, t.anchor).rolling(n, op, col).join(),
    "gap": lambda df, t, col: indicators.gap(df, t.daily, col, anchor=t.anchor),
    "atr_gap": lambda df, t, col, period: indicators.atr_gap(df, t.daily, col, period, anchor=t.anchor),
    "shift": lambda df, t, col, n: indicators.shift(df, col, n),
    "prev_day": _prev_day,
    "daily_gap": lambda df, t: indicators.daily_gap(df, t.daily, anchor=t.anchor),
    "daily_atr": lambda df, t, period: Daily(t.daily, df, t.anchor).atr(period).join(),
    "daily_atr_gap": lambda df, t, period: indicators.daily_atr_gap(df, t.daily, period, anchor=t.anchor),
    "adr": lambda df, t, period: Daily(t.daily, df, t.anchor).adr(period).join(),
    "adv": lambda df, t, period: Daily(t.daily, df, t.anchor).adv(period).join(),
    "prev_allday": lambda df, t, col: indicators.prev_allday(df, t.allday, col, t.anchor),
    "day_open": lambda df, t: indicators.day_open(df, t.daily, anchor=t.anchor),
    "days_to_earnings": lambda df, t: fundamental.days_to_earnings(df, t.earnings),
    "days_from_earnings": lambda df, t: fundamental.days_from_earnings(df, t.earnings),
    "market_cap": lambda df, t: fundamental.market_cap(df, t.caps),
    "days_since_ipo": lambda df, t: fundamental.days_since_ipo(df, t.static),
    "shares_float": lambda df, t: listings.dated_value(df, t.shares, "shares_float"),
    "news_confidence": lambda df, t: listings.news_as_of(df, t.scores),
}


def _relative(value: Column) -> Column:
    return F.try_divide(value - F.col("prev_day_close"), F.col("prev_day_close"))


def _position(n: int) -> Column:
    low, high = F.col(f"min_low_{n}d"), F.col(f"max_high_{n}d")
    return F.when(high != low, (F.col("close") - low) / (high - low))


#: What an indicator needs of the daily spine.
DAY = {
    "daily_rolling": lambda d, n, op, col: d.rolling(n, op, col), "prev_day": lambda d, col, n=1: d.prev_day(col, n), "daily_atr": lambda d, period: d.atr(period), "adr": lambda d, period: d.adr(period),
    "adv": lambda d, period: d.adv(period), "position_in_range": lambda d, n: d.rolling(n, "min", "low").rolling(n, "max", "high"), "gap": lambda d, col: d.prev_day("close"),
    "atr_gap": lambda d, col, period: d.prev_day("close").atr(period), "daily_gap": lambda d: d.prev_day("close"), "daily_atr_gap": lambda d, period: d.prev_day("close").atr(period),
}
#: Values of a whole day from other tables.
TABLE = {
    "days_to_earnings": lambda days, t: fundamental.days_to_earnings(days, t.earnings), "days_from_earnings": lambda days, t: fundamental.days_from_earnings(days, t.earnings),
    "market_cap": lambda days, t: fundamental.market_cap(days, t.caps), "days_since_ipo": lambda days, t: fundamental.days_since_ipo(days, t.static),
    "shares_float": lambda days, t: listings.dated_value(days, t.shares, "shares_float"),
}
#: Expressions over a bar, the features of its day and the day's open (NULL before the opening).
VALUE = {
    "position_in_range": lambda o, n: {f"position_in_range_{n}d": _position(n)}, "gap": lambda o, col: {f"gap_{col}": _relative(F.col(col))},
    "atr_gap": lambda o, col, period: {f"atr_gap_{col}_{period}": F.try_divide(F.col(col) - F.col("prev_day_close"), F.col(f"daily_atr_{period}"))},
    "daily_gap": lambda o: {"daily_gap": _relative(o)}, "day_open": lambda o: {"day_open": o},
    "daily_atr_gap": lambda o, period: {f"daily_atr_gap_{period}": F.try_divide(_relative(o) * F.col("prev_day_close"), F.col(f"daily_atr_{period}"))},
}
_OPENING = ("day_open", "daily_gap", "daily_atr_gap")


def day_features(days: DataFrame, tables: Tables, wanted: list[tuple[str, dict]], opening: bool = False) -> DataFrame:
    """``symbol, date`` with what ``wanted`` needs of a whole day (and ``_open``, if ``opening``): one spine for all daily features."""
    days = days.select("symbol", "date").distinct()
    calendar = [(name, p) for name, p in wanted if name == "prev_day" and p.get("mode", "bar") != "bar"]
    daily = [(name, p) for name, p in wanted if name in DAY and (name, p) not in calendar]
    if daily or opening:
        spine = Daily(tables.daily, days, tables.anchor)
        for name, params in daily:
            DAY[name](spine, **{k: v for k, v in params.items() if k != "mode"})
        days = (spine.day_open() if opening else spine).join().withColumnsRenamed({"day_open": "_open"})
    for name in dict.fromkeys(name for name, _ in wanted if name in TABLE):
        days = TABLE[name](days, tables)
    for name, params in calendar:
        days = INDICATORS[name](days, tables, **params)
    return days


def values(wanted: list[tuple[str, dict]], day_open: Column) -> dict[str, Column]:
    return {k: v for name, params in wanted if name in VALUE for k, v in VALUE[name](day_open, **params).items()}


def indicate(df: DataFrame, tables: Tables, wanted: list[tuple[str, dict]]) -> DataFrame:
    """``df`` with the indicators of ``wanted`` (name and parameters). What holds for a whole day is computed for the days of ``df``, on one spine,
    and joined once, however many indicators are asked for."""
    for name, _ in wanted:
        if name not in INDICATORS:
            raise ValueError(f"unknown indicator {name!r}; known: {', '.join(INDICATORS)}")
    opening = any(name in _OPENING for name, _ in wanted)
    out = df
    for name, params in sorted(wanted, key=lambda w: w[0] != "atr"):
        if name not in DAY and name not in TABLE and name != "day_open":
            out = INDICATORS[name](out, tables, **params)
    if opening or any(name in DAY or name in TABLE for name, _ in wanted):
        features = day_features(df, tables, wanted, opening)
        out = out.join(features.select("symbol", "date", *[c for c in features.columns if c not in out.columns]), ["symbol", "date"], "left")
    open_ = F.when(time_of_day(F.col("ts")) >= OPEN, F.col("_open")) if opening else F.lit(None)
    return out.withColumns(values(wanted, open_)).drop("_open")
