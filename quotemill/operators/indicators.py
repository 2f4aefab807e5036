"""Indicators over candles of all symbols at once.

Intraday frames have ``symbol, ts, date`` and bars; daily frames ``symbol, date`` and bars. Daily features are
windows on the spine with one partitioning by symbol, joined once to the target. Previous values are of the
previous available bar. Division by zero gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.time import clock, time_of_day
from quotemill.operators.blocks import average_range, ewm_mean, spine, true_range
from quotemill.operators.candles import daily_bars, session_offset

NAMES = {"min": "lowest", "max": "highest", "sum": "total"}
OPEN = clock("09:30")


def _day() -> Window:
    return Window.partitionBy("symbol", "date").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)


def cumulative(df: DataFrame, col: str, op: str, name: str | None = None) -> DataFrame:
    """Running minimum, maximum or sum of the day."""
    return df.withColumn(name or f"{NAMES[op]}_{col}", getattr(F, op)(col).over(_day()))


def cumulative_daily_volume(df: DataFrame) -> DataFrame:
    return cumulative(df, "volume", "sum", "cumulative_daily_volume")


def premarket_cumulative(df: DataFrame, col: str, op: str) -> DataFrame:
    """Running value of the bars before 09:30, carried through the day; NULL on days without one."""
    early = F.when(time_of_day(F.col("ts")) < OPEN, F.col(col))
    return df.withColumn(f"premarket_{NAMES[op]}_{col}", getattr(F, op)(early).over(_day()))


def atr(df: DataFrame, period: int, freq: str = "1min") -> DataFrame:
    """Average true range over the bars of a symbol; bars of another frequency than 1min have it in the column's name."""
    return average_range(df, period, f"atr_{period}" if freq == "1min" else f"atr_{period}_{freq}", F.date_trunc("month", "ts"))


def shift(df: DataFrame, col: str, n: int) -> DataFrame:
    """The value n bars ago in the same day."""
    return df.withColumn(f"{col}_shift_{n}", F.lag(col, n).over(Window.partitionBy("symbol", "date").orderBy("ts")))


class Daily:
    """Features of the spine, collected and joined to a target once.

    >>> Daily(daily, bars).prev_day("close").adv(14).join()

    ``anchor`` is the first date that counts; None takes all history.
    """

    def __init__(self, daily: DataFrame, target: DataFrame, anchor=None):
        daily = daily if anchor is None else daily.filter(F.col("date") >= F.lit(anchor))
        self.target, self.frame, self.names = target, spine(daily, target), []
        self.order = Window.partitionBy("symbol").orderBy("date")

    def _add(self, name: str, value: Column) -> Daily:
        if name not in self.names:
            self.frame = self.frame.withColumn(name, value)
            self.names.append(name)
        return self

    def prev_day(self, col: str, n: int = 1) -> Daily:
        return self._add(f"prev_{'' if n == 1 else n}day_{col}", F.lag(col, n).over(self.order))

    def rolling(self, n: int, op: str, col: str) -> Daily:
        """Over the n bars before."""
        return self._add(f"{op}_{col}_{n}d", getattr(F, op)(col).over(self.order.rowsBetween(-n, -1)))

    def adr(self, period: int) -> Daily:
        return self._add(f"adr_{period}", F.avg(F.try_divide(F.col("high") - F.col("low"), F.col("close"))).over(self.order.rowsBetween(-period, -1)))

    def adv(self, period: int) -> Daily:
        return self._add(f"adv_{period}", F.avg("volume").over(self.order.rowsBetween(-period, -1)))

    def atr(self, period: int) -> Daily:
        name = f"daily_atr_{period}"
        if name not in self.names:
            f = self.frame.withColumn("_tr", F.when(F.col("high").isNotNull(), true_range(F.col("high"), F.col("low"), F.lag("close").over(self.order))))
            f = ewm_mean(f, F.col("_tr"), period, "_ewm", ["symbol"], ["date"])
            self.frame = f.withColumn(name, F.lag("_ewm").over(self.order)).drop("_tr", "_ewm")
            self.names.append(name)
        return self

    def day_open(self) -> Daily:
        return self._add("day_open", F.col("open"))

    def join(self) -> DataFrame:
        """The target with the features it does not have yet."""
        new = [n for n in self.names if n not in self.target.columns]
        return self.target.join(self.frame.select("symbol", "date", *new), ["symbol", "date"], "left") if new else self.target


def prev_session(df: DataFrame, daily: DataFrame, col: str, calendar: DataFrame, n: int = 1) -> DataFrame:
    """As ``prev_day``, of exactly the n-th session before in the calendar; NULL if the symbol has no bar there."""
    back = F.broadcast(session_offset(df.select("date").distinct(), calendar, -n))  # one row a date
    days = daily.select("symbol", F.col("date").alias("session"), F.col(col).alias(f"prev_{'' if n == 1 else n}day_{col}"))
    return df.join(back, "date", "left").join(days, ["symbol", "session"], "left").drop("session")


def gap(df: DataFrame, daily: DataFrame, col: str, anchor=None) -> DataFrame:
    """(value - previous close) / previous close."""
    df = Daily(daily, df, anchor).prev_day("close").join()
    return df.withColumn(f"gap_{col}", F.try_divide(F.col(col) - F.col("prev_day_close"), F.col("prev_day_close")))


def atr_gap(df: DataFrame, daily: DataFrame, col: str, period: int, anchor=None) -> DataFrame:
    """The gap in units of the daily average true range."""
    df = Daily(daily, df, anchor).prev_day("close").atr(period).join()
    return df.withColumn(f"atr_gap_{col}_{period}", F.try_divide(F.col(col) - F.col("prev_day_close"), F.col(f"daily_atr_{period}")))


def _opening_gap(days: Daily, intraday: bool) -> tuple[DataFrame, Column]:
    """The target with the features of ``days``, and the gap of the day's open, unknown before 09:30."""
    kept = [c for c in days.target.columns if c == "day_open"]
    days.target = days.target.withColumnsRenamed({"day_open": "_day_open"})
    df = days.prev_day("close").day_open().join()
    value = F.try_divide(F.col("day_open") - F.col("prev_day_close"), F.col("prev_day_close"))
    df = df.withColumn("daily_gap", F.when(time_of_day(F.col("ts")) >= OPEN, value) if intraday else value).drop("day_open")
    return (df.withColumnsRenamed({"_day_open": "day_open"}) if kept else df), F.col("daily_gap")


def daily_gap(df: DataFrame, daily: DataFrame, intraday: bool = True, anchor=None) -> DataFrame:
    """(day's open - previous close) / previous close, unknown before 09:30."""
    return _opening_gap(Daily(daily, df, anchor), intraday)[0]


def daily_atr_gap(df: DataFrame, daily: DataFrame, period: int, anchor=None) -> DataFrame:
    """The day's gap in units of the daily average true range; one spine serves both."""
    out, value = _opening_gap(Daily(daily, df, anchor).atr(period), True)
    return out.withColumn(f"daily_atr_gap_{period}", F.try_divide(value * F.col("prev_day_close"), F.col(f"daily_atr_{period}")))


def day_open(df: DataFrame, daily: DataFrame, anchor=None) -> DataFrame:
    df = Daily(daily, df.drop("day_open"), anchor).day_open().join()
    return df.withColumn("day_open", F.when(time_of_day(F.col("ts")) >= OPEN, F.col("day_open")))


def position_in_range(df: DataFrame, daily: DataFrame, n: int, anchor=None) -> DataFrame:
    """Where the close lies between the lowest low and highest high of the n days before."""
    df = Daily(daily, df, anchor).rolling(n, "min", "low").rolling(n, "max", "high").join()
    low, high = F.col(f"min_low_{n}d"), F.col(f"max_high_{n}d")
    return df.withColumn(f"position_in_range_{n}d", F.when(high != low, (F.col("close") - low) / (high - low)))


def prev_allday(df: DataFrame, bars: DataFrame, col: str, anchor=None) -> DataFrame:
    """Previous day's value over all sessions."""
    days = Daily(daily_bars(bars), df.select("symbol", "date").distinct(), anchor).prev_day(col).join()
    return df.join(days.withColumnRenamed(f"prev_day_{col}", f"prev_allday_{col}"), ["symbol", "date"], "left")
