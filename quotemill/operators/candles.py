"""Candles from trades and bars, split adjustment, trading calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.time import bucket, clock, time_of_day

OHLC = ("open", "high", "low", "close")


def trades_to_candles(trades: DataFrame, freq: str, first_seq: bool = False) -> DataFrame:
    """``symbol, ts, open, high, low, close, volume`` from ``symbol, ts, seq, price, size``; trades of one
    time are ordered by ``seq``, of which ``first_seq`` adds the smallest. One partial aggregate and one shuffle."""
    at = F.struct("ts", "seq")
    more = [F.min("seq").alias("first_seq")] if first_seq else []
    return trades.groupBy("symbol", bucket(F.col("ts"), freq).alias("bucket")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), *more
    ).withColumnRenamed("bucket", "ts")


def resample(bars: DataFrame, freq: str) -> DataFrame:
    """Coarser bars from finer ones; empty buckets do not appear."""
    return bars.groupBy("symbol", bucket(F.col("ts"), freq).alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("bucket", "ts")


def resample_multi(bars: DataFrame, freqs: list[str]) -> DataFrame:
    """Several frequencies from one scan: every bar is dealt to its bucket of each frequency."""
    to = F.explode(F.array(*[F.struct(F.lit(f).alias("freq"), bucket(F.col("ts"), f).alias("bucket")) for f in freqs])).alias("to")
    return bars.select("*", to).groupBy("symbol", F.col("to.freq").alias("freq"), F.col("to.bucket").alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("bucket", "ts")


def daily_bars(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``symbol, date, ...`` bars of whole days, or of the times in [start, end)."""
    t = time_of_day(F.col("ts"))
    if start:
        bars = bars.filter((t >= clock(start)) & (t < clock(end)))
    return resample(bars, "1d").withColumn("date", F.to_date("ts")).drop("ts")


def session_filter(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars whose time of day lies in [start, end]."""
    return bars.filter(time_of_day(F.col("ts")).between(clock(start), clock(end)))


def split_adjust(bars: DataFrame, splits: DataFrame, to) -> DataFrame:
    """Prices before a split's execution date times from / to, for splits executed up to ``to``; volume is left.

    The product over later splits is a running product per symbol, found by an as-of lookup, so bars are
    never multiplied by splits."""
    s = splits.filter(F.col("execution_date") <= F.lit(to)).groupBy("symbol", "execution_date").agg(F.product(F.col("split_from") / F.col("split_to")).alias("l"))
    w = Window.partitionBy("symbol").orderBy(F.desc("execution_date")).rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("symbol", F.date_sub("execution_date", 1).alias("date"), F.product("l").over(w).alias("l"))
    from quotemill.operators.blocks import asof_join

    out = asof_join(bars, s, {"l": "_l"}, forward=True)
    factor = F.coalesce("_l", F.lit(1.0))
    return out.select(*[(F.col(c) * factor).alias(c) if c in OHLC else F.col(c) for c in bars.columns])


def trading_calendar(spark, first: str, last: str, holidays: list[str]) -> DataFrame:
    """``date, is_session, tdx``: weekdays that are no holiday, with their running number."""
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS date")
    open_ = (F.weekday("date") < 5) & ~F.col("date").cast("string").isin(holidays)
    days = days.withColumn("is_session", open_)
    return days.withColumn("tdx", F.sum(F.col("is_session").cast("long")).over(Window.orderBy("date")))  # a calendar is some thousand rows


def session_offset(dates: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """``date, session``: the n-th session after each date (negative: before); n = 0 gives the date."""
    if n == 0:
        return dates.select("date", F.col("date").alias("session"))
    sessions = F.broadcast(calendar.filter("is_session").select(F.col("date").alias("session"), F.col("tdx").alias("to")))  # one row a day
    own = F.broadcast(calendar.select("date", "tdx", "is_session"))
    base = F.col("tdx") + n + F.when(F.col("is_session") | F.lit(n > 0), 0).otherwise(1)
    return dates.join(own, "date").withColumn("to", base).join(sessions, "to", "left").select("date", "session")


def market_open(df: DataFrame, calendar: DataFrame, ts: str = "ts") -> DataFrame:
    """``is_open``: a session day of the calendar, from 04:00 up to 20:00; days outside of the calendar are closed."""
    days = F.broadcast(calendar.select(F.col("date").alias("_day"), F.col("is_session").alias("_open")))  # one row a day
    out = df.join(days, F.to_date(ts) == F.col("_day"), "left")
    t = time_of_day(F.col(ts))
    return out.withColumn("is_open", F.coalesce(F.col("_open"), F.lit(False)) & (t >= clock("04:00")) & (t < clock("20:00"))).drop("_day", "_open")


def next_time(df: DataFrame, calendar: DataFrame, at: str, ts: str = "ts") -> DataFrame:
    """``next_at``: the next session's time ``at`` (HH:MM) after ``ts``, on its own day if that is a session and the time still to come."""
    following = session_offset(df.select(F.to_date(ts).alias("date")).distinct(), calendar, 1)
    days = F.broadcast(calendar.join(following, "date").select(F.col("date").alias("_day"), "is_session", "session"))  # one row a day
    day = F.when(F.col("is_session") & (time_of_day(F.col(ts)) < clock(at)), F.to_date(ts)).otherwise(F.col("session"))
    out = df.join(days, F.to_date(ts) == F.col("_day"), "left")
    return out.withColumn("next_at", day.cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(clock(at)))).drop("_day", "is_session", "session")


def normalise_bars(raw: DataFrame, freq: str) -> DataFrame:
    """Vendor bars (``symbol``, epoch milliseconds ``t`` and ``o, h, l, c, v``) as candles: the first bar of every bucket
    that has an open."""
    ts = F.timestamp_millis("t").cast("timestamp_ntz")
    named = raw.select("symbol", ts.alias("ts"), *[F.col(k).cast("double").alias(n) for k, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)])
    first = F.min_by(F.struct("open", "high", "low", "close", "volume"), "ts").alias("bar")
    out = named.filter("open IS NOT NULL").groupBy("symbol", bucket(F.col("ts"), freq).alias("bucket")).agg(first)
    return out.select("symbol", F.col("bucket").alias("ts"), "bar.*")
