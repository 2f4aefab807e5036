"""Fundamental and news features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.blocks import asof_join


def days_to_earnings(df: DataFrame, earnings: DataFrame) -> DataFrame:
    """Days to the next earnings date, the date itself included; NULL without one."""
    e = earnings.select("symbol", "date", F.col("date").alias("earnings_date"))
    return asof_join(df, e, {"earnings_date": "_e"}, forward=True).withColumn("days_to_earnings", F.datediff("_e", "date")).drop("_e")


def days_from_earnings(df: DataFrame, earnings: DataFrame) -> DataFrame:
    e = earnings.select("symbol", "date", F.col("date").alias("earnings_date"))
    return asof_join(df, e, {"earnings_date": "_e"}).withColumn("days_from_earnings", F.datediff("date", "_e")).drop("_e")


def market_cap(df: DataFrame, caps: DataFrame) -> DataFrame:
    """Last market cap known at the date."""
    return asof_join(df, caps, {"value": "market_cap"})


def days_since_ipo(df: DataFrame, static: DataFrame) -> DataFrame:
    """Whole days since the listing; NULL if unknown or in the future."""
    days = F.datediff("date", "ipo_date")
    return df.join(static.select("symbol", "ipo_date"), "symbol", "left").withColumn("days_since_ipo", F.when(days >= 0, days)).drop("ipo_date")


def round_robin(headlines: DataFrame, cap: int = 50) -> DataFrame:
    """At most ``cap`` headlines a symbol, taken in turns: the first of every source, then the second, ..."""
    turn = F.row_number().over(Window.partitionBy("symbol", "source").orderBy("published_at", "title"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("turn", "source"))
    return headlines.withColumn("turn", turn).withColumn("place", place).filter(F.col("place") <= cap)


def round_robin_by(headlines: DataFrame, sources: list[str], cap: int = 50) -> DataFrame:
    """As ``round_robin``, with the turns in the order of ``sources``; others come after them, by name."""
    known = F.array_position(F.array(*map(F.lit, sources)), F.coalesce("source", F.lit("")))
    turn = F.row_number().over(Window.partitionBy("symbol", "source").orderBy("published_at", "title"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("turn", F.when(known > 0, known).otherwise(len(sources) + 1), "source"))
    return headlines.withColumn("turn", turn).withColumn("place", place).filter(F.col("place") <= cap)


def score_thresholds(scores: DataFrame, thresholds: tuple[int, ...] = (50, 75, 90)) -> DataFrame:
    """Scored headlines of each source at or above every threshold, and how many are kept (above 50)."""
    return scores.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 50).alias("kept"), *[F.count_if(F.col("score") >= t).alias(f"ge_{t}") for t in thresholds])
