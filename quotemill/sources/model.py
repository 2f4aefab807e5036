"""The market-data model over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.candles import daily_bars, trades_to_candles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    size = F.get_json_object("props", "$.k").cast("long") + 1
    return e.select((F.col("user_id") % 10).alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), size.alias("size"))


def bars(spark: SparkSession, sf_dir: str, freq: str = "1h") -> DataFrame:
    return trades_to_candles(trades(spark, sf_dir), freq).withColumn("date", F.to_date("ts"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular-session days."""
    return daily_bars(trades_to_candles(trades(spark, sf_dir), "30min"), "09:30", "16:00")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily history: bars of line items by supplier and ship date."""
    li = table(spark, sf_dir, "lineitem")
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum("l_quantity").alias("volume")
    )


def market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 100).alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("value"))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return o.select((F.col("o_custkey") % 100).alias("symbol"), F.to_date("o_orderdate").alias("date")).distinct()


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.min(F.to_date("l_shipdate")).alias("first"))
    return first.select("symbol", F.date_add("first", F.col("symbol").cast("int")).alias("ipo_date"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and reverse splits from all of part: some twenty a supplier, of which several may fall on one date."""
    p, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    date = F.date_add(F.lit("1993-01-01").cast("date"), (F.col("p_size") % 25 * 100).cast("int"))
    return p.crossJoin(F.broadcast(n)).select((F.col("p_partkey") % F.col("n") + 1).alias("symbol"), date.alias("execution_date"), (F.col("p_size") % 3 + 1).alias("split_from"), (F.col("p_partkey") % 4 + 1).alias("split_to"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return d.select((F.col("doc_id") % 50).alias("symbol"), "source", F.col("text").alias("title"), at.alias("published_at"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars as a stream might have delivered them: some lost, changed, or delivered twice."""
    b = trades_to_candles(trades(spark, sf_dir), "1h", first_seq=True).withColumnRenamed("first_seq", "seq").filter("seq % 17 <> 0")
    b = b.withColumn("close", F.when(F.col("seq") % 23 == 0, F.col("close") + 1).otherwise(F.col("close")))
    again = F.when(F.col("seq") % 29 == 0, F.array("seq", F.col("seq") + 1_000_000_000)).otherwise(F.array("seq"))
    return b.select(*[c for c in b.columns if c != "seq"], F.explode(again).alias("seq"))
