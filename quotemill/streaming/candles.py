"""Streaming candles, scans and monitors on the batch definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "20 seconds"
UNITS = {"A": "s", "AM": "min"}  # fixed values: the feed's kinds of aggregates


def trade_stream(spark, sf_dir: str, schema) -> DataFrame:
    """Trades read as a stream of files. Event time must be a timestamp for watermarks."""
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    size = F.get_json_object("props", "$.k").cast("long") + 1
    return e.select((F.col("user_id") % 10).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), size.alias("size"))


def candle_events(events: DataFrame) -> DataFrame:
    """Vendor events as candles with ``unit``: those with a start time (``start_ms``, epoch milliseconds) and of a known kind."""
    unit = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])[F.col("event_type")]
    named = events.withColumn("unit", unit).filter("unit IS NOT NULL AND start_ms IS NOT NULL")
    return named.select("symbol", F.timestamp_millis("start_ms").alias("ts"), "open", "high", "low", "close", "volume", "unit")


def rebucket(trades: DataFrame, freq: str, late: str = LATE) -> DataFrame:
    """Tumbling bars, emitted once the watermark has passed the bucket's end; later rows are dropped.
    ``freq`` in Spark's words (``15 minutes``)."""
    at = F.struct("ts", "seq")
    out = trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", freq).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def write_candles(bars: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append bars to a table partitioned by date, and by frequency before it if they have ``freq``."""
    by = [c for c in ("freq",) if c in bars.columns] + ["date"]
    out = bars.withColumn("date", F.to_date("ts")).writeStream.outputMode("append").partitionBy(*by)
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()
