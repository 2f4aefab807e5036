"""Audit of streamed candles against source candles, by (symbol, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")


def missing_streams(stream: DataFrame, source: DataFrame) -> DataFrame:
    """``symbol, date``: days with source bars and no streamed one."""
    days = lambda df: df.select("symbol", F.to_date("ts").alias("date")).distinct()
    return days(source).join(days(stream), ["symbol", "date"], "left_anti")


def source_issues(stream: DataFrame, source: DataFrame, wanted: DataFrame, unreadable_stream: DataFrame | None = None, unreadable_source: DataFrame | None = None) -> DataFrame:
    """``symbol, issue_type`` of the ``wanted`` symbols whose bars could not be compared: no streamed bars, no source bars in the
    streamed range (of any time without streamed ones), or rows that could not be read (the second result of ``storage.read_bars``)."""
    present = stream.select("symbol").distinct()
    usable = in_stream_range(stream, source).select("symbol").union(source.join(present, "symbol", "left_anti").select("symbol")).distinct()
    kinds = {"MISSING_REALTIME_DATA": wanted.join(present, "symbol", "left_anti"), "EMPTY_SOURCE_DATA": wanted.join(usable, "symbol", "left_anti")}
    for kind, rows in (("ERROR_READING_REALTIME", unreadable_stream), ("ERROR_READING_SOURCE", unreadable_source)):
        if rows is not None:
            kinds[kind] = wanted.join(rows.select("symbol").distinct(), "symbol", "left_semi")
    parts = [df.select("symbol", F.lit(kind).alias("issue_type")).distinct() for kind, df in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_stream_range(stream: DataFrame, source: DataFrame) -> DataFrame:
    """Source rows between the first and last streamed time of their symbol."""
    ends = stream.groupBy("symbol").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return source.join(ends, "symbol").filter("ts BETWEEN _a AND _b").drop("_a", "_b")


def duplicates(df: DataFrame) -> DataFrame:
    """``symbol, n_rows, n_times``: rows in repeated times."""
    d = df.groupBy("symbol", "ts").count().filter("count > 1")
    return d.groupBy("symbol").agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_times"))


def missing_extra(stream: DataFrame, source: DataFrame) -> DataFrame:
    """``symbol, ts, issue_type``: MISSING in the stream or EXTRA there."""
    a, b = stream.select("symbol", "ts").distinct(), in_stream_range(stream, source).select("symbol", "ts").distinct()
    return b.join(a, ["symbol", "ts"], "left_anti").withColumn("issue_type", F.lit("MISSING")).unionByName(a.join(b, ["symbol", "ts"], "left_anti").withColumn("issue_type", F.lit("EXTRA")))


def _first(df: DataFrame) -> DataFrame:
    at = "seq" if "seq" in df.columns else "ts"
    return df.groupBy("symbol", "ts").agg(F.min_by(F.struct(*FIELDS), at).alias("v")).select("symbol", "ts", "v.*")


def ohlcv_mismatch(stream: DataFrame, source: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``symbol, ts, field, realtime, source`` where a field differs or one side is NULL."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in FIELDS])).alias("p")
        return _first(df).select("symbol", "ts", pairs).select("symbol", "ts", "p.*")

    both = tall(stream, "realtime").join(tall(source, "source"), ["symbol", "ts", "field"])
    return both.filter(F.coalesce(F.abs(F.col("realtime") - F.col("source")) > tolerance, F.col("realtime").isNull() != F.col("source").isNull()))


def unsorted(df: DataFrame, arrival: str = "seq") -> DataFrame:
    """``symbol, n_violations``: rows that arrive after a later time."""
    return unsorted_rows(df, arrival).groupBy("symbol").agg(F.count("*").alias("n_violations"))


def unsorted_rows(df: DataFrame, arrival: str = "seq", stretch: int = 1 << 20) -> DataFrame:
    """Rows whose predecessor in the order of arrival is later. The order runs inside stretches of arrival numbers; the time
    before a stretch is the last one of the stretch before it."""
    df = df.withColumn("_s", F.floor(F.col(arrival) / stretch))
    last = df.groupBy("symbol", "_s").agg(F.max_by("ts", arrival).alias("_last"))
    last = last.select("symbol", "_s", F.lag("_last").over(Window.partitionBy("symbol").orderBy("_s")).alias("_last"))
    before = F.lag("ts").over(Window.partitionBy("symbol", "_s").orderBy(arrival))
    return df.withColumn("_b", before).join(last, ["symbol", "_s"]).filter("coalesce(_b, _last) > ts").drop("_s", "_b", "_last")


def issue_counts(stream: DataFrame, source: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``symbol, date, issue_type, n``: the issues of all audits by day, from one comparison of the two sides: each is
    aggregated by ``symbol, ts`` once, and a full join sets them side by side."""
    seq = "seq" if "seq" in stream.columns else "ts"
    a = stream.groupBy("symbol", "ts").agg(F.count("*").alias("n"), F.min_by(F.struct(*FIELDS), seq).alias("a"))
    b = source.groupBy("symbol", "ts").agg(F.min_by(F.struct(*FIELDS), "seq" if "seq" in source.columns else "ts").alias("b"))
    ends = stream.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    both = a.join(b, ["symbol", "ts"], "full").join(ends, "symbol", "left")
    differs = lambda f: F.coalesce(F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) > tolerance, F.col(f"a.{f}").isNull() != F.col(f"b.{f}").isNull()).cast("int")
    here, there = F.col("a").isNotNull(), F.col("b").isNotNull()
    days = both.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.count_if(F.col("n") > 1).alias("DUPLICATE"), F.sum(F.when(here & there, sum((differs(f) for f in FIELDS), F.lit(0))).otherwise(0)).alias("MISMATCH"),
        F.count_if(~here & F.col("ts").between(F.col("first"), F.col("last"))).alias("MISSING"), F.count_if(~there).alias("EXTRA"), (~F.bool_or(here)).cast("long").alias("MISSING_STREAM"),
    )
    kinds = ["DUPLICATE", "MISMATCH", "MISSING", "EXTRA", "MISSING_STREAM"]
    rows = days.select("symbol", "date", F.explode(F.array(*[F.struct(F.lit(k).alias("issue_type"), F.col(k).cast("long").alias("n")) for k in kinds])).alias("e")).select("symbol", "date", "e.*").filter("n > 0")
    if seq == "ts":
        return rows
    late = unsorted_rows(stream, seq).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    return rows.unionByName(late.select("symbol", "date", F.lit("UNSORTED").alias("issue_type"), "n"))


def issue_summary(counts: DataFrame) -> DataFrame:
    """``issue_type, n, symbols``: issues and symbols that have one."""
    return counts.groupBy("issue_type").agg(F.sum("n").alias("n"), F.count_distinct("symbol").alias("symbols"))


def duplicate_times(df: DataFrame) -> DataFrame:
    """``symbol, ts, n``: the repeated times themselves."""
    return df.groupBy("symbol", "ts").agg(F.count("*").alias("n")).filter("n > 1")


def issue_details(rows: DataFrame, keep: int = 20) -> DataFrame:
    """The first ``keep`` issues of each symbol and type in the order of ``ts``, for a report that is to be read."""
    order = Window.partitionBy("symbol", "issue_type").orderBy("ts")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= keep)


def arrival_spread(arrivals: DataFrame, seconds: int) -> DataFrame:
    """Per bar start ``ts``: seconds from the bar's end to its first arrival, and from that to its last. Arrivals after the
    first one of a newer bar of the day are of an older bar and ignored."""
    first = arrivals.groupBy("ts").agg(F.min("arrived").alias("first"))
    newer = F.min("first").over(Window.partitionBy(F.to_date("ts")).orderBy("ts").rowsBetween(1, Window.unboundedFollowing))
    bounds = first.withColumn("until", newer)  # a row for each bar start, not for each arrival
    kept = arrivals.join(bounds, "ts").filter("until IS NULL OR arrived < until").groupBy("ts").agg(F.min("arrived").alias("first"), F.max("arrived").alias("last"))
    at = lambda c: F.unix_timestamp(c)
    return kept.select("ts", (at("first") - at("ts") - seconds).alias("delay_s"), (at("last") - at("first")).alias("spread_s"))


def delivery_latency(processed: DataFrame, seconds: int = 60) -> DataFrame:
    """Per minute: seconds from its end until its last bar was processed, bars, and the median and 95th percentile of all."""
    late = F.unix_timestamp("processed") - F.unix_timestamp("ts") - seconds
    return processed.groupBy("ts").agg(F.max(late).alias("last_s"), F.count("*").alias("n"), F.percentile(late, 0.5).alias("median_s"), F.percentile(late, 0.95).alias("p95_s"))
