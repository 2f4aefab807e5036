"""Bars on disk, partitioned by frequency and period, and exported reports."""

from __future__ import annotations

import datetime
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.time import key_range, partition_key
from quotemill.operators.candles import resample, resample_multi, split_adjust
from quotemill.operators.listings import expired_partitions

BARS = "symbol long, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; without it only a session on one machine gets one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder, for plans that read them more than once."""
    path = f"{shared_folder(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_bars(bars: DataFrame, path: str, freqs: list[str], files: int = 8, fmt: str = "parquet") -> None:
    """``bars`` (with ``freq``) under ``freq=/key=``. Only partitions that ``bars`` touches are replaced. Every
    partition has at most ``files`` files, dealt by symbol and sorted, so one symbol's range reads few row groups."""
    key = F.coalesce(*[F.when(F.col("freq") == f, partition_key(F.col("ts"), f)) for f in freqs])
    out = bars.filter(F.col("freq").isin(freqs)).withColumn("key", key).withColumn("_file", F.pmod(F.xxhash64("symbol"), F.lit(files)))
    out = out.repartition("freq", "key", "_file").sortWithinPartitions("freq", "key", "symbol", "ts").drop("_file")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("freq", "key").format(fmt).save(path)


def bucketed_table(bars: DataFrame, name: str, buckets: int = 64, order: str = "ts") -> None:
    """``bars`` as the table ``name``, one sorted file a bucket of symbols. With ``spark.sql.requireAllClusterKeysForCoPartition`` false, scans join
    their days and run their windows by day on it without shuffling a bar."""
    bars.repartition(buckets, "symbol").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", order).saveAsTable(name)


def backfill(bars: DataFrame, path: str, freqs: list[str], first, end) -> None:
    """All frequencies for all symbols over [first, end), in one scan of the base bars."""
    write_bars(resample_multi(bars.filter((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(end))), freqs), path, freqs)


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = BARS) -> tuple[DataFrame, DataFrame]:
    """``bars, bad``: readable bars, and the text rows that do not fit the schema, with what was read of ``symbol`` (their partitions are to be
    fetched again). Corrupt Parquet files are passed over; ``BarStore.damaged`` names what they held."""
    columns = f"{schema}, freq string, key string"
    if fmt == "parquet":
        df = spark.read.schema(columns).option("ignoreCorruptFiles", True).parquet(path)
        return df, df.filter("false").select("freq", "key", "symbol").withColumn("_bad", F.lit(None).cast("string"))
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}")
    # Spark's reader judges a row by the columns a query reads; parsing the whole line judges it alike for all.
    row = F.from_csv("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.schema("value string, freq string, key string").text(path).select(row.alias("row"), "freq", "key")
    df = lines.select("row.*", "freq", "key")
    return df.filter("_bad IS NULL").drop("_bad"), df.filter("_bad IS NOT NULL").select("freq", "key", "symbol", "_bad")


def read_range(spark: SparkSession, path: str, symbols: list | None, first: datetime.date, last: datetime.date, freq: str, splits: DataFrame | None = None, today: datetime.date | None = None) -> DataFrame:
    """Bars of ``freq`` of the local dates from ``first`` to ``last``, both included; of all symbols if None, adjusted if ``splits`` are
    given. Days that are not over raise ValueError. Partitions are pruned by frequency and key, row groups by symbol and time."""
    today = today or datetime.date.today()
    if last > today - datetime.timedelta(days=1):
        raise ValueError(f"bars end on {today - datetime.timedelta(days=1)}, {last} is asked for")
    keys = spark.range(1).select(*[partition_key(F.lit(d), freq).alias(n) for n, d in (("a", first), ("b", last))]).first()
    bars, _ = read_bars(spark, path)
    out = bars.filter((F.col("freq") == freq) & F.col("key").between(keys["a"], keys["b"]))
    after = datetime.datetime.combine(last, datetime.time()) + datetime.timedelta(days=1)
    out = out.filter((F.col("ts") >= F.lit(datetime.datetime.combine(first, datetime.time())).cast("timestamp_ntz")) & (F.col("ts") < F.lit(after).cast("timestamp_ntz")))
    if symbols is not None:
        out = out.filter(F.col("symbol").isin(symbols))
    out = out.withColumn("date", F.to_date("ts"))
    return out if splits is None else split_adjust(out, splits, today)


def refresh(bars: DataFrame, path: str, freq: str, manifest: DataFrame, today: datetime.date) -> DataFrame:
    """Write anew, from base bars, the partitions ``symbol, key`` of one frequency that are missing in ``manifest`` (``symbol, key,
    expires``), expired, or a symbol's newest. The manifest as of now; an open partition expires tomorrow, a closed one never.

    A key's folder is replaced as a whole, so all symbols of a key with an expired partition are computed again."""
    wanted = bars.select("symbol", partition_key(F.col("ts"), freq).alias("key")).distinct()
    newest = wanted.groupBy("symbol").agg(F.max("key").alias("key"))
    keys = expired_partitions(wanted, manifest, today).union(newest).select("key").distinct()
    due = bars.withColumn("_key", partition_key(F.col("ts"), freq)).join(keys.withColumnRenamed("key", "_key"), "_key", "left_semi").drop("_key")
    write_bars(resample(due, freq).withColumn("freq", F.lit(freq)), path, [freq])
    open_ = key_range(F.col("key"), freq)[1] >= F.lit(today)
    return wanted.withColumn("expires", F.when(open_, F.lit(today + datetime.timedelta(days=1))))


def export_calculation(frame: DataFrame, path: str, ts: str = "ts", zone: str = "America/New_York") -> None:
    """A frame as CSV with a header, its local times in UTC and without a zone."""
    utc = F.date_format(F.to_utc_timestamp(F.col(ts).cast("timestamp_ntz").cast("string"), zone), "yyyy-MM-dd HH:mm:ss")
    frame.withColumn(ts, utc).write.mode("errorifexists").option("header", True).csv(path)


def export_report(report: DataFrame, folder: str, run: str | None = None) -> str:
    """``report`` as CSV in a folder of its own below ``folder``; an existing report is never overwritten."""
    path = f"{folder}/run={run or uuid.uuid4().hex}"
    report.write.mode("errorifexists").option("header", True).csv(path)
    return path
