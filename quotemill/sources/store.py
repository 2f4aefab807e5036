"""Stored bars with a manifest, and the sink of a stream.

``BarStore`` keeps bars of one frequency under ``data/key=/bucket=/version=``; a bucket has the symbols of one hash. The manifest says
by symbol and key which version counts, how many rows it has, a checksum of them, and when it expires. A refresh writes new versions of the buckets that are due, then a new
manifest: a folder that is there or not, so readers see the old or the new state and never a mix.

``write_once`` appends the batches of a stream so that a batch that is tried again replaces itself; ``compact`` joins the small files of
days, and readers count every row once before, during and after it."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions.time import key_range, partition_key
from quotemill.operators.candles import resample
from quotemill.operators.listings import expired_partitions

_DATA = "symbol long, ts timestamp_ntz, open double, high double, low double, close double, volume long"
_COLUMNS = [c.split(" ")[0] for c in _DATA.split(", ")]
_MANIFEST = "symbol long, key string, bucket int, version int, n long, checksum long, expires date"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, fs = _files(spark, path)
    return fs.exists(where)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders ``prefix<number>`` below ``path``."""
    where, fs = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


@dataclass(frozen=True)
class BarStore:
    """Bars of ``freq`` under ``path``, in ``buckets`` buckets a key."""

    spark: SparkSession
    path: str
    freq: str
    buckets: int = 16

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("symbol"), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The newest complete manifest; 0 if there is none."""
        done = [v for v in _numbers(self.spark, f"{self.path}/manifest", "version=") if self._complete(v)]
        return max(done, default=0)

    def _complete(self, version: int) -> bool:
        return _exists(self.spark, f"{self.path}/manifest/version={version}/_SUCCESS")

    def manifest(self, version: int | None = None) -> DataFrame:
        """``symbol, key, bucket, version, n, checksum, expires`` of what counts (now, or as of a manifest)."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST.replace("version int", "version_ int")).parquet(f"{self.path}/manifest/version={version}").withColumnRenamed("version_", "version")

    def read(self) -> DataFrame:
        """The bars that count, with ``key`` and ``bucket``. Files that cannot be read are an error: see ``damaged``."""
        return self._counted(False)

    def _counted(self, skip: bool) -> DataFrame:
        """The folders that the manifest counts, no others: older versions may be damaged. With ``skip``, what cannot be read gives no rows."""
        live = self.manifest().select("key", "bucket", "version").distinct().collect()  # a name a folder: keys times buckets
        folders = [f"{self.path}/data/key={r['key']}/bucket={r['bucket']}/version={r['version']}" for r in live]
        if skip:
            folders = [f for f in folders if _exists(self.spark, f)]
        schema = f"{_DATA}, key string, bucket int, version int"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").option("ignoreCorruptFiles", skip).parquet(*folders)

    def _sums(self, bars: DataFrame) -> DataFrame:
        return bars.groupBy("symbol", "key", "bucket", "version").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*_COLUMNS)).alias("checksum"))

    def damaged(self, deep: bool = False) -> DataFrame:
        """``symbol, key, bucket, version, wanted, found``: what the manifest counts and the files do not have any more. Tasks read the files, each for itself; a truncated or
        missing one gives no rows. ``deep`` compares the checksums of the rows as well, which finds values that changed."""
        found = self._sums(self._counted(True)).withColumnsRenamed({"n": "found", "checksum": "_sum"})
        both = self.manifest().join(found, ["symbol", "key", "bucket", "version"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
        bad = F.col("found") != F.col("n")
        bad = bad | ~F.col("_sum").eqNullSafe(F.col("checksum")) if deep else bad
        return both.filter(bad).select("symbol", "key", "bucket", "version", F.col("n").alias("wanted"), "found")

    def due(self, bars: DataFrame, today: datetime.date) -> DataFrame:
        """``symbol, key`` to be computed again: not stored yet, expired, or a symbol's newest."""
        wanted = bars.select("symbol", partition_key(F.col("ts"), self.freq).alias("key")).distinct()
        newest = wanted.groupBy("symbol").agg(F.max("key").alias("key"))
        return expired_partitions(wanted, self.manifest(), today).unionByName(newest).distinct()

    def refresh(self, bars: DataFrame, today: datetime.date, again: DataFrame | None = None) -> DataFrame:
        """Compute from base bars what is due (or ``again``: rows ``symbol, key``, as ``damaged`` gives them) and return the new manifest. The buckets that hold
        a due symbol are written as a new version, all others stay as they are. An open key expires tomorrow, a closed one never."""
        old, version = self.manifest(), self.version() + 1
        due = (self.due(bars, today) if again is None else again.select("symbol", "key")).withColumn("bucket", self.bucket()).select("key", "bucket").distinct()
        base = bars.withColumn("key", partition_key(F.col("ts"), self.freq)).withColumn("bucket", self.bucket())
        fresh = resample(base.join(due, ["key", "bucket"], "left_semi"), self.freq).select(*[F.col(c).cast(t) for c, t in (f.split(" ") for f in _DATA.split(", "))])
        fresh = fresh.withColumns({"key": partition_key(F.col("ts"), self.freq), "bucket": self.bucket(), "version": F.lit(version)})
        out = fresh.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "symbol", "ts")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key", "bucket", "version").parquet(f"{self.path}/data")
        folders = [f"{self.path}/data/key={r['key']}/bucket={r['bucket']}/version={version}" for r in due.collect()]
        folders = [f for f in folders if _exists(self.spark, f)]
        schema = f"{_DATA}, key string, bucket int, version int"
        written = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        open_ = key_range(F.col("key"), self.freq)[1] >= F.lit(today)
        rows = self._sums(written).withColumn("expires", F.when(open_, F.lit(today + datetime.timedelta(days=1))))
        kept = old.join(due, ["key", "bucket"], "left_anti").select(*rows.columns)
        new = kept.unionByName(rows).withColumnRenamed("version", "version_")
        new.write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return self.manifest(version)


def write_once(bars: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream of bars (with ``freq``) under ``rows/freq=/date=/batch=``. A batch that is tried again, after a failure between its write and
    its commit, replaces what it wrote before."""
    stream = bars.writeStream.foreachBatch(lambda batch, n: write_batch(batch, path, n)).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def write_batch(batch: DataFrame, path: str, number: int) -> None:
    out = batch.withColumns({"date": F.to_date("ts"), "batch": F.lit(number).cast("long")})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("freq", "date", "batch").parquet(f"{path}/rows")


def _stored(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{part}") if _exists(spark, f"{path}/{part}") else spark.createDataFrame([], schema)


def read_sink(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every row that ``write_once`` wrote (columns ``schema``), once. Days are read from their newest compaction and the batches after it."""
    rows = _stored(spark, path, "rows", f"{schema}, freq string, date date, batch long")
    packed = _stored(spark, path, "compact", f"{schema}, freq string, date date, through long")
    newest = packed.groupBy("freq", "date").agg(F.max("through").alias("last"))  # a row a day
    later = rows.join(newest, ["freq", "date"], "left").filter("last IS NULL OR batch > last").drop("batch", "last")
    return later.unionByName(packed.join(newest.withColumnRenamed("last", "through"), ["freq", "date", "through"], "left_semi").drop("through"))


def compact(spark: SparkSession, path: str, schema: str, before: datetime.date, files: int = 8) -> None:
    """Join the files of the days before a date into at most ``files`` files a day, sorted by symbol and time, up to the last batch there is. The small
    files stay until ``drop_packed``."""
    rows = read_sink(spark, path, schema).filter(F.col("date") < F.lit(before))
    last = _stored(spark, path, "rows", f"{schema}, freq string, date date, batch long").filter(F.col("date") < F.lit(before)).groupBy("freq", "date").agg(F.max("batch").alias("through"))
    done = _stored(spark, path, "compact", f"{schema}, freq string, date date, through long").select("freq", "date", "through").distinct()
    due = last.join(done, ["freq", "date", "through"], "left_anti")
    out = rows.join(due, ["freq", "date"]).withColumn("_file", F.pmod(F.xxhash64("symbol"), F.lit(files)))
    out = out.repartition("freq", "date", "_file").sortWithinPartitions("freq", "date", "symbol", "ts").drop("_file")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("freq", "date", "through").parquet(f"{path}/compact")


def drop_packed(spark: SparkSession, path: str, schema: str) -> int:
    """Delete the batches and older compactions that no reader counts any more; how many folders went."""
    packed = _stored(spark, path, "compact", f"{schema}, freq string, date date, through long").select("freq", "date", "through").distinct()
    packed = packed.withColumn("last", F.max("through").over(Window.partitionBy("freq", "date")))  # some rows a day
    rows = _stored(spark, path, "rows", f"{schema}, freq string, date date, batch long").select("freq", "date", "batch").distinct()
    old = rows.join(packed.filter("through = last").select("freq", "date", "last"), ["freq", "date"]).filter("batch <= last")
    folders = [f"rows/freq={r['freq']}/date={r['date']}/batch={r['batch']}" for r in old.collect()] + [f"compact/freq={r['freq']}/date={r['date']}/through={r['through']}" for r in packed.filter("through < last").collect()]
    for folder in folders:  # names of folders, a few a day
        where, fs = _files(spark, f"{path}/{folder}")
        fs.delete(where, True)
    return len(folders)
