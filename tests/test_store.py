"""Versions of buckets behind a manifest, damaged files, and batches that are written once."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from quotemill.sources import model, store
from quotemill.streaming import running

SF = "/root/testdata/sf0.001"
BAR = "symbol long, ts timestamp_ntz, open double, high double, low double, close double, volume long"
TODAY = dt.date(2024, 1, 20)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def same(a, b):
    cols = [c.split(" ")[0] for c in BAR.split(", ")]
    return a.select(*cols).exceptAll(b.select(*cols)).isEmpty() and b.select(*cols).exceptAll(a.select(*cols)).isEmpty()


@pytest.fixture(scope="module")
def bars(spark):
    return model.bars(spark, SF).drop("date").filter("ts < timestamp_ntz'2024-01-20'").cache()


def test_one_expired_symbol_rewrites_one_bucket(spark, bars, tmp_path):
    s = store.BarStore(spark, str(tmp_path), "1h", 4)
    assert s.version() == 0 and s.manifest().isEmpty() and s.read().isEmpty()
    first = s.refresh(bars, TODAY)
    assert s.version() == 1 and same(s.read(), bars) and first.agg(F.sum("n")).first()[0] == bars.count()
    assert {r["expires"] for r in first.collect()} == {dt.date(2024, 1, 21)}  # the month is open
    before = files(tmp_path / "data")
    # one symbol is asked for again, with changed base bars
    one = bars.select("symbol").orderBy("symbol").first()[0]
    changed = bars.withColumn("volume", F.col("volume") + 1)
    bucket = first.filter(F.col("symbol") == one).first()["bucket"]
    second = s.refresh(changed, TODAY, again=first.filter(F.col("symbol") == one))
    after = files(tmp_path / "data")
    assert {k: v for k, v in after.items() if k in before} == before  # no file of the others was touched
    assert {k.split("/")[1] for k in set(after) - set(before)} == {f"bucket={bucket}"}
    assert {(r["bucket"] == bucket, r["version"]) for r in second.collect()} == {(True, 2), (False, 1)}
    moved = {r["symbol"] for r in second.filter("version = 2").collect()}
    assert one in moved and same(s.read().filter(F.col("symbol").isin(*moved)), changed.filter(F.col("symbol").isin(*moved)))
    assert same(s.read().filter(~F.col("symbol").isin(*moved)), bars.filter(~F.col("symbol").isin(*moved)))
    assert same(store.BarStore.read(s), s.read()) and s.manifest(1).filter("version = 2").isEmpty()


def test_a_manifest_that_is_not_complete_does_not_count(spark, bars, tmp_path):
    s = store.BarStore(spark, str(tmp_path), "1h", 2)
    s.refresh(bars, TODAY)
    (tmp_path / "manifest" / "version=2").mkdir()
    assert s.version() == 1 and same(s.read(), bars)


def test_truncated_and_missing_files_are_named_and_fetched_again(spark, bars, tmp_path):
    s = store.BarStore(spark, str(tmp_path), "1h", 4)
    made = s.refresh(bars, TODAY)
    assert s.damaged().isEmpty() and s.damaged(deep=True).isEmpty()
    used = [p for p in sorted((tmp_path / "data").rglob("*.parquet"))]
    cut, gone = used[0], used[1]
    cut.write_bytes(cut.read_bytes()[:-20])
    cut.with_name(f".{cut.name}.crc").unlink(missing_ok=True)
    gone.unlink()
    where = {(p.parts[-4], p.parts[-3]) for p in (cut, gone)}
    lost = made.filter(F.concat(F.lit("bucket="), "bucket").isin(*[b for _, b in where]))
    bad = s.damaged()
    assert {(r["symbol"], r["key"], r["wanted"], r["found"]) for r in bad.collect()} == {(r["symbol"], r["key"], r["n"], 0) for r in lost.collect()}
    s.refresh(bars, TODAY, again=bad)
    assert same(s.read(), bars) and s.damaged(deep=True).isEmpty()


def test_changed_values_are_found_by_checksum(spark, bars, tmp_path):
    s = store.BarStore(spark, str(tmp_path), "1h", 1)
    s.refresh(bars, TODAY)
    folder = next((tmp_path / "data").rglob("version=1"))
    other = spark.read.parquet(str(folder)).withColumn("close", F.when(F.col("symbol") == 1, F.col("close") + 1).otherwise(F.col("close"))).collect()
    spark.createDataFrame(other, BAR).coalesce(1).write.mode("overwrite").parquet(str(folder))
    assert s.damaged().isEmpty() and {r["symbol"] for r in s.damaged(deep=True).collect()} == {1}


def test_a_repeated_batch_is_written_once_and_days_are_compacted(spark, bars, tmp_path):
    path, want = str(tmp_path / "sink"), bars.withColumn("freq", F.lit("1h"))
    assert store.read_sink(spark, path, BAR).isEmpty()
    q = store.write_once(running.replay(bars, 5).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("freq", F.lit("1h")), path, str(tmp_path / "c"), {"availableNow": True})
    q.awaitTermination()
    assert same(store.read_sink(spark, path, BAR), bars)
    part = want.filter("ts < timestamp_ntz'2024-01-03'")
    for _ in range(2):  # a batch that fails after its write is tried again under its number
        store.write_batch(part, path, 77)
    assert store.read_sink(spark, path, BAR).count() == bars.count() + part.count()
    whole = store.read_sink(spark, path, BAR).count()
    store.compact(spark, path, BAR, dt.date(2024, 1, 10), files=1)
    again = store.read_sink(spark, path, BAR)
    assert again.count() == whole and len(list((tmp_path / "sink" / "compact").rglob("*.parquet"))) == 9
    store.write_batch(part, path, 78)  # a late batch of packed days
    assert store.read_sink(spark, path, BAR).count() == whole + part.count()
    assert store.drop_packed(spark, path, BAR) > 0
    assert store.read_sink(spark, path, BAR).count() == whole + part.count()
    store.compact(spark, path, BAR, dt.date(2024, 1, 10), files=1)
    assert store.drop_packed(spark, path, BAR) == 4 and store.drop_packed(spark, path, BAR) == 0  # two late batches, two older compactions
    assert store.read_sink(spark, path, BAR).count() == whole + part.count()
    assert same(store.read_sink(spark, path, BAR).filter("date >= date'2024-01-03'"), bars.filter("ts >= timestamp_ntz'2024-01-03'"))
