"""Building blocks: daily spine, exponentially weighted means, as-of join. Histories are cut in time, never by symbol alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(daily: DataFrame, target: DataFrame) -> DataFrame:
    """Daily bars and, for every symbol, the target's last date if it has no bar yet (with NULL values). Days that are their own
    target have a bar there, only an unknown symbol equals none: they are not computed again to be compared with themselves."""
    if target is daily:
        return daily.unionByName(daily.filter("symbol IS NULL").groupBy("symbol").agg(F.max("date").alias("date")), allowMissingColumns=True)
    last = target.groupBy("symbol").agg(F.max("date").alias("date"))
    return daily.unionByName(last.join(daily.select("symbol", "date"), ["symbol", "date"], "left_anti"), allowMissingColumns=True)


def _weights(period: int) -> tuple[float, int]:
    """The decay q a row, and the rows after which its weight is below 1e-16."""
    q = 1 - 1 / period
    return q, math.ceil(37 / -math.log(q)) if q > 0 else 1


def _decayed(df: DataFrame, value: Column, period: int, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_i`` (rows before), ``_num`` and ``_den``: the decayed sum of the values, and of their weights.

    Weights q^-k overflow over long histories, so sums run inside blocks of rows, long enough that one block
    back holds all weight above 1e-16; the end of the block before is added with its decay."""
    q, size = _weights(period)
    run = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_i", F.row_number().over(run) - 1).withColumn("_k", F.col("_i") % size).withColumn("_block", F.floor(F.col("_i") / size))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_x", value)
    grow, decay = F.pow(F.lit(q), -F.col("_k")), F.pow(F.lit(q), "_k")
    df = df.withColumn("_num", decay * F.sum(F.coalesce("_x", F.lit(0.0)) * grow).over(inside))
    df = df.withColumn("_den", decay * F.sum(F.when(F.col("_x").isNotNull(), grow).otherwise(0.0)).over(inside))
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    for c in ("_num", "_den"):
        end = F.last(F.when(F.col("_k") == size - 1, F.col(c)), ignorenulls=True).over(before)
        df = df.withColumn(f"{c}2", F.col(c) + F.coalesce(end, F.lit(0.0)) * F.pow(F.lit(q), F.col("_k") + 1))
    return df.drop("_k", "_block", "_x", "_num", "_den").withColumnsRenamed({"_num2": "_num", "_den2": "_den"})


def ewm_mean(df: DataFrame, value: Column, period: int, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """Exponentially weighted mean with alpha = 1 / period and normalised weights (NULLs weigh nothing). One task takes the
    rows of one key: for daily rows; ``average_range`` is for long histories."""
    if period == 1:
        return df.withColumn(out, value)
    return _decayed(df, value, period, keys, order).withColumn(out, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))).drop("_i", "_num", "_den")


def true_range(high: Column, low: Column, before: Column) -> Column:
    return F.greatest(F.abs(high - low), F.abs(high - before), F.abs(low - before))


def average_range(df: DataFrame, period: int, out: str, chunk: Column, key: str = "symbol", ts: str = "ts", sums: bool = False) -> DataFrame:
    """The exponentially weighted mean of true ranges over a history of any length, as a prefix scan in two passes.

    ``chunk`` cuts a symbol's history (it does not fall along ``ts``). In each chunk the decayed sums run on their own, without the range of its first
    bar; the ends of the chunks (sums, rows, last close, first bar) are then run along the symbol, and every chunk gets the sums
    and the close before it. No task takes more bars than a chunk has. ``sums`` adds the mean's two sums, ``_num`` and ``_den``."""
    q, size = _weights(period)
    keys = [key, "_chunk"]
    df = df.withColumn("_chunk", chunk)
    here = Window.partitionBy(*keys).orderBy(ts)
    span = F.when(F.row_number().over(here) > 1, true_range(F.col("high"), F.col("low"), F.lag("close").over(here)))
    rows = _decayed(df.withColumn("_tr", span), F.col("_tr"), period, keys, [ts]).drop("_tr")

    ends = rows.groupBy(*keys).agg(F.count("*").alias("m"), F.max_by(F.struct("_num", "_den", "close"), ts).alias("end"), F.min_by(F.struct("high", "low"), ts).alias("first"))
    along = Window.partitionBy(key).orderBy("_chunk")  # a row a chunk
    ends = ends.withColumn("_tr0", true_range(F.col("first.high"), F.col("first.low"), F.lag("end.close").over(along)))
    ends = ends.withColumn("at", F.sum("m").over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    ends = ends.withColumns({"b": F.floor(F.col("at") / size), "r": F.col("at") % size})
    first = F.pow(F.lit(q), F.col("m") - 1)
    ends = ends.withColumns({"_num": F.col("end._num") + first * F.coalesce("_tr0", F.lit(0.0)), "_den": F.col("end._den") + F.when(F.col("_tr0").isNotNull(), first).otherwise(0.0)})
    inside = Window.partitionBy(key, "b").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    last_block = Window.partitionBy(key).orderBy("b").rangeBetween(-1, -1)
    for c in ("_num", "_den"):
        grown = F.col(c) * F.pow(F.lit(q), -F.col("r"))
        total = F.pow(F.lit(q), "r") * F.sum(grown).over(inside) + F.pow(F.lit(q), F.col("r") + size) * F.coalesce(F.sum(grown).over(last_block), F.lit(0.0))
        ends = ends.withColumn(f"{c}0", total)
    ends = ends.select(*keys, "_tr0", *[F.coalesce(F.lag(f"{c}0").over(along), F.lit(0.0)).alias(f"{c}0") for c in ("_num", "_den")])

    near, far = F.pow(F.lit(q), "_i"), F.pow(F.lit(q), F.col("_i") + 1)
    num = F.col("_num") + near * F.coalesce("_tr0", F.lit(0.0)) + far * F.col("_num0")
    den = F.col("_den") + F.when(F.col("_tr0").isNotNull(), near).otherwise(0.0) + far * F.col("_den0")
    out_cols = [F.when(den > 0, num / den).alias(out), *([num.alias("_num"), den.alias("_den")] if sums else [])]
    return rows.join(ends, keys).select(*[c for c in df.columns if c not in ("_chunk", out)], *out_cols)


def stretch_of(at: Column, kind: str, days: int) -> Column:
    """Number of the stretch of ``days`` days that a date or timestamp column lies in."""
    day = F.unix_date(at if kind == "date" else F.to_date(at))
    return F.floor(day / days)


def asof_join(left: DataFrame, right: DataFrame, values: dict[str, str], on: str = "date", forward: bool = False, days: int = 64) -> DataFrame:
    """For every row of ``left`` the values of ``right`` at the nearest ``on`` not after it (``forward``: not
    before), by ``symbol``; NULL for a NULL symbol or ``on``.

    Both sides are put in one order inside stretches of ``days`` days and the last value is carried; what is known from earlier stretches
    runs along one row a symbol and stretch. So no range join, and no task with all rows of a symbol."""
    names, kind = list(values.values()), dict(left.dtypes)[on]
    r = right.filter(f"symbol IS NOT NULL AND {on} IS NOT NULL").select("symbol", F.col(on).alias("_at"), F.struct(*[F.col(k).alias(v) for k, v in values.items()]).alias("_v"), F.lit(0).alias("_side"))
    both = left.withColumn("_at", F.col(on)).withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True).withColumn("_stretch", stretch_of(F.col("_at"), kind, days))
    order = [F.col("_at").desc() if forward else F.col("_at"), F.col("_side")]
    w = Window.partitionBy("symbol", "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pick = (F.min_by if forward else F.max_by)("_v", F.when(F.col("_side") == 0, F.col("_at")))
    along = Window.partitionBy("symbol").orderBy(F.col("_stretch").desc() if forward else F.col("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    known = both.groupBy("symbol", "_stretch").agg(pick.alias("_last")).select("symbol", "_stretch", F.last("_last", ignorenulls=True).over(along).alias("_before")).filter("_before IS NOT NULL")
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").join(known, ["symbol", "_stretch"], "left")
    return out.select(*left.columns, *[F.coalesce("_v", "_before")[n].alias(n) for n in names])
