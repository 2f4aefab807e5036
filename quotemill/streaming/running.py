"""Running values of bars in a stream, and the scans on them: the rules are those of the batch scanners.

State is kept by symbol and holds only what runs through a day (and the average range); daily and slow features come from
tables by stream-static joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quotemill.functions.time import clock, time_of_day
from quotemill.operators import scanners
from quotemill.operators.blocks import average_range
from quotemill.operators.indicators import NAMES, OPEN
from quotemill.sources.storage import shared_folder

_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]
_BAR = "symbol long, ts timestamp, open double, high double, low double, close double, volume double"


@dataclass(frozen=True)
class Running:
    """Which values run: ``cumulative`` and ``premarket`` as (column, operation), ``atr`` a period or None, ``shifts`` as (column, n)."""

    cumulative: tuple[tuple[str, str], ...] = (("volume", "sum"), ("high", "max"), ("low", "min"))
    premarket: tuple[tuple[str, str], ...] = (("volume", "sum"),)
    atr: int | None = None
    shifts: tuple[tuple[str, int], ...] = ()

    def sums(self) -> list[tuple[str, str, str, bool]]:
        """Name, column, operation, and whether only bars before the opening count."""
        whole = [("cumulative_daily_volume" if (c, op) == ("volume", "sum") else f"{NAMES[op]}_{c}", c, op, False) for c, op in self.cumulative]
        return whole + [(f"premarket_{NAMES[op]}_{c}", c, op, True) for c, op in self.premarket]

    def depth(self) -> dict[str, int]:
        """Bars to remember of each shifted column."""
        return {c: max(n for d, n in self.shifts if d == c) for c, _ in self.shifts}

    def names(self) -> list[str]:
        return [s[0] for s in self.sums()] + [f"{c}_shift_{n}" for c, n in self.shifts] + ["day_open"] + ([f"atr_{self.atr}"] if self.atr else [])

    def state(self) -> str:
        run = [f"s{i} double" for i in range(len(self.sums()))] + [f"l{i} array<double>" for i in range(len(self.depth()))]
        return ", ".join(["day string", "ts timestamp", "day_open double", "close double", "num double", "den double", *run])


def _clean(v):
    return None if v is None or v != v else float(v)


def _average_range(x: pd.DataFrame, q: float, close, num: float, den: float):
    """The normalised mean after each bar, and what the next bar needs; a NULL range decays the weights and adds none."""
    before = np.concatenate([[np.nan if close is None else close], x["close"].to_numpy(float)[:-1]])
    high, low = x["high"].to_numpy(float), x["low"].to_numpy(float)
    spans = pd.DataFrame({"a": np.abs(high - low), "b": np.abs(high - before), "c": np.abs(low - before)}).max(axis=1).to_numpy()
    nums, dens = (_decayed_sums(v, q, held) for v, held in ((np.nan_to_num(spans), num), ((~np.isnan(spans)).astype(float), den)))
    with np.errstate(all="ignore"):
        return np.where(dens > 0, nums / dens, np.nan), float(nums[-1]), float(dens[-1])


def _decayed_sums(v: np.ndarray, q: float, held: float) -> np.ndarray:
    """``s_i = q s_(i-1) + v_i`` after ``held``, as a mean with weight 1 - q times its scale."""
    a = 1 - q
    return pd.Series(np.concatenate([[a * held], v])).ewm(alpha=a, adjust=False).mean().to_numpy()[1:] / a if q > 0 else v


def advance(new: pd.DataFrame, held: tuple | None, want: Running) -> tuple[pd.DataFrame | None, tuple | None]:
    """The bars later than the last one held, with running values, and the state after them."""
    new = new.sort_values("ts", kind="stable").drop_duplicates("ts")
    sums, depth = want.sums(), want.depth()
    if held is not None:
        new = new[new["ts"] > held[1]]
    if new.empty:
        return None, held
    parts, seconds = [], new["ts"].dt.hour * 3600 + new["ts"].dt.minute * 60 + new["ts"].dt.second
    for day, x in new.groupby(new["ts"].dt.strftime("%Y-%m-%d")):
        same, t = held is not None and held[0] == day, seconds[x.index]
        x, ends, tails = x.copy(), [], []
        for i, (name, col, op, early) in enumerate(sums):
            v = x[col].astype(float)
            v = v.where(t < OPEN) if early else v
            if same and held[6 + i] is not None:
                v = pd.concat([pd.Series([held[6 + i]]), v])
            run = getattr(v, {"sum": "cumsum", "min": "cummin", "max": "cummax"}[op])().ffill()
            x[name] = run.to_numpy()[-len(x) :]
            ends.append(_clean(x[name].iloc[-1]))
        for i, (col, n) in enumerate(depth.items()):
            past = [np.nan if v is None else v for v in held[6 + len(sums) + i] or []] if same else []
            v = pd.Series([*past, *x[col].astype(float)])
            for k in [k for c, k in want.shifts if c == col]:
                x[f"{col}_shift_{k}"] = v.shift(k).to_numpy()[len(past) :]
            tails.append([_clean(e) for e in v.iloc[-n:]])
        opens = x["open"].where((t >= OPEN) & (t < clock("16:00"))).bfill()
        first = held[2] if same and held[2] is not None else (_clean(opens.iloc[0]))
        x["day_open"] = np.where((t >= OPEN) & (first is not None), np.nan if first is None else first, np.nan)
        close, num, den = (held[3], held[4], held[5]) if held is not None else (None, 0.0, 0.0)
        if want.atr:
            x[f"atr_{want.atr}"], num, den = _average_range(x, 1 - 1 / want.atr, close, num or 0.0, den or 0.0)
        held = (day, x["ts"].iloc[-1].to_pydatetime(), first, _clean(x["close"].iloc[-1]), num, den, *ends, *tails)
        parts.append(x)
    return pd.concat(parts), held


class _Processor(StatefulProcessor):
    """One state variable a symbol; the first state comes from the snapshot, read once when the query first starts."""

    def __init__(self, want: Running):
        self.want = want

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("running", self.want.state())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803  names of the interface
        names = [f.split(" ")[0] for f in self.want.state().split(", ")]
        self.held.update(tuple(_plain(initialState[n].iloc[0]) for n in names))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = tuple(self.held.get()) if self.held.exists() else None
        out, after = advance(pd.concat(list(rows), ignore_index=True)[_COLUMNS], before, self.want)
        if after is not None:
            self.held.update(after)
        if out is not None:
            yield out[[*_COLUMNS, *self.want.names()]]

    def close(self) -> None:
        pass


def running(bars: DataFrame, want: Running, warm: DataFrame | None = None) -> DataFrame:
    """Bars with the running values of ``want``, in a stream of ``symbol, ts`` and bars.

    Values of a day start anew on a new date; bars not later than a symbol's last one are dropped. The state of each symbol is a variable of the
    state store (RocksDB, see ``start``), kept by the stream's checkpoint: a restart goes on from there. ``warm``: bars before the stream's start, whose ``snapshot`` is
    the initial state; it is read when the query first starts and by no later batch."""
    out = ", ".join([_BAR, *[f"{n} double" for n in want.names()]])
    initial = None if warm is None else snapshot(warm, want).groupBy("symbol")
    return bars.select(*_COLUMNS).groupBy("symbol").transformWithStateInPandas(_Processor(want), out, "Append", "None", initial)


def _plain(v):
    """A value of a pandas row as the state holds it."""
    if isinstance(v, list | np.ndarray):
        return [_clean(e) for e in v]
    if isinstance(v, str) or v is None:
        return v
    return None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else float(v)


def snapshot(bars: DataFrame, want: Running) -> DataFrame:
    """``symbol`` and the state after its last bar, as ``advance`` would hold it, by the batch operators: aggregates of the last day and
    a prefix scan over the history."""
    bars = bars.select(*_COLUMNS).withColumn("date", F.to_date("ts"))
    time, early = time_of_day(F.col("ts")), time_of_day(F.col("ts")) < OPEN
    runs = [getattr(F, op)(F.when(early, F.col(c)) if before else F.col(c)).cast("double").alias(f"s{i}") for i, (_, c, op, before) in enumerate(want.sums())]
    tail = lambda c, n: F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ts", F.col(c).cast("double").alias("v")))), -n, n), lambda e: e["v"])
    whole = lambda c, n: F.when(F.count("*") >= n, tail(c, n)).otherwise(F.transform(F.array_sort(F.collect_list(F.struct("ts", F.col(c).cast("double").alias("v")))), lambda e: e["v"]))
    tails = [whole(c, n).alias(f"l{i}") for i, (c, n) in enumerate(want.depth().items())]  # of one day's bars
    regular = F.when((time >= OPEN) & (time < clock("16:00")) & F.col("open").isNotNull(), F.col("ts"))
    last_day = bars.join(bars.groupBy("symbol").agg(F.max("date").alias("date")), ["symbol", "date"])
    out = last_day.groupBy("symbol").agg(
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("day"), F.max("ts").cast("timestamp").alias("ts"), F.min_by("open", regular).cast("double").alias("day_open"), F.max_by("close", "ts").cast("double").alias("close"), *runs, *tails
    )
    if want.atr:
        sums = average_range(bars, want.atr, "_mean", F.date_trunc("month", "ts"), sums=True)
        out = out.join(sums.groupBy("symbol").agg(F.max_by("_num", "ts").alias("num"), F.max_by("_den", "ts").alias("den")), "symbol")
    else:
        out = out.withColumns({"num": F.lit(0.0), "den": F.lit(0.0)})
    return out.select("symbol", *[f.split(" ")[0] for f in want.state().split(", ")])


def _parabolic(side: str, col: str, extreme: str):
    def rule(multiplier: float, min_volume: float = 0) -> tuple[dict[str, Column], Column]:
        signal, passed = scanners.parabolic_rule(side, multiplier, min_volume, "cumulative_daily_volume")
        return {"signal": signal}, passed & scanners.at_extreme(col, extreme)

    return rule


def _one(rule, side: str):
    def made(**params) -> tuple[dict[str, Column], Column]:
        signal, passed = rule(side, **params)
        return {"signal": signal}, passed

    return made


def _small_cap(**params) -> tuple[dict[str, Column], Column]:
    gap, alert, passed = scanners.small_cap_rule(**params)
    return {"gap_high": gap, "triggered_alert": alert}, passed & scanners.at_extreme("high", "highest_high")


#: Scans that a stream can run; the parabolic ones count the volume of the day. The daily scans need no stream.
RULES = {
    "atr_gap_down": _one(scanners.atr_gap_rule, "down"), "atr_gap_up": _one(scanners.atr_gap_rule, "up"),
    "atr_parabolic_down": _parabolic("down", "low", "lowest_low"), "atr_parabolic_up": _parabolic("up", "high", "highest_high"),
    "high_range_gap_up": _one(scanners.range_gap_rule, "up"), "low_range_gap_down": _one(scanners.range_gap_rule, "down"), "small_cap_up": _small_cap,
}


def marked(name: str, bars: DataFrame, days: DataFrame, start: str = "04:00", end: str = "20:00", **params) -> DataFrame:
    """Bars with running values as the scan sees them, and ``passed``. ``days`` has a row for each symbol and date that
    passes the daily stage, with the daily features; bars of other days do not pass."""
    if name not in RULES:
        raise ValueError(f"no live scan {name!r}; known: {', '.join(RULES)}")
    values, rule = RULES[name](**params)
    out = bars.withColumn("date", F.to_date("ts")).join(days.withColumn("_known", F.lit(True)), ["symbol", "date"], "left")
    rule = rule & F.col("_known") & time_of_day(F.col("ts")).between(clock(start), clock(end))
    return out.withColumns(values).withColumn("passed", scanners.passed(rule)).drop("_known")


def start(stream: DataFrame, path: str, trigger: dict | None = None):
    """A query that appends to ``path/rows`` and keeps its state under ``path/checkpoint``; started again on the same path, it goes on.
    Timers of wall clock never let ``availableNow`` end; such a stream takes ``{"once": True}``."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # a query takes the settings it starts with
    try:
        return stream.writeStream.option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def to_table(stream: DataFrame, trigger: dict | None = None) -> DataFrame:
    """What a stream gives for the rows there are now, as a table in the shared folder."""
    path = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    start(stream, path, trigger).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def replay(rows: DataFrame, batches: int = 5, most: int = 2_000_000, at: str = "ts", size: int = 32 << 20) -> DataFrame:
    """A table as a stream of files, each with the rows of one stretch of time, read in that order. There are ``batches`` micro-batches,
    and more if one would have over some ``most`` rows; each takes several files if one would be over some ``size`` bytes, so that
    no task writes or reads more than that, however much there is."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in rows.dtypes), F.lit(0))
    n, held = rows.agg(F.count("*"), F.sum(width.cast("long"))).first()
    batches = max(batches, -(-n // most))
    files_each = max(1, -(-(held or 0) // (batches * size)))
    rows.repartitionByRange(batches * files_each, at).write.parquet(path)  # equal times stay together
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listFiles(folder, True)
    while found.hasNext():  # a file a stretch, numbered along time: the times of files give the order in which a stream takes them
        one = found.next().getPath()
        if one.getName().endswith(".parquet"):
            files.setTimes(one, (1_600_000_000 + int(one.getName().split("-")[1])) * 1000, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_each).parquet(path)


def matches(name: str, bars: DataFrame, days: DataFrame, freq: str, **params) -> DataFrame:
    """The bars that pass, with the time at which the bar was complete."""
    return scanners.with_scan_time(marked(name, bars, days, **params).filter("passed"), freq)
