"""Coarser bars from a stream of base bars, given out as soon as they are complete."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.time import bucket, seconds

_STATE = "start long, open double, high double, low double, close double, volume double, flushed long"
_BAR = "symbol long, start long, open double, high double, low double, close double, volume double"
_NAMES = ["start", "open", "high", "low", "close", "volume"]


def advance(new: pd.DataFrame, held: tuple | None, base: int, length: int) -> tuple[list[tuple], tuple]:
    """Bars given out, and the state after ``new`` (``start``: of the bucket, ``at``: of the base bar, in seconds).

    A bucket is given out with its last base bar, or with the first one of a later bucket. Bars of buckets before the
    open one or not after the last one given out are dropped."""
    open_, flushed, out = (held[:6] if held and held[0] is not None else None), held[6] if held else None, []
    for start, x in new.sort_values("at", kind="stable").groupby("start"):
        start = int(start)
        if (flushed is not None and start <= flushed) or (open_ is not None and start < open_[0]):
            continue
        if open_ is not None and start > open_[0]:
            out.append(open_)
            flushed, open_ = open_[0], None
        first = x["open"].iloc[0] if open_ is None else open_[1]
        high, low, volume = x["high"].max(), x["low"].min(), x["volume"].sum()
        if open_ is not None:
            high, low, volume = max(high, open_[2]), min(low, open_[3]), volume + open_[5]
        open_ = (start, float(first), float(high), float(low), float(x["close"].iloc[-1]), float(volume))
        if x["at"].iloc[-1] + base >= start + length:
            out.append(open_)
            flushed, open_ = start, None
    return out, (*(open_ or (None,) * 6), flushed)


def complete_bars(bars: DataFrame, freq: str, base: str, grace: int = 20) -> DataFrame:
    """``symbol, ts`` and bars of ``freq`` from a stream of bars of ``base``. A bucket whose last bars never come is given
    out ``grace`` seconds of wall clock after its end, with the next batch."""
    length, step = seconds(freq), seconds(base)
    rows = bars.select("symbol", F.unix_timestamp(bucket(F.col("ts"), freq)).alias("start"), F.unix_timestamp("ts").alias("at"), *[F.col(c).cast("double").alias(c) for c in _NAMES[1:]])

    def follow(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            done, after = [held[:6]] if held[0] is not None else [], (*(None,) * 6, held[0] if held[0] is not None else held[6])
        else:
            done, after = advance(pd.concat(list(frames), ignore_index=True), held, step, length)
        state.update(after)
        if after[0] is not None:
            state.setTimeoutDuration(max(1, (after[0] + length + grace) * 1000 - state.getCurrentProcessingTimeMs()))
        if done:
            yield pd.DataFrame(done, columns=_NAMES).assign(symbol=key[0])[["symbol", *_NAMES]]

    out = rows.groupBy("symbol").applyInPandasWithState(follow, _BAR, _STATE, "append", "ProcessingTimeTimeout")
    return out.select("symbol", F.timestamp_seconds("start").alias("ts"), *_NAMES[1:])
