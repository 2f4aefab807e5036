"""The live forms of the named indicators: all but ``prev_allday``, which has none.

What runs through a day (cumulative and premarket values, shifts, the day's open, the average range) is kept by symbol in the state of one
stream. What holds for a whole day (rolling and previous values, average ranges and volumes, fundamentals) is computed by the batch operators for the
days that are to come, and joined; a query reads that table, not the history. Gaps and positions are expressions over both. News values change during the
day: each holds from its headline to the next higher one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.registry import DAY, TABLE, VALUE, Tables, day_features, values
from quotemill.streaming.running import Running, running


#: What runs in the state, as arguments of ``Running``.
_RUNS = {
    "cumulative_daily_volume": lambda: ("cumulative", ("volume", "sum")), "premarket_cumulative": lambda col, op: ("premarket", (col, op)), "cumulative": lambda col, op: ("cumulative", (col, op)),
    "atr": lambda period, freq="1min": ("atr", period), "shift": lambda col, n: ("shifts", (col, n)),
}
_LIVE = {*_RUNS, *DAY, *TABLE, *VALUE, "news_confidence"}


def news_intervals(scores: DataFrame) -> DataFrame:
    """``symbol, date, since, until, news_confidence``: the day's highest score so far and the times it holds (``until`` not included)."""
    s = scores.groupBy("symbol", F.to_date("published_at").alias("date"), F.col("published_at").cast("timestamp").alias("since")).agg(F.max("score").alias("score"))
    day = Window.partitionBy("symbol", "date").orderBy("since")
    best = F.max("score").over(day.rowsBetween(Window.unboundedPreceding, 0))
    return s.select("symbol", "date", "since", F.lead("since").over(day).alias("until"), best.alias("news_confidence"))


def live_indicators(bars: DataFrame, wanted: list[tuple[str, dict]], tables: Tables, days: DataFrame, warm: DataFrame | None = None) -> DataFrame:
    """A stream of bars with the indicators of ``wanted`` (name and parameters), by the batch definitions.

    ``days`` has the ``symbol, date`` that are to come; bars of other days get NULL for what holds for a day. ``warm``: see ``running``."""
    for name, _ in wanted:
        if name not in _LIVE:
            raise ValueError(f"no live form of {name!r}; known: {', '.join(sorted(_LIVE))}")
    asked: dict[str, list] = {"cumulative": [], "premarket": [], "shifts": [], "atr": []}
    for name, params in wanted:
        if name in _RUNS:
            kind, value = _RUNS[name](**params)
            asked[kind].append(value)
    if len(set(asked["atr"])) > 1:
        raise ValueError(f"one average range a stream; asked for {sorted(set(asked['atr']))}")
    unique = {kind: tuple(dict.fromkeys(v)) for kind, v in asked.items()}
    want = Running(unique["cumulative"], unique["premarket"], unique["atr"][0] if unique["atr"] else None, unique["shifts"])
    out = running(bars, want, warm).withColumn("date", F.to_date("ts"))
    features = day_features(days, tables, wanted)
    if len(features.columns) > 2:
        out = out.join(features, ["symbol", "date"], "left")
    if any(name == "news_confidence" for name, _ in wanted):
        n = news_intervals(tables.scores).withColumnsRenamed({"symbol": "_symbol", "date": "_date"})
        here = (F.col("symbol") == F.col("_symbol")) & (F.col("date") == F.col("_date")) & (F.col("ts") >= F.col("since")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))
        out = out.join(n, here, "left").drop("_symbol", "_date", "since", "until")
    named = {f"atr_{p['period']}_{p['freq']}": F.col(f"atr_{p['period']}") for name, p in wanted if name == "atr" and p.get("freq", "1min") != "1min"}
    return out.withColumns(values(wanted, F.col("day_open")) | named)
