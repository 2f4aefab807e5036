"""Live scans: stateful intraday features, daily and slow features by stream-static joins, subscriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def active_only(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of the symbols in ``universe``."""
    return bars.join(universe.select("symbol").distinct(), "symbol", "left_semi")


def write_active(bars: DataFrame, universe: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that reads the universe anew for every batch, so a new day's list needs no restart."""
    each = lambda batch, n: write(active_only(batch, universe()), n)
    return bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def with_features(bars: DataFrame, features: DataFrame) -> DataFrame:
    """Daily or fundamental features by symbol and date; ``features`` is a table, so each batch sees its present rows."""
    return bars.withColumn("date", F.to_date("ts")).join(features, ["symbol", "date"], "left")


def slow_features(bars: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The largest of a slow feature's values (``symbol, date, value``) so far that day."""
    return with_features(bars, values.groupBy("symbol", "date").agg(F.max("value").alias(name)))


def live_scan(bars: DataFrame, passed: Column) -> DataFrame:
    """Bars that pass, with the time of the scan."""
    return bars.filter(passed).withColumn("scan_time", F.date_format("ts", "HH:mm"))


def subscribed(bars: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row for each bar (with ``freq``) and subscription (``subscription_id, symbol, freq``) to it."""
    return bars.join(subscriptions.select("subscription_id", "symbol", "freq").distinct(), ["symbol", "freq"])


def subscribed_values(bars: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """As ``subscribed``, for bars with indicators; ``values`` maps the ``indicators`` (array of columns) each subscription asks for."""
    fixed = {"symbol", "freq", "ts", "date"}
    known = [c for c, kind in bars.dtypes if c not in fixed and kind in ("double", "float", "bigint", "int")]
    every = F.create_map(*[v for c in known for v in (F.lit(c), F.col(c).cast("double"))])
    asked = subscriptions.groupBy("subscription_id", "symbol", "freq").agg(F.array_distinct(F.flatten(F.collect_list("indicators"))).alias("indicators"))
    out = bars.join(asked, ["symbol", "freq"])
    return out.select("subscription_id", "symbol", "freq", "ts", F.map_filter(every, lambda k, v: F.array_contains("indicators", k)).alias("values"))


def indicator_sets(subscriptions: DataFrame, most: int = 1000) -> list[tuple[str, tuple[str, ...]]]:
    """The distinct pairs of frequency and asked-for indicators of one ``subscription_id, symbol, freq``; over ``most`` of them is an error."""
    sets = _asked(subscriptions).select("freq", "indicators").distinct().limit(most + 1).collect()
    if len(sets) > most:
        raise ValueError(f"more than {most} different sets of indicators")
    return sorted((r["freq"], tuple(r["indicators"])) for r in sets)


def _asked(subscriptions: DataFrame) -> DataFrame:
    """What each subscription to a symbol and frequency asks for, in order."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("indicators"))))
    return subscriptions.groupBy("subscription_id", "symbol", "freq").agg(every.alias("indicators"))


def subscribed_indicators(bars: dict[str, DataFrame], subscriptions: DataFrame, compute: Callable[[DataFrame, str, tuple[str, ...]], DataFrame]) -> DataFrame:
    """``subscription_id, symbol, freq, ts, values``, where only what is asked for is computed: subscriptions with the same frequency and set
    of indicators are served together, from the ``bars`` of the frequency that have their symbols. ``compute(bars, freq, names)`` adds the columns ``names``."""
    asked, parts = _asked(subscriptions), []
    for freq, names in indicator_sets(subscriptions):
        here = asked.filter((F.col("freq") == freq) & (F.col("indicators") == F.array(*map(F.lit, names)))).select("subscription_id", "symbol")
        own = compute(bars[freq].join(here.select("symbol").distinct(), "symbol", "left_semi"), freq, names)
        values = F.create_map(*[v for n in names for v in (F.lit(n), F.col(n).cast("double"))]) if names else F.create_map().cast("map<string,double>")
        parts.append(own.join(here, "symbol").select("subscription_id", "symbol", F.lit(freq).alias("freq"), "ts", values.alias("values")))
    if not parts:
        raise ValueError("no subscription")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class _Subscribers(StatefulProcessor):
    """The subscribers of a symbol and unit, each a key of a map in the state store, and their number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.present = handle.getMapState("present", "subscriber long", "since timestamp")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable").itertuples():
            one = (int(r.subscriber),)
            if bool(r.add) == self.present.containsKey(one):
                continue
            if r.add:
                self.present.updateValue(one, (r.ts.to_pydatetime(),))
            else:
                self.present.removeKey(one)
            n += 1 if r.add else -1
            if n == (1 if r.add else 0):
                out.append((key[0], key[1], r.ts, int(r.seq), "first" if r.add else "last"))
        self.count.update((n,))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "unit", "ts", "seq", "trigger"])

    def close(self) -> None:
        pass


def live_triggers(changes: DataFrame) -> DataFrame:
    """As ``subscription_triggers``, in a stream of changes that come in the order of time: counts and members are kept across batches."""
    rows = changes.select("symbol", "unit", "subscriber", "ts", "seq", "add").groupBy("symbol", "unit")
    return rows.transformWithStateInPandas(_Subscribers(), "symbol long, unit string, ts timestamp, seq long, trigger string", "Append", "None")


def unseen_stream(headlines: DataFrame, late: str = "1 day") -> DataFrame:
    """Headlines of a stream whose title is new for the symbol on its day. The state has a digest of each title, and drops it ``late`` after its day's rows."""
    key = headlines.withColumns({"_day": F.to_date("published_at"), "_title": F.md5(F.col("title").cast("binary"))})
    return key.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["symbol", "_day", "_title"]).drop("_day", "_title")


def arrival_spread_stream(arrivals: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """As ``quality.arrival_spread``, in a stream: a bar start is given out when the newest one is ``late`` past it, and arrivals after that are ignored."""
    first, last = (F.unix_timestamp(f("arrived")) for f in (F.min, F.max))
    return arrivals.withWatermark("ts", late).groupBy("ts").agg((first - F.unix_timestamp("ts") - seconds).alias("delay_s"), (last - first).alias("spread_s"))


def delivery_latency_stream(processed: DataFrame, seconds: int = 60, late: str = "1 minute", accuracy: int = 10_000) -> DataFrame:
    """As ``quality.delivery_latency``, in a stream, with quantiles of a sketch: their rank is right within 1 / ``accuracy``."""
    delay = F.unix_timestamp("processed") - F.unix_timestamp("ts") - seconds
    ends = [F.percentile_approx(delay, q, accuracy).cast("double").alias(n) for q, n in ((0.5, "median_s"), (0.95, "p95_s"))]
    return processed.withWatermark("ts", late).groupBy("ts").agg(F.max(delay).alias("last_s"), F.count("*").alias("n"), *ends)


def subscription_triggers(changes: DataFrame) -> DataFrame:
    """``symbol, unit, ts, seq, trigger``: the changes with which a symbol and unit gets its first subscriber (``first``)
    or loses its last one (``last``). An addition of a present subscriber and a removal of an absent one change nothing."""
    own = Window.partitionBy("subscriber", "symbol", "unit").orderBy("ts", "seq")
    step = F.col("add").cast("int") - F.coalesce(F.lag("add").over(own).cast("int"), F.lit(0))
    moved = changes.withColumn("_step", step).filter("_step <> 0")
    total = F.sum("_step").over(Window.partitionBy("symbol", "unit").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    out = moved.withColumn("_n", total).withColumn("trigger", F.when((F.col("_n") == 1) & (F.col("_step") == 1), "first").when(F.col("_n") == 0, "last"))
    return out.filter("trigger IS NOT NULL").select("symbol", "unit", "ts", "seq", "trigger")


def subscription_counts(changes: DataFrame) -> DataFrame:
    """``symbol, unit, subscribers``: of ``subscriber, symbol, unit, ts, seq, add``, the subscribers whose last
    change is an addition. Symbols without one do not appear."""
    last = changes.groupBy("subscriber", "symbol", "unit").agg(F.max_by("add", F.struct("ts", "seq")).alias("add"))
    return last.filter("add").groupBy("symbol", "unit").agg(F.count("*").alias("subscribers"))
