"""Symbol universe, backfill windows, storage refresh, and merges of splits, earnings and headlines."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Security types of the universe.
TYPES = ("CS", "ADRC", "ADRP", "ADRR")


def universe(listings: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Distinct symbols of the wanted types, active or not."""
    return listings.filter(F.col("type").isin(*types)).select("symbol").distinct()


def active_by_exchange(listings: DataFrame, exchange: str) -> DataFrame:
    """Distinct active symbols of one exchange."""
    return listings.filter(F.col("active") & (F.col("exchange") == exchange)).select("symbol").distinct()


def slice_ranges(ranges: DataFrame, days: int) -> DataFrame:
    """``symbol, first, last`` cut into windows of at most ``days`` days, a row for each request."""
    starts = F.explode(F.sequence("first", "last", F.make_dt_interval(days=F.lit(days)))).alias("start")
    return ranges.select("symbol", "last", starts).select("symbol", "start", F.least(F.date_add("start", days - 1), "last").alias("end"))


def rotating_batch(symbols: DataFrame, key: str, day: datetime.date, since: datetime.date, batches: int) -> DataFrame:
    """The symbols whose turn it is on ``day``; every symbol comes once in ``batches`` days."""
    return symbols.filter(F.pmod(F.col(key), F.lit(batches)) == (day - since).days % batches)


def expired_partitions(wanted: DataFrame, manifest: DataFrame, today: datetime.date) -> DataFrame:
    """Partitions ``symbol, key`` to be written: not stored yet, or past the day they expire (NULL: never)."""
    stored = manifest.select("symbol", "key", "expires", F.lit(True).alias("_stored"))
    out = wanted.join(stored, ["symbol", "key"], "left")
    return out.filter(F.col("_stored").isNull() | (F.col("expires") <= F.lit(today))).select("symbol", "key")


def merge_splits(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of a symbol with a split newer than its known ones are replaced."""
    latest = old.groupBy("symbol").agg(F.max("execution_date").alias("_known"))
    newer = new.join(latest, "symbol", "left").filter("_known IS NULL OR execution_date > _known").select("symbol").distinct()
    return old.join(newer, "symbol", "left_anti").unionByName(new.join(newer, "symbol", "left_semi"))


def merge_earnings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known dates before a symbol's first new one, then the new ones."""
    first = new.groupBy("symbol").agg(F.min("date").alias("_first"))
    kept = old.join(first, "symbol", "left").filter("_first IS NULL OR date < _first").drop("_first")
    return kept.unionByName(new.distinct())


def dated_value(days: DataFrame, payloads: DataFrame, name: str) -> DataFrame:
    """Value of a JSON payload ``{"date", "value"}`` by symbol; it holds on its own date only."""
    p = payloads.select("symbol", F.from_json("payload", "date DATE, value DOUBLE").alias("p"))
    return days.join(p.select("symbol", "p.date", F.col("p.value").alias(name)), ["symbol", "date"], "left")


def news_confidence(scored: DataFrame) -> DataFrame:
    """Highest score of a symbol's headlines of the day so far."""
    day = Window.partitionBy("symbol", F.to_date("published_at")).orderBy("published_at")
    return scored.withColumn("news_confidence", F.max("score").over(day))


_SPLITS = "array<struct<execution_date:date,historical_adjustment_factor:double,split_from:double,split_to:double>>"


def load_splits(raw: DataFrame, col: str = "value") -> DataFrame:
    """``symbol, execution_date, split_from, split_to, factor`` of rows with a JSON map from symbols to lists of splits. Text that is no such map gives
    no rows, and neither does a split without a date; a map of any size may be cut into rows, a part of the symbols each."""
    maps = raw.select(F.explode(F.from_json(col, f"map<string,{_SPLITS}>")).alias("symbol", "splits"))
    out = maps.select("symbol", F.inline("splits")).filter("execution_date IS NOT NULL")
    return out.select("symbol", "execution_date", "split_from", "split_to", F.col("historical_adjustment_factor").alias("factor"))


def dump_splits(splits: DataFrame) -> DataFrame:
    """``value``: the JSON map of each symbol, as ``load_splits`` reads it, in the order of dates."""
    names = ["execution_date", "historical_adjustment_factor", "split_from", "split_to"]
    rows = splits.withColumnRenamed("factor", "historical_adjustment_factor") if "factor" in splits.columns else splits.withColumn("historical_adjustment_factor", F.lit(None).cast("double"))
    lists = rows.filter("symbol IS NOT NULL").groupBy(F.col("symbol").cast("string").alias("symbol")).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("splits"))  # some splits a symbol
    return lists.select(F.to_json(F.create_map("symbol", "splits")).alias("value"))


def on_day(headlines: DataFrame, day: datetime.date, zone: str = "America/New_York", at: str = "published_at") -> DataFrame:
    """Headlines of one local date of ``zone``. Times without a zone are UTC; instants are what they are; NULL is on no day."""
    naive = dict(headlines.dtypes)[at] == "timestamp_ntz"
    utc = F.col(at) if naive else F.col(at).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC") if naive else F.current_timezone(), F.lit(zone), utc)
    return headlines.filter(F.to_date(local) == F.lit(day))


def mentions(headlines: DataFrame) -> DataFrame:
    """Headlines that name their symbol in the title, or in the ``summary`` if there is one, in any case; NULLs count as empty. A name across the two counts, as
    they are joined by a space."""
    text = [F.coalesce(c, F.lit("")) for c in ("title", "summary") if c in headlines.columns]
    return headlines.filter(F.contains(F.upper(F.concat_ws(" ", *text)), F.upper("symbol")))


def new_headlines(headlines: DataFrame, scored: DataFrame) -> DataFrame:
    """Headlines whose title has not been scored for the symbol."""
    return headlines.join(scored.select("symbol", "title"), ["symbol", "title"], "left_anti")


def unseen_today(headlines: DataFrame, scored: DataFrame) -> DataFrame:
    """Headlines whose title has not been scored for the symbol on their own day; both sides have ``published_at``."""
    day = F.to_date("published_at").alias("day")
    seen = scored.select("symbol", "title", day).distinct()
    return headlines.withColumn("day", day).join(seen, ["symbol", "title", "day"], "left_anti").drop("day")


def scored_headlines(scores: DataFrame, headlines: DataFrame, keep: int = 50) -> DataFrame:
    """Headlines with the score of their number ``idx`` in the symbol's round, those above ``keep``."""
    return headlines.join(scores.select("symbol", "idx", "confidence"), ["symbol", "idx"]).filter(F.col("confidence") > keep)


def outcomes(rounds: DataFrame, scores: DataFrame) -> DataFrame:
    """``outcome`` of every scoring round: ``fail_open`` without an answer (NULL), ``empty`` for one without scores, else ``scored``."""
    n = scores.groupBy("symbol").agg(F.count("*").alias("n_scores"))
    out = rounds.join(n, "symbol", "left").withColumn("n_scores", F.coalesce("n_scores", F.lit(0)))
    return out.withColumn("outcome", F.when(F.col("response").isNull(), "fail_open").when(F.col("n_scores") == 0, "empty").otherwise("scored"))


def news_as_of(bars: DataFrame, scored: DataFrame) -> DataFrame:
    """Bars with ``news_confidence``, the highest score so far of the symbol's headlines of the bar's day; NULL until one is
    known. ``bars`` has ``symbol, date, ts``, ``scored`` has ``symbol, published_at, score``."""
    s = scored.select("symbol", F.col("published_at").alias("_at"), F.to_date("published_at").alias("date"), F.col("score").alias("_score"), F.lit(0).alias("_side"))
    both = bars.withColumn("_at", F.col("ts")).withColumn("_side", F.lit(1)).unionByName(s, allowMissingColumns=True)
    far = Window.partitionBy("symbol", "date").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("news_confidence", F.max("_score").over(far)).filter("_side = 1")
    return out.select(*bars.columns, "news_confidence")


def score_comparison(old: DataFrame, new: DataFrame, keep: int = 50) -> DataFrame:
    """Per symbol: titles that both scorings keep (a score above ``keep``), or only one."""
    sides = [df.filter(F.col("score") > keep).select("symbol", "title").distinct().withColumn(s, F.lit(True)) for df, s in ((old, "o"), (new, "n"))]
    both = sides[0].join(sides[1], ["symbol", "title"], "full")
    one = [F.count_if(F.col("n").isNull()).alias("only_old"), F.count_if(F.col("o").isNull()).alias("only_new")]
    return both.groupBy("symbol").agg(*one, F.count_if(F.col("o") & F.col("n")).alias("both"))


def score_changes(old: DataFrame, new: DataFrame, keep: int = 50) -> DataFrame:
    """``symbol, title, old_score, new_score, change``: the titles that only one scoring keeps, a missing score as -1."""
    sides = [df.groupBy("symbol", "title").agg(F.max("score").alias(s)) for df, s in ((old, "old_score"), (new, "new_score"))]
    both = sides[0].join(sides[1], ["symbol", "title"], "full").na.fill(-1, ["old_score", "new_score"])
    was, now = F.col("old_score") > keep, F.col("new_score") > keep
    return both.filter(was != now).withColumn("change", F.when(was, "only_old").otherwise("only_new"))


def score_totals(old: DataFrame, new: DataFrame, keep: int = 50) -> DataFrame:
    """One row: kept titles of either scoring, their symmetric difference, and the symbols that differ. Symbols that
    only one side has scored are left out."""
    known = old.select("symbol").distinct().join(new.select("symbol").distinct(), "symbol")
    c = score_comparison(old, new, keep).join(known, "symbol", "left_semi")
    differ = F.col("only_old") + F.col("only_new")
    kept = [F.coalesce(F.sum(F.col(s) + F.col("both")), F.lit(0)).alias(n) for s, n in (("only_old", "old_kept"), ("only_new", "new_kept"))]
    return c.agg(*kept, F.coalesce(F.sum(differ), F.lit(0)).alias("symmetric_difference"), F.count_if(differ > 0).alias("symbols_changed"))
