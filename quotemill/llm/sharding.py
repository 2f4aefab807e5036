"""Shards of equal load by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group and stay in one shard. Groups are placed largest first (by their largest share of a shard's capacity), each
where the dot product of its loads with the shard's residual capacity, in shares of the capacity, is highest.

Only groups that matter alone are placed alone: those with more than ``1 / ALONE`` of a shard's capacity in one of the three measures,
at most ``3 * ALONE * shards`` of them whatever the input. The others travel in lots: of documents of one size class
(powers of two, so that lots differ in the proportions of their loads) and one range of the group's hash; the ranges halve
from level to level, so the last lots placed are small enough to even out what the large ones left. There are at most
``64 * LEVELS * LOTS`` lots. Both are sums; their number, not that of the documents, bounds what the driver sees.

A group with more than a shard's capacity is cut into slices of its rows by a hash of their ids; so are those with more than half, but
only if these and the larger ones need more shards than there are. No other group is ever split.

Slots count the documents of a shard: first within ranges of a hash, then over the ranges' counts, so no task numbers a whole shard.

The sizes of the shards (UTF-8 bytes of the text, one more a document) come out near equal, as far as single documents allow.
Tokens are words (``[^\\x20\\x09-\\x0D]+``) unless a column of counts is given.

Defined results: NULL text is empty and one group with it; NULL and repeated ids are kept, each row has its own slot; texts of any
length count whole; ties between shards go to the lowest number; rows alike in every column are interchangeable; an empty table gives no row; other columns are
ignored. Texts are told apart by a 64-bit hash, their CRC-32 and their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import materialize, own_tables

SHARDS = 16
ALONE = 128
LEVELS = 8
LOTS = 64
_WORD = r"[^\x20\x09-\x0D]+"
_LOADS = ["size", "tokens", "one"]


def place(loads: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The shard of each row of ``loads`` (one column a measure): largest first, each where the dot product of its shares of the
    capacity with the residual shares is highest."""
    total = loads.sum(0)
    share = loads * shards / np.where(total > 0, total, 1)
    left, out = np.ones((shards, loads.shape[1])), np.zeros(len(loads), int)
    for i in np.lexsort((np.arange(len(loads)), -share.max(1))):
        s = int((left @ share[i]).argmax())
        left[s] -= share[i]
        out[i] = s
    return out


@own_tables
def shard(docs: DataFrame, shards: int = SHARDS, tokens: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, tokens, shard`` and ``slot``, its place in the shard, gapless from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = F.coalesce(F.col(tokens), F.lit(0)) if tokens else F.regexp_count(text, F.lit(_WORD))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        count.cast("long").alias("tokens"), F.xxhash64(text).alias("key"), F.lit(1).cast("long").alias("one"),
    )
    rows = materialize(rows)
    total = rows.agg(*[F.sum(c).alias(c) for c in _LOADS]).first()
    group = ["key", "text_crc32", "size"]
    g = rows.groupBy(*group).agg(F.sum("size").alias("all_size"), F.sum("tokens").alias("all_tokens"), F.sum("one").alias("all_one"))
    most = F.greatest(*[F.col(f"all_{c}") * shards / F.lit(max(float(total[c] or 0), 1.0)) for c in _LOADS])
    # At most 3 * ALONE * shards groups: each has more than 1 / (ALONE * shards) of one of three totals.
    large = materialize(g.withColumn("most", most).filter(F.col("most") > 1 / ALONE).select(*group, "most"))
    needed = large.filter("most > 0.5").agg(F.sum(F.ceil("most"))).first()[0] or 0
    slices = F.when(F.col("most") > (1.0 if needed <= shards else 0.5), F.ceil(F.col("most") * ALONE).cast("int")).otherwise(F.lit(1))
    large = F.broadcast(large.select(*group, slices.alias("slices")))

    level = F.least(F.lit(LEVELS - 1), F.length(F.regexp_extract(F.lpad(F.bin(F.pmod("key", F.lit(1 << LEVELS))), LEVELS, "0"), "^0*", 0)))
    lot = F.pmod(F.shiftright("key", 20), F.lit(LOTS))
    size_class = F.floor(F.log2(F.col("size")))
    own = F.col("slices").isNotNull()
    cut = F.when(F.col("slices") > 1, F.pmod(F.xxhash64("doc_id"), F.col("slices"))).otherwise(F.lit(0))
    unit = F.when(own, F.struct(F.lit(True).alias("own"), F.col("key").alias("a"), F.col("text_crc32").alias("b"), F.col("size").alias("c"), cut.cast("long").alias("d"))).otherwise(
        F.struct(F.lit(False).alias("own"), size_class.cast("long").alias("a"), level.cast("long").alias("b"), lot.cast("long").alias("c"), F.lit(0).cast("long").alias("d"))
    )
    rows = rows.join(large, group, "left").withColumn("unit", unit).drop("slices")
    units = rows.groupBy("unit").agg(*[F.sum(c).alias(c) for c in _LOADS]).orderBy("unit").collect()  # bounded, as said above
    placed = place(np.array([[u[c] for c in _LOADS] for u in units], float).reshape(-1, len(_LOADS)), shards)
    spark = docs.sparkSession
    kind = "unit struct<own:boolean,a:bigint,b:bigint,c:bigint,d:bigint>, shard int"
    where = F.broadcast(spark.createDataFrame([(u["unit"], int(s)) for u, s in zip(units, placed, strict=True)], kind))
    rows = materialize(rows.join(where, "unit").select("doc_id", "size", "text_crc32", "tokens", "key", "shard"))

    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("range", F.pmod(F.xxhash64("doc_id", "key"), F.lit(ranges)))
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("here"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = counts.select("shard", "range", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "key", "text_crc32", "size")) - 1
    rows = rows.withColumn("number", number).join(counts, ["shard", "range"])
    return rows.select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("base") + F.col("number")).alias("slot"))
