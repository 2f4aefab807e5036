"""Benchmark decontamination by size-partitioned MinHash containment search, in native operations only.

An item is contained in a document if at least ``threshold`` of its distinct 5-word shingles occur there
(an item with fewer words is one shingle). Jaccard-banded MinHash cannot find a 30-word item in a
20,000-word document, so containment is searched from the item's side: items are partitioned by shingle
count, and an item of m shingles is represented by its k smallest shingle hashes (its bottom-k MinHash
sketch), where k = m - ceil(threshold * m) + 1 rounded up to the largest need of its size class. An item
contained at the threshold misses at most k - 1 of its shingles, so at least one sketch value is in the
document: the candidate step loses nothing. Candidates are confirmed on the shingles themselves.

Words are maximal runs of letters and digits of the lower-cased text. NULL or empty texts have no shingles
and match nothing; NULL ids never match; repeated rows give one result row; empty tables give no rows;
other columns are ignored. Documents are scanned without a shuffle while the sketch is small enough to
broadcast (checked by count), else joined by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import fresh, materialize, own_tables, small

WORDS = 5
THRESHOLD = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _windows(w: str, size: int, make) -> Column:
    """``make`` of every window of ``size`` words of array column ``w``; empty if there is none."""
    n = F.size(w) - (size - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: make(F.slice(w, i, F.lit(size))))).otherwise(F.array().cast("array<string>") if make is _text else F.array().cast("array<bigint>"))


def _text(window: Column) -> Column:
    return F.array_join(window, " ")


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, size (words a shingle), n_shingles, shingles``: distinct shingles of every item."""
    it = items.select(F.col(id_col).cast("long").alias("item_id"), _words(F.col(text_col)).alias("w")).filter("item_id IS NOT NULL AND size(w) > 0")
    grams = F.when(F.size("w") < WORDS, F.array(_text(F.col("w")))).otherwise(_windows("w", WORDS, _text))
    it = it.select("item_id", F.least(F.size("w"), F.lit(WORDS)).alias("size"), F.explode(F.array_distinct(grams)).alias("shingle")).distinct()
    return it.groupBy("item_id", "size").agg(F.collect_set("shingle").alias("shingles")).withColumn("n_shingles", F.size("shingles"))


def _needed(n: Column, threshold: float) -> Column:
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """``item_id, size, h``: the bottom-k hashes of every item, k by its size class (powers of two)."""
    top = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1).cast("int") - 1  # largest count in the class
    k = F.least(F.col("n_shingles"), top - _needed(top, threshold) + 1)
    hashes = F.sort_array(F.transform("shingles", lambda s: F.xxhash64(F.split(s, " "))))
    return items.select("item_id", "size", F.explode(F.slice(hashes, F.lit(1), k)).alias("h"))


@own_tables
def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_shared, containment``: one row for each item in each document."""
    its = materialize(item_shingles(items, item_id, item_text))
    sizes = [r[0] for r in its.select("size").distinct().collect()]  # at most WORDS values
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _words(F.col(doc_text)).alias("w"), F.col(doc_text).alias("_text")).filter("doc_id IS NOT NULL")
    sketch = materialize(sketches(its, threshold))
    probes = F.concat(*[_windows("w", s, lambda x: F.xxhash64(x)) for s in sizes]) if sizes else F.array().cast("array<bigint>")
    found = d.select("doc_id", F.explode(probes).alias("h")).join(small(sketch.select("h").distinct()), "h", "left_semi")
    found = materialize(found.select("doc_id").distinct())
    some = d.select("doc_id", "_text").join(small(found), "doc_id", "left_semi").select("doc_id", _words(F.col("_text")).alias("w"))
    grams = F.concat(*[_windows("w", s, _text) for s in sizes]) if sizes else F.array().cast("array<string>")
    grams = some.select("doc_id", F.explode(F.array_distinct(grams)).alias("shingle"))
    wanted = its.select("item_id", "n_shingles", F.explode("shingles").alias("shingle"))
    hits = grams.join(small(wanted), "shingle").distinct()
    out = hits.groupBy("doc_id", "item_id").agg(F.first("n_shingles").alias("n"), F.count("*").alias("n_shared"))
    return out.filter(F.col("n_shared") >= _needed(F.col("n"), threshold)).select(
        "doc_id", "item_id", F.col("n").cast("long").alias("n_item_shingles"), "n_shared", F.round(F.col("n_shared") / F.col("n"), 6).alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item; columns unchanged. Rows with a NULL id stay."""
    bad = fresh("bad")
    found = materialize(contained_items(docs, items, doc_id=doc_id, doc_text=doc_text).select(F.col("doc_id").alias(bad)).distinct())
    return docs.join(small(found), F.col(doc_id).cast("long") == F.col(bad), "left_anti")
