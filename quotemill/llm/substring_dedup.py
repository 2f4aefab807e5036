"""Removal of repeated passages: every word that a window of ``WINDOW`` words covers which also starts
earlier (in a smaller document id, or earlier in the same document).

Suffix automata of reference shards, streamed over by all documents, do not give this result in bounded
memory here: the reference is the whole corpus, so either every document meets every shard (work grows with
the square of the corpus) or the automata outgrow what may be broadcast. The same maximal spans are found
by window hashes instead, restricted to where a repeat is possible:

1. Documents with equal word sequences are collapsed: a later copy is removed whole, and never holds a
   first occurrence.
2. Of every window the smallest hash of its ``GRAM``-word grams (its minimizer) is an anchor. Equal windows
   have equal anchors, so a window can repeat only if its anchor occurs twice; anchors are an eighth of
   the words. Their counts are combined map-side.
3. Only windows around repeated anchors are hashed (64 bits); for each hash the first occurrence is a
   map-side combined minimum, and the others mark the words they cover.

Defined results: NULL text has no words; rows with a NULL id are returned unchanged and do not take part;
repeated rows of one id are one document; texts with fewer words than a window stay whole; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import materialize, small
from quotemill.llm.near_dedup import _mix

WINDOW, GRAM = 20, 6
_U = np.uint64


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _U(0x9E3779B97F4A7C15) + h[j : j + n]
        out ^= out >> _U(29)
    return _mix(out)


def anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Positions of the grams that are the smallest of some window (the leftmost of equal ones)."""
    g = gram_hashes(h, gram)
    width = window - gram + 1
    if len(g) < width:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, width)
    at = np.concatenate([view[i : i + 8192].argmin(axis=1) + np.arange(i, min(i + 8192, len(view))) for i in range(0, len(view), 8192)])
    return np.unique(at)


def _fingerprints(batches):
    for b in batches:
        fp, n = [], []
        for text in b.column(1).to_pylist():
            w = split(text)
            fp.append(xxhash.xxh3_128_digest(b" ".join(w)))
            n.append(len(w))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(fp, pa.binary())], names=["doc", "n", "fp"])


def _anchors(window: int, gram: int):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                doc, pos, key = [], [], []
                for d, text in zip(*(c.to_pylist() for c in b.slice(i, 500).columns), strict=True):
                    h = word_hashes(split(text))
                    at = anchors(h, window, gram)
                    doc.append(np.full(len(at), d, np.int64))
                    pos.append(at.astype(np.int32))
                    key.append(gram_hashes(h, gram)[at].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, doc, pos)], names=["key", "doc", "pos"])

    return run


def _windows(window: int, gram: int):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                doc, start, key = [], [], []
                for d, text, at in zip(*(c.to_pylist() for c in b.slice(i, 200).columns), strict=True):
                    w = gram_hashes(word_hashes(split(text)), window)
                    s = np.unique((np.array(at)[:, None] - np.arange(window - gram + 1)).ravel())
                    s = s[(s >= 0) & (s < len(w))]
                    doc.append(np.full(len(s), d, np.int64))
                    start.append(s.astype(np.int32))
                    key.append(w[s].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, doc, start)], names=["key", "doc", "pos"])

    return run


def _repeated(seen: DataFrame) -> DataFrame:
    """Rows ``key, doc, pos`` of keys that occur more than once, with ``first`` (the smallest doc, pos)."""
    many = seen.groupBy("key").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("many")).filter("many > 1")
    return seen.join(many.select("key", "first"), "key")


def _apply(window: int):
    def run(batches):
        for b in batches:
            n, removed, text_out = [], [], []
            for text, runs, copy in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                w = split(text)
                n.append(len(w))
                if copy and len(w) >= window:
                    runs = [0, len(w) - window]
                if runs:
                    kept, at = [], 0
                    for first, last in zip(runs[::2], runs[1::2], strict=True):
                        kept += w[at : max(at, first)]
                        at = max(at, last + window)
                    w = kept + w[at:]
                removed.append(n[-1] - len(w))
                text_out.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text_out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc, runs``: first and last start of each run of windows of a document that start earlier elsewhere.
    ``docs`` has ``doc`` (distinct) and ``text``."""
    seen = materialize(docs.mapInArrow(_anchors(window, gram), "key long, doc long, pos int"))
    some = materialize(_repeated(seen).groupBy("doc").agg(F.collect_list("pos").alias("at")))
    near = docs.join(small(some.select("doc")), "doc", "left_semi").join(some, "doc").select("doc", "text", "at")
    windows = materialize(near.mapInArrow(_windows(window, gram), "key long, doc long, pos int"))
    later = _repeated(windows).filter("doc <> first.doc OR pos <> first.pos")
    starts = later.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("s"))
    begin = F.filter("s", lambda x, k: (k == 0) | (F.get("s", k - 1) < x - 1))
    end = F.filter("s", lambda x, k: (k == F.size("s") - 1) | (F.get("s", k + 1) > x + 1))
    return starts.select("doc", F.flatten(F.zip_with(begin, end, lambda a, b: F.array(a, b))).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept`` (the words that stay, joined by a space)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    fp = materialize(docs.filter("doc IS NOT NULL").mapInArrow(_fingerprints, "doc long, n int, fp binary"))
    first = fp.filter(F.col("n") >= window).groupBy("fp").agg(F.min("doc").alias("first"), F.count("*").alias("many"))
    copies = materialize(fp.join(first.filter("many > 1"), "fp").filter("doc <> first").select("doc").distinct())
    copies = small(copies)
    single = docs.filter("doc IS NOT NULL").join(copies, "doc", "left_anti")
    runs = materialize(repeated_windows(single, window))
    marks = copies.select("doc", F.lit(True).alias("copy"))
    out = docs.join(small(runs), "doc", "left").join(marks, "doc", "left")
    return out.select("doc", "text", "runs", "copy").mapInArrow(_apply(window), "doc_id long, n_words long, n_removed long, kept string")
