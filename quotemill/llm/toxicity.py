"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, replaces homoglyphs and digit or symbol substitutions by the letter they stand for
(``l``, ``1`` and ``i`` become one letter), and turns everything else that is no letter into a space.
Lexicon entries are stems anchored at a word's start; each has as weight its smoothed log-odds between
documents labelled toxic and others. Exception phrases (a hit with its neighbouring word, seen only in
documents labelled clean) cancel the hits they cover. The sum of weights is divided by the square root
of the length in words, and a logistic of its distance to the best training threshold is the score.

Labels are learnt from a bounded sample: at most ``sample_docs`` labelled documents, those with the smallest
hash of their id. Features of the sample are counted by Spark; every entry that is seen in ``MIN_DOCS`` toxic documents of
the sample and odd enough is kept.

Defined results: NULL text is empty; empty texts score like texts without a hit; labels of unknown or NULL ids and
NULL labels are ignored; texts of any length are read whole; ties in score stay ties; with nothing to learn every score is 0; repeated rows get equal scores; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.quality_classifier import sample_labels

SAMPLE_DOCS = 8000
STEMS = (4, 5, 6, 7, 8)
MIN_DOCS, MIN_ODDS = 4, 3.0
CUT = 0.3

# Characters that are read as another letter.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "i",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ɡ": "g",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}


class _Folding(dict):
    """A translation table that is filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:  # full-width forms of ASCII
            c = chr(code - 0xFEE0)
        c = c.lower()
        c = HOMOGLYPHS.get(c, c)
        c = SUBSTITUTIONS.get(c, c)
        out = c if c.isalpha() else "" if c in "́​‌‍­" else " "
        self[code] = out
        return out


_FOLD = _Folding()


def fold(text: str | None) -> str:
    """Folded text: letters and spaces, with a space at either end."""
    return " " + (text or "").translate(_FOLD) + " "


def stems(folded: str) -> set[str]:
    """Anchored stems and whole words of a folded text."""
    out = set()
    for w in set(folded.split()):
        out.update(" " + w[:k] for k in STEMS if len(w) > k)
        out.add(f" {w}" if len(w) in STEMS else f" {w} ")
    return out


class Lexicon:
    """Weighted stems, exception phrases, and the scale of the reported score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str] = (), threshold: float = 1.0):
        self.weights, self.exceptions, self.threshold = dict(weights), list(exceptions), threshold
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for s, w in self.weights.items():
                a.add_word(s, (len(s), w))
            for s in self.exceptions:
                a.add_word(f" {s} ", (len(s) + 2, None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """``(start, end, weight)`` of the hits that no exception phrase covers."""
        if not len(self.automaton):
            return []
        found = [(e - n + 1, e, w) for e, (n, w) in self.automaton.iter(folded)]
        spans = sorted((s, e) for s, e, w in found if w is None)
        if not spans:
            return found
        reach = list(accumulate((e for _, e in spans), max))  # the furthest end of the spans up to each
        starts = [s for s, _ in spans]
        return [x for x in found if x[2] is not None and not ((k := bisect_right(starts, x[0])) and x[1] <= reach[k - 1])]

    def raw(self, text: str | None) -> float:
        folded = fold(text)
        hits = self.hits(folded)
        return sum(w for _, _, w in hits) / math.sqrt(max(1, len(folded.split()))) if hits else 0.0

    def scores(self, raw: np.ndarray) -> np.ndarray:
        z = np.log(CUT / (1 - CUT)) + 4 * (raw - self.threshold) / self.threshold
        return np.where(raw > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def _word_before(folded: str, at: int) -> str:
    while at > 0 and folded[at - 1] == " ":
        at -= 1
    return folded[folded.rfind(" ", 0, at) + 1 : at]


def _word_after(folded: str, at: int) -> str:
    while at < len(folded) and folded[at] == " ":
        at += 1
    return folded[at : max(at, folded.find(" ", at))]


def _minimal(found: dict[str, float]) -> dict[str, float]:
    """Entries without those that a shorter entry already matches."""
    return {s: w for s, w in found.items() if not any(s[:k] in found for k in range(2, len(s)))}


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Lexicon:
    some = F.broadcast(sample_labels(labels, learn, F.col(label_col), id_col, sample_docs))  # at most sample_docs rows
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(some, "_id").select("text", "y")

    def emit(batches):
        for b in batches:
            keys, ys = [], []
            for text, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = stems(fold(text))
                keys += [*s, ""]
                ys += [y] * (len(s) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ys, pa.int32())], names=["stem", "y"])

    counts = joined.mapInArrow(emit, "stem string, y int").groupBy("stem").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (F.col("neg") + 2))  # few sightings weigh little
    total = counts.filter("stem = ''").first()
    if total is None or not total["pos"] or not total["neg"]:
        return Lexicon({})
    base = math.log((total["pos"] + 0.5) / (total["neg"] + 0.5))
    top = counts.filter((F.col("stem") != "") & (F.col("pos") >= MIN_DOCS)).withColumn("w", F.round(odds - base, 6)).filter(F.col("w") >= MIN_ODDS)
    top = top.orderBy("stem").collect()  # stems of at most sample_docs documents
    lexicon = Lexicon(_minimal({r["stem"]: r["w"] for r in top}))

    def second(batches):
        for b in batches:
            phrases, raws, ys = [], [], []
            for text, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                folded = fold(text)
                near = set()
                for s, e, _ in lexicon.hits(folded):
                    end = folded.find(" ", e)
                    word, before, after = folded[s:end].strip(), _word_before(folded, s), _word_after(folded, end)
                    near.update(" ".join(x) for x in ((before, word), (word, after)) if all(x))
                phrases.append(sorted(near))
                raws.append(lexicon.raw(text))
                ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.list_(pa.string())), pa.array(raws, pa.float64()), pa.array(ys, pa.int32())], names=["phrases", "raw", "y"])

    rows = joined.mapInArrow(second, "phrases array<string>, raw double, y int").collect()  # at most sample_docs rows
    clean: dict[str, int] = {}
    for r in rows:
        for p in r["phrases"] if r["y"] == 0 else []:
            clean[p] = clean.get(p, 0) + 1
    toxic = {p for r in rows if r["y"] == 1 for p in r["phrases"]}
    lexicon = Lexicon(lexicon.weights, sorted(p for p, n in clean.items() if n >= 2 and p not in toxic))
    raw, y = np.array([r["raw"] for r in rows]), np.array([r["y"] for r in rows])
    order = np.argsort(-raw, kind="stable")
    raw, y = raw[order], y[order]
    f1 = np.where(raw > 0, 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum()), -1)
    last = np.append(raw[1:] != raw[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = raw[k + 1] if k + 1 < len(raw) else 0.0
    lexicon.threshold = float(max(1e-6, below / 2 + raw[k] / 2 if below > 0 else raw[k] / 4))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", *carry: Column) -> DataFrame:
    """Per row: ``doc_id``, the columns of ``carry``, ``score`` and ``predicted``."""

    def run(batches):
        for b in batches:
            raw = np.array([lexicon.raw(t) for t in b.column(0).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lexicon.scores(raw), pa.float64())], names=[*b.schema.names[1:], "score"])

    d = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *carry)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[1:])
    return d.mapInArrow(run, f"{kept}, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))
