"""Quality rules by line-first cleaning, in native column expressions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document that loses too much of its text is rejected. A base test on the whole text comes first: at
least 50 words, and no more than half of them inside 3-word windows that the text repeats.

Defined results: NULL text counts as empty (no words, base test failed, not kept); empty and blank
lines are never judged and stay; equal rows get equal results; an empty table gives an empty table;
other columns of the input are carried by :func:`clean_documents` and ignored by :func:`assess`.
The plan is one projection over the scan: no shuffle, so hot sources and copies do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import SEPARATORS, let, words

MIN_WORDS = 50
MAX_REPEAT = 0.5
MAX_LOST = 0.4  # share of word characters that removed lines may hold

# Patterns of the line rules (they read alike in Java and RE2).
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
SHOUT = r"[!?][!?]"
SENTENCE_MARK = r"[.!?;:,\x{2026}]"
SEPARATOR_MARK = r"(^|[\x20\x09])[|\x{BB}\x{203A}\x{2022}\x{B7}>]([\x20\x09]|$)"
BOILERPLATE = (
    r"(?i)(all rights reserved|licensed under|released under the|under the terms of|"
    r"gnu general public license|terms of (use|service)|privacy policy|use of cookies|accept cookies|"
    r"enable javascript|copyright (\(c\)|\x{A9})|lorem ipsum)"
)
NAVIGATION = (
    r"(?i)^[\x20\x09]*(home|menu|log ?in|sign ?(in|up)|subscribe|share( this)?|next( page)?|previous( page)?|"
    r"read more|click here|back to top|skip to (main )?content)[\x20\x09]*$"
)
LONG_LINE = 20  # words from which a line without any sentence mark fails


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are packed as 38 bits of hash and
    26 bits of position, so that one primitive sort brings equal windows together; neighbours in that
    order are compared word by word, and sorted starts give the size of the union of the windows."""
    n = F.size(w)

    def window(p: Column) -> Column:
        return F.slice(w, p, F.lit(3))

    packed = F.sort_array(
        F.transform(
            F.sequence(F.lit(1), n - 2),
            lambda i: F.shiftleft(F.xxhash64(window(i)), 26).bitwiseOR(i.cast("long")),
        )
    )

    def starts(s: Column) -> Column:
        def at(x: Column) -> Column:
            return x.bitwiseAND(F.lit((1 << 26) - 1)).cast("int")

        def same(x: Column, y: Column) -> Column:
            near = F.shiftright(x, 26) == F.shiftright(y, 26)
            return F.when(near, window(at(x)) == window(at(y))).otherwise(F.lit(False))

        hits = F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))
        return F.sort_array(F.transform(hits, at))

    def union_size(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return F.when(n < 4, F.lit(0)).otherwise(let(let(packed, starts), union_size))


def line_fails(line: Column) -> Column:
    """True if a line with a word fails a rule."""
    chars = _length_without(line, SEPARATORS)
    symbols = F.length(line) - _length_without(line, SYMBOL)
    n_words = F.size(words(line))
    punctuation = (symbols * 10 >= chars) | (F.regexp_count(line, F.lit(SHOUT)) * 4 >= n_words)
    punctuation = punctuation | ((n_words >= LONG_LINE) & ~line.rlike(SENTENCE_MARK))
    navigation = (F.regexp_count(line, F.lit(SEPARATOR_MARK)) >= 3) | line.rlike(NAVIGATION)
    return punctuation | navigation | line.rlike(BOILERPLATE)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carry: str) -> DataFrame:
    """Per row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_failed_lines, lost_chars, clean_text, kept`` and the columns named in ``carry``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    text, lines = F.col("_t"), F.split(F.col("_t"), "\n")
    full = F.filter(lines, lambda x: x.rlike(HAS_WORD))
    d = d.select(
        "*",
        F.size(words(text)).cast("long").alias("n_words"),
        _length_without(text, SEPARATORS).cast("long").alias("word_chars"),
        (F.length(text) - _length_without(text, SYMBOL)).cast("long").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words(text), _repeat_words).cast("long").alias("n_repeat_words"),
        F.transform(lines, lambda x: F.struct(x.alias("line"), (x.rlike(HAS_WORD) & line_fails(x)).alias("bad"))).alias("_l"),
    )
    bad = F.filter("_l", lambda x: x["bad"])
    d = d.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words"))).alias("base_failed"),
        F.size(bad).cast("long").alias("n_failed_lines"),
        F.aggregate(bad, F.lit(0), lambda a, x: a + _length_without(x["line"], SEPARATORS)).cast("long").alias("lost_chars"),
        F.array_join(F.transform(F.filter("_l", lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= int(100 * MAX_LOST) * F.col("word_chars"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_failed_lines", "lost_chars", "clean_text", kept.alias("kept"), *[F.col(f"_carry_{c}") for c in carry],
    )


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Documents that are kept, without their failing lines, in the columns of ``docs``; ``n_chars`` follows."""
    judged = assess(docs, id_col, text_col, *docs.columns).filter("kept")
    new = {text_col: F.col("clean_text"), chars_col: F.length("clean_text").cast("long")}
    return judged.select(*[new.get(c, F.col(f"_carry_{c}")).alias(c) for c in docs.columns])
