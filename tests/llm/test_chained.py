"""Operators one after the other on tables with clashing names, repeated and NULL ids, and very long texts."""

import random

import pytest

pytest.importorskip("quotemill.llm")
from pyspark.sql import functions as F  # noqa: E402

from quotemill.llm import common, decontamination, language_id, line_dedup, near_dedup, packing, quality_rules, toxicity  # noqa: E402

CLASHING = ["_gone", "_pos", "_doc", "_bad", "_lines", "_text", "_t", "component", "id", "doc", "text_", "n", "kept", "root", "block"]


def prose(rng, n):
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    return ".\n".join(" ".join(rng.choice(words) for _ in range(30)) for _ in range(n)) + "."


def test_five_stages_on_clashing_names(spark):
    rng = random.Random(11)
    texts = [prose(rng, 8) for _ in range(5)]
    rows = [(i, t, len(t or "")) for i, t in enumerate([*texts, texts[0], None, "", prose(rng, 3000)])] + [(None, texts[1], 5), (3, texts[3], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit(7) for c in CLASHING})
    items = spark.createDataFrame([(1, " ".join(texts[2].split()[10:40]))], "item_id long, text string")
    out = docs
    for stage in (quality_rules.clean_documents, line_dedup.dedup_lines, near_dedup.drop_near_duplicates, lambda d: decontamination.decontaminate(d, items)):
        out = stage(out)
        assert set(docs.columns) == set(out.columns) and len(out.columns) == len(docs.columns)
    left = {r["doc_id"] for r in out.collect()}
    assert {0, 1, 3, 4, 8} <= left and 2 not in left and all(r["component"] == 7 for r in out.collect())
    assert {r["doc_id"] for r in packing.pack(out).collect()} == left


def test_tables_go_with_the_job(spark):
    import os

    docs = spark.createDataFrame([(i, "one two three four five six seven eight " * (i % 3 + 1)) for i in range(9)], "doc_id long, text string")
    where = common.shared_dir(spark).removeprefix("file:")
    # tables and checkpoints alike: one result is left, and nothing of the rounds of the components
    everything = lambda: {x for folder, names, files in os.walk(where) for x in names if x.startswith(("table-", "rdd-"))}
    before = everything()
    out = near_dedup.near_duplicates(docs)
    assert len(everything() - before) == 1 and out.count() == 9
    before = everything()
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert common.connected_components(chain).agg(F.max("component")).first()[0] == 0
    assert len(everything() - before) <= 1


def test_small_looks_at_bytes(spark):
    wide = common.materialize(spark.createDataFrame([(1, list(range(1000)))], "id long, a array<long>"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.small(wide)) and not hinted(common.small(wide, 4000)) and hinted(common.small(wide.filter("id > 1"), 0))


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, ("le chat dort bien " if i % 2 else "der hund ist gross ") * 5, "fr" if i % 2 else "de") for i in range(60)]
    odd = [(100, "½ ² Ⅷ 12", None), (101, None, None), (102, "", None), (103, "é", None), (104, "der hund ist gross " * 40_000, None), (None, "le chat dort", None)]
    docs = spark.createDataFrame([*rows, *odd, rows[1]], "doc_id long, text string, lang string").coalesce(1)
    net = language_id.train(docs, F.lit(True), "doc_id", "text", "lang", sample_docs=20)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs, net).collect()]
    by = {d: (lang, score) for d, lang, score in got}
    assert len(got) == 67 and all(by[k] == ("und", 0.0) for k in (100, 101, 102)) and by[103][0] != "und"
    assert by[104][0] == "de" and by[None][0] == "fr" and all(by[i][0] == lang for i, _, lang in rows)
    for k in (1, 2, 104):  # a document alone
        (r,) = language_id.identify(docs.filter(F.col("doc_id") == k).limit(1), net).collect()
        assert r["lang_pred"] == by[k][0] and abs(r["score"] - by[k][1]) < 1e-5


def test_matches_equal_brute_force():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon({" ab": 1.0, " abc": 2.0, " b ": 3.0, "ca ": 0.5}, ["ab c", "b a", "c ab b"])
    for _ in range(300):
        folded = " " + "".join(rng.choice("abc  ") for _ in range(rng.randint(0, 40))) + " "
        at = lambda s: [k for k in range(len(folded) - len(s) + 1) if folded[k : k + len(s)] == s]  # noqa: E731, B023
        spans = [(k, k + len(x) + 1) for x in lexicon.exceptions for k in at(f" {x} ")]
        want = [(k, k + len(s) - 1, w) for s, w in lexicon.weights.items() for k in at(s) if not any(a <= k and k + len(s) - 1 <= z for a, z in spans)]
        assert sorted(lexicon.hits(folded)) == sorted(want)


def test_packed_pieces_cover_each_document_once(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, n)) for i, n in enumerate([0, 1, 3, 40, 700])] + [(9, None)], "doc_id long, text string")
    pieces = {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for parts in pieces.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total
    assert set(pieces) == {0, 1, 2, 3, 4, 9}
