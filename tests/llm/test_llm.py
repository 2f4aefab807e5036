"""Corpus operators against brute force, library results and edge cases."""

import struct
import zlib

import pytest

pytest.importorskip("quotemill.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quotemill.llm import decontamination, language_id, line_dedup, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity  # noqa: E402

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"
TEXTS = [
    BASE, BASE, BASE.replace("kappa", "kapow"), BASE.upper(), None, "", "   \n", "word", "word", "a b\n" * 30, "don't <|endoftext|> é漢字 x\x1cy 12.5%", BASE + " " + BASE,
    "\n".join([BASE + ".", "Home", "All rights reserved."] * 3), "long " * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i}", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, component string, n_chars long")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_near_duplicates_equal_brute_force(docs):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False))

    s = [shingles(t) for t in TEXTS]
    group = list(range(len(s)))
    for _ in s:
        for i in range(len(s)):
            for j in range(i):
                if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                    group[i] = group[j] = min(group[i], group[j])
    got = by_id(near_dedup.near_duplicates(docs))
    assert {i: got[i]["component_id"] for i in range(len(s))} == dict(enumerate(group))
    assert all(got[i]["n_shingles"] == len(s[i]) for i in range(len(s))) and got[None]["kept"]


def test_token_counts_equal_library(docs):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(token_counts.count_tokens(docs))
    for i, t in enumerate(TEXTS):
        assert got[i]["n_tokens"] == len(lib.encode(t or "", add_special_tokens=False).ids)
        cut = (t or "")[: got[i]["limit_chars"]]
        assert len(lib.encode(cut, add_special_tokens=False).ids) <= token_counts.LIMIT


def test_packing_round_trip(docs):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            ids = [*lib.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, packing.END_ID]
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_repeated_windows_equal_brute_force(docs):
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone.update(range(k, k + 20))
            seen.add(key)
        want[i] = (len(w), len(gone))
    got = by_id(substring_dedup.remove_repeats(docs))
    assert {i: (got[i]["n_words"], got[i]["n_removed"]) for i in want} == want and got[None]["n_removed"] == 0


def test_line_dedup_keeps_one_of_each_group(docs):
    got = by_id(line_dedup.dedup_lines(docs))
    # document 2 differs in a word: whether the lines share a block is up to their hashes
    assert got[0]["_gone"] == 0 and [got[i]["text"] for i in (1, 3)] == [""] * 2
    assert got[4]["text"] is None and got[None]["text"] == BASE and got[9]["_gone"] == 0
    assert set(got[0].asDict()) == {*docs.columns, "_lines", "_gone"}


def test_quality_rules(docs):
    got = by_id(quality_rules.assess(docs))
    assert got[4]["n_words"] == 0 and got[4]["base_failed"] and not got[4]["kept"]
    assert got[12]["n_dup_lines"] == 6 and got[13]["n_repeat_words"] == 5000
    assert quality_rules.clean_documents(docs).columns == docs.columns


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, " ".join(BASE.split()[3:25])), (2, "word"), (3, None), (4, "not there at all my friend")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(docs, items).collect()}
    assert {(i, 1) for i in (0, 1, 3, 11, 12)} | {(7, 2), (8, 2)} <= got and {k for _, k in got} == {1, 2}
    assert decontamination.decontaminate(docs, items).columns == docs.columns


def test_classifiers_on_planted_texts(spark):
    rows = [(i, ("the cat sat on a mat and you idiot left. " if i % 3 == 0 else "the cat sat on a mat and then left. ") * 3 if i % 2 else "x!! y!! z!! " * 20, "en" if i % 2 else "zz") for i in range(240)]
    d = spark.createDataFrame([*rows, (999, None, None)], "doc_id long, text string, lang string")
    labels = d.filter("doc_id < 240").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), ((F.col("doc_id") % 6) == 3).cast("int").alias("toxic"))
    net = language_id.train(d, F.lit(True), "doc_id", "text", "lang")
    got = by_id(language_id.identify(d, net))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and got[999]["lang_pred"] == "und"
    q = by_id(quality_classifier.score(d, quality_classifier.train(d, labels, F.lit(True))))
    assert all(q[i]["predicted"] == i % 2 for i in range(240))
    t = by_id(toxicity.score(d, toxicity.train(d, labels, F.lit(True))))
    assert all(t[i]["predicted"] == (i % 6 == 3) for i in range(240)) and t[999]["score"] == 0
    assert toxicity.Lexicon({" idiot": 5.0}).raw("you 1d10t") > 0


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        near_dedup.near_duplicates(none), token_counts.count_tokens(none), packing.pack(none), substring_dedup.remove_repeats(none), line_dedup.dedup_lines(none),
        quality_rules.assess(none), decontamination.contained_items(none, items), language_id.identify(none, None), toxicity.score(none, toxicity.Lexicon({})), quality_classifier.score(none, None),
    ):
        assert df.count() == 0


def test_lines_are_hashed_alike_whole_and_cut(monkeypatch):
    import pyarrow as pa

    from quotemill.llm import line_dedup

    texts = ["One two, THREE four 5five\n\nshort line\nä b c d e f\n", None, "", " \n ", "one two three four 0five", "x " * 700 + "\nlast line has six words here"]
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(texts)), pa.int64()), "text": texts})
    whole = pa.Table.from_batches(list(line_dedup._hashes([batch]))).to_pylist()
    assert [(r["doc"], r["pos"], r["n"]) for r in whole] == [(0, 0, 5), (0, 3, 6), (4, 0, 5), (5, 0, 700), (5, 1, 6)]
    assert whole[0]["id"] == whole[2]["id"] and (whole[0]["s0"], whole[0]["s1"]) == (whole[2]["s0"], whole[2]["s1"])
    assert len({r["id"] for r in whole}) == 4
    monkeypatch.setattr(line_dedup, "PIECE", 8)
    cut = pa.Table.from_batches(list(line_dedup._hashes([batch]))).to_pylist()
    assert cut == whole


def test_odd_sketch_never_exceeds_the_difference():
    import numpy as np

    from quotemill.llm import near_dedup

    texts = [" ".join(f"w{(i * k) % 97}" for i in range(60 + k)) for k in (1, 2, 3, 5)]
    sets = [near_dedup.shingle_hashes(t) for t in texts]
    odd = [np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=512) & 1 for h in sets]
    for a, x in zip(sets, odd, strict=True):
        for b, y in zip(sets, odd, strict=True):
            assert (x != y).sum() <= len(np.setxor1d(a, b))
