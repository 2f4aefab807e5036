"""The corpus pipeline, stage by stage and whole, on planted documents."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(800)]
    sentence = lambda n=30: " ".join(["the", "and", "of", *(rng.choice(vocabulary) for _ in range(n)), "that", "with"]).capitalize() + "."
    fuzzy = sentence(40)
    words = fuzzy.split()
    words[7], words[20] = "changedonce", "changedtwice"
    texts = ["\n".join(sentence() for _ in range(6)) for _ in range(8)]
    texts[2] += "\n" + fuzzy
    texts[5] += "\n" + " ".join(words)
    item = " ".join(texts[7].split("\n")[3].split()[:25])
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        seen[name] = docs
    text = {name: {r["doc_id"]: r["text"] for r in df.collect()} for name, df in seen.items() if name != "packing"}
    assert text["quality_rules"] == dict(enumerate(texts))
    assert text["line_dedup"] == {**text["quality_rules"], 5: texts[5].rsplit("\n", 1)[0]}
    assert text["near_dedup"] == text["line_dedup"]
    assert text["decontamination"] == {i: t for i, t in text["near_dedup"].items() if i != 7}
    packed = sorted(map(str, seen["packing"].collect()))
    assert packed == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert {r["doc_id"] for r in seen["packing"].collect()} - {None} == set(text["decontamination"])
