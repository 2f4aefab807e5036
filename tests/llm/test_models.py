"""The learnt operators against plain versions, and their odd rows: NULL ids, repeated rows, long texts, clashing names."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quotemill.llm")
from quotemill.llm import language_id, quality_classifier, token_counts, toxicity  # noqa: E402


# ---- language


def plain_log_probs(net, data):
    """Loops over every window, filter and place."""
    total, size = np.zeros(len(net.classes)), 0
    for at in range(0, max(len(data), 1), language_id.WINDOW):
        piece = data[at : at + language_id.WINDOW]
        e = [net.p["e"][b].astype(float) for b in piece + bytes(language_id.WINDOW - len(piece))]
        pooled = []
        for w in language_id.WIDTHS:
            k = net.p[f"w{w}"].astype(float)
            places = [np.concatenate(e[i : i + w]) @ k for i in range(language_id.WINDOW - w + 1)]
            pooled += [max(p[f] for p in places) + float(net.p[f"c{w}"][f]) for f in range(language_id.FILTERS)]
        z = np.maximum(pooled, 0) @ net.p["o"].astype(float) + net.p["b"]
        z = z - z.max()
        total += (z - math.log(np.exp(z).sum())) * len(piece)
        size += len(piece)
    return total / size


def test_forward_pass_equals_loops(spark):
    net = language_id.ByteConvNet(["a", "b", "c"], seed=4)
    net.p["b"] += np.array([0.1, -0.2, 0.05], np.float32)
    rng = random.Random(3)
    texts = ["é", "".join(rng.choice("abcdé ñ\n") for _ in range(300)), "x" * 256, "word " * 130, "y" * 257]
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()
    for r in got:
        lp = plain_log_probs(net, texts[r["doc_id"]].encode())
        p = np.exp(lp - lp.max())
        assert r["lang_pred"] == net.classes[int(lp.argmax())] and abs(r["score"] - p.max() / p.sum()) < 1e-4


def test_gradients_equal_differences():
    net = language_id.ByteConvNet(["a", "b"], seed=1)
    rng = np.random.default_rng(2)
    x, y, weight = rng.integers(0, 256, (4, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])

    def loss():
        f, _ = net.features(x)
        z = f @ net.p["o"] + net.p["b"]
        z = z - z.max(axis=1, keepdims=True)
        return float((-(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(4), y] * weight).mean())

    grads = net._gradients(x, y, weight)
    for name, at in (("o", (3, 1)), ("b", (0,)), ("w2", (5, 2)), ("w4", (1, 7)), ("c3", (4,)), ("e", (int(x[0, 10]), 2))):
        held = net.p[name][at]
        values = []
        for step in (np.float32(2e-3), np.float32(-2e-3)):
            net.p[name][at] = held + step
            values.append(loss())
        net.p[name][at] = held
        assert abs((values[0] - values[1]) / 4e-3 - grads[name][at]) < 2e-3 + 0.02 * abs(grads[name][at]), name


# ---- quality


def plain_features(text):
    text = text or ""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = lambda s: sum(1 for i in _apart(text, s))
    raw = [
        sum(c in "#*$%&|<>" for c in text) / chars, (count("!!") + count("??")) / n, sum(w.isupper() for w in words) / n, count(" | ") / n,
        sum(words[i] == words[i - 1] for i in range(1, len(words))) / n, 1 - len(set(windows)) / len(windows) if windows else 0.0, max(Counter(words).values(), default=0) / n,
        sum(line.rstrip()[-1] not in '.!?…"”' for line in lines) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
    ]
    return [*raw, *[v / (v + 0.05) for v in raw], min(1.0, math.log(1 + len(words)) / 12), min(1.0, chars / n / 20), float(len(words) < 20)]


def _apart(text, s):
    at = text.find(s)
    while at >= 0:
        yield at
        at = text.find(s, at + len(s))


def test_features_equal_a_plain_count():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "!!", "?", " | ", "\n", " ", "x x", "#", ".", "É", "aa bb cc "]) for _ in range(rng.randint(0, 60)))
        np.testing.assert_allclose(quality_classifier.features(text), plain_features(text), atol=1e-12)
    assert quality_classifier.features(None) == quality_classifier.features("") and len(plain_features(None)) == quality_classifier.N_FEATURES


def test_ranking_minimises_the_pairwise_loss_and_cuts_at_the_quantile():
    rng = np.random.default_rng(9)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.random((400, 5)) + y[:, None] * np.array([0.3, 0, -0.2, 0, 0.05])
    model = quality_classifier.Ranking(x, y, seed=3)
    z = (x - x.mean(0)) / x.std(0)
    pairs = [(i, j) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)]
    d = np.array([z[i] - z[j] for i, j in pairs])  # every preference, not a sample
    loss = lambda w: float(np.log1p(np.exp(-d @ w)).mean())
    w = np.zeros(5)
    for _ in range(3000):
        w += 0.5 * (d / (1 + np.exp(d @ w))[:, None]).mean(0)
    assert loss(model.w) < loss(w) + 0.01
    scores = model.score(x)
    assert abs(int((scores < quality_classifier.CUT).sum()) - int((y == 0).sum())) <= 1  # as many below the cut as are labelled 0
    order = np.argsort(z @ model.w)
    assert (np.diff(scores[order]) >= -1e-12).all()


# ---- toxicity


def test_lexicon_equals_a_plain_count(spark):
    rng = random.Random(8)
    clean = ["table", "garden", "window", "moroccan", "yellow", "simple", "reading"]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(clean) for _ in range(rng.randint(3, 12))]
        bad = i % 4 == 0
        if bad:
            words[1] = rng.choice(["m0ron", "MORONS", "scumbag", "ѕcumbags", "worthless"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.train(docs, known, F.lit(True))
    pos, neg, n = Counter(), Counter(), Counter(y for _, y in labels)
    for (_, text), (_, y) in zip(rows, labels, strict=True):
        folded = text.lower()
        for a, b in (("ѕ", "s"), ("0", "o"), ("l", "i")):
            folded = folded.replace(a, b)
        found = set()
        for w in folded.split():
            found |= {" " + w[:k] for k in toxicity.STEMS if k < len(w)}
            found.add(" " + w if len(w) in toxicity.STEMS else f" {w} ")
        (pos if y else neg).update(found)
    base = math.log((n[1] + 0.5) / (n[0] + 0.5))
    weight = {s: math.log((k + 0.5) / (neg[s] + 2)) - base for s, k in pos.items() if k >= toxicity.MIN_DOCS}
    weight = {s: w for s, w in weight.items() if w >= toxicity.MIN_ODDS}
    want = {s: w for s, w in weight.items() if not any(s != t and s.startswith(t) for t in weight)}
    assert set(lexicon.weights) == set(want) and all(abs(lexicon.weights[s] - w) < 1e-5 for s, w in want.items()) and len(want) >= 2
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, lexicon).collect()}
    assert all(scored[i] == y for i, y in labels)


# ---- odd rows


def test_odd_rows_of_the_scorers(spark):
    good, bad = "A calm line of words that ends well. ", "BUY NOW!! | BUY NOW!! | moron moron ### "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 3), "en" if i % 2 else "xx", 0.5, 1, "s") for i in range(160)]
    odd = [(None, good, "en", 0.5, 1, "s"), (None, bad, None, 0.5, 1, "s"), (1000, None, None, 0.5, 1, "s"), (1001, "", None, 0.5, 1, "s"), (1002, good * 20_000, "en", 0.5, 1, "s"), (1003, bad * 20_000, "xx", 0.5, 1, "s"), rows[1], rows[2]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double, predicted int, n_tokens string").coalesce(2)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(160)] + [(None, 1, 1), (7, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    everything = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    quality = quality_classifier.score(docs, quality_classifier.train(docs, labels, F.lit(True)))
    toxic = toxicity.score(docs, toxicity.train(docs, labels, F.lit(True)))
    for out, calm in ((quality, 1), (toxic, 0)):
        assert out.columns == ["doc_id", "score", "predicted"] and out.count() == 168
        by = {}
        for d, s, p in everything(out):
            assert 0 <= s <= 1 and p == int(s >= 0.3)
            by.setdefault(d, []).append((s, p))
        assert len(by[1]) == 2 and by[1][0] == by[1][1] and len(by[None]) == 2  # repeated rows agree, rows without an id stay
        assert all(by[i][0][1] == (calm if i % 2 else 1 - calm) for i in range(160)) and sorted(p for _, p in by[None]) == [0, 1]
        assert by[1000][0] == by[1001][0] and by[1002][0][1] == calm and by[1003][0][1] == 1 - calm
    net = language_id.train(docs, F.lit(True), "doc_id", "text", "lang", sample_docs=40)
    langs = {}
    for d, lang, s in everything(language_id.identify(docs, net)):
        langs.setdefault(d, []).append(lang)
    assert langs[1] == ["en", "en"] and langs[1000] == langs[1001] == ["und"] and langs[1002] == ["en"] and langs[1003] == ["xx"] and sorted(langs[None]) == ["en", "xx"]
    counts = {}
    for r in token_counts.count_tokens(docs).collect():
        counts.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_tokens"]))
    assert counts[1][0] == counts[1][1] and counts[1000] == counts[1001] == [(0, 0)] and len(counts[None]) == 2
    assert counts[1002][0][0] == len(good) * 20_000 and counts[1002][0][1] > 100_000
    for f in (lambda d: quality_classifier.score(d, None), lambda d: toxicity.score(d, toxicity.Lexicon({})), lambda d: language_id.identify(d, None), token_counts.count_tokens):
        assert f(docs.limit(0)).collect() == []
