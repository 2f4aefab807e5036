"""Prefix trie, whitening and sharding against plain versions, with odd rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("quotemill.llm")
from quotemill.llm import prefix_trie, sharding, whitening  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, depth string, n long"


def plain_trie(rows, rebuild):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            text = r[3] or ""
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    paths = dict(own)
    if rebuild:
        for c, turns in own.items():
            base, h = c - c % 100, zlib.crc32(str(c).encode()) % 6
            paths[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), up, len(m), kids.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def conversations():
    say = lambda k: f"text {k} é\n" * (k % 3 + 1)
    rows = []
    for c in range(95, 330):  # base 0 is absent, 100, 200 and 300 are there
        if c == 200:
            rows += [(200, 0, "user", "short base", "x", 1), (200, 1, "assistant", "end", "x", 1)]
            continue
        n = 40 if c == 107 else 1 + c % 9
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", say(t if t < 4 + c % 4 else c * 100 + t), "x", 1) for t in range(n)]
    rows += [(400 + i, t, "user", say(t), "x", 1) for i in range(300) for t in range(5)]  # one large group of copies
    rows += [(900, None, None, None, "x", 1), (900, 3, "user", None, "x", 1), (900, 3, "assistant", "tie", "x", 1), (900, 3, "assistant", "tie", "x", 1), (900, -2000, "user", "early", "x", 1)]
    rows += [(None, 0, "user", "no conversation", "x", 1), (-7, 0, "user", "negative", "x", 1), (5000, 1, "user", "long " * 30000, "x", 1)]
    return rows


@pytest.mark.parametrize(("rebuild", "block"), [(True, 4), (False, 4), (True, 1), (False, 7)])
def test_trie_equals_plain_version(spark, rebuild, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 8)  # so that several stretches are met
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS)
    got = prefix_trie.prefix_trie(df, block=block, rebuild=prefix_trie.branched if rebuild else None)
    assert sorted(map(tuple, got.collect())) == plain_trie(rows, rebuild)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS), rebuild=prefix_trie.branched).collect() == []
    got = prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a", "x", 1)], TURNS))
    assert got.collect() == []


def test_rank_one_updates_equal_a_dense_decomposition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        dim = int(rng.integers(1, 9))
        y = rng.integers(0, 4, (int(rng.integers(1, 40)), dim)) * rng.integers(0, 2, dim) + whitening.SHIFT
        whole, a, b = whitening.Spectrum(dim), whitening.Spectrum(dim), whitening.Spectrum(dim)
        for i, v in enumerate(y):
            whole.add(v, 1)
            (a if i % 3 else b).add(v, 1)
        a.merge(b)
        scatter = (y - y.mean(0)).T @ (y - y.mean(0))
        for s in (whole, a):
            assert np.abs(s.vectors * s.values @ s.vectors.T - scatter).max() < 1e-9 * (1 + np.abs(scatter).max())
            assert np.abs(s.vectors.T @ s.vectors - np.eye(dim)).max() < 1e-10
            assert (np.diff(s.values) >= -1e-9 * (1 + abs(s.values[-1]))).all()
            assert s.n == len(y) and (s.sums == y.sum(0)).all()


VECTORS = "vec_id long, embedding array<float>, label int, n string, component string"


def test_whitening_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(900, 12)) @ rng.normal(size=(12, 12)) * 0.1).astype(np.float32)
    x[300:600] = x[0]  # a third are copies
    rows = [(i, v.tolist(), 0, "x", "y") for i, v in enumerate(x)]
    odd = [(1000, None, 0, "x", "y"), (1001, [float("nan")] * 12, 0, "x", "y"), (1002, [1.0] * 11 + [float("inf")], 0, "x", "y"), (1003, [1.0] * 11 + [None], 0, "x", "y"), (1004, [], 0, "x", "y"), (1005, [0.5] * 3, 0, "x", "y")]
    twice = [(None, x[5].tolist(), 0, "x", "y"), (7, x[7].tolist(), 0, "x", "y")]
    got = whitening.whiten(spark.createDataFrame(rows + odd + twice, VECTORS).repartition(11)).toPandas()
    keep = np.vstack([x, x[5], x[7]]).astype(float)
    whole = np.floor(1024 * keep).astype(int) + 100000
    n, sums = len(whole), whole.sum(0)
    c = whole - whole.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    assert len(got) == 8 * n and set(got["component"]) == set(range(1, 9)) and (got["n"] == n).all()
    assert (got["identity_error"] < 1e-9).all() and got["identity_error"].nunique() == 1
    exact = {i: sum(int(d) ** 2 for d in n * whole[i] - sums) for i in range(900)}
    assert all(exact[int(r.vec_id)] == r.deviation for r in got.dropna(subset="vec_id").itertuples())
    for k in range(1, 9):
        g = got[(got["component"] == k)].dropna(subset="vec_id").drop_duplicates("vec_id").sort_values("vec_id")
        want = (c @ vectors[:, -k] / np.sqrt(values[-k]))[:900]
        assert min(np.abs(g["whitened"] - want).max(), np.abs(g["whitened"] + want).max()) < 1e-8
        assert np.allclose(g["explained"], values[-k] / values.sum(), rtol=1e-9)


def test_whitening_without_variance_and_of_few_dimensions(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.1, 0.2], 0, "x", "y")] * 3, VECTORS)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [0.1, 0.2], 0, "x", "y"), (2, [0.3, 0.2], 0, "x", "y")], VECTORS)).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["explained"]) for r in got) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


DOCS = "doc_id long, text string, lang string, shard string, slot long"


def test_shards_are_even_and_keep_groups(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(["wörd"] * int(n)) + f" {i}" for i, n in enumerate(rng.lognormal(4, 1, 3000))]
    texts += ["the same again"] * 1500 + ["a pair " * 30] * 2 + [None, "", "long " * 4000]
    rows = [(i, t, "en", "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "en", "x", 1), (4, texts[4], "en", "x", 1), (4, texts[4], "en", "x", 1)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS).repartition(7)).toPandas()
    size = lambda t: len((t or "").encode()) + 1
    by_id = dict(enumerate(texts))
    assert len(got) == len(rows) and set(got["shard"]) == set(range(16))
    known = got.dropna(subset="doc_id")
    assert all(r.size == size(by_id[int(r.doc_id)]) and r.text_crc32 == zlib.crc32((by_id[int(r.doc_id)] or "").encode()) for r in known.rename(columns={"size": "size"}).itertuples())
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    loads = got.groupby("shard").agg(bytes=("size", "sum"), tokens=("tokens", "sum"), rows=("slot", "count"))
    for c in loads:
        assert loads[c].max() / loads[c].mean() < 1.02 and loads[c].min() / loads[c].mean() > 0.98
    parts = got.groupby(["text_crc32", "size"])["shard"].nunique()
    assert set(parts[parts > 1].index) == {(zlib.crc32(b"the same again"), 15)}  # more than a shard's rows


def test_shards_of_little(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, None, "en", "x", 1), (2, "", "en", "x", 1), (3, "b c", "en", "x", 1), *[(i, f"text {i}", "en", "x", 1) for i in range(4, 60)]]
    where = {r["doc_id"]: (r["shard"], r["slot"], r["size"], r["tokens"]) for r in sharding.shard(spark.createDataFrame(rows, DOCS)).collect()}
    assert where[1][0] == where[2][0] and where[1][1] != where[2][1] and len(where) == 59
    assert where[3][2:] == (4, 2) and where[1][2:] == (1, 0)


def test_placing_takes_the_highest_dot_product():
    assert sharding.place(np.array([[4.0, 1], [4, 1], [1, 4], [1, 4]]), 2).tolist() == [0, 1, 0, 1]
    assert sharding.place(np.zeros((0, 3)), 4).tolist() == []
