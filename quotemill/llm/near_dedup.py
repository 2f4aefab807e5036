"""MinHash near-duplicate detection with an LSH forest.

A document's set is its distinct 2-word shingles (A-Z lower-cased; with fewer words the whole sequence is
one shingle; with none the set is empty and linked with nothing). Documents with Jaccard similarity of at
least ``percent`` / 100 are linked, and components of links are returned.

* Rows with equal sets are first collapsed onto their smallest id by a map-side combined minimum, so exact
  copies, however many, cost one row from there on.
* Every set gets ``TREES`` MinHash signatures of ``LEVELS`` labels; a tree is the documents in the order of
  their signature, and a region of it is a run of documents whose signatures share a prefix. Documents with
  a common prefix of at least ``MIN_DEPTH`` labels are candidates. A region with more than ``REGION``
  documents is split at the next level (adaptive depth), until the signature ends.
* Every region links its members to its root at every depth it passes (a star, linear in the region).
  The root is the smallest id, in larger regions the member nearest to the majority of the region's
  sketches: edited copies of one text are linked to that text, though not to each other. Stars give first components; members that a leaf region's star did not reach are then compared
  with all members of that region in other components, so that a group of thousands of near copies is
  never expanded into pairs while pairs that could join two components are all looked at.
* A candidate pair must fit by set size, by a sketch (four bits of each MinHash, with a bound at six standard
  deviations) and by an odd sketch (Mitzenmacher et al. 2014): 512 parities of hashed shingles, in which two
  sets differ in no more bits than in shingles, so that this bound never loses a link and is close for sets
  of up to about a thousand shingles. What fits is confirmed on the full sets before it links.

A pair at similarity s is a candidate with probability 1 - (1 - s**MIN_DEPTH)**TREES: 0.9999994 at 0.8.

Defined results: NULL or blank texts form components of their own; rows with a NULL id are returned with
``n_shingles`` and NULL component, kept; repeated rows of one id share its component; ties go to the
smallest id; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import connected_components, fresh, materialize, own_tables, region_links, small

TREES, LEVELS, MIN_DEPTH, REGION = 20, 6, 3, 64
PERCENT = 80
#: Labels of 120 in which sketches (4 bits of each MinHash) of a linked pair may differ: 22.5 are expected
#: at similarity 0.8, with a standard deviation of 4.3.
MAX_APART = 48
CENTRED = 8
SKETCH = [f"b{k}" for k in range(TREES * LEVELS // 15)]
ODD = [f"o{k}" for k in range(8)]  # 512 parities
COMPARED = ["n", *SKETCH, *ODD]

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_MULTIPLIERS = _mix(np.arange(1, TREES * LEVELS + 1, dtype=np.uint64)) | _U(1)


def shingle_hashes(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(size, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[j : len(w) - k + 1 + j])
    return np.unique(out)


def _minima(hashes: np.ndarray) -> np.ndarray:
    best = np.full(len(_MULTIPLIERS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 2048):
        x = hashes[None, i : i + 2048] * _MULTIPLIERS[:, None]
        np.minimum(best, (x >> _U(32)).astype(np.uint32).min(axis=1), out=best)
    return _mix(best.astype(np.uint64))


def _signatures(size: int):
    def run(batches):
        for b in batches:
            ids, n, fp, key, bits, odd = b.column(0), [], [], [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_hashes(text, size)
                n.append(len(h))
                fp.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                m = _minima(h)
                key.append((m & _U(0xFFFF)).astype(">u2").tobytes() if len(h) else None)
                bits.append((m >> _U(40)) & _U(15))
                odd.append(np.packbits(np.bincount((h >> _U(55)).astype(np.int64), minlength=512) & 1))
            nibbles = np.array(bits, np.uint64).reshape(len(bits), len(SKETCH), 15) << (_U(4) * np.arange(15, dtype=np.uint64))
            sketch = np.bitwise_or.reduce(nibbles, axis=2).view(np.int64)
            sketch = np.hstack([sketch, np.array(odd, np.uint8).reshape(len(odd), 8 * len(ODD)).view(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(fp, pa.binary()), pa.array(key, pa.binary()), pa.array(n, pa.int32()), *[pa.array(np.ascontiguousarray(c)) for c in sketch.T]],
                names=["doc_id", "fp", "key", *COMPARED],
            )

    return run


def _sets(size: int):
    def run(batches):
        for b in batches:
            sets = [shingle_hashes(t, size).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return run


def _fits(a: str, b: str, percent: int):
    """Whether two candidates can reach the similarity by set size and by sketch."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.lit(0)
    for k in SKETCH:  # labels that differ: non-zero groups of four bits
        x = F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        apart = apart + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    odd = F.lit(0)
    for k in ODD:
        odd = odd + F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}")))
    near = (100 + percent) * odd <= (100 - percent) * (na + nb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & near & (apart <= MAX_APART)


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets reach the similarity. Only documents in a pair are read again."""
    pairs = materialize(pairs.select("a", "b").distinct())
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = docs.join(small(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = materialize(texts.mapInArrow(_sets(size), "id long, s array<long>"))
    two = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return materialize(two.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b"))


def _forest(reps: DataFrame) -> DataFrame:
    """``t, key, id``: every set once in each tree, with that tree's signature."""
    width = 2 * LEVELS
    t = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")
    rows = reps.select(F.col("doc_id").alias("id"), "key", t)
    return rows.withColumn("key", F.substring("key", F.col("t") * width + 1, F.lit(width)))


def _centred(rows: DataFrame) -> DataFrame:
    """``rows`` with the most central member as root of every region of at least ``CENTRED`` members: a
    majority vote of 120 bits of the sketches, then the member that differs from it in the fewest."""
    big = rows.filter(F.col("many") >= CENTRED)
    votes = {f"v{c}_{k}": F.sum(F.shiftright(c, k).bitwiseAND(F.lit(1))) for c in SKETCH[:2] for k in range(60)}
    won = big.groupBy("t", "p").agg(F.count("*").alias("n_in"), *[v.alias(k) for k, v in votes.items()])
    for c in SKETCH[:2]:
        bits = [F.when(2 * F.col(f"v{c}_{k}") > F.col("n_in"), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(60)]
        won = won.withColumn(f"m{c}", F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda a, x: a + x))
    won = materialize(won.select("t", "p", *[f"m{c}" for c in SKETCH[:2]]))
    far = F.bit_count(F.col("b0").bitwiseXOR(F.col("mb0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("mb1")))
    best = big.join(won, ["t", "p"]).groupBy("t", "p").agg(F.min(F.struct(far.alias("far"), "id")).alias("best"))
    rows = rows.join(best, ["t", "p"], "left")
    return materialize(rows.withColumn("root", F.coalesce("best.id", "root")).drop("best"))


@own_tables
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = materialize(docs.mapInArrow(_signatures(size), "doc_id long, fp binary, key binary, n int, " + ", ".join(f"{k} long" for k in SKETCH + ODD)))
    with_id = sig.filter("doc_id IS NOT NULL AND n > 0")
    first = materialize(with_id.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    reps = with_id.join(first.select(F.col("rep").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi").dropDuplicates(["doc_id"])

    sketches = materialize(reps.select(F.col("doc_id").alias("id"), *COMPARED))
    stars, leaves, rows = [], [], _forest(reps)
    for depth in range(MIN_DEPTH, LEVELS + 1):
        rows = rows.withColumn("p", F.substring("key", 1, 2 * depth))
        if depth == MIN_DEPTH:
            rows = materialize(rows)
        regions = rows.groupBy("t", "p").agg(F.count("*").alias("many"), F.min("id").alias("root")).filter("many > 1")
        rows = rows.join(regions, ["t", "p"])
        rows = _centred(materialize(rows.join(sketches, "id") if depth == MIN_DEPTH else rows))
        roots = rows.filter("id = root").select("t", "p", "id", *COMPARED)
        x, r = rows.filter("id <> root").alias("x"), roots.alias("r")
        stars.append(x.join(r, (F.col("x.t") == F.col("r.t")) & (F.col("x.p") == F.col("r.p")) & _fits("x", "r", percent)).select(F.col("r.id").alias("a"), F.col("x.id").alias("b")))
        last = depth == LEVELS
        leaves.append(rows.filter(F.lit(True) if last else F.col("many") <= REGION).select("t", F.lit(depth).alias("depth"), "p", "id"))
        if last or rows.filter(F.col("many") > REGION).isEmpty():
            break
        rows = rows.filter(F.col("many") > REGION).select("t", "key", "id", *COMPARED)
    links = region_links(
        _union(leaves), ["t", "depth", "p"], sketches, lambda a, b: _fits(a, b, percent), lambda pairs: _confirmed(pairs, docs, size, percent), _union(stars)
    )
    groups = materialize(connected_components(links))

    first = first.join(groups, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n", "fp").join(first, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group (the smallest id); columns unchanged."""
    gone = fresh("gone")
    dropped = near_duplicates(docs, id_col, text_col, size, percent).filter("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(small(dropped), F.col(id_col).cast("long") == F.col(gone), "left_anti")
