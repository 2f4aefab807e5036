"""Prefix trie of conversations by fixed-length block hashing.

A conversation's turns are cut into blocks of ``block`` turns. The key of a prefix is the exclusive or of 128-bit hashes
of its turns, each taken with its position, so keys of blocks follow from partial sums. Conversations are grouped by the
successive keys of their blocks first: one row for each distinct block of a distinct start, combined before the shuffle.
Where all that go on from a start share one block, the nodes inside it have the same members and are read off that one row;
only where siblings diverge (or one ends inside the block) are the turns of the distinct blocks grouped one by one.

Sums over subtrees need no walk of the tree: each node belongs to its smallest member, each conversation carries the sum of
its own nodes, and a node's subtree holds what its members carry, less the nodes of its smallest member above it. So the
trie's depth costs no rounds. Running values along a conversation go by stretches of ``STRETCH`` turns, then by the
stretches' totals, so one conversation with a third of all turns is no single task's. The SHA-256 of the ids that end at a
node reads them in order: strings of the ids of a range of 256 are joined, then streamed through one hasher a node.

Defined results: NULL turns come first; turns of one conversation with the same number are ordered by role, then by the digest of
their text; NULL roles and texts are empty; rows with NULL conv_id are no conversation; repeated rows are turns of their
own; texts of any length count whole (only digests and lengths are shuffled); conv_id is read as a long, and one that is
none is an error; an empty table gives no node, not even a root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import materialize, own_tables

BLOCK = 4
STRETCH = 1024
ENDS = 256
_NO_ID = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, keys: list[str], order: list[Column], stretch: Column, values: dict[str, Column], total) -> DataFrame:
    """``df`` with each value's running total (by the aggregate ``total``, 0 at first) over the rows before it, by ``keys``.

    Two levels: inside a stretch (a number that does not fall along ``order``), then over the totals of the stretches."""
    df = df.withColumn("_s", stretch)
    inside = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = df.groupBy(*keys, "_s").agg(*[total(v).alias(f"_t_{n}") for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    here = here.select(*keys, "_s", *[total(f"_t_{n}").over(before).alias(f"_b_{n}") for n in values]).filter(" OR ".join(f"_b_{n} IS NOT NULL" for n in values))
    out = df.withColumns({n: F.coalesce(total(v).over(inside), F.lit(0)) for n, v in values.items()}).join(here, [*keys, "_s"], "left")
    pair = lambda n: F.when(F.col(f"_b_{n}").isNull(), F.col(n)).otherwise(_both(total, F.col(n), F.col(f"_b_{n}")))
    return out.withColumns({n: pair(n) for n in values}).drop("_s", *[f"_b_{n}" for n in values])


def _both(total, a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b) if total is F.bit_xor else a + b


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos`` (from 1)``, turn_key`` (digest of role and text)``, chars`` (code points of the text)."""
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    t = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("text_key"), F.length(text).cast("long").alias("chars")
    ).filter("conv_id IS NOT NULL")
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)))
    t = running(t, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_key")], stretch, {"before": F.lit(1)}, F.sum)
    return t.select("conv_id", (F.col("before") + 1).alias("pos"), F.unhex(F.md5(F.concat(F.md5(F.col("role").cast("binary")), F.col("text_key")).cast("binary"))).alias("turn_key"), "chars")


def branched(turns: DataFrame, ids: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """Turns of conversations rebuilt as branches: each takes the first h turns of conversation ``conv_id - conv_id % span``
    (all if it has fewer, none if it is absent), h = crc32 of its decimal id modulo ``most``, then its own turns after the first h."""
    lead = turns.filter((F.col("conv_id") % span == 0) & (F.col("pos") < most))
    lead = lead.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_key", "chars"))).alias("lead"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = F.col("conv_id") % span == 0
    plan = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % span).withColumn("h", F.when(own, 0).otherwise(h)).join(lead, "base", "left")
    plan = plan.withColumn("lead", F.slice(F.coalesce("lead", F.array().cast("array<struct<pos:bigint,turn_key:binary,chars:bigint>>")), F.lit(1), F.col("h").cast("int")))
    rest = turns.join(plan.select("conv_id", "h", F.size("lead").alias("led")), "conv_id").filter("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("led")).alias("pos"), "turn_key", "chars")
    return rest.unionByName(plan.select("conv_id", F.inline("lead")))


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """``conv_id, block``, the keys before it (``s1, s2``) and at its end (``e1, e2``), and its turns with the keys up to each."""
    x = [F.xxhash64(F.lit(seed), F.col("pos"), F.col("turn_key")).alias(f"x{seed}") for seed in (1, 2)]
    t = turns.select("conv_id", F.floor((F.col("pos") - 1) / block).alias("block"), F.struct("pos", *x, "chars").alias("t"))
    t = t.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("t"))  # at most `block` turns
    xor = lambda turns, c: F.aggregate(turns, F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(e[c]))
    t = t.withColumns({"d1": xor(F.col("t"), "x1"), "d2": xor(F.col("t"), "x2")})
    t = running(t, ["conv_id"], [F.col("block")], F.floor(F.col("block") * block / STRETCH), {"s1": F.col("d1"), "s2": F.col("d2")}, F.bit_xor)
    upto = lambda i, c: F.col(f"s{c[1]}").bitwiseXOR(xor(F.slice("t", F.lit(1), i), c))
    node = lambda e, i: F.struct(e["pos"].alias("depth"), upto(i + 1, "x1").alias("k1"), upto(i + 1, "x2").alias("k2"), upto(i, "x1").alias("p1"), upto(i, "x2").alias("p2"), e["chars"].alias("chars"))
    return t.select("conv_id", "block", "s1", "s2", F.col("s1").bitwiseXOR(F.col("d1")).alias("e1"), F.col("s2").bitwiseXOR(F.col("d2")).alias("e2"), F.transform("t", node).alias("turns"))


def _nodes(blocks: DataFrame, over: dict[str, tuple]) -> DataFrame:
    """The nodes below the root, with aggregates over their members: ``over`` has by name an aggregate and the column of ``blocks``."""
    edges = blocks.groupBy("block", "s1", "s2", "e1", "e2").agg(F.first("turns").alias("turns"), *[f(c).alias(n) for n, (f, c) in over.items()])
    edges = materialize(edges)
    fan = edges.groupBy("s1", "s2").agg(F.count("*").alias("fan"))
    edges = edges.join(fan, ["s1", "s2"]).select("fan", *over, F.inline("turns"))
    alone = edges.filter("fan = 1").drop("fan")
    apart = edges.filter("fan > 1").groupBy("k1", "k2", "p1", "p2", "depth").agg(F.first("chars").alias("chars"), *[f(n).alias(n) for n, (f, _) in over.items()])
    return alone.unionByName(apart)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of ``conv_id, k1, k2``: the ids of a node ascending, joined by commas."""
    parts = ends.groupBy("k1", "k2", F.floor(F.col("conv_id") / ENDS).alias("part")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    parts = parts.select("k1", "k2", "part", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def follow(batches):
        held, digest = None, None
        for b in batches:
            done = []
            for k1, k2, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held == (k1, k2):
                    digest.update(b",")
                else:
                    if held is not None:
                        done.append((*held, digest.hexdigest()))
                    held, digest = (k1, k2), hashlib.sha256()
                digest.update(ids.encode())
            yield _rows(done)
        yield _rows([(*held, digest.hexdigest())] if held is not None else [])

    # A digest reads its ids one after the other: one task takes a node's, as they stream by, and holds a hasher.
    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part").select("k1", "k2", "ids").mapInArrow(follow, "k1 long, k2 long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"k1": pa.int64(), "k2": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _trie(turns: DataFrame, ids: DataFrame, block: int) -> DataFrame:
    ids = materialize(ids)
    blocks = materialize(_blocks(turns, block))
    root = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2")] + [F.lit(None).cast("long").alias(c) for c in ("p1", "p2")]
    top = ids.agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).filter("n > 0")
    top = top.select(*root, F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n", "rep")
    nodes = materialize(_nodes(blocks.withColumn("one", F.lit(1).cast("long")), {"n": (F.sum, "one"), "rep": (F.min, "conv_id")}).unionByName(top))

    kids = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    own = (F.col("n") - 1) * F.col("chars")
    nodes = nodes.join(kids, ["k1", "k2"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "own": own})
    nodes = materialize(running(nodes, ["rep"], [F.col("depth")], F.floor(F.col("depth") / STRETCH), {"above": F.col("own")}, F.sum))

    carried = nodes.groupBy(F.col("rep").alias("conv_id")).agg(F.sum("own").alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf")).filter("own > 0 OR leaf > 0")
    carried = materialize(carried)
    below = _nodes(blocks.join(carried, "conv_id"), {"all_own": (F.sum, "own"), "n_leaves": (F.sum, "leaf")}).select("k1", "k2", "all_own", "n_leaves")
    below = below.unionByName(carried.agg(F.sum("own").alias("all_own"), F.sum("leaf").alias("n_leaves")).select(*root[:2], "all_own", "n_leaves"))

    last = blocks.groupBy("conv_id").agg(F.max(F.struct("block", "e1", "e2")).alias("e"))
    ends = ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"e.e{i}"), F.lit(0)).alias(f"k{i}") for i in (1, 2)])
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent_conv_id"))
    out = nodes.join(below, ["k1", "k2"], "left").join(_end_hashes(ends), ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
    return out.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("all_own", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ID)).alias("ends_sha256"),
    )


@own_tables
def prefix_trie(conversations: DataFrame, block: int = BLOCK, rebuild=None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct sequence of first turns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (NULL at the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (code points that members beyond the first need not repeat, over the subtree) and ``ends_sha256``.
    ``rebuild(turns, ids)`` may rearrange the ordered turns first, as ``branched`` does."""
    ids = conversations.select(F.col(conv_col).cast("long").alias("conv_id")).filter("conv_id IS NOT NULL").distinct()
    turns = ordered_turns(conversations, conv_col, turn_col, role_col, text_col)
    if rebuild is not None:
        ids, turns = materialize(ids), materialize(turns)
        turns = rebuild(turns, ids)
    return _trie(turns, ids, block)
