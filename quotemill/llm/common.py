"""Helpers shared by the corpus operators: word splitting, shared-folder tables, size-checked
broadcasts and distributed connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this package: space and \t \n \v \f \r.
SEPARATORS = r"[\x20\x09-\x0D]+"

#: Largest table, in bytes of its values, that may be broadcast; beyond it a shuffle join runs.
BROADCAST_BYTES = 32 << 20

_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def words(text: Column) -> Column:
    """Words of a text, unchanged; an empty array for NULL or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session on one machine without it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at a table every
    executor can reach, so a lost executor costs only its running tasks."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """The table written of ``df``, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if _TABLES.get() is not None:
        _TABLES.get().append(path)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # shuffle files of earlier tables stay until the driver collects its garbage
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table; one that is gone already is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):  # left-over files cost disk only
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def own_tables(job):
    """``job(docs, ...)`` with its DataFrame written as a table of the caller's; the tables that the job wrote on its way
    are deleted then."""

    @wraps(job)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        token = _TABLES.set([])
        try:
            out = job(docs, *args, **kwargs)
            mine = _TABLES.get()
            _TABLES.reset(token)
            token = None
            return materialize(out)
        finally:
            if token is not None:
                mine = _TABLES.get()
                _TABLES.reset(token)
            for path in mine:
                drop_table(docs.sparkSession, path)

    return run


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its values are of at most ``most`` bytes, else as it is (a shuffle join
    follows, which adaptive execution splits on hot keys). Sums ``df`` up, so give it a written table."""
    size = F.lit(16)
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType.typeName()
        length = F.octet_length(c) if kind in ("string", "binary") else 8 * F.size(c) if kind in ("array", "map") else None
        size = size + (F.lit(8) if length is None else 16 + F.coalesce(length, F.lit(0)))
    total = df.agg(F.sum(size.cast("long"))).first()[0]
    return F.broadcast(df) if (total or 0) <= most else df


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Components of an undirected graph ``edges(a, b)`` as ``(id, component)``; component is the
    smallest id reachable. Alternating large-star and small-star rounds (Kiveris et al. 2014): every
    round is two min-aggregations and joins, so a hub is combined map-side and never sits in one task.
    Nodes without an edge to another node do not appear. NULL ends and loops are ignored. The edges of each round are a
    table in the shared folder; the one of the round before is deleted then."""
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e, path = _written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        around = large.join(low, "u")
        out = around.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        e, path = _written(out.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop_table(edges.sparkSession, old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))


def region_links(regions: DataFrame, keys: list[str], about, fits, confirm, stars: DataFrame) -> DataFrame:
    """Confirmed links ``(a, b)`` between members of a region (rows ``keys, id``), enough of them to join all that
    links join. ``about`` has by ``id`` what ``fits`` compares, or adds it to rows of members; ``stars`` are the candidates of members with their roots.

    Stars are confirmed first. Regions whose members they all join are done; in the others, members that are not in the
    largest component there are compared with all members of other components. A group of
    near copies, however large, thus costs one candidate a member and is never expanded into pairs."""
    links = confirm(stars)
    groups = small(materialize(connected_components(links)))
    rows = _mixed(regions.join(groups, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"), keys).drop("many")
    rows = materialize(about(rows) if callable(about) else rows.join(about, "id"))
    x, y = rows.filter("c <> root_c").alias("x"), rows.alias("y")
    here = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    once = (F.col("y.c") == F.col("y.root_c")) | (F.col("x.id") < F.col("y.id"))
    rest = x.join(y, _all(here) & (F.col("x.c") != F.col("y.c")) & once & fits("x", "y"))
    return links.unionByName(confirm(rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))))


def _mixed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` of the regions with members in several components ``c``; with the largest of these, and the region's members."""
    parts = rows.groupBy(*keys, "c").agg(F.count("*").alias("here"))
    parts = parts.groupBy(*keys).agg(F.max(F.struct("here", "c"))["c"].alias("root_c"), F.sum("here").alias("many"), F.count("*").alias("parts"))
    return rows.join(parts.filter("parts > 1").drop("parts"), keys)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
