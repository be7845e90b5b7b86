"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answer_eval.llm.common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) joined to (u, m).  The second key says nothing new, but the minima are not
    partitioned by it, so both sides are shuffled for the join and the engine can
    split the rows of a hot u."""
    key = F.xxhash64("u").alias("k")
    return edges.select("u", "v", key).join(least.select("u", "m", key), ["u", "k"])


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _least(both).withColumn("m", F.least("u", "m"))
    return _with_least(both.where("v > u"), m).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """u and every neighbour below it are linked to the least of those."""
    m = _least(edges)
    moved = _with_least(edges, m).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long, u <> v): root is the least
    id reachable; a root itself is not listed.

    Each round keeps at most one row per edge; it ends when every edge points at a
    root, so the number of rounds grows with the logarithm of a component's size.
    Minima are pre-aggregated before the shuffle; the join back has one row per
    node on one side, so a hot node's rows can be split."""
    cur = scratch.keep(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(),
        "edges-0")
    sign = None
    for k in range(1, max_rounds + 1):
        nxt = scratch.keep(_small(_large(cur)), f"edges-{k}")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges-{k - 1}")
        cur = nxt
        if now == sign:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
