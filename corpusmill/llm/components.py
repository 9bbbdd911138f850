"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release


#: A node's edges meet its least neighbour in so many groups, so that a hub's edges are no task's own.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    # never a broadcast: Spark sizes that side by its rows before they are repeated
    repeated = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated.hint("merge"), ["u", "_s"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least).select("v", "m").where("v <> m").toDF("u", "v")
    return moved.unionByName(least.toDF("u", "v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of one sortable type -> (node, root): every node of an edge with its component's least node.

    Nothing but a count and a checksum of each round goes to the driver. Self edges and repeated edges are
    harmless; nulls are dropped; an empty table gives an empty result. A hub's edges are
    dealt to SALTS groups; its least neighbour is a partial aggregate.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "star")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        before, now = now, materialize(_small_star(_large_star(now)), "star")
        discard(before)
        last, mark = mark, _mark(now)
        release(now.sparkSession)
        if mark == last:
            break
    else:
        raise RuntimeError("components: not stable; raise max_rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
