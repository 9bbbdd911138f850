"""First-wins and last-wins over an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep_null: bool = True) -> DataFrame:
    """The first row of each key in order, by a partial aggregate: a hot key's rows meet as one row from each task."""
    rows = df if keep_null else df.where(" and ".join(f"{k} is not null" for k in keys))
    chosen = F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order))
    return rows.groupBy(*keys).agg(chosen.alias("_r")).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    chosen = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order))
    return df.groupBy(*keys).agg(chosen.alias("_r")).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def identical_only(df: DataFrame, key: str, content: str) -> DataFrame:
    """Keys whose rows differ in content: what must be empty before duplicates are collapsed."""
    return df.groupBy(key).agg(F.countDistinct(content).alias("contents")).where("contents > 1")


def uid_flips(df: DataFrame, uid: str, statement: str, order: Sequence[str]) -> DataFrame:
    """Per uid, how often its statement changes from one row to the next in read order."""
    before = F.lag(statement).over(Window.partitionBy(uid).orderBy(*order))
    return df.withColumn("_b", before).groupBy(uid).agg(F.count_if(F.col("_b").isNotNull() & (F.col("_b") != F.col(statement))).alias("flips")).where("flips > 0")


def running_before(df: DataFrame, value: str, order: Sequence[str], out: str) -> DataFrame:
    """df with `out`: the sum of value over the rows before it in order, by a range sort, running sums within partitions and one offset for each of those."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_t"))
    before = totals.select("_part", (F.sum("_t").over(Window.orderBy("_part")) - F.col("_t")).alias("_earlier"))  # a row for each partition
    summed = placed.withColumn(out, F.coalesce(F.sum(value).over(own), F.lit(0)))
    return summed.join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_earlier")).drop("_part", "_earlier")


def capped(df: DataFrame, group: str, group_order: str, order: str, cap: int | None, target: int) -> DataFrame:
    """df with `outcome`: candidate, surplus or dropped.

    At most `cap` rows of a group are eligible; eligible rows become candidates, in (group_order, order), until there are
    `target`; other rows of groups up to the one that reached it are surplus, and later groups are dropped. The running
    count runs over groups (one row each), not rows, and no task orders them all.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    rows = df.withColumn("_rank", rank).withColumn("_ok", (F.col("_rank") <= cap) if cap else F.lit(True))
    per = rows.groupBy(group, group_order).agg(F.count_if("_ok").alias("_n"))
    per = running_before(per, "_n", [group_order], "_before")
    joined = rows.join(per.select(group, "_before"), group)
    outcome = F.when(F.col("_ok") & (F.col("_before") + F.col("_rank") <= target), "candidate").when(F.col("_before") < target, "surplus").otherwise("dropped")
    return joined.withColumn("outcome", outcome).drop("_rank", "_ok", "_before")
