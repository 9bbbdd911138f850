"""Rollout tallies, difficulty labels and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BAND_HI, BAND_LO, DEGENERATE_SHARE, UNSOLVABLE
from ..functions.text import truth_garbage
from .normalise import label_of


def tally(rollouts: DataFrame, uid: str = "uid", order: str = "sample_idx") -> DataFrame:
    """(uid, n, n_correct, n_wrong, n_degenerate, modal_wrong, top_wrong_share, pass_at_k, label).

    The modal wrong candidate is the most frequent, the one seen first on a tie; its share is of all rollouts. Two partial
    aggregates: by (uid, verdict, candidate), then by uid.
    """
    per = rollouts.groupBy(uid, "verdict", "candidate").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("first"))
    wrong = (F.col("verdict") == "wrong") & F.col("candidate").isNotNull()
    best = F.max(F.when(wrong, F.struct(F.col("c"), (-F.col("first")).alias("f"), F.col("candidate"))))
    n = {v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("c"))), F.lit(0)).alias(f"n_{v}") for v in ("correct", "wrong", "degenerate")}
    rows = per.groupBy(uid).agg(F.sum("c").alias("n"), *n.values(), best.alias("b"))
    share = F.coalesce(F.col("b.c") / F.col("n"), F.lit(0.0))
    rate = F.col("n_correct") / F.col("n")
    return rows.select(uid, "n", "n_correct", "n_wrong", "n_degenerate", F.col("b.candidate").alias("modal_wrong"), share.alias("top_wrong_share"), rate.alias("pass_at_k"), label_of(rate, share).alias("label"))


def in_band(p: Column, lo: float = BAND_LO, hi: float = BAND_HI) -> Column:
    return F.coalesce(p.between(lo, hi), F.lit(False))


def solvable(df: DataFrame) -> DataFrame:
    """Rows whose label is none of the unsolvable ones; a null label stays."""
    return df.where(F.col("label").isNull() | ~F.col("label").isin(*UNSOLVABLE))


def n_total(df_includes_degenerate: bool) -> Column:
    """The two readings of a record's trial count."""
    base = F.coalesce(F.col("n_correct"), F.lit(0)) + F.coalesce(F.col("n_wrong"), F.lit(0))
    return base + F.coalesce(F.col("n_degenerate"), F.lit(0)) if df_includes_degenerate else base


def perfect_solve() -> Column:
    return F.coalesce((n_total(True) > 0) & (F.col("n_correct") == n_total(True)), F.lit(False))


def total_collapse() -> Column:
    return F.coalesce((n_total(True) > 0) & (F.col("n_correct") == 0), F.lit(False))


def prefilter(records: DataFrame, scored: DataFrame, tier: Column) -> DataFrame:
    """records with `kind`: what happens before any rollout, in order: prescored, resumed, garbage truth, unverifiable truth, live."""
    done = scored.select(F.col("uid"), F.lit(True).alias("_done"))
    truth = F.coalesce(F.try_element_at("truth_strings", F.lit(1)), F.lit(""))
    kind = (
        F.when(F.col("pass_at_k").isNotNull(), "prescored").when(F.col("_done"), "resumed").when(truth_garbage(truth), "garbage_truth")
        .when(~tier.isin("number", "tuple", "expr"), "unverifiable_truth").otherwise("live")
    )
    return records.join(done, "uid", "left").withColumn("kind", kind).drop("_done")


def degenerate_dominated(n_degenerate: Column, n: Column) -> Column:
    return n_degenerate / F.nullif(n, F.lit(0)) >= DEGENERATE_SHARE


def stamp(records: DataFrame, scores: DataFrame) -> DataFrame:
    """records with the scores' columns; a score replaces the record's own value."""
    fresh = [c for c in scores.columns if c != "uid"]
    return records.drop(*fresh).join(scores, "uid", "left")


def replay(records: DataFrame, sheet: DataFrame) -> DataFrame:
    """Scores from a sheet (one row for each uid); records that it lacks are dropped with a reason and zero tallies."""
    marked = sheet.withColumn("_hit", F.lit(True))
    joined = records.select("uid").join(marked, "uid", "left")
    miss = F.col("_hit").isNull()
    counts = [F.when(miss, 0).otherwise(F.col(c)).alias(c) for c in ("n_correct", "n_wrong", "n_degenerate")]
    return joined.select("uid", F.when(miss, "drop").otherwise(F.col("label")).alias("label"), F.when(miss, "not_in_calibration_sheet").alias("drop_reason"), *counts)


def label_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("records"))


def verdict_totals(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.sum(c).alias(c) for c in ("n_correct", "n_wrong", "n_degenerate")])


def first_verified(samples: DataFrame, verified: Column, budget: int) -> DataFrame:
    """(uid, sample_idx, output, k_tried): the first sample within the budget that verifies."""
    rows = samples.where((F.col("sample_idx") >= 0) & (F.col("sample_idx") < budget)).where(verified)
    return rows.groupBy("uid").agg(F.min("sample_idx").alias("sample_idx"), F.min_by("output", "sample_idx").alias("output")).withColumn("k_tried", F.col("sample_idx") + 1)
