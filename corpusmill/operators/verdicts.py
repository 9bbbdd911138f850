"""Votes, gate policies, cascades and agreement over long verdict tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import GATE_SCORES, POLICIES, PUBLICATION_STATUSES


def map_status(status: Column, mapping: dict[str, str], quorum_broken: Column | None = None) -> Column:
    """A tool's status in the gate's words: unknown ones defer; a deferral for want of votes is an error."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    named = F.coalesce(F.try_element_at(table, status), F.lit("defer"))
    return named if quorum_broken is None else F.when((named == "defer") & quorum_broken, "error").otherwise(named)


def with_missing(inputs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row for each input uid; without a verdict it is an error."""
    return inputs.select("uid").join(verdicts, "uid", "left").withColumn("status", F.coalesce("status", F.lit("error")))


def latest(verdicts: DataFrame) -> DataFrame:
    """The last attempt's verdict of each uid and combo."""
    return verdicts.groupBy("uid", "combo").agg(F.max_by("status", "attempt").alias("status"))


def combine(verdicts: DataFrame, combos: Sequence[str], policy: str) -> DataFrame:
    """(uid, status, pass_count, present, score) under intersect, union, majority, or prefer:<combo>.

    intersect needs every combo's pass, majority more than half of the verdicts present. A denial is ill_posed if any combo
    says so, else error, else defer.
    """
    if policy.startswith("prefer:"):
        own = verdicts.where(F.col("combo") == policy.removeprefix("prefer:"))
        score = reduce(lambda e, kv: e.when(F.col("status") == kv[0], kv[1]), GATE_SCORES.items(), F.when(F.lit(False), 0.0))
        return own.select("uid", "status", F.when(F.col("status") == "well_posed", 1).otherwise(0).cast("long").alias("pass_count"), F.lit(1).cast("long").alias("present"), score.alias("score"))
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    has = lambda s: F.count_if(F.col("status") == s)
    rows = verdicts.where(F.col("combo").isin(*combos)).groupBy("uid").agg(F.count("status").alias("present"), has("well_posed").alias("pass_count"), has("ill_posed").alias("_ill"), has("error").alias("_err"), has("defer").alias("_defer"))
    admit = {
        "intersect": (F.col("present") == len(combos)) & (F.col("pass_count") == len(combos)),
        "union": F.col("pass_count") >= 1,
        "majority": F.col("pass_count") * 2 > F.col("present"),
    }[policy]
    denial = F.when(F.col("_ill") > 0, "ill_posed").when(F.col("_err") > 0, "error").when(F.col("_defer") > 0, "defer").otherwise("error")
    return rows.select("uid", F.when(admit, "well_posed").otherwise(denial).alias("status"), "pass_count", "present", F.when(admit, 1.0).otherwise(0.0).alias("score"))


def compare(verdicts: DataFrame, combos: Sequence[str]) -> DataFrame:
    """(uid, agreement, a column for each combo); a uid that some combo lacks is has_missing, whatever the others say."""
    wide = verdicts.groupBy("uid").pivot("combo", list(combos)).agg(F.first("status"))
    all_are = lambda s: reduce(lambda a, b: a & b, [F.col(f"`{c}`") == s for c in combos])
    missing = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in combos])
    bucket = F.when(missing, "has_missing").when(all_are("well_posed"), "unanimous_pass").when(all_are("ill_posed"), "unanimous_fail").when(all_are("defer"), "unanimous_defer").otherwise("split")
    return wide.withColumn("agreement", bucket)


def disagreements(compared: DataFrame, limit: int = 20) -> DataFrame:
    """The first rows, by uid, that are split or miss a verdict: a report's list."""
    return compared.where(F.col("agreement").isin("split", "has_missing")).orderBy("uid").limit(limit)


def kappa(compared: DataFrame, combos: Sequence[str]) -> DataFrame:
    """(a, b, n, kappa) for each pair of combos; null without shared uids or where agreement is certain."""
    pairs = []
    for a, b in combinations(combos, 2):
        both = compared.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).groupBy(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).agg(F.count(F.lit(1)).alias("c"))
        total = both.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
        rows = both.groupBy("x").agg(F.sum("c").alias("r")).join(both.groupBy(F.col("y").alias("x")).agg(F.sum("c").alias("q")), "x").agg(F.coalesce(F.sum(F.col("r") * F.col("q")), F.lit(0)).alias("e"))
        one = total.crossJoin(rows)  # two tables of one row
        expected, observed = F.col("e") / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
        pairs.append(one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce("n", F.lit(0)).alias("n"), F.when((F.col("n") > 0) & (expected < 1), (observed - expected) / (1 - expected)).alias("kappa")))
    return reduce(DataFrame.unionByName, pairs)


def usage_rollup(usage: DataFrame, input_rate: float, output_rate: float) -> DataFrame:
    """Token sums for each combo and, with a null combo, for all; cost in USD at rates per million tokens, six places."""
    rows = usage.rollup("combo").agg(F.count_if(F.coalesce("input_tokens", "output_tokens").isNotNull()).alias("records_with_usage"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    return rows.withColumn("cost_usd", F.bround(F.col("input_tokens") / 1e6 * input_rate + F.col("output_tokens") / 1e6 * output_rate, 6))


def publication_majority(votes: DataFrame, uphold: int) -> DataFrame:
    """(uid, status): error first if it reaches `uphold`, then published, unpublished, defer; else defer."""
    has = {s: F.count_if(F.coalesce("status", F.lit("error")) == s) for s in PUBLICATION_STATUSES[:4]}
    rows = votes.groupBy("uid").agg(*[c.alias(f"_{s}") for s, c in has.items()])
    chosen = F.when(F.col("_error") >= uphold, "error")
    for s in ("published", "unpublished", "defer"):
        chosen = chosen.when(F.col(f"_{s}") >= uphold, s)
    return rows.select("uid", chosen.otherwise("defer").alias("status"))


def representative(votes: DataFrame, majority: DataFrame) -> DataFrame:
    """(uid, sample_id): of the samples with the majority's status the most confident, the first on ties; else the first that is no error; else the first."""
    joined = votes.join(majority.select("uid", F.col("status").alias("_m")), "uid")
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    match, sound = F.col("status") == F.col("_m"), F.col("status") != "error"
    key = F.struct(F.when(match, 2).when(sound, 1).otherwise(0).alias("tier"), F.when(match, rank).otherwise(0).alias("rank"), (-F.col("sample_id")).alias("first"))
    return joined.groupBy("uid").agg(F.max_by("sample_id", key).alias("sample_id"))


def corroborate(samples: DataFrame, uphold: int) -> DataFrame:
    """(uid, n, votes, majority, defer_reason, score). Votes of samples that lack context count for nothing else.

    Too many errors for a quorum turn any majority into a deferral.
    """
    lacks = F.coalesce("insufficient_context", F.lit(False))
    rows = samples.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("verdict") == "pass") & ~lacks).alias("pass_votes"), F.count_if((F.col("verdict") == "flag") & ~lacks).alias("flag_votes"),
        F.count_if(lacks).alias("ic_votes"), F.count_if(F.col("verdict") == "error").alias("error_votes"),
    )
    broken = F.col("error_votes") > F.col("n") - uphold
    majority = F.when(broken, "defer").when(F.col("ic_votes") >= uphold, "insufficient_context").when(F.col("flag_votes") >= uphold, "flag").when(F.col("pass_votes") >= uphold, "pass").otherwise("defer")
    rows = rows.withColumn("majority", majority)
    reason = F.when(F.col("majority") == "defer", F.when(broken, "judge_errors").otherwise("split"))
    score = F.when(F.col("majority").isin("pass", "flag"), F.col("pass_votes") / F.col("n")).when(F.col("majority") == "insufficient_context", 0.0).otherwise(0.5)
    return rows.withColumn("defer_reason", reason).withColumn("score", score)


def residue(replies: DataFrame, uphold: int) -> DataFrame:
    """(uid, status): replies(uid, determined) with null where one could not be parsed; fewer denials than `uphold` pass."""
    rows = replies.groupBy("uid").agg(F.count("determined").alias("parsed"), F.count_if(~F.col("determined")).alias("denials"))
    return rows.withColumn("status", F.when(F.col("parsed") == 0, "error").when(F.col("denials") >= uphold, "flag").otherwise("pass"))


def record_status(structural: Column, computed: Column, majority: Column, statement: Column) -> Column:
    """Structural hits flag a record even if it is computed; then computed ones pass, then the judge decides."""
    return F.when(F.coalesce(F.trim(statement), F.lit("")) == "", "error").when(F.size(structural) > 0, "flag").when(computed, "pass").otherwise(F.coalesce(majority, F.lit("defer")))


def tiered_status(self_contained: Column, hits: Column, majority: Column, judge: str) -> Column:
    """Trusted records pass before any scan; then by judge policy: always, on_scanner_hit, or off."""
    if judge == "always":
        return F.when(self_contained, "pass").otherwise(F.coalesce(majority, F.lit("defer")))
    if judge == "on_scanner_hit":
        return F.when(self_contained | (hits == 0), "pass").otherwise(F.coalesce(majority, F.lit("defer")))
    return F.when(self_contained | (hits == 0), "pass").otherwise("flag")


def self_contained(provenance: Column, policy: Column) -> Column:
    return (provenance == "computed") | ((provenance == "manual") & F.coalesce(policy == "trusted", F.lit(False)))


def cascade(records: DataFrame, verdicts: DataFrame, stages: Sequence[tuple[str, bool]]) -> tuple[DataFrame, DataFrame]:
    """(survivors, review): stages of (combo, advisory) in order, each on the last attempts of what the one before kept.

    A hard stage keeps well_posed; an advisory one keeps all but errors and sends what did not pass to review. No verdict is
    an error.
    """
    newest, review = latest(verdicts), []
    for combo, advisory in stages:
        own = newest.where(F.col("combo") == combo).select("uid", F.col("status").alias("_s"))
        seen = records.join(own, "uid", "left").withColumn("_s", F.coalesce("_s", F.lit("error")))
        if advisory:
            review.append(seen.where(~F.col("_s").isin("well_posed", "error")).select("uid", F.lit(combo).alias("combo"), F.col("_s").alias("status")))
            records = seen.where("_s <> 'error'").drop("_s")
        else:
            records = seen.where("_s = 'well_posed'").drop("_s")
    empty = newest.select("uid", "combo", "status").limit(0)
    return records, reduce(DataFrame.unionByName, review, empty)


def passed(records: DataFrame, combined: DataFrame) -> DataFrame:
    """Records, as they were, that the gate let through."""
    return records.join(combined.where("status = 'well_posed'").select("uid"), "uid", "left_semi")


def status_counts(verdicts: DataFrame, domain: Sequence[str]) -> DataFrame:
    return verdicts.groupBy("status").agg(F.count(F.lit(1)).alias("records")).where(F.col("status").isin(*domain))


def gate_crossing(base: Column, tuned: Column) -> Column:
    """+1 where only the tuned model passes, -1 where only the base does, 0 otherwise."""
    return F.when(~base & tuned, 1).when(base & ~tuned, -1).otherwise(0)
