"""Training rows: reconciliation, caps and weights, blends, checks of written data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import WEIGHT_POLICIES
from ..identity import draw_rank
from .dedupe import first_wins


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sft_rows(records: DataFrame, rollouts: DataFrame, system: str, suffix: str = "") -> DataFrame:
    """Correct rollouts as chat rows: the record's statement asked, the rollout's output word for word, and provenance."""
    good = rollouts.where("verdict = 'correct'").select("uid", "rollout_uid", "sample_idx", "output")
    rows = records.select("uid", "statement", "arxiv_id").join(good, "uid")
    return rows.select(
        "uid", "rollout_uid", F.array(message("system", F.lit(system)), message("user", F.concat("statement", F.lit(suffix)))).alias("prompt"), F.array(message("assistant", F.col("output"))).alias("completion"),
        F.struct("uid", "rollout_uid", "sample_idx", "arxiv_id", F.lit("correct").alias("verdict"), F.lit(True).alias("verbatim_output")).alias("provenance"),
    )


def hinted_rows(outputs: DataFrame, system: str, suffix: str = "") -> DataFrame:
    """outputs(uid, question, output, proof_raw_sha, sample_idx, k_tried, source_tier, arxiv_id) as chat rows: the question without its hint, the output word for word."""
    receipt = F.struct(F.col("k_tried"), F.lit(True).alias("verified")).alias("verify_receipt")
    return outputs.select(
        F.array(message("system", F.lit(system)), message("user", F.concat("question", F.lit(suffix)))).alias("prompt"), F.array(message("assistant", F.col("output"))).alias("completion"),
        F.struct("uid", "proof_raw_sha", F.col("sample_idx").alias("regen_sample_idx"), receipt, "source_tier", "arxiv_id").alias("provenance"),
    )


def folded(rows: DataFrame, batch: str, via: str, source_file: str, k: int = 8) -> DataFrame:
    """Scored rows of a batch in the corpus's shape: how they were admitted, from where, and their results as one field."""
    results = F.struct(F.lit(k).alias("k"), "label", "modal_wrong", "n_correct", "n_degenerate", "n_wrong", "pass_at_k", F.lit(source_file).alias("source_file"), F.lit("final").alias("status"), "top_wrong_share")
    return rows.select("uid", "statement", F.lit(via).alias("wellposed_via"), F.lit(batch).alias("source_batch"), results.alias("pass_at_k_results"))


def census(rows: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """(place, stage, rows): how many rows pass each stage and all before it."""
    passed, counts = F.lit(True), []
    for name, ok in stages:
        passed = passed & F.coalesce(ok, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    one = rows.agg(*counts)
    return one.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("rows")) for n, _ in stages])).alias("place", "s")).select("place", "s.stage", "s.rows")


def hinted_prompt(statement: Column, marker: str, solution: Column, suffix: str = "") -> Column:
    return F.concat(statement, F.lit(marker), solution, F.lit(suffix))


def flat_provenance(df: DataFrame) -> DataFrame:
    """uid, rollout_uid from a nested provenance where there is one, else from the row."""
    nested = "provenance" in df.columns
    for c in ("uid", "rollout_uid"):
        inner, outer = F.col(f"provenance.{c}") if nested else F.lit(None), F.col(c) if c in df.columns else F.lit(None)
        df = df.withColumn(c, F.coalesce(inner, outer))
    return df


def one_per_rollout(rows: DataFrame, order: str) -> DataFrame:
    return first_wins(rows, ["uid", "rollout_uid"], [order])


def reconcile(records: DataFrame, rollouts: DataFrame) -> DataFrame:
    """(uid, file, how): the rollout file that accounts for a record's counts.

    records(uid, rollout_uids, routed, n_correct, n_wrong, n_degenerate); rollouts(file, uid, rollout_uid, verdict), one row for
    each key. A file accounts for a record if it has every rollout and the same tallies. The routed file wins; else exactly one
    other must; otherwise file is null and how says none or ambiguous.
    """
    wanted = records.select("uid", F.explode("rollout_uids").alias("rollout_uid"))
    has = {v: F.count_if(F.col("verdict") == v) for v in ("correct", "wrong", "degenerate")}
    per = wanted.join(rollouts, ["uid", "rollout_uid"]).groupBy("uid", "file").agg(F.count(F.lit(1)).alias("found"), *[c.alias(f"_{v}") for v, c in has.items()])
    same = (F.col("found") == F.size("rollout_uids")) & (F.col("_correct") == F.col("n_correct")) & (F.col("_wrong") == F.col("n_wrong")) & (F.col("_degenerate") == F.col("n_degenerate"))
    fits = records.join(per, "uid").where(same).groupBy("uid").agg(F.max(F.when(F.col("file") == F.col("routed"), F.col("file"))).alias("_routed"), F.count(F.lit(1)).alias("_n"), F.min("file").alias("_only"))
    out = records.select("uid").join(fits, "uid", "left")
    how = F.when(F.col("_routed").isNotNull(), "routed").when(F.col("_n") == 1, "unique_alternative").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return out.select("uid", F.when(how.isin("routed", "unique_alternative"), F.coalesce("_routed", "_only")).alias("file"), how.alias("how"))


def weighted(rows: DataFrame, policy: str, cap: int = 1, seed: int = 0) -> DataFrame:
    """cap1 and capk keep a seeded draw of rollouts for each uid; inverse keeps all with weight 1 / rows of the uid."""
    if policy not in WEIGHT_POLICIES:
        raise ValueError(f"unknown weight policy {policy!r}")
    if policy == "inverse":
        counts = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("_n"))
        return rows.join(counts, "uid").withColumn("weight", F.lit(1.0) / F.col("_n")).drop("_n")
    if policy == "capk" and cap < 1:
        raise ValueError("capk needs a positive cap")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(draw_rank(seed, F.col("uid"), F.col("rollout_uid"))))
    return rows.withColumn("_r", rank).where(F.col("_r") <= (1 if policy == "cap1" else cap)).drop("_r")


def weight_violations(rows: DataFrame, policy: str, cap: int = 1) -> DataFrame:
    """(uid, rows): uids over their cap, or with a weight that is not one over their rows."""
    counts = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("rows"), *([F.min("weight").alias("_lo"), F.max("weight").alias("_hi")] if "weight" in rows.columns else []))
    if policy == "inverse":
        return counts.where("_lo <> 1.0D / rows or _hi <> 1.0D / rows or _lo is null").select("uid", "rows")
    bad = F.col("rows") > (1 if policy == "cap1" else cap)
    return counts.where(bad | F.col("_hi").isNotNull() if "weight" in rows.columns else bad).select("uid", "rows")


def rows_per_uid(rows: DataFrame) -> DataFrame:
    """How many uids have how many rows."""
    return rows.groupBy("uid").agg(F.count(F.lit(1)).alias("rows")).groupBy("rows").agg(F.count(F.lit(1)).alias("uids"))


def draw(rows: DataFrame, exclude: DataFrame, n: int, seed: str) -> DataFrame:
    """n rows by seeded rank of uid, none of an excluded uid; fewer than n raise."""
    pool = rows.join(exclude.select("uid"), "uid", "left_anti")
    drawn = pool.orderBy(draw_rank(seed, F.col("uid")), "uid").limit(n)
    if (have := drawn.count()) < n:
        raise ValueError(f"{n} rows are needed, {have} remain")
    return drawn


def hinted_tier(rows: DataFrame, band: DataFrame, pool: DataFrame) -> DataFrame:
    """(uid, tier, why): band corpus first, then the pool's label; a uid in neither has no tier."""
    b, p = band.select("uid").distinct().withColumn("_b", F.lit(True)), pool.select("uid", F.col("label").alias("_l")).withColumn("_p", F.lit(True))
    joined = rows.select("uid").join(b, "uid", "left").join(p, "uid", "left")
    why = F.when(F.col("_b"), "band").when(F.col("_p").isNull(), "not_in_pool").when(F.col("_l").isNull(), "missing_label").otherwise(F.col("_l"))
    return joined.select("uid", F.when(F.col("_b"), "band").otherwise(F.col("_l")).alias("tier"), why.alias("why"))


def not_verified(rows: DataFrame) -> DataFrame:
    """Chat rows that are not a correct, verbatim, named rollout."""
    p = F.col("provenance")
    ok = (p["verdict"] == "correct") & p["verbatim_output"] & (F.coalesce(p["rollout_uid"], F.lit("")) != "")
    return rows.where(~F.coalesce(ok, F.lit(False)))


def not_verbatim(rows: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Chat rows whose completion is not the rollout's output, byte for byte."""
    own = rollouts.select("uid", "rollout_uid", F.col("output").alias("_o"))
    joined = rows.join(own, ["uid", "rollout_uid"], "left")
    return joined.where(F.col("_o").isNull() | (F.col("completion")[0]["content"] != F.col("_o"))).drop("_o")


def malformed(rows: DataFrame) -> DataFrame:
    """Chat rows without exactly a system and a user message asked and one non-empty assistant message answered."""
    roles = lambda c: F.transform(F.col(c), lambda m: m["role"])
    ok = (roles("prompt") == F.array(F.lit("system"), F.lit("user"))) & (roles("completion") == F.array(F.lit("assistant")))
    full = F.forall(F.concat("prompt", "completion"), lambda m: F.trim(m["content"]) != "")
    return rows.where(~F.coalesce(ok & full, F.lit(False)))


def hint_in_prompt(rows: DataFrame, marker: str) -> DataFrame:
    return rows.where(F.exists("prompt", lambda m: F.contains(m["content"], F.lit(marker))))


def weights_format(rows: DataFrame) -> DataFrame:
    """(rows, weighted, bad): weights must be on all rows or none, and positive."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count("weight").alias("weighted"), F.count_if(F.col("weight") <= 0).alias("bad"))


def regen_prompts(solutions: DataFrame, marker: str, k: int) -> DataFrame:
    """k numbered hinted prompts for each solution."""
    numbered = solutions.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return numbered.withColumn("prompt", hinted_prompt(F.col("statement"), marker, F.col("solution")))
