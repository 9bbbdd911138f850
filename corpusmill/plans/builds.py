"""Guarded builds of training rows: guards run in order on whole tables, the first that finds offenders stops the build."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..identity import uid_set_digest
from ..operators import splits, training
from ..operators.splits import enforce
from .control import need


@dataclass
class Evaluation:
    """What must never be trained on: papers, uids and statements of the evaluation set."""

    papers: DataFrame
    uids: DataFrame
    statements: DataFrame


def harvest_problems(records: DataFrame, routed: DataFrame, rollouts: DataFrame) -> DataFrame:
    """(uid, problem) for each record whose rollouts can't be harvested, the first problem of each.

    records(uid, rollout_uids, n_correct, n_wrong, n_degenerate), routed(uid, file), rollouts(file, uid, rollout_uid, verdict,
    output): every listed rollout stands in the record's file under its uid, the tallies are the record's, one is correct and
    no correct one has an empty output.
    """
    wanted = records.select("uid", F.explode("rollout_uids").alias("rollout_uid")).join(routed.where("file is not null"), "uid")
    held = rollouts.select("file", F.col("uid").alias("_u"), "rollout_uid", "verdict", "output")
    met = wanted.join(held, ["file", "rollout_uid"], "left")
    own, verdict = F.col("_u") == F.col("uid"), F.col("verdict")
    counts = {f"_{v}": F.count_if(own & (verdict == v)) for v in ("correct", "wrong", "degenerate")}
    per = met.groupBy("uid").agg(F.countDistinct(F.when(own, F.col("rollout_uid"))).alias("_found"), F.count_if(own & (verdict == "correct") & (F.coalesce("output", F.lit("")) == "")).alias("_empty"), *[c.alias(n) for n, c in counts.items()])
    rows = records.join(routed.where("file is not null"), "uid", "left").join(per, "uid", "left")
    same = F.lit(True)
    for v in ("correct", "wrong", "degenerate"):
        same = same & F.coalesce(F.col(f"_{v}"), F.lit(0)).eqNullSafe(F.col(f"n_{v}"))
    why = (
        F.when(F.col("file").isNull(), "no file accounts for it").when(F.coalesce("_found", F.lit(0)) != F.size(F.array_distinct("rollout_uids")), "a rollout is missing or another record's")
        .when(~same, "tallies differ").when(F.col("n_correct") < 1, "no correct rollout").when(F.col("_empty") > 0, "an empty output")
    )
    return rows.select("uid", why.alias("problem")).where("problem is not null")


def written_problems(rows: DataFrame, evaluation: Evaluation, policy: str, cap: int = 1, marker: str | None = None) -> DataFrame:
    """(guard, rows): how many written chat rows offend against each guard, zero where none does. Rows have uid, rollout_uid, prompt, completion, provenance."""
    asked = rows.withColumn("_prompt", F.expr("array_join(transform(prompt, m -> m.content), '\\n')")).withColumn("arxiv_id", F.col("provenance.arxiv_id"))
    guards: dict[str, Callable[[], DataFrame]] = {
        "malformed": lambda: training.malformed(rows),
        "not verified": lambda: training.not_verified(rows),
        "evaluation paper": lambda: splits.paper_leaks(asked, evaluation.papers),
        "evaluation uid": lambda: splits.uid_leaks(rows, evaluation.uids),
        "evaluation statement": lambda: splits.prompt_leaks(asked, evaluation.statements, "_prompt"),
        "repeated rollout": lambda: rows.groupBy("uid", "rollout_uid").count().where("count > 1"),
        "weights": lambda: training.weight_violations(rows, policy, cap),
    }
    if marker:
        guards["hint in prompt"] = lambda: training.hint_in_prompt(rows, marker)
    out = None
    for name, offenders in guards.items():
        one = offenders().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("guard"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def check_written(rows: DataFrame, evaluation: Evaluation, policy: str, cap: int = 1, marker: str | None = None) -> None:
    """What an upload runs on the rows as they were read back: any offender is an error, and so is an empty table."""
    need(not rows.isEmpty(), "no rows")
    enforce(written_problems(rows, evaluation, policy, cap, marker).where("rows > 0"), "written rows offend")


def build(corpus: DataFrame, files: DataFrame, train_uids: DataFrame, backfill: DataFrame, evaluation: Evaluation, system: str, policy: str = "cap1", cap: int = 1, seed: int = 0, suffix: str = "") -> DataFrame:
    """The whole guarded build: selection, reconciliation, harvest, chat rows, leak guards, caps.

    corpus(uid, statement, arxiv_id, rollout_uids, routed, n_correct, n_wrong, n_degenerate); files(file, uid, rollout_uid,
    sample_idx, verdict, output). Each guard sees whole tables and raises with the first offenders.
    """
    enforce(splits.not_disjoint(train_uids, evaluation.uids), "training and evaluation share uids")
    enforce(splits.selection_desyncs(corpus, train_uids, backfill), "selection and corpus differ")
    chosen = splits.select_train(corpus, train_uids, backfill)
    routed = training.reconcile(chosen.select("uid", "rollout_uids", "routed", "n_correct", "n_wrong", "n_degenerate"), files).select("uid", "file")
    enforce(harvest_problems(chosen, routed, files), "rollouts can't be harvested")
    own = files.join(routed.where("file is not null"), ["uid", "file"])
    listed = chosen.select("uid", F.explode("rollout_uids").alias("rollout_uid")).distinct()
    rows = training.one_per_rollout(training.sft_rows(chosen, own.join(listed, ["uid", "rollout_uid"], "left_semi"), system, suffix), "provenance.sample_idx")
    enforce(splits.shared_statements(chosen), "a statement stands under several uids")
    enforce(splits.without_statement_or_answer(chosen.withColumn("answer", F.lit("given"))), "a statement is blank")
    enforce(splits.statement_leaks(chosen, evaluation.statements), "an evaluation statement is trained on")
    rows = training.weighted(rows, policy, cap, seed)
    enforce(written_problems(rows, evaluation, policy, cap).where("rows > 0"), "rows offend")
    return rows


def manifest(rows: DataFrame, policy: str, seed: int) -> DataFrame:
    """One row that tells a build: rows, uids, their digest, papers, policy and seed."""
    uids = rows.select("uid").distinct().agg(uid_set_digest(F.col("uid")).alias("uid_digest"))
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("uid").alias("uids"), F.countDistinct("provenance.arxiv_id").alias("papers"))
    return counts.crossJoin(uids).withColumns({"policy": F.lit(policy), "seed": F.lit(seed)})  # two tables of one row


def hinted_build(verified: DataFrame, band: DataFrame, pool: DataFrame, anchors: DataFrame, n_anchors: int, evaluation: Evaluation, system: str, seed: str, marker: str, suffix: str = "") -> DataFrame:
    """Hinted rows blended with anchors: verified(uid, question, output, proof_raw_sha, sample_idx, k_tried, arxiv_id), one for each uid.

    Each verified row gets its tier and must have one; anchors(uid, prompt, completion, arxiv_id) are drawn by seed among uids that
    are not hinted, and none may be an evaluation's. uid, lane, prompt, completion.
    """
    tiers = training.hinted_tier(verified, band, pool)
    enforce(tiers.where("tier is null"), "a hinted row has no tier")
    hinted = training.hinted_rows(verified.join(tiers.select("uid", F.col("tier").alias("source_tier")), "uid"), system, suffix)
    hinted = hinted.select(F.col("provenance.uid").alias("uid"), F.lit("hinted").alias("lane"), "prompt", "completion")
    drawn = training.draw(anchors, verified, n_anchors, seed)
    enforce(splits.anchors_in_eval(drawn, evaluation.uids, evaluation.papers), "an anchor belongs to the evaluation")
    rows = hinted.unionByName(drawn.select("uid", F.lit("anchor").alias("lane"), "prompt", "completion"))
    enforce(splits.uid_leaks(rows, evaluation.uids), "an evaluation uid is trained on")
    enforce(training.hint_in_prompt(rows, marker), "a prompt carries the hint")
    enforce(rows.groupBy("uid").count().where("count > 1"), "a uid has several rows")
    asked = rows.withColumn("_prompt", F.expr("array_join(transform(prompt, m -> m.content), '\\n')"))
    enforce(splits.prompt_leaks(asked, evaluation.statements, "_prompt"), "an evaluation statement is asked")
    return rows


def bundle_problems(rows: DataFrame, fields: tuple[str, ...] = ("uid", "statement", "solution", "prompt"), marker: str | None = None) -> DataFrame:
    """(uid, problem) for rows of a bundle with a blank field, a repeated uid and number, or a prompt without the hint's marker."""
    blank = F.lit(False)
    for f in fields:
        blank = blank | (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "")
    bare = ~F.contains("prompt", F.lit(marker)) if marker else F.lit(False)
    per = rows.withColumn("_bad", F.when(blank, "a blank field").when(bare, "no hint"))
    single = per.where("_bad is not null").select("uid", F.col("_bad").alias("problem"))
    twice = rows.groupBy("uid", "sample_idx").count().where("count > 1").select("uid", F.lit("repeated").alias("problem"))
    return single.unionByName(twice).distinct()


def rollouts_path(source_file: Column) -> Column:
    """Where the rollouts of a results file stand: in the progress folder beside it."""
    return F.concat(F.regexp_replace(source_file, r"[^/]*$", ""), F.lit("_progress/rollouts.jsonl"))


def run_stage(done: bool, cost: float, limit: float, run: Callable[[], None], verified: Callable[[], bool]) -> str:
    """skipped if the stage's outputs are there, stopped if its cost would pass the limit, else done once what it wrote is verified."""
    if done:
        return "skipped"
    if cost > limit:
        return "stopped"
    run()
    need(verified(), "the stage's outputs do not verify")
    return "done"
