"""Acquisition, lookups and caches around the record model: what is asked for, what is known already, what it cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..identity import uid_set_digest

# Fixed values of the estimates.
PAPERS_PER_RECORD, CANDIDATES_PER_PAPER, SAFETY, PAGE, HARVEST_PAGE = 4, 13, 1.5, 50, 1000


def estimated_calls(target: int, extraction: str = "abstract") -> int:
    """Calls that an interactive acquisition of `target` records is expected to make."""
    papers = target * PAPERS_PER_RECORD
    calls = max(1, ceil(papers / PAGE)) + (papers if extraction in ("latex", "qa") else 0) + (papers * CANDIDATES_PER_PAPER if extraction == "qa" else 0)
    return ceil(calls * SAFETY)


def bulk_calls(manifest: DataFrame | None, target: int, extraction: str = "latex", since: str | None = None) -> int:
    """The same for a bulk acquisition: pages of the harvest by the manifest's items, then a call for each paper."""
    papers = target * PAPERS_PER_RECORD
    items = papers
    if manifest is not None:
        items = manifest.where(F.lit(True) if since is None else F.col("yymm") >= since).agg(F.coalesce(F.sum("num_items"), F.lit(0))).first()[0]
    calls = max(1, ceil(items / HARVEST_PAGE)) + papers + (papers * CANDIDATES_PER_PAPER if extraction == "qa" else 0)
    return ceil(calls * SAFETY)


def unseen(candidates: DataFrame, *prior: DataFrame) -> DataFrame:
    """Candidates of papers that no earlier run holds."""
    seen = prior[0].select("arxiv_id")
    for p in prior[1:]:
        seen = seen.unionByName(p.select("arxiv_id"))
    return candidates.join(seen, "arxiv_id", "left_anti")


def surplus_only(surplus: DataFrame, handoff: DataFrame) -> DataFrame:
    """Surplus rows whose statement was not handed off."""
    return surplus.join(handoff.select("statement"), "statement", "left_anti")


def predisposition(records: DataFrame, arxiv: Column, discard_generated: bool = True) -> DataFrame:
    """records with arxiv_id and discard_reason: generated ones, then ones without a paper, never reach a lookup."""
    rows = records.withColumn("arxiv_id", arxiv)
    reason = F.when(F.lit(discard_generated) & (F.lower(F.coalesce("provenance", F.lit(""))) == "computed"), "generated").when(F.col("arxiv_id").isNull(), "no_arxiv_id")
    return rows.withColumn("discard_reason", reason)


def unique_papers(queued: DataFrame, order: str) -> DataFrame:
    """One row for each paper: the title and uid of its first record."""
    return queued.groupBy("arxiv_id").agg(F.min_by(F.struct("title", "uid"), order).alias("_f")).select("arxiv_id", "_f.title", "_f.uid")


def lookups(papers: DataFrame, cache: DataFrame, provider: DataFrame) -> DataFrame:
    """papers with status, confidence and cache_hit: the cache's verdict, else the provider table's; a paper in neither is an error."""
    c = cache.select("arxiv_id", F.struct("status", "confidence").alias("_c"))
    p = provider.select("arxiv_id", F.struct("status", "confidence").alias("_p"))
    rows = papers.join(c, "arxiv_id", "left").join(p, "arxiv_id", "left")
    found = F.coalesce("_c", "_p")
    return rows.select(*papers.columns, F.coalesce(found["status"], F.lit("error")).alias("status"), found["confidence"].alias("confidence"), F.col("_c").isNotNull().alias("cache_hit"))


def cloned(records: DataFrame, paper_verdicts: DataFrame) -> DataFrame:
    """Each record with its paper's verdict: a record without one keeps its discard reason and is discarded."""
    v = paper_verdicts.select("arxiv_id", "status", "confidence")
    return records.join(v, "arxiv_id", "left").withColumn("status", F.when(F.col("discard_reason").isNotNull(), "discarded").otherwise(F.coalesce("status", F.lit("error"))))


def published(records: DataFrame) -> DataFrame:
    return records.where("status = 'published'")


def lookup_misses(verdicts: DataFrame) -> DataFrame:
    """Verdicts of lookups that did not end published; those discarded before any lookup don't count."""
    return verdicts.where(~F.col("status").isin("published", "discarded"))


def lookup_usage(samples: DataFrame) -> DataFrame:
    """Token sums over the samples of papers that were not cache hits; samples without usage don't count."""
    used = samples.where(~F.col("cache_hit") & F.coalesce("input_tokens", "output_tokens").isNotNull())
    return used.agg(F.count(F.lit(1)).alias("sample_count"), F.countDistinct("arxiv_id").alias("papers_with_usage"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def cached_outputs(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """requests with output and from_cache."""
    held = cache.select(key, F.col("output").alias("_o")).dropDuplicates([key])
    return requests.join(held, key, "left").withColumn("output", F.col("_o")).withColumn("from_cache", F.col("_o").isNotNull()).drop("_o")


def first_path(document: Column, paths: Sequence[str]) -> Column:
    """The first dotted path of a JSON document that is there and not null, as text."""
    return F.coalesce(*[F.get_json_object(document, "$." + p) for p in paths])


def dataset_format(rows: DataFrame) -> str:
    """prompt_completion or messages: every row must have the one form."""
    has = lambda c: F.count(c) if c in rows.columns else F.lit(0)
    n, prompts, answers, chats = rows.agg(F.count(F.lit(1)), has("prompt"), has("completion"), has("messages")).first()
    if n and prompts == answers == n and not chats:
        return "prompt_completion"
    if n and chats == n and not prompts and not answers:
        return "messages"
    raise ValueError(f"mixed or unknown format: {prompts} prompts, {answers} completions, {chats} chats in {n} rows")


def near_solved(rows: DataFrame, roster: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(records, problems): roster uids whose one scored row is solved with k - 1 correct; problems say why the others are not."""
    per = roster.select("uid").distinct().join(rows, "uid", "left")
    count = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("_n"))
    per = per.join(count, "uid", "left")
    why = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when(~F.col("n_correct").eqNullSafe(k - 1), "tally").when(~F.col("label").eqNullSafe("solved"), "label").when(F.coalesce("statement", F.lit("")) == "", "blank statement")
    marked = per.withColumn("problem", why)
    return marked.where("problem is null").drop("problem", "_n"), marked.where("problem is not null").select("uid", "problem").distinct()


def review_flags(degenerate: Column, consistency: Column) -> Column:
    return F.array_compact(F.array(F.when(consistency == "mismatch", "answer_mismatch"), F.when(degenerate, "degenerate_candidate")))


def flag_counts(results: DataFrame) -> DataFrame:
    return results.select(F.explode("review_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("records"))


def judge_score(status: Column, pass_votes: Column, n: Column) -> Column:
    """Votes for a record as a share where the judge decided, 0 where context lacks, a half where it deferred."""
    return F.when(status.isin("pass", "flag"), pass_votes / F.greatest(n, F.lit(1))).when(status == "insufficient_context", 0.0).otherwise(0.5)


def handoff_matches(handoff: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: whether the two uid sets have one digest, with both digests."""
    a, b = (df.agg(uid_set_digest(F.col("uid")).alias("sha")).first().sha for df in (handoff.select("uid").distinct(), expected.select("uid").distinct()))
    return handoff.sparkSession.createDataFrame([(a == b, a, b)], "same boolean, handoff string, expected string")


def config_mismatches(persisted: Mapping, current: Mapping, fields: Sequence[str]) -> list[str]:
    return [f"{k}: persisted={persisted.get(k)!r} vs current={current.get(k)!r}" for k in fields if persisted.get(k) != current.get(k)]


def write_run(candidates: DataFrame, path: str) -> DataFrame:
    """The intake layout: papers, candidates, quarantine, handoff and surplus from one pass's columns -> row counts by part.

    candidates has arxiv_id, quarantine_reason, duplicate and outcome.
    """
    parts = {
        "papers": candidates.where("arxiv_id is not null").select("arxiv_id").distinct(),
        "candidates": candidates,
        "quarantine": candidates.where("quarantine_reason is not null"),
        "handoff": candidates.where("quarantine_reason is null and not duplicate and outcome = 'candidate'"),
        "surplus": candidates.where("quarantine_reason is null and not duplicate and outcome = 'surplus'"),
    }
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = candidates.sparkSession
    return spark.createDataFrame([(n, spark.read.parquet(f"{path}/{n}").count()) for n in parts], "part string, rows long")
