"""Group-disjoint splits, evaluation slices, leakage and integrity guards.

A guard returns the rows that offend, all of them; enforce() raises if there are any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from .dedupe import first_wins
from .rollouts import perfect_solve, total_collapse


class GuardError(ValueError):
    pass


def enforce(offenders: DataFrame, message: str, shown: int = 5) -> None:
    rows = offenders.limit(shown).collect()
    if rows:
        raise GuardError(f"{message}: {offenders.count()} rows, first {[tuple(r) for r in rows]}")


def eval_slices(records: DataFrame, eval_papers: DataFrame, order: Sequence[str]) -> DataFrame:
    """records with eval_slice (eval_band, anchor_solved, anchor_fail, or null) and is_train; the first row of a uid counts.

    A record of an evaluation paper is never trained on, whatever its label.
    """
    rows = first_wins(records, ["uid"], order)
    held = eval_papers.select("arxiv_id").distinct().withColumn("_eval", F.lit(True))
    rows = rows.join(held, "arxiv_id", "left")
    on = F.coalesce("_eval", F.lit(False))
    tag = F.when(on & (F.col("label") == "band"), "eval_band").when(on & (F.col("label") == "solved") & perfect_solve(), "anchor_solved").when(on & (F.col("label") == "collapse") & total_collapse(), "anchor_fail")
    return rows.withColumn("eval_slice", tag).withColumn("is_train", ~on & F.coalesce(F.col("label") == "band", F.lit(False))).drop("_eval")


def slice_order(eval_slice: Column) -> Column:
    return F.when(eval_slice == "eval_band", 0).when(eval_slice == "anchor_solved", 1).when(eval_slice == "anchor_fail", 2)


def slice_rows(eval_set: DataFrame, name: str) -> DataFrame:
    """The rows of one evaluation slice."""
    return eval_set.where(F.col("eval_slice") == name)


def slice_uids(eval_set: DataFrame, name: str) -> DataFrame:
    """The uids of one evaluation slice, in order."""
    return slice_rows(eval_set, name).select("uid").orderBy("uid")


def paper_leaks(rows: DataFrame, eval_papers: DataFrame) -> DataFrame:
    return rows.join(eval_papers.select("arxiv_id"), "arxiv_id", "left_semi")


def uid_leaks(rows: DataFrame, eval_uids: DataFrame) -> DataFrame:
    return rows.join(eval_uids.select("uid"), "uid", "left_semi")


def statement_leaks(rows: DataFrame, eval_statements: DataFrame, key: str = "statement") -> DataFrame:
    """Rows whose whole statement is an evaluation statement."""
    return rows.join(eval_statements.select(F.col("statement").alias(key)), key, "left_semi")


#: Words of a statement by which it is looked up.
SEED_WORDS = 3


def prompt_leaks(rows: DataFrame, eval_statements: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Rows whose prompt holds an evaluation statement anywhere, be it from the middle of a word on.

    A containment join without a nested loop: the words of a statement but its first and last stand whole in any prompt that
    holds it, so up to SEED_WORDS of them are looked up among a prompt's runs of words, one row for each word; candidates are
    then compared. A statement of one or two words is looked up by its characters, among stretches of its length.
    """
    wanted = eval_statements.select("statement").where("statement <> ''").distinct()
    wanted = wanted.withColumn("_w", F.expr(r"split(statement, '\\s+')")).withColumn("_n", F.least(F.size("_w") - 2, F.lit(SEED_WORDS)))
    seeds = wanted.where("_n > 0").select("statement", "_n", F.xxhash64(F.expr("array_join(slice(_w, 2, _n), ' ')")).alias("_k"))
    short = wanted.where("_n <= 0").select("statement", (-F.length("statement")).alias("_n"), F.xxhash64("statement").alias("_k"))
    kinds = sorted(r[0] for r in seeds.select("_n").unionByName(short.select("_n")).distinct().collect())  # a few lengths
    if not kinds:
        return rows.limit(0)
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())  # what is looked up carries the row's number, not its prompt

    def stretches(n: int):
        if n < 0:
            starts = F.sequence(F.lit(1), F.greatest(F.length(prompt) + n + 1, F.lit(1)))
            return F.transform(starts, lambda i: F.xxhash64(F.substr(F.col(prompt), i, F.lit(-n))))
        runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
        return once(F.split(prompt, r"\s+"), runs)

    def keyed(n: int):
        return F.transform(F.array_distinct(stretches(n)), lambda k: F.struct(F.lit(n).alias("_n"), k.alias("_k")))

    pieces = numbered.where(F.col(prompt).isNotNull()).select("_row", F.inline(F.concat(*[keyed(n) for n in kinds])))
    near = pieces.join(seeds.unionByName(short), ["_n", "_k"]).select("_row", "statement").distinct()
    return numbered.join(near, "_row").where(F.contains(F.col(prompt), F.col("statement"))).select("_row", *rows.columns).dropDuplicates(["_row"]).drop("_row")


def shared_statements(rows: DataFrame) -> DataFrame:
    """Statements that stand under more than one uid."""
    return rows.where("statement is not null").groupBy("statement").agg(F.countDistinct("uid").alias("uids")).where("uids > 1")


def not_on_train_side(rows: DataFrame, train_uids: DataFrame) -> DataFrame:
    return rows.join(train_uids.select("uid"), "uid", "left_anti")


def anchors_in_eval(rows: DataFrame, eval_uids: DataFrame, eval_papers: DataFrame) -> DataFrame:
    """Anchors that are an evaluation uid, stand in an evaluation paper, or name no paper."""
    u, p = eval_uids.select("uid").distinct().withColumn("_u", F.lit(True)), eval_papers.select("arxiv_id").distinct().withColumn("_p", F.lit(True))
    return rows.join(u, "uid", "left").join(p, "arxiv_id", "left").where("_u or _p or arxiv_id is null").select(*rows.columns)


def not_disjoint(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    return train.select("uid").intersect(evaluation.select("uid"))


def roster_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Uids that one roster has and the other lacks, repeats counted."""
    x, y = a.select("uid"), b.select("uid")
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def selection_desyncs(corpus: DataFrame, train_uids: DataFrame, backfill: DataFrame) -> DataFrame:
    """(uid, problem): repeated uids in list or corpus, backfill in the corpus, uids that neither has, blank statements."""
    name = lambda df, what: df.select("uid", F.lit(what).alias("problem"))
    wanted = train_uids.select("uid").distinct()
    twice = train_uids.groupBy("uid").count().where("count > 1")
    copies = corpus.where("uid is not null").groupBy("uid").count().where("count > 1")
    inside = backfill.select("uid").distinct().join(corpus.select("uid"), "uid", "left_semi")
    absent = wanted.join(corpus.select("uid"), "uid", "left_anti").join(backfill.select("uid"), "uid", "left_anti")
    blank = corpus.join(wanted, "uid", "left_semi").where("coalesce(statement, '') = ''")
    out = name(twice, "repeated in the list")
    for df, what in ((copies, "repeated in the corpus"), (inside, "backfill in the corpus"), (absent, "missing"), (blank, "blank statement")):
        out = out.unionByName(name(df, what))
    return out


def select_train(corpus: DataFrame, train_uids: DataFrame, backfill: DataFrame) -> DataFrame:
    wanted = train_uids.select("uid").join(backfill.select("uid"), "uid", "left_anti")
    return corpus.join(wanted, "uid", "left_semi")


def without_statement_or_answer(rows: DataFrame) -> DataFrame:
    return rows.where("coalesce(trim(statement), '') = '' or coalesce(trim(answer), '') = ''")


def subset_differences(rows: DataFrame, reference: DataFrame, content: str) -> DataFrame:
    """(uid, problem): rows that one side lacks, or whose content differs."""
    a, b = rows.select("uid", F.col(content).alias("_a")), reference.select("uid", F.col(content).alias("_b"))
    why = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "uid", "full").select("uid", why.alias("problem")).where("problem is not null")
