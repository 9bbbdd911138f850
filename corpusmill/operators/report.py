"""Paired evaluation statistics and reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import Z_95
from ..functions.udf import vectorised


def paired_table(uids: DataFrame, base: DataFrame, tuned: DataFrame, group: str | None = None) -> DataFrame:
    """Per group: n_pairs, a (both solved), b (base only), c (tuned only), d (neither), solved counts, missing uids."""
    solved = lambda df, name: df.select("uid", F.when(F.col("n_correct").isNotNull(), F.col("n_correct") > 0).alias(name))
    rows = uids.join(solved(base, "_b"), "uid", "left").join(solved(tuned, "_t"), "uid", "left")
    both = F.col("_b").isNotNull() & F.col("_t").isNotNull()
    cells = {"a": F.col("_b") & F.col("_t"), "b": F.col("_b") & ~F.col("_t"), "c": ~F.col("_b") & F.col("_t"), "d": ~F.col("_b") & ~F.col("_t")}
    out = rows.groupBy(*([group] if group else [])).agg(
        F.count_if(both).alias("n_pairs"), *[F.count_if(both & e).alias(k) for k, e in cells.items()], F.count_if(both & F.col("_b")).alias("base_solved"),
        F.count_if(both & F.col("_t")).alias("tuned_solved"), F.count_if(~both).alias("missing"),
    )
    return out


def missing_uids(uids: DataFrame, *scores: DataFrame) -> DataFrame:
    out = None
    for s in scores:
        lost = uids.select("uid").join(s.where("n_correct is not null").select("uid"), "uid", "left_anti")
        out = lost if out is None else out.unionByName(lost)
    return out.distinct()


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided test of discordant pairs, in integers: in doubles the binomials overflow from n = 1,030 on."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    total = term = math.comb(n, k)
    for i in range(k, 0, -1):  # downwards, each from the one before; what is left then is beyond a double's last bit
        term = term * i // (n - i + 1)
        total += term
        if term.bit_length() < total.bit_length() - 100:
            break
    return min(1.0, 2 * total / 2**n)


@vectorised("double")
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    """Python: exact binomials of unbounded size, one row for each slice."""
    return pd.Series([mcnemar(int(x), int(y)) for x, y in zip(b, c, strict=True)])


def wald_interval(b: Column, c: Column, n: Column, z: float = Z_95) -> Column:
    """Interval of the difference of paired proportions; (0, 0) without pairs."""
    diff = (c - b) / n
    se = F.sqrt(F.greatest(b + c - (c - b) * (c - b) / n, F.lit(0.0))) / n
    return F.struct(F.coalesce(F.when(n > 0, diff - z * se), F.lit(0.0)).alias("lo"), F.coalesce(F.when(n > 0, diff + z * se), F.lit(0.0)).alias("hi"))


def sign_test(wins: int, losses: int) -> float:
    return mcnemar(wins, losses)


def repeat_means(scores: DataFrame, uids: DataFrame) -> DataFrame:
    """scores(repeat, uid, n_correct) -> mean per repeat over the wanted uids."""
    return scores.join(uids.select("uid").distinct(), "uid", "left_semi").groupBy("repeat").agg(F.avg("n_correct").alias("mean_n_correct"))


def mean_of_means(means: DataFrame) -> DataFrame:
    return means.agg(F.count(F.lit(1)).alias("n_repeats"), F.avg("mean_n_correct").alias("overall_mean_n_correct"))


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 1000) -> str:
    """A small result as a markdown table; report tables have a row for each slice, combo or status."""
    columns = list(columns or df.columns)
    rows = [tuple(r) for r in df.select(*columns).limit(limit).collect()]
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def paired_report(title: str, generated_at: str, tables: DataFrame, group: str) -> str:
    """Markdown of paired tables with the exact test and the interval of each."""
    ci = wald_interval(F.col("b"), F.col("c"), F.col("n_pairs"))
    rows = tables.select("*", mcnemar_exact("b", "c").alias("p"), ci["lo"].alias("lo"), ci["hi"].alias("hi")).orderBy(group)
    return f"# {title}\n\nGenerated {generated_at}\n\n{markdown_table(rows)}\n"


def comparison_report(counts: DataFrame, kappas: DataFrame, examples: DataFrame) -> str:
    parts = (("Agreement", counts), ("Kappa", kappas), ("Disagreements", examples))
    return "\n\n".join(f"## {name}\n\n{markdown_table(df)}" for name, df in parts) + "\n"
