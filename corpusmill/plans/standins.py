"""The driver tables read as the record model's tables. They are stand-ins: the shapes are the model's, the contents are not.

Each frame has the same definition in SQL, as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMBOS = ("click", "purchase", "view")

CTE = {
    "ro": "ro AS (SELECT CAST(user_id AS VARCHAR) AS uid, 'r' || event_id AS rollout_uid, event_id AS sample_idx, event_type AS candidate, CASE WHEN value < 15 THEN 'correct' WHEN value < 70 THEN 'wrong' ELSE 'degenerate' END AS verdict FROM events)",
    "ve": "ve AS (SELECT CAST(user_id AS VARCHAR) AS uid, event_type AS combo, event_id AS attempt, CASE WHEN value < 60 THEN 'well_posed' WHEN value < 100 THEN 'ill_posed' WHEN value < 150 THEN 'defer' ELSE 'error' END AS status FROM events)",
    "la": "la AS (SELECT uid, combo, status FROM ve QUALIFY row_number() OVER (PARTITION BY uid, combo ORDER BY attempt DESC) = 1)",
    "ta": """pc AS (SELECT uid, candidate, count(*) AS c, min(sample_idx) AS f FROM ro WHERE verdict = 'wrong' GROUP BY uid, candidate),
mw AS (SELECT uid, candidate AS modal_wrong, c FROM pc QUALIFY row_number() OVER (PARTITION BY uid ORDER BY c DESC, f) = 1),
tc AS (SELECT uid, count(*) AS n, count(*) FILTER (verdict = 'correct') AS n_correct, count(*) FILTER (verdict = 'wrong') AS n_wrong, count(*) FILTER (verdict = 'degenerate') AS n_degenerate FROM ro GROUP BY uid),
ta0 AS (SELECT tc.uid, n, n_correct, n_wrong, n_degenerate, modal_wrong, coalesce(c / n, 0.0) AS top_wrong_share, n_correct / n AS pass_at_k FROM tc LEFT JOIN mw ON tc.uid = mw.uid),
ta AS (SELECT *, CASE WHEN pass_at_k > 0.75 THEN 'solved' WHEN pass_at_k >= 0.125 THEN 'band' WHEN top_wrong_share >= 0.5 THEN 'misdirection' ELSE 'collapse' END AS label FROM ta0)""",
    "sa": "sa AS (SELECT CAST(user_id AS VARCHAR) AS uid, event_id AS sample_id, CASE WHEN value < 40 THEN 'pass' WHEN value < 90 THEN 'flag' ELSE 'error' END AS verdict, event_type = 'signup' AS insufficient_context FROM events)",
    "vo": "vo AS (SELECT CAST(user_id AS VARCHAR) AS uid, event_id AS sample_id, CASE WHEN value < 40 THEN 'published' WHEN value < 80 THEN 'unpublished' WHEN value < 120 THEN 'defer' ELSE 'error' END AS status, CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'medium' WHEN 'error' THEN 'low' END AS confidence FROM events)",
    "rec": "rec AS (SELECT doc_id, coalesce(source, '') AS source, text AS statement, trim(regexp_replace(lower(coalesce(text, '')), '{WS}', ' ', 'g'), ' ') AS dk FROM documents)",
}
#: What the invented prose of the documents lacks: phrases that the scanners look for. A document's statement is its text and one of them.
PHRASES = (
    "Solutions of, the equation hold.",
    "A solution of such that x holds; assumptions hold on the system - with y.",
    "Here x is bounded by, \\begin{equation} y \\end{equation}",
    "See \\ref{a}, \\eqref{b} and \\cite{c} for the \\label{d} mark.",
    "As shown above, see Theorem 2.1 and (3.2).",
    "By Lemma 3 and [?] of the previous section (7).",
    "The main result in this paper uses the notation of the figure.",
    "Let q denote a system. Using the notation, what is q?",
    "Then \\mathrm{x} \\ldots \\operatorname{y} stand.",
    "What is f(x)? Put f(x):=x+12345678.",
    "Plain words only.",
    "The proposition shown below is defined above, as before (a) and (2.1).",
)
CTE["fx"] = f"fx AS (SELECT doc_id, lang, source, coalesce(text, '') || ' ' || [{', '.join(repr(x).replace(chr(92) * 2, chr(92)) for x in PHRASES)}][CAST(doc_id % {len(PHRASES)} AS INTEGER) + 1] AS text FROM documents)"
#: Both engines' white space for collapsing, as SQL text.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n].replace("{WS}", WS) for n in names) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    verdict = F.when(v < 15, "correct").when(v < 70, "wrong").otherwise("degenerate")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("uid"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("rollout_uid"), F.col("event_id").alias("sample_idx"), F.col("event_type").alias("candidate"), verdict.alias("verdict"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    status = F.when(v < 60, "well_posed").when(v < 100, "ill_posed").when(v < 150, "defer").otherwise("error")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("uid"), F.col("event_type").alias("combo"), F.col("event_id").alias("attempt"), status.alias("status"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    verdict = F.when(v < 40, "pass").when(v < 90, "flag").otherwise("error")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("uid"), F.col("event_id").alias("sample_id"), verdict.alias("verdict"), (F.col("event_type") == "signup").alias("insufficient_context"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = F.col("value"), F.col("event_type")
    status = F.when(v < 40, "published").when(v < 80, "unpublished").when(v < 120, "defer").otherwise("error")
    confidence = F.when(e == "click", "high").when(e == "view", "medium").when(e == "error", "low")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("uid"), F.col("event_id").alias("sample_id"), status.alias("status"), confidence.alias("confidence"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("text").alias("statement"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a phrase of PHRASES after each text."""
    phrase = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (F.col("doc_id") % len(PHRASES)).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), phrase).alias("text"))
