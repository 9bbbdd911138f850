"""Every registered query of the engine with its equivalent SQL.

A key begins with the identifier of the operator that it shows. Every query reads its whole tables and whole texts; remainders of
ids only tell rows of one kind from rows of another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import latex, text, verify
from ..identity import dedup_key, gate_uid, ingest_uid, rollout_cache_key, statement_cache_key, stmt_key
from ..operators import acquire, dedupe, normalise, report, rollouts, slices, spans, splits, training, verdicts
from . import standins as S
from .standins import COMBOS, WS, table, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- identity and ingest -------------------------------------------------------------------------------------------------


@query("id_uids", with_("rec") + "SELECT doc_id, substr(sha256(source || chr(31) || coalesce(statement, '')), 1, 32) AS uid, sha256(dk) AS stmt_key, substr(sha1(coalesce(statement, '')), 1, 16) AS cache_key FROM rec")
def _(spark, sf):
    r = S.records(spark, sf)
    return r.select("doc_id", gate_uid(F.col("source"), F.col("statement")).alias("uid"), stmt_key(F.col("statement")).alias("stmt_key"), statement_cache_key(F.col("statement")).alias("cache_key"))


@query("id_rollout_cache_key", "SELECT event_id, substr(sha1('m' || chr(31) || event_type || chr(31) || '0.7' || chr(31) || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END || chr(31) || CAST(event_id AS VARCHAR)), 1, 16) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", rollout_cache_key(F.lit("m"), F.col("event_type"), F.lit("0.7"), F.col("event_id") % 2 == 0, F.col("event_id")).alias("k"))


@query("a23_ingest_counts", with_("rec") + "SELECT source, count(*) AS records, count(DISTINCT source || chr(31) || coalesce(statement, '')) AS uids FROM rec GROUP BY source")
def _(spark, sf):
    r = S.records(spark, sf)
    return r.withColumn("uid", ingest_uid(F.col("source"), F.col("statement"))).groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("uid").alias("uids"))


@query(
    "p1_records",
    """SELECT d.doc_id, coalesce(d.text, '') AS statement_text, CASE WHEN l.quality = 1 THEN 'computed' ELSE 'extracted' END AS provenance,
CASE WHEN l.quality = 1 THEN 'trusted' ELSE 'extracted' END AS truth_policy,
CASE WHEN p IS NULL THEN 'other' WHEN p > 0.75 THEN 'solved' WHEN p >= 0.125 THEN 'band' WHEN s >= 0.5 THEN 'misdirection' ELSE 'collapse' END AS label, d.n AS n_correct
FROM (SELECT doc_id, text, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE (n_chars % 100) / 100.0 END AS p, (n_chars % 10) / 10.0 AS s, CAST(n_chars % 9 AS INTEGER) AS n FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "f").alias("family"))
    n = F.col("n_chars")
    raw = d.join(lab, "doc_id", "left").select("doc_id", F.col("text").alias("question"), "family", F.when(n % 7 != 0, (n % 100) / 100.0).alias("pass_at_k"), ((n % 10) / 10.0).alias("top_wrong_share"), (n % 9).cast("string").alias("correct"))
    out = normalise.to_records(raw, F.lit("s"), ["doc_id"])
    return out.select("doc_id", F.col("statement").alias("statement_text"), "provenance", "truth_policy", "label", "n_correct")


@query("p2_column_map", "SELECT doc_id, text AS statement, lang AS tier FROM documents")
def _(spark, sf):
    return normalise.apply_column_map(table(spark, sf, "documents"), {"statement": "text", "tier": "lang", "doc_id": "n_chars"}).select("doc_id", "statement", "tier")


@query("p5_truth_strings", "SELECT doc_id, len(list_filter([CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, source], lambda x: x IS NOT NULL AND x <> '')) AS truths FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("truth"), F.col("source").alias("answer"))
    return d.select("doc_id", F.size(normalise.truth_strings(d)).cast("long").alias("truths"))


@query("p7_coerce", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(event_id % 100 AS INTEGER) END AS n FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 4 == 0, "3.7").otherwise((F.col("event_id") % 100).cast("string"))
    return e.select("event_id", normalise.to_int(raw).alias("n"))


@query("p11_arxiv_id", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '2301.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') END AS arxiv_id FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    ident = F.concat(F.lit("2301."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"))
    field = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("arXiv:"), ident, F.lit("v3")))
    url = F.when(F.col("doc_id") % 5 > 1, F.concat(F.lit("https://arxiv.org/pdf/"), ident, F.lit("v2"))).otherwise(F.lit("https://example.org/x"))
    return d.select("doc_id", text.arxiv_id([field], [url]).alias("arxiv_id"))


@query("p12_arxiv_from_link", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '2301.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') END AS arxiv_id FROM documents")
def _(spark, sf):
    ident = F.concat(F.lit("2301."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"))
    link = F.when(F.col("doc_id") % 3 == 0, "https://example.org/abs/1").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("http://arxiv.org/abs/"), ident, F.lit("v1?x=1"))).otherwise(F.concat(F.lit("https://export.arxiv.org/pdf/"), ident, F.lit(".pdf")))
    return table(spark, sf, "documents").select("doc_id", text.arxiv_from_link(link).alias("arxiv_id"))


@query(
    "f12_quarantine",
    with_("rec") + "SELECT doc_id, CASE WHEN coalesce(statement, '') = '' THEN 'missing statement' WHEN doc_id % 11 = 0 THEN '[quality-guard] unresolved external refs in source' END AS quarantine_reason, "
    "coalesce(coalesce(statement, '') <> '' AND doc_id % 11 <> 0 AND doc_id > min(doc_id) FILTER (coalesce(statement, '') <> '' AND doc_id % 11 <> 0) OVER (PARTITION BY dk), false) AS duplicate FROM rec",
)
def _(spark, sf):
    r = S.records(spark, sf).withColumns({"has_external_refs": F.col("doc_id") % 11 == 0, "n_resolved": F.lit(0), "n_unresolved": F.lit(1)})
    return normalise.quarantine(r, "doc_id", "strict").select("doc_id", "quarantine_reason", "duplicate")


@query(
    "w3_paper_pool",
    "WITH p AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'l' || (doc_id % 400) END AS link, text AS title FROM documents), "
    "a AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '')), '" + WS + "', ' ', 'g'), ' ') AS t FROM p WHERE link IS NOT NULL QUALIFY row_number() OVER (PARTITION BY link ORDER BY doc_id) = 1) "
    "SELECT doc_id, link FROM a QUALIFY row_number() OVER (PARTITION BY CASE WHEN t = '' THEN chr(1) || link ELSE t END ORDER BY doc_id) = 1",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("l"), (F.col("doc_id") % 400).cast("string"))).alias("link"), F.col("text").alias("title"))
    return normalise.paper_pool(d, "doc_id").select("doc_id", "link")


@query("w1_rid", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS rid FROM documents")
def _(spark, sf):
    return normalise.with_rid(table(spark, sf, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "rid")


# --- dedupe and windows --------------------------------------------------------------------------------------------------


@query("w4_first_wins", "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL GROUP BY text")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return dedupe.first_wins(d, ["h"], ["doc_id"])


@query("w6_last_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, sf):
    return dedupe.last_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("w7_latest", with_("ve", "la") + "SELECT uid, combo, status FROM la")
def _(spark, sf):
    return verdicts.latest(S.verdicts(spark, sf))


@query("w8_identical_only", "SELECT source, count(DISTINCT lang) AS contents FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def _(spark, sf):
    return dedupe.identical_only(table(spark, sf, "documents"), "source", "lang")


@query("a23_uid_flips", "SELECT user_id, count(*) AS flips FROM (SELECT user_id, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events) WHERE f GROUP BY user_id")
def _(spark, sf):
    return dedupe.uid_flips(table(spark, sf, "events"), "user_id", "event_type", ["event_id"])


@query(
    "w9_capped",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
g AS (SELECT user_id, count(*) FILTER (k <= 20) AS n FROM r GROUP BY user_id),
b AS (SELECT user_id, coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT event_id, CASE WHEN k <= 20 AND before + k <= 1500 THEN 'candidate' WHEN before < 1500 THEN 'surplus' ELSE 'dropped' END AS outcome FROM r JOIN b USING (user_id)""",
)
def _(spark, sf):
    return dedupe.capped(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "user_id", "event_id", 20, 1500).select("event_id", "outcome")


# --- rollouts ------------------------------------------------------------------------------------------------------------

_TALLY = "uid, n, n_correct, n_wrong, n_degenerate, modal_wrong, round(top_wrong_share, 6) AS top_wrong_share, round(pass_at_k, 6) AS pass_at_k, label"


def _tally(spark, sf) -> DataFrame:
    return rollouts.tally(S.rollouts(spark, sf))


@query("a1_tally", with_("ro", "ta") + f"SELECT {_TALLY} FROM ta")
def _(spark, sf):
    return _tally(spark, sf).withColumns({c: F.round(c, 6) for c in ("top_wrong_share", "pass_at_k")})


@query("w13_modal_wrong", with_("ro", "ta") + "SELECT uid, modal_wrong FROM ta")
def _(spark, sf):
    return _tally(spark, sf).select("uid", "modal_wrong")


@query("a3_label_counts", with_("ro", "ta") + "SELECT label, count(*) AS records FROM ta GROUP BY label")
def _(spark, sf):
    return rollouts.label_counts(_tally(spark, sf))


@query("a22_verdict_totals", with_("ro", "ta") + "SELECT CAST(sum(n_correct) AS BIGINT) AS n_correct, CAST(sum(n_wrong) AS BIGINT) AS n_wrong, CAST(sum(n_degenerate) AS BIGINT) AS n_degenerate FROM ta")
def _(spark, sf):
    return rollouts.verdict_totals(_tally(spark, sf))


@query("f1_solvable", with_("ro", "ta") + "SELECT uid, label FROM ta WHERE label IS NULL OR label NOT IN ('drop', 'collapse', 'misdirection')")
def _(spark, sf):
    return rollouts.solvable(_tally(spark, sf)).select("uid", "label")


@query("f2_in_band", with_("ro", "ta") + "SELECT uid, coalesce(pass_at_k BETWEEN 0.125 AND 0.75, false) AS in_band FROM ta")
def _(spark, sf):
    return _tally(spark, sf).select("uid", rollouts.in_band(F.col("pass_at_k")).alias("in_band"))


@query("f3_truth_garbage", with_("fx") + "SELECT doc_id, regexp_matches(text, 'mathrm|mathbb|mathcal|mathbf|mathsf|operatorname|Bigl|Bigr|bigl|bigr|widetilde|widehat|cdots|ldots|efsub|displaystyle|text|boldsymbol|mathfrak|mathscr') AS junk FROM fx")
def _(spark, sf):
    return S.statements(spark, sf).select("doc_id", text.truth_garbage(F.col("text")).alias("junk"))


@query(
    "f14_prefilter",
    with_("ro", "ta") + "SELECT uid, CASE WHEN CAST(uid AS BIGINT) % 5 = 0 THEN 'prescored' WHEN label = 'solved' THEN 'resumed' WHEN CAST(uid AS BIGINT) % 3 = 0 THEN 'garbage_truth' WHEN CAST(uid AS BIGINT) % 2 = 0 THEN 'unverifiable_truth' ELSE 'live' END AS kind FROM ta",
)
def _(spark, sf):
    t = _tally(spark, sf)
    u = F.col("uid").cast("long")
    recs = t.select("uid", F.when(u % 5 == 0, 0.5).alias("pass_at_k"), F.array(F.when(u % 3 == 0, "\\mathrm{x}").otherwise("7")).alias("truth_strings"), F.when(u % 2 == 0, "prose").otherwise("number").alias("tier"))
    return rollouts.prefilter(recs, t.where("label = 'solved'"), F.col("tier")).select("uid", "kind")


@query("p19_stamp", with_("ro", "ta") + "SELECT c.c_custkey AS custkey, coalesce(ta.label, 'none') AS label FROM customer c LEFT JOIN ta ON CAST(c.c_custkey AS VARCHAR) = ta.uid")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_custkey").alias("custkey"), F.lit("old").alias("label"))
    return rollouts.stamp(c, _tally(spark, sf).select("uid", "label")).select("custkey", F.coalesce("label", F.lit("none")).alias("label"))


@query("j8_replay", with_("ro", "ta") + "SELECT c.c_custkey AS custkey, coalesce(label, 'drop') AS label, CASE WHEN label IS NULL THEN 'not_in_calibration_sheet' END AS drop_reason, coalesce(n_correct, 0) AS n_correct FROM customer c LEFT JOIN ta ON CAST(c.c_custkey AS VARCHAR) = ta.uid")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid"))
    return rollouts.replay(c, _tally(spark, sf)).select(F.col("uid").cast("long").alias("custkey"), "label", "drop_reason", "n_correct")


@query("w12_first_verified", with_("ro") + "SELECT uid, min(sample_idx) AS sample_idx, arg_min(candidate, sample_idx) AS output, min(sample_idx) + 1 AS k_tried FROM ro WHERE sample_idx < 6000 AND verdict = 'correct' GROUP BY uid")
def _(spark, sf):
    r = S.rollouts(spark, sf).withColumn("output", F.col("candidate"))
    return rollouts.first_verified(r, F.col("verdict") == "correct", 6000)


@query("m_degenerate_dominated", with_("ro", "ta") + "SELECT uid, n_degenerate / n >= 0.5 AS dominated FROM ta")
def _(spark, sf):
    return _tally(spark, sf).select("uid", rollouts.degenerate_dominated(F.col("n_degenerate"), F.col("n")).alias("dominated"))


# --- verdicts ------------------------------------------------------------------------------------------------------------


def _latest(spark, sf) -> DataFrame:
    return verdicts.latest(S.verdicts(spark, sf)).where(F.col("combo").isin(*COMBOS))


_COMBINED = "c AS (SELECT uid, count(*) AS present, count(*) FILTER (status = 'well_posed') AS pass_count, count(*) FILTER (status = 'ill_posed') AS i, count(*) FILTER (status = 'error') AS e, count(*) FILTER (status = 'defer') AS d FROM la WHERE combo IN ('click', 'purchase', 'view') GROUP BY uid)"
_ADMIT = {"intersect": "present = 3 AND pass_count = 3", "union": "pass_count >= 1", "majority": "pass_count * 2 > present"}

for _policy, _admit in _ADMIT.items():
    _sql = with_("ve", "la") + f", {_COMBINED} SELECT uid, CASE WHEN {_admit} THEN 'well_posed' WHEN i > 0 THEN 'ill_posed' WHEN e > 0 THEN 'error' WHEN d > 0 THEN 'defer' ELSE 'error' END AS status, pass_count, present, CAST(CASE WHEN {_admit} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score FROM c"
    query(f"a13_{_policy}", _sql)(lambda spark, sf, p=_policy: verdicts.combine(_latest(spark, sf), COMBOS, p))


@query("a14_prefer", with_("ve", "la") + "SELECT uid, status, CAST(CASE status WHEN 'well_posed' THEN 1.0 WHEN 'defer' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM la WHERE combo = 'view'")
def _(spark, sf):
    return verdicts.combine(_latest(spark, sf), COMBOS, "prefer:view").select("uid", "status", "score")


_WIDE = "w AS (SELECT uid, max(status) FILTER (combo = 'click') AS click, max(status) FILTER (combo = 'purchase') AS purchase, max(status) FILTER (combo = 'view') AS view_ FROM la WHERE combo IN ('click', 'purchase', 'view') GROUP BY uid), g AS (SELECT *, CASE WHEN click IS NULL OR purchase IS NULL OR view_ IS NULL THEN 'has_missing' WHEN click = 'well_posed' AND purchase = click AND view_ = click THEN 'unanimous_pass' WHEN click = 'ill_posed' AND purchase = click AND view_ = click THEN 'unanimous_fail' WHEN click = 'defer' AND purchase = click AND view_ = click THEN 'unanimous_defer' ELSE 'split' END AS agreement FROM w)"


@query("a15_compare", with_("ve", "la") + f", {_WIDE} SELECT uid, agreement, click, purchase, view_ FROM g")
def _(spark, sf):
    return verdicts.compare(_latest(spark, sf), COMBOS).withColumnRenamed("view", "view_")


@query("o2_disagreements", with_("ve", "la") + f", {_WIDE} SELECT uid, agreement FROM g WHERE agreement IN ('split', 'has_missing') ORDER BY uid LIMIT 20")
def _(spark, sf):
    return verdicts.disagreements(verdicts.compare(_latest(spark, sf), COMBOS)).select("uid", "agreement")


def _kappa_sql() -> str:
    parts = []
    for a, b in (("click", "purchase"), ("click", "view"), ("purchase", "view")):
        parts.append(
            f"(SELECT '{a}' AS a, '{b}' AS b, n, CASE WHEN n > 0 AND e < 1 THEN round((o - e) / (1 - e), 6) END AS kappa FROM (SELECT count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS o, "
            "(SELECT sum(r * q) FROM (SELECT x, count(*) AS r FROM z GROUP BY x) JOIN (SELECT y, count(*) AS q FROM z GROUP BY y) ON x = y) / (count(*) * count(*)) AS e FROM z))".replace(
                " z", f" (SELECT p.status AS x, s.status AS y FROM la p JOIN la s ON p.uid = s.uid WHERE p.combo = '{a}' AND s.combo = '{b}')"
            )
        )
    return with_("ve", "la") + " UNION ALL ".join(parts)


@query("a16_kappa", _kappa_sql())
def _(spark, sf):
    k = verdicts.kappa(verdicts.compare(_latest(spark, sf), COMBOS), COMBOS)
    return k.withColumn("kappa", F.round("kappa", 6))


@query("a6_usage_rollup", "SELECT event_type AS combo, count(*) AS records_with_usage, CAST(sum(event_id) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens, round(sum(event_id) / 1e6 * 3 + sum(user_id) / 1e6 * 15, 4) AS cost_usd FROM events GROUP BY ROLLUP (event_type)")
def _(spark, sf):
    u = table(spark, sf, "events").select(F.col("event_type").alias("combo"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return verdicts.usage_rollup(u, 3.0, 15.0).withColumn("cost_usd", F.round("cost_usd", 4))


@query("a10_publication", with_("vo") + "SELECT uid, CASE WHEN count(*) FILTER (status = 'error') >= 3 THEN 'error' WHEN count(*) FILTER (status = 'published') >= 3 THEN 'published' WHEN count(*) FILTER (status = 'unpublished') >= 3 THEN 'unpublished' ELSE 'defer' END AS status FROM vo GROUP BY uid")
def _(spark, sf):
    return verdicts.publication_majority(S.votes(spark, sf), 3)


@query(
    "w14_representative",
    with_("vo") + ", m AS (SELECT uid, CASE WHEN count(*) FILTER (status = 'error') >= 3 THEN 'error' WHEN count(*) FILTER (status = 'published') >= 3 THEN 'published' WHEN count(*) FILTER (status = 'unpublished') >= 3 THEN 'unpublished' ELSE 'defer' END AS m FROM vo GROUP BY uid) "
    "SELECT uid, sample_id FROM vo JOIN m USING (uid) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN status = m THEN 2 WHEN status <> 'error' THEN 1 ELSE 0 END DESC, CASE WHEN status = m THEN CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END ELSE 0 END DESC, sample_id) = 1",
)
def _(spark, sf):
    v = S.votes(spark, sf)
    return verdicts.representative(v, verdicts.publication_majority(v, 3))


@query(
    "a11_corroborate",
    with_("sa") + ", c AS (SELECT uid, count(*) AS n, count(*) FILTER (verdict = 'pass' AND NOT insufficient_context) AS pass_votes, count(*) FILTER (verdict = 'flag' AND NOT insufficient_context) AS flag_votes, count(*) FILTER (insufficient_context) AS ic_votes, count(*) FILTER (verdict = 'error') AS error_votes FROM sa GROUP BY uid), "
    "j AS (SELECT *, CASE WHEN error_votes > n - 4 THEN 'defer' WHEN ic_votes >= 4 THEN 'insufficient_context' WHEN flag_votes >= 4 THEN 'flag' WHEN pass_votes >= 4 THEN 'pass' ELSE 'defer' END AS majority FROM c) "
    "SELECT uid, majority, CASE WHEN majority = 'defer' THEN CASE WHEN error_votes > n - 4 THEN 'judge_errors' ELSE 'split' END END AS defer_reason, round(CASE WHEN majority IN ('pass', 'flag') THEN pass_votes / n WHEN majority = 'insufficient_context' THEN 0.0 ELSE 0.5 END, 6) AS score FROM j",
)
def _(spark, sf):
    return verdicts.corroborate(S.samples(spark, sf), 4).select("uid", "majority", "defer_reason", F.round("score", 6).alias("score"))


@query("a12_residue", with_("sa") + "SELECT uid, CASE WHEN count(*) FILTER (verdict <> 'error') = 0 THEN 'error' WHEN count(*) FILTER (verdict = 'flag') >= 3 THEN 'flag' ELSE 'pass' END AS status FROM sa GROUP BY uid")
def _(spark, sf):
    r = S.samples(spark, sf).select("uid", F.when(F.col("verdict") != "error", F.col("verdict") == "pass").alias("determined"))
    return verdicts.residue(r, 3).select("uid", "status")


@query("u4_cascade", with_("ve", "la") + "SELECT c_custkey AS custkey FROM customer c WHERE EXISTS (SELECT 1 FROM la WHERE uid = CAST(c_custkey AS VARCHAR) AND combo = 'click' AND status <> 'error') AND EXISTS (SELECT 1 FROM la WHERE uid = CAST(c_custkey AS VARCHAR) AND combo = 'view' AND status = 'well_posed')")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid"))
    kept, _review = verdicts.cascade(c, S.verdicts(spark, sf), [("click", True), ("view", False)])
    return kept.select(F.col("uid").cast("long").alias("custkey"))


@query("u4_cascade_review", with_("ve", "la") + "SELECT uid, combo, status FROM la WHERE combo = 'click' AND status IN ('ill_posed', 'defer') AND CAST(uid AS BIGINT) IN (SELECT c_custkey FROM customer)")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid"))
    return verdicts.cascade(c, S.verdicts(spark, sf), [("click", True), ("view", False)])[1]


@query("j1_passed", with_("ve", "la") + f", {_COMBINED} SELECT c_custkey AS custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT uid FROM c WHERE pass_count * 2 > present)")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid"))
    return verdicts.passed(c, verdicts.combine(_latest(spark, sf), COMBOS, "majority")).select(F.col("uid").cast("long").alias("custkey"))


@query("p17_missing_is_error", with_("ve", "la") + "SELECT c_custkey AS custkey, coalesce(status, 'error') AS status FROM customer LEFT JOIN (SELECT * FROM la WHERE combo = 'view') ON uid = CAST(c_custkey AS VARCHAR)")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid"))
    return verdicts.with_missing(c, _latest(spark, sf).where("combo = 'view'")).select(F.col("uid").cast("long").alias("custkey"), "status")


@query("p15_map_status", "SELECT event_id, CASE event_type WHEN 'click' THEN 'well_posed' WHEN 'error' THEN 'ill_posed' ELSE CASE WHEN value > 50 THEN 'error' ELSE 'defer' END END AS status FROM events")
def _(spark, sf):
    status = verdicts.map_status(F.col("event_type"), {"click": "well_posed", "error": "ill_posed"}, F.col("value") > 50)
    return table(spark, sf, "events").select("event_id", status.alias("status"))


@query("a4_status_counts", with_("ve", "la") + "SELECT status, count(*) AS records FROM la WHERE status IN ('well_posed', 'ill_posed') AND combo IN ('click', 'purchase', 'view') GROUP BY status")
def _(spark, sf):
    return verdicts.status_counts(_latest(spark, sf), ("well_posed", "ill_posed"))


@query("a29_gate_crossing", with_("ro", "ta") + "SELECT uid, CASE WHEN n_correct * 2 > n THEN CASE WHEN n_wrong % 2 = 0 THEN 0 ELSE -1 END ELSE CASE WHEN n_wrong % 2 = 0 THEN 1 ELSE 0 END END AS crossing FROM ta")
def _(spark, sf):
    t = _tally(spark, sf)
    return t.select("uid", verdicts.gate_crossing(F.col("n_correct") * 2 > F.col("n"), F.col("n_wrong") % 2 == 0).alias("crossing"))


# --- text ----------------------------------------------------------------------------------------------------------------

_N = "coalesce(len(regexp_extract_all(coalesce(text, ''), '{}')), 0)"


def _counts_sql(patterns: dict[str, str], tail: str = "") -> str:
    return with_("fx") + "SELECT doc_id, " + ", ".join(f"{_N.replace('{}', p.replace(chr(39), chr(39) * 2))} AS {k}" for k, p in patterns.items()) + f" FROM fx{tail}"


def _counts(spark, sf, patterns: dict[str, str], scan) -> DataFrame:
    d = S.statements(spark, sf).select("doc_id", scan(F.col("text")).alias("m"))
    return d.select("doc_id", *[F.coalesce(F.col("m")[k], F.lit(0)).cast("long").alias(k) for k in patterns])


@query("x20_elision", _counts_sql(text.ELISION))
def _(spark, sf):
    return _counts(spark, sf, text.ELISION, text.elision_signals)


@query("x25_structural", _counts_sql(text.STRUCTURAL))
def _(spark, sf):
    return _counts(spark, sf, text.STRUCTURAL, text.structural_hits)


#: RE2 has no lookahead: what follows a match is matched, too, and no match begins there.
_RE2_DANGLING = {k: p.replace(r"(?=\s*[.\n]|\s*$)", r"\s*(?:[.\n]|$)") for k, p in text.DANGLING.items()}


@query("x21_dangling_counts", _counts_sql(_RE2_DANGLING))
def _(spark, sf):
    return _counts(spark, sf, text.DANGLING, text.dangling_counts)


@query("x21_dangling_scan", f"WITH c AS ({_counts_sql(_RE2_DANGLING)}) SELECT doc_id, pattern, hits FROM (UNPIVOT c ON {', '.join(_RE2_DANGLING)} INTO NAME pattern VALUE hits) WHERE hits > 0")
def _(spark, sf):
    d = S.statements(spark, sf).select("doc_id", F.explode(text.dangling_scan("text")).alias("h"))
    return d.groupBy("doc_id", "h.pattern").agg(F.count(F.lit(1)).alias("hits"))


_PHRASES = _N.replace("{}", text.CONTEXT_PHRASES)


@query("x26_soft_context", with_("fx") + f"SELECT doc_id, {_N.replace('{}', text.EQUATION_NUMBER)} AS bare_equation_number, {_PHRASES} AS phrases, CASE WHEN contains(lower(text), 'shown below') THEN 1 ELSE 0 END AS shown_below FROM fx")
def _(spark, sf):
    d = S.statements(spark, sf).select("doc_id", text.soft_context(F.col("text")).alias("m"))
    count = lambda k: F.coalesce(F.col("m")[k], F.lit(0)).cast("long")
    total = F.aggregate(F.map_values("m"), F.lit(0), lambda a, v: a + v).cast("long")
    return d.select("doc_id", count("bare_equation_number").alias("bare_equation_number"), (total - count("bare_equation_number")).alias("phrases"), count("shown below").cast("int").alias("shown_below"))


@query(
    "x28_context_lint",
    with_("fx") + f""", c AS (SELECT doc_id, {_N.replace('{}', text.MISSING_CONTEXT)} AS missing_context_placeholder, {_N.replace('{}', text.SOURCE_LOCAL)} AS source_local_language,
CAST(doc_id % {len(S.PHRASES)} = 7 AS INTEGER) AS defines_then_asks, CAST(contains(text, 'Plain words only.') AS INTEGER) AS verbatim_formula_recall FROM fx)
SELECT doc_id, lint, CAST(hits AS INTEGER) AS hits FROM (UNPIVOT (SELECT doc_id, CAST(missing_context_placeholder AS INTEGER) AS missing_context_placeholder, CAST(source_local_language AS INTEGER) AS source_local_language, defines_then_asks, verbatim_formula_recall FROM c)
ON missing_context_placeholder, source_local_language, defines_then_asks, verbatim_formula_recall INTO NAME lint VALUE hits) WHERE hits > 0""",
)
def _(spark, sf):
    d = S.statements(spark, sf).select("doc_id", F.explode(text.context_lint(F.col("text"), F.lit("Plain  words only."))).alias("lint", "found"))
    return d.select("doc_id", "lint", F.size("found").alias("hits"))


@query("x1_strip_think", "SELECT doc_id, regexp_replace(regexp_replace('<think>' || lang || '</think> ' || text, '(?s)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.strip_think(F.concat(F.lit("<think>"), "lang", F.lit("</think> "), "text")).alias("t"))


@query("x4_candidate", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '\\frac{' || doc_id || '}{2}' WHEN doc_id % 3 = 1 THEN 'b' || doc_id ELSE 'forty ' || doc_id END AS candidate FROM documents")
def _(spark, sf):
    n = F.col("doc_id").cast("string")
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("so $x$ is \\boxed{\\frac{"), n, F.lit("}{2}} done"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("either $a$ or $b"), n, F.lit("$ ok"))).otherwise(F.concat(F.lit("Final answer: forty "), n, F.lit(".")))
    return table(spark, sf, "documents").select("doc_id", text.extract_candidate(answer).alias("candidate"))


def _clean_sql(raw: str) -> str:
    for pattern in (text.LABEL, text.CITE, text.REF, r"\{\s*\}", r"^\s*\[[^\]]*\]"):
        raw = f"regexp_replace({raw}, '{pattern}', '', 'g')"
    return f"trim(regexp_replace(regexp_replace(replace({raw}, '~', ' '), '\\s+([.,;:])', '\\1', 'g'), '{WS}', ' ', 'g'), ' ')"


@query("x12_clean_tex", "SELECT doc_id, " + _clean_sql("' [Opt] Let~A\\label{q} . ' || text || '\\cite[p]{z} b\\ref{a,b} , {} c '") + " AS t FROM documents")
def _(spark, sf):
    raw = F.concat(F.lit(" [Opt] Let~A\\label{q} . "), "text", F.lit("\\cite[p]{z} b\\ref{a,b} , {} c "))
    return table(spark, sf, "documents").select("doc_id", text.clean_tex(raw).alias("t"))


@query("x15_referenced_labels", "SELECT doc_id, 'a|b|' || lang AS labels FROM documents")
def _(spark, sf):
    raw = F.concat(F.lit("\\ref{a, b} and \\eqref{"), "lang", F.lit("}"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.referenced_labels(raw), "|").alias("labels"))


@query(
    "x18_classify_proof",
    "WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '" + WS + "', ' ', 'g'), ' ') AS f FROM documents) "
    "SELECT doc_id, CASE WHEN length(f) < 40 OR (length(f) < 200 AND regexp_matches(lower(f), 'omitted|left to the reader|standard|follows from|immediate from|see \\[|see \\\\cite')) THEN 'omitted' ELSE 'substantive' END AS class FROM t",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.classify_proof(F.col("text")).alias("class"))


@query("x23_normalise_math", "SELECT item_id, '1/2+x' || item_id || '=' AS m FROM benchmark")
def _(spark, sf):
    raw = F.concat(F.lit("$\\left( \\dfrac{1}{2} \\right) + X_{"), F.col("item_id").cast("string"), F.lit("} =$ ."))
    return table(spark, sf, "benchmark").select("item_id", F.replace(text.normalise_math(raw), F.lit("_"), F.lit("")).alias("m"))


@query("x30_judge_reply", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS k FROM documents")
def _(spark, sf):
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('```json\n{"k": '), F.col("doc_id").cast("string"), F.lit("}\n```"))).otherwise(F.lit("no json {here"))
    return table(spark, sf, "documents").select("doc_id", F.get_json_object(text.judge_reply(reply), "$.k").cast("long").alias("k"))


@query(
    "a27_copy_fraction",
    "WITH w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '" + WS + "', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS ws FROM conversations), "
    "g AS (SELECT conv_id, turn, CASE WHEN len(ws) >= 6 THEN list_distinct(list_transform(range(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 5], ' '))) ELSE [] END AS gs FROM w) "
    "SELECT a.conv_id, a.turn, CASE WHEN len(a.gs) = 0 THEN 0.0 ELSE round(len(list_intersect(a.gs, b.gs)) / len(a.gs), 6) END AS copied FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
)
def _(spark, sf):
    c = table(spark, sf, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.copy_fraction(F.col("text"), F.col("reply")), 6).alias("copied"))


@query("x27_passk_warning", with_("ro", "ta") + "SELECT uid, round(n_degenerate / n, 6) AS degenerate_share, CASE WHEN n_correct + n_wrong = 0 THEN 'no committed answers in pass@k trials' WHEN n_degenerate / n >= 0.5 THEN 'high degenerate share in pass@k trials' END AS warning FROM ta")
def _(spark, sf):
    w = text.passk_warning(F.col("n_correct"), F.col("n_wrong"), F.col("n_degenerate"))
    return _tally(spark, sf).select("uid", w["degenerate_share"].alias("degenerate_share"), w["warning"].alias("warning"))


@query(
    "x38_divergence",
    with_("fx") + "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'match' WHEN doc_id % 3 = 1 THEN 'prefix' ELSE 'divergence' END AS kind, CASE WHEN doc_id % 3 = 1 THEN length(text) WHEN doc_id % 3 = 2 THEN length(text) - 1 END AS at FROM fx",
)
def _(spark, sf):
    t, m = F.col("text"), F.col("doc_id") % 3
    other = F.when(m == 0, t).when(m == 1, F.concat(t, F.lit(" more"))).otherwise(F.concat(F.substr(t, F.lit(1), F.length(t) - 1), F.lit("Z")))
    out = text.text_divergence(t, other)
    return S.statements(spark, sf).select("doc_id", out["kind"].alias("kind"), out["at"].cast("long").alias("at"))


@query("x5_verifier", "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'number' ELSE 'expr' END AS tier, doc_id % 2 = 0 AS correct FROM documents")
def _(spark, sf):
    n, kind, right = F.col("doc_id") % 20, F.col("doc_id") % 5, F.col("doc_id") % 2 == 0
    k, other = n.cast("string"), (n + 1).cast("string")
    own = F.when(right, k).otherwise(other)
    truth = F.when(kind == 0, F.concat(F.lit("$\\frac{"), (n * 2).cast("string"), F.lit("}{4} + x$"))).when(kind == 1, F.concat(F.lit("\\[ y = (x+1)^2 + "), k, F.lit(" \\]")))
    truth = truth.when(kind == 2, F.concat(F.lit("2^{n+"), k, F.lit("}"))).when(kind == 3, F.concat(F.lit("\\sin(2x) + "), k)).otherwise(F.concat(F.lit("\\sqrt{8} + "), k))
    candidate = F.when(kind == 0, F.concat(F.lit("x + "), own, F.lit("/2"))).when(kind == 1, F.concat(F.lit("x^2 + 2x + 1 + "), own))
    candidate = candidate.when(kind == 2, F.concat(F.lit("2^n \\cdot 2^{"), own, F.lit("}"))).when(kind == 3, F.concat(own, F.lit(" + sin(x+x)"))).otherwise(F.concat(own, F.lit(" + 2\\sqrt{2}")))
    return table(spark, sf, "documents").select("doc_id", verify.truth_tier(truth).alias("tier"), verify.verify_answer(candidate, truth).alias("correct"))


def _papers(spark, sf) -> DataFrame:
    parts = [F.lit("\\begin{theorem}\\label{t1} Let "), "text", F.lit("\n hold. \\end{theorem}\n\\begin{proof}[Proof of \\ref{t1}] It follows. "), "text", F.lit("\n\\end{proof}")]
    return table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("arxiv_id"), F.concat(*parts).alias("tex"))


_BODY = "'\\label{t1} Let ' || regexp_replace(text, '%[^\n]*', '', 'g') || chr(10) || ' hold. '"


@query("x13_theorems", f"SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, 0 AS pos, 'theorem' AS env_name, {_clean_sql(_BODY)} AS statement, {_BODY} AS body_raw FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    return latex.theorem_candidates(_papers(spark, sf))


@query(
    "x19_match_proofs",
    "WITH t AS (SELECT doc_id, length('\\begin{theorem}\\label{t1} Let ' || text || '. hold. \\end{theorem}.') AS start, trim(regexp_replace(' It follows. ' || text || ' ', '" + WS + "', ' ', 'g'), ' ') AS f FROM documents WHERE text IS NOT NULL) "
    "SELECT 'u' || doc_id AS uid, CAST(start AS INTEGER) AS start, 'proof_of_label' AS method, 'high' AS confidence, false AS multi_proof, "
    "CASE WHEN length(f) < 40 OR (length(f) < 200 AND regexp_matches(lower(f), 'omitted|left to the reader|standard|follows from|immediate from|see \\[|see \\\\cite')) THEN 'omitted' ELSE 'substantive' END AS proof_class FROM t",
)
def _(spark, sf):
    papers = _papers(spark, sf)
    thm = papers.select("arxiv_id", F.explode(latex.theorem_envs("tex")).alias("e")).select(F.concat(F.lit("u"), "arxiv_id").alias("uid"), "arxiv_id", "e.start", "e.end", "e.body_raw")
    prf = papers.select("arxiv_id", F.explode(latex.proof_envs("tex")).alias("e")).select("arxiv_id", "e.start", "e.end", "e.body_raw", "e.opt_arg")
    return spans.match_proofs(thm, prf, thm.select("arxiv_id", "start"))


# --- ranges and as-of ----------------------------------------------------------------------------------------------------


@query("j9_range_join", "SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_orderkey BETWEEN p_partkey * 7 AND p_partkey * 7 + 10")
def _(spark, sf):
    r = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * 7).alias("lo"), (F.col("p_partkey") * 7 + 10).alias("hi"))
    return spans.range_join(table(spark, sf, "orders").select("o_orderkey"), r, "o_orderkey", "lo", "hi", 16).select("o_orderkey", "p_partkey")


@query(
    "j17_as_of_forward",
    "SELECT l.user_id, l.event_id, min(r.event_id) AS next_error FROM (SELECT * FROM events WHERE event_type = 'purchase') l LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r ON l.user_id = r.user_id AND r.event_id >= l.event_id GROUP BY l.user_id, l.event_id",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    left, right = e.where("event_type = 'purchase'").select("user_id", "event_id"), e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("next_error"))
    return spans.as_of_forward(left, right, ["user_id"], "event_id", "next_error")


def _manifest(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    code = lambda n: F.concat(F.lpad((n % 12 + 1 + 2300).cast("string"), 4, "0"), F.lit("."), F.lpad((n * 5 % 90000).cast("string"), 5, "0"))
    yymm = F.lpad((k % 12 + 1 + 2300).cast("string"), 4, "0")
    return table(spark, sf, "part").select(F.concat(F.lit("f"), k.cast("string")).alias("filename"), yymm.alias("yymm"), code(k).alias("first_item"), F.concat(yymm, F.lit("."), F.lpad((k * 5 % 90000 + 3).cast("string"), 5, "0")).alias("last_item"), k.alias("size_bytes"))


@query("a17_rollup", "SELECT count(*) AS chunk_count, CAST(coalesce(sum(p_partkey), 0) AS BIGINT) AS total_bytes, round(coalesce(sum(p_partkey), 0) / 1e9 * 0.09, 6) AS egress_usd FROM part WHERE p_partkey % 12 = 4")
def _(spark, sf):
    return spans.rollup(spans.select_chunks(_manifest(spark, sf), 2023, 5))


@query("j9_chunks_for_ids", "SELECT DISTINCT 'f' || p_partkey AS filename FROM part JOIN orders ON o_orderkey % 12 = p_partkey % 12 AND o_orderkey % 90000 BETWEEN p_partkey * 5 % 90000 AND p_partkey * 5 % 90000 + 3")
def _(spark, sf):
    o = F.col("o_orderkey")
    wanted = table(spark, sf, "orders").select(F.concat(F.lpad((o % 12 + 1 + 2300).cast("string"), 4, "0"), F.lit("."), F.lpad((o % 90000).cast("string"), 5, "0")).alias("arxiv_id"))
    return spans.chunks_for_ids(_manifest(spark, sf), wanted).select("filename")


# --- splits and guards ---------------------------------------------------------------------------------------------------


def _scored(spark, sf) -> DataFrame:
    return _tally(spark, sf).withColumn("arxiv_id", F.concat(F.lit("p"), (F.col("uid").cast("long") % 40).cast("string"))).withColumn("pos", F.col("uid").cast("long"))


@query("a26_eval_slices", with_("ro", "ta") + "SELECT uid, CASE WHEN CAST(uid AS BIGINT) % 40 < 15 THEN CASE WHEN label = 'band' THEN 'eval_band' WHEN label = 'solved' AND n_correct = n THEN 'anchor_solved' WHEN label = 'collapse' AND n_correct = 0 THEN 'anchor_fail' END END AS eval_slice, CAST(uid AS BIGINT) % 40 >= 15 AND label = 'band' AS is_train FROM ta")
def _(spark, sf):
    papers = spark.range(15).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("arxiv_id"))
    return splits.eval_slices(_scored(spark, sf), papers, ["pos"]).select("uid", "eval_slice", "is_train")


@query("o7_slice_order", with_("ro", "ta") + "SELECT uid, CASE label WHEN 'band' THEN 0 WHEN 'solved' THEN 1 WHEN 'collapse' THEN 2 END AS k FROM ta WHERE label IN ('band', 'solved', 'collapse') ORDER BY k, uid")
def _(spark, sf):
    named = F.when(F.col("label") == "band", "eval_band").when(F.col("label") == "solved", "anchor_solved").when(F.col("label") == "collapse", "anchor_fail")
    return _tally(spark, sf).select("uid", splits.slice_order(named).alias("k")).where("k is not null").orderBy("k", "uid")


@query("j22_statement_leaks", "WITH r AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark) SELECT doc_id FROM r WHERE text IN (SELECT text FROM benchmark)")
def _(spark, sf):
    held = table(spark, sf, "benchmark")
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("statement")).unionByName(held.select((-1 - F.col("item_id")).alias("doc_id"), F.col("text").alias("statement")))
    return splits.statement_leaks(d, held.select(F.col("text").alias("statement"))).select("doc_id")


@query("j21_prompt_leaks", "SELECT DISTINCT doc_id FROM conv, bench WHERE contains(p, s)".replace("conv", "(SELECT doc_id, text AS p FROM documents)").replace("bench", "(SELECT text AS s FROM benchmark)"))
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").alias("prompt"))
    return splits.prompt_leaks(d, table(spark, sf, "benchmark").select(F.col("text").alias("statement"))).select("doc_id")


@query("g2_shared_statements", "SELECT sha256(text) AS h, count(DISTINCT doc_id) AS uids FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT doc_id) > 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.sha2("text", 256).alias("statement"))
    return splits.shared_statements(d).select(F.col("statement").alias("h"), "uids")


@query("j24_leaks", "SELECT doc_id, 'paper' AS kind FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, 'uid' AS kind FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("arxiv_id"), F.col("doc_id").alias("uid"))
    papers = spark.range(1).select(F.lit("src1").alias("arxiv_id"))
    uids = table(spark, sf, "benchmark").select(F.col("item_id").alias("uid"))
    return splits.paper_leaks(d, papers).select("doc_id", F.lit("paper").alias("kind")).unionByName(splits.uid_leaks(d, uids).select("doc_id", F.lit("uid").alias("kind")))


@query("j26_anchors_in_eval", "SELECT doc_id FROM documents WHERE source = 'src1' OR source IS NULL OR doc_id IN (SELECT item_id FROM benchmark)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("arxiv_id"), F.col("doc_id").alias("uid"))
    return splits.anchors_in_eval(d, table(spark, sf, "benchmark").select(F.col("item_id").alias("uid")), spark.range(1).select(F.lit("src1").alias("arxiv_id"))).select("doc_id")


@query("j27_not_on_train_side", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"))
    return splits.not_on_train_side(d, table(spark, sf, "labels").select(F.col("doc_id").alias("uid"))).select(F.col("uid").alias("doc_id"))


@query("j3_select_train", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"))
    return splits.select_train(d, lab.where("quality = 1").select(F.col("doc_id").alias("uid")), lab.where("toxic = 1").select(F.col("doc_id").alias("uid"))).select(F.col("uid").alias("doc_id"))


@query("j3_desyncs", "SELECT doc_id AS uid, 'missing' AS problem FROM (SELECT doc_id + 1000000 AS doc_id FROM labels WHERE quality = 0) UNION ALL SELECT doc_id, 'backfill in the corpus' FROM labels WHERE toxic = 1")
def _(spark, sf):
    lab = table(spark, sf, "labels")
    corpus = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.coalesce(F.nullif("text", F.lit("")), F.lit("x")).alias("statement"))
    wanted = lab.where("quality = 1").select(F.col("doc_id").alias("uid")).unionByName(lab.where("quality = 0").select((F.col("doc_id") + 1000000).alias("uid")))
    return splits.selection_desyncs(corpus, wanted, lab.where("toxic = 1").select(F.col("doc_id").alias("uid")))


@query("j28_subset_differences", "SELECT coalesce(a.doc_id, b.doc_id) AS uid, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS problem FROM (SELECT doc_id, quality FROM labels) a FULL JOIN (SELECT doc_id, toxic FROM labels WHERE quality = 1) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.quality <> b.toxic")
def _(spark, sf):
    lab = table(spark, sf, "labels")
    return splits.subset_differences(lab.select(F.col("doc_id").alias("uid"), F.col("quality").alias("c")), lab.where("quality = 1").select(F.col("doc_id").alias("uid"), F.col("toxic").alias("c")), "c")


@query("u5_not_disjoint", "SELECT doc_id AS uid FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def _(spark, sf):
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "uid")
    return splits.not_disjoint(lab.where("quality = 1"), lab.where("toxic = 1"))


@query("u6_roster_differences", "(SELECT uid, 'left' AS side FROM (SELECT doc_id AS uid FROM labels WHERE quality = 1 EXCEPT ALL SELECT doc_id FROM labels WHERE toxic = 1)) UNION ALL (SELECT uid, 'right' AS side FROM (SELECT doc_id AS uid FROM labels WHERE toxic = 1 EXCEPT ALL SELECT doc_id FROM labels WHERE quality = 1))")
def _(spark, sf):
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "uid")
    return splits.roster_differences(lab.where("quality = 1"), lab.where("toxic = 1"))


@query("u2_union_distinct", "SELECT doc_id AS uid FROM labels UNION SELECT item_id FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("uid")).union(table(spark, sf, "benchmark").select("item_id")).distinct()


@query("g1_without_answer", "SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) = '' OR doc_id % 9 < 2")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("statement"), F.when(F.col("doc_id") % 9 == 0, "  ").when(F.col("doc_id") % 9 > 1, F.col("lang")).alias("answer"))
    return splits.without_statement_or_answer(d).select("doc_id")


# --- training rows -------------------------------------------------------------------------------------------------------


@query("w10_cap1", with_("ro") + "SELECT uid, rollout_uid FROM ro WHERE verdict = 'correct' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY sha256('7:' || uid || ':' || rollout_uid)) = 1")
def _(spark, sf):
    return training.weighted(S.rollouts(spark, sf).where("verdict = 'correct'"), "cap1", seed=7).select("uid", "rollout_uid")


@query("w10_capk", with_("ro") + "SELECT uid, rollout_uid FROM ro WHERE verdict = 'correct' QUALIFY row_number() OVER (PARTITION BY uid ORDER BY sha256('7:' || uid || ':' || rollout_uid)) <= 3")
def _(spark, sf):
    return training.weighted(S.rollouts(spark, sf).where("verdict = 'correct'"), "capk", 3, 7).select("uid", "rollout_uid")


@query("w10_inverse", with_("ro") + "SELECT uid, rollout_uid, round(1.0 / count(*) OVER (PARTITION BY uid), 9) AS weight FROM ro WHERE verdict = 'correct'")
def _(spark, sf):
    return training.weighted(S.rollouts(spark, sf).where("verdict = 'correct'"), "inverse").select("uid", "rollout_uid", F.round("weight", 9).alias("weight"))


@query("w11_weight_violations", with_("ro") + "SELECT uid, count(*) AS rows FROM ro WHERE verdict = 'correct' GROUP BY uid HAVING count(*) > 20")
def _(spark, sf):
    return training.weight_violations(S.rollouts(spark, sf).where("verdict = 'correct'"), "capk", 20)


@query("a21_rows_per_uid", with_("ro") + "SELECT rows, count(*) AS uids FROM (SELECT uid, count(*) AS rows FROM ro GROUP BY uid) GROUP BY rows")
def _(spark, sf):
    return training.rows_per_uid(S.rollouts(spark, sf))


@query("o5_draw", with_("ro") + "SELECT CAST(c_custkey AS VARCHAR) AS uid FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT uid FROM ro) ORDER BY sha256('anchor:' || CAST(c_custkey AS VARCHAR)), 1 LIMIT 25")
def _(spark, sf):
    return training.draw(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid")), S.rollouts(spark, sf), 25, "anchor")


@query("j15_hinted_tier", with_("ro", "ta") + "SELECT c_custkey AS custkey, CASE WHEN c_custkey IN (SELECT item_id FROM benchmark) THEN 'band' ELSE label END AS tier, CASE WHEN c_custkey IN (SELECT item_id FROM benchmark) THEN 'band' WHEN uid IS NULL THEN 'not_in_pool' ELSE label END AS why FROM customer LEFT JOIN ta ON uid = CAST(c_custkey AS VARCHAR)")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid"))
    band = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("uid"))
    return training.hinted_tier(c, band, _tally(spark, sf).select("uid", "label")).select(F.col("uid").cast("long").alias("custkey"), "tier", "why")


@query("w5_one_per_rollout", with_("ro") + "SELECT uid, candidate AS rollout_uid, min(sample_idx) AS sample_idx FROM ro GROUP BY uid, candidate")
def _(spark, sf):
    r = S.rollouts(spark, sf).select("uid", F.col("candidate").alias("rollout_uid"), "sample_idx")
    return training.one_per_rollout(r, "sample_idx")


@query(
    "j14_reconcile",
    with_("ro", "ta") + ", k AS (SELECT uid, CAST(uid AS BIGINT) % 4 AS m FROM ta) SELECT uid, CASE WHEN m = 0 THEN 'f1' WHEN m = 1 THEN 'f2' END AS file, CASE m WHEN 0 THEN 'routed' WHEN 1 THEN 'unique_alternative' WHEN 2 THEN 'none' ELSE 'ambiguous' END AS how FROM k",
)
def _(spark, sf):
    r = S.rollouts(spark, sf)
    m = F.col("uid").cast("long") % 4
    files = r.where(m == 0).withColumn("file", F.lit("f1"))
    for when_, name in ((m == 1, "f2"), (m == 3, "f2"), (m == 3, "f3")):
        files = files.unionByName(r.where(when_).withColumn("file", F.lit(name)))
    recs = r.groupBy("uid").agg(F.collect_list("rollout_uid").alias("rollout_uids")).join(_tally(spark, sf), "uid").withColumn("routed", F.lit("f1"))
    return training.reconcile(recs.select("uid", "rollout_uids", "routed", "n_correct", "n_wrong", "n_degenerate"), files.select("file", "uid", "rollout_uid", "verdict"))


def _chat(spark, sf) -> DataFrame:
    recs = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_name").alias("statement"), F.col("c_mktsegment").alias("arxiv_id"))
    return training.sft_rows(recs, S.rollouts(spark, sf).withColumn("output", F.col("candidate")), "You solve problems.", " /go")


@query("p21_sft_rows", with_("ro") + "SELECT uid, rollout_uid, 'system|user|' || c_name || ' /go' AS asked, candidate AS answered FROM ro JOIN customer ON uid = CAST(c_custkey AS VARCHAR) WHERE verdict = 'correct'")
def _(spark, sf):
    asked = F.concat_ws("|", F.col("prompt")[0]["role"], F.col("prompt")[1]["role"], F.col("prompt")[1]["content"])
    return _chat(spark, sf).select("uid", "rollout_uid", asked.alias("asked"), F.col("completion")[0]["content"].alias("answered"))


def _bad_chat(spark, sf) -> DataFrame:
    """Chat rows, some with an unverified provenance, an empty answer or a message too many."""
    m = F.col("uid").cast("long") % 10
    p, q = F.col("provenance"), F.col("prompt")
    return _chat(spark, sf).withColumns(
        {
            "provenance": p.withField("verdict", F.when(m == 0, "wrong").otherwise(p["verdict"])).withField("rollout_uid", F.when(m != 1, p["rollout_uid"])),
            "completion": F.when(m == 2, F.array(training.message("assistant", F.lit(" ")))).otherwise(F.col("completion")),
            "prompt": F.when(m == 3, F.concat(q, q)).when(m == 4, F.reverse(q)).otherwise(q),
        }
    )


@query("g3_not_verified", with_("ro") + "SELECT uid, rollout_uid FROM ro JOIN customer ON uid = CAST(c_custkey AS VARCHAR) WHERE verdict = 'correct' AND c_custkey % 10 < 2")
def _(spark, sf):
    return training.not_verified(_bad_chat(spark, sf)).select("uid", "rollout_uid")


@query("g5_malformed", with_("ro") + "SELECT uid, rollout_uid FROM ro JOIN customer ON uid = CAST(c_custkey AS VARCHAR) WHERE verdict = 'correct' AND c_custkey % 10 BETWEEN 2 AND 4")
def _(spark, sf):
    return training.malformed(_bad_chat(spark, sf)).select("uid", "rollout_uid")


@query("g7_hint_in_prompt", with_("ro") + "SELECT uid, rollout_uid FROM ro JOIN customer ON uid = CAST(c_custkey AS VARCHAR) WHERE verdict = 'correct' AND contains(c_name, '7')")
def _(spark, sf):
    return training.hint_in_prompt(_chat(spark, sf), "7").select("uid", "rollout_uid")


@query("r57_regen_prompts", "SELECT item_id, k AS sample_idx, text || ' HINT ' || 's' AS prompt FROM benchmark, range(0, 3) t(k)")
def _(spark, sf):
    s = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("statement"), F.lit("s").alias("solution"))
    return training.regen_prompts(s, " HINT ", 3).select("item_id", F.col("sample_idx").cast("long").alias("sample_idx"), "prompt")


# --- report --------------------------------------------------------------------------------------------------------------


def _pairs(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = _tally(spark, sf)
    base = t.select("uid", F.when(F.col("n_wrong") % 3 != 0, F.col("n_correct") % 2).alias("n_correct"))
    tuned = t.select("uid", (F.col("n_wrong") % 2).alias("n_correct"))
    return t.select("uid", "label"), base, tuned


_PAIRS = "p AS (SELECT label, CASE WHEN n_wrong % 3 <> 0 THEN n_correct % 2 > 0 END AS b, n_wrong % 2 > 0 AS t FROM ta), q AS (SELECT label, count(*) FILTER (b IS NOT NULL) AS n_pairs, count(*) FILTER (b AND t) AS a, count(*) FILTER (b AND NOT t) AS b, count(*) FILTER (NOT b AND t) AS c, count(*) FILTER (NOT b AND NOT t) AS d, count(*) FILTER (b IS NULL) AS missing FROM p GROUP BY label)"


@query("j12_paired_table", with_("ro", "ta") + f", {_PAIRS} SELECT * FROM q")
def _(spark, sf):
    return report.paired_table(*_pairs(spark, sf), group="label").select("label", "n_pairs", "a", "b", "c", "d", "missing")


@query("a19_wald", with_("ro", "ta") + f", {_PAIRS} SELECT label, round(coalesce((c - b) / n_pairs - 1.959963984540054 * sqrt(greatest(b + c - (c - b) * (c - b) / n_pairs, 0.0)) / n_pairs, 0.0), 9) AS lo, round(coalesce((c - b) / n_pairs + 1.959963984540054 * sqrt(greatest(b + c - (c - b) * (c - b) / n_pairs, 0.0)) / n_pairs, 0.0), 9) AS hi FROM q")
def _(spark, sf):
    ci = report.wald_interval(F.col("b"), F.col("c"), F.col("n_pairs"))
    return report.paired_table(*_pairs(spark, sf), group="label").select("label", F.round(ci["lo"], 9).alias("lo"), F.round(ci["hi"], 9).alias("hi"))


def _choose(n: str, k: str) -> str:
    return f"list_reduce(list_prepend(1.0::DOUBLE, range(1, {k} + 1)::DOUBLE[]), lambda x, i: x * ({n} - i + 1) / i)"


@query("a18_mcnemar", with_("ro", "ta") + f", {_PAIRS} SELECT label, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda j: {_choose('(b + c)', 'j')})) / pow(2.0, b + c)), 9) END AS p FROM q")
def _(spark, sf):
    return report.paired_table(*_pairs(spark, sf), group="label").select("label", F.round(report.mcnemar_exact("b", "c"), 9).alias("p"))


@query("a20_repeat_means", "SELECT event_type AS repeat, round(avg(value), 6) AS mean_n_correct FROM events WHERE user_id IN (SELECT item_id FROM benchmark) GROUP BY event_type")
def _(spark, sf):
    s = table(spark, sf, "events").select(F.col("event_type").alias("repeat"), F.col("user_id").alias("uid"), F.col("value").alias("n_correct"))
    return report.repeat_means(s, table(spark, sf, "benchmark").select(F.col("item_id").alias("uid"))).withColumn("mean_n_correct", F.round("mean_n_correct", 6))


# --- slices and streams --------------------------------------------------------------------------------------------------


def _journal(spark, sf) -> tuple[DataFrame, DataFrame]:
    e, u = table(spark, sf, "events"), F.col("user_id")
    j = e.select(F.col("event_id").alias("line_no"), F.concat(F.lit("u"), (u % 120).cast("string")).alias("uid"), F.concat(F.lit("s"), (u % 120).cast("string")).alias("stmt_key"), F.lit("h").alias("content_hash"))
    n = F.col("id").cast("string")
    led = spark.range(30).select(F.concat(F.when(F.col("id") < 20, "u").otherwise("x"), n).alias("uid"), F.concat(F.lit("s"), n).alias("stmt_key"), F.when(F.col("id") < 10, "h").otherwise("other").alias("content_hash"), F.lit(1).cast("long").alias("journal_line"), (F.col("id") >= 25).alias("warn_only"))
    return j, led


_JOURNAL = """j AS (SELECT event_id AS line_no, user_id % 120 AS k FROM events),
v AS (SELECT *, CASE WHEN k < 10 THEN 'replay' WHEN k < 20 THEN 'uid_conflict' WHEN k < 25 THEN 'stmt_conflict' WHEN k < 30 THEN 'warn' ELSE 'new' END AS verdict FROM j)"""


@query("j31_ledger_check", f"WITH {_JOURNAL} SELECT line_no, verdict FROM v")
def _(spark, sf):
    return slices.ledger_check(*_journal(spark, sf)).select("line_no", "verdict")


@query(
    "w16_cut_slice",
    f"""WITH {_JOURNAL}, f AS (SELECT k, min(line_no) AS first FROM v WHERE k >= 25 GROUP BY k),
e AS (SELECT max(first) AS through, count(*) AS n FROM (SELECT first FROM f ORDER BY first LIMIT 50))
SELECT line_no, CASE WHEN v.k >= 25 AND line_no > first THEN 'replay' ELSE verdict END AS verdict, n >= 50 AND coalesce(v.k >= 25 AND line_no = first, false) AS accepted FROM v LEFT JOIN f ON v.k = f.k, e WHERE n < 50 OR line_no <= through""",
)
def _(spark, sf):
    j, led = _journal(spark, sf)
    return slices.cut_slice(j, led, 50).select("line_no", "verdict", "accepted")


@query("w17_intra_previous", "SELECT event_id AS line_no, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_line FROM events")
def _(spark, sf):
    j = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.col("user_id").alias("stmt_key"))
    return slices.intra_previous(j).select("line_no", "previous_line")


@query("m_windowed_counts", "SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS rows FROM events GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("rows")).select("event_type", F.col("window.start").cast("date").alias("day"), "rows")


# --- acquisition and lookups ---------------------------------------------------------------------------------------------


@query("j4_unseen", "SELECT doc_id FROM documents WHERE source NOT IN (SELECT 'src' || (item_id % 7) FROM benchmark)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("arxiv_id"))
    return acquire.unseen(d, table(spark, sf, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")).alias("arxiv_id"))).select("doc_id")


@query("j5_surplus_only", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL)")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").alias("statement"))
    return acquire.surplus_only(d, d.join(table(spark, sf, "labels"), "doc_id", "left_semi")).select("doc_id")


@query("f13_discard", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'generated' WHEN source = 'src1' THEN 'no_arxiv_id' END AS discard_reason FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "Computed").alias("provenance"), "source")
    return acquire.predisposition(d, F.when(F.col("source") != "src1", F.col("source"))).select("doc_id", "discard_reason")


def _lookups(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("uid"), F.col("lang").alias("title"), "source", F.lit("x").alias("provenance"))
    queued = acquire.predisposition(d, F.when(F.col("source") != "src1", F.col("source")))
    papers = acquire.unique_papers(queued.where("discard_reason is null"), "doc_id")
    verdict = lambda like, status: d.where(F.col("source").rlike(like)).select(F.col("source").alias("arxiv_id"), F.lit(status).alias("status"), F.lit("high").alias("confidence")).distinct()
    return queued, acquire.lookups(papers, verdict("[13579]$", "published"), verdict("[0-4]$", "unpublished"))


@query("j7_unique_papers", "SELECT source AS arxiv_id, arg_min(lang, doc_id) AS title, CAST(min(doc_id) AS VARCHAR) AS uid FROM documents WHERE source <> 'src1' GROUP BY source")
def _(spark, sf):
    return _lookups(spark, sf)[1].select("arxiv_id", "title", "uid")


@query("j30_lookups", "SELECT DISTINCT source AS arxiv_id, CASE WHEN regexp_matches(source, '[13579]$') THEN 'published' WHEN regexp_matches(source, '[0-4]$') THEN 'unpublished' ELSE 'error' END AS status, regexp_matches(source, '[13579]$') AS cache_hit FROM documents WHERE source <> 'src1'")
def _(spark, sf):
    return _lookups(spark, sf)[1].select("arxiv_id", "status", "cache_hit")


@query("p18_cloned", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'discarded' WHEN regexp_matches(source, '[13579]$') THEN 'published' WHEN regexp_matches(source, '[0-4]$') THEN 'unpublished' ELSE 'error' END AS status FROM documents WHERE source IS NOT NULL")
def _(spark, sf):
    return acquire.cloned(*_lookups(spark, sf)).select("doc_id", "status")


@query("j2_published", "SELECT doc_id FROM documents WHERE source <> 'src1' AND regexp_matches(source, '[13579]$')")
def _(spark, sf):
    return acquire.published(acquire.cloned(*_lookups(spark, sf))).select("doc_id")


@query("a7_lookup_usage", "SELECT count(*) AS sample_count, count(DISTINCT user_id) AS papers_with_usage, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS input_tokens, CAST(count(*) AS BIGINT) AS output_tokens FROM events WHERE event_type <> 'view' AND value < 100")
def _(spark, sf):
    e = table(spark, sf, "events")
    s = e.select(F.col("user_id").cast("string").alias("arxiv_id"), (F.col("event_type") == "view").alias("cache_hit"), F.when(F.col("value") < 100, F.col("event_id")).alias("input_tokens"), F.when(F.col("value") < 100, F.lit(1)).cast("long").alias("output_tokens"))
    return acquire.lookup_usage(s)


@query("m16_cached_outputs", "SELECT event_id, CASE WHEN user_id IN (SELECT item_id FROM benchmark) THEN 'o' END AS output, user_id IN (SELECT item_id FROM benchmark) AS from_cache FROM events")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("cache_key"), F.lit("o").alias("output"))
    return acquire.cached_outputs(table(spark, sf, "events").select("event_id", F.col("user_id").alias("cache_key")), b).select("event_id", "output", "from_cache")


@query("p24_first_path", "SELECT event_id, regexp_extract(props, ': ([0-9]+)', 1) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", acquire.first_path(F.col("props"), ["a.b", "k"]).alias("k"))


@query("f15_near_solved", "SELECT CAST(l.doc_id AS VARCHAR) AS uid, CASE WHEN d.n_chars % 8 <> 7 THEN 'tally' WHEN lang <> 'en' THEN 'label' WHEN coalesce(text, '') = '' THEN 'blank statement' END AS problem FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE NOT (d.n_chars % 8 = 7 AND lang = 'en' AND coalesce(text, '') <> '')")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("uid"), (F.col("n_chars") % 8).alias("n_correct"), F.when(F.col("lang") == "en", "solved").otherwise("band").alias("label"), F.col("text").alias("statement"))
    return acquire.near_solved(d, table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("uid")))[1]


@query("a25_flag_counts", "SELECT flag, count(*) AS records FROM (SELECT unnest(list_filter([CASE WHEN toxic = 1 THEN 'answer_mismatch' END, CASE WHEN quality = 0 THEN 'degenerate_candidate' END], lambda x: x IS NOT NULL)) AS flag FROM labels) GROUP BY flag")
def _(spark, sf):
    lab = table(spark, sf, "labels")
    flags = acquire.review_flags(F.col("quality") == 0, F.when(F.col("toxic") == 1, "mismatch").otherwise("match"))
    return acquire.flag_counts(lab.select(flags.alias("review_flags")))


@query("x32_judge_score", with_("sa") + "SELECT uid, round(CASE WHEN count(*) FILTER (verdict = 'pass') > 2 THEN count(*) FILTER (verdict = 'pass') / count(*) ELSE 0.5 END, 6) AS score FROM sa GROUP BY uid")
def _(spark, sf):
    s = S.samples(spark, sf).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "pass").alias("p"))
    status = F.when(F.col("p") > 2, "pass").otherwise("defer")
    return s.select("uid", F.round(acquire.judge_score(status, F.col("p"), F.col("n")), 6).alias("score"))


@query("r69_handoff_matches", "SELECT l.k, (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE l.k = 0 OR quality = 1 EXCEPT SELECT doc_id FROM labels)) + (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM labels WHERE l.k = 0 OR quality = 1)) = 0 AS same FROM (SELECT unnest([0, 1]) AS k) l")
def _(spark, sf):
    d = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("uid"), "quality")
    runs = [acquire.handoff_matches(d if k == 0 else d.where("quality = 1"), d).select(F.lit(k).alias("k"), "same") for k in (0, 1)]
    return runs[0].unionByName(runs[1])


@query("s10_ids_for", "SELECT doc_id FROM documents WHERE lang = 'fr' AND source LIKE 'src1%' ORDER BY doc_id")
def _(spark, sf):
    index = table(spark, sf, "documents").select(F.concat("source", F.lit("."), F.col("doc_id").cast("string")).alias("arxiv_id"), F.array("lang").alias("categories"), F.col("lang").alias("primary_category"))
    return spans.ids_for(index, "fr", "src1").select(F.substring_index("arxiv_id", ".", -1).cast("long").alias("doc_id"))


# --- flagship ------------------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: identity, quarantine, first statement kept, gate, scores, labels; counts by label and outcome."""
    kept = normalise.quarantine(S.records(spark, sf_dir), "doc_id").where("quarantine_reason is null and not duplicate")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "well_posed").otherwise("ill_posed").alias("a"), F.when(F.col("toxic") == 0, "well_posed").otherwise("ill_posed").alias("b"))
    votes = labels.select(F.col("doc_id").alias("uid"), F.inline(F.array(F.struct(F.lit("a").alias("combo"), F.col("a").alias("status")), F.struct(F.lit("b").alias("combo"), F.col("b").alias("status")))))
    gate = verdicts.combine(votes, ["a", "b"], "intersect").select(F.col("uid").alias("doc_id"), F.col("status").alias("gate"))
    scores = _tally(spark, sf_dir).select(F.col("uid").cast("long").alias("doc_id"), "label")
    joined = kept.join(gate, "doc_id", "left").join(scores, "doc_id", "left")
    cited = F.concat("statement", F.when(F.col("doc_id") % 7 == 0, " \\cite{a}").otherwise(""))
    hits = F.size(text.structural_hits(cited)) > 0
    return joined.groupBy(F.coalesce("gate", F.lit("error")).alias("gate"), F.coalesce("label", F.lit("other")).alias("label"), hits.alias("cites")).agg(F.count(F.lit(1)).alias("records"))


query(
    "flagship",
    with_("rec", "ro", "ta") + """, k AS (SELECT doc_id, statement FROM rec WHERE coalesce(statement, '') <> '' QUALIFY row_number() OVER (PARTITION BY dk ORDER BY doc_id) = 1)
SELECT CASE WHEN l.doc_id IS NULL THEN 'error' WHEN quality = 1 AND toxic = 0 THEN 'well_posed' ELSE 'ill_posed' END AS gate, coalesce(label, 'other') AS label,
regexp_matches(statement || CASE WHEN k.doc_id % 7 = 0 THEN ' \\cite{a}' ELSE '' END, '\\\\(?:eqref|ref|cref|Cref|autoref|vref|pageref|labelcref|cite|citep|citet|citeauthor|citeyear|label)\\s*\\{') AS cites, count(*) AS records
FROM k LEFT JOIN labels l ON k.doc_id = l.doc_id LEFT JOIN ta ON ta.uid = CAST(k.doc_id AS VARCHAR) GROUP BY 1, 2, 3""",
)(flagship)

from . import more  # noqa: E402, F401  registers its queries
