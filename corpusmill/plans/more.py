"""Further registered queries: readers, scanners and guards over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import latex, text, verify
from ..operators import acquire, dedupe, normalise, report, spans, splits, training, verdicts
from ..sources import archives, lines
from . import builds
from . import standins as S
from .catalog import query
from .standins import WS, table, with_


def _raw(spark, sf) -> DataFrame:
    """Raw rows as readers meet them: blank and absent fields, answers as a list, a JSON list or one string."""
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(n % 3 != 0, F.col("source")).alias("source"), F.when(n % 3 == 0, F.lit("set")).alias("dataset"),
        F.when(n % 2 == 0, F.lit("")).otherwise(F.col("text")).alias("statement"), F.col("text").alias("problem"), F.col("text").alias("question"),
        F.when(n % 4 == 0, "Computed").when(n % 4 == 1, " extracted ").when(n % 4 == 2, "other").alias("provenance"),
        F.when(n % 5 == 0, '["a", "", "b", 3]').when(n % 5 == 1, "plain").when(n % 5 == 2, "[broken").when(n % 5 == 3, " ").alias("truth_strings"),
        F.when(n % 2 == 0, F.lit("t")).alias("truth"), F.lit("t").alias("answer"), F.concat(F.lit("g"), (n % 3).cast("string")).alias("gold_answer"),
        F.when(n % 4 == 0, '{"k": 1}').when(n % 4 == 1, "[1]").alias("params"), F.lit('{"d": 2}').alias("detail"), F.when(n % 3 == 1, "fam").otherwise("").alias("family"),
        (n % 9).cast("string").alias("correct"), (n % 4).cast("string").alias("wrong_complete"), F.when(n % 6 == 0, "0.5").alias("pass_rate"), F.lit("Trusted").alias("truth_policy"),
    )


_FIRST = "coalesce(CASE WHEN doc_id % 3 <> 0 THEN source END, 'set')"


@query("p13_first_judge", f"SELECT doc_id, substr(sha256({_FIRST} || chr(31) || text), 1, 32) AS uid, {_FIRST} AS source, CASE WHEN doc_id % 4 = 0 THEN 'computed' ELSE 'unknown' END AS provenance, 'trusted' AS truth_policy FROM documents WHERE text <> ''")
def _(spark, sf):
    out = normalise.first_judge_rows(_raw(spark, sf).where("problem <> ''").withColumn("tier", F.col("doc_id")))
    return out.select(F.col("tier").cast("long").alias("doc_id"), "uid", "source", "provenance", "truth_policy")


_N2 = "(doc_id % 9 + doc_id % 4)"


@query(
    "p14_second_judge",
    f"""SELECT doc_id, substr(sha1(coalesce(CASE WHEN doc_id % 3 <> 0 THEN source END, 'file') || chr(0) || text), 1, 12) AS uid,
CASE WHEN doc_id % 4 = 0 THEN 'computed' WHEN doc_id % 4 = 1 THEN 'extracted' ELSE 'unknown' END AS provenance, CAST(doc_id % 9 AS INTEGER) AS n_correct, CAST(doc_id % 4 AS INTEGER) AS n_wrong,
CASE WHEN doc_id % 6 = 0 THEN 0.5 WHEN {_N2} > 0 THEN round((doc_id % 9) / {_N2}, 6) END AS pass_at_k FROM documents WHERE text <> ''""",
)
def _(spark, sf):
    out = normalise.second_judge_rows(_raw(spark, sf).where("problem <> ''").withColumn("tier", F.col("doc_id")), "file")
    return out.select(F.col("tier").cast("long").alias("doc_id"), "uid", "provenance", "n_correct", "n_wrong", "pass_at_k")


@query("r43_truths", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'a|b|3' WHEN doc_id % 5 = 1 THEN 'plain' WHEN doc_id % 5 = 2 THEN '[broken' ELSE 't|g' || (doc_id % 3) END AS truths FROM documents")
def _(spark, sf):
    raw = _raw(spark, sf)
    return raw.select("doc_id", F.array_join(normalise.truths(raw), "|").alias("truths"))


@query("r44_params", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{\"k\": 1}' WHEN doc_id % 3 = 1 THEN '{\"d\": 2}' END AS params FROM documents")
def _(spark, sf):
    raw = _raw(spark, sf)
    return raw.select("doc_id", normalise.params(raw, F.nullif("family", F.lit(""))).alias("params"))


@query("r41_provenance", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'computed' WHEN doc_id % 4 = 1 THEN 'extracted' ELSE 'unknown' END AS provenance FROM documents")
def _(spark, sf):
    raw = _raw(spark, sf)
    return raw.select("doc_id", normalise.stated_provenance(raw).alias("provenance"))


@query("p10_inject_uid", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE substr(sha256(coalesce(source, '') || chr(31) || coalesce(text, '')), 1, 32) END AS uid FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("question"), F.when(F.col("doc_id") % 2 == 0, "own").otherwise("").alias("uid"))
    return normalise.inject_uid(d).select("doc_id", "uid")


@query("p9_canonical", with_("fx") + "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'computed' ELSE 'extracted' END AS provenance, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'x' END AS answer, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN lang <> 'x' THEN lang END AS truth, len([1 FOR p IN [doc_id % 5 = 0] IF p]) AS warned FROM fx")
def _(spark, sf):
    n = F.col("doc_id")
    d = S.statements(spark, sf).select(F.col("text").alias("statement"), F.when(n % 2 == 0, "g").alias("generated"), F.when(n % 3 != 0, "x").alias("answer"), F.col("lang").alias("truth"), F.when(n % 5 != 0, "2301.00001").alias("arxiv_id"), n.cast("string").alias("family"))
    out = normalise.canonical(d, "s", ["a", "b"])
    return out.select(F.col("family").cast("long").alias("doc_id"), "provenance", "answer", "truth", F.size("warnings").cast("long").alias("warned"))


def _lines(spark, sf) -> DataFrame:
    n = F.col("doc_id")
    body = F.when(n % 7 == 0, "{broken").when(n % 7 == 1, "  ").otherwise(F.to_json(F.struct(F.col("doc_id").alias("id"), "lang")))
    return table(spark, sf, "documents").select(F.lit("f").alias("path"), n.alias("line_no"), body.alias("line"), F.lit(True).alias("terminated"), F.lit(False).alias("is_last"))


@query("s2_parse", "SELECT doc_id AS line_no, doc_id AS id, lang FROM documents WHERE doc_id % 7 > 1")
def _(spark, sf):
    return lines.parse(_lines(spark, sf), "id long, lang string", "skip").select("line_no", "id", "lang")


@query("s4_broken_files", "SELECT min(doc_id) AS line_no FROM documents WHERE doc_id % 7 = 0")
def _(spark, sf):
    return lines.broken_files(_lines(spark, sf)).select("line_no")


@query("x2_boxed", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '{' || lang || '} y' ELSE 'open ' || lang END AS boxed FROM documents")
def _(spark, sf):
    n = F.col("doc_id") % 3
    t = F.when(n == 0, F.col("text")).when(n == 1, F.concat("text", F.lit("\\boxed{a} \\boxed{{"), "lang", F.lit("} y} z"))).otherwise(F.concat("text", F.lit("\\boxed{open "), "lang"))
    return table(spark, sf, "documents").select("doc_id", text.extract_boxed(t).alias("boxed"))


@query("x10_answer_form", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'tuple' WHEN 2 THEN 'expr' WHEN 3 THEN 'latex' END AS form FROM documents")
def _(spark, sf):
    n = F.col("doc_id")
    s = n.cast("string")
    answer = F.when(n % 5 == 0, F.concat(F.lit("-"), s, F.lit(".5"))).when(n % 5 == 1, F.concat(F.lit("("), s, F.lit(", 2)"))).when(n % 5 == 2, F.concat(F.lit("x^2 + "), s)).when(n % 5 == 3, F.concat(F.lit("\\oint_"), s)).otherwise("")
    return table(spark, sf, "documents").select("doc_id", verify.answer_form(answer).alias("form"))


@query("x5_tiers", "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'piecewise' WHEN 2 THEN 'multi' WHEN 3 THEN 'tuple' WHEN 4 THEN 'number' WHEN 5 THEN 'expr' WHEN 6 THEN 'prose' ELSE 'reject' END AS tier FROM documents")
def _(spark, sf):
    n, s = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    kinds = ["$ $", "\\begin{cases} 1 \\end{cases}", "(a) 1 (b) 2", "(1, 2/3)", "$\\frac{1}{2}$", "$y = x^2$"]
    answer = F.when(n == 6, F.concat(F.lit("The value in "), "lang")).when(n == 7, F.concat(F.lit("\\oint "), s))
    for k, v in enumerate(kinds):
        answer = answer.when(n == k, v)
    return table(spark, sf, "documents").select("doc_id", verify.truth_tier(answer).alias("tier"))


@query("x11_looks_like_math", with_("fx") + "SELECT doc_id, regexp_matches(text, '[\\\\_^{}=]') AS math FROM fx")
def _(spark, sf):
    return S.statements(spark, sf).select("doc_id", text.looks_like_math(F.col("text")).alias("math"))


@query("x22_degeneracy", f"SELECT doc_id, CASE WHEN doc_id % {len(S.PHRASES)} = 9 THEN 'answer_in_statement|defined_then_asked' ELSE '' END AS hits FROM documents")
def _(spark, sf):
    hits = text.degeneracy_hits(F.col("text"), F.lit("x + 12345678"))
    return S.statements(spark, sf).select("doc_id", F.array_join(F.transform(hits, lambda h: h["pattern"]), "|").alias("hits"))


@query("x24_answer_consistency", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' ELSE 'unknown' END AS how FROM documents")
def _(spark, sf):
    n = F.col("doc_id") % 3
    derived = F.when(n == 0, F.array(F.lit("$x + 1$"))).when(n == 1, F.array(F.lit("y"))).otherwise(F.array(F.lit(" ")))
    return table(spark, sf, "documents").select("doc_id", text.answer_consistency(derived, F.lit("x+1")).alias("how"))


@query("x31_repaired_reply", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"r\": \"\\\\alpha ' || doc_id || '\"}' END AS reply FROM documents")
def _(spark, sf):
    n = F.col("doc_id").cast("string")
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('So {"r": "\\alpha '), n, F.lit('"}.'))).otherwise(F.concat(F.lit("{no "), n))
    return table(spark, sf, "documents").select("doc_id", text.judge_reply_repaired(reply).alias("reply"))


@query("x33_tiered_status", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN 'pass' ELSE 'flag' END AS off, CASE WHEN doc_id % 4 = 0 THEN 'pass' WHEN lang = 'en' THEN 'flag' ELSE 'defer' END AS always FROM documents")
def _(spark, sf):
    n = F.col("doc_id")
    own = verdicts.self_contained(F.when(n % 4 == 0, "manual").otherwise("extracted"), F.lit("trusted"))
    status = lambda judge: verdicts.tiered_status(own, n % 3, F.when(F.col("lang") == "en", "flag"), judge)
    return table(spark, sf, "documents").select("doc_id", status("off").alias("off"), status("always").alias("always"))


@query("x34_record_status", with_("fx") + "SELECT doc_id, CASE WHEN doc_id % 12 = 3 THEN 'flag' WHEN doc_id % 5 = 0 THEN 'pass' WHEN lang = 'en' THEN 'pass' ELSE 'defer' END AS status FROM fx")
def _(spark, sf):
    status = verdicts.record_status(text.structural_hits(F.col("text")), F.col("doc_id") % 5 == 0, F.when(F.col("lang") == "en", "pass"), F.col("text"))
    return S.statements(spark, sf).select("doc_id", status.alias("status"))


@query("x35_word_ngrams", "WITH w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '" + WS + "', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS ws FROM conversations) SELECT conv_id, turn, CAST(CASE WHEN len(ws) >= 6 THEN len(list_distinct(list_transform(range(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 5], ' ')))) ELSE 0 END AS INTEGER) AS grams FROM w")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(text.word_ngrams(F.col("text"))).alias("grams"))


@query("x39_leading_think", "SELECT doc_id, text AS t FROM documents WHERE NOT regexp_matches(text, '^\\s')")
def _(spark, sf):
    d = table(spark, sf, "documents").where(~F.col("text").rlike(r"^\s"))
    return d.select("doc_id", text.leading_think(F.concat(F.lit(" <think>a\nb</think>\n"), "text")).alias("t"))


@query("x42_guess_number", "SELECT doc_id, nullif(regexp_extract(text, '[0-9]+(?:\\.[0-9]+)*', 0), '') AS n FROM fx".replace("fx", "(SELECT doc_id, text || ' Theorem 2.' || doc_id || '.1' AS text FROM documents)"))
def _(spark, sf):
    t = F.concat("text", F.lit(" Theorem 2."), F.col("doc_id").cast("string"), F.lit(".1"))
    return table(spark, sf, "documents").select("doc_id", text.guess_number(t).alias("n"))


@query("x36_id_key", "SELECT o_orderkey, lpad(CAST(o_orderkey % 12 + 2301 AS VARCHAR), 4, '0') AS yymm, CAST(o_orderkey AS INTEGER) AS n, length(CAST(o_orderkey AS VARCHAR)) IN (5, 6) AS new_style FROM orders")
def _(spark, sf):
    o = F.col("o_orderkey")
    ident = F.concat(F.lpad((o % 12 + 2301).cast("string"), 4, "0"), F.lit("."), o.cast("string"))
    key = spans.id_key(ident)
    return table(spark, sf, "orders").select("o_orderkey", key["yymm"].alias("yymm"), key["n"].alias("n"), spans.is_new_style(ident).alias("new_style"))


@query("j29_resolve_refs", "SELECT doc_id, label, CASE WHEN label = 'a1' THEN left(trim(regexp_replace(text, '" + WS + "', ' ', 'g'), ' '), 600) END AS content FROM documents, (SELECT unnest(['a1', 'zz']) AS label) WHERE text IS NOT NULL AND trim(regexp_replace(text, '" + WS + "', ' ', 'g'), ' ') <> ''")
def _(spark, sf):
    d = table(spark, sf, "documents").where("trim(text) <> ''")
    papers = d.select(F.col("doc_id").cast("string").alias("arxiv_id"), F.concat(F.lit("\\begin{equation}\\label{a1} "), "text", F.lit("\n\\end{equation}")).alias("tex"))
    proofs = d.select(F.col("doc_id").cast("string").alias("uid"), F.col("doc_id").cast("string").alias("arxiv_id"), F.concat("text", F.lit(" by \\ref{a1, zz}")).alias("body_raw"))
    return latex.resolve_refs(proofs, papers).select(F.col("uid").cast("long").alias("doc_id"), "label", "content")


@query("x14_label_index", "SELECT doc_id, 'a1' AS label, left(trim(regexp_replace(text, '" + WS + "', ' ', 'g'), ' '), 600) AS content FROM documents WHERE text <> ''")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text <> ''")
    papers = d.select(F.col("doc_id").cast("string").alias("arxiv_id"), F.concat(F.lit("\\begin{align*}\\label{a1} "), "text", F.lit("\\end{align*}\\begin{align}\\label{a1} second \\end{align}")).alias("tex"))
    return latex.label_index(papers).select(F.col("arxiv_id").cast("long").alias("doc_id"), "label", "content")


@query("x16_proof_envs", "SELECT doc_id, CAST(7 AS INTEGER) AS start, 'Proof of [' || lang || ']' AS opt_arg, text AS body_raw FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    tex = F.concat(F.lit("before "), F.lit("\\begin{proof}\n[Proof of ["), "lang", F.lit("]]"), "text", F.lit("\\end{proof}"))
    return d.select("doc_id", F.explode(latex.proof_envs(tex)).alias("e")).select("doc_id", "e.start", "e.opt_arg", "e.body_raw")


@query("j19_locate", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'ref_stripped' END AS method, doc_id % 3 < 2 AND false AS ambiguous FROM documents WHERE text IS NOT NULL AND doc_id % 3 < 2 AND regexp_matches(text, '[a-z]') UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 2 AND regexp_matches(text, '[a-z]')")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").where(F.col("text").rlike("[a-z]"))
    n = F.col("doc_id") % 3
    body = F.when(n == 1, F.concat(F.lit("By \\ref{q} "), "text")).when(n == 0, F.col("text")).otherwise("0 1 2 3")
    papers = d.select(F.col("doc_id").cast("string").alias("arxiv_id"), F.concat(F.lit("\\begin{lemma} "), body, F.lit(" \\end{lemma}")).alias("tex"))
    asked = F.when(n == 1, F.concat(F.lit("By "), "text")).when(n == 0, F.col("text")).otherwise("####")
    records = d.select(F.col("doc_id").cast("string").alias("uid"), F.col("doc_id").cast("string").alias("arxiv_id"), asked.alias("source_statement"))
    return latex.locate_theorems(papers, records).select(F.col("uid").cast("long").alias("doc_id"), "method", "ambiguous")


@query("o4_ids_in_scope", "SELECT arxiv_id FROM (SELECT DISTINCT lpad(CAST(2300 + doc_id % 12 + 1 AS VARCHAR), 4, '0') || '.' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS arxiv_id, doc_id % 12 + 1 AS m FROM documents WHERE lang = 'fr' AND doc_id % 12 + 1 IN (3, 5, 8)) ORDER BY CASE m WHEN 5 THEN 0 WHEN 3 THEN 1 ELSE 2 END, arxiv_id LIMIT 25")
def _(spark, sf):
    n = F.col("doc_id")
    ident = F.concat(F.lpad((n % 12 + 2301).cast("string"), 4, "0"), F.lit("."), F.lpad(n.cast("string"), 6, "0"))
    index = table(spark, sf, "documents").select(ident.alias("arxiv_id"), F.array("lang").alias("categories"), F.col("lang").alias("primary_category"))
    chunks = spark.range(4).select(F.element_at(F.array(F.lit("2305"), F.lit("2303"), F.lit("2305"), F.lit("2308")), (F.col("id") + 1).cast("int")).alias("yymm"), F.col("id").alias("ordinal"))
    return spans.ids_in_scope(index, chunks, "fr", most=25)


@query("f6_slice_rows", with_("ro", "ta") + "SELECT uid FROM ta WHERE label = 'band'")
def _(spark, sf):
    from .catalog import _tally

    named = _tally(spark, sf).withColumn("eval_slice", F.when(F.col("label") == "band", "eval_band").otherwise("other"))
    return splits.slice_uids(named, "eval_band")


@query("p22_hinted_rows", "SELECT item_id AS uid, text AS asked, CAST(item_id % 3 AS INTEGER) AS k_tried FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    outputs = b.select(F.col("item_id").alias("uid"), F.col("text").alias("question"), F.lit("o").alias("output"), F.lit("sha").alias("proof_raw_sha"), F.lit(0).alias("sample_idx"), (F.col("item_id") % 3).cast("int").alias("k_tried"), F.lit("band").alias("source_tier"), F.lit(None).cast("string").alias("arxiv_id"))
    rows = training.hinted_rows(outputs, "You solve problems.")
    return rows.select("provenance.uid", F.col("prompt")[1]["content"].alias("asked"), F.col("provenance.verify_receipt.k_tried").alias("k_tried"))


@query("p27_folded", with_("ro", "ta") + "SELECT uid, 'b14' AS source_batch, label, n_correct, 'final' AS status FROM ta")
def _(spark, sf):
    from .catalog import _tally

    rows = training.folded(_tally(spark, sf).withColumn("statement", F.lit("s")), "b14", "gate", "f.jsonl")
    return rows.select("uid", "source_batch", "pass_at_k_results.label", "pass_at_k_results.n_correct", "pass_at_k_results.status")


@query("a28_census", "SELECT place, stage, rows FROM (SELECT 0 AS place, 'english' AS stage, count(*) FILTER (lang = 'en') AS rows FROM documents UNION ALL SELECT 1, 'long', count(*) FILTER (lang = 'en' AND n_chars > 500) FROM documents UNION ALL SELECT 2, 'odd', count(*) FILTER (lang = 'en' AND n_chars > 500 AND doc_id % 2 = 1) FROM documents)")
def _(spark, sf):
    return training.census(table(spark, sf, "documents"), [("english", F.col("lang") == "en"), ("long", F.col("n_chars") > 500), ("odd", F.col("doc_id") % 2 == 1)])


@query("g4_not_verbatim", with_("ro") + "SELECT uid, rollout_uid FROM ro JOIN customer ON uid = CAST(c_custkey AS VARCHAR) WHERE verdict = 'correct' AND candidate = 'view'")
def _(spark, sf):
    from .catalog import _chat

    changed = S.rollouts(spark, sf).withColumn("output", F.when(F.col("candidate") == "view", "other").otherwise(F.col("candidate")))
    return training.not_verbatim(_chat(spark, sf), changed).select("uid", "rollout_uid")


@query("g15_weights_format", "SELECT count(*) AS rows, count(CASE WHEN event_id % 2 = 0 THEN 1 END) AS weighted, count(*) FILTER (event_id % 10 = 0) AS bad FROM events")
def _(spark, sf):
    n = F.col("event_id")
    return training.weights_format(table(spark, sf, "events").select(F.when(n % 10 == 0, 0.0).when(n % 2 == 0, 0.5).alias("weight")))


@query("p25_flat_provenance", "SELECT CAST(event_id AS VARCHAR) AS uid, CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END AS rollout_uid FROM events")
def _(spark, sf):
    n = F.col("event_id")
    e = table(spark, sf, "events").select(n.cast("string").alias("uid"), F.lit("out").alias("rollout_uid"), F.struct(n.cast("string").alias("uid"), F.when(n % 2 == 0, "in").alias("rollout_uid")).alias("provenance"))
    return training.flat_provenance(e).select("uid", "rollout_uid")


@query("u7_duplicate_counts", "SELECT sha256(text) AS h, count(*) AS rows FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def _(spark, sf):
    return dedupe.duplicate_counts(table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("h")), ["h"])


@query("j32_uid_leaks", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"))
    return splits.uid_leaks(d, table(spark, sf, "benchmark").select(F.col("item_id").alias("uid"))).select(F.col("uid").alias("doc_id"))


@query("r21_lookup_misses", "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')")
def _(spark, sf):
    status = F.when(F.col("event_type") == "click", "published").when(F.col("event_type") == "view", "discarded").otherwise("error")
    return acquire.lookup_misses(table(spark, sf, "events").select("event_id", status.alias("status"))).select("event_id")


@query("j12_missing_uids", "SELECT DISTINCT user_id AS uid FROM events WHERE user_id NOT IN (SELECT item_id FROM benchmark) OR user_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    u = table(spark, sf, "events").select(F.col("user_id").alias("uid"))
    scores = lambda t, c: table(spark, sf, t).select(F.col(c).alias("uid"), F.lit(1).alias("n_correct"))
    return report.missing_uids(u, scores("benchmark", "item_id"), scores("labels", "doc_id"))


@query("a30_sign_test", "SELECT wins, 2 - wins AS losses, CASE wins WHEN 1 THEN 1.0 ELSE 0.5 END AS p FROM (SELECT unnest([0, 1, 2]) AS wins)")
def _(spark, sf):
    return spark.range(3).select(F.col("id").cast("int").alias("wins"), (2 - F.col("id")).cast("int").alias("losses"), report.mcnemar_exact("id", 2 - F.col("id")).alias("p"))


@query("x37_member_id", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2301.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') WHEN 1 THEN NULL ELSE '2302.' || lpad(CAST(doc_id AS VARCHAR), 6, '0') END AS arxiv_id FROM documents")
def _(spark, sf):
    n = F.col("doc_id")
    name = F.when(n % 3 == 0, F.concat(F.lit("2301/2301."), F.lpad(n.cast("string"), 5, "0"), F.lit(".gz"))).when(n % 3 == 1, F.concat(F.lit("2301/readme"), n.cast("string"))).otherwise(F.concat(F.lit("2302."), F.lpad(n.cast("string"), 6, "0"), F.lit(".pdf")))

    @F.pandas_udf("string")
    def named(names):
        return names.map(archives.member_id)

    return table(spark, sf, "documents").select("doc_id", named(name).alias("arxiv_id"))


# --- guarded builds ------------------------------------------------------------------------------------------------------


def _corpus(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Records with their tallies and listed rollouts, and the rollouts as files: one of its own for each third of the records, and one that lacks some."""
    from .catalog import _tally

    r = S.rollouts(spark, sf).withColumn("output", F.concat(F.lit("answer "), "candidate"))
    u = F.col("uid").cast("long")
    lists = r.groupBy("uid").agg(F.collect_list("rollout_uid").alias("rollout_uids"))
    corpus = _tally(spark, sf).join(lists, "uid").select("uid", F.concat(F.lit("Statement of record "), "uid").alias("statement"), F.concat(F.lit("p"), (u % 40).cast("string")).alias("arxiv_id"), "rollout_uids", F.concat(F.lit("f"), (u % 3).cast("string")).alias("routed"), "n_correct", "n_wrong", "n_degenerate")
    files = r.withColumn("file", F.concat(F.lit("f"), (u % 3).cast("string")))
    return corpus, files.unionByName(r.where("sample_idx % 2 = 0").withColumn("file", F.lit("other")))


def _evaluation(spark) -> builds.Evaluation:
    papers = spark.range(15).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("arxiv_id"))
    return builds.Evaluation(papers, spark.range(1).select(F.lit("none").alias("uid")), spark.range(1).select(F.lit("A statement of the evaluation").alias("statement")))


def _built(spark, sf) -> DataFrame:
    corpus, files = _corpus(spark, sf)
    chosen = corpus.where("n_correct > 0 and cast(uid as bigint) % 40 >= 15 and cast(uid as bigint) % 2 = 0").select("uid")
    return builds.build(corpus, files, chosen, chosen.limit(0), _evaluation(spark), "You solve problems.", "capk", 3, 7)


_BUILT = "b AS (SELECT ro.uid, rollout_uid FROM ro WHERE verdict = 'correct' AND CAST(uid AS BIGINT) % 40 >= 15 AND CAST(uid AS BIGINT) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY sha256('7:' || uid || ':' || rollout_uid)) <= 3)"


@query("r56_build", with_("ro") + f", {_BUILT} SELECT uid, rollout_uid, 'Statement of record ' || uid AS asked FROM b")
def _(spark, sf):
    return _built(spark, sf).select("uid", "rollout_uid", F.col("prompt")[1]["content"].alias("asked"))


@query("r55_manifest", with_("ro") + f", {_BUILT} SELECT count(*) AS rows, count(DISTINCT uid) AS uids, count(DISTINCT CAST(uid AS BIGINT) % 40) AS papers, 'capk' AS policy FROM b")
def _(spark, sf):
    return builds.manifest(_built(spark, sf), "capk", 7).select("rows", "uids", "papers", "policy")


@query("g8_harvest_problems", with_("ro", "ta") + "SELECT uid, CASE WHEN CAST(uid AS BIGINT) % 5 = 0 THEN 'no file accounts for it' WHEN CAST(uid AS BIGINT) % 5 = 1 THEN 'tallies differ' WHEN n_correct = 0 THEN 'no correct rollout' WHEN CAST(uid AS BIGINT) % 5 = 2 THEN 'an empty output' END AS problem FROM ta WHERE CAST(uid AS BIGINT) % 5 < 3 OR n_correct = 0")
def _(spark, sf):
    corpus, files = _corpus(spark, sf)
    u = F.col("uid").cast("long")
    records = corpus.withColumn("n_wrong", F.when(u % 5 == 1, F.col("n_wrong") + 1).otherwise(F.col("n_wrong")))
    routed = corpus.select("uid", F.when(u % 5 != 0, F.col("routed")).alias("file"))
    return builds.harvest_problems(records, routed, files.withColumn("output", F.when(u % 5 != 2, F.col("output")).otherwise("")))


@query(
    "r66_written_problems",
    with_("ro") + """, g AS (SELECT CAST(uid AS BIGINT) % 10 AS m, CAST(uid AS BIGINT) AS k, uid, rollout_uid FROM ro JOIN customer ON uid = CAST(c_custkey AS VARCHAR) WHERE verdict = 'correct')
SELECT 'malformed' AS guard, count(*) AS rows FROM g WHERE m BETWEEN 2 AND 4 UNION ALL SELECT 'not verified', count(*) FROM g WHERE m < 2 UNION ALL
SELECT 'evaluation paper', 0 UNION ALL SELECT 'evaluation uid', count(*) FROM g WHERE uid IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark) UNION ALL
SELECT 'evaluation statement', count(*) FROM g JOIN customer ON k = c_custkey WHERE k IN (SELECT item_id FROM benchmark) UNION ALL SELECT 'repeated rollout', 0 UNION ALL
SELECT 'weights', count(*) FROM (SELECT uid FROM g GROUP BY uid HAVING count(*) > 5)""",
)
def _(spark, sf):
    from .catalog import _bad_chat

    ids = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("uid"))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_name").alias("statement")).join(ids, "uid").select("statement")
    e = builds.Evaluation(spark.range(1).select(F.lit("no paper").alias("arxiv_id")), ids, asked)
    return builds.written_problems(_bad_chat(spark, sf), e, "capk", 5)


@query("r64_hinted_build", "SELECT CAST(item_id AS VARCHAR) AS uid, 'hinted' AS lane FROM benchmark UNION ALL SELECT uid, 'anchor' FROM (SELECT CAST(c_custkey AS VARCHAR) AS uid FROM customer WHERE c_custkey NOT IN (SELECT item_id FROM benchmark) ORDER BY sha256('a:' || CAST(c_custkey AS VARCHAR)), 1 LIMIT 20)")
def _(spark, sf):
    from .catalog import training as t

    b = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("uid"), F.col("text").alias("question"))
    verified = b.select("*", F.lit("o").alias("output"), F.lit("sha").alias("proof_raw_sha"), F.lit(0).alias("sample_idx"), F.lit(1).alias("k_tried"), F.lit("p99").alias("arxiv_id"))
    name = lambda role, c: F.array(t.message(role, c))
    anchors = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uid"), name("user", F.col("c_name")).alias("prompt"), name("assistant", F.lit("done")).alias("completion"), F.lit("p99").alias("arxiv_id"))
    rows = builds.hinted_build(verified, b, b.select("uid", F.lit("solved").alias("label")), anchors, 20, _evaluation(spark), "You solve problems.", "a", "HINT:")
    return rows.select("uid", "lane")


@query("g14_bundle_problems", "SELECT uid, problem FROM (SELECT CAST(item_id AS VARCHAR) AS uid, CASE WHEN item_id % 4 = 0 THEN 'a blank field' WHEN item_id % 4 = 1 THEN 'no hint' WHEN item_id % 4 = 2 THEN 'repeated' END AS problem FROM benchmark) WHERE problem IS NOT NULL")
def _(spark, sf):
    n = F.col("item_id") % 4
    rows = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("uid"), F.col("text").alias("statement"), F.when(n == 0, "  ").otherwise("s").alias("solution"), F.concat("text", F.when(n == 1, "").otherwise(" HINT: s")).alias("prompt"), F.explode(F.when(n == 2, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("sample_idx"))
    return builds.bundle_problems(rows, marker="HINT:")


@query("r51_rollouts_path", "SELECT doc_id, 'runs/' || lang || '/' || doc_id || '/_progress/rollouts.jsonl' AS path FROM documents")
def _(spark, sf):
    source = F.concat(F.lit("runs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/results.jsonl"))
    return table(spark, sf, "documents").select("doc_id", builds.rollouts_path(source).alias("path"))
