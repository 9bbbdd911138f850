import math
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedupe, normalise, report, rollouts, slices, spans, splits, training, verdicts


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_provenance_and_policy(spark):
    df = spark.createDataFrame([(1, "q", "fam", None, None), (2, "q", None, "manual", None), (3, "q", None, "odd", "trusted"), (4, "", "fam", "external", None)], "i int, question string, family string, provenance string, truth_policy string")
    got = normalise.to_records(df, F.lit("s"), ["i"]).orderBy("i").collect()
    assert [(r.provenance, r.truth_policy) for r in got] == [("computed", "trusted"), ("manual", "unknown"), ("extracted", "trusted"), ("external", "unknown")]
    with pytest.raises(ValueError):
        normalise.provenance(df, "odd")


def test_field_precedence(spark):
    df = spark.createDataFrame([("", "Q", "P", "0", "3.7")], "statement string, question string, problem string, truth string, n_correct string")
    r = normalise.to_records(df, F.lit("s"), ["question"]).first()
    assert (r.statement, r.truth_strings, r.n_correct) == ("Q", ["0"], 0)
    assert normalise.apply_column_map(df, {"question": "problem", "tier": "problem"}).first().tier == "P"


def test_quarantined_rows_do_not_shadow(spark):
    df = spark.createDataFrame([(1, "A  b", True), (2, "a B", False), (3, "A B", False), (4, None, False)], "i int, statement string, has_external_refs boolean")
    got = {r.i: (r.quarantine_reason is not None, r.duplicate) for r in normalise.quarantine(df, "i", "strict").collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, True), 4: (True, False)}


def test_modal_wrong_ties(spark):
    for first, second in (("a", "b"), ("b", "a")):
        df = spark.createDataFrame([("u", 0, "correct", None), ("u", 1, "wrong", first), ("u", 2, "wrong", second), ("u", 3, "wrong", None)], "uid string, sample_idx int, verdict string, candidate string")
        r = rollouts.tally(df).first()
        assert (r.modal_wrong, r.top_wrong_share, r.n_wrong, r.label) == (first, 0.25, 3, "band")


def test_null_label_survives(spark):
    df = spark.createDataFrame([("a", None), ("b", "drop"), ("c", "band")], "uid string, label string")
    assert rows(rollouts.solvable(df), "uid") == [("a",), ("c",)]


def test_policies_against_loops(spark):
    rng, combos = random.Random(5), ["a", "b", "c"]
    votes = {u: {c: rng.choice(["well_posed", "ill_posed", "defer", "error"]) for c in combos if rng.random() < 0.8} for u in range(200)}
    df = spark.createDataFrame([(str(u), c, s) for u, v in votes.items() for c, s in v.items()], "uid string, combo string, status string")
    for policy in ("intersect", "union", "majority"):
        want = []
        for u, v in votes.items():
            if not v:
                continue
            n, k = len(v), sum(s == "well_posed" for s in v.values())
            admit = {"intersect": n == k == 3, "union": k > 0, "majority": 2 * k > n}[policy]
            denial = next((s for s in ("ill_posed", "error", "defer") if s in v.values()), "error")
            want.append((str(u), "well_posed" if admit else denial))
        assert rows(verdicts.combine(df, combos, policy), "uid", "status") == sorted(want, key=str)


def test_quorum_overrides_majority(spark):
    df = spark.createDataFrame([("u", i, v, False, None, None) for i, v in enumerate(["error", "error", "pass"])] + [("w", i, "flag", i == 0, None, None) for i in range(3)], "uid string, sample_id int, verdict string, insufficient_context boolean, reason string, derived_answer string")
    assert rows(verdicts.corroborate(df, 2), "uid", "majority", "defer_reason") == [("u", "defer", "judge_errors"), ("w", "flag", None)]


def test_structural_beats_computed_on_one_side_only(spark):
    df = spark.createDataFrame([("\\ref{x} is it",)], "t string")
    from corpusmill.functions import text

    structural = text.structural_hits(F.col("t"))
    assert df.select(verdicts.record_status(structural, F.lit(True), F.lit(None).cast("string"), F.col("t"))).first()[0] == "flag"
    assert df.select(verdicts.tiered_status(F.lit(True), F.lit(3), F.lit(None).cast("string"), "off")).first()[0] == "pass"


def test_capped_against_loop(spark):
    rng = random.Random(2)
    data = [(p, i) for p in range(30) for i in range(rng.randrange(0, 9))]
    df = spark.createDataFrame(data, "p int, i int")
    for cap, target in ((3, 20), (None, 35), (2, 1000)):
        seen, want, done = 0, [], False
        for p in range(30):
            own = [i for q, i in data if q == p]
            for k, i in enumerate(own):
                ok = cap is None or k < cap
                if ok and seen < target:
                    seen += 1
                    want.append((p, i, "candidate"))
                else:
                    want.append((p, i, "dropped" if done else "surplus"))
            done = seen >= target
        assert rows(dedupe.capped(df, "p", "p", "i", cap, target), "p", "i", "outcome") == sorted(want, key=str)


def test_slice_against_loop(spark):
    rng = random.Random(9)
    for size in (3, 6, 50):
        journal = []
        for line in range(40):
            k = rng.randrange(12)
            journal.append((line, f"u{k}", f"s{k}", rng.choice("xy")))
        ledger = [(f"u{k}", f"s{k}", "x", 1, False) for k in range(2)] + [("other", "s2", "x", 1, False), ("u3", "s3", "x", 1, True)]
        by_uid, by_stmt = {u: h for u, s, h, _, w in ledger if not w}, {s for _, s, _, _, w in ledger if not w}
        out, pending = [], {}
        for line, u, s, h in journal:
            if len(pending) == size:
                break
            if s in pending:
                out.append((line, "replay" if pending[s] == h else "uid_conflict", False))
            elif u in by_uid:
                out.append((line, "replay" if by_uid[u] == h else "uid_conflict", False))
            elif s in by_stmt:
                out.append((line, "stmt_conflict", False))
            else:
                pending[s] = h
                out.append((line, "warn" if u == "u3" else "new", True))
        if len(pending) < size:
            out = [(line, v, False) for line, v, _ in out]
        j = spark.createDataFrame(journal, "line_no int, uid string, stmt_key string, content_hash string")
        led = spark.createDataFrame(ledger, "uid string, stmt_key string, content_hash string, journal_line long, warn_only boolean")
        assert rows(slices.cut_slice(j, led, size), "line_no", "verdict", "accepted") == sorted(out, key=str)


def test_slices_where_uids_cross_statements(spark):
    rng = random.Random(3)
    for size in (4, 60):
        journal = [(line, f"u{rng.randrange(9)}", f"s{rng.randrange(9)}", rng.choice("xy")) for line in range(50)]
        ledger = [("u0", "s0", "x", 1, False)]
        uids, stmts, out = {}, set(), []
        for line, u, s, h in journal:
            if len(uids) == size:
                break
            if u == "u0" or s == "s0":
                out.append((line, ("replay" if h == "x" else "uid_conflict") if u == "u0" else "stmt_conflict", False))
            elif u in uids:
                out.append((line, "replay" if uids[u] == h else "uid_conflict", False))
            elif s in stmts:
                out.append((line, "stmt_conflict", False))
            else:
                uids[u] = h
                stmts.add(s)
                out.append((line, "new", True))
        if len(uids) < size:
            out = [(line, v, False) for line, v, _ in out]
        j = spark.createDataFrame(journal, "line_no int, uid string, stmt_key string, content_hash string")
        led = spark.createDataFrame(ledger, "uid string, stmt_key string, content_hash string, journal_line long, warn_only boolean")
        assert rows(slices.cut_slice(j, led, size), "line_no", "verdict", "accepted") == sorted(out, key=str)


@pytest.mark.parametrize("b, c, p", [(0, 0, 1), (1, 9, 22 / 1024), (2, 8, 112 / 1024), (0, 5, 2 / 32), (3, 3, 1), (1, 1, 1)])
def test_mcnemar(b, c, p):
    assert report.mcnemar(b, c) == pytest.approx(p)


def test_mcnemar_of_many_pairs():
    began = time.perf_counter()
    assert report.mcnemar(15_360, 14_220) == pytest.approx(3.511701402840725e-11, rel=1e-14)  # doubles overflow; the sum of all binomials takes a minute and a half
    assert report.mcnemar(256, 237) == min(1.0, 2 * sum(math.comb(493, i) for i in range(238)) / 2**493) and report.mcnemar(15_000, 15_000) == 1
    assert time.perf_counter() - began < 20


def test_paired_report(spark):
    uids = spark.createDataFrame([(f"u{i}", "s") for i in range(6)], "uid string, slice string")
    base = spark.createDataFrame([(f"u{i}", int(i < 2)) for i in range(6)], "uid string, n_correct int")
    tuned = spark.createDataFrame([(f"u{i}", int(i >= 1 and i < 5)) for i in range(6)], "uid string, n_correct int")
    t = report.paired_table(uids, base, tuned, "slice")
    r = t.first()
    assert (r.n_pairs, r.b, r.c, r.base_solved, r.tuned_solved) == (6, 1, 3, 2, 4)
    ci = t.select(report.wald_interval(F.col("b"), F.col("c"), F.col("n_pairs")).alias("w")).first().w
    assert (round(ci.lo, 3), round(ci.hi, 3)) == (-0.263, 0.930)
    assert "0.625" in report.paired_report("T", "now", t, "slice")
    assert rows(report.missing_uids(uids, base.limit(0)), "uid") == [(f"u{i}",) for i in range(6)]


def test_weights_and_guards(spark):
    df = spark.createDataFrame([("u", f"r{i}") for i in range(4)] + [("w", "r9")], "uid string, rollout_uid string")
    assert training.weighted(df, "cap1").count() == 2 and training.weighted(df, "capk", 3).count() == 4
    inverse = training.weighted(df, "inverse")
    assert training.weight_violations(inverse, "inverse").isEmpty() and not training.weight_violations(df, "capk", 3).isEmpty()
    with pytest.raises(ValueError):
        training.draw(df, df.limit(0), 99, "s")
    with pytest.raises(splits.GuardError):
        splits.enforce(df, "rows")
    splits.enforce(df.limit(0), "rows")


def test_prompt_leaks_with_short_statements(spark):
    d = spark.createDataFrame([(1, "xx the whole statement of an evaluation problem yy"), (2, "short abc"), (3, "none"), (4, "")], "i int, prompt string")
    s = spark.createDataFrame([("the whole statement of an evaluation problem",), ("abc",), ("",)], "statement string")
    assert rows(splits.prompt_leaks(d, s), "i") == [(1,), (2,)]


def test_as_of_ties_and_gaps(spark):
    left = spark.createDataFrame([("p", 5), ("p", 9), ("q", 1)], "k string, at int")
    right = spark.createDataFrame([("p", 5, "x"), ("p", 8, "y"), ("q", 0, "z")], "k string, start int, v string")
    assert rows(spans.as_of_forward(left, right, ["k"], "at", "start"), "k", "at", "start", "v") == [("p", 5, 5, "x"), ("p", 9, None, None), ("q", 1, None, None)]


def test_chunks_by_month_and_width(spark):
    m = spark.createDataFrame([("a", "2301", "2301.00001", "2301.00010", 5), ("b", "2301", "2301.99990", "2302.00005", 6), ("c", "2302", "bad", "2302.1", 7)], "filename string, yymm string, first_item string, last_item string, size_bytes long")
    w = spark.createDataFrame([("2302.00001",), ("2301.0005",), ("math/0301001",), ("2301.00010",)], "arxiv_id string")
    assert rows(spans.chunks_for_ids(m, w), "filename") == [("a",), ("b",)]
    assert spans.rollup(m).first().chunk_count == 3 and rows(spans.select_chunks(m, 2023), "filename") == [("a",), ("b",), ("c",)]


def test_acquisition(spark, tmp_path):
    from corpusmill.operators import acquire

    assert (acquire.estimated_calls(100), acquire.estimated_calls(100, "latex"), acquire.estimated_calls(100, "qa")) == (12, 612, 8412)
    m = spark.createDataFrame([("2301", 2500), ("2302", 10)], "yymm string, num_items int")
    assert acquire.bulk_calls(m, 1) == 11 and acquire.bulk_calls(m, 1, "qa", "2302") == 86 and acquire.bulk_calls(None, 1) == 8
    chat = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    assert acquire.dataset_format(chat) == "prompt_completion"
    with pytest.raises(ValueError):
        acquire.dataset_format(chat.withColumn("messages", F.lit("m")))
    c = spark.createDataFrame([("p1", None, False, "candidate"), ("p1", "bad", False, None), ("p2", None, False, "surplus"), (None, None, True, "candidate")], "arxiv_id string, quarantine_reason string, duplicate boolean, outcome string")
    assert {r.part: r.rows for r in acquire.write_run(c, str(tmp_path)).collect()} == {"papers": 2, "candidates": 4, "quarantine": 1, "handoff": 1, "surplus": 1}
    assert acquire.config_mismatches({"a": 1}, {"a": 2}, ["a", "b"]) == ["a: persisted=1 vs current=2"]
    scored = spark.createDataFrame([("u", 7, "solved", "s"), ("w", 6, "solved", "s"), ("x", 7, "solved", "s"), ("x", 7, "solved", "s")], "uid string, n_correct int, label string, statement string")
    good, bad = acquire.near_solved(scored, spark.createDataFrame([("u",), ("w",), ("x",), ("y",)], "uid string"))
    assert rows(good, "uid") == [("u",)] and rows(bad, "uid", "problem") == [("w", "tally"), ("x", "ambiguous"), ("y", "missing")]


def test_ranges_that_hold_points(spark):
    rng = random.Random(6)
    ranges = [(k, lo := rng.randrange(0, 5000), lo + rng.choice((-1, 0, 0, 1, 2, 3, 7, 8, 63, 64, 300))) for k in range(400)] + [(400 + k, 5000, 4999 + (1 << k)) for k in range(40)] + [(500, 0, 1 << 33), (501, 6000, 1 << 33), (502, 6001, 6000 + (1 << 29))]
    points = [rng.randrange(0, 5000) for _ in range(300)] + [6000, 6000]
    r, p = spark.createDataFrame(ranges, "k int, lo long, hi long"), spark.createDataFrame([(x,) for x in points], "p long")
    assert [x for (x,) in rows(spans.ranges_that_hold(p, r, "p", "lo", "hi").orderBy("k"), "k")] == sorted((k for k, lo, hi in ranges if any(lo <= x <= hi for x in points)), key=str)


def test_chunks_of_one_month_make_no_pairs(spark):
    code = F.concat(F.lit("2301."), F.lpad(F.col("id").cast("string"), 5, "0"))
    m = spark.range(0, 40_000, 2).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"), code.alias("first_item"), code.alias("last_item"))
    found = spans.chunks_for_ids(m, spark.range(1, 40_000, 3).select(code.alias("arxiv_id")))
    assert "_hi" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)  # places meet by equality alone
    assert sorted(int(r.filename[1:]) for r in found.collect()) == list(range(4, 40_000, 6))
