import pytest
from pyspark.sql import functions as F

from corpusmill.operators.splits import GuardError
from corpusmill.plans import builds, control

RECORD = "uid string, statement string, arxiv_id string, rollout_uids array<string>, routed string, n_correct int, n_wrong int, n_degenerate int"
ROLLOUT = "file string, uid string, rollout_uid string, sample_idx int, verdict string, output string"


@pytest.fixture
def world(spark):
    corpus = [("a", "Find x in the first problem.", "p1", ["r1", "r2"], "f", 1, 1, 0), ("b", "Find y in the second one.", "p2", ["r3"], "f", 1, 0, 0)]
    files = [("f", "a", "r1", 0, "correct", "out a"), ("f", "a", "r2", 1, "wrong", "no"), ("g", "b", "r3", 0, "correct", "out b")]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "uid string")
    statements = lambda *x: spark.createDataFrame([(i,) for i in x], "statement string")
    return {
        "corpus": spark.createDataFrame(corpus, RECORD), "files": spark.createDataFrame(files, ROLLOUT), "train": ids("a", "b"), "ids": ids, "statements": statements,
        "evaluation": builds.Evaluation(spark.createDataFrame([("p9",)], "arxiv_id string"), ids("z"), statements("The evaluated statement of all")),
    }


def run(w, **changed):
    w = {**w, **changed}
    return builds.build(w["corpus"], w["files"], w["train"], w["train"].limit(0), w["evaluation"], "Solve.", "cap1", 1, 7)


def test_build(spark, world):
    rows = run(world)
    assert sorted((r.uid, r.prompt[1].content, r.completion[0].content) for r in rows.collect()) == [("a", "Find x in the first problem.", "out a"), ("b", "Find y in the second one.", "out b")]
    told = builds.manifest(rows, "cap1", 7).first()
    assert (told.rows, told.uids, told.papers) == (2, 2, 2)
    builds.check_written(rows, world["evaluation"], "cap1")
    with pytest.raises(control.ControlError, match="no rows"):
        builds.check_written(rows.limit(0), world["evaluation"], "cap1")
    with pytest.raises(GuardError, match="offend"):
        builds.check_written(rows.unionAll(rows), world["evaluation"], "cap1")


def test_each_guard_stops_the_build(spark, world):
    e, corpus, files = world["evaluation"], world["corpus"], world["files"]
    cases = {
        "share uids": {"evaluation": builds.Evaluation(e.papers, world["ids"]("a"), e.statements)},
        "selection and corpus": {"train": world["ids"]("a", "nobody")},
        "harvested": {"files": files.withColumn("output", F.lit(""))},
        "several uids": {"corpus": corpus.withColumn("statement", F.lit("the same"))},
        "evaluation statement is trained": {"evaluation": builds.Evaluation(e.papers, e.uids, world["statements"]("Find y in the second one."))},
        "rows offend.*evaluation paper": {"evaluation": builds.Evaluation(spark.createDataFrame([("p2",)], "arxiv_id string"), e.uids, e.statements)},
        "rows offend.*evaluation statement": {"evaluation": builds.Evaluation(e.papers, e.uids, world["statements"]("x in the first"))},
    }
    for message, changed in cases.items():
        with pytest.raises(GuardError, match=message):
            run(world, **changed)


def test_harvest_problems(spark, world):
    routed = spark.createDataFrame([("a", "f"), ("b", None)], "uid string, file string")
    assert [tuple(r) for r in builds.harvest_problems(world["corpus"], routed, world["files"]).collect()] == [("b", "no file accounts for it")]
    forged = world["files"].withColumn("uid", F.when(F.col("rollout_uid") == "r2", "b").otherwise(F.col("uid")))
    got = dict(builds.harvest_problems(world["corpus"], routed.fillna("g"), forged).collect())
    assert got == {"a": "a rollout is missing or another record's"}


def test_stages_run_once():
    ran = []
    run_ = lambda done, cost, ok=True: builds.run_stage(done, cost, 5.0, lambda: ran.append(1), lambda: ok)
    assert [run_(True, 9), run_(False, 9), run_(False, 1)] == ["skipped", "stopped", "done"] and len(ran) == 1
    with pytest.raises(control.ControlError, match="verify"):
        run_(False, 1, ok=False)
