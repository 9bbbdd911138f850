import pytest

from corpusmill.plans import control
from corpusmill.plans.control import Batch, ControlError, Plan


def test_states():
    b = Batch().to("SLICED", "t").to("MOUNTED", "t").to("MOUNTED", "t").to("FROZEN", "t").to("CASCADE_DONE", "t").to("PASSK_DONE", "t").to("READY", "t")
    assert b.state == "READY" and len(b.history) == 6
    for start, step in ((Batch(), "MOUNTED"), (Batch("SLICED"), "READY"), (b, "FROZEN"), (Batch("MOUNTED"), "SLICED"), (Batch(), "odd")):
        with pytest.raises(ControlError):
            start.to(step, "t")


def test_plans():
    plan = Plan("r1", 100, 12, output_dir="/o")
    with pytest.raises(ControlError, match="approved"):
        plan.check()
    plan.approve("me").check()
    for change in ({"call_budget": 11}, {"target_count": 0}, {"mode": "odd"}, {"mode": "flow_testing"}, {"truth_policy": "odd"}, {"call_budget": True}):
        with pytest.raises(ControlError):
            Plan(**{**plan.approve("me").__dict__, **change}).check()


def test_specs():
    assert control.parse_combo(" A : X ", ["a"], ["x"]) == ("a", "x")
    assert control.parse_stage("a:x?advisory", ["a"], ["x"]) == ("a:x", True)
    for bad in ("a", "b:x", "a:y"):
        with pytest.raises(ControlError):
            control.parse_combo(bad, ["a"], ["x"])
    with pytest.raises(ControlError):
        control.check_window({"odd": 1}, ["year"])
    assert control.check_window({"year": 1, "exclude_arxiv_ids": ["p"]}, ["year", "exclude_arxiv_ids"])
    control.check_roles({"base_url": "a", "log_path": "b", "cache_path": "c"}, {"base_url": "d", "log_path": "e", "cache_path": "f"})
    with pytest.raises(ControlError, match="log_path"):
        control.check_roles({"base_url": "a", "log_path": "b", "cache_path": "c"}, {"base_url": "d", "log_path": "b", "cache_path": "f"})
    with pytest.raises(ControlError):
        control.check_names(["/x/My_KEY.txt"], ["key"])


def test_pins_replay_and_retries(spark, tmp_path):
    (tmp_path / "f").write_text("a\nb")
    sha, rows = control.pin(spark, str(tmp_path / "f"))
    assert rows == 2
    control.check_pin(spark, str(tmp_path / "f"), sha, 2)
    with pytest.raises(ControlError):
        control.check_pin(spark, str(tmp_path / "f"), sha, 3)
    answers = spark.createDataFrame([("u", 0, "yes")], "uid string, sample_idx int, output string")
    asked = spark.createDataFrame([("u", 0), ("u", 1)], "uid string, sample_idx int")
    table = control.backend("production", answers)
    assert sorted((r.sample_idx, r.output) for r in table.ask(asked).collect()) == [(0, "yes"), (1, None)]
    with pytest.raises(ControlError):
        table.ask_all(asked)
    with pytest.raises(ControlError):
        control.backend("production", None)
    calls = []
    with pytest.raises(OSError):
        control.with_retries(lambda: calls.append(1) or (_ for _ in ()).throw(OSError()), lambda e: True, 3)
    assert len(calls) == 3
    w = spark.createDataFrame([("no id",), ("no id",)], "warning string")
    assert "- no id: 2" in control.source_report("T", {"kept": 3}, w, spark.createDataFrame([("r",)], "quarantine_reason string"))


def test_run_guards(spark, tmp_path):
    control.check_not_retired("/a/b", ["/a/c", "/a/bb"])
    with pytest.raises(control.ControlError, match="retired"):
        control.check_not_retired("/a/b/../b/x", ["/a/b"])
    uids = spark.createDataFrame([("u",), ("v",)], "uid string")
    with pytest.raises(control.ControlError, match="no baseline at"):
        control.check_baseline(spark, str(tmp_path / "none"), uids)
    spark.createDataFrame([("u", 1), ("v", None)], "uid string, n_correct int").write.parquet(str(tmp_path / "base"))
    control.check_baseline(spark, str(tmp_path / "base"), uids.where("uid = 'u'"))
    with pytest.raises(control.ControlError, match="no baseline score"):
        control.check_baseline(spark, str(tmp_path / "base"), uids)
    (tmp_path / "f").write_bytes(b"a\nb")
    sha = control.pin(spark, str(tmp_path / "f"))[0]
    control.check_chain(spark, {"x": sha}, {"x": str(tmp_path / "f")})
    for manifest, message in (({"x": "0"}, "not the files"), ({}, "does not name")):
        with pytest.raises(control.ControlError, match=message):
            control.check_chain(spark, manifest, {"x": str(tmp_path / "f")})
    assert control.run_concluded(True, None, 5) and control.run_concluded(False, 6.0, 5) and not control.run_concluded(False, None, 5)
    assert [control.retry_after(v) for v in ("3", "1.5", "-1", "inf", "Wed, 21 Oct", None)] == [3.0, 1.5, None, None, None, None]


def test_tick_and_status():
    seen = []
    done, open_, frozen = control.Batch("READY"), control.Batch("SLICED", [(None, "SLICED", "t1")]), control.Batch(control.FROZEN)
    run = lambda batches: control.tick([lambda: seen.append("watched")], batches, lambda k: seen.append(k), lambda: seen.append("cut"))
    assert [run([done, open_]), run([done, frozen, open_]), run([done])] == ["advanced", "halted", "sliced"]
    assert seen == ["watched", 1, "watched", "watched", "cut"]
    text = control.status_report({2: open_, 1: done}, 7, {"cost": 1.5})
    assert "| 1 | READY |  |\n| 2 | SLICED | t1 |" in text and "next slice: 7" in text and "- cost: 1.5" in text
