import hashlib
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import archives, lines, mount, sheets, xml
from corpusmill.streaming import journal


def test_line_tolerances(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"uid": "a"}\n\n{"uid": "b"}\n{"uid": "c')
    held = lines.read_lines(spark, str(p))
    assert [(r.line_no, r.terminated) for r in held.orderBy("line_no").collect()] == [(1, True), (2, True), (3, True), (4, False)]
    for tolerance in ("skip", "torn_tail", "last_line"):
        assert [r.uid for r in lines.parse(held, "uid string", tolerance).orderBy("line_no").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="a.jsonl:4"):
        lines.parse(held, "uid string").collect()
    p.write_text('{"uid": "a"}\n{bad}\n{"uid": "c"}\n')
    assert lines.parse(lines.read_lines(spark, str(p)), "uid string", "skip").count() == 2
    with pytest.raises(Exception, match="a.jsonl:2"):
        lines.parse(lines.read_lines(spark, str(p)), "uid string", "torn_tail").collect()


def test_line_numbers_across_splits(spark, tmp_path):
    for name, end in (("a", "\n"), ("b", "")):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"n": i, "pad": "é" * (i % 90)}) for i in range(1, 3001)) + end)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        held = lines.read_lines(spark, str(tmp_path))
        got = held.select("path", "line_no", F.get_json_object("line", "$.n").cast("long").alias("n"), "terminated", "is_last").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(got) == 6000 and all(r.line_no == r.n for r in got)
    assert sorted((r.path[-7:], r.n) for r in got if r.is_last) == [("a.jsonl", 3000), ("b.jsonl", 3000)]
    assert [(r.path[-7:], r.n) for r in got if not r.terminated] == [("b.jsonl", 3000)]


def test_mount(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"statement": "x", "source": null}\n{"statement": "y"}\n')
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"statement": "z", "source": "own"}]}))
    (tmp_path / "c.csv").write_text("q,extra\nw,1\n")
    (tmp_path / "d.tsv").write_text("other\n1\n")
    (tmp_path / "e.jsonl").write_text("{broken\n")
    (tmp_path / "f.txt").write_text("no")
    rows, errors = mount.mount(spark, str(tmp_path), "statement string, source string", {"source": "drop"}, {"statement": "q"})
    got = {r.statement: r.source for r in rows.collect()}
    assert got == {"x": None, "y": "drop", "z": "own", "w": "drop"}
    assert sorted(r.path.rpartition("/")[2] for r in errors.collect()) == ["d.tsv", "e.jsonl"]


def test_xml(spark, tmp_path):
    (tmp_path / "atom.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2301.00001v2</id><title> A\n b </title><summary>S</summary><published>2023</published><category term="math.AP"/><category term="math.NA"/></entry><entry><id>none</id></entry></feed>')
    r = xml.read_atom(spark, str(tmp_path / "atom.xml")).collect()
    assert [(x.arxiv_id, x.title, x.categories) for x in r] == [("2301.00001", "A b", ["math.AP", "math.NA"])]
    assert xml.in_window(xml.candidates(xml.read_atom(spark, str(tmp_path / "atom.xml"))), ["math.*"], "2022").count() == 1
    fields = "filename yymm seq_num first_item last_item num_items size md5sum content_md5sum timestamp".split()
    entry = "".join(f"<{f}>{'7' if f in ('seq_num', 'num_items', 'size') else f}</{f}>" for f in fields)
    (tmp_path / "m.xml").write_text(f"<arXivSRC><file>{entry}</file></arXivSRC>")
    assert xml.read_manifest(spark, str(tmp_path / "m.xml")).first().size_bytes == 7
    (tmp_path / "n.xml").write_text("<arXivSRC><file><filename>f</filename></file></arXivSRC>")
    with pytest.raises(Exception, match="without"):
        xml.read_manifest(spark, str(tmp_path / "n.xml")).collect()
    page = "<r><record><metadata><arXiv><id>1</id><categories>a b</categories><title>t</title></arXiv></metadata></record><resumptionToken> tok </resumptionToken></r>"
    (tmp_path / "o.xml").write_text(page)
    assert xml.read_harvest(spark, str(tmp_path / "o.xml")).first().primary_category == "a"
    assert spark.range(1).select(xml.resumption_token(F.lit(page))).first()[0] == "tok"


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "c.tar", "w") as tar:
        for name in ("2301/2301.00001.gz", "2301/2301.00002.gz", "2301/readme"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    members = archives.read_members(spark, str(tmp_path / "c.tar"))
    wanted = spark.createDataFrame([("2301.00002",)], "arxiv_id string")
    assert [(r.arxiv_id, bytes(r.payload)) for r in archives.matching(members, wanted).collect()] == [("2301.00002", b"abc")]
    manifest = spark.createDataFrame([("src/c.tar", "x")], "filename string, md5sum string")
    assert archives.checksum_failures(members, manifest).count() == 1
    md5 = hashlib.md5((tmp_path / "c.tar").read_bytes()).hexdigest()
    assert archives.checksum_failures(members, spark.createDataFrame([("src/c.tar", md5)], "filename string, md5sum string")).count() == 0
    asked = spark.createDataFrame([("src/c.tar", ["2301.00001"]), ("src/other.tar", ["2301.00002"])], "chunk string, arxiv_ids array<string>")
    assert [(r.arxiv_id, r.md5) for r in archives.read_members(spark, str(tmp_path / "*.tar"), asked).collect()] == [("2301.00001", None)]
    with open(tmp_path / "c.tar", "r+b") as f:  # what follows the wanted member is not read: a broken tail does no harm
        f.truncate(1500)
    assert archives.read_members(spark, str(tmp_path / "c.tar"), asked).count() == 1


def test_rows_name_their_file(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"statement": "s", "n": 1}\n')
    (tmp_path / "two.json").write_text('{"records": [{"statement": "t", "n": 2}]}')
    (tmp_path / "three.csv").write_text('n,statement\n3,"u, v"\n')
    got = [tuple(mount.read_rows(spark, str(tmp_path / f), "statement string, n int, other string").first()) for f in ("one.jsonl", "two.json", "three.csv")]
    assert got == [("s", 1, None, "one"), ("t", 2, None, "two"), ("u, v", 3, None, "three")]


def test_rollout_registry(spark, tmp_path):
    for name in ("a/_progress", "b/_progress"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "rollouts.jsonl").write_text('{"uid": "u", "rollout_uid": "r", "verdict": "wrong"}\n{"uid": "u", "rollout_uid": "r", "verdict": "correct"}\n')
    got = sheets.rollout_registry(spark, [str(tmp_path / "a/_progress/rollouts.jsonl"), str(tmp_path / "gone/rollouts.jsonl")], [str(tmp_path / "*/_progress/rollouts.jsonl")])
    assert sorted((r.file.split("/")[-3], r.verdict) for r in got.collect()) == [("a", "correct"), ("b", "correct")]
    assert sheets.rollout_registry(spark, [str(tmp_path / "none")]).count() == 0


def test_sheets(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"uid": "a", "label": "band"}\n{"uid": "a", "label": "solved"}\n')
    assert sheets.calibration_sheet(spark, str(tmp_path / "s.jsonl")).first().label == "solved"
    (tmp_path / "split.json").write_text('{"eval_papers": ["p", "q"]}')
    assert sheets.split_file(spark, str(tmp_path / "split.json"), "eval_papers").count() == 2
    with pytest.raises(sheets.PinError):
        sheets.split_file(spark, str(tmp_path / "split.json"), "eval_papers", "0" * 16)
    df = spark.createDataFrame([("a", 1)], "uid string, n int")
    assert sheets.write_checked(df, str(tmp_path / "w"), "uid").count() == 1
    sheets.flat_csv(df.withColumn("tags", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().tags == "x;y"
    assert sheets.published_path("/r", {"a": 1}) == sheets.published_path("/r", {"a": 1})


def line(k, extra=0):
    return json.dumps({"arxiv_id": "p", "extra": extra, "candidate": {"statement": f"s{k}"}}) + "\n"


def test_journal_stream_is_exactly_once(spark, tmp_path):
    folder, ledger, check = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "check")
    folder.mkdir()
    (folder / "a.jsonl").write_text(line(1) + line(2) + line(1))
    run = lambda: journal.consume(journal.journal_stream(spark, str(folder)), ledger, check, "src", "t").awaitTermination()
    run()
    assert journal.read_ledger(spark, ledger).count() == 2
    (folder / "b.jsonl").write_text(line(2) + line(3) + line(1, extra=9))
    run()
    run()
    got = journal.read_ledger(spark, ledger)
    assert got.count() == 3 and got.select("uid").distinct().count() == 3
    skips = spark.read.parquet(f"{ledger}-skips/batch=*")
    assert sorted(r.verdict for r in skips.collect()) == ["replay", "replay", "uid_conflict"]


def run_journal(spark, root, size=None):
    stream = journal.journal_stream(spark, str(root / "in"))
    journal.consume(stream, str(root / "ledger"), str(root / "check"), "src", "t", size).awaitTermination()


def test_the_first_line_of_a_statement_is_taken(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spaced = lambda s: json.dumps({"candidate": {"statement": s}}) + "\n"
    (tmp_path / "in/a.jsonl").write_text(spaced("zeta one") + spaced("Zeta  ONE") + spaced("zeta one") + json.dumps({"candidate": {}}) + "\n\n")
    run_journal(spark, tmp_path)
    assert [(r.journal_line, r.source_journal) for r in journal.read_ledger(spark, str(tmp_path / "ledger")).collect()] == [(1, "src")]
    skips = spark.read.parquet(f"{tmp_path}/ledger-skips/batch=*").orderBy("line_no").collect()
    assert [(r.line_no, r.verdict) for r in skips] == [(2, "stmt_conflict"), (3, "replay"), (4, "no statement")]


def test_a_broken_line_stops_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(line(1) + "[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        run_journal(spark, tmp_path)
    assert journal.read_ledger(spark, str(tmp_path / "ledger")).count() == 0


def test_slices_of_the_stream_are_exact(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ledger = str(tmp_path / "ledger")
    for k, (lines_, entries, held) in enumerate([([1, 2, 3, 4, 5], {"slice-1": 3}, [4, 5]), ([5, 1], {"slice-1": 3}, [4, 5]), ([6, 7], {"slice-1": 3, "slice-2": 3}, [7])]):
        (tmp_path / f"in/{k}.jsonl").write_text("".join(line(x) for x in lines_))
        run_journal(spark, tmp_path, 3)
        got = journal.read_ledger(spark, ledger)
        assert {r.batch_label: r["count"] for r in got.groupBy("batch_label").count().collect()} == entries
        want = {r.uid for r in journal.identified(lines.read_lines(spark, str(tmp_path / "in")), "src").where(F.col("statement").isin([f"s{x}" for x in held])).collect()}
        assert {r.uid for r in journal.held_rows(spark, ledger).collect()} == want
    skips = spark.read.parquet(f"{ledger}-skips/batch=*")
    assert [r.verdict for r in skips.collect()] == ["replay", "replay"]


def test_windows_need_a_zoned_timestamp(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    folder = tmp_path / "ev"
    spark.read.parquet(src).write.parquet(str(folder))
    stream = journal.windowed_counts(spark.readStream.schema(schema).parquet(str(folder)))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("rows")).first()[0] == spark.read.parquet(src).count()
