"""Replay sheets, checkpoints and pinned lists; sinks that write and read back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import last_wins
from .lines import parse, read_lines

CALIBRATION = "uid string, label string, pass_at_k double, n_correct int, n_wrong int, n_degenerate int"
JUDGE_SHEET = "section string, uid string, sample_id int, reply struct<verdict:string,insufficient_context:boolean,reason:string>"
ROLLOUTS = "uid string, rollout_uid string, sample_idx int, output string, candidate string, verdict string"


class PinError(ValueError):
    pass


def calibration_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each uid."""
    return last_wins(parse(read_lines(spark, path), CALIBRATION).drop("path", "terminated"), ["uid"], ["line_no"]).drop("line_no")


def judge_sheet(spark: SparkSession, path: str) -> DataFrame:
    return last_wins(parse(read_lines(spark, path), JUDGE_SHEET).drop("path", "terminated"), ["uid", "sample_id"], ["line_no"]).drop("line_no")


def rollout_file(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The last line of each (uid, rollout_uid), with the file."""
    rows = parse(read_lines(spark, path), ROLLOUTS).withColumnRenamed("path", "file").drop("terminated")
    return last_wins(rows, ["file", "uid", "rollout_uid"], ["line_no"])


def rollout_registry(spark: SparkSession, routed: Sequence[str], patterns: Sequence[str] = ()) -> DataFrame:
    """Every candidate file's rollouts, with the file: the routed ones and those that a pattern finds, each file once. Files that are not there are none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found: set[str] = set()
    for pattern in [*routed, *patterns]:
        place = hadoop.Path(pattern)
        found |= {f.getPath().toString() for f in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []}
    if not found:
        return spark.createDataFrame([], f"file string, line_no long, {ROLLOUTS}")
    return rollout_file(spark, sorted(found))


def checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Torn or broken lines are left out."""
    return parse(read_lines(spark, path), schema, "skip")


def uid_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("uid")).where("uid <> ''")


def split_file(spark: SparkSession, path: str, field: str, sha16: str | None = None) -> DataFrame:
    """One list of a pinned split file, as rows; the file's hash must begin with sha16."""
    text = spark.read.text(path, wholetext=True).first().value
    if sha16 is not None and (got := hashlib.sha256(text.encode()).hexdigest()[:16]) != sha16:
        raise PinError(f"{path}: pinned {sha16}, found {got}")
    return spark.createDataFrame([(str(x),) for x in json.loads(text)[field]], f"{'arxiv_id' if field.endswith('papers') else 'uid'} string")


def split_sheet(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A canonical sheet's two readings: judge replies, and a reply cache."""
    judge = rows.where("section = 'judge'").select("uid", "sample_id", "reply")
    cache = rows.where("section = 'cache'").select("uid", "sample_id", "reply")
    return judge, cache


def write_checked(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write, read back and compare: rows and keys must be what was given."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    want, got = (d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(key))).first() for d in (df, back))
    if tuple(want) != tuple(got):
        raise PinError(f"{path}: wrote {tuple(want)}, read {tuple(got)}")
    return back


def write_passed(records: DataFrame, passed: DataFrame, path: str) -> None:
    """Gate survivors as JSON lines, in their own shape."""
    records.join(passed.select("uid"), "uid", "left_semi").write.mode("overwrite").json(path)


def flat_csv(results: DataFrame, path: str) -> None:
    """Results as CSV: lists joined by semicolons, structures as JSON."""
    kinds = dict(results.dtypes)
    flat = [F.array_join(c, ";").alias(c) if k == "array<string>" else F.to_json(c).alias(c) if k.startswith(("struct", "map", "array")) else F.col(c) for c, k in kinds.items()]
    results.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("overwrite").partitionBy("combo").parquet(path)


def run_manifest(spark: SparkSession, **fields) -> DataFrame:
    """One row that says what a run read, counted and wrote."""
    return spark.createDataFrame([(json.dumps(fields, sort_keys=True, default=str),)], "manifest string")


def published_path(root: str, signature: dict) -> str:
    """A folder named by what goes into it: the same inputs give the same place."""
    return f"{root}/{hashlib.sha256(json.dumps(signature, sort_keys=True).encode()).hexdigest()[:16]}"
