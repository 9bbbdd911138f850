"""The journal loop as Structured Streaming: new rows are cut into the ledger exactly once."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..identity import content_hash, gate_uid, stmt_key
from ..operators.slices import judged
from ..schemas import LEDGER
from ..sources.lines import is_object, read_lines


def journal_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A growing folder of closed journal files as a stream of their lines; the checkpoint holds which files were read."""
    return spark.readStream.format("text").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def identified(lines: DataFrame, source: str) -> DataFrame:
    """read_lines' rows -> (path, line_no, statement, uid, stmt_key, content_hash). Blank lines go; a line that is no JSON object is an error that names it."""
    rows = lines.where(F.trim("line") != "")
    place = F.concat(F.col("path"), F.lit(":"), F.col("line_no"), F.lit(": not a JSON object"))
    checked = F.when(is_object(F.col("line")), F.col("line")).otherwise(F.raise_error(place))
    rows = rows.withColumn("line", checked).withColumn("statement", F.get_json_object("line", "$.candidate.statement"))
    return rows.select("path", "line_no", "statement", gate_uid(F.lit(source), F.col("statement")).alias("uid"), stmt_key(F.col("statement")).alias("stmt_key"), content_hash("line").alias("content_hash"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # no batch yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, f"{path}/batch=*", LEDGER)


#: Rows that were accepted but fill no slice yet, in their order.
HELD = "uid string, stmt_key string, content_hash string, path string, line_no long, at long"


def consume(stream: DataFrame, ledger_path: str, checkpoint: str, source: str, now_iso: str, size: int | None = None, warn_only: bool = False, name: str = "j"):
    """Read each micro-batch's files in order against the ledger, as a reader of lines would: accepted rows go to the ledger, the others to its skip log.

    With `size` the ledger takes whole slices of exactly so many rows, named slice-1, slice-2 and so on; a remainder is held
    and leads the next batch, and is never made a short slice. Without it a batch's accepted rows are one entry. A second
    journal is read by a stream of another `source`; warn_only marks its rows as ones that only warn.

    A batch writes folders of its own, overwritten if it is replayed, and reads the ledger and the held rows without them:
    replaying it gives the same folders, so nothing is taken twice or lost when a run is cut off between its writes. The
    ledger is a table and not streaming state, as it never expires.
    """

    def one(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        mine = f"{name}{batch_id}"
        paths = sorted(r.path for r in df.select("path").distinct().collect())  # the files of one micro-batch
        rows = identified(read_lines(spark, paths), source) if paths else spark.createDataFrame([], "path string, line_no long, statement string, uid string, stmt_key string, content_hash string")
        blank = rows.where("statement is null").select("path", "line_no", "uid", "stmt_key", "content_hash", F.lit("no statement").alias("verdict"))
        held = _table(spark, f"{ledger_path}-held/batch={name}{batch_id - 1}", HELD)
        ledger = read_ledger(spark, ledger_path).where(F.col("batch") != mine)
        taken = held.select("uid", "stmt_key", "content_hash", F.lit(mine).alias("batch"), F.lit(None).cast("string").alias("batch_label"), F.lit(source).alias("source_journal"), F.col("line_no").alias("journal_line"), F.lit(now_iso).alias("sliced_at"), F.lit(False).alias("warn_only"))
        order = F.struct("path", "line_no").alias("at")
        got = judged(rows.where("statement is not null").select("uid", "stmt_key", "content_hash", order), ledger.unionByName(taken), "at")
        fresh = got.where("accepted").select("uid", "stmt_key", "content_hash", "at.path", "at.line_no", F.lit(batch_id).cast("long").alias("at"))
        fresh = held.unionByName(fresh)
        label = F.lit(mine)
        if size:
            # Slices are numbered on from the ledger's; what is ordered by one task is a batch's accepted rows.
            before = ledger.where(F.startswith("batch_label", F.lit("slice-"))).agg(F.coalesce(F.max(F.substring_index("batch_label", "-", -1).cast("long")), F.lit(0))).first()[0]
            ranked = fresh.withColumn("_k", F.row_number().over(Window.orderBy("at", "path", "line_no")) - 1)
            whole = fresh.count() // size * size
            fresh, rest = ranked.where(F.col("_k") < whole), ranked.where(F.col("_k") >= whole)
            label = F.concat(F.lit("slice-"), (F.expr(f"_k div {size}") + before + 1).cast("string"))
            rest.drop("_k").write.mode("overwrite").parquet(f"{ledger_path}-held/batch={mine}")
        entry = fresh.select("uid", "stmt_key", "content_hash", F.lit(mine).alias("batch"), label.alias("batch_label"), F.lit(source).alias("source_journal"), F.col("line_no").alias("journal_line"), F.lit(now_iso).alias("sliced_at"), F.lit(warn_only).alias("warn_only"))
        entry.write.mode("overwrite").parquet(f"{ledger_path}/batch={mine}")
        skipped = got.where("not accepted").select("at.path", "at.line_no", "uid", "stmt_key", "content_hash", "verdict")
        skipped.unionByName(blank).write.mode("overwrite").parquet(f"{ledger_path}-skips/batch={mine}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def held_rows(spark: SparkSession, ledger_path: str, name: str = "j") -> DataFrame:
    """Rows of the last batch that fill no slice yet."""
    every = _table(spark, f"{ledger_path}-held/batch={name}*", HELD).withColumn("_b", F.regexp_extract(F.col("_metadata.file_path"), rf"batch={name}(\d+)/", 1).cast("long"))
    return every.withColumn("_last", F.max("_b").over(Window.partitionBy())).where("_b = _last").drop("_b", "_last")


def backfill(ledger_path: str, history: DataFrame, warn_only: bool = False) -> None:
    """Rows consumed before the stream began, as the ledger's first batch; a row's own uid is trusted."""
    rows = history.select("uid", "stmt_key", "content_hash", F.lit("backfill").alias("batch"), F.lit("backfill").alias("batch_label"), F.lit("history").alias("source_journal"), F.lit(None).cast("long").alias("journal_line"), F.lit("").alias("sliced_at"), F.lit(warn_only).alias("warn_only"))
    rows.write.mode("overwrite").parquet(os.path.join(ledger_path, "batch=-1"))


def windowed_counts(events: DataFrame, lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Rows by event-time window and kind; `ts` is made a zoned timestamp first, as watermarks need one."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("rows"))
