"""JSON-lines readers: every reader keeps file and line, and each has its own rule for what is broken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, line_no from 1, line, terminated, is_last) for each line.

    Files are read in splits. A line's number is its place in its split plus the lines of the file's earlier splits, so no
    task holds a file and nothing is sorted; what is broadcast has a row for each split. `terminated` is false for a last
    line without a line end, which the file's size tells.
    """
    place = F.monotonically_increasing_id()  # rises along a split
    meta = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_block_start", "file_size")]
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), *meta, F.col("value").alias("_v"), place.alias("_id"))
    rows = rows.withColumnsRenamed({"_file_block_start": "_block", "_file_size": "_size"})
    blocks = rows.groupBy("path", "_block", "_size").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_lo"), F.sum(F.octet_length("_v") + 1).alias("_bytes"))
    own, so_far = Window.partitionBy("path"), Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "path", "_block", "_lo", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("_all"), (F.sum("_bytes").over(own) <= F.col("_size")).alias("_closed")
    )
    joined = rows.drop("_size").join(F.broadcast(blocks), ["path", "_block"]).withColumn("line_no", F.col("_before") + F.col("_id") - F.col("_lo") + 1)
    last = F.col("line_no") == F.col("_all")
    return joined.select("path", "line_no", F.regexp_replace("_v", "\r$", "").alias("line"), (~last | F.col("_closed")).alias("terminated"), last.alias("is_last"))


def is_json(line: Column) -> Column:
    return F.try_parse_json(line).isNotNull()


def is_object(line: Column) -> Column:
    return F.startswith(F.coalesce(F.schema_of_variant(F.try_parse_json(line)), F.lit("")), F.lit("OBJECT"))


def parse(lines: DataFrame, schema: str, tolerance: str = "strict") -> DataFrame:
    """lines with the schema's fields. Blank lines go; broken ones by rule:

    strict: an error that names file and line. skip: left out. torn_tail: an unterminated last line is left out, any other broken
    line is an error. last_line: a broken last line is left out whether it ends or not, any other is an error.
    """
    rows = lines.where(F.trim("line") != "")
    bad = ~is_json(F.col("line"))
    if tolerance == "skip":
        rows = rows.where(~bad)
    elif tolerance == "torn_tail":
        rows = rows.where("terminated")
    elif tolerance == "last_line":
        rows = rows.where(~(bad & F.col("is_last")))
    elif tolerance != "strict":
        raise ValueError(f"unknown tolerance {tolerance!r}")
    checked = F.when(bad, F.raise_error(F.concat(F.col("path"), F.lit(":"), F.col("line_no"), F.lit(": not JSON")))).otherwise(F.col("line"))
    return rows.select("path", "line_no", "terminated", F.from_json(checked, schema).alias("_r")).select("path", "line_no", "terminated", "_r.*")


def broken_files(lines: DataFrame) -> DataFrame:
    """(path, line_no) of each file's first line that is not JSON: what a mount reports and leaves out."""
    return lines.where((F.trim("line") != "") & ~is_json(F.col("line"))).groupBy("path").agg(F.min("line_no").alias("line_no"))


def load_inputs(spark: SparkSession, inputs: Sequence[tuple[str, str]], schema: str) -> DataFrame:
    """inputs: (path, source) in read order -> one table with file_pos, line_no and source; any broken line is an error."""
    out = None
    for pos, (path, source) in enumerate(inputs):
        rows = parse(read_lines(spark, path), schema).withColumns({"file_pos": F.lit(pos), "source": F.lit(source)})
        out = rows if out is None else out.unionByName(rows)
    return out


def ingest_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("uid").alias("uids"))
