"""Mounting a folder of JSON, JSON-lines, CSV and TSV drops."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import broken_files, parse, read_lines

SUFFIXES = ("jsonl", "json", "csv", "tsv")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, suffix) of mountable files, one level deep, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    return files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("suffix").isin(*SUFFIXES)).orderBy("path")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of objects, or an object that holds one under records or data -> rows in order with pos."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    held = F.coalesce(*[F.from_json("value", f"struct<{k}:array<struct<{schema}>>>")[k] for k in ("records", "data")], F.from_json("value", f"array<struct<{schema}>>"))
    return text.select("path", F.posexplode(held).alias("pos", "_r")).select("path", "pos", "_r.*")


def read_table(spark: SparkSession, path: str, mapping: Mapping[str, str], sep: str = ",") -> DataFrame:
    """CSV or TSV with a mandatory map canonical -> column; other columns are kept in raw_columns."""
    if not mapping:
        raise ValueError("a column map is needed for CSV and TSV files")
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    if lost := [c for c in mapping.values() if c not in raw.columns]:
        raise ValueError(f"{path} has no column {', '.join(lost)}")
    rest = [c for c in raw.columns if c not in mapping.values()]
    pairs = [x for c in rest for x in (F.lit(c), F.col(f"`{c}`"))]
    return raw.select(*[F.col(f"`{of}`").alias(to) for to, of in mapping.items()], (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("raw_columns"))


def mount(spark: SparkSession, folder: str, schema: str, stamps: Mapping[str, str], mapping: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): every mountable file's rows with path; a file that can't be read is left out and reported.

    stamps fill fields that a row does not have: a field that is there and null stays null.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    out, errors = None, []
    for path, suffix in [tuple(r) for r in scan(spark, folder).collect()]:  # a drop folder's listing
        if suffix == "jsonl":
            lines = read_lines(spark, path)
            if bad := broken_files(lines).first():
                errors.append((path, f"line {bad.line_no}: not JSON"))
                continue
            rows = parse(lines, schema).withColumn("pos", F.col("line_no") - 1)
            keys = lines.select(F.col("line_no"), F.json_object_keys("line").alias("_keys"))
            rows = rows.join(keys, "line_no")
        elif suffix == "json":
            rows = read_json_array(spark, path, schema).withColumn("_keys", F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))
            if rows.isEmpty():
                errors.append((path, "not an array of objects"))
                continue
        else:
            try:
                rows = read_table(spark, path, mapping or {}, "\t" if suffix == "tsv" else ",").withColumn("pos", F.monotonically_increasing_id())
            except ValueError as e:
                errors.append((path, str(e)))
                continue
            rows = rows.withColumns({n: F.lit(None).cast("string") for n in names if n not in rows.columns}).withColumn("path", F.lit(path)).withColumn("_keys", F.array(*[F.lit(n) for n in mapping or {}]))
        filled = {n: F.when(F.array_contains("_keys", n), F.col(n)).otherwise(F.lit(v)) if n in names else F.lit(v) for n, v in stamps.items()}
        rows = rows.withColumns(filled).select("path", "pos", *names, *[s for s in stamps if s not in names])
        out = rows if out is None else out.unionByName(rows)
    report = spark.createDataFrame(errors, "path string, error string")
    if out is None:
        out = spark.createDataFrame([], "path string, pos long, " + schema)
    return out, report


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON-lines, JSON or CSV file of raw rows, with default_source: the file's name without its suffix. CSV columns go by their headers."""
    stem, suffix = re.fullmatch(r"(?:.*/)?([^/]*?)\.([A-Za-z]+)", path).groups()
    names = [f.split()[0] for f in schema.split(", ")]
    if suffix.lower() == "jsonl":
        rows = parse(read_lines(spark, path), schema)
    elif suffix.lower() == "json":
        rows = read_json_array(spark, path, schema)
    else:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
        rows = raw.select(*[(F.col(f"`{n}`") if n in raw.columns else F.lit(None)).cast(kind).alias(n) for n, kind in (f.split() for f in schema.split(", "))])
    return rows.select(*names).withColumn("default_source", F.lit(stem))


def duplicate_uids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("uid").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
