"""Shared plumbing: the folder that every executor sees, written intermediate tables, files by URI."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bit table: 2 MB, whatever the data's size.
TABLE_BITS = 24
#: Rows in one Arrow batch: bounds a Python worker's memory where texts are long.
BATCH_ROWS = 1000


def shared_root(spark: SparkSession) -> str:
    """URI of the folder shared by driver and executors: spark.checkpoint.dir, in the default file system where it names none.

    Where it is unset, a local master gets a folder of its own; on a cluster that is an error, as no machine sees another's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(path).toString()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    made = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives a lost executor. discard() deletes it early."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[id(back)] = path
    weakref.finalize(back, _written.pop, id(back), None)
    return back


#: id of a frame that materialize gave -> its path.
_written: dict[int, str] = {}


def discard(*frames: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in frames:
        if made := _written.pop(id(df), None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches to a bounded number of rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def bit_table(hashes: DataFrame):
    """Broadcast of a bit for each value of the top TABLE_BITS of 64-bit hashes(h), as numpy words: passes() screens by it."""
    word = F.shiftrightunsigned("h", 64 - TABLE_BITS + 6)
    bit = F.shiftrightunsigned("h", 64 - TABLE_BITS).bitwiseAND(F.lit(63)).cast("int")
    found = hashes.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("m")).collect()  # 2**18 rows at most
    bits = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    for r in found:
        bits[r.w] = r.m & 0xFFFFFFFFFFFFFFFF
    return hashes.sparkSession.sparkContext.broadcast(bits)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A flag for each hash: false only where it is not in the table."""
    place = h >> np.uint64(64 - TABLE_BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI: local, HDFS or object store."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, chunks) -> int:
    """Write byte chunks under a private name, then rename: a repeated or speculative task leaves one whole file."""
    filesystem, path = open_fs(uri)
    parent, _, base = path.rpartition("/")
    filesystem.create_dir(parent, recursive=True)
    part = f"{parent}/_{uuid.uuid4().hex}.{base}"
    size = 0
    with filesystem.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    try:
        filesystem.move(part, path)
    except OSError:
        filesystem.delete_file(path)
        filesystem.move(part, path)
    return size


def arrow_rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
