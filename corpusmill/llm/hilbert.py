"""Sharding along a Hilbert curve: quantise metadata, order by curve index, cut runs.

Neighbours on the curve are near in every dimension, so a run of rows, and the file it becomes, covers a small box
of the metadata space and min/max statistics prune it in several dimensions at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize

#: Texts with more than a MOST-th of the rows each: there are at most so many, which bounds what is broadcast of them.
MOST = 100_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """cells: (n, dims) integers below 2**bits -> index along the curve; dims * bits is at most 62.

    Works from the highest bit down: each level's cell is read as a Gray code in the frame reached so far, and the
    frame is turned by exchanging or complementing the lower bits of the first axis.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for k in range(dims):
            set_ = (x[:, k] & bit) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, k]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, k] ^= swap
    for k in range(1, dims):
        x[:, k] ^= x[:, k - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, dims - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    out = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            out = (out << 1) | ((x[:, k] >> level) & 1)
    return out


def curve_column(dims: Sequence[Column], bits: int) -> Column:
    if len(dims) * bits > 62:
        raise ValueError("dims * bits must be at most 62")

    @F.pandas_udf(T.LongType())
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(dtype=np.int64), bits))

    return index(F.struct(*[d.cast("long").alias(f"d{k}") for k, d in enumerate(dims)]))


def category_cell(column: Column, bits: int) -> Column:
    """A category's cell: its hash; null has a cell like any value."""
    return F.pmod(F.xxhash64(F.coalesce(column.cast("string"), F.lit(""))), F.lit(1 << bits))


def size_cell(column: Column, bits: int, top_log2: float = 32.0) -> Column:
    """A size's cell: its logarithm, evenly quantised; null counts as zero."""
    value = F.greatest(F.coalesce(column.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(F.log2(value + 1) * ((1 << bits) / top_log2)), F.lit((1 << bits) - 1))


def ranked(rows: DataFrame, keys: Sequence[str], flag: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """rows with `rank`, gapless from 0 in the order of keys (nulls first), `before` (rows of earlier rank that have the flag), and their number.

    A range sort deals rows out; a row's rank is its place in its partition plus the rows of earlier partitions. Only two
    counts for each partition go to the driver.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounded_batches(spark)
    names, at = rows.columns, rows.columns.index(flag)
    schema = rows.select("*", F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_place"), F.lit(0).cast("long").alias("_flags")).schema

    def number(batches):
        from pyspark import TaskContext

        part, place, flags = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            set_ = np.asarray(batch.column(at).cast(pa.int64()))
            seen = flags + np.cumsum(set_) - set_
            here = np.arange(place, place + batch.num_rows)
            place, flags = place + batch.num_rows, flags + int(set_.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(here), pa.array(seen)], names=[*names, "_part", "_place", "_flags"])

    placed = materialize(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(number, schema), "ranked")
    counts = sorted(tuple(r) for r in placed.groupBy("_part").agg(F.count(F.lit(1)), F.count_if(flag)).collect())
    before, total, flagged = [], 0, 0
    for part, n, f in counts:
        before.append((part, total, flagged))
        total, flagged = total + n, flagged + f
    offsets = spark.createDataFrame(before, "_part int, _before long, _flagged long")  # a row for each partition
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.select(*names, (F.col("_before") + F.col("_place")).alias("rank"), (F.col("_flagged") + F.col("_flags")).alias("before")), total


def _grouped(rows: DataFrame) -> DataFrame:
    """rows with `alone` (no other row has the text), and the curve index of every text's rows lowered to the least of them.

    Texts of so many rows that there can't be over MOST of them meet their rows in a broadcast, the others in a shuffle.
    """
    repeated = rows.groupBy("_text").agg(F.count(F.lit(1)).alias("_n"), F.min("curve").alias("_least")).where("_n > 1")
    repeated = materialize(repeated, "repeated")
    hot = F.col("_n") > max(rows.count() // MOST, 1000)
    rows = rows.join(F.broadcast(repeated.where(hot).select("_text", F.col("_least").alias("_hot"))), "_text", "left")
    key = F.when(F.col("_hot").isNull(), F.col("_text"))  # a hot text's rows need no other partner: they are spread by a null key
    rows = rows.withColumn("_key", key).join(repeated.where(~hot).select(F.col("_text").alias("_key"), "_least"), "_key", "left")
    least = F.coalesce("_hot", "_least")
    return rows.withColumn("alone", least.isNull()).withColumn("curve", F.coalesce(least, "curve")).drop("_hot", "_least", "_key")


def _fixes(placed: DataFrame, n: int, shards: int) -> list[tuple]:
    """For each cut that parts a text which one shard could hold: (shard, from rank, to rank, first, end, before, move).

    The text, at ranks first..end, goes to one side of the cut; `move` rows that are alone with their text, the nearest on the
    curve, change sides with it. At most `shards` rows are read for each list here.
    """
    cut = lambda k: -(-k * n // shards)
    cuts = {cut(k): k for k in range(1, shards) if 0 < cut(k) < n}
    sides = {r.rank: r for r in placed.where(F.col("rank").isin([c - d for c in cuts for d in (0, 1)])).select("rank", "_text", "alone").collect()}
    parted = {k: sides[c]._text for c, k in cuts.items() if not sides[c].alone and sides[c]._text == sides[c - 1]._text and not sides[c - 1].alone}
    if not parted:
        return []
    spans = placed.where(F.col("_text").isin(list(set(parted.values())))).where("not alone").groupBy("_text").agg(F.min("rank").alias("first"), (F.max("rank") + 1).alias("end"), F.min("before").alias("before"))
    spans = {r._text: r for r in spans.collect()}
    wanted = {}
    for k, t in parted.items():
        s, c = spans[t], cut(k)
        if s.first > cut(k - 1) - 1 and s.end <= cut(k + 1):
            wanted[k] = (s, c - s.first, s.end - c)
    last = [s.before + a - 1 for s, a, _ in wanted.values()] + [s.before - b for s, _, b in wanted.values()]
    at = {r.before: r.rank for r in placed.where("alone").where(F.col("before").isin(last)).select("before", "rank").collect()} if last else {}
    out, free = [], 0
    for k, (s, ahead, behind) in sorted(wanted.items()):
        c = cut(k)
        low = max(free, cut(k - 1))
        high = min(cut(k + 1), min((x.first for j, (x, _, _) in wanted.items() if j > k), default=n))
        down, up = at.get(s.before + ahead - 1), at.get(s.before - behind)
        moves = []
        if down is not None and s.end <= down < high:
            moves.append((ahead, s.first, down + 1))
        if up is not None and low <= up < s.first:
            moves.append((-behind, up, s.end))
        if s.first < low or not moves:
            continue
        move, lo, hi = min(moves, key=lambda m: abs(m[0]))
        free = hi
        out += [(k - 1, lo, c, s.first, s.end, s.before, move), (k, c, hi, s.first, s.end, s.before, move)]
    return out


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = 10, id_col: str = "doc_id", text_col: str = "text", dims: Sequence[Column] | None = None, whole_rows: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) per row, and the row itself as a struct `row` where whole_rows: law `rows`, shard row counts at most one apart.

    Dimensions default to language, source and text size; rows of equal texts take the least curve index among them and are
    neighbours. Ties on the curve are ordered by text hash, then id. A text that a cut would part goes to one side of it, and
    as many rows that are alone with their text change sides; a text stays parted only if it has more rows than a shard, or
    too few such rows stand near. Null text: size 8, checksum 0; null texts are equal. Null metadata: a cell of its own. Null
    ids and repeated rows are rows like others. Other columns are ignored. An empty table gives no rows.
    """
    have = set(docs.columns)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8
    if dims is None:
        named = [category_cell(F.col(c) if c in have else F.lit(None), bits) for c in ("lang", "source")]
        dims = [*named, size_cell(size, bits)]
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    held = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(F.col(text_col)).alias("_text"), curve_column(dims, bits).alias("curve"), *held)
    rows = materialize(rows, "curve")
    placed, n = ranked(_grouped(rows), ["curve", "_text", "doc_id"], "alone")
    fixes = docs.sparkSession.createDataFrame(_fixes(placed, n, shards), "shard int, lo long, hi long, first long, end long, c long, move long")
    placed = placed.withColumn("shard", F.expr(f"(rank * {shards}) div {max(n, 1)}").cast("int"))
    near = placed.join(F.broadcast(fixes.withColumnRenamed("shard", "_shard")), (F.col("shard") == F.col("_shard")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")  # two rows a cut at most
    later, gone = F.col("move") > 0, F.greatest(F.lit(0), F.least(F.abs("move"), F.when(F.col("move") > 0, F.col("before") - F.col("c")).otherwise(F.col("before") - F.col("c") - F.col("move"))))
    own = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    moved = F.when(own, F.col("rank") + F.col("move"))
    moved = moved.when(later & F.col("alone"), F.col("first") + F.col("before") - F.col("c")).when(later, F.col("rank") + F.col("move") - gone)
    moved = moved.when(F.col("alone"), F.col("end") + F.col("move") + gone).otherwise(F.col("rank") - gone)
    near = near.withColumn("rank", F.when(F.col("move").isNull(), F.col("rank")).otherwise(moved)).withColumn("shard", F.expr(f"(rank * {shards}) div {max(n, 1)}").cast("int"))
    slot = F.col("rank") - F.expr(f"(cast(shard as long) * {n} + {shards - 1}) div {shards}")
    return near.select("doc_id", "size", "text_crc32", "curve", "shard", slot.alias("slot"), *["row"] * whole_rows)


def write_shards(docs: DataFrame, path: str, shards: int = 24, file_bytes: int = 128 << 20, **options) -> DataFrame:
    """Write docs in shard folders, slot order within a file, and return the pruning index: per shard, rows and bounds of the curve and size.

    Every row is written once, repeated and null ids included; the columns shard and slot are added and replace ones of those
    names. Tasks follow the size of the texts, so that a shard is cut into files of about file_bytes.
    """
    placed = materialize(hilbert_shards(docs, shards, whole_rows=True, **options), "placed")
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(shards, -(-total // file_bytes))
    rows = placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    rows.repartitionByRange(int(tasks), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{c}_{n}") for c in ("curve", "size") for n, f in (("min", F.min), ("max", F.max))])


def op9_hilbert(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = hilbert_shards(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
