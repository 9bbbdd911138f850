"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are word n-grams of the test items. How often each occurs in the whole corpus decides which are rare: of an item's
n-grams that the corpus holds, the rarer share seeds the search. Rows of documents are screened by a bit table of fixed
size, so what is broadcast does not grow with either side; the hits that pass meet the seeds in an exact join. Around its
hits a passage as long as an item needs is cut out and aligned with each item that it shares a seed with.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bit_table, bounded_batches, materialize, passes, release

#: Words of a seed; share of an item's n-grams that may seed; alignment scores; least score as a share of the best possible.
N, RARE, MATCH, MISMATCH, GAP, LEAST = 3, 0.75, 2, -1, 1, 0.5
BASE = np.uint64(0x9E3779B97F4A7C15)

_find = re.compile(r"\w+").findall


def word_hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + hashes[k : len(hashes) - n + 1 + k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _words(text) -> list[str]:
    return _find((text or "").lower())


def item_grams(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, h, size, words) distinct: an item's n-grams, or of one of fewer words the whole item, with the words of a gram and of the item."""
    out = pa.schema([("item_id", pa.int64()), ("h", pa.int64()), ("size", pa.int32()), ("words", pa.int32())])

    def each(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _words(text)
                size = min(n, len(words))
                found = np.unique(gram_hashes(word_hashes(words), size)) if size else []
                rows += [(item, int(np.int64(np.uint64(h).view(np.int64))), size, len(words)) for h in found]
            if rows:
                yield arrow_rows(out, list(zip(*rows, strict=True)))

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null")
    return rows.mapInArrow(each, "item_id long, h long, size int, words int").distinct()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: best local score and the place just after its last passage word."""
    gaps = GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        move = np.where(passage == w, MATCH, MISMATCH)
        new = np.maximum(row - GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + move)
        row = np.maximum.accumulate(new + gaps) - gaps  # gaps along the passage
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def best_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """(score as a share of the item's best possible, first word, word after the last) in the passage."""
    best, end = align(item, passage)
    _, back = align(item[::-1], passage[:end][::-1])
    return best / (MATCH * max(len(item), 1)), end - back, end


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, rare: float = RARE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): each document with a passage that aligns with an item, best passage of each pair.

    Words are lower-cased runs of letters, digits and underscores. Null and empty texts match nothing; an item of fewer than n
    words is found where it stands whole, a null or empty one nowhere. Rows with a null id are searched and have a null doc_id; repeated rows give one pair.
    Extra columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    grams = materialize(item_grams(benchmark, n, item_col, item_text_col), "grams")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Items of like length are a class: so far apart may hits of one passage lie, and so many words are cut around them.
    kinds = grams.groupBy("size", F.expr("cast(ceil(log2(words)) as int)").alias("kind")).agg(F.max("words").alias("pad")).collect()  # a row for each doubling of the words
    sizes = sorted({r["size"] for r in kinds})
    screen = bit_table(grams.select("h"))
    counted = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(1).to_pylist():
                hashes = word_hashes(_words(text))
                for size in sizes:
                    h = gram_hashes(hashes, size)
                    found.append(h[passes(screen.value, h)])
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            yield arrow_rows(counted, [values.view(np.int64), counts.astype(np.int64)])

    counts = rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    known = grams.join(counts, "h")
    order = Window.partitionBy("item_id").orderBy("n", "h")
    ranked = known.withColumn("place", F.row_number().over(order)).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    seeds = ranked.where(F.col("place") <= F.ceil(F.col("all") * rare)).select("item_id", "h", "size", F.expr("cast(ceil(log2(words)) as int)").alias("kind"))
    seeds = materialize(seeds, "seeds")
    screens = [(r["size"], r.kind, r.pad, bit_table(seeds.where((F.col("size") == r["size"]) & (F.col("kind") == r.kind)).select("h"))) for r in kinds]
    release(spark)
    made = pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("passage", pa.string()), ("hits", pa.list_(pa.int64()))])

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _words(text)
                hashes = word_hashes(words)
                grams_ = {size: gram_hashes(hashes, size) for size in sizes}
                for size, kind, pad, bits in screens:
                    h = grams_[size]
                    at = np.flatnonzero(passes(bits.value, h))
                    if not len(at):
                        continue
                    for group in np.split(at, np.flatnonzero(np.diff(at) > pad) + 1):
                        a, b = max(int(group[0]) - pad, 0), int(group[-1]) + size + pad
                        out.append((doc_id, kind, a, " ".join(words[a:b]), np.unique(h[group]).view(np.int64).tolist()))
            if out:
                yield arrow_rows(made, list(zip(*out, strict=True)))

    passages = rows.mapInArrow(cut, "doc_id long, kind int, start long, passage string, hits array<long>")
    passages = materialize(passages.withColumn("pid", F.monotonically_increasing_id()), "passages")
    release(spark)
    pairs = passages.select("pid", "kind", F.explode("hits").alias("h")).join(seeds, ["h", "kind"]).select("pid", "item_id").distinct()
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).dropDuplicates(["item_id", "item"])
    joined = pairs.join(passages.select("pid", "doc_id", "start", "passage"), "pid").join(items, "item_id").select("doc_id", "item_id", "start", "passage", "item")
    scored = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def score(batches):
        for batch in batches:
            out = []
            for doc_id, item_id, start, passage, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, first, end = best_alignment(word_hashes(_words(item)), word_hashes(passage.split(" ")))
                if s >= least:
                    out.append((doc_id, item_id, round(s, 6), start + first, start + end))
            if out:
                yield arrow_rows(scored, list(zip(*out, strict=True)))

    found = joined.mapInArrow(score, "doc_id long, item_id long, score double, first_word long, end_word long")
    best = F.max(F.struct(F.col("score"), (-F.col("first_word")).alias("f"), "end_word"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", (-F.col("b.f")).alias("first_word"), "b.end_word")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
