"""Best-fit packing by exact complements: an index of single, pair and triple sums gives the lengths that fill a gap exactly; then best fit.

The plan is made on counts of lengths, of which there are at most `capacity`, so it costs the same for any number of
documents: a plan is a short list of patterns (lengths that share a sequence) with a number of uses. Pieces are ranked
within their length by a salted window and look their pattern up by rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, materialize
from .tokens import END, encoder

CAPACITY = 1024


class Sums:
    """Lengths by the sum of one, two or three of them, for sums below capacity.

    pairs[s] holds every (a, b) with a >= b and a + b = s, most even first, or most uneven first. A triple is kept as a length
    and the key of a pair sum, so the index has capacity**2 entries at most, not capacity**3.
    """

    def __init__(self, lengths: np.ndarray, capacity: int, even: bool = True) -> None:
        known = np.zeros(capacity + 1, dtype=bool)
        known[lengths] = True
        self.lengths = np.sort(lengths[lengths < capacity])[:: 1 if even else -1]
        self.pairs: dict[int, np.ndarray] = {}
        for s in range(2, capacity):
            a = self.lengths[(self.lengths >= s - self.lengths) & (self.lengths < s)]
            a = a[known[s - a]]
            if len(a):
                self.pairs[s] = np.stack([a, s - a], axis=1)

    def single(self, have: np.ndarray, gap: int) -> tuple[int, ...] | None:
        return (gap,) if have[gap] > 0 else None

    def pair(self, have: np.ndarray, gap: int) -> tuple[int, ...] | None:
        found = self.pairs.get(gap)
        if found is None:
            return None
        a, b = found[:, 0], found[:, 1]
        fits = (have[a] > 0) & (have[b] > (a == b))
        k = int(fits.argmax())
        return (int(a[k]), int(b[k])) if fits[k] else None

    def triple(self, have: np.ndarray, gap: int) -> tuple[int, ...] | None:
        for a in self.lengths[(3 * self.lengths >= gap) & (self.lengths < gap)].tolist():
            if have[a] <= 0 or gap - a not in self.pairs:
                continue
            b, c = self.pairs[gap - a].T
            fits = (b <= a) & (have[b] > (b == a)) & (have[c] > (c == b).astype(int) + (c == a))
            k = int(fits.argmax())
            if fits[k]:
                return a, int(b[k]), int(c[k])
        return None


#: Shares of the capacity. A plan fills gaps of more than such a share by pairs and triples, the largest first, and leaves smaller
#: ones to best fit; where pieces are few, exact fills of small gaps use up the short pieces that best fit needs.
LEAST_GAPS = (0.0, 0.2, 0.3, 0.36, 0.4, 0.44, 0.47, 0.495)


def plan_patterns(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """counts[length] pieces of each length 1..capacity -> (uses, lengths) patterns that take every piece once.

    Every plan takes exact complements of one, two and three lengths from the index and packs the rest by best fit. Of the
    plans for LEAST_GAPS, even and uneven pairs first, that with the fewest sequences is kept; of equal ones the first.
    """
    lengths = np.flatnonzero(counts)
    indexes = [Sums(lengths, capacity, even) for even in (True, False)]
    plans = (_plan(counts, capacity, index, int(share * capacity)) for share in LEAST_GAPS for index in indexes)
    return min(plans, key=lambda plan: sum(uses for uses, _ in plan))


def _plan(counts: np.ndarray, capacity: int, index: Sums, least: int) -> list[tuple[int, list[int]]]:
    have = np.array(counts, dtype=np.int64)
    patterns: list[tuple[int, list[int]]] = []
    if have[capacity]:
        patterns.append((int(have[capacity]), [capacity]))
        have[capacity] = 0

    def fill(length: int, find) -> None:
        while have[length] > 0:
            have[length] -= 1  # one is placed; the rest of its length may complete it
            found = find(have, capacity - length)
            have[length] += 1
            if found is None:
                return
            pattern = [length, *found]
            uses = min(int(have[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                have[x] -= uses
            patterns.append((uses, pattern))

    for length in range(capacity - 1, (capacity - 1) // 2, -1):  # the longer of two complements
        fill(length, index.single)
    for find in (index.pair, index.triple):
        for length in range((capacity + 1) // 2, capacity - least):
            fill(length, find)
    return patterns + _best_fit(have, capacity)


def _best_fit(have: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing on counts: bins of one content are one entry with a number of uses."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left > 0:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                fit = capacity // length
                uses, fit = (left // fit, fit) if left >= fit else (1, left)
                open_.setdefault(capacity - fit * length, []).append((uses, [length] * fit))
                left -= uses * fit
                continue
            uses, content = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            fit = min(gap // length, left)
            take = min(uses, left // fit)
            if uses > take:
                open_.setdefault(gap, []).append((uses - take, content))
            open_.setdefault(gap - fit * length, []).append((take, content + [length] * fit))
            left -= take * fit
    return [entry for entries in open_.values() for entry in entries]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end id, cut where longer than capacity.

    All pieces but the first are of capacity. Null text is empty: one piece of the end id.
    """
    bounded_batches(docs.sparkSession, 500)
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = END.to_bytes(4, "little")

    def cut(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text) + end)
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    rows.append((doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
            if rows:
                yield arrow_rows(out, list(zip(*rows, strict=True)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, salt_rows: int = 200_000) -> DataFrame:
    """pieces(doc_id, piece, length, ...) -> the same rows with sequence_id and offset.

    Every piece is placed once, offsets in a sequence are gapless from 0, and no sequence is over capacity. Lengths must be
    1..capacity. A length that holds most rows is ranked in many salted groups. Repeated rows are pieces of their own; an
    empty table gives no rows.
    """
    pieces = materialize(pieces, "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # a row for each length
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens; the capacity is {capacity}")
        counts[length] = n
    starts, bases, offsets, sequence, cursor = [], [], [], 0, np.zeros(capacity + 1, dtype=np.int64)
    for uses, lengths in plan_patterns(counts, capacity):
        at = 0
        for length in lengths:
            starts.append((length << 44) + int(cursor[length]))
            bases.append(sequence)
            offsets.append(at)
            cursor[length] += uses
            at += length
        sequence += uses
    order = np.argsort(np.array(starts, dtype=np.int64))
    starts, bases, offsets = (np.array(x, dtype=np.int64)[order] for x in (starts, bases, offsets))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        k = np.searchsorted(starts, key, side="right") - 1
        return pd.DataFrame({"sequence_id": bases[k] + key - starts[k], "offset": offsets[k]})

    salts = max(256, int(counts.sum()) // salt_rows)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("_rank", within.cast("long")).join(groups, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    return ranked.withColumn("_at", place("length", "_rank")).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs))
