"""SimHash near-duplicates: vantage-point trees over Hamming space, exact links, components.

Distinct fingerprints are dealt to shards by vantage-point trees built from a bounded sample. A node holds a vantage
fingerprint, a bit mask, the radius that a link can spend under that mask, and a threshold: fingerprints within the
threshold go left, the rest right, and those on the left within the radius of the boundary visit the right side as
well. By the triangle inequality a linked pair that the boundary parts always meets on the right, so each linked pair
shares a shard. There are radius-splitting trees, one for each half of the bits: two fingerprints that differ in r bits
differ in r // 2 or fewer in one half, which thins the boundary. Shards split on by the same rule inside a task.
Copies are never paired: only distinct fingerprints are searched, and a shard gives a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, discard, materialize, release
from .components import components

#: Fingerprints read by the driver to place vantage points; the links do not depend on it.
SAMPLE = 40_000
#: Fingerprints aimed at in a shard, and shards in a tree at most: beyond it shards grow and split inside their task.
SHARD, MAX_SHARDS = 4096, 16_384
#: Rows up to which a task compares all with all in blocks.
BLOCK = 2048
SEED = 42
FULL = 0xFFFFFFFFFFFFFFFF


def shingles(tokens: list[bytes], words: int) -> np.ndarray:
    """Hashes of the shingles of one token or more, in order; all tokens are one shingle where they are words or fewer."""
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64)


def vote(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):  # bounds memory for very long texts
        bits = np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash of lower-cased (A-Z) UTF-8 text: bit set if in over half the shingle hashes."""
    tokens = (text or b"").lower().split()  # bytes split at exactly [\x20\x09-\x0D]
    return vote(shingles(tokens, words)) if tokens else 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


class Tree:
    """Nodes in arrays; node k is a leaf if left[k] < 0, with shard number ~left[k]."""

    def __init__(self) -> None:
        self.vantage: list[int] = []
        self.mask: list[int] = []
        self.radius: list[int] = []
        self.mu: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves = 0

    def _add(self) -> int:
        for column in (self.vantage, self.mask, self.radius, self.mu, self.left, self.right):
            column.append(0)
        return len(self.left) - 1

    def grow(self, points: np.ndarray, mask: int, radius: int, whole: int, aim: float, rng: np.random.Generator) -> Tree:
        """Split until a leaf holds aim points, or no split pays. (mask, radius) is this tree's metric; (FULL, whole) also bounds every link."""
        work = [(self._add(), points)]
        while work:
            node, own = work.pop()
            room = self.leaves + len(work) + 1 < MAX_SHARDS
            choice = _best_split(own, ((mask, radius), (FULL, whole)), rng) if room and len(own) > max(aim, 8) else None
            if choice is None:
                self.left[node] = ~self.leaves
                self.leaves += 1
                continue
            v, m, r, mu, near, right = choice
            self.vantage[node], self.mask[node], self.radius[node], self.mu[node] = v, m, r, mu
            self.left[node], self.right[node] = self._add(), self._add()
            work += [(self.left[node], own[near]), (self.right[node], own[right])]
        return self

    def deal(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, indexes of points) for each shard that a point owns or visits."""
        work = [(0, np.arange(len(points)))]
        while work:
            node, own = work.pop()
            if not len(own):
                continue
            if self.left[node] < 0:
                yield ~self.left[node], own
                continue
            near, right = _sides(points[own], self.vantage[node], self.mask[node], self.radius[node], self.mu[node])
            work += [(self.left[node], own[near]), (self.right[node], own[right])]


def _sides(points: np.ndarray, v: int, mask: int, radius: int, mu: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count((points ^ np.uint64(v)) & np.uint64(mask)).astype(np.int64)
    return d <= mu, d > mu - radius


def _best_split(points: np.ndarray, metrics, rng: np.random.Generator, tries: int = 6):
    """The vantage point, metric and threshold with the least sum of squared sides; None if none saves a twentieth."""
    best, least = None, 0.95 * float(len(points)) ** 2
    for v in rng.choice(points, tries).tolist():
        for mask, radius in metrics:
            d = np.bitwise_count((points ^ np.uint64(v)) & np.uint64(mask)).astype(np.int64)
            below = np.cumsum(np.bincount(d, minlength=65))
            for mu in range(65):
                left = int(below[mu])
                right = len(points) - (int(below[mu - radius]) if mu >= radius else 0)
                if 0 < left < len(points) and float(left) ** 2 + float(right) ** 2 < least:
                    best, least = (v, mask, radius, mu), float(left) ** 2 + float(right) ** 2
    return None if best is None else (*best, *_sides(points, *best))


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """label after joining the pairs (a, b): the least index of each component so far. label is flat: label[label] is label.

    Only roots are hooked, each on a lower one, and then all is made flat again: no link found before is lost.
    """
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


def local_links(points: np.ndarray, radius: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as stars) of the links between distinct points, exact."""
    label = np.arange(len(points))
    rng = np.random.default_rng(seed)
    pool = points if len(points) <= 20_000 else rng.choice(points, 20_000, replace=False)
    if len(points) > BLOCK:
        tree = Tree().grow(pool, FULL, radius, radius, BLOCK * len(pool) / len(points), rng)
        groups = (own for _, own in tree.deal(points))
    else:
        groups = iter([np.arange(len(points))])
    held, pairs = [], 0
    for own in groups:
        p = points[own]
        for k in range(0, len(p), 256):
            near = np.bitwise_count(p[k : k + 256, None] ^ p[None, k:]) <= radius
            a, b = np.nonzero(near)
            keep = a < b
            held.append((own[a[keep] + k], own[b[keep] + k]))
            pairs += int(keep.sum())
            if pairs > len(points):  # joining costs as much as the points: never for fewer links
                label, held, pairs = _forest(*map(np.concatenate, zip(*held, strict=True)), label), [], 0
    if pairs:
        label = _forest(*map(np.concatenate, zip(*held, strict=True)), label)
    member = np.nonzero(label != np.arange(len(points)))[0]
    return points[member], points[label[member]]


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, text_hash long) for every row; null and blank texts have fingerprint 0."""
    bounded_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64())])

    def each(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield arrow_rows(out, [batch.column(0), _signed(fps), batch.column(2)])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(each, "doc_id long, fp long, text_hash long")


def linked(distinct: DataFrame, radius: int = 3, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """distinct(fp) -> (a, b): spanning forests of every link at radius or fewer differing bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    drawn = [r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(sample).collect()] if n > sample else [r[0] for r in distinct.collect()]
    drawn = np.array(drawn, dtype=np.int64).view(np.uint64)
    rng = np.random.default_rng(SEED)
    aim = max(shard, n / MAX_SHARDS) * len(drawn) / max(n, 1)
    low = 0x00000000FFFFFFFF
    trees = [Tree().grow(drawn, low, radius // 2, radius, aim, rng), Tree().grow(drawn, FULL ^ low, radius // 2, radius, aim, rng)]
    dealt = pa.schema([("shard", pa.int32()), ("fp", pa.int64())])

    def deal(batches):
        for batch in batches:
            points = np.asarray(batch.column(0)).view(np.uint64)
            base, ids, fps = 0, [], []
            for tree in trees:
                for k, own in tree.deal(points):
                    ids.append(np.full(len(own), base + k, dtype=np.int32))
                    fps.append(points[own])
                base += tree.leaves
            if ids:
                yield arrow_rows(dealt, [np.concatenate(ids), _signed(np.concatenate(fps))])

    def link(table: pa.Table) -> pa.Table:
        a, b = local_links(np.unique(np.asarray(table.column("fp")).view(np.uint64)), radius)
        return pa.table({"a": _signed(a), "b": _signed(b)})

    bounded_batches(spark)
    return distinct.select("fp").mapInArrow(deal, "shard int, fp long").groupBy("shard").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp long, text_hash, component_id, root) per row of docs; root is the component's least fingerprint.

    Rows with equal fingerprints, or chained by fingerprints at radius or fewer differing bits, form a component, named by
    its smallest doc_id. Null or blank text: fingerprint 0, linked like any other. A row with a null id keeps its place and
    gets the smallest id of its component (null if there is none). Repeated rows stay. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    fps = materialize(fingerprints(docs, words, id_col, text_col), "simhash")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(linked(distinct.select("fp"), radius, sample, shard)).toDF("fp", "root")
    least = roots.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("least"))
    moved = roots.join(least, "root").select("fp", "root", "least")
    known = F.col("root").isNotNull()  # a component of one fingerprint has no row here
    named = distinct.join(moved, "fp", "left").select("fp", F.when(known, F.col("least")).otherwise(F.col("first")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "named")
    discard(distinct)
    release(spark)
    return fps.join(named, "fp").select("doc_id", "fp", "text_hash", "component_id", "root")


def representatives(found: DataFrame) -> DataFrame:
    """near_duplicates' rows -> one (doc_id, text_hash, rows) for each component: its smallest id, then text hash; null ids last.

    rows: how many rows of the table are that very document.
    """
    per = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "rows"))
    return per.groupBy("root").agg(best.alias("b")).select("b.doc_id", "b.text_hash", "b.rows")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
