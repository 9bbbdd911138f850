"""Repeated spans of words, found by compaction of a de Bruijn graph and cut out of documents.

A window is `window` consecutive words. Its anchor is its least-hash k-mer; windows of one document that share an
anchor are neighbours and form a run (a super k-mer), and the words of a run are an edge of the graph between the
anchors on either side. Equal windows have equal anchors, so only runs whose anchor occurs again can hold a repeated
window. Such runs are counted as edges:
  an edge that occurs twice or more is repeated as a whole; edges that follow each other wherever either occurs are
  joined into one nonbranching path, by pointer jumping through Spark joins, and a path is carried to the documents
  as one span for each occurrence of its head;
  an edge that occurs once beside other edges of its anchor is compared with them window by window.
The cut runs over the source text: it finds a span's words by its coordinates and checks the hash of its last edge.
Hashes are pairs of 64 bits (anchor and content).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, release

WINDOW, K = 35, 12
BASE, BASE2, MIX, MIX2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
M64 = (1 << 64) - 1


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.step, self.back = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, self.step))))
            self.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, self.back))))
        return self.up[:n], self.down[:n]


_powers = {BASE: _Powers(BASE), BASE2: _Powers(BASE2)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any span of one document's words."""

    def __init__(self, words: list[bytes]) -> None:
        digest = xxhash.xxh64_intdigest
        self.n = len(words)
        self.hash = np.fromiter((digest(w) for w in words), np.uint64, self.n)
        self.sums = {b: np.concatenate(([np.uint64(0)], np.cumsum(self.hash * p.to(self.n)[0]))) for b, p in _powers.items()}

    def at(self, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        sums = self.sums[base]
        return _mixed((sums[end] - sums[start]) * _powers[base].to(self.n + 1)[1][start] + (end - start).astype(np.uint64) * np.uint64(MIX2))


class Runs:
    """The runs of one document: window starts first..last, anchor hash, content hash."""

    def __init__(self, words: list[bytes], window: int, k: int) -> None:
        windows = len(words) - window + 1
        self.spans = None
        if windows < 1:
            self.first = self.last = np.zeros(0, dtype=np.int64)
            self.anchor = self.content = np.zeros(0, dtype=np.uint64)
            return
        self.spans = Spans(words)
        at = np.arange(len(words) - k + 1)
        kmers = self.spans.at(at, at + k, BASE)
        place = np.arange(windows) + _least(kmers, window - k + 1)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        self.first = starts
        self.last = np.concatenate((starts[1:], [windows])) - 1
        self.anchor = kmers[place[starts]]
        self.content = self.spans.at(self.first, self.last + window, BASE2)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each stretch of width values, in blocks that bound memory."""
    views = np.lib.stride_tricks.sliding_window_view(values, width)
    return np.concatenate([views[i : i + 262_144].argmin(axis=1) for i in range(0, len(views), 262_144)])


def _keyed(docs: DataFrame, id_col: str, text_col: str, key: str = "_k", id_: str = "_d") -> DataFrame:
    """docs with a key (MD5 of the text) and an id that is never null: what a row's spans are joined by."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(key, F.unhex(F.md5(text.cast("binary")))).withColumn(id_, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))


def scan_runs(docs: DataFrame, window: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(rid, _k, _d, runs array<(mh, rh)>) for each row with a window."""
    bounded_batches(docs.sparkSession, 500)
    out = pa.schema([("_k", pa.binary()), ("_d", pa.int64()), ("mh", pa.list_(pa.int64())), ("rh", pa.list_(pa.int64()))])

    def scan(batches):
        for batch in batches:
            keep, sizes, mh, rh = [], [0], [], []
            for place, text in enumerate(batch.column(2).to_pylist()):
                runs = Runs((text or b"").split(), window, k)  # bytes split at exactly [\x20\x09-\x0D]
                if len(runs.first):
                    keep.append(place)
                    sizes.append(sizes[-1] + len(runs.first))
                    mh.append(runs.anchor.view(np.int64))
                    rh.append(runs.content.view(np.int64))
            if keep:
                offsets = pa.array(sizes, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (mh, rh)]
                kept = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(kept).cast(pa.binary()), batch.column(1).take(kept), *lists], schema=out)

    rows = _keyed(docs.select(id_col, text_col), id_col, text_col).select("_k", "_d", F.col(text_col).cast("string").cast("binary"))
    scanned = rows.mapInArrow(scan, "_k binary, _d long, mh array<long>, rh array<long>")
    return materialize(scanned.withColumn("rid", F.monotonically_increasing_id()), "runs")


def _paths(edges: DataFrame) -> DataFrame:
    """edges(mh, rh, next, prev): repeated edges with the one edge that always follows or precedes -> (mh, rh, len, tail): path heads.

    List ranking: each edge's pointer skips to its successor's pointer until it passes the tail; edges left on a cycle are paths
    of their own.
    """
    spark = edges.sparkSession
    link = edges.select(F.col("mh").alias("_m"), F.col("rh").alias("_r"), F.col("prev").alias("_p"))
    here = F.struct(F.col("mh"), F.col("rh"))
    joined = edges.join(link, (F.col("next.mh") == F.col("_m")) & (F.col("next.rh") == F.col("_r")), "left")
    chain = joined.select("mh", "rh", F.when(F.col("_p") == here, F.col("next")).alias("to"))
    chain = materialize(chain.select("mh", "rh", "to", F.lit(1).cast("long").alias("len"), F.col("rh").alias("tail")), "chain")
    followed = chain.where("to is not null").select("to.mh", "to.rh")
    first, open_ = chain, chain.where("to is not null").count()
    while open_:
        ahead = chain.select(F.col("mh").alias("_m"), F.col("rh").alias("_r"), F.col("to").alias("_to"), F.col("len").alias("_len"), F.col("tail").alias("_tail"))
        stepped = chain.join(ahead, (F.col("to.mh") == F.col("_m")) & (F.col("to.rh") == F.col("_r")), "left")
        before, chain = chain, materialize(stepped.select("mh", "rh", F.col("_to").alias("to"), (F.col("len") + F.coalesce("_len", F.lit(0))).alias("len"), F.coalesce("_tail", "tail").alias("tail")), "chain")
        if before is not first:
            discard(before)
        left = chain.where("to is not null").count()
        release(spark)
        if left == open_:
            break
        open_ = left
    heads = chain.where("to is null").join(followed, ["mh", "rh"], "left_anti").select("mh", "rh", "len", "tail")
    if not open_:
        return heads
    looped = chain.where("to is not null").select("mh", "rh", F.lit(1).cast("long").alias("len"), F.col("rh").alias("tail"))
    return heads.unionByName(looped)


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k, _d, spans array<(run, len, tail, mask)>) for each text and id with a repeated window.

    A span is `len` whole runs from run number `run`, the last with content hash `tail`; or, len 0, the windows of one run
    whose bits are set in mask.
    """
    spark = docs.sparkSession
    if not 0 < k <= window or window - k + 1 > 62:
        raise ValueError("k must be at most window, and window - k at most 61")
    scanned = scan_runs(docs, window, k, id_col, text_col)
    runs = scanned.select("rid", F.posexplode(F.arrays_zip("mh", "rh")).alias("run", "e")).select("rid", "run", "e.mh", "e.rh")
    anchors = runs.groupBy("mh").agg(F.count(F.lit(1)).alias("n"), F.min("rh").alias("lo"), F.max("rh").alias("hi")).where("n > 1")
    anchors = materialize(anchors.select("mh", F.expr("lo <> hi").alias("contested")), "anchors")
    release(spark)
    live = materialize(runs.join(anchors, "mh").select("rid", "run", "mh", "rh", "contested"), "live")
    discard(anchors)
    release(spark)
    by_row = Window.partitionBy("rid").orderBy("run")
    edge = F.struct("mh", "rh")
    near = live.select("*", F.when(F.lag("run").over(by_row) == F.col("run") - 1, F.lag(edge).over(by_row)).alias("p"), F.when(F.lead("run").over(by_row) == F.col("run") + 1, F.lead(edge).over(by_row)).alias("f"))
    only = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c))
    edges = near.groupBy("mh", "rh").agg(F.count(F.lit(1)).alias("n"), F.max("contested").alias("contested"), F.min(F.struct("rid", "run")).alias("at"), only("p").alias("prev"), only("f").alias("next"))
    edges = materialize(edges, "edges")
    release(spark)

    keys = scanned.select("rid", "_k", "_d")
    wanted = edges.where("contested").select(F.col("at.rid").alias("rid"), F.struct(F.col("at.run").alias("run"), F.col("n").alias("n")).alias("r"))
    wanted = wanted.groupBy("rid").agg(F.collect_list("r").alias("runs")).join(keys, "rid")
    windows = materialize(_windows(docs, wanted, window, k, id_col, text_col), "windows")
    release(spark)
    twice = windows.groupBy("mh", "wh").agg(F.sum("n").alias("n")).where("n > 1").select("mh", "wh")
    masks = windows.where("n = 1").join(twice, ["mh", "wh"]).groupBy("rid", "run").agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask"))

    # Both written by themselves: where an edge is in a third of all rows, the join's large partitions are split only if nothing else shares its stage.
    heads = materialize(_paths(edges.where("n > 1").select("mh", "rh", "next", "prev")), "heads")
    whole = materialize(live.join(heads.hint("shuffle_hash"), ["mh", "rh"]).select("rid", F.struct("run", "len", "tail", F.lit(0).cast("long").alias("mask")).alias("s")), "whole")
    part = masks.select("rid", F.struct("run", F.lit(0).cast("long").alias("len"), F.lit(0).cast("long").alias("tail"), "mask").alias("s"))
    spans = whole.unionByName(part).groupBy("rid").agg(F.collect_list("s").alias("spans"))
    found = materialize(spans.join(keys, "rid").groupBy("_k", "_d").agg(F.first("spans").alias("spans")), "spans")
    discard(scanned, live, edges, windows, heads, whole)
    return found


def _windows(docs: DataFrame, wanted: DataFrame, window: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """wanted(rid, runs, _k, _d) -> (rid, run, place, mh, wh, n): every window of the wanted runs."""
    out = pa.schema([("rid", pa.int64()), ("run", pa.int32()), ("place", pa.int32()), ("mh", pa.int64()), ("wh", pa.int64()), ("n", pa.int64())])

    def each(batches):
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in out]
            for rid, picked, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = Runs(text.split(), window, k)
                run, n = (np.array([x[c] for x in picked], dtype=np.int64) for c in ("run", "n"))
                size = runs.last[run] - runs.first[run] + 1
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(runs.first[run], size) + place
                whole = (np.full(len(at), rid), np.repeat(run, size), place, np.repeat(runs.anchor[run].view(np.int64), size), runs.spans.at(at, at + window, BASE2).view(np.int64), np.repeat(n, size))
                for column, values in zip(columns, whole, strict=True):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    rows = _keyed(docs.select(id_col, text_col), id_col, text_col).select("_k", "_d", F.col(text_col).cast("string").cast("binary").alias("_text"))
    rows = rows.join(wanted.dropDuplicates(["rid"]).hint("shuffle_hash"), ["_k", "_d"]).select("rid", "runs", "_text")
    return rows.mapInArrow(each, "rid long, run int, place int, mh long, wh long, n long")


def cut_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and n_words, n_removed, kept (the kept words, joined by one space).

    A word goes if a window of `window` words that covers it starts anywhere else too, the same row included; windows are
    judged on the input. Null and short texts lose nothing. Repeated rows count as rows: a text of `window` words or more
    that stands in two rows goes from both. Extra columns pass through; ones named n_words, n_removed or kept are replaced,
    and names that begin with _cm_ are the operator's own. An empty table gives no rows.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    spans = repeated_spans(docs, window, k, id_col, text_col).toDF("_cm_k", "_cm_d", "_cm_spans")
    names = docs.columns
    plain = docs.select(*names, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept"))
    at = names.index(text_col)

    def each(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = _covered(words, own, window, k) if own else None
                if gone is not None:
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
                else:
                    kept.append(b" ".join(words).decode())
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    keyed = _keyed(docs, id_col, text_col, "_cm_k", "_cm_d")
    joined = keyed.join(spans.hint("shuffle_hash"), ["_cm_k", "_cm_d"], "left").select(*names, "_cm_spans")
    return joined.mapInArrow(each, plain.schema)


def _covered(words: list[bytes], spans, window: int, k: int) -> np.ndarray:
    """A flag for each word: whether a repeated window covers it. Checks each path's last edge against the text."""
    runs = Runs(words, window, k)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        run = s["run"]
        if s["len"]:
            last = run + s["len"] - 1
            if last >= len(runs.first) or int(runs.content[last].view(np.int64)) != s["tail"]:
                raise ValueError("a repeated path does not match the text at its coordinates")
            edge[runs.first[run]] += 1
            edge[runs.last[last] + window] -= 1
            continue
        for place in range(int(runs.last[run] - runs.first[run]) + 1):
            if s["mask"] >> place & 1:
                edge[runs.first[run] + place] += 1
                edge[runs.first[run] + place + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def op10_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h
  FROM w, unnest(range(1, len(ws) - 33)) AS t(s) WHERE len(ws) >= 35),
r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, s + j AS pos FROM p JOIN r USING (h), unnest(range(0, 35)) AS u(j)),
g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, gone, CASE WHEN gone IS NULL THEN ws
    ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
  FROM w LEFT JOIN g ON g.doc_id = w.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""
