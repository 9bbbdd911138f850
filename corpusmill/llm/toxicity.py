"""Toxicity by a classifier chain of linear models.

Categories are predicted in order. The model of a category sees a text's words and word beginnings and the log-odds that
the models before it give; in training those come out of fold, so a later model learns from predictions as good as it will
meet, not from ones fitted to the same rows. Fitting uses a bounded sample of labelled rows; scoring covers every row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, discard, materialize

#: Labelled rows that are fitted on at most; features of a category at most; rows of a feature at least; its chi-square at least.
SAMPLE, FEATURES, ROWS, CHI2 = 12_000, 400, 5, 25.0
#: Letters of a word beginning, a feature beside the word itself.
BEGIN = 4
FOLDS, STEPS, DECAY = 5, 120, 3e-4
#: Loss of F1 for which a threshold nearer to a half is taken.
SLACK = 0.02
SEED = 42

_find = re.compile(r"\w+").findall


def features_of(text: str | None) -> set[str]:
    """The words, and as ^begin the beginnings of longer ones."""
    words = set(_find((text or "").lower()))
    return words | {"^" + b for b in {w[:BEGIN] for w in words if len(w) > BEGIN}}


@dataclass
class Link:
    """One category's model: word weights, weights of the earlier log-odds, bias, decision threshold."""

    name: str
    weights: dict[str, float]
    earlier: list[float]
    bias: float
    threshold: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by accelerated gradient steps in single precision; the last column is the bias. One class only: the smoothed prior."""
    out = np.zeros(x.shape[1], np.float32)
    rate = (y.sum() + 1) / (len(y) + 2)
    out[-1] = np.log(rate / (1 - rate))
    if not 0 < y.sum() < len(y):
        return out
    step = np.float32(4 / (float(np.einsum("ij,ij->", x, x)) / len(y) + 1e-9))
    v, t = out.copy(), 1.0
    keep = np.full(x.shape[1], DECAY, np.float32)
    keep[-1] = 0
    for _ in range(STEPS):
        gap = (_sigmoid(x @ v) - y).astype(np.float32) / np.float32(len(y))
        new, t2 = v - step * (gap @ x + keep * v), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, out, t = new + np.float32((t - 1) / t2) * (new - out), new, t2
    return out


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of the thresholds with nearly the best out-of-fold F1, the one nearest to a half."""
    if not y.any():
        return 0.5
    grid = np.arange(0.1, 0.91, 0.02)
    f1 = np.array([2 * ((p >= t) & (y == 1)).sum() / max((p >= t).sum() + y.sum(), 1) for t in grid])
    return float(min(grid[f1 >= f1.max() - SLACK], key=lambda t: abs(t - 0.5)))


def _group(words: set[str]) -> str:
    """What near copies share: a text's longest words. Texts of a group are in one fold, so that no copy of a held-out text is fitted on."""
    return " ".join(sorted(words, key=lambda w: (-len(w), w))[:3])


def train(rows: Sequence[np.ndarray], labels: Sequence[tuple[int, ...]], vocabularies: dict[str, list[str]], folds: Sequence[int]) -> list[Link]:
    """rows: places in the sorted union of the vocabularies; labels: 0/1 per category; vocabularies: each category's features, in chain order; folds: 0 to FOLDS - 1."""
    union = sorted(set().union(*vocabularies.values()))
    y = np.array(labels, dtype=np.float32).reshape(len(rows), len(vocabularies))
    fold = np.array(folds, dtype=np.int64)
    before, chain = np.zeros((len(rows), 0), np.float32), []
    for k, (name, vocabulary) in enumerate(vocabularies.items()):
        column = np.full(len(union) + 1, -1)
        column[np.searchsorted(union, vocabulary)] = np.arange(len(vocabulary))
        full = np.zeros((len(rows), len(vocabulary) + k + 1), np.float32)
        for row, places in enumerate(rows):
            at = column[places]
            full[row, at[at >= 0]] = 1
        full[:, len(vocabulary) : -1], full[:, -1] = before, 1
        oof = np.zeros(len(rows))
        for f in range(FOLDS):
            if (fold == f).any() and (fold != f).any():
                oof[fold == f] = _sigmoid(full[fold == f] @ _fit(full[fold != f], y[fold != f, k]))
        w = _fit(full, y[:, k]) if len(rows) else np.zeros(len(vocabulary) + k + 1)
        chain.append(Link(name, {v: float(w[i]) for i, v in enumerate(vocabulary)}, [float(v) for v in w[len(vocabulary) : -1]], float(w[-1]), _threshold(oof, y[:, k])))
        before = np.hstack([before, _log_odds(oof)[:, None].astype(np.float32)])
    return chain


def predict(chain: Sequence[Link], words: set[str]) -> list[float]:
    """Each category's probability, in chain order."""
    out: list[float] = []
    odds: list[float] = []
    for link in chain:
        z = link.bias + sum(link.weights[w] for w in sorted(words & link.weights.keys())) + sum(a * o for a, o in zip(link.earlier, odds, strict=True))
        p = float(_sigmoid(np.float64(z)))
        out.append(p)
        odds.append(float(_log_odds(np.float64(p))))
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Link]:
    """Train on at most `sample` labelled rows, those with the least hash of the id; rows with a null label, a null id or no document are left out.

    Each of these rows is fitted on: a document or a label that stands twice counts twice, and rows that contradict each other
    all count; only where repeated ids make more than `sample` of them, as many are kept by the hash of the row. Without rows
    the models give one half, rows of one class its smoothed share. Features are chosen by their chi-square with each
    category, counted by Spark; the driver gets the chosen ones of each row.
    """
    names = list(categories)
    marked = labels.select(F.col(id_col).alias("_id"), *[c.cast("int").alias(n) for n, c in categories.items()]).dropna()
    n = marked.count()
    share = int(min(1.0, 1.5 * sample / max(n, 1)) * (1 << 30))
    drawn = marked.withColumn("_h", F.xxhash64("_id")).where(F.pmod("_h", F.lit(1 << 30)) <= share).orderBy("_h").limit(sample)  # sample rows at most
    bounded_batches(docs.sparkSession, 500)
    out = pa.schema([("fold", pa.int32()), ("features", pa.list_(pa.string())), *[(c, pa.int32()) for c in names]])

    def features(batches):
        for batch in batches:
            found = [features_of(t) for t in batch.column(0).to_pylist()]
            yield arrow_rows(out, [[xxhash.xxh64_intdigest(_group(f), SEED) % FOLDS for f in found], [sorted(f) for f in found], *[batch.column(k + 1) for k in range(len(names))]])

    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(drawn), "_id").select("_text", *names)
    rows = materialize(joined.mapInArrow(features, "fold int, features array<string>, " + ", ".join(f"{c} int" for c in names)), "labelled")
    if rows.count() > sample:
        rows = materialize(rows.orderBy(F.xxhash64(*rows.columns)).limit(sample), "labelled")
    total = rows.agg(F.count(F.lit(1)), *[F.sum(c) for c in names]).first()
    counts = rows.select(*names, F.explode("features").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).where(F.col("n") >= ROWS)
    counts = materialize(counts, "counts")
    vocabularies = {}
    for name, p in zip(names, total[1:], strict=True):
        n, p = float(total[0]), float(p or 0)
        gap = F.col(name) * (n - p - F.col("n") + F.col(name)) - (F.col("n") - F.col(name)) * (p - F.col(name))
        chi2 = n * gap * gap / F.greatest(F.lit(p * (n - p)) * F.col("n") * (n - F.col("n")), F.lit(1.0))
        best = counts.select("w", chi2.alias("s")).where(F.col("s") >= CHI2).orderBy(F.desc("s"), "w").limit(FEATURES)
        vocabularies[name] = [r.w for r in best.collect()]
    place = {w: i for i, w in enumerate(sorted(set().union(*vocabularies.values())))}
    packed = pa.schema([("places", pa.binary()), ("fold", pa.int32()), *[(c, pa.int32()) for c in names]])

    def pack(batches):
        for batch in batches:
            found = [np.array([place[w] for w in f if w in place], dtype="<i4").tobytes() for f in batch.column(0).to_pylist()]
            yield arrow_rows(packed, [found, *batch.columns[1:]])

    kept = rows.select("features", "fold", *names).mapInArrow(pack, "places binary, fold int, " + ", ".join(f"{c} int" for c in names))
    found = sorted((bytes(r.places), *tuple(r)[1:]) for r in kept.collect())  # sample rows at most, of FEATURES places a category
    discard(rows, counts)
    return train([np.frombuffer(r[0], dtype="<i4") for r in found], [r[2:] for r in found], vocabularies, [r[1] for r in found])


def score(docs: DataFrame, chain: list[Link], text_col: str = "text") -> DataFrame:
    """docs and p_<category> and is_<category> for each link. Null and empty texts have no words: the models' base rates.

    Whole texts are read. Repeated rows get equal scores; an empty table gives no rows. Extra columns pass through unless they have one of the new names: those are replaced.
    """
    bounded_batches(docs.sparkSession, 500)
    new = [f"{k}_{link.name}" for link in chain for k in ("p", "is")]
    docs = docs.drop(*new)
    names, at = docs.columns, docs.columns.index(text_col)
    schema = docs.select("*", *[(F.lit(0.0) if c[:2] == "p_" else F.lit(True)).alias(c) for c in new]).schema

    def each(batches):
        for batch in batches:
            found = [predict(chain, features_of(t)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            for k, link in enumerate(chain):
                p = np.array([f[k] for f in found], dtype=float)
                columns += [pa.array(p.round(6)), pa.array(p >= link.threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    return docs.mapInArrow(each, schema)


def categories() -> dict[str, Column]:
    """The chain over the columns of `labels`: poor text, toxic text, toxic but well-written text."""
    return {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "toxic_prose": (F.col("toxic") == 1) & (F.col("quality") == 1)}


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), categories())
    return score(docs, chain).drop("text")
