"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a bounded sample of labelled texts are cut into bins at quantiles;
trees of equal depth are grown on sums of gradients per bin.  A trained forest is
three flat arrays (feature, threshold, leaf value), and texts are scored where
they are by walking all trees level by level with array arithmetic.

Defined results: null and empty texts have statistics of 0 and get a score; labels
without a document, with a null id or a null label are not learned from; a
document labelled more than once counts with its highest label; repeated rows are
scored each; without labels every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .statistics import base_statistics, ratios
from .toxicity import fold, labelled_sample
from .words import by_slices


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled documents learned from: those with the
    smallest hash of their id.  Everything else covers all rows."""

    sample: int = 20_000
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    l2: float = 1.0
    least: float = 4.0  # sum of second derivatives on each side of a split


class Forest(NamedTuple):
    """Complete trees: node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray  # to the right if above
    leaf: np.ndarray  # (trees, 2 ** depth)
    base: float


def features(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    base = base_statistics(texts)
    more = ratios(texts, base)
    columns = [np.log1p(base["n_words"]), base["n_dup_lines"], *more.values()]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def grow(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Forest:
    """Trees for logistic loss on the rows of ``x`` with labels ``y``."""
    trees, depth = settings.trees, settings.depth
    feature = np.zeros((trees, 2**depth - 1), np.int32)
    threshold = np.full((trees, 2**depth - 1), np.inf)
    leaf = np.zeros((trees, 2**depth))
    if not len(y):
        return Forest(feature, threshold, leaf, 0.0)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    # a bin ends at its edge; the last one has none
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, settings.bins + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1)
    width, d = settings.bins, x.shape[1]
    offset = np.arange(d) * width
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            count = 2**level
            first = count - 1
            cell = ((node - first)[:, None] * d * width + offset + bins).ravel()
            shape = (count, d, width)
            gs = np.bincount(cell, np.repeat(g, d), count * d * width).reshape(shape).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, d), count * d * width).reshape(shape).cumsum(2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + settings.l2) + (g_all - gs) ** 2 / (h_all - hs + settings.l2) - g_all**2 / (h_all + settings.l2)
            gain[(hs < settings.least) | (h_all - hs < settings.least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        at = node - (2**depth - 1)
        leaf[t] = settings.rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + settings.l2)
        total += leaf[t, at]
    return Forest(feature, threshold, leaf, base)


def walk(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Score of each row: all trees at once, level by level."""
    trees, inner = forest.feature.shape
    tree, row = np.arange(trees), np.arange(len(x))[:, None]
    node = np.zeros((len(x), trees), np.int64)
    for _ in range((inner + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[row, forest.feature[tree, node]] > forest.threshold[tree, node])
    return 1 / (1 + np.exp(-(forest.base + forest.leaf[tree, node - inner].sum(1))))


def train(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Forest:
    """A forest from the labels for which ``learn`` (a test of doc_id) holds.  The
    sample of labels is broadcast; only its texts' statistics reach the driver."""
    sample = labelled_sample(labels, "quality", learn, settings.sample)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column("text"))
        return pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInArrow(by_slices(work), "doc_id long, label int, x array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    if not rows:
        return grow(np.zeros((0, len(features(pa.array([""]))[0]))), np.zeros(0), settings)
    return grow(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float), settings)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    # a few thousand numbers; as a plain tuple, which a worker needs no module for
    shared = docs.sparkSession.sparkContext.broadcast(tuple(forest))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), pa.array(walk(Forest(*shared.value), features(batch.column("text"))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(work), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; never learns from held-out ids."""
    scored = score(docs, train(docs, labels, ~held_out, settings))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(4) == 2)
