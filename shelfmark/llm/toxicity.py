"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the hashes of its words, word pairs, and pairs with one
word between (skip-grams), each counted once however often it occurs.  Words are
lower-cased and lose punctuation at both ends.  FTRL-proximal keeps a learning
rate per coordinate and an L1 term that holds most weights at exactly zero, so
what is broadcast for scoring is the short list of the others.  The bias has no
L1 term.

Defined results: a null or empty text has the bias as its only feature and so
gets a score too; labels without a document, with a null id or a null label are
not learned from; a document labelled more than once is toxic if any label says
so; repeated rows are scored each; without any label every score is 0.5 and
``predicted`` is 1 by the contract's threshold unless another is given.  The filter
drops a row only if its own features speak for toxic, so it keeps all rows if
nothing is learned, and a row without a learned feature whatever the bias is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import SLICE_BYTES, by_slices, hashes, mixed, words_of

_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: features of a text take many times its bytes, and a stage of a pipeline shares its
#: executors with what the stages before it left
_MOST = SLICE_BYTES // 16


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled documents learned from: those with the
    smallest hash of their id.  Everything else covers all rows."""

    bits: int = 20
    sample: int = 12_000
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    positive: float = 6.0  # what a toxic document counts for: they are few


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts one after the other, with repeats, and their owners."""
    words = words_of(texts, lower=True)
    plain = pa.array([w.strip(_STRIP).lower() for w in words.vocabulary.to_pylist()], pa.string())
    one = hashes(plain)[words.codes]
    owners = words.owners
    found, of = [mixed(one)], [owners]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        if len(one) > gap:
            same = owners[:-gap] == owners[gap:]
            found.append(mixed(one[:-gap] * salt + one[gap:])[same])
            of.append(owners[:-gap][same])
    # feature 0 is the bias
    numbers = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.uint32)
    return np.maximum(numbers, 1), np.concatenate(of)


def fit(rows: list[tuple[np.ndarray, int]], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers with a weight other than zero, and those weights."""
    z = np.zeros(1 << settings.bits)
    n = np.zeros(1 << settings.bits)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        # the bias comes first in each row, as it does among all
        held = np.full(len(z), settings.l1)
        held[0] = 0.0
        free = -(z - np.sign(z) * held) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2)
        return np.where(np.abs(z) <= held, 0.0, free)

    for _ in range(settings.epochs):
        for numbers, label in rows:
            zi, ni = z[numbers], n[numbers]
            w = weights(zi, ni)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - label) * (settings.positive if label else 1.0)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / settings.alpha
            z[numbers] = zi + g - sigma * w
            n[numbers] = ni + g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept.astype(np.uint32), w[kept].astype(np.float32)


def labelled_sample(labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """At most ``limit`` documents that may be learned from: (doc_id, label)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    one = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()):
    """Weights learned from the labels for which ``learn`` (a test of doc_id) holds.

    The sample of labels is broadcast: its size is bounded by ``settings.sample``.
    Features are taken where the texts are; only theirs, as numbers, reach the driver.
    """
    bits = settings.bits
    sample = labelled_sample(labels, "toxic", learn, settings.sample)

    def numbers(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, of = features(batch.column("text"), bits)
        # once per text, in order
        unique = np.unique((of.astype(np.uint64) << np.uint64(bits)) | found)
        ends = np.searchsorted(unique >> np.uint64(bits), np.arange(batch.num_rows + 1))
        low = (unique & np.uint64((1 << bits) - 1)).astype("<u4")
        packed = [low[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        return pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "found"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInArrow(by_slices(numbers, _MOST), "doc_id long, label int, found binary").toArrow().to_pylist()
    # the order of learning is that of the ids' hashes, not of the partitions
    rows.sort(key=lambda r: (mixed(np.array([r["doc_id"]], np.int64).view(np.uint64))[0], r["found"]))
    bias = np.zeros(1, np.uint32)
    return fit([(np.concatenate([bias, np.frombuffer(r["found"], "<u4")]), r["label"]) for r in rows], settings)


def _scorer(model, bits: int):
    """A function from texts to the sums of their own weights and to scores; the
    model is shared with the executors."""
    dense: list[np.ndarray] = []

    def scores(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not dense:
            kept, values = model.value
            dense.append(np.zeros(1 << bits, np.float32))
            dense[0][kept] = values
        weights = dense[0]
        found, of = features(texts, bits)
        hit = weights[found] != 0
        unique = np.unique((of[hit].astype(np.uint64) << np.uint64(bits)) | found[hit])
        total = np.bincount(
            (unique >> np.uint64(bits)).astype(np.int64),
            weights[(unique & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.float64),
            len(texts),
        )
        return total, 1 / (1 + np.exp(-np.clip(total + weights[0], -35, 35)))

    return scores


def score(docs: DataFrame, model, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** bits short pairs
    scores = _scorer(shared, settings.bits)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), pa.array(scores(batch.column("text"))[1])], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(work, _MOST), "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """``docs``, whatever its columns, without the rows that are scored as toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~held_out, settings))
    scores = _scorer(shared, settings.bits)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, found = scores(batch.column("text"))
        return batch.filter(pa.array((found < threshold) | (own <= 0)))

    return docs.mapInArrow(by_slices(work, _MOST), docs.schema)


def fold(mod: int) -> Column:
    """crc32 of doc_id as text, modulo ``mod`` (null: as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; never learns from held-out ids."""
    model = train(docs, labels, ~held_out, settings)
    scored = score(docs, model, settings)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, fold(5) == 0)
