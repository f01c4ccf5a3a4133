"""Hard negatives by Four-Russians scoring.

The score of two rows is the inner product of their integer components, exact.

How it goes:

1. Rows are packed once: of each component's two's complement every bit goes to a
   plane, and a plane holds one byte for eight components.  A row has as many planes
   as its own largest component needs.
2. Of an anchor all 256 subset sums of every eight components are tabled, so a
   plane's byte indexes the sum of the components whose bit is set.  Looked-up sums
   are added over the groups of eight, and planes are put together by shift and add,
   the sign's plane counting negative.
3. Anchors are taken in blocks of bounded size, which the driver hands to the tasks;
   every task scores its own rows against the block and keeps the best few of each
   anchor.  One pass finds an anchor's positives among the rows of its label, a
   second one, over the other labels, the best rows in each positive's band.
   What a task hands on does not grow with its rows.

Rows of a task come by ascending id, so a later row that ties with the last one kept
loses, and a group of equal vectors of any size costs no sorting.

Defined results: rows with a null id, label or vector, or a null component take no
part.  Of rows that repeat an id the one with the smallest label and vector counts.
Vectors of different lengths are filled up with zeros; empty ones score 0.  Components
so large that a hundredfold score might not fit a long raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import new_folder, stage
from .words import give_back

#: components of anchors handed to the tasks at once: 8 MB
BLOCK_VALUES = 1 << 20
#: rows a task scores, at least as many tasks as there are cores
TASK_ROWS = 50_000
#: anchors whose tables are in use together, and rows scored at once
_ANCHORS, _ROWS = 256, 2048

_PACKED = "vec_id long, label long, bits int, planes binary"


# -- scoring ------------------------------------------------------------------


def bits_of(values: np.ndarray) -> np.ndarray:
    """Bits of two's complement that each row of ``values`` needs."""
    if not values.shape[1]:
        return np.ones(len(values), np.int64)
    largest = np.maximum(values, ~values).max(1)
    return np.frexp(largest.astype(np.float64))[1].astype(np.int64) + 1


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit-plane bytes of rows: (row, plane, group of eight components)."""
    planes = [np.packbits(((values >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)]
    return np.stack(planes, axis=1)


class Tables:
    """Subset sums of some anchors for every group of eight components."""

    def __init__(self, anchors: np.ndarray, bits: int) -> None:
        count, dims = anchors.shape
        groups = -(-dims // 8)
        full = np.zeros((count, groups * 8), np.int64)
        full[:, :dims] = anchors
        bound = int(np.abs(full).sum(1).max(initial=0)) << bits
        self.kind = np.int32 if bound < 1 << 31 else np.int64
        by_group = full.reshape(count, groups, 8).transpose(1, 2, 0).astype(self.kind)
        self.sums = np.zeros((groups, 256, count), self.kind)
        for k in range(8):
            self.sums[:, 1 << k : 2 << k] = self.sums[:, : 1 << k] + by_group[:, k : k + 1]

    def score(self, planes: np.ndarray) -> np.ndarray:
        """Scores (row, anchor) of packed rows."""
        rows, bits, groups = planes.shape
        total = np.zeros((rows, self.sums.shape[2]), self.kind)
        looked = np.empty_like(total)
        for b in range(bits - 1, -1, -1):
            total <<= 1
            for g in range(groups):
                np.take(self.sums[g], planes[:, b, g], axis=0, out=looked, mode="clip")
                if b == bits - 1:
                    total -= looked  # the sign's plane
                else:
                    total += looked
        return total


class Best:
    """The ``k`` best (id, score) of each of many keys."""

    def __init__(self, keys: int, k: int, kind: type) -> None:
        self.low = np.iinfo(kind).min
        self.scores = np.full((keys, k), self.low, kind)
        self.ids = np.zeros((keys, k), np.int64)

    @property
    def last(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(keys):
            return
        k = self.scores.shape[1]
        touched = np.unique(keys)
        keys = np.concatenate([np.repeat(touched, k), keys])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        # int64 holds the complement of every score
        order = np.lexsort((ids, ~scores.astype(np.int64), keys))
        keys, ids, scores = keys[order], ids[order], scores[order]
        nth = np.arange(len(keys)) - np.searchsorted(keys, keys)
        top = nth < k
        self.scores[keys[top], nth[top]] = scores[top]
        self.ids[keys[top], nth[top]] = ids[top]


# -- tasks --------------------------------------------------------------------


def _steps(count: int) -> Iterator[slice]:
    """Ever larger pieces: the first few rows set a bar for all others."""
    start, step = 0, 64
    while start < count:
        yield slice(start, start + step)
        start, step = start + step, min(step * 2, _ROWS)


def _scored(batch: pa.RecordBatch, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, planes) of a batch, a piece at a time, in the order of its rows."""
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    bits = batch.column("bits").to_numpy()
    planes = np.zeros((batch.num_rows, bits.max(initial=1), groups), np.uint8)
    for n in np.unique(bits).tolist():
        at = np.flatnonzero(bits == n)
        raw = b"".join(batch.column("planes").take(pa.array(at)).to_pylist())
        planes[at, :n] = np.frombuffer(raw, np.uint8).reshape(len(at), n, groups)
        planes[at, n:] = planes[at, n - 1 : n]  # more bits of a number repeat its sign
    for some in _steps(batch.num_rows):
        yield ids[some], labels[some], planes[some]


class _Anchors:
    """A block of anchors, in groups whose tables fit a cache."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, bits: int) -> None:
        self.ids, self.labels, self.values, self.bits = ids, labels, values, bits
        self.groups = max(-(-values.shape[1] // 8), 1)

    def parts(self) -> Iterator[tuple[np.ndarray, Tables]]:
        for start in range(0, len(self.ids), _ANCHORS):
            at = np.arange(start, min(start + _ANCHORS, len(self.ids)))
            yield at, Tables(self.values[at], self.bits)


def _find_positives(block: _Anchors, most: int) -> Callable:
    """Per anchor the best other rows of its label among a task's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # anchors by label: a row meets those of its own only
        order = np.argsort(block.labels, kind="stable")
        by_label = []
        for label in np.unique(block.labels).tolist():
            mine = order[np.searchsorted(block.labels[order], label) : np.searchsorted(block.labels[order], label, "right")]
            for start in range(0, len(mine), _ANCHORS):
                at = mine[start : start + _ANCHORS]
                tables = Tables(block.values[at], block.bits)
                by_label.append((label, at, tables, Best(len(at), most, tables.kind)))
        for batch in batches:
            for ids, labels, planes in _scored(batch, block.groups):
                for label, at, tables, best in by_label:
                    same = labels == label
                    if not same.any():
                        continue
                    score, some = tables.score(planes[same]), ids[same]
                    row, key = np.nonzero(score > best.last)
                    other = some[row] != block.ids[at[key]]
                    row, key = row[other], key[other]
                    best.offer(key, some[row], score[row, key])
        for _, at, _, best in by_label:
            key, nth = np.nonzero(best.scores > best.low)
            columns = [block.ids[at[key]], best.ids[key, nth], best.scores[key, nth].astype(np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], ["anchor_id", "positive_id", "positive_score"])
        give_back()

    return work


def _find_negatives(block: _Anchors, known: np.ndarray, positive: np.ndarray, score_of: np.ndarray, most: int, low: int, high: int) -> Callable:
    """Per anchor and positive the best rows of other labels in the band, among a
    task's rows.  The arrays have a row for each anchor; ``known`` says where there is
    a positive."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = positive.shape[1]
        parts = []
        for at, tables in block.parts():
            # low * p <= 100 * n <= high * p, in whole numbers; empty without a positive
            floor, roof = -(-low * score_of[at] // 100), high * score_of[at] // 100
            missing = ~known[at]
            floor[missing], roof[missing] = 1, 0
            parts.append((at, tables, floor.astype(tables.kind), roof.astype(tables.kind), Best(len(at) * slots, most, tables.kind)))
        for batch in batches:
            for ids, labels, planes in _scored(batch, block.groups):
                for at, tables, floor, roof, best in parts:
                    score = tables.score(planes)
                    for label in np.intersect1d(labels, block.labels[at]).tolist():
                        score[np.ix_(labels == label, block.labels[at] == label)] = best.low
                    for slot in range(slots):
                        bar = best.last[slot::slots]
                        within = (score > bar) & (score >= floor[:, slot]) & (score <= roof[:, slot])
                        row, key = np.nonzero(within)
                        best.offer(key * slots + slot, ids[row], score[row, key])
        for at, _, _, _, best in parts:
            key, nth = np.nonzero(best.scores > best.low)
            anchor, slot = at[key // slots], key % slots
            columns = [block.ids[anchor], positive[anchor, slot], score_of[anchor, slot], best.ids[key, nth], best.scores[key, nth].astype(np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
        give_back()

    return work


# -- the operator -------------------------------------------------------------


def _packed(rows: DataFrame, dims: int) -> DataFrame:
    """The rows as bit planes (``vector``: array of long, filled up to ``dims``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.diff(lists.offsets.to_numpy())
            values = np.zeros((batch.num_rows, max(dims, 1)), np.int64)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            values[owner, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
            bits = bits_of(values)
            planes: list[bytes] = [b""] * batch.num_rows
            for n in np.unique(bits).tolist():
                at = np.flatnonzero(bits == n)
                for i, row in zip(at.tolist(), pack(values[at], n)):
                    planes[i] = row.tobytes()
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(bits.astype(np.int32)), pa.array(planes, pa.binary())]
            yield pa.record_batch(columns, ["vec_id", "label", "bits", "planes"])

    return rows.mapInArrow(work, _PACKED)


def _first(rows: DataFrame, by: list[str], score: str, other: str, most: int) -> DataFrame:
    ranked = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(other))
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the rows that ``is_anchor`` (a test of ``vec_id``) picks.

    ``vectors``: vec_id, label, vector (array of long).  For each anchor and each of
    its first ``positives`` other rows of the same label: the first ``negatives`` rows
    of other labels with a score between ``low`` and ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    rows = vectors.where(whole & ~F.exists("vector", lambda x: x.isNull()))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")
    # a partition of many rows would be scored by one task
    rows = stage(rows, "vectors")
    bound = rows.agg(F.count("*"), F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    count, dims, least, most = (x or 0 for x in bound)
    largest = max(-least, most)
    if dims * largest**2 * 100 >= 1 << 62:
        raise ValueError("components too large: a score might not fit a long")
    tasks = max(spark.sparkContext.defaultParallelism, -(-count // TASK_ROWS))
    packed = stage(_packed(rows, dims).repartition(tasks, "vec_id"), "planes")
    spread = packed.repartition(tasks, "vec_id").sortWithinPartitions("vec_id")

    anchors = rows.where(is_anchor)
    per_block = max(1, BLOCK_VALUES // max(dims, 1))
    blocks = max(1, -(-anchors.count() // per_block))
    folder = new_folder(spark, "negatives")
    for n in range(blocks):
        some = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toArrow()
        values = np.zeros((some.num_rows, max(dims, 1)), np.int64)
        for i, vector in enumerate(some.column("vector").to_pylist()):
            values[i, : len(vector)] = vector
        block = _Anchors(some.column("vec_id").to_numpy(), some.column("label").to_numpy(), values, largest.bit_length() + 1)
        near = spread.mapInArrow(_find_positives(block, positives), "anchor_id long, positive_id long, positive_score long")
        # as many rows as the block has anchors, times ``positives``
        found = _first(near, ["anchor_id"], "positive_score", "positive_id", positives).toArrow()
        known = np.zeros((some.num_rows, positives), bool)
        which, score = np.zeros(known.shape, np.int64), np.zeros(known.shape, np.int64)
        order = np.argsort(block.ids)
        at = order[np.searchsorted(block.ids[order], found.column("anchor_id").to_numpy())] if len(order) else order
        nth = found.column("rank").to_numpy() - 1
        known[at, nth] = True
        which[at, nth], score[at, nth] = found.column("positive_id").to_numpy(), found.column("positive_score").to_numpy()
        schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
        far = spread.mapInArrow(_find_negatives(block, known, which, score, negatives, low, high), schema)
        best = _first(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
        best.write.parquet(f"{folder}/block={n}")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return spark.read.parquet(folder).select(*columns)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = ~F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    given = rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector"))
    return hard_negatives(given, F.col("vec_id") % 50 == 0)


REFERENCE = """
WITH given AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, n.vec_id AS other_id, a.label = n.label AS same,
         CAST(list_dot_product(a.v, n.v) AS BIGINT) AS score
  FROM given a JOIN given n ON a.vec_id % 50 = 0 AND a.vec_id <> n.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
