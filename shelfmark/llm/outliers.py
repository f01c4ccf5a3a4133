"""Quality rules: fixed limits, then robust multivariate outliers.

Each text gives a vector of statistics, transformed so that most of a group's
texts lie in one cloud.  Per language and source the centre and the shape of that
cloud are estimated by minimum covariance determinant: of all rows, those nearest
by Mahalanobis distance are kept, mean and covariance are taken of them alone, and
distances anew (concentration steps), from two starts of which the one with the
smaller determinant wins.  After a reweighting step rows too far away are rejected.

Every step is one grouping over all rows by group: sums of products, reduced where
the rows are, and the quantile of distances from counts of a fixed grid.  Only the
solving of a group's small matrices is numpy, one row per group.

A group with fewer than ``least`` rows says too little by itself: it is judged by
its language's estimate, and a small language by that of all rows.

Defined results: a null or empty text has no words and fails the fixed limits; a
row that fails them is left out of the estimates; null language or source is a
value like any other; repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import stage
from .statistics import BASE, base_statistics, ratios
from .words import by_slices

#: statistics and their units: the least standard deviation that a group is taken to
#: have.  Most texts have no symbol, digit or repeated line at all, and a spread near 0
#: would reject each text that has one.
UNITS = {
    "word_length": 0.15,  # of the logarithm
    "symbols": 0.05,  # a word
    "dup_lines": 0.1,
    "repeats": 0.05,
    "digits": 0.04,
    "capitals": 0.03,  # of the square root, as the next two
    "stops": 0.03,
    "commas": 0.03,
    "others": 0.05,
}
VECTOR = tuple(UNITS)
_ROOTS = ("capitals", "stops", "commas")
_D = len(VECTOR)
#: cells of the grid of distances, on a log scale
_GRID = 2000


@dataclass(frozen=True)
class Settings:
    share: float = 0.75  # of a group's rows, in the concentration steps
    steps: int = 4
    cutoff: float = 1e-3  # share of a normal cloud that may lie beyond the limit
    least: int = 300
    floor: float = 1.0  # least standard deviation, in units
    min_words: int = 50
    max_repeat_percent: int = 50


def chi2_quantile(p: float, d: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return d * (1 - 2 / (9 * d) + z * np.sqrt(2 / (9 * d))) ** 3


def transformed(values: dict[str, np.ndarray]) -> np.ndarray:
    """Statistics as rows of a matrix, in their units: the logarithm of a length, the
    square roots of shares that all texts have, other shares as they are."""

    def column(name: str) -> np.ndarray:
        if name == "word_length":
            return np.log(np.maximum(values[name], 0.1))
        return np.sqrt(np.maximum(values[name], 0)) if name in _ROOTS else values[name]

    return np.stack([column(name) / unit for name, unit in UNITS.items()], axis=1)


def measured(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, lang, source, the base statistics, base_failed, x) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        base = base_statistics(texts)
        x = transformed(ratios(texts, base))
        failed = (base["n_words"] < settings.min_words) | (100 * base["n_repeat_words"] > settings.max_repeat_percent * base["n_words"])
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), _D).cast(pa.list_(pa.float64()))
        columns = [*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(base[b]) for b in BASE), pa.array(failed), vectors]
        return pa.record_batch(columns, ["doc_id", "lang", "source", *BASE, "base_failed", "x"])

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    counts = ", ".join(f"{b} long" for b in BASE)
    return rows.mapInArrow(by_slices(work), f"doc_id long, lang string, source string, {counts}, base_failed boolean, x array<double>")


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, level, mates): the group whose estimate judges these rows, and
    the key of each estimate they enter."""
    sizes = rows.groupBy("lang", "source").count()
    langs = sizes.groupBy("lang").agg(F.sum("count").alias("in_lang"))
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    both = sizes.join(langs.withColumnRenamed("lang", "_lang"), same).drop("_lang")
    own = F.col("count") >= least
    return both.select("lang", "source", F.when(own, 2).when(F.col("in_lang") >= least, 1).otherwise(0).alias("level"))


def _key(level: Column, lang: str = "lang", source: str = "source") -> Column:
    """Name of an estimate: all rows, a language, or a language and source."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return F.to_json(F.array(F.when(level > 0, part(lang)), F.when(level > 1, part(source))))


def _distance(x: str, centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; ``inverse`` holds the upper triangle by rows,
    with the terms off the diagonal doubled."""
    gaps = [F.get(F.col(x), F.lit(i)) - F.get(centre, F.lit(i)) for i in range(_D)]
    total, k = F.lit(0.0), 0
    for i in range(_D):
        for j in range(i, _D):
            total = total + gaps[i] * gaps[j] * F.get(inverse, F.lit(k))
            k += 1
    return total


def _cell(distance: Column) -> Column:
    """Grid cell of a squared distance: 100 cells for each factor of e."""
    return F.least(F.greatest(F.floor(F.log(F.greatest(distance, F.lit(1e-6))) * 100) + 600, F.lit(0)), F.lit(_GRID)).cast("int")


def _moments(rows: DataFrame, weight: Column) -> DataFrame:
    """Count, sums and sums of products of x, by estimate."""
    at = [F.get("x", F.lit(i)) for i in range(_D)]
    terms = at + [at[i] * at[j] for i in range(_D) for j in range(i, _D)]
    sums = F.array(*[F.sum(F.when(weight, t)) for t in terms])
    return rows.groupBy("key").agg(F.sum(weight.cast("long")).alias("n"), sums.alias("sums"))


_SOLVED = "key string, centre array<double>, inverse array<double>, det double"


def solved(n: np.ndarray, sums: np.ndarray, floor: float, spherical: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, inverse covariance (upper triangle, doubled off the diagonal), and log
    determinant.  A variance is at least ``floor`` squared."""
    n = np.maximum(n, 1)[:, None]
    centre = sums[:, :_D] / n
    upper = np.triu_indices(_D)
    cov = np.zeros((len(n), _D, _D))
    cov[:, upper[0], upper[1]] = sums[:, _D:] / n - centre[:, upper[0]] * centre[:, upper[1]]
    cov = cov + np.triu(cov.transpose(0, 2, 1).swapaxes(1, 2), 1).transpose(0, 2, 1)
    if spherical:
        cov = cov * np.eye(_D)
    values, vectors = np.linalg.eigh(cov + floor**2 * np.eye(_D))
    values = np.maximum(values, floor**2)
    inverse = (vectors / values[:, None, :]) @ vectors.transpose(0, 2, 1)
    weights = np.where(upper[0] == upper[1], 1.0, 2.0)
    return centre, inverse[:, upper[0], upper[1]] * weights, np.log(values).sum(1)


def _solve(moments: DataFrame, settings: Settings, spherical: bool = False) -> DataFrame:
    floor = settings.floor

    def work(batches):
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            sums = np.array([np.nan_to_num(np.array(s, float)) for s in batch.column("sums").to_pylist()]).reshape(len(n), -1)
            centre, inverse, det = solved(n, sums, floor, spherical)
            yield pa.record_batch(
                [batch.column("key"), pa.array(list(centre)), pa.array(list(inverse)), pa.array(det)], ["key", "centre", "inverse", "det"]
            )

    return moments.mapInArrow(work, _SOLVED)


def _limits(rows: DataFrame, share: float) -> DataFrame:
    """(key, limit): the grid cell that the nearest ``share`` of rows reach."""
    from pyspark.sql import Window

    cells = rows.groupBy("key", "cell").count()
    upto = F.sum("count").over(Window.partitionBy("key").orderBy("cell"))
    whole = F.sum("count").over(Window.partitionBy("key"))
    reached = cells.withColumns({"upto": upto, "whole": whole}).where(F.col("upto") >= F.col("whole") * share)
    return reached.groupBy("key").agg(F.min("cell").alias("limit"))


def _concentrated(rows: DataFrame, model: DataFrame, settings: Settings) -> DataFrame:
    """One concentration step from an estimate to the next."""
    near = rows.join(model, "key").withColumn("cell", _cell(_distance("x", F.col("centre"), F.col("inverse")))).select("key", "x", "cell")
    limits = stage(_limits(near, settings.share), "limits")
    return stage(_solve(_moments(near.join(limits, "key"), F.col("cell") <= F.col("limit")), settings), "model")


def estimates(rows: DataFrame, settings: Settings) -> DataFrame:
    """(key, centre, inverse) by minimum covariance determinant.

    ``rows``: key, x.  Starts: medians with the spread around them, and all rows.
    The covariance is widened until its median distance is not above that of a normal
    cloud.  It is not narrowed: where a spread is below its unit the unit counts, and
    distances are small by intent.
    """
    medians = rows.groupBy("key").agg(*[F.percentile_approx(F.get("x", F.lit(i)), 0.5, 1000).alias(f"m{i}") for i in range(_D)])
    medians = stage(medians.select("key", F.array(*[f"m{i}" for i in range(_D)]).alias("middle")), "medians")
    # around the medians, with far values drawn in: unlike a variance this is not swayed
    drawn = F.transform(F.arrays_zip("x", "middle"), lambda v: v["middle"] + F.least(F.greatest(v["x"] - v["middle"], F.lit(-3.0)), F.lit(3.0)))
    first = _moments(rows.join(medians, "key").withColumn("x", drawn), F.lit(True))
    starts = [stage(_solve(first, settings, spherical=True), "model"), stage(_solve(_moments(rows, F.lit(True)), settings), "model")]
    ends = []
    for n, model in enumerate(starts):
        for _ in range(settings.steps):
            model = _concentrated(rows, model, settings)
        ends.append(model.withColumn("start", F.lit(n)))
    best = F.min_by(F.struct("centre", "inverse"), F.struct("det", "start")).alias("best")
    chosen = ends[0].unionByName(ends[1]).groupBy("key").agg(best).select("key", "best.*")
    raw = _scaled(rows, stage(chosen, "model"))
    # reweighting: all rows within the limit that 97.5 % of a normal cloud keep
    near = rows.join(raw, "key").withColumn("d2", _distance("x", F.col("centre"), F.col("inverse")))
    again = _solve(_moments(near.select("key", "x", "d2"), F.col("d2") <= float(chi2_quantile(0.975, _D))), settings)
    return _scaled(rows, stage(again.select("key", "centre", "inverse"), "model"))


def _scaled(rows: DataFrame, model: DataFrame) -> DataFrame:
    near = rows.join(model, "key").withColumn("cell", _cell(_distance("x", F.col("centre"), F.col("inverse"))))
    middle = _limits(near.select("key", "cell"), 0.5)
    factor = float(chi2_quantile(0.5, _D)) / F.exp((F.col("limit") - 600) / 100.0)
    wide = F.least(factor, F.lit(1.0))
    scaled = model.join(middle, "key").select("key", "centre", F.transform("inverse", lambda v: v * wide).alias("inverse"))
    return stage(scaled, "model")


def quality(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, the base statistics, base_failed, kept, distance) of every row."""
    rows = stage(measured(docs, settings), "measured")
    good = rows.where("not base_failed")
    groups = stage(_groups(good, settings.least), "groups")
    key = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "level", _key(F.col("level")).alias("judge"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    marked = good.select("lang", "source", "x").join(key, same)
    # a row enters its own group's estimate, and those that judge smaller groups
    used = [_key(F.lit(level)) for level in (0, 1, 2)]
    entered = marked.select("x", F.explode(F.array(*used)).alias("key"))
    judges = key.select(F.col("judge").alias("key")).distinct()
    model = estimates(stage(entered.join(judges, "key", "left_semi"), "entered"), settings)
    judged = rows.join(key, same & ~F.col("base_failed"), "left").join(model.withColumnRenamed("key", "judge"), "judge", "left")
    d2 = _distance("x", F.col("centre"), F.col("inverse"))
    kept = ~F.col("base_failed") & (d2 <= float(chi2_quantile(1 - settings.cutoff, _D)))
    return judged.select("doc_id", *BASE, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), F.sqrt(d2).alias("distance"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
