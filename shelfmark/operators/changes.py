"""Rescans: what changed, which hashes to keep, and the new files table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FILE_KEY

NEW, CHANGED, UNCHANGED, UNSEEN = "new", "changed", "unchanged", "unseen"


# Joins on (disk, path) put this number in front: rows then sort by a number that
# hardly ever ties, where the paths of a disk share long beginnings.
_BY = ["_key", *FILE_KEY]


def _keyed(files: DataFrame) -> DataFrame:
    return files.withColumn("_key", F.xxhash64(F.col("disk_id").cast("long"), F.col("path")))


def classify_changes(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``change_kind`` and the stored ``hash`` and ``hash_algo`` to a listing.

    Unchanged means known under the same (disk, path) with equal size and equal
    modification time.  The stored hash is given for those rows only.
    """
    known = catalog.select(
        *FILE_KEY,
        F.col("size_bytes").alias("_size"),
        F.col("modified_date").alias("_modified"),
        F.col("hash").alias("_hash"),
        F.col("hash_algo").alias("_algo"),
        F.lit(True).alias("_known"),
    )
    same = F.col("size_bytes").eqNullSafe(F.col("_size")) & F.col("modified_date").eqNullSafe(F.col("_modified"))
    kind = F.when(F.col("_known").isNull(), F.lit(NEW)).when(same, F.lit(UNCHANGED)).otherwise(F.lit(CHANGED))
    joined = _keyed(listing).join(_keyed(known), _BY, "left").withColumn("change_kind", kind)
    keep = F.col("change_kind") == UNCHANGED
    return joined.select(
        *[c for c in listing.columns if c not in ("hash", "hash_algo")],
        "change_kind",
        F.when(keep, F.col("_hash")).alias("hash"),
        F.when(keep, F.col("_algo")).alias("hash_algo"),
    )


def match_listing(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Listing and catalog in one: a row for every (disk, path) of either.

    Adds ``change_kind``, with ``unseen`` for catalogued files the listing lacks,
    and ``old``, the whole catalog row.  Everything a rescan needs to know then
    comes from one join, and the new table takes no second one.
    """
    stored = catalog.select(*FILE_KEY, F.struct(*catalog.columns).alias("old"))
    joined = _keyed(listing.withColumn("_listed", F.lit(True))).join(_keyed(stored), _BY, "full_outer")
    same = F.col("size_bytes").eqNullSafe(F.col("old.size_bytes")) & F.col("modified_date").eqNullSafe(
        F.col("old.modified_date")
    )
    kind = (
        F.when(F.col("_listed").isNull(), F.lit(UNSEEN))
        .when(F.col("old").isNull(), F.lit(NEW))
        .when(same, F.lit(UNCHANGED))
        .otherwise(F.lit(CHANGED))
    )
    return joined.withColumn("change_kind", kind).drop("_listed", "_key")


def reuse_hashes(
    listing: DataFrame,
    catalog: DataFrame,
    digest: Callable[[Column], Column],
    algo: Column,
    content: str = "content",
) -> DataFrame:
    """Listing with hashes: stored ones where unchanged, computed ones elsewhere.

    ``digest`` makes a hash of a content column, null of null; ``algo`` is an
    expression over the listing.  Spark runs Python functions on all rows, whatever
    CASE they stand in, so what an unchanged row hands to ``digest`` is null.  The
    rows are read and joined once.
    """
    rows = classify_changes(listing, catalog)
    keep = F.col("change_kind") == UNCHANGED
    fed = F.when(~keep, F.col(content))
    return rows.withColumns(
        {
            "hash": F.when(keep, F.col("hash")).otherwise(digest(fed)),
            "hash_algo": F.when(keep, F.col("hash_algo")).otherwise(algo),
        }
    )


def last_row_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is largest by ``order``; the other columns settle ties.

    Spark keeps the first row per key within every input partition before it
    shuffles (a group limit), so a key that repeats very often stays cheap.
    """
    return _last_by(rows, [F.xxhash64(*key), *key], order, key)


def _last_by(rows: DataFrame, by: list, order: list[Column], key: list[str] | None = None) -> DataFrame:
    ties = [F.desc(c) for c in rows.columns if c not in (key or by)]
    last_first = Window.partitionBy(*by).orderBy(*[o.desc() for o in order], *ties)
    return rows.withColumn("_nth", F.row_number().over(last_first)).where(F.col("_nth") == 1).drop("_nth")


def upsert_files(catalog: DataFrame, incoming: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Files table after a scan: incoming rows replace or extend, the rest stays.

    Of incoming rows that repeat a (disk_id, path) the last by ``order`` counts
    (default: ``last_seen``); the other columns settle ties.  The last rows come
    out spread by the key, so the full join shuffles each side once.
    """
    old = _keyed(catalog).select(*_BY, F.struct(*catalog.columns).alias("_old"))
    last = _last_by(_keyed(incoming), _BY, order or [F.col("last_seen")])
    new = last.select(*_BY, F.struct(*catalog.columns).alias("_new"))
    return old.join(new, _BY, "full_outer").select(
        F.coalesce("_new", "_old").alias("_row")
    ).select("_row.*")
