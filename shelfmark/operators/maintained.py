"""Folder totals and duplicate groups kept up to date by what a rescan changed.

A change is a signed row: ``+1`` for a file as it is now, ``-1`` for what it was.  Sums
of signed rows, added to stored sums, give the sums of the new state, so the work of a
rescan is in proportion to its changes.  Stored sums are a base and the changes since,
added up when they are read.

Null sizes count as 0.  Rows without a hash are in no duplicate group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import SEP, ancestors, tidy_path
from ..functions.paths import folder_of
from .changes import CHANGED, NEW, UNSEEN

ROLLUP = "disk_id long, folder string, file_count long, total_bytes long"
HASHES = "hash string, copies long, total_bytes long"

ENTERED, LEFT, GREW, SHRANK = "entered", "left", "grew", "shrank"


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows of the files table as signed rows."""
    size = F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes")
    return rows.select("disk_id", "path", size, "hash", F.lit(sign).cast("long").alias("sign"))


def signed_changes(matched: DataFrame, drop_unseen: bool = False) -> DataFrame:
    """Signed rows of a ``match_listing`` whose listing has its hashes.

    Unseen files stay in the catalog, unless ``drop_unseen``."""
    kind = F.col("change_kind")
    lost = [CHANGED, UNSEEN] if drop_unseen else [CHANGED]
    return signed(matched.where(kind.isin(NEW, CHANGED)), 1).unionByName(signed(matched.where(kind.isin(lost)).select("old.*"), -1))


# -- folder totals ------------------------------------------------------------


def rollup_changes(changes: DataFrame, sep: str = SEP) -> DataFrame:
    """What signed rows change in the totals of every folder above them.

    Summed per direct folder first; folders in which it all cancels out are left out,
    and only the others are repeated for their ancestors."""
    direct = (
        changes.groupBy("disk_id", folder_of(tidy_path("path", sep), sep).alias("direct"))
        .agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("size_bytes")).alias("b"))
        .where("n != 0 or b != 0")
    )
    above = direct.withColumn("folder", F.explode(ancestors("direct", sep)["path"]))
    sums = above.groupBy("disk_id", "folder").agg(F.sum("n").alias("file_count"), F.sum("b").alias("total_bytes"))
    return sums.where("file_count != 0 or total_bytes != 0")


def add_up_rollup(parts: DataFrame) -> DataFrame:
    """Totals of all folders that hold a file, from a stored base and its changes."""
    sums = parts.groupBy("disk_id", "folder").agg(F.sum("file_count").alias("file_count"), F.sum("total_bytes").alias("total_bytes"))
    return sums.where("file_count > 0")


# -- duplicate groups ---------------------------------------------------------


def hash_changes(changes: DataFrame) -> DataFrame:
    """What signed rows change in the count and bytes of every hash."""
    sums = changes.where(F.col("hash").isNotNull()).groupBy("hash")
    sums = sums.agg(F.sum("sign").alias("copies"), F.sum(F.col("sign") * F.col("size_bytes")).alias("total_bytes"))
    return sums.where("copies != 0 or total_bytes != 0")


def add_up_hashes(parts: DataFrame) -> DataFrame:
    """Count and bytes of every hash, also of those with one file: the state from which
    groups enter and leave."""
    sums = parts.groupBy("hash").agg(F.sum("copies").alias("copies"), F.sum("total_bytes").alias("total_bytes"))
    return sums.where("copies > 0")


def group_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Duplicate groups that enter, leave, grow or shrink: (hash, change, copies_before,
    copies).  Only hashes named in ``changes`` are looked up."""
    some = changes.select("hash", F.col("copies").alias("_more"))
    joined = some.join(state.select("hash", F.col("copies").alias("_had")), "hash", "left")
    before = F.coalesce("_had", F.lit(0))
    after = before + F.col("_more")
    return (
        joined.select("hash", _change(before, after).alias("change"), before.alias("copies_before"), after.alias("copies"))
        .where(F.col("change").isNotNull())
    )


def _change(before: Column, after: Column) -> Column:
    return (
        F.when((before < 2) & (after > 1), ENTERED)
        .when((before > 1) & (after < 2), LEFT)
        .when((before > 1) & (after > before), GREW)
        .when((before > 1) & (after < before), SHRANK)
    )
