"""Folders, derived from file paths: no folder table exists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    SEP,
    ancestors,
    blank_if_null,
    categorize,
    human_size,
    parent_path,
    path_segments,
    tidy_path,
    under_folder,
)
from ..functions.paths import folder_of, join_segments, split_folder
from .totals import total, total_type


@dataclass(frozen=True)
class Browse:
    """What a file manager shows for one folder."""

    location: DataFrame  # one row: disk_id, current_path, parent_path
    folders: DataFrame
    files: DataFrame


def descendants(files: DataFrame, disk_id: int, folder: str | None, sep: str = SEP) -> DataFrame:
    """Files of a disk anywhere below ``folder``; A-Z in the folder match a-z."""
    return files.where((F.col("disk_id") == disk_id) & under_folder("path", folder, sep))


def _below(rows: DataFrame, sep: str) -> DataFrame:
    """Adds ``_rest``: the path below the folder in ``head`` ('' for the top)."""
    skip = F.when(F.col("head") == "", F.lit(0)).otherwise(F.length("head") + 1)
    return rows.withColumn("_rest", F.substr(tidy_path("path", sep), skip + 1)).where(F.col("_rest") != "")


def _folders_at(rows: DataFrame, kind: str, sep: str) -> DataFrame:
    """Immediate sub-folders of ``head``, each with all that is below it.

    Bytes are summed in the type ``kind`` (see ``total_type``)."""
    rest = F.col("_rest")
    path = F.when(F.col("head") == "", F.col("name")).otherwise(F.concat("head", F.lit(sep), "name"))
    return (
        _below(rows, sep)
        .where(F.contains(rest, F.lit(sep)))
        .groupBy("head", F.substring_index(rest, sep, 1).alias("name"))
        .agg(F.count("*").alias("file_count"), total(F.coalesce("size_bytes", F.lit(0)), kind).alias("total_bytes"))
        .select("name", path.alias("path"), "file_count", "total_bytes", human_size("total_bytes").alias("size_human"))
        .orderBy(F.lower("name"), "name")
    )


def _files_at(rows: DataFrame, sep: str) -> DataFrame:
    """Files directly in ``head``."""
    return (
        _below(rows, sep)
        .where(~F.contains("_rest", F.lit(sep)))
        .select(
            F.col("_rest").alias("name"),
            "path",
            blank_if_null("extension").alias("extension"),
            categorize("extension").alias("category"),
            "size_bytes",
            human_size("size_bytes").alias("size_human"),
            "modified_date",
            "hash",
        )
        .orderBy(F.lower("name"), "name", "path")
    )


def _chosen(files: DataFrame, disk_id: int, folder: str | None, sep: str) -> DataFrame:
    head = F.lit(sep.join(split_folder(folder, sep)))
    return descendants(files, disk_id, folder, sep).withColumn("head", head)


def browse_folders(files: DataFrame, disk_id: int, folder: str | None = None, sep: str = SEP) -> DataFrame:
    """Sub-folders of ``folder`` with the files and bytes below each."""
    rows = _chosen(files, disk_id, folder, sep)
    return _folders_at(rows, total_type(rows), sep)


def browse_files(files: DataFrame, disk_id: int, folder: str | None = None, sep: str = SEP) -> DataFrame:
    """Files directly in ``folder``."""
    return _files_at(_chosen(files, disk_id, folder, sep), sep)


def _shared_head(lowest: Column, highest: Column, sep: str) -> Column:
    """Segments two folder paths share from the top."""
    pairs = F.arrays_zip(path_segments(lowest, sep).alias("a"), path_segments(highest, sep).alias("b"))
    differs = F.transform(pairs, lambda p: p["a"].eqNullSafe(p["b"]))
    first = F.array_position(differs, F.lit(False)).cast("int")
    shared = F.when(first > 0, first - 1).otherwise(F.size(pairs))
    return F.slice(path_segments(lowest, sep), F.lit(1), shared)


def root_folder(files: DataFrame, disk_id: int, sep: str = SEP) -> DataFrame:
    """Where browsing a disk starts: one row with ``disk_id`` and ``head``.

    Going down while there is exactly one folder and no file ends at the longest
    prefix common to all folders.  That of the first and the last folder in sort
    order is the same, so one aggregate finds it, however deep it lies.
    """
    # ending in a separator, 'a' and 'a b' share whole segments only
    folder = F.concat(folder_of(tidy_path("path", sep), sep), F.lit(sep))
    shared = join_segments(_shared_head(F.col("lowest"), F.col("highest"), sep), sep)
    return (
        files.where(F.col("disk_id") == disk_id)
        .agg(F.max("disk_id").alias("disk_id"), F.min(folder).alias("lowest"), F.max(folder).alias("highest"))
        .select("disk_id", F.coalesce(shared, F.lit("")).alias("head"))
    )


def _location(head: DataFrame, disk_id: int, sep: str) -> DataFrame:
    return head.select(
        F.lit(disk_id).cast("long").alias("disk_id"),
        F.col("head").alias("current_path"),
        parent_path("head", sep).alias("parent_path"),
    )


def browse(files: DataFrame, disk_id: int, folder: str | None = None, sep: str = SEP) -> Browse:
    """Folders and files in ``folder``; without one, at the disk's first branching."""
    if folder is not None:
        rows = _chosen(files, disk_id, folder, sep)
        start = files.sparkSession.range(1).select(F.lit(sep.join(split_folder(folder, sep))).alias("head"))
        kind = total_type(rows)
    else:
        start = root_folder(files, disk_id, sep)
        # an aggregate without keys is one row, so broadcasting it is safe
        on_disk = files.where(F.col("disk_id") == disk_id)
        rows, kind = on_disk.join(F.broadcast(start), "disk_id"), total_type(on_disk)
    return Browse(_location(start, disk_id, sep), _folders_at(rows, kind, sep), _files_at(rows, sep))


def folder_rollup(files: DataFrame, sep: str = SEP) -> DataFrame:
    """Files and bytes below every folder of every disk.

    Files are summed per direct folder first; only folders are then repeated for
    each of their ancestors.
    """
    direct = (
        files.groupBy("disk_id", folder_of(tidy_path("path", sep), sep).alias("direct"))
        .agg(F.count("*").alias("n"), total(F.coalesce("size_bytes", F.lit(0)), total_type(files)).alias("b"))
    )
    # files outside any folder have no ancestors and drop out here; a filter on
    # the folder would be pushed down and cut up every path a second time
    return (
        direct.withColumn("folder", F.explode(ancestors("direct", sep)["path"]))
        .groupBy("disk_id", "folder")
        .agg(F.sum("n").alias("file_count"), F.sum("b").alias("total_bytes"))
    )
