"""Search over the files table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blank_if_null, categorize, human_size, in_category
from .filters import SearchFilters, apply_filters, top



def _newest_first() -> list:
    # path and disk settle ties, so that a limit is well defined
    return [F.desc("modified_date"), F.asc("path"), F.asc("disk_id")]


def search_files(files: DataFrame, filters: SearchFilters | None = None) -> DataFrame:
    """Files that pass ``filters``, newest first, at most ``filters.limit``."""
    filters = filters or SearchFilters()
    hits = apply_filters(files, filters).select(
        "disk_id", "path", "filename", "extension", "size_bytes", "modified_date", "hash"
    )
    return top(hits, _newest_first(), filters.limit)


def search_listing(files: DataFrame, disk_id: int | None = None, query: str | None = None, limit: int | None = 200) -> DataFrame:
    """Search by name on one disk, with category and readable size."""
    hits = search_files(files, SearchFilters(name=query or None, disk_id=disk_id, limit=limit))
    return hits.select(
        F.col("filename").alias("name"),
        "path",
        blank_if_null("extension").alias("extension"),
        categorize("extension").alias("category"),
        "size_bytes",
        human_size("size_bytes").alias("size_human"),
        "modified_date",
    )


def filter_category(listing: DataFrame, category: str | None) -> DataFrame:
    """Rows of one category; all when none is chosen.

    Tested on the extension, so the filter needs no category column.
    """
    return listing.where(in_category("extension", category)) if category else listing


def category_facets(listing: DataFrame) -> DataFrame:
    """Row count per category in name order, led by the total as ``All``.

    Empty unless there are two categories or more.  There are at most eleven, so
    after the grouped count the whole facet list fits in one row.
    """
    counts = listing.groupBy(categorize("extension").alias("category")).agg(F.count("*").alias("n"))
    gathered = counts.agg(
        F.sum("n").alias("total"),
        F.array_sort(F.collect_list(F.struct("category", "n"))).alias("found"),
    ).where(F.size("found") >= 2)
    every = F.array(F.struct(F.lit("All").alias("category"), F.col("total").alias("n")))
    return gathered.select(F.posexplode(F.concat(every, F.col("found"))).alias("position", "facet")).select(
        F.col("position").cast("long").alias("position"),
        F.col("facet.category").alias("category"),
        F.col("facet.n").alias("file_count"),
    )


def files_for_hash(files: DataFrame, digest: str | Column) -> DataFrame:
    """Every file with a given content hash, by path."""
    return (
        files.where(F.col("hash") == (F.lit(digest) if isinstance(digest, str) else digest))
        .select("disk_id", "path", "filename", "size_bytes", "modified_date")
        .orderBy("path", "disk_id")
    )


def known_paths(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Requested paths with a flag: is the path catalogued on any disk?

    The catalog is first cut down to the requested paths.  A short request list
    is then the small side of that join, and the catalog is not shuffled.
    """
    wanted = requested.select("path").distinct()
    found = files.select("path").join(wanted, "path", "left_semi").distinct()
    return requested.join(found.withColumn("known", F.lit(True)), "path", "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )
