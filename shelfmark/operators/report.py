"""The flat report: one row per file, ready for a spreadsheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import SEP, blank_if_null, categorize, human_size, iso_utc, parent_folder
from ..functions.display import or_else
from .filters import SearchFilters, apply_filters, top

# fixed values: report headings, in order
HEADERS = ("Disk", "Folder", "Filename", "Extension", "Category", "Size (bytes)", "Size", "Created", "Modified", "Hash")

_PADDING, _NARROWEST, _WIDEST = 2, 10, 80


def export_rows(
    files: DataFrame, disks: DataFrame, filters: SearchFilters | None = None, limit: int | None = None
) -> DataFrame:
    """Matching files with their disk's label, by path.

    All of them, unless ``limit`` is given: the limit of ``filters`` is that of a
    search page and does not count here.  Files are filtered before the join, so a disk filter means the file's disk.
    Spark broadcasts ``disks`` below its size threshold and shuffles beyond it,
    with AQE splitting the partition of a disk that holds most files.
    """
    labels = disks.select("disk_id", F.col("label").alias("disk_label"))
    rows = (
        apply_filters(files, filters)
        .join(labels, "disk_id")
        .select(
            "disk_id",
            "disk_label",
            "path",
            "filename",
            "extension",
            "size_bytes",
            "created_date",
            "modified_date",
            "hash",
            "mime_type",
        )
    )
    return top(rows, [F.asc("path"), F.asc("disk_id")], limit)


def report(rows: DataFrame, sep: str = SEP) -> DataFrame:
    """Export rows under the report headings; no NULL is left."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def when(c: str) -> Column:
        return blank_if_null(iso_utc(c, kinds[c]))

    values = (
        or_else("disk_label", F.col("disk_id").cast("string")),
        parent_folder("path", sep),
        F.col("filename"),
        blank_if_null("extension"),
        categorize("extension"),
        F.col("size_bytes"),
        human_size("size_bytes"),
        when("created_date"),
        when("modified_date"),
        blank_if_null("hash"),
    )
    return rows.select(*[v.alias(h) for v, h in zip(values, HEADERS)])


def report_widths(rows: DataFrame) -> DataFrame:
    """Column widths that fit a report: heading, width; in one pass."""
    longest = rows.agg(
        *[F.coalesce(F.max(F.length(F.col(f"`{h}`").cast("string"))), F.lit(0)).alias(f"w{i}") for i, h in enumerate(HEADERS)]
    )

    def fitted(i: int, heading: str) -> Column:
        wide = F.greatest(F.col(f"w{i}"), F.lit(len(heading))) + _PADDING
        return F.least(F.greatest(wide, F.lit(_NARROWEST)), F.lit(_WIDEST)).cast("long")

    cells = [
        F.struct(F.lit(i).cast("long").alias("position"), F.lit(h).alias("heading"), fitted(i, h).alias("width"))
        for i, h in enumerate(HEADERS)
    ]
    return longest.select(F.inline(F.array(*cells)))


def write_report(rows: DataFrame, path: str, sep: str = SEP) -> None:
    """Writes the report as CSV parts with headings, in the order of ``rows``.

    Quotes are doubled and a backslash is an ordinary character, as spreadsheets
    expect.
    """
    options = {"header": True, "emptyValue": "", "quote": '"', "escape": '"'}
    report(rows, sep).write.mode("errorifexists").options(**options).csv(path)
