"""Searches of a stored catalog that open only the files that can matter.

The manifest knows the bounds of every base file: sizes, modification times.  Files whose
bounds rule out a hit are not opened, and, where a disk has an index of names, nor are
those that lack a piece of the searched text.

A newest-first page opens the files that reach latest, and more of them, twice as many
each time, until its last row is newer than anything in the files not opened.  Rows
changed since the base are few and always looked at.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import SearchFilters
from ..operators.search import search_files
from ..operators.zones import after_key
from .catalog import Catalog, Wanted


def _micros(value: str | datetime) -> int:
    at = datetime.fromisoformat(value) if isinstance(value, str) else value
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at
    since = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


def _within(filters: SearchFilters, key: tuple | None) -> Wanted:
    """May a base file hold a row that passes, going by its bounds?"""

    def wanted(disk: int, file: dict) -> bool:
        if filters.disk_id is not None and disk != filters.disk_id:
            return False
        if filters.min_size is not None and file["largest"] < filters.min_size:
            return False
        if filters.max_size is not None and file["smallest"] > filters.max_size:
            return False
        # a file of rows without a time has no bounds, and no row passes a bound of time
        if filters.modified_after and (file["newest"] is None or file["newest"] < _micros(filters.modified_after)):
            return False
        if filters.modified_before and (file["oldest"] is None or file["oldest"] > _micros(filters.modified_before)):
            return False
        return key is None or file["oldest"] is None or file["oldest"] <= _micros(key[0])

    return wanted


def search_stored(catalog: Catalog, filters: SearchFilters | None = None, key: tuple | None = None) -> DataFrame:
    """``search_files`` over a stored catalog.

    ``key``: the (modified_date, path, disk_id) of the last row of the page before."""
    filters = filters or SearchFilters()
    manifest = catalog.manifests.newest()
    within = _within(filters, key)
    named = catalog.name_candidates(manifest, filters.disk_id, filters.name) if filters.name else lambda disk, file: True
    disks = {d: s for d, s in manifest["disks"].items() if filters.disk_id in (None, int(d))}
    files = [f for d, s in disks.items() for f in s["base"]["files"] if within(int(d), f) and named(int(d), f)]
    # those that reach latest first; those without a time hold the last rows of all
    files.sort(key=lambda f: (f["newest"] is not None, f["newest"] or 0), reverse=True)
    limit = filters.limit if filters.limit is not None and filters.limit >= 0 else None
    opened = len(files) if limit is None else _enough(files, limit)
    while True:
        names = {f["name"] for f in files[:opened]}
        rows = catalog.files(filters.disk_id, manifest, lambda disk, file: file["name"] in names)
        page = search_files(rows if key is None else rows.where(after_key(_literals(key))), filters)
        if opened >= len(files):
            return page
        left = files[opened]["newest"]
        count, last = page.agg(F.count("*"), F.min(F.unix_micros(F.col("modified_date").cast("timestamp")))).first()
        # rows of equal time might come first by their path
        if count == limit and last is not None and left is not None and last > left:
            return page
        if limit == 0:
            return page
        opened = min(len(files), 2 * opened)


def _literals(key: tuple) -> tuple:
    return F.timestamp_micros(F.lit(_micros(key[0]))), key[1], key[2]


def _enough(files: list[dict], limit: int) -> int:
    """How many of the first files hold ``limit`` rows; one at least."""
    rows = 0
    for n, file in enumerate(files, 1):
        rows += file["rows"]
        if rows >= limit:
            return n
    return max(1, len(files))
