"""The search filter and how it becomes Spark predicates."""

from __future__ import annotations

import string
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ascii_fold

_ESCAPE = "!"
_TO_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class SearchFilters:
    """All given filters must hold.  Empty text means not given; so does None."""

    name: str | None = None
    extension: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    disk_id: int | None = None
    scan_id: int | None = None
    modified_after: str | datetime | None = None
    modified_before: str | datetime | None = None
    limit: int | None = 200


def name_contains(filename: Column, text: str) -> Column:
    """``text`` anywhere in the name, A-Z matching a-z.

    ``%`` and ``_`` in ``text`` keep their LIKE meaning.  Backslash is ordinary:
    the escape character is ``!``, doubled here wherever the text holds one.
    """
    pattern = f"%{text}%".translate(_TO_LOWER).replace(_ESCAPE, _ESCAPE * 2)
    if _ESCAPE in pattern:
        return F.like(ascii_fold(filename), F.lit(pattern), F.lit(_ESCAPE))
    # without an escape Spark turns '%text%' into a plain substring test
    return F.like(ascii_fold(filename), F.lit(pattern.replace("\\", "\\\\")))


def extension_is(extension: Column, wanted: str) -> Column:
    dotted = wanted if wanted.startswith(".") else f".{wanted}"
    return extension == F.lit(dotted.lower())


def _bound(value: str | datetime, kind: T.DataType) -> Column:
    """A date bound as a literal of the column's own timestamp type."""
    at = datetime.fromisoformat(value) if isinstance(value, str) else value
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(at.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")
    return F.lit(at.isoformat()).cast("timestamp")


def predicates(filters: SearchFilters, schema: T.StructType) -> list[Column]:
    modified = schema["modified_date"].dataType
    out: list[Column] = []
    if filters.name:
        out.append(name_contains(F.col("filename"), filters.name))
    if filters.extension:
        out.append(extension_is(F.col("extension"), filters.extension))
    if filters.min_size is not None:
        out.append(F.col("size_bytes") >= F.lit(filters.min_size))
    if filters.max_size is not None:
        out.append(F.col("size_bytes") <= F.lit(filters.max_size))
    if filters.disk_id is not None:
        out.append(F.col("disk_id") == F.lit(filters.disk_id))
    if filters.scan_id is not None:
        out.append(F.col("scan_id") == F.lit(filters.scan_id))
    if filters.modified_after:
        out.append(F.col("modified_date") >= _bound(filters.modified_after, modified))
    if filters.modified_before:
        out.append(F.col("modified_date") <= _bound(filters.modified_before, modified))
    return out


def apply_filters(files: DataFrame, filters: SearchFilters | None) -> DataFrame:
    """Rows of ``files`` that pass every given filter; all rows when none is."""
    preds = predicates(filters or SearchFilters(), files.schema)
    return files.where(reduce(and_, preds)) if preds else files


def top(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """First ``limit`` rows in ``order``; None or a negative number means all."""
    ordered = df.orderBy(*order)
    return ordered if limit is None or limit < 0 else ordered.limit(limit)
