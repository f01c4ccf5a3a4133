"""Columns as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# every character Unicode counts as white space, and the four ASCII separators
_BLANKS = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of every kind at both ends (``trim`` takes spaces only)."""
    return F.btrim(_col(c), F.lit(_BLANKS))


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def or_else(c: Column | str, fallback: Column) -> Column:
    """``fallback`` where a text is NULL or empty."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), fallback)


def short_hash(c: Column | str) -> Column:
    return F.substring(_col(c), 1, 16)


def _as_utc(c: Column, kind: T.DataType | None) -> Column:
    # a zoneless timestamp already is UTC; an instant is shown in UTC, whatever
    # the session's own zone
    if isinstance(kind, T.TimestampType):
        return F.to_utc_timestamp(c, F.current_timezone())
    return c


def display_ts(c: Column | str, kind: T.DataType | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, '' for NULL."""
    return F.coalesce(F.date_format(_as_utc(_col(c), kind), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def iso_utc(c: Column | str, kind: T.DataType | None = None) -> Column:
    """ISO-8601 text in UTC, microseconds only where there are any."""
    ts = _as_utc(_col(c), kind)
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    fraction = F.when(micros == ".000000", F.lit("")).otherwise(micros)
    return F.concat(seconds, fraction, F.lit("+00:00"))
