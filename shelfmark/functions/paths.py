"""File-name and path columns.

Paths are stored as text with ``\\`` between segments (``sep`` for others).
Nothing here uses a UDF, so the expressions stay in generated code.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\\"
_TRAIL = "array<struct<label:string,path:string>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_fold(c: Column | str) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(_col(c), string.ascii_uppercase, string.ascii_lowercase)


def _after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def suffix(filename: Column | str) -> Column:
    """Lower-cased last dot part; '' when the dot is first, last or absent."""
    name = _col(filename)
    tail = _after_last(name, ".")
    dot_at = F.length(name) - F.length(tail) - 1
    return F.when((dot_at > 0) & (tail != ""), F.lower(F.concat(F.lit("."), tail))).otherwise(F.lit(""))


def path_segments(path: Column | str, sep: str = SEP) -> Column:
    """Segments of a path, empty ones dropped."""
    return F.filter(F.split(_col(path), re.escape(sep)), lambda part: part != "")


def tidy_path(path: Column | str, sep: str = SEP) -> Column:
    """A path without separators at either end or next to each other.

    Equal to joining ``path_segments``, but plain text work for the usual path.
    """
    p = _col(path)
    inner = F.btrim(p, F.lit(sep))
    single = F.regexp_replace(inner, re.escape(sep) + "+", sep.replace("\\", "\\\\"))
    return F.when(F.contains(p, F.lit(sep * 2)), single).otherwise(inner)


def folder_of(tidy: Column, sep: str = SEP) -> Column:
    """All of a tidy path but its last segment; '' at the top."""
    return F.substring(tidy, F.lit(1), F.greatest(F.length(tidy) - F.length(_after_last(tidy, sep)) - 1, F.lit(0)))


def join_segments(parts: Column, sep: str = SEP) -> Column:
    return F.array_join(parts, sep)


def parent_folder(path: Column | str, sep: str = SEP) -> Column:
    """Folder that holds a file, as a path; roots keep their separator."""
    p = _col(path)
    cut = F.length(p) - F.length(_after_last(p, sep)) - 1
    parent = F.substring(p, F.lit(1), F.greatest(cut, F.lit(0)))
    root = (parent == "") | parent.rlike(r"^[A-Za-z]:$")
    if sep == SEP:
        root = root | parent.rlike(r"^\\\\[^\\]+\\[^\\]+$")
    return F.when(cut < 0, F.lit(".")).when(root, F.concat(parent, F.lit(sep))).otherwise(parent)


def parent_path(folder: Column | str, sep: str = SEP) -> Column:
    """Folder one level up; NULL at the top level."""
    parts = path_segments(folder, sep)
    return F.when(F.size(parts) > 1, join_segments(F.slice(parts, F.lit(1), F.size(parts) - 1), sep))


def ancestors(path: Column | str, sep: str = SEP) -> Column:
    """Every folder from the top down to ``path`` itself, as label and path."""
    parts = path_segments(path, sep)
    trail = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(
            F.get(parts, n - 1).alias("label"),
            join_segments(F.slice(parts, F.lit(1), n), sep).alias("path"),
        ),
    )
    return F.when(F.size(parts) > 0, trail).otherwise(F.array().cast(_TRAIL))


def split_folder(folder: str | None, sep: str = SEP) -> list[str]:
    return [part for part in (folder or "").split(sep) if part]


def under_folder(path: Column | str, folder: str | None, sep: str = SEP) -> Column:
    """Is a path below ``folder``?  A-Z match a-z; leading separators are ignored.

    The exact test cannot be pushed into a Parquet scan, so a range test goes in
    front of it: every spelling of a prefix lies between its upper-case and its
    lower-case form, and the range lets the scan skip row groups sorted by path.
    """
    parts = split_folder(folder, sep)
    if not parts:
        return F.lit(True)
    p = _col(path)
    prefix = sep.join(parts) + sep
    low = _ascii(prefix, str.lower)
    exact = ascii_fold(F.ltrim(p, F.lit(sep))).startswith(low)
    near = _spelled_like(p, prefix) | _spelled_like(p, sep + prefix) | p.startswith(sep + sep)
    return near & exact


def _spelled_like(p: Column, prefix: str) -> Column:
    """Range that holds every path starting with ``prefix`` in any ASCII case."""
    first, last = _ascii(prefix, str.upper), _ascii(prefix, str.lower)
    above = last[:-1] + chr(ord(last[-1]) + 1)
    return (p >= first) & (p < above)


def _ascii(text: str, change) -> str:
    return "".join(change(ch) if ch in string.ascii_letters else ch for ch in text)
