"""File kinds: report category and MIME type, both from the name."""

from __future__ import annotations

import mimetypes
import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: report category of each extension; anything else is "Other"
CATEGORIES: dict[str, tuple[str, ...]] = {
    "Image": (
        ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".svg", ".ico", ".raw", ".cr2", ".nef", ".dng",
    ),
    "Video": (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg", ".3gp"),
    "Audio": (".mp3", ".wav", ".flac", ".aac", ".ogg", ".wma", ".m4a", ".opus"),
    "Book": (".epub", ".mobi", ".azw", ".azw3", ".fb2"),
    "Document": (".pdf", ".doc", ".docx", ".odt", ".rtf", ".txt", ".md"),
    "Spreadsheet": (".xls", ".xlsx", ".ods", ".csv"),
    "Presentation": (".ppt", ".pptx", ".odp"),
    "Archive": (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz"),
    "Executable": (".exe", ".msi", ".bat", ".cmd", ".sh"),
    "Code": (
        ".py", ".js", ".ts", ".java", ".c", ".cpp", ".cs", ".go", ".rs", ".html", ".css", ".json", ".xml", ".yaml", ".yml",
    ),
}
OTHER = "Other"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_category(extension: Column | str, category: str) -> Column:
    """Does an extension belong to ``category``?  One set lookup."""
    ext = F.lower(F.coalesce(_col(extension), F.lit("")))
    if category == OTHER:
        return ~ext.isin([e for exts in CATEGORIES.values() for e in exts])
    return ext.isin(*CATEGORIES[category]) if category in CATEGORIES else F.lit(False)


def categorize(extension: Column | str) -> Column:
    """Report category of an extension, whatever its case; ``Other`` by default."""
    of = {ext: name for name, exts in CATEGORIES.items() for ext in exts}
    return F.coalesce(F.try_element_at(_literal_map(of), F.lower(_col(extension))), F.lit(OTHER))


class _MimeTables:
    """Python's own type tables, without the host's extra files."""

    def __init__(self) -> None:
        db = mimetypes.MimeTypes(filenames=())
        self.types = dict(db.types_map[True])
        self.packed = sorted(db.encodings_map)
        # .tgz stands for .tar.gz: its type is that of the .tar inside
        self.short = {k: posixpath.splitext(v)[0] for k, v in db.suffix_map.items()}


MIME = _MimeTables()


def _literal_map(pairs: dict[str, str]) -> Column:
    # as one SQL text: hundreds of literal columns would take longer to build
    # than most queries take to plan
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in sorted(pairs.items())) + ")")


def _dot_part(name: Column) -> Column:
    """Last dot part with its dot, case kept; '' where only leading dots precede it."""
    tail = F.substring_index(name, ".", -1)
    stem = F.substring(name, F.lit(1), F.greatest(F.length(name) - F.length(tail) - 1, F.lit(0)))
    has = F.length(tail) < F.length(name)
    return F.when(has & (F.ltrim(stem, F.lit(".")) != ""), F.concat(F.lit("."), tail)).otherwise(F.lit(""))


def _without(name: Column, part: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(part))


def mime_type(filename: Column | str) -> Column:
    """MIME type by name, looking through compression suffixes; NULL if unknown."""
    name = _col(filename)
    outer = _dot_part(name)
    inner = _dot_part(_without(name, outer))
    short = F.try_element_at(_literal_map(MIME.short), F.lower(outer))
    ext = F.coalesce(short, F.when(outer.isin(MIME.packed), inner).otherwise(outer))
    return F.try_element_at(_literal_map(MIME.types), F.lower(ext))
