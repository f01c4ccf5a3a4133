"""Column functions: ``Column`` in, ``Column`` out, all evaluated in the JVM."""

from .display import blank_if_null, display_ts, iso_utc, short_hash, strip
from .kinds import CATEGORIES, categorize, in_category, mime_type
from .paths import (
    SEP,
    ancestors,
    ascii_fold,
    parent_folder,
    parent_path,
    path_segments,
    suffix,
    tidy_path,
    under_folder,
)
from .sizes import human_size

__all__ = [
    "CATEGORIES",
    "SEP",
    "ancestors",
    "ascii_fold",
    "blank_if_null",
    "categorize",
    "display_ts",
    "human_size",
    "in_category",
    "iso_utc",
    "mime_type",
    "parent_folder",
    "parent_path",
    "path_segments",
    "short_hash",
    "strip",
    "suffix",
    "tidy_path",
    "under_folder",
]
