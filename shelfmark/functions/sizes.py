"""Byte counts for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: units of 1024, the last one open-ended
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_size(num_bytes: Column | str) -> Column:
    """``1536`` -> ``1.5 KB``: one decimal, ties to even, whole bytes below 1 KB.

    Dividing by a power of two is exact and ``rint`` breaks ties to even, so the
    text equals that of a ``%.1f`` format without a formatting call per row.
    """
    c = F.col(num_bytes) if isinstance(num_bytes, str) else num_bytes
    n = c.cast("double")
    scaled = n / _by_magnitude(n, [float(1 << 10 * power) for power in range(1, len(UNITS))])
    tenths = F.rint(scaled * 10) / 10
    # from ten million on, a double is written with an exponent
    text = F.when(tenths < 1e7, tenths.cast("string")).otherwise(tenths.cast("decimal(38,1)").cast("string"))
    unit = _by_magnitude(n, [f" {u}" for u in UNITS[1:]])
    small = F.concat(c.cast("long").cast("string"), F.lit(f" {UNITS[0]}"))
    return F.when(n < 1024, small).otherwise(F.concat(text, unit))


def _by_magnitude(n: Column, choices: list) -> Column:
    """The choice for KB, MB, ... by the size of a number."""
    out = F
    for power, choice in enumerate(choices[:-1], start=2):
        out = out.when(n < float(1 << 10 * power), F.lit(choice))
    return out.otherwise(F.lit(choices[-1]))
