"""The type that sums of sizes take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG, WIDE = "long", "decimal(38,0)"


def total_type(files: DataFrame) -> str:
    """``long`` while all sizes of ``files`` together fit one, else ``decimal(38,0)``.

    No total over some of the files, nor a running sum of such totals, is beyond that of
    all of them without their signs, so every one is exact in this type.  Takes one pass
    over the sizes; one number comes back.
    """
    most = files.agg(F.sum(F.abs(F.col("size_bytes").cast(WIDE)))).first()[0]
    return LONG if (most or 0) < 1 << 63 else WIDE


def total(size: Column, kind: str) -> Column:
    """Sum of sizes in a type given by ``total_type``."""
    return F.sum(size.cast(kind))
