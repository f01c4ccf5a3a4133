"""Which dated snapshots of a table to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = 30


def newest_snapshots(rows: DataFrame, column: str, keep: int = KEEP) -> DataFrame:
    """Rows of the ``keep`` newest snapshots.

    The kept names are at most ``keep`` rows; Spark broadcasts them if they are few,
    and joining on the partition column lets it skip the folders of the others.
    """
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    newest = rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.desc(column)).limit(keep)
    return rows.join(newest, column, "left_semi")
