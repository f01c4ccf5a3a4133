"""Files with equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import top

# A content hash may be shared by a large part of the catalog (all empty files
# have one).  Members of a group are spread over this many slots; one bit per
# slot fits a long.
_SLOTS = 64


def _groups(files: DataFrame, *extra) -> DataFrame:
    return (
        files.where(F.col("hash").isNotNull())
        .groupBy("hash")
        .agg(F.count("*").alias("copies"), F.sum("size_bytes").alias("total_bytes"), *extra)
        .where(F.col("copies") > 1)
    )


def _largest_first() -> list:
    return [F.desc("total_bytes"), F.asc("hash")]


def find_duplicates(files: DataFrame, limit: int | None = 50) -> DataFrame:
    """Groups of files with equal hash, largest total first."""
    return top(_groups(files), _largest_first(), limit)


def duplicate_members(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Every member of every duplicate group (or of the ``limit`` largest).

    All groups: each file belongs to one of 64 slots of its hash, and the grouped
    pass notes in a bit mask which slots a group occupies.  The join back to the
    files is on (hash, slot), so a hot group is split over 64 keys while a pair
    of files still adds two join rows at most.  AQE splits further if it must.
    """
    columns = ["hash", "copies", "total_bytes", "disk_id", "path", "filename", "size_bytes", "modified_date"]
    hashed = files.where(F.col("hash").isNotNull())
    slot = F.pmod(F.xxhash64("disk_id", "path"), F.lit(_SLOTS)).cast("int")
    slotted = hashed.withColumn("slot", slot)
    groups = _groups(slotted, F.expr("bit_or(shiftleft(1L, slot))").alias("occupied"))
    if limit is not None and limit >= 0:
        groups = top(groups, _largest_first(), limit)
    occupied = F.filter(
        F.sequence(F.lit(0), F.lit(_SLOTS - 1)), lambda n: F.getbit("occupied", n) == 1
    )
    slots = groups.select("hash", "copies", "total_bytes", F.explode(occupied).alias("slot"))
    return slotted.join(slots, ["hash", "slot"]).select(*columns)
