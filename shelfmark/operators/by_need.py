"""Equal files by as little reading as it takes.

Files of different sizes differ.  Of files that share their size, head and tail are
hashed; of files that share those too, all of the content.  Each step looks only at
groups that still have two members, so most files are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import HashPolicy, hash_files


def _shared(rows: DataFrame, *by: str) -> DataFrame:
    """Rows whose group by ``by`` has two members or more; a hot group is counted before
    the shuffle, and the join back is one that can be split."""
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").select(*by)
    return rows.join(groups, list(by), "left_semi")


def equal_by_need(rows: DataFrame, sample: Callable[[DataFrame], DataFrame], whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Members of groups of equal files, with their ``hash``.

    ``rows`` have ``size_bytes``; ``sample`` and ``whole`` add the column ``hash``, of a
    part and of all of the content."""
    sampled = sample(_shared(rows, "size_bytes")).withColumnRenamed("hash", "_sample")
    left = _shared(sampled.where(F.col("_sample").isNotNull()), "size_bytes", "_sample").drop("_sample")
    return _shared(whole(left).where(F.col("hash").isNotNull()), "hash")


def equal_files(files: DataFrame, sample: int = 64 * 1024) -> DataFrame:
    """Members of groups of equal files on disk: (path, size_bytes, hash) and whatever
    else ``files`` has besides hashes.  What cannot be read is in no group."""
    bare = files.drop("hash", "hash_algo")
    part, all_ = HashPolicy("sampled", large=2 * sample, sample=sample), HashPolicy("full")

    def hashed(policy: HashPolicy) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: hash_files(rows, policy).drop("hash_algo", "error_message")

    return equal_by_need(bare, hashed(part), hashed(all_))


def equal_content(rows: DataFrame, digest: Callable[[Column], Column], sample: int) -> DataFrame:
    """The same for a column ``content``: ``digest`` makes a hash of a binary column."""
    size = F.col("size_bytes")
    ends = F.concat(F.substring("content", 1, sample), F.substr(F.col("content"), F.greatest(size - sample + 1, F.lit(1)).cast("int")))
    return equal_by_need(rows, lambda r: r.withColumn("hash", digest(ends)), lambda r: r.withColumn("hash", digest(F.col("content"))))
