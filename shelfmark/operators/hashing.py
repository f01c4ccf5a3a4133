"""Content hashes: of bytes in a column, and of files by path."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: they decide which digest a file gets
HASH_MODES = ("full", "sampled", "none")
FULL, SAMPLED = "blake2b", "blake2b-sampled"
LARGE_FILE = 50 * 1024 * 1024
SAMPLE = 1024 * 1024
CHUNK = 1024 * 1024


@dataclass(frozen=True)
class HashPolicy:
    """Which files are hashed whole and which by head and tail."""

    mode: str = "sampled"
    large: int = LARGE_FILE
    sample: int = SAMPLE

    def __post_init__(self) -> None:
        if self.mode not in HASH_MODES:
            raise ValueError(f"no such way to hash: {self.mode!r}; there are {', '.join(HASH_MODES)}")

    def whole(self, size: Column) -> Column:
        return F.lit(True) if self.mode == "full" else size <= F.lit(self.large)

    def to_read(self, size: Column) -> Column:
        """Bytes of a file that its hash needs."""
        return F.when(self.whole(size), size).otherwise(F.lit(2 * self.sample))

    def algo(self, size: Column, full: str = FULL, sampled: str = SAMPLED) -> Column:
        if self.mode == "none":
            return F.lit(None).cast("string")
        return F.when(self.whole(size), F.lit(full)).otherwise(F.lit(sampled))


# -- bytes in a column --------------------------------------------------------


def sampled_bytes(content: Column, size: Column, sample: int) -> Column:
    """Size (8 bytes, big-endian), head, and the tail if there is more than a head."""
    n = F.lit(sample)
    tail = F.when(size > n, F.substring(content, F.lit(-sample), n)).otherwise(F.lit(b""))
    prefix = F.unhex(F.lpad(F.hex(size), 16, "0"))
    return F.concat(prefix, F.substring(content, F.lit(1), n), tail)


def sha256_of(content: Column, size: Column, policy: HashPolicy) -> Column:
    """SHA-256 of a binary column under ``policy``; runs without Python."""
    if policy.mode == "none":
        return F.lit(None).cast("string")
    sample = sampled_bytes(content, size, policy.sample)
    return F.sha2(F.when(policy.whole(size), content).otherwise(sample), 256)


def _blake2b_batch(content: pa.Array) -> pa.Array:
    digests = [None if v is None else hashlib.blake2b(v).hexdigest() for v in _buffers(content)]
    return pa.array(digests, pa.string())


# Declared non-deterministic though it is not: otherwise a filter on the digest
# is pushed below its column, and everything is hashed twice.
_blake2b = F.arrow_udf(_blake2b_batch, T.StringType()).asNondeterministic()


def _buffers(content: pa.Array) -> Iterator[memoryview | None]:
    for value in content:
        buffer = value.as_buffer()
        yield None if buffer is None else memoryview(buffer)


def blake2b_of(content: Column, size: Column, policy: HashPolicy) -> Column:
    """BLAKE2b-512 of a binary column under ``policy``."""
    if policy.mode == "none":
        return F.lit(None).cast("string")
    sample = sampled_bytes(content, size, policy.sample)
    return _blake2b(F.when(policy.whole(size), content).otherwise(sample))


# -- files by path ------------------------------------------------------------


def _digest(path: str, size: int, whole: bool, sample: int) -> str:
    h = hashlib.blake2b()
    if not stat.S_ISREG(os.stat(path).st_mode):
        raise OSError(f"not a regular file: {path!r}")
    with open(path, "rb", buffering=0) as f:
        if whole:
            for chunk in iter(lambda: f.read(CHUNK), b""):
                h.update(chunk)
        else:
            h.update(size.to_bytes(8, "big"))
            h.update(_exactly(f, sample))
            if size > sample:
                f.seek(size - sample)
                h.update(_exactly(f, sample))
    return h.hexdigest()


def _exactly(f, n: int) -> bytes:
    """Up to ``n`` bytes: a raw read may return fewer before the end."""
    got = bytearray()
    while len(got) < n and (piece := f.read(n - len(got))):
        got += piece
    return bytes(got)


_BUCKETS = 1024


def spread_by_bytes(files: DataFrame, cost: Column, task_bytes: int) -> DataFrame:
    """``files`` (with ``path``) dealt to tasks by the bytes each file costs.

    A file of ``task_bytes`` or more is a task of its own.  The others lie one after
    the other in an order by hash, and a task takes those that begin in its stretch
    of ``task_bytes``: so at most twice that.  What precedes a file is summed in its
    bucket, and what precedes a bucket over all buckets.
    """
    marked = files.withColumns({"_cost": cost, "_bucket": F.pmod(F.xxhash64("path"), F.lit(_BUCKETS))})
    alone = F.col("_cost") >= task_bytes
    short = F.when(~alone, F.col("_cost")).otherwise(0)
    sums = marked.groupBy("_bucket").agg(F.sum(short).alias("bytes"), F.sum(alone.cast("long")).alias("large"))
    everything, large = sums.agg(F.sum("bytes"), F.sum("large")).first()
    tasks, large = -(-(everything or 0) // task_bytes), large or 0
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("bytes", "large")])
    before = Window.partitionBy("_bucket").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    stretch = F.floor((F.col("_bytes") + F.coalesce(F.sum(short).over(before), F.lit(0))) / task_bytes)
    nth = tasks + F.col("_large") + F.coalesce(F.sum(alone.cast("long")).over(before), F.lit(0))
    placed = marked.join(F.broadcast(offsets), "_bucket")  # a row for each bucket
    # an empty file at the very end begins where the last stretch ends
    task = F.when(alone, nth).otherwise(F.least(stretch, F.lit(max(tasks - 1, 0)))).cast("int")
    placed = placed.withColumn("_task", task)
    return placed.repartitionById(max(1, tasks + large), "_task").select(*files.columns)


def hash_files(files: DataFrame, policy: HashPolicy) -> DataFrame:
    """Adds ``hash``, ``hash_algo`` and ``error_message`` by reading each ``path``.

    Files are read in chunks on the executors, so a file of any size needs one
    chunk of memory.  A file that cannot be read gets an error, not a hash.
    """
    if policy.mode == "none":
        none = F.lit(None).cast("string")
        return files.withColumns({"hash": none, "hash_algo": none, "error_message": none})
    sample = policy.sample

    def read(path: pa.Array, size: pa.Array, whole: pa.Array) -> pa.Array:
        rows = []
        for p, n, w in zip(path.to_pylist(), size.to_pylist(), whole.to_pylist()):
            try:
                rows.append({"hash": _digest(p, n, w, sample), "error": None})
            except OSError as exc:
                rows.append({"hash": None, "error": str(exc)})
        return pa.array(rows, pa.struct([("hash", pa.string()), ("error", pa.string())]))

    size = F.col("size_bytes")
    digest = F.arrow_udf(read, "struct<hash:string,error:string>").asNondeterministic()
    return (
        files.withColumn("_read", digest("path", "size_bytes", policy.whole(size)))
        .withColumns(
            {
                "hash": F.col("_read.hash"),
                "hash_algo": F.when(F.col("_read.hash").isNotNull(), policy.algo(size)),
                "error_message": F.col("_read.error"),
            }
        )
        .drop("_read")
    )
