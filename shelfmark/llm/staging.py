"""Written tables between the steps of an operator.

A step that is written once is not computed again, whichever executors are lost
later, and its lineage ends there.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import give_back


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may leave it unset; it then gets a
    temporary folder of its own, which is entered in that setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Name of a folder no other run uses; not yet created."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Has the driver collect garbage.

    Spark removes the shuffle files of a plan once the driver's collector finds that no
    one refers to it any more; on an idle driver that may take half an hour."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables staged within once it is left, but for those staged to be kept."""
    folders: list[str] = []
    token = _made.set((*_made.get(), folders))
    try:
        yield
    finally:
        _made.reset(token)
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        release(spark)


def stage(rows: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``rows`` as Parquet and reads them back.

    With ``keep`` the table outlives the innermost ``scratch``."""
    spark = rows.sparkSession
    folder = new_folder(spark, name)
    # the innermost scratch, or with ``keep`` the one around it, will remove it
    around = _made.get()[: len(_made.get()) - keep]
    if around:
        around[-1].append(folder)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


#: rows of a few short columns that may be broadcast: some 40 MB
BROADCAST_ROWS = 500_000


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, a written table of short columns, hinted for broadcast if it has
    at most ``most`` rows; beyond that the join is left to shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def unused(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``rows`` does not have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name
