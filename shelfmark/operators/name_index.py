"""Substring search by an index of three-character pieces.

Files lie in blocks (the files of a table, or any other column).  The index holds, for
every piece of three characters that occurs in a name, the blocks it occurs in.  A block
can hold a hit only if it has every piece of the searched text; only such blocks are
looked through, and their rows are tested as a search without index tests them.

Texts under three characters, and those with a wildcard, have no piece to look up: then
every block is a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ascii_fold
from .filters import name_contains

SIZE = 3


def pieces_of(name: Column) -> Column:
    """Distinct pieces of a name, A-Z folded; none if it is shorter."""
    folded = ascii_fold(name)
    starts = F.sequence(F.lit(1), F.greatest(F.length(folded) - (SIZE - 1), F.lit(1)))
    cut = F.array_distinct(F.transform(starts, lambda at: F.substr(folded, at, F.lit(SIZE))))
    return F.when(F.length(folded) >= SIZE, cut).otherwise(F.array().cast("array<string>"))


def postings(files: DataFrame, block: str) -> DataFrame:
    """(piece, block): reduced before the shuffle, so a piece of every name is one row a
    block and task."""
    return files.select(F.explode(pieces_of(F.col("filename"))).alias("piece"), F.col(block).alias("block")).distinct()


def pieces_of_text(text: str) -> list[str]:
    """The pieces of a searched text; none if it cannot be looked up."""
    if len(text) < SIZE or "%" in text or "_" in text:
        return []
    folded = "".join(c.lower() if c.isascii() else c for c in text)
    return sorted({folded[n : n + SIZE] for n in range(len(folded) - SIZE + 1)})


def candidates(index: DataFrame, text: str) -> DataFrame | None:
    """Blocks that have every piece of ``text``; None: any block may hold a hit."""
    wanted = pieces_of_text(text)
    if not wanted:
        return None
    found = index.where(F.col("piece").isin(wanted)).groupBy("block").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("block")


def search_by_index(files: DataFrame, index: DataFrame, block: str, text: str) -> DataFrame:
    """Rows of ``files`` with ``text`` in their name."""
    blocks = candidates(index, text)
    if blocks is not None:
        files = files.join(blocks.withColumnRenamed("block", block), block, "left_semi")
    return files.where(name_contains(F.col("filename"), text))
