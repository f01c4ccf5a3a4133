"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words.  A document's share of its source's target is
a number of copies, seldom whole: each document gets the whole part, and what is
left is a probability below one.  The probabilities are rounded pairwise: two
documents pass words to and fro, at random but fair on average, until one of them
has a whole number.  The words of the pair stay what they were, so a source's
total is kept but for the last document that remains.

Documents are first rounded in groups of bounded size, alike in length.  What is
left of each group, one document at most, goes on to the next level, in which a
group takes the remains of many: a reduction tree.  Random numbers are hashes of
the document's id and the seed, so reruns agree.

Defined results: a null or empty text has no words: it is taken 0 times, or as
often as the others of its source on the whole part; sources count by code point
with null last; a source without words has target 0; of an empty table nothing is
taken.  Rows equal in id, source and text pass words among themselves first, which
leaves all but one of them with a whole number: that one is rounded with others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import small, stage, unused
from .words import by_slices, mixed, words_of

WEIGHTS = (5.0, 2.0, 1.0)
#: documents rounded by one task at a time, and remains taken together
GROUP, FAN = 50_000, 4_096


def _mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def with_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark): words of each text, and a hash of the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = pa.array(words_of(batch.column("text")).counts)
        return pa.record_batch([batch.column("doc_id"), batch.column("source"), counts, batch.column("mark")], _SIZED)

    rows = docs.select("doc_id", "source", "text", _mark().alias("mark"))
    return rows.mapInArrow(by_slices(work), "doc_id long, source string, size long, mark long")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target): one row per source.

    Weights repeat over the sources in order.  A target stops at ``most`` times its
    source; what is over is shared by the others, by weight.  The sources that stop
    are those with the least room for their weight, so one pass in that order finds
    the share of the rest.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.get(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))))
    room = sizes.withColumn("weight", pick).withColumn("room", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("room").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    stepped = room.withColumn("level", left / weight_left)
    stops = F.col("room") <= F.col("level") * F.col("weight")
    shared = stepped.withColumn("stops", stops)
    # the first source that does not stop fixes the level of all that follow
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("room") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    share = F.when(F.col("stops"), F.col("room")).otherwise(level["level"] * F.col("weight"))
    return shared.select("source", "source_size", share.alias("target"))


def _uniform(ids: np.ndarray, marks: np.ndarray, seed: int) -> np.ndarray:
    bits = mixed(mixed(ids.view(np.uint64) + np.uint64(seed)) ^ marks.view(np.uint64))
    return (bits >> np.uint64(11)) / float(1 << 53)


def pivot(parts: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds probabilities in order; gives them and the place of the one left, or -1.

    Sizes are above 0.  Each step keeps the words of the pair, and makes 0 or 1 of
    one of the two at least.
    """
    parts = parts.tolist()
    sizes, draws = sizes.tolist(), draws.tolist()
    held = -1
    for i, p in enumerate(parts):
        if p <= 0.0 or p >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        mass, other = parts[a] * sizes[a], p * sizes[b]
        up = min(sizes[a] - mass, other)  # words b may pass to a
        down = min(mass, sizes[b] - other)  # and a to b
        move = up if draws[i] * (up + down) < down else -down
        for at, value, whole in ((a, mass + move, sizes[a]), (b, other - move, sizes[b])):
            # what the step made whole is so but for the last digits
            parts[at] = 0.0 if value <= whole * 1e-9 else 1.0 if value >= whole * (1 - 1e-9) else value / whole
        held = next((x for x in (a, b) if 0.0 < parts[x] < 1.0), -1)
    return np.array(parts), held


_SIZED = ["doc_id", "source", "size", "mark"]
_ROW = [*_SIZED, "rows"]
_ROUND = "row struct<doc_id:long,source:string,size:long,mark:long,rows:long>, whole long, part double, left boolean"


def _round(rows: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Rounds ``part`` within the groups ``by``; ``left`` marks what remains."""

    def work(group: pa.Table) -> pa.Table:
        row = pa.concat_arrays(group.column("row").chunks)
        # fields that may be null, as the schema says
        row = pa.StructArray.from_arrays([row.field(n) for n in _ROW], _ROW)
        ids = row.field("doc_id").fill_null(0).to_numpy()
        sizes, marks = row.field("size").to_numpy() * row.field("rows").to_numpy(), row.field("mark").to_numpy()
        parts = group.column("part").to_numpy()
        order = np.lexsort((marks, ids, sizes))
        rounded, held = pivot(parts[order], sizes[order].astype(float), _uniform(ids, marks, seed)[order])
        out = np.empty(len(order))
        out[order] = rounded
        left = np.zeros(len(order), bool)
        if held >= 0:
            left[order[held]] = True
        return pa.table([row, group.column("whole"), pa.array(out), pa.array(left)], ["row", "whole", "part", "left"])

    return rows.groupBy(*by).applyInArrow(work, _ROUND)


def _among_equals(units: DataFrame) -> DataFrame:
    """Units of equal rows, parted where their rows end with unlike numbers: some are
    taken once more, the others not, and one keeps what is left of the probability."""
    many = (F.col("rows") > 1) & (F.col("size") > 0)
    sum_ = F.col("rows") * F.col("part")
    more = F.floor(sum_)
    none = F.lit(0.0)

    def entry(rows: Column, whole: Column, part: Column) -> Column:
        return F.struct(rows.cast("long").alias("rows"), whole.cast("long").alias("whole"), part.alias("part"))

    whole = F.col("whole")
    last = F.least(F.col("rows") - more, F.lit(1))
    parts = F.array(entry(more, whole + 1, none), entry(last, whole, sum_ - more), entry(F.col("rows") - more - last, whole, none))
    as_is = F.array(entry(F.col("rows"), whole, F.col("part")))
    kept = F.filter(F.when(many, parts).otherwise(as_is), lambda e: e["rows"] > 0)
    others = [c for c in units.columns if c not in ("rows", "whole", "part")]
    return units.select(*others, F.explode(kept).alias("entry")).select(*others, "entry.*")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0, seed: int = 1, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """(doc_id, source, size, mark, rows, source_size, target, copies).

    ``rows`` rows equal in id, source and text are taken ``copies`` times each; where
    equal rows are taken unlike times there is an entry for each number.  The table
    of targets has a row per source and is left to Spark's broadcast limit.
    """
    sized = stage(with_sizes(docs), "sized")
    aims = stage(targets(sized, weights, most), "targets")
    same = F.col("source").eqNullSafe(F.col("_source"))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = aims.select(F.col("source").alias("_source"), factor.alias("factor"))
    row = F.struct(*_ROW).alias("row")
    units = sized.groupBy(*_SIZED).agg(F.count("*").alias("rows"))
    parted = units.join(shares, same).withColumns({"whole": F.floor("factor"), "part": F.col("factor") - F.floor("factor")})
    split = _among_equals(parted).select(row, "whole", "part")
    # texts without words weigh nothing: they have no part to round
    bare = split.where("row.size = 0").select("row", "whole", F.lit(0.0).alias("part"), F.lit(False).alias("left"))
    rest = split.where("row.size > 0")
    length = F.floor(F.log2(F.col("row.size").cast("double")) * 2)
    rest = rest.withColumn("source", F.col("row.source")).withColumn("length", length)
    counts = rest.groupBy("source", "length").agg(F.ceil(F.count("*") / group).alias("groups"))
    counts = counts.select(F.col("source").alias("_source"), F.col("length").alias("_length"), "groups")
    placed = rest.join(counts, same & (F.col("length") == F.col("_length")))
    placed = placed.withColumn("number", F.pmod(F.xxhash64("row.doc_id", "row.mark"), F.col("groups")))
    rounded = stage(_round(placed.select("row", "whole", "part", "source", "length", "number"), ["source", "length", "number"], seed), "rounded")
    done = [bare, rounded.where("not left")]
    # the tree: each level takes up to ``fan`` remains of a source together
    remains = rounded.where("left")
    while True:
        most_left = remains.groupBy("row.source").count().agg(F.max("count")).first()[0] or 0
        if most_left <= 1:
            break
        seed += 1
        groups = -(-most_left // fan)
        at = F.pmod(F.xxhash64("row.doc_id", "row.mark", F.lit(seed)), F.lit(groups))
        next_level = remains.select("row", "whole", "part", F.col("row.source").alias("source"), at.alias("number"))
        rounded = stage(_round(next_level, ["source", "number"], seed), "rounded")
        done.append(rounded.where("not left"))
        remains = rounded.where("left")
    # the last document of a source is rounded alone: to the nearest
    done.append(remains.withColumn("part", F.round("part")).select("row", "whole", "part", "left"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    copies = F.col("whole") + F.col("part").cast("long")
    taken = every.select("row.*", copies.alias("copies"))
    final = aims.select(F.col("source").alias("_source"), "source_size", "target")
    return taken.join(final, same).drop("_source")


#: parts in which equal rows are numbered
_PARTS = 4_096


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0, seed: int = 1) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    taken = mix(docs, weights, most, seed)
    names = {c: unused(docs, f"_{c}") for c in ("doc_id", "source", "mark", "rows", "copies", "copy", "tie", "part", "number", "before")}
    sums = F.sum("rows").alias(names["rows"]), F.sum(F.col("rows") * F.col("copies")).alias(names["copies"])
    unit = [F.col(c).alias(names[c]) for c in ("doc_id", "source", "mark")]
    key = stage(taken.groupBy(*unit).agg(*sums).where(F.col(names["copies"]) > 0), "copies")
    same = _mark() == F.col(names["mark"])
    for c in ("doc_id", "source"):
        same = same & F.col(c).eqNullSafe(F.col(names[c]))

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        every = F.sequence(F.lit(1).cast("long"), times)
        return rows.withColumn(names["copy"], F.explode(F.when(times > 0, every))).select(*docs.columns)

    # the copies of a unit of n rows fall to them evenly, so that equal shares need no numbers
    rows, copies = F.col(names["rows"]), F.col(names["copies"])
    even = copies % rows == 0
    whole = repeated(docs.join(small(key.where(even)), same), F.floor(copies / rows))
    uneven = key.where(~even)
    if uneven.isEmpty():
        return whole
    part = F.pmod(F.xxhash64(F.col(names["tie"])), F.lit(_PARTS))
    tied = docs.join(small(uneven), same).withColumn(names["tie"], F.monotonically_increasing_id())
    tied = stage(tied.withColumn(names["part"], part), "equals")
    units = [names[c] for c in ("doc_id", "source", "mark")]
    counts = tied.groupBy(*units, names["part"]).count()
    before = F.sum("count").over(Window.partitionBy(*units).orderBy(names["part"]).rowsBetween(Window.unboundedPreceding, -1))
    twin = {c: unused(docs, f"{c}_") for c in (*units, names["part"])}
    starts = counts.select(*[F.col(c).alias(t) for c, t in twin.items()], F.coalesce(before, F.lit(0)).alias(names["before"]))
    within = F.row_number().over(Window.partitionBy(*units, names["part"]).orderBy(names["tie"]))
    meet = [F.col(c).eqNullSafe(F.col(t)) for c, t in twin.items()]
    numbered = tied.withColumn(names["number"], within).join(small(stage(starts, "starts")), meet)
    number = F.col(names["before"]) + F.col(names["number"])
    times = F.floor(number * copies / rows) - F.floor((number - 1) * copies / rows)
    return whole.unionByName(repeated(numbered, times))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return each.select("doc_id", "size", "source_size", "target", taken, "source", "copies")
