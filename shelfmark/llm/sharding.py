"""Shards by a k-d tree over document metadata.

The whole table is one box.  A box that needs several shards is cut along its
widest dimension at the weighted median, or, for an odd number of shards, at the
matching share of its bytes; until each box reaches the target bytes of a shard.
So documents alike in language, source and length lie together, and shards are
near equal in bytes.

Medians are found by digits: bytes are summed by a dimension's value, and only
where the cut falls inside one value by the text's checksum, then by the row's
hash, then among rows alike in all of these by a running digit.  The sums have a
bounded number of rows for each box, and no row is ranked or collected.  Equal
texts have equal checksums and so stay together unless a cut must fall among them.
The running digit follows the order of reading: which of several equal rows lies
in which shard may differ where the input is split differently.

Defined results: a null text has 0 bytes and the checksum of no bytes; null
language and source are values like any other; repeated rows are placed each, and
cuts fall among them as among others; an empty table has no shards; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import small, stage

#: bytes that a row costs besides its text
ROW_BYTES = 16
_CELLS, _DIGITS = 4096, 65536


def metadata() -> list[Column]:
    """The dimensions of a document, each a whole number from 0 to 4,095: its length
    on a log scale, and by hash, as names have no distances, language and source."""
    named = [F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("\0")).cast("binary")), F.lit(_CELLS)) for c in ("lang", "source")]
    return [F.least(F.floor(F.log2(F.col("size").cast("double")) * 64), F.lit(_CELLS - 1)).cast("long"), *named]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, at, crc_digit, row_digit, tie_digit): what the tree needs."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.col("lang"),
        F.col("source"),
    )
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.array(*metadata()).alias("at"),
        F.pmod(F.col("text_crc32"), F.lit(_DIGITS)).alias("crc_digit"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(_DIGITS)).alias("row_digit"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_DIGITS)).alias("tie_digit"),
    )


def _first(box: str, by: list[str], digit: str, base: Column) -> tuple[Column, Column]:
    """Bytes up to and before a digit, counted from ``base``."""
    order = Window.partitionBy(box, *by).orderBy(digit)
    upto = base + F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return upto, upto - F.col("bytes")


def _cut_of_dimension(rows: DataFrame, ranges: list[int]) -> DataFrame:
    """(box, dim, cut, base, goal): the widest dimension of each box, and the value
    in which the share ``goal`` of its bytes is reached, ``base`` bytes before it."""
    cells = rows.select("box", "shards", "size", F.posexplode("at").alias("dim", "value"))
    sums = cells.groupBy("box", "shards", "dim", "value").agg(F.sum("size").alias("bytes"))
    whole = Window.partitionBy("box", "dim")
    upto, before = _first("box", ["dim"], "value", F.lit(0))
    goal = F.sum("bytes").over(whole) * F.floor(F.col("shards") / 2) / F.col("shards")
    sums = sums.withColumns({"upto": upto, "before": before, "goal": goal})
    wide = F.get(F.array(*[F.lit(1.0 / max(r, 1)) for r in ranges]), F.col("dim"))
    cut = F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("value", "before")))
    spread = ((F.max("value") - F.min("value")) * F.first(wide)).alias("spread")
    dims = sums.groupBy("box", "dim").agg(spread, cut.alias("cut"), F.first("goal").alias("goal"))
    best = F.max(F.struct("spread", -F.col("dim"), F.col("dim").alias("dim"), "cut", "goal")).alias("best")
    one = dims.groupBy("box").agg(best)
    return one.select("box", "best.dim", F.col("best.cut.value").alias("cut"), F.col("best.cut.before").alias("base"), "best.goal")


def _cut_of_digit(rows: DataFrame, digit: str, last: bool) -> DataFrame:
    """(box, cut, base): the digit in which a box's goal is reached.  The last cut is
    moved before its digit where that is nearer to the goal."""
    sums = rows.groupBy("box", digit).agg(F.sum("size").alias("bytes"), F.first("base").alias("base"), F.first("goal").alias("goal"))
    upto, before = _first("box", [], digit, F.col("base"))
    sums = sums.withColumns({"upto": upto, "before": before})
    reached = F.struct(F.col(digit).alias("cut"), "before", "upto", "goal")
    one = sums.groupBy("box").agg(F.min(F.when(F.col("upto") >= F.col("goal"), reached)).alias("at"))
    nearer = (F.col("at.goal") - F.col("at.before")) < (F.col("at.upto") - F.col("at.goal"))
    cut = F.when(nearer, F.col("at.cut") - 1).otherwise(F.col("at.cut")) if last else F.col("at.cut")
    return one.select("box", cut.alias("cut"), F.col("at.before").alias("base"))


def kd_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``rows``, as ``measured`` gives them, with their ``shard`` from 0 on.

    They are written with their first box: a constant would turn the joins on it
    into joins without a key.
    """
    rows = stage(rows.withColumns({"box": F.lit(0), "shards": F.lit(shards)}), "boxes")
    first = rows.agg(*[F.max(F.get("at", F.lit(d))) - F.min(F.get("at", F.lit(d))) for d in range(3)]).first()
    ranges = [int(r or 0) for r in first]
    boxes = {shards}
    while max(boxes) > 1:
        open_ = rows.where("shards > 1")
        value = F.get("at", F.col("dim"))
        cut0 = small(stage(_cut_of_dimension(open_, ranges), "cuts"))
        inside0 = open_.join(cut0, "box").where(value == F.col("cut"))
        cut1 = small(stage(_cut_of_digit(inside0.select("box", "size", "crc_digit", "base", "goal"), "crc_digit", False), "cuts"))
        at1 = cut1.select("box", F.col("cut").alias("cut1"), F.col("base").alias("base1"))
        inside1 = inside0.drop("base").join(at1, "box").where("crc_digit = cut1").withColumnRenamed("base1", "base")
        cut2 = small(stage(_cut_of_digit(inside1.select("box", "size", "row_digit", "base", "goal"), "row_digit", False), "cuts"))
        at2 = cut2.select("box", F.col("cut").alias("cut2"), F.col("base").alias("base2"))
        inside2 = inside1.drop("base").join(at2, "box").where("row_digit = cut2").withColumnRenamed("base2", "base")
        cut3 = _cut_of_digit(inside2.select("box", "size", "tie_digit", "base", "goal"), "tie_digit", True)
        at3 = cut3.select("box", F.col("cut").alias("cut3"))
        digits = at1.drop("base1").join(at2.drop("base2"), "box").join(at3, "box")
        cuts = small(stage(cut0.select("box", "dim", F.col("cut").alias("cut0")).join(digits, "box"), "cuts"))
        placed = rows.join(cuts, "box", "left")
        low = F.struct(value, "crc_digit", "row_digit", "tie_digit") <= F.struct("cut0", "cut1", "cut2", "cut3")
        half = F.floor(F.col("shards") / 2).cast("int")
        single = F.col("shards") == 1
        box = F.when(single | low, F.col("box")).otherwise(F.col("box") + half)
        count = F.when(single, 1).when(low, half).otherwise(F.col("shards") - half)
        rows = stage(placed.withColumns({"box": box, "shards": count}).drop("dim", "cut0", "cut1", "cut2", "cut3"), "boxes")
        boxes = {n for b in boxes for n in ((b // 2, b - b // 2) if b > 1 else (1,))}
    return rows.drop("shards").withColumnRenamed("box", "shard")


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... in each shard.

    Rows are numbered within parts of a shard by hash, of some 100,000 rows; what
    precedes a part is summed over the parts' counts.
    """
    parts = max(16, -(-rows.count() // (shards * 100_000)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "tie_digit"), F.lit(parts)))
    counts = rows.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "tie_digit")
    numbered = rows.withColumn("within", F.row_number().over(order))
    joined = numbered.join(small(stage(offsets, "offsets")), ["shard", "part"])
    return joined.withColumn("slot", (F.col("before") + F.col("within") - 1).cast("long")).drop("part", "before", "within")


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """Shards that ``target_bytes`` each make of a table."""
    size = F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)) + ROW_BYTES
    return max(1, -(-(docs.agg(F.sum(size.cast("long"))).first()[0] or 0) // target_bytes))


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    placed = with_slots(kd_shards(measured(docs), shards), shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
