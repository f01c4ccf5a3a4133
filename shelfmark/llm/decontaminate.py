"""Benchmark decontamination by spaced-seed hashing.

A mask says which words of a window count ("1") and which may differ ("0").
Every window of every benchmark item is hashed under each mask, and so is every
window of every document; equal hashes are hits.  Around a hit item and document
are laid side by side.  An item counts as contained when some stretch of it has
``RUN`` words that agree, ``percent`` of its words or more; so single words may be
replaced, and the rule does not depend on how long the rest of the item is.  Of an
item too short for such a stretch ``percent`` of all words must agree.

The masks lose nothing: every stretch that counts has a window that agrees under
one of ``MASKS`` (at 80 percent or more; below, a mask of so many words in a row as
must agree somewhere is added), and items of less than ``SHORT`` words get every mask
that leaves out as many words as may differ.

Words are longest runs of letters and digits, lower-cased.  Built-in expressions
only: windows are taken from the array of word hashes by position, and hits are
checked where they are found, so no text is shuffled.

Seeds and items are broadcast in blocks of bounded size, one block after another; a
larger benchmark makes more blocks, not larger ones.  Items of the same words are
searched for once.  Texts are looked up in chunks, and a hit takes along only the
words around it, so what hits hold depends neither on the length of a text nor on
how often an item comes.

Defined results: null and empty texts contain nothing and are contained in
nothing; an item longer than ``PIECE`` words is searched for in pieces, which
overlap so that a stretch that counts lies in one of them, and counts as contained
if one piece is; in ``contained`` repeated rows of an id or an item count as one with the
best match, and rows with a null id as one document; ``decontaminate`` judges each text.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import release, small, stage, unused

#: complete for ``RUN`` at 80 percent, and for whole items of ``SHORT`` words and more
MASKS = ("11111", "111011", "11001011")
RUN, SHORT = 13, 8
PIECE = 256
#: words of benchmark text whose seeds and items are broadcast at once
BLOCK_WORDS = 250_000
#: windows of a text that are looked up as one row
CHUNK_WORDS = 512


def word_hashes(text: str = "text") -> Column:
    """64-bit hashes of a text's words, in order (null: none)."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def least_agreeing(length: int, percent: int) -> int:
    """Words that must agree of an item of ``length`` words."""
    return min(RUN, -(-percent * length // 100))


def masks_of(length: int, percent: int) -> tuple[str, ...]:
    """Masks one of which fits any stretch that counts of an item of ``length`` words."""
    need = least_agreeing(length, percent)
    if length < SHORT:
        picked = combinations(range(length), need)
        return tuple(sorted({"".join("1" if k in some else "0" for k in range(length)).strip("0") for some in picked}))
    if percent >= 80:
        return MASKS
    # n agreeing words with m others between them: so many of them in a row at least
    most = lambda n: min(length, n * 100 // percent)
    return (*MASKS, "1" * min(-(-n // (most(n) - n + 1)) for n in range(need, min(2 * need - 1, length) + 1)))


def _masks(lengths: list[int], percent: int) -> dict[str, Column]:
    """Each mask in use and the test of ``length`` for the items it serves."""
    use: dict[str, list[int]] = {}
    for length in sorted({min(n, 2 * RUN * 100 // percent) for n in lengths}):
        for mask in masks_of(length, percent):
            use.setdefault(mask, []).append(length)
    top = 2 * RUN * 100 // percent
    return {mask: F.least(F.col("length"), F.lit(top)).isin(served) for mask, served in use.items()}


def _seed(words: str, mask: str) -> Column:
    """Hash under a mask of the window that begins at ``at``; null if it does not fit in."""
    counted = [F.get(F.col(words), F.col("at") + k) for k, bit in enumerate(mask) if bit == "1"]
    return F.when(F.col("at") + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *counted))


def _windows(rows: DataFrame, words: str, seeds: list[Column], shortest: int) -> DataFrame:
    """A row per window and mask: ``at`` (from 0) and ``seed`` (null: none)."""
    long_enough = rows.where(F.size(words) >= shortest)
    placed = long_enough.withColumn("at", F.explode(F.sequence(F.lit(0), F.size(words) - shortest)))
    return placed.withColumn("seed", F.explode(F.array(*seeds)))


def _pieces(benchmark: DataFrame, percent: int) -> DataFrame:
    """(item_id, item_words, piece): items cut into pieces of at most ``PIECE`` words
    that overlap by the longest stretch that has none shorter in it."""
    items = benchmark.select("item_id", word_hashes().alias("whole")).where(F.size("whole") > 0)
    overlap = (2 * RUN - 1) * 100 // percent
    most = max(PIECE, 2 * overlap)
    later = F.greatest(F.ceil((F.size("whole") - most) / (most - overlap)), F.lit(0)).cast("int")
    cut = items.withColumn("begin", F.explode(F.transform(F.sequence(F.lit(0), later), lambda n: n * (most - overlap))))
    pieces = cut.select("item_id", F.slice("whole", F.col("begin") + 1, F.lit(most)).alias("item_words")).distinct()
    return pieces.withColumn("piece", F.xxhash64("item_words"))


def _bodies(pieces: DataFrame) -> DataFrame:
    """(piece, item_words): words that several items have are searched for once."""
    return stage(pieces.select("piece", "item_words").distinct(), "bodies")


def _counts(agreeing: Column, percent: int) -> Column:
    """Is there a stretch that counts?  ``agreeing``: places of agreeing words, in order.

    Each such stretch holds one of at most 2 * need - 1 agreeing words."""
    need = F.least(F.lit(RUN), F.ceil(F.col("length") * percent / 100)).cast("int")
    place = lambda k: F.get(agreeing, k)
    dense = lambda i, n: (place(i + n - 1) - place(i) + 1) * percent <= n * 100
    some = lambda i: F.exists(F.sequence(need, 2 * need - 1), lambda n: F.coalesce(dense(i, n), F.lit(False)))
    return (F.size(agreeing) >= need) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(agreeing) - need, F.lit(0))), some)


def _hits(docs: DataFrame, seeds: DataFrame, masks: dict[str, Column], longest: int) -> DataFrame:
    """(doc_id, seed, near) of windows whose seed some item has; ``near``: the window's
    first word, and ``longest`` words before and after it (null: none there).

    Spark compiles explodes and joins into one loop, which holds all that a row yields
    until the row is through.  So texts are cut into chunks of ``CHUNK_WORDS`` windows
    with ``longest`` words around; both transform() stay outside of that loop, and rows
    pass them one by one."""
    shortest = min(map(len, masks))

    def chunk(n: Column) -> Column:
        before = F.least(n * CHUNK_WORDS, F.lit(longest))
        words = F.slice("whole", n * CHUNK_WORDS - before + 1, before + CHUNK_WORDS + longest)
        return F.struct(before.alias("before"), words.alias("words"))

    last = F.floor((F.size("whole") - shortest) / CHUNK_WORDS).cast("int")
    numbers = F.when(F.size("whole") >= shortest, F.sequence(F.lit(0), last))
    chunks = docs.select("doc_id", word_hashes().alias("whole")).select("doc_id", F.inline(F.transform(numbers, chunk)))
    end = F.least(F.col("before") + CHUNK_WORDS - 1, F.size("words") - shortest)
    placed = chunks.select("doc_id", "words", F.explode(F.sequence("before", end)).alias("at"))
    windows = placed.withColumn("seed", F.explode(F.array(*[_seed("words", mask) for mask in masks])))
    known = windows.join(F.broadcast(seeds.select("seed").distinct()), "seed", "left_semi")
    near = F.transform(F.sequence(F.col("at") - longest, F.col("at") + longest), lambda k: F.get("words", k))
    return known.select("doc_id", "seed", near.alias("near"))


def _found(docs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """(doc_id, piece, length, matched): the most words of a piece that agree in a
    stretch of a document that counts.  ``bodies``: (piece, item_words), each once."""
    spark = docs.sparkSession
    total = bodies.agg(F.sum(F.size("item_words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    # of at most PIECE different lengths, or some more below 80 percent
    lengths = [r[0] for r in bodies.select(F.size("item_words")).distinct().collect()] or [SHORT]
    masks, longest = _masks(lengths, percent), max(*lengths, SHORT)
    shortest = min(map(len, masks))
    found = []
    for block in range(blocks):
        some = bodies.where(F.pmod("piece", F.lit(blocks)) == block).withColumn("length", F.size("item_words"))
        served = [F.when(serves, _seed("item_words", mask)) for mask, serves in masks.items()]
        # at most BLOCK_WORDS windows under each mask, and as many words of items
        seeds = _windows(some, "item_words", served, shortest).where("seed is not null")
        places = seeds.select("seed", F.col("at").alias("item_at"), "piece", "length")
        pairs = _hits(docs, seeds, masks, longest).join(F.broadcast(places), "seed")
        beside = F.slice("near", F.lit(longest + 1) - F.col("item_at"), F.col("length")).alias("beside")
        laid = pairs.select("doc_id", "piece", beside)
        agreeing = F.filter(
            F.sequence(F.lit(0), F.col("length") - 1),
            lambda k: F.coalesce(F.get("beside", k) == F.get("item_words", k), F.lit(False)),
        )
        # as a row of its own, so that the places are found once and not at each use
        counted = F.explode(F.filter(F.array(agreeing), lambda a: _counts(a, percent))).alias("agreeing")
        checked = laid.join(F.broadcast(some), "piece").select("doc_id", "piece", "length", counted)
        matched = checked.groupBy("doc_id", "piece", "length").agg(F.max(F.size("agreeing")).alias("matched"))
        # block after block: what is broadcast for one goes before the next
        found.append(stage(matched, "found"))
        if blocks > 1:
            del some, seeds, places, pairs, laid, checked, matched
            release(spark)
    return reduce(DataFrame.unionByName, found)


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, item_words, matched) of items contained in documents; the
    last two count words of the item (of its piece) and those that agree."""
    pieces = stage(_pieces(benchmark, percent), "items")
    found = _found(docs, _bodies(pieces), percent)
    best = F.max(F.struct(F.col("matched") / F.col("length"), "matched", "length")).alias("best")
    rows = found.join(small(pieces.select("piece", "item_id")), "piece").groupBy("doc_id", "item_id").agg(best)
    return rows.select("doc_id", "item_id", F.col("best.length").alias("item_words"), F.col("best.matched").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item.

    Texts decide, not ids: rows that share an id, or have none, are judged each on its own."""
    name = unused(docs, "_hit")
    # 128 bits: a clean text does not share them with another
    keyed = docs.withColumn(name, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    named = keyed.select(F.col(name).alias("doc_id"), "text")
    found = _found(named, _bodies(stage(_pieces(benchmark, percent), "items")), percent)
    bad = stage(found.select(F.col("doc_id").alias(name)).distinct(), "contained")
    return keyed.join(small(bad), name, "left_anti").select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
