"""Removal of repeated substrings by bucket-pointer refinement.

A byte goes if some string of ``length`` bytes that covers it also begins anywhere else
in the corpus.  Suffixes are sorted only as far as that question needs: into buckets of
positions whose strings agree, refined until they agree in ``length`` bytes.

How it goes:

1. Buckets of q-grams (q: a quarter of the length).  A position's bucket identifier is
   put together from those of shorter grams at it and at later offsets, doubling each
   time.  Of the q-grams of a string the one with the smallest identifier (the first of
   them) stands for it, so equal strings are stood for by equal grams at equal places,
   and only these grams go into the shuffle, about one in 150 positions.
2. A gram stands for some strings in a row: its surroundings.  A bucket with a single
   position is done.  Positions of a bucket with equal surroundings are a class; of a
   class with two members all strings are repeated, and one member stays for it.
3. Members that are alone in their class, and one of each other class, are refined with
   the rest of their bucket: identifiers of whole strings are put together from those of
   the grams at later offsets, again by doubling, and sorted; equal ones are repeated.
4. A text's removed bytes are the union of its repeated strings.

What is refined grows with the number of places where copies differ, not with the
copies: a large group of copies is one class.  Buckets are refined in tasks, many at a
time.  A bucket of more than ``BUCKET`` classes is refined by Spark, a row for each
string.  Buckets, classes and strings have identifiers of 64 bits each, compared within a
bucket only (strings of such large buckets: 128 bits).

Equal texts are worked on once in a task, and count as often as they occur.  Every group
by a key is reduced before the shuffle; a text's own spans meet in one group, which grows
with that text alone.

Defined results: a null text counts as empty; a text shorter than ``length`` loses
nothing; the rows of equal texts, whatever their ids, all get the same result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import small, stage
from .utf8 import buffer_of
from .words import give_back, mixed, slices

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(29)
#: string starts looked at together: all arrays of it stay near the processor
_PIECE = 1 << 18
#: bytes of surroundings that a task refines at once, unless one bucket has more
_BLOCK = 1 << 20
#: classes of a bucket that one task refines
BUCKET = 20_000
#: bytes of rows that may be broadcast
_BROADCAST_BYTES = 32 * 1024 * 1024


# -- buckets of grams ---------------------------------------------------------


def gram_ids(data: np.ndarray, size: int) -> np.ndarray:
    """Bucket identifiers of the grams of ``size`` bytes at every position that has one."""
    grams = data.astype(np.uint64) + np.uint64(1)
    whole, covered, width = None, 0, 1
    while True:
        if size & width:
            # identifiers of the positions so far, then those at the later offset
            whole = grams if whole is None else _joined(whole, grams, covered)
            covered += width
        if covered == size:
            return whole[: max(len(data) - size + 1, 0)]
        grams, width = _joined(grams, grams, width), width * 2


def _joined(ids: np.ndarray, later: np.ndarray, offset: int) -> np.ndarray:
    n = max(min(len(ids), len(later) - offset), 0)
    value = ids[:n] * _ODD
    value += later[offset : offset + n]
    value ^= value >> _TURN
    value *= _ODD
    return value


def standing(data: np.ndarray, length: int, gram: int, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Positions and buckets of the grams that stand for the strings at ``starts``, and the
    first and the last string each stands for (``starts`` ascend; ``data`` has at most
    ``_PIECE`` + ``length`` bytes)."""
    ids = mixed(gram_ids(data, gram))
    span = length - gram + 1
    low = np.uint64((1 << (_PIECE + length).bit_length()) - 1)
    # the position settles ties, so the first of equal grams is the smallest
    least = (ids & ~low) | np.arange(len(ids), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least[starts] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[cut], ids[at[cut]], starts[cut], starts[np.concatenate([cut[1:], [len(at)]]) - 1]


def inner_starts(at: np.ndarray, begin: int, end: int, length: int) -> np.ndarray:
    """Starts between begin and end of strings that lie in one of data[at[i]:at[i + 1]]."""
    first, last = (np.searchsorted(at, [begin, end - 1], "right") - 1).tolist()
    stop = np.repeat(at[first + 1 : last + 2], np.diff(np.clip(at[first : last + 2], begin, end)))
    return begin + np.flatnonzero(np.arange(begin, end) + length <= stop)


def places(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the texts data[at[i]:at[i + 1]]: positions of standing grams, their buckets, and
    the first and last string of each."""
    none = np.zeros(0, np.int64)
    found = [(none, none.astype(np.uint64), none, none)]
    for begin in range(0, len(data), _PIECE):
        starts = inner_starts(at, begin, min(begin + _PIECE, len(data)), length)
        if len(starts):
            p, bucket, first, last = standing(data[begin : int(starts[-1]) + length], length, gram, starts - begin)
            found.append((p + begin, bucket, first + begin, last + begin))
    p, bucket, first, last = (np.concatenate(part) for part in zip(*found))
    # a gram may stand for strings on both sides of a piece's end
    cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else none
    return p[cut], bucket[cut], first[cut], last[np.concatenate([cut[1:], [len(p)]]).astype(np.int64) - 1][: len(cut)]


# -- occurrences --------------------------------------------------------------


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _long_texts(docs: DataFrame, length: int) -> DataFrame:
    return docs.where(F.octet_length("text") >= length).select(_digest().alias("digest"), "text")


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per text (digest, times) with its standing grams: bucket ``core``, class
    ``name``, ``begin``, where the surroundings begin, ``left``, how far behind that the
    gram is, ``more``, how many strings follow the first, and ``run``, how many positions
    in a row have these surroundings.

    Equal texts of a slice are one row; ``times`` counts them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                digests = part.column("digest").to_pylist()
                times: dict[bytes, int] = {}
                distinct = []
                for i, digest in enumerate(digests):
                    if digest not in times:
                        distinct.append(i)
                    times[digest] = times.get(digest, 0) + 1
                data, at = buffer_of(part.column("text").take(pa.array(distinct, pa.int64())))
                p, core, first, last = places(data, at, length, gram)
                view = memoryview(np.ascontiguousarray(data))
                digest = xxhash.xxh3_64_intdigest
                rows = zip(first.tolist(), (last + length).tolist(), (p - first).tolist())
                name = np.fromiter((digest(view[a:b], seed=left) for a, b, left in rows), np.uint64, len(p))
                owner = np.searchsorted(at, p, "right") - 1
                # a run of one letter has the same surroundings at every position
                again = (name[1:] == name[:-1]) & (p[1:] == p[:-1] + 1) & (owner[1:] == owner[:-1]) & (first[1:] == last[1:])
                keep = np.flatnonzero(np.concatenate([[True], ~again])) if len(p) else np.zeros(0, np.int64)
                run = np.diff(np.concatenate([keep, [len(p)]]))
                owner = owner[keep]
                offsets = pa.array(np.searchsorted(owner, np.arange(len(distinct) + 1)).astype(np.int32))
                lists = [core[keep].view(np.int64), name[keep].view(np.int64)]
                lists += [x.astype(np.int32) for x in (first[keep] - at[owner], (p - first)[keep], (last - first)[keep], run)]
                columns = [
                    pa.array([digests[i] for i in distinct], pa.binary()),
                    pa.array([times[digests[i]] for i in distinct], pa.int64()),
                    *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists],
                ]
                yield pa.record_batch(columns, ["digest", "times", *_LISTS])
        give_back()

    kinds = ["long", "long", "int", "int", "int", "int"]
    schema = "digest binary, times long, " + ", ".join(f"{n} array<{k}>" for n, k in zip(_LISTS, kinds))
    return _long_texts(docs, length).mapInArrow(work, schema)


_LISTS = ["core", "name", "begin", "left", "more", "run"]


# -- refinement ---------------------------------------------------------------


def _bounded(rows: DataFrame, size: Column) -> DataFrame:
    """The rows as a written table, hinted for broadcast if their sizes add up to little."""
    kept = stage(rows, "wanted")
    return F.broadcast(kept) if (kept.agg(F.sum(size)).first()[0] or 0) <= _BROADCAST_BYTES else kept


def _surroundings(docs: DataFrame, members: DataFrame, length: int, gram: int) -> DataFrame:
    """(bucket, digest, begin, n, bytes) of classes, each read off one member (digest,
    begin, left, more, n).  Copies of a text in several tasks give equal rows."""
    lists = ["begin", "left", "more", "n"]
    grouped = members.groupBy("digest").agg(F.collect_list(F.struct(*lists)).alias("_all"))
    # arrays of numbers take a third of the room of an array of rows
    arrays = grouped.select("digest", *[F.col(f"_all.{c}").alias(c) for c in lists])
    wanted = _bounded(arrays, 160 + 16 * F.size("begin"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for part in slices(batch):
                buckets, digests, begins, ns, pieces = [], [], [], [], []
                for digest, text, *of in zip(*(part.column(c).to_pylist() for c in ("digest", "text", *lists))):
                    if digest in seen:
                        continue
                    seen.add(digest)
                    data = text.encode()
                    for begin, left, more, n in zip(*of):
                        buckets.append(xxhash.xxh3_64_intdigest(data[begin + left : begin + left + gram]))
                        digests.append(digest)
                        begins.append(begin)
                        ns.append(n)
                        pieces.append(data[begin : begin + more + length])
                bucket = np.array(buckets, np.uint64).view(np.int64)
                columns = [pa.array(bucket), pa.array(digests, pa.binary()), pa.array(begins, pa.int32()), pa.array(ns, pa.int32()), pa.array(pieces, pa.binary())]
                yield pa.record_batch(columns, ["bucket", "digest", "begin", "n", "bytes"])
        give_back()

    joined = _long_texts(docs, length).join(wanted, "digest").select("digest", "text", *lists)
    return joined.mapInArrow(work, "bucket long, digest binary, begin int, n int, bytes binary")


_SPANS = "digest binary, `from` int, `to` int"


def _runs(inside: np.ndarray) -> np.ndarray:
    """(from, to) of the runs of true values."""
    edge = np.concatenate([[False], inside, [False]])
    return np.flatnonzero(edge[1:] != edge[:-1]).reshape(-1, 2)


def _refine_block(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Repeated spans of the members of whole buckets that are alone in their class."""
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])])
    starts, ids = [], []
    for begin in range(0, len(data), _PIECE):
        some = inner_starts(at, begin, min(begin + _PIECE, len(data)), length)
        if len(some):
            starts.append(some)
            ids.append(gram_ids(data[begin : int(some[-1]) + length], length)[some - begin])
    start, string = np.concatenate(starts), np.concatenate(ids)
    owner = np.searchsorted(at, start, "right") - 1
    times = np.array([min(r[3], 2) for r in rows])
    same = np.unique(string, return_inverse=True)[1]
    repeated = np.bincount(same, times[owner])[same] > 1
    # strings of a member follow each other, those of two members do not
    marked = np.zeros(len(data) + 1, bool)
    marked[start[repeated & (times[owner] == 1)]] = True
    spans = _runs(marked)
    of = np.searchsorted(at, spans[:, 0], "right") - 1
    begin = np.array([r[2] for r in rows])[of] - at[of]
    columns = [pa.array([rows[i][1] for i in of.tolist()], pa.binary())]
    columns += [pa.array((x + begin).astype(np.int32)) for x in (spans[:, 0], spans[:, 1] - 1 + length)]
    return pa.record_batch(columns, ["digest", "from", "to"])


def _refined(around: DataFrame, length: int) -> DataFrame:
    """Spans of members that are alone in their class, bucket by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "digest", "begin", "n", "bytes"]
        rows: list[tuple] = []
        size = 0
        for row in chain.from_iterable(zip(*(batch.column(c).to_pylist() for c in names)) for batch in batches):
            if rows and row[:3] == rows[-1][:3]:
                continue  # the same member, read off a copy
            if size >= _BLOCK and row[0] != rows[-1][0]:
                yield _refine_block(rows, length)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
        if rows:
            yield _refine_block(rows, length)
        give_back()

    spread = around.repartition("bucket").sortWithinPartitions("bucket", "digest", "begin")
    return spread.mapInArrow(work, _SPANS)


def _refined_by_string(around: DataFrame, length: int) -> DataFrame:
    """The same for buckets too large for a task: a row for each string."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, begin, n, data in zip(*(batch.column(c).to_pylist() for c in ("digest", "begin", "n", "bytes"))):
                count = len(data) - length + 1
                strings = [xxhash.xxh3_128_digest(data[k : k + length]) for k in range(count)]
                columns = [pa.array(strings, pa.binary()), pa.array([digest] * count, pa.binary())]
                columns += [pa.array(range(begin, begin + count), pa.int32()), pa.array([n] * count, pa.int32())]
                yield pa.record_batch(columns, ["string", "digest", "from", "n"])
        give_back()

    one = around.dropDuplicates(["digest", "begin", "bucket"])
    strings = stage(one.mapInArrow(work, "string binary, digest binary, `from` int, n int"), "strings")
    twice = strings.groupBy("string").agg(F.sum("n").alias("times")).where("times > 1").select("string")
    alone = strings.where("n = 1").join(twice, "string")
    return alone.select("digest", "from", (F.col("from") + length).cast("int").alias("to"))


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(digest, from, to): spans of repeated strings in the texts with that digest."""
    texts = stage(_occurrences(docs, length, gram), "occurrences")
    each = texts.select("digest", "times", F.explode(F.arrays_zip(*_LISTS)).alias("at")).select("digest", "times", "at.*")
    each = each.withColumn("n", F.col("times") * F.col("run"))
    repeated = stage(each.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core"), "buckets")
    met = each.join(small(repeated), "core")
    place = F.min(F.struct("digest", "begin", "left", "more")).alias("place")
    classes = stage(met.groupBy("core", "name").agg(F.sum("n").alias("n"), place), "classes")
    # every string of a class with two members
    shared = met.join(small(classes.where("n > 1").select("core", "name")), ["core", "name"])
    end = F.col("begin") + F.col("more") + F.col("run") + (length - 1)
    spans = [shared.select("digest", F.col("begin").alias("from"), end.cast("int").alias("to"))]
    # buckets in which some member is alone in its class, beside other classes
    state = classes.groupBy("core").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1")
    members = classes.join(state.select("core", "k"), "core")
    members = stage(members.select("place.*", F.least("n", F.lit(2)).cast("byte").alias("n"), "k"), "members")
    spans.append(_refined(_surroundings(docs, members.where(F.col("k") <= BUCKET), length, gram), length))
    large = members.where(F.col("k") > BUCKET)
    if large.limit(1).count():
        spans.append(_refined_by_string(_surroundings(docs, large, length, gram), length))
    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    return found


def _merged(spans: DataFrame) -> DataFrame:
    """(digest, starts, ends): a text's maximal spans, in order."""
    grouped = spans.groupBy("digest").agg(F.collect_set(F.struct("from", "to")).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for spans in batch.column("spans").to_pylist():
                edges = np.array([(s["from"], s["to"]) for s in spans], np.int64)
                edges = edges[np.argsort(edges[:, 0], kind="stable")]
                reach = np.maximum.accumulate(edges[:, 1])
                new = np.flatnonzero(np.concatenate([[True], edges[1:, 0] > reach[:-1]]))
                starts.append(edges[new, 0].tolist())
                ends.append(reach[np.concatenate([new[1:], [len(reach)]]) - 1].tolist())
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch.column("digest"), pa.array(starts, kind), pa.array(ends, kind)], ["digest", "starts", "ends"])

    return grouped.mapInArrow(work, "digest binary, starts array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs`` (doc_id, text): the removed
    runs of bytes as pairs (from, to), and the bytes that stay."""
    spans = repeated_spans(docs, length, max(length // 4, 1))
    removed = _bounded(_merged(spans), 96 + 8 * F.size("starts"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _digest().alias("digest"))
    joined = rows.join(removed, "digest", "left").select("doc_id", "text", "starts", "ends")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, spans, kept = [], [], []
                for text, starts, ends in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                    data = text.encode()
                    gone = list(zip(starts or [], ends or []))
                    sizes.append(len(data))
                    spans.append([{"from": a, "to": b} for a, b in gone])
                    kept.append(b"".join(data[a:b] for a, b in zip([0, *(ends or [])], [*(starts or []), len(data)])))
                kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "n_bytes", "spans", "kept"])
        give_back()

    return joined.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(
        "doc_id",
        "n_bytes",
        lost.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
