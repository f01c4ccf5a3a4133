"""Near-duplicate links between documents: an n-gram Jaccard join by signature trees.

A document's set holds its distinct word shingles.  Two documents link when their
sets' Jaccard similarity reaches the threshold; the result is each document's
connected component of links, exactly.

How it goes:

1. Equal sets form a class; only one document of a class is compared.
2. Neighbourhoods.  A set is cut into parts by the hash of its shingles, one more
   part than two linked sets of that size class can differ in.  So two linked sets
   agree in some part, and meet under that part's hash.  A meeting counts only if
   sizes and token bitmaps (two bits a shingle) allow a link.  First each set is held
   against the first one it meets under a key; under keys where such a pair fails, a
   signature tree over the bitmaps of all sets there finds the pairs that may link.
   Neighbourhoods are the connected components of what is left: every link lies
   inside one.
3. In a neighbourhood sets hang in a signature tree.  Each node holds the OR of
   the token bitmaps below it and the range of their sizes.  Two trees (or one
   with itself) are walked together, and a pair of nodes is dropped when their
   sizes, or the largest overlap their bitmaps allow, rule out any link.  What is
   left at the leaves is compared exactly.
4. A neighbourhood too large for one task is cut into bands of size, such that
   linked sets are in one band or in neighbouring ones, and a band too large into
   chunks.  First each chunk is joined with itself, then leaders of the components
   so found are joined, and last those pairs of chunks in one or neighbouring bands
   in which different components remain.  Pairs that are connected already need no
   comparison, so a huge group of near copies costs no all-pairs work, yet no link
   between different components is lost.

Defined results: a null or empty text, or one without a word, has an empty set,
0 shingles, links with nothing and is its own component; a text of fewer words
than a shingle has one shingle, all its words; repeated rows of an id count as one
document (the union of their links); a row with a null id gets a null component
and links with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .staging import release, scratch, small, stage, unused
from .words import by_slices, give_back, hashes, mixed, slices, windows, words_of

_PART, _EMPTY = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)
#: documents and shingles of one chunk, which one task joins at a time
CHUNK_DOCS, CHUNK_SHINGLES = 4096, 1_500_000
_FAN, _MAX_BITS, _PAIRS, _WORDS = 8, 1 << 16, 1 << 14, 1 << 19


# -- sets ---------------------------------------------------------------------


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased."""
    words = words_of(texts, lower=True)
    hashed = hashes(words.vocabulary)[words.codes]
    found, at = windows(hashed, words.offsets, size)
    sets = []
    for i, n in enumerate(words.counts.tolist()):
        if n >= size:
            sets.append(np.unique(found[at[i] : at[i + 1]]))
        else:
            run = hashed[words.offsets[i] : words.offsets[i + 1]]
            whole = np.full(min(n, 1), n, np.uint64)
            for value in run:
                whole = mixed(whole ^ value)
            sets.append(whole)
    return sets


def digest_of(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.astype("<u8").tobytes(), digest_size=16).digest()


# -- meetings -----------------------------------------------------------------


def size_classes() -> list[int]:
    """Lower bounds of the size classes, each half as large again as the last."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2))
    return bounds


def part_count(largest: int, percent: int) -> tuple[int, int]:
    """Parts for pairs whose larger set has at most ``largest`` members, and how many
    of its parts a set leaves out.

    Linked sets x, y differ in at most (100-p)/(100+p) * (|x|+|y|) members, and agree in
    all parts that none of these is in.  With that many parts and ``spare`` + 1 more, they
    agree in ``spare`` + 1 parts or more.
    """
    differ = (100 - percent) * 2 * largest // (100 + percent)
    spare = 2 + differ // 2
    return (0, 0) if differ == 0 else (differ + 1 + spare, spare)


def part_keys(members: np.ndarray, bounds: list[int], percent: int) -> np.ndarray:
    """Keys under which a set meets every set it might link with.

    A set leaves out its ``spare`` least parts, in an order of what is in them: parts of
    few members first, which unlike sets with a passage in common agree in.  Of linked
    sets take the one whose last part left out comes later.  It keeps a part they agree
    in, and as that comes later still, the other set keeps it too.
    """
    n, keys = len(members), []
    at = np.searchsorted(bounds, n, "right") - 1
    # also in the classes of larger sets that could still link
    while at >= 0 and at + 1 < len(bounds) and bounds[at] * percent <= n * 100:
        parts, spare = part_count(bounds[at + 1] - 1, percent)
        if parts:
            part = (mixed(members ^ _PART) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            filled, starts = np.unique(part[order], return_index=True)
            value, held = np.full(parts, _EMPTY), np.bincount(part, minlength=parts)
            # members are in order, so equal parts add up equal terms
            value[filled] = np.add.reduceat(mixed(members[order]), starts) ^ np.bitwise_xor.reduceat(members[order], starts)
            key = mixed(value ^ mixed(np.arange(parts, dtype=np.uint64) + np.uint64(at << 40)))
            keys.append(key[np.lexsort((key, held))[spare:]])
        at += 1
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


# -- bitmaps ------------------------------------------------------------------

_TOKEN = np.uint64(0xA0761D6478BD642F)


def bitmap_of(members: np.ndarray) -> bytes:
    """Bits of a set's members in a bitmap of two bits a member or more, a power of two
    wide, so that a wide one can be folded onto a narrow one."""
    width = max(64, 1 << (2 * len(members) - 1).bit_length()) if len(members) else 64
    bit = (mixed(members ^ _TOKEN) & np.uint64(width - 1)).astype(np.int64)
    flags = np.zeros(width // 8, np.uint8)
    np.bitwise_or.at(flags, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    return flags.tobytes()


def _folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (one a row) folded onto ``words`` words."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] | bitmaps[:, half:]
    return bitmaps


def may_link(bitmaps: list[bytes], sizes: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Do sizes and bitmaps allow that sets a[i] and b[i] link?"""
    ok = (sizes[a] * 100 >= sizes[b] * percent) & (sizes[b] * 100 >= sizes[a] * percent)
    words = np.array([len(m) // 8 for m in bitmaps], np.int64)
    wide = np.stack([words[a], words[b]], 1)
    for x, y in np.unique(wide[ok], axis=0).tolist():
        some = np.flatnonzero(ok & (wide[:, 0] == x) & (wide[:, 1] == y))
        for start in range(0, len(some), max(1, _WORDS // max(x, y))):
            at = some[start : start + max(1, _WORDS // max(x, y))]
            one, two = (np.frombuffer(b"".join(bitmaps[i] for i in side[at].tolist()), np.uint64).reshape(len(at), -1) for side in (a, b))
            one, two = _folded(one, min(x, y)), _folded(two, min(x, y))
            common = np.bitwise_count(one & two).sum(1).astype(np.int64)
            hidden = np.minimum(sizes[a[at]] - np.bitwise_count(one).sum(1), sizes[b[at]] - np.bitwise_count(two).sum(1))
            # an overlap o of sizes x, y links when 100 o >= p (x + y - o)
            ok[at] = (100 + percent) * (common + hidden) >= percent * (sizes[a[at]] + sizes[b[at]])
    return ok


_SETS = (
    "doc_id long, n_shingles long, digest binary, node long, bitmap binary, keys array<long>, later array<long>, met array<long>"
)


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per document: its set's size, digest and bitmap, and the keys to meet under.

    Within a batch equal sets are given once.  A set that may link with the first set of
    the batch under a key is joined to that one (``met``), and the key is kept apart
    (``later``): so a hot key or class enters the shuffle once per batch.
    """
    bounds = size_classes()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digests, nodes, bitmaps, seen = [], [], [], [], set()
        keys: list[np.ndarray] = []
        owner: list[int] = []
        for i, members in enumerate(shingle_sets(batch.column("text"), size)):
            digest = digest_of(members)
            n.append(len(members))
            digests.append(digest)
            nodes.append(int.from_bytes(digest[:8], "little", signed=True))
            bitmaps.append(None)
            if digest not in seen:
                seen.add(digest)
                bitmaps[i] = bitmap_of(members)
                found = part_keys(members, bounds, percent)
                keys.append(found)
                owner += [i] * len(found)
        every = np.concatenate([np.zeros(0, np.uint64), *keys])
        of = np.array(owner, np.int64)
        node = np.array(nodes, np.int64)
        first, inverse = np.unique(every, return_index=True, return_inverse=True)[1:]
        head = of[first][inverse] if len(every) else of
        pairs, which = np.unique(np.stack([of, head]), axis=1, return_inverse=True)
        sizes = np.array(n, np.int64)
        joined = (pairs[0] != pairs[1]) & may_link(bitmaps_or_empty(bitmaps), sizes, pairs[0], pairs[1], percent)
        later = joined[which.ravel()]
        links = pairs[:, joined]
        rows = np.arange(batch.num_rows + 1)

        def lists(values, owners):
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, rows).astype(np.int32)), pa.array(values))

        columns = [
            batch.column("doc_id"),
            pa.array(n, pa.int64()),
            pa.array(digests, pa.binary()),
            pa.array(node),
            pa.array(bitmaps, pa.binary()),
            lists(every[~later].view(np.int64), of[~later]),
            lists(every[later].view(np.int64), of[later]),
            lists(node[links[1]], links[0]),
        ]
        return pa.record_batch(columns, ["doc_id", "n_shingles", "digest", "node", "bitmap", "keys", "later", "met"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(work), _SETS)


def bitmaps_or_empty(bitmaps: list[bytes | None]) -> list[bytes]:
    return [b"" if m is None else m for m in bitmaps]


#: sets under one key that are held against each other; under a key of more all meet
KEY_SETS = 20_000


def _neighbourhoods(sets: DataFrame, classes: DataFrame, percent: int, key_sets: int = KEY_SETS) -> DataFrame:
    """(node, component) of sets that meet another set they may link with."""
    from pyspark.sql import Window

    keys = sets.select("node", F.explode("keys").alias("key"))
    # a key has a row per batch and set that may not link with the first one there
    first = F.min("node").over(Window.partitionBy("key"))
    met = stage(keys.select("key", "node", first.alias("other")).where("node != other"), "met")
    shape = classes.select("node", "n_shingles", "bitmap")
    checked = stage(_checked(met.select("node", "other").distinct(), shape, percent), "checked")
    # keys under which a set may not link with the first one: all sets there are compared
    mixed_keys = met.join(small(checked.where("not ok").select("node", "other")), ["node", "other"]).select("key").distinct()
    mixed_keys = stage(mixed_keys, "keys")
    every = sets.select("node", F.explode(F.concat("keys", "later")).alias("key"))
    there = every.join(small(mixed_keys), "key").distinct()
    there = stage(there, "there")
    # two sets alone under a key have been compared; keys with the same sets count once
    named = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("named")
    groups = there.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("other"), named).where("n > 2")
    once = groups.groupBy("n", "named", "other").agg(F.min("key").alias("key"))
    once = stage(once.select("key", "n", "other"), "groups")
    many = once.where(F.col("n") > key_sets).select("key", "other")
    few = there.join(small(once.where(F.col("n") <= key_sets).select("key", F.col("other").alias("hub"))), "key")
    # keys with the same first set mostly hold the same sets: these are compared at once,
    # each sent once for all of the keys, unless that would be more sets than a key may have
    hubs = stage(few.select("hub", "node").distinct(), "hubs")
    wide = stage(hubs.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > key_sets).select("hub"), "wide")
    alone = few.join(small(wide), "hub").select("key", "node")
    release(sets.sparkSession)
    edges = checked.where("ok").select("node", "other")
    edges = edges.unionByName(there.join(small(many), "key").select("node", "other"))
    edges = edges.unionByName(_compared(hubs.join(small(wide), "hub", "left_anti").withColumnRenamed("hub", "key"), shape, percent))
    if wide.limit(1).count():
        edges = edges.unionByName(_compared(alone, shape, percent))
    early = sets.select("node", F.explode("met").alias("other"))
    edges = stage(edges.unionByName(early).where("node != other").distinct(), "edges")
    release(sets.sparkSession)
    return components(edges, "node", "other")


def _checked(pairs: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, other) with ``ok``: do their sizes and bitmaps allow a link?"""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps = batch.column("bitmap").to_pylist() + batch.column("other_bitmap").to_pylist()
            sizes = np.concatenate([batch.column(c).to_numpy() for c in ("n_shingles", "other_size")])
            at = np.arange(batch.num_rows)
            ok = may_link(bitmaps, sizes, at, at + batch.num_rows, percent)
            yield pa.record_batch([batch.column("node"), batch.column("other"), pa.array(ok)], ["node", "other", "ok"])
        give_back()

    others = shape.select(F.col("node").alias("other"), F.col("n_shingles").alias("other_size"), F.col("bitmap").alias("other_bitmap"))
    both = pairs.join(shape, "node").join(others, "other").select("node", "other", "n_shingles", "bitmap", "other_size", "other_bitmap")
    return both.mapInArrow(work, "node long, other long, ok boolean")


def _compared(there: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Edges (node, other) that connect the sets of a key that may link, found by a tree
    over their bitmaps.  A key has at most ``KEY_SETS`` sets; its rows come one after the
    other in a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "node", "n_shingles", "bitmap")))

        nodes: list[int] = []
        others: list[int] = []
        for _, group in groupby(each(), key=lambda r: r[0]):
            group = list(group)
            found = tree_of_bitmaps([r[3] for r in group], np.array([r[2] for r in group], np.int64), percent)
            nodes += [r[1] for r in group]
            others += [group[i][1] for i in found.tolist()]
            if len(nodes) > 100_000:
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(others, pa.int64())], ["node", "other"])
                nodes, others = [], []
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(others, pa.int64())], ["node", "other"])
        give_back()

    rows = there.join(shape, "node").select("key", "node", "n_shingles", "bitmap")
    spread = rows.repartition("key").sortWithinPartitions("key", "node")
    return spread.mapInArrow(work, "node long, other long").where("node != other").distinct()


# -- the tree join ------------------------------------------------------------


class _Tree:
    """Signature trees over sets, given by their bitmaps."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, hidden: np.ndarray, labels: np.ndarray, exact: bool) -> None:
        # ``hidden``: at most so many members share a bit with another of their set
        self.labels, self.exact = labels, exact
        self.levels = [(bitmaps, sizes, sizes, hidden)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, more = self.levels[-1]
            at = np.arange(0, len(maps), _FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], labels: np.ndarray) -> _Tree:
        """Their bitmaps over one numbering of tokens."""
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        number, times = np.unique(tokens, return_inverse=True, return_counts=True)[1:]
        common = times > 1  # a token of one set alone is in no overlap
        new = np.cumsum(common) - 1
        held = common[number]
        number, owner = new[number[held]], owner[held]
        exact = len(number) == 0 or int(new[-1]) < _MAX_BITS
        width = min(_MAX_BITS, max(64, -(-int(common.sum()) // 64) * 64))
        bit = number % width
        members = np.bincount(owner, minlength=len(sets))
        flags = np.zeros((len(sets), width // 8), np.uint8)
        np.bitwise_or.at(flags, (owner, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
        bitmaps = flags.view(np.uint64)
        return cls(bitmaps, sizes, members - np.bitwise_count(bitmaps).sum(1).astype(np.int64), labels, exact)

    def find(self, i: int) -> int:
        while self.labels[i] != i:
            self.labels[i] = self.labels[self.labels[i]]
            i = self.labels[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.labels[self.labels]
            if (up == self.labels).all():
                return self.labels
            self.labels[:] = up

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Do the sizes and bitmaps of nodes a[i] and b[i] allow a link below them?"""
        maps, low, high, hidden = self.levels[level]
        ok = (high[a] * 100 >= low[b] * percent) & (high[b] * 100 >= low[a] * percent)
        sized = np.flatnonzero(ok)
        # wide bitmaps are taken a few at a time
        step = max(1, _WORDS // maps.shape[1])
        for start in range(0, len(sized), step):
            some = sized[start : start + step]
            x, y = a[some], b[some]
            overlap = np.bitwise_count(maps[x] & maps[y]).sum(1).astype(np.int64) + np.minimum(hidden[x], hidden[y])
            # an overlap o of sizes x, y links when 100 o >= p (x + y - o)
            ok[some] = (100 + percent) * overlap >= percent * (low[x] + low[y])
        return ok

    def below(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of the node pairs (a[i], b[i]), each pair once."""
        count = len(self.levels[level - 1][0])
        x = np.repeat(a * _FAN, _FAN * _FAN) + np.tile(np.repeat(np.arange(_FAN), _FAN), len(a))
        y = np.repeat(b * _FAN, _FAN * _FAN) + np.tile(np.arange(_FAN), len(b) * _FAN)
        ok = (x < count) & (y < count) & (x <= y)
        return x[ok], y[ok]

    def uniform(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each node, the smallest and the largest component below."""
        low = high = self.roots().copy()
        spans = [(low, high)]
        for _ in self.levels[1:]:
            at = np.arange(0, len(low), _FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            spans.append((low, high))
        return spans


def tree_join(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None, joined: np.ndarray | None = None) -> np.ndarray:
    """Component (number of its first set) of each set, walking the tree with itself.

    ``joined``: components known beforehand.  With ``sides``, sets of one side are
    compared only with those of the other.
    """
    count = len(sets)
    order = _order(sets, sides)
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    labels = np.arange(count)
    if joined is not None:
        first: dict[int, int] = {}
        for i in range(count):
            labels[i] = first.setdefault(int(joined[order[i]]), i)
    inside = [sets[i] for i in order]
    tree = _Tree.of_sets(inside, labels)
    _walk(tree, percent, None if sides is None else sides[order], lambda i, j: _linked(inside[i], inside[j], percent))
    return _firsts(tree.roots()[place])


def tree_of_bitmaps(bitmaps: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Component (number of its first set) of each set, where sets are connected if their
    sizes and bitmaps allow a link."""
    count = len(bitmaps)
    order = np.argsort(sizes, kind="stable")
    words = min(len(m) for m in bitmaps) // 8
    folded = np.concatenate([_folded(np.frombuffer(bitmaps[i], np.uint64)[None, :], words) for i in order.tolist()])
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    hidden = sizes[order] - np.bitwise_count(folded).sum(1).astype(np.int64)
    tree = _Tree(folded, sizes[order], hidden, np.arange(count), True)
    _walk(tree, percent, None, None)
    return _firsts(tree.roots()[place])


def _firsts(roots: np.ndarray) -> np.ndarray:
    """Components named by their first member."""
    count = len(roots)
    first_of = np.full(count, count, np.int64)
    np.minimum.at(first_of, roots, np.arange(count))
    return first_of[roots]


def _walk(tree: _Tree, percent: int, side: np.ndarray | None, linked) -> None:
    """Walks the tree with itself and joins the labels of sets that link.

    Pairs the bitmaps allow are put to ``linked`` unless the bitmaps are exact."""
    count = len(tree.labels)

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        roots = tree.roots()
        live = roots[a] != roots[b]
        if side is not None:
            live &= side[a] != side[b]
        a, b = a[live], b[live]
        ok = tree.possible(0, a, b, percent)
        for i, j in zip(a[ok].tolist(), b[ok].tolist()):
            x, y = tree.find(i), tree.find(j)
            if x != y and (tree.exact or linked(i, j)):
                tree.labels[max(x, y)] = min(x, y)

    # neighbours in the order first: they join most of a group of near copies
    for start in range(0, count - 1, _PAIRS):
        some = np.arange(start, min(start + _PAIRS, count - 1))
        compare(some, some + 1)

    top = len(tree.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    spans, age = tree.uniform(), 0
    while stack:
        level, a, b = stack.pop()
        if len(a) > _PAIRS:
            stack += [(level, a[_PAIRS:], b[_PAIRS:])]
            a, b = a[:_PAIRS], b[:_PAIRS]
        if level == 0:
            compare(a, b)
            age += 1
            if age % 8 == 0:
                spans = tree.uniform()
            continue
        low, high = spans[level]
        same = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        a, b = a[~same], b[~same]
        ok = tree.possible(level, a, b, percent)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        stack.append((level - 1, *tree.below(level, a, b)))


def _order(sets: list[np.ndarray], sides: np.ndarray | None) -> np.ndarray:
    """Sets in the order of a tree's leaves: like ones close to each other, side by side."""
    order = np.lexsort((np.arange(len(sets)), [len(s) for s in sets], [int(s[0]) for s in sets]))
    return order if sides is None else order[np.argsort(sides[order], kind="stable")]


def link_counts(sets: list[np.ndarray], weights: np.ndarray, percent: int, sides: np.ndarray | None = None) -> np.ndarray:
    """Of each set, the weights of the others it links with, added up; the tree is walked
    with itself, and every pair that sizes and bitmaps allow is compared.

    With ``sides``, only sets of the other side count."""
    order = _order(sets, sides)
    inside = [sets[i] for i in order]
    weight = np.asarray(weights, np.int64)[order]
    side = None if sides is None else sides[order]
    tree = _Tree.of_sets(inside, np.arange(len(sets)))
    counts = np.zeros(len(sets), np.int64)
    top = len(tree.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    if side is not None:
        # smallest and largest side below each node: a pair of nodes of one side has no pair to count
        spans = [(side, side)]
        for _ in tree.levels[1:]:
            at = np.arange(0, len(spans[-1][0]), _FAN)
            spans.append((np.minimum.reduceat(spans[-1][0], at), np.maximum.reduceat(spans[-1][1], at)))
    while stack:
        level, a, b = stack.pop()
        if len(a) > _PAIRS:
            stack.append((level, a[_PAIRS:], b[_PAIRS:]))
            a, b = a[:_PAIRS], b[:_PAIRS]
        if level == 0:
            a, b = a[a != b], b[a != b]
        if side is not None:
            low, high = spans[level]
            one = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            a, b = a[~one], b[~one]
        ok = tree.possible(level, a, b, percent)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if level:
            stack.append((level - 1, *tree.below(level, a, b)))
            continue
        if not tree.exact:
            same = np.fromiter((_linked(inside[i], inside[j], percent) for i, j in zip(a.tolist(), b.tolist())), bool, len(a))
            a, b = a[same], b[same]
        np.add.at(counts, a, weight[b])
        np.add.at(counts, b, weight[a])
    found = np.empty(len(sets), np.int64)
    found[order] = counts
    return found


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


_MEMBERS = "hood long, part long, other long, side int, doc_id long, label long"


def _join_groups(rows: DataFrame, size: int, percent: int, counted: bool = False) -> DataFrame:
    """Joins the sets of each (hood, part, other); gives (doc_id, label), where the
    label is the smallest label among the sets connected with it there.  With
    ``counted`` it gives (digest, n) instead: the weights (``label``) of the sets that
    link with it there, added up.

    ``rows``: hood, part, other, side, doc_id, label, digest, text; a text whose set has
    another digest is another text of that id and left out.  A group is at most two
    chunks and is taken off the sorted rows of its partition as it comes by.
    """
    spread = rows.repartition("hood", "part", "other").sortWithinPartitions("hood", "part", "other", "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for some in slices(batch):
                    sets = shingle_sets(some.column("text"), size)
                    names = ["hood", "part", "other", "side", "doc_id", "label"]
                    columns = (some.column(c).to_pylist() for c in (*names, "digest"))
                    for *row, digest, members in zip(*columns, sets):
                        if digest_of(members) == digest:
                            yield (*row, members, digest)

        for _, group in groupby(each(), key=lambda r: r[:3]):
            group = list(group)
            labels = np.array([r[5] for r in group], np.int64)
            two = group[0][1] != group[0][2]
            sides = np.array([r[3] for r in group]) if two else None
            if counted:
                n = link_counts([r[6] for r in group], labels, percent, sides)
                some = np.flatnonzero(n)
                digests = pa.array([group[i][7] for i in some.tolist()], pa.binary())
                yield pa.record_batch([digests, pa.array(n[some])], ["digest", "n"])
                continue
            found = tree_join([r[6] for r in group], percent, sides, labels)
            least = np.full(len(group), np.iinfo(np.int64).max)
            np.minimum.at(least, found, labels)
            yield pa.record_batch([pa.array([r[4] for r in group], pa.int64()), pa.array(labels), pa.array(least[found])], ["doc_id", "label", "found"])
        give_back()

    return spread.mapInArrow(work, "digest binary, n long" if counted else "doc_id long, label long, found long")


def _chunked(members: DataFrame, percent: int, docs_most: int, shingles_most: int) -> DataFrame:
    """Adds ``large`` (is the neighbourhood more than a chunk?), ``band``, ``parts``
    (the chunks of the band), and ``part``, the member's chunk."""

    def share(*by: str) -> DataFrame:
        need = F.greatest(F.count("*") / docs_most, F.sum("n_shingles") / shingles_most)
        return members.groupBy(*by).agg(F.ceil(need).cast("long").alias("parts"))

    whole = share("hood").select("hood", (F.col("parts") > 1).alias("large"))
    members = members.join(whole, "hood")
    # a little wider than the sizes of linked sets can be apart
    width = float(np.log(100 / percent) * 1.0001)
    band = F.when(F.col("large"), F.floor(F.log(F.col("n_shingles").cast("double")) / width)).otherwise(F.lit(0))
    members = members.withColumn("band", band.cast("long"))
    members = members.join(share("hood", "band"), ["hood", "band"])
    return members.withColumn("part", _chunk(F.col("band"), F.pmod(F.xxhash64("doc_id"), F.col("parts"))))


def _chunk(band, number):
    return F.shiftleft(band, 40) + number


def similar(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    chunk_docs: int = CHUNK_DOCS,
    chunk_shingles: int = CHUNK_SHINGLES,
    links: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, rows) of every document of ``docs`` (doc_id,
    text); ``rows`` counts the rows of the id.

    With ``links`` also ``n_links``, the number of documents whose set links with the
    document's own, equal sets included.  All pairs of unlike sets of a neighbourhood
    that its trees do not rule out are compared for it.  Of an id with several sets the
    links of all sets are added up."""
    with scratch(docs.sparkSession):
        return stage(_similar(docs, shingle, percent, chunk_docs, chunk_shingles, links), "similar", keep=True)


def _similar(docs: DataFrame, shingle: int, percent: int, chunk_docs: int, chunk_shingles: int, links: bool) -> DataFrame:
    texts = docs.select("doc_id", "text")
    sets = stage(_sets(texts, shingle, percent), "sets")
    named = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # rows with a null id link with nothing, but a batch may have named its set by them
    shapes = sets.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.max("bitmap").alias("bitmap")
    )
    shapes = stage(shapes, "classes")
    classes = shapes.where("rep is not null").drop("bitmap")
    hoods = _neighbourhoods(sets, shapes, percent).select("node", F.col("component").alias("hood"))
    members = classes.join(hoods, "node").select("hood", F.col("rep").alias("doc_id"), "n_shingles", "digest")
    members = stage(_chunked(members, percent, chunk_docs, chunk_shingles), "members")
    release(docs.sparkSession)

    def with_text(rows: DataFrame) -> DataFrame:
        # repeated rows of an id would bring several sets under one name
        one = texts.where(F.col("doc_id").isNotNull())
        return one.join(small(rows), "doc_id")

    def join(rows: DataFrame) -> DataFrame:
        return _join_groups(with_text(rows), shingle, percent)

    # each chunk with itself
    chunks = members.select("hood", "part", F.col("part").alias("other"), F.lit(0).alias("side"), "doc_id", F.col("doc_id").alias("label"), "digest")
    found = stage(join(chunks), "joined")
    large = members.where("large")
    if large.limit(1).count():
        found = _across(large, found, join, percent, chunk_docs, chunk_shingles)
    joined = sets.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.count("*").alias("rows"))
    whole = _whole(named, classes, found, bool(large.limit(1).count()) or _repeated(named))
    joined = joined.join(whole, F.col("doc_id") == F.col("node"), "left")
    joined = joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "rows")
    if not links:
        return joined
    release(docs.sparkSession)
    counts = _link_counts(named, members, lambda rows: _join_groups(with_text(rows), shingle, percent, counted=True))
    return joined.join(counts.withColumnRenamed("doc_id", "node"), F.col("doc_id") == F.col("node"), "left").select(
        *joined.columns, F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links")
    )


def _link_counts(named: DataFrame, members: DataFrame, count) -> DataFrame:
    """(doc_id, n_links) of the documents with a set: those with the same set, and those of
    the sets that link with it.  A chunk is compared with itself and with every chunk of
    its band and of the next one; what comes out is a number for each set and pair of
    chunks, not the pairs."""
    copies = named.select("doc_id", "digest").distinct()
    weights = stage(copies.groupBy("digest").agg(F.count("*").alias("weight")), "weights")
    weighed = stage(members.join(weights, "digest").withColumnRenamed("weight", "label"), "weighed")
    columns = ["hood", "part", "other", "side", "doc_id", "label", "digest"]
    pairs = weighed.select("*", F.col("part").alias("other"), F.lit(0).alias("side")).select(*columns)
    found = stage(count(pairs), "counts")
    large = weighed.where("large")
    if large.limit(1).count():
        found = found.unionByName(stage(count(_chunk_pairs(large, large)), "counts"))
    linked = found.groupBy("digest").agg(F.sum("n").alias("n"))
    each = copies.join(weights.join(linked, "digest", "left"), "digest")
    n = F.sum(F.col("weight") - 1 + F.coalesce("n", F.lit(0)))
    return each.groupBy("doc_id").agg(n.cast("long").alias("n_links"))


def _repeated(named: DataFrame) -> bool:
    """Does an id have several sets?"""
    return bool(named.groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("many")).where("many").limit(1).count())


def _whole(named: DataFrame, classes: DataFrame, found: DataFrame, chained: bool) -> DataFrame:
    """(node, component) of all documents with a set.

    A class takes the component of its first document, the smallest of them.  Only
    where joins of several chunks, or several sets of one id, must be put together
    are their links chained.
    """
    copies = named.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest")
    if chained:
        links = found.where("doc_id != found").select(F.col("doc_id").alias("u"), F.col("found").alias("v"))
        links = links.unionByName(copies.where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
        return components(links)
    firsts = found.select(F.col("doc_id").alias("rep"), "found").distinct()
    return copies.join(firsts, "rep", "left").select(F.col("doc_id").alias("node"), F.coalesce("found", "rep").alias("component")).distinct()


def _across(large: DataFrame, found: DataFrame, join, percent: int, chunk_docs: int, chunk_shingles: int) -> DataFrame:
    """Links between the chunks of large neighbourhoods, added to ``found``."""
    large = large.select("hood", "band", "part", "parts", "doc_id", "n_shingles", "digest")
    # leaders of components in bands of several chunks, joined among themselves as
    # long as that leaves fewer of them
    leaders = large.where("parts > 1").join(found.where("doc_id = found").select("doc_id"), "doc_id", "left_semi")
    leaders = stage(leaders.select("hood", "doc_id", "n_shingles", "digest"), "leaders")
    before = leaders.count()
    while before:
        some = stage(_chunked(leaders, percent, chunk_docs, chunk_shingles), "leaders")
        rows = some.select("hood", "part", F.col("part").alias("other"), F.lit(0).alias("side"), "doc_id", F.col("doc_id").alias("label"), "digest")
        more = stage(join(rows), "joined")
        found = stage(found.unionByName(more), "joined")
        left = some.join(more.where("doc_id = found").select("doc_id"), "doc_id", "left_semi")
        leaders = stage(left.select("hood", "doc_id", "n_shingles", "digest"), "leaders")
        after = leaders.count()
        if after > before * 3 // 4 or not some.where("parts > 1").limit(1).count():
            break
        before = after
    # pairs of chunks whose neighbourhood still holds two components
    labels = stage(_labels(large, found), "labels")
    several = labels.groupBy("hood").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("hood")
    rest = labels.join(several, "hood", "left_semi")
    crossed = join(_chunk_pairs(large, rest))
    # components, not single sets, are what such a join connects
    tied = crossed.select(F.col("label").alias("doc_id"), "label", "found")
    return stage(found.unionByName(tied), "joined")


def _chunk_pairs(large: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` once for each other chunk of their band and the next ones, as a group of
    both chunks; ``large`` has all members of these neighbourhoods."""
    bands = large.select("hood", F.col("band").alias("mate_band"), F.col("parts").alias("mates")).distinct()
    near = rows.withColumn("mate_band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("mates") - 1)).alias("number")
    mates = near.join(bands, ["hood", "mate_band"]).select("*", number).withColumn("mate", _chunk(F.col("mate_band"), F.col("number")))
    return mates.where("mate != part").select(
        "hood",
        F.least("part", "mate").alias("part"),
        F.greatest("part", "mate").alias("other"),
        F.when(F.col("part") < F.col("mate"), 0).otherwise(1).alias("side"),
        "doc_id",
        "label",
        "digest",
    )


def _labels(large: DataFrame, found: DataFrame) -> DataFrame:
    """The members with their component so far."""
    whole = components(found.select(F.col("doc_id").alias("u"), F.col("found").alias("v")))
    at = large.join(whole, F.col("doc_id") == F.col("node"), "left")
    return at.select(*large.columns, F.coalesce("component", "doc_id").alias("label"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of equal or linked texts.

    Texts decide, not ids: of unlike texts of one id each is judged on its own, and rows
    with a null id are like others.  The row with the smallest id (null last) stays.
    Rows without a word, which link with nothing, all stay.
    """
    key, place = unused(docs, "_key"), unused(docs, "_row")
    word = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    # copies under different ids differ, so that one of them stands for all in the join
    keyed = docs.where(word).withColumn(key, F.xxhash64("doc_id", "text"))
    found = similar(keyed.select(F.col(key).alias("doc_id"), "text"), shingle, percent)
    named = keyed.select(key, "doc_id").join(found.select(F.col("doc_id").alias(key), "component_id", "rows"), key)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"), "rows")
    best = named.groupBy("component_id").agg(F.min(order).alias("best"))
    first = stage(best.select(F.col("best.key").alias(key), F.col("best.rows").alias("rows")), "first")
    once = keyed.join(small(first.where("rows = 1").select(key)), key, "left_semi").select(*docs.columns)
    several = keyed.join(small(first.where("rows > 1").select(key)), key, "left_semi")
    # grouped by the text's digest too, should two texts ever share a key
    one = several.groupBy(key, F.md5(F.col("text").cast("binary"))).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(place))
    return once.unionByName(one.select(f"{place}.*")).unionByName(docs.where(~word))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=85, links=True)
