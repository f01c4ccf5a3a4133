"""Near duplicates against all pairs, and rows that share an id."""

import random

import numpy as np
import pytest

from shelfmark.llm import decontaminate, jaccard


def sets_of(text, size):
    words = (text or "").lower().split()
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows, size, percent):
    """Smallest id reachable from each id; rows of an id share their links."""
    sets = [(i, sets_of(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def brute_links(rows, size, percent):
    """Number of documents that link with each id, equal sets included; of an id with
    several sets the numbers are added up."""
    sets = {(i, frozenset(sets_of(t, size))) for i, t in rows if i is not None}
    counts = {i: 0 for i, _ in sets}
    for n, (i, x) in enumerate(all_ := sorted(sets, key=lambda s: (s[0], sorted(s[1])))):
        for j, y in all_[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                counts[i] += 1
                counts[j] += 1
    return counts


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 90, 200]))]
        if rng.random() < 0.6:
            base[2:2] = passage[: rng.randint(20, 60)]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy + rng.sample(words, rng.randint(0, 6))))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(rows[3][0], None), (rows[4][0], ""), (rows[5][0], texts[0]), (None, texts[1]), (None, None), (900, " \n"), (901, texts[2])]


@pytest.mark.parametrize("seed, chunk, keys", [(1, 4096, 20_000), (2, 3, 20_000), (3, 2, 2), (4, 4096, 1)])
def test_components_are_those_of_all_pairs(spark, seed, chunk, keys, monkeypatch):
    monkeypatch.setattr(jaccard, "KEY_SETS", keys)
    rows = corpus(seed)
    # sets of their own under one id, which is then the first of several classes
    rows += [(-1, " ".join(f"q{i}" for i in range(n, n + 40))) for n in (0, 1, 2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.similar(docs, 4, 85, chunk_docs=chunk, links=True).collect()
    want = brute_components(rows, 4, 85)
    assert {r.doc_id: r.n_links for r in got if r.doc_id is not None} == brute_links(rows, 4, 85)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert len(got) == len({r[0] for r in rows})


def test_link_counts_with_inexact_bitmaps(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(jaccard, "_MAX_BITS", 64)
    bases = [rng.choice(10**6, n) for n in (30, 80, 300)]
    sets = [np.unique(np.concatenate([rng.permutation(b)[rng.integers(0, 6) :], rng.choice(10**6, 3)])).astype(np.uint64) for b in bases for _ in range(60)]
    weights, sides = rng.integers(1, 5, len(sets)), rng.integers(0, 2, len(sets))
    for side in (None, sides):
        want = np.zeros(len(sets), np.int64)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                both = len(np.intersect1d(x, y))
                if i != j and (side is None or side[i] != side[j]) and 100 * both >= 85 * (len(x) + len(y) - both):
                    want[i] += weights[j]
        assert want.any() and (jaccard.link_counts(sets, weights, 85, side) == want).all()


def test_one_row_of_each_group_stays(spark):
    rows = corpus(5) + [(3, "quite another text of the same id as before it"), (None, "a text that has no id and no copy at all")]
    docs = spark.createDataFrame([(i, t, "x", "rep") for i, t in rows], "doc_id long, text string, node string, digest string")
    kept = jaccard.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    texts = sorted({t for _, t in rows if sets_of(t, 5)})
    groups = brute_components(list(enumerate(texts)), 5, 80)
    got = [r.text for r in kept.collect()]
    worded = [t for t in got if sets_of(t, 5)]
    assert sorted(groups[texts.index(t)] for t in worded) == sorted(set(groups.values()))
    assert len(got) - len(worded) == sum(not sets_of(t, 5) for _, t in rows)


def test_rows_that_share_an_id_are_judged_apart(spark):
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(None, "clean one"), (None, f"see {item} there"), (None, "clean two"), (7, item), (7, "clean seven"), (8, None), (9, item), (9, item)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, _hit int")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str) == sorted([(None, "clean one"), (None, "clean two"), (7, "clean seven"), (8, None)], key=str)
