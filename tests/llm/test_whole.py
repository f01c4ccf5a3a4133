"""Cases of which an operator must not settle for less than the whole job."""

from itertools import combinations

from pyspark.sql import functions as F

from shelfmark.llm import decontaminate

# -- decontamination ----------------------------------------------------------


def words(name, n):
    return [f"{name}{i}" for i in range(n)]


def test_stretches_of_items_count_whatever_their_length(spark):
    items = {n: words(f"i{n}x", n) for n in (1, 4, 6, 20, 250, 256, 257, 600)}
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    texts, want = [], set()

    def add(said, *found):
        want.update((len(texts), n) for n in found)
        texts.append((len(texts), "before " + " ".join(said) + " after"))

    for n in (250, 256, 257, 600):
        add(items[n][60:210], n)
        add(items[n][100:113], n)
        add(items[n][100:112])
        add([w if i % 5 else "no" for i, w in enumerate(items[n][100:120])], n)
        add([w if i % 3 else "no" for i, w in enumerate(items[n])])
    # where pieces meet
    for at in range(205, 260):
        add([w if i % 5 else "no" for i, w in enumerate(items[600][at : at + 17])], 600)
    add(items[20][3:16], 20)
    add(items[4], 4)
    add(items[4][:3])
    add(items[6][:2] + ["other"] + items[6][3:], 6)
    add(items[6][:2] + ["other", "other"] + items[6][4:])
    add(items[1], 1)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, benchmark).collect()}
    assert got == want


def test_short_items_are_found_with_any_words_replaced(spark):
    items = {n: words(f"s{n}x", n) for n in (5, 7, 8, 9, 10, 13, 15, 16)}
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    texts, want = [], {}
    for n, item in items.items():
        for off in range(4):
            for some in combinations(range(n), off):
                want[len(texts)] = {n} if 5 * (n - off) >= 4 * n else set()
                texts.append((len(texts), " ".join("no" if i in some else w for i, w in enumerate(item))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: {r.item_id} for r in decontaminate.contained(docs, benchmark).collect()}
    # of 16 words a run of 13 counts as well
    assert got == {k: v for k, v in want.items() if v}


def test_masks_fit_all_stretches():
    for percent in (60, 80, 90):
        for length in range(1, 17):
            need = decontaminate.least_agreeing(length, percent)
            masks = [(len(m), int(m[::-1], 2)) for m in decontaminate.masks_of(length, percent)]
            for some in combinations(range(length), need):
                if need * 100 >= percent * (some[-1] - some[0] + 1):
                    bits = sum(1 << k for k in some)
                    assert any((bits >> s) & m == m for k, m in masks for s in range(length - k + 1)), (percent, some)
