"""Decontamination of long texts and large benchmarks: bounded rows, one block at a time, the same finds."""

import random

from shelfmark.llm import decontaminate

from conftest import plan_of

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def found(docs, benchmark, percent=80):
    return {tuple(r) for r in decontaminate.contained(docs, benchmark, percent).collect()}


def test_a_long_text_meets_an_item_of_many_ids(spark):
    item = " ".join(f"q{i}" for i in range(40))
    # a hit that took the text along would be 480 kB: 15 GB in all, held at once
    text = " ".join(f"w{i}" for i in range(30_000)) + f" {item} " + " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, text.replace("q20", "no"))], DOCS)
    benchmark = spark.createDataFrame([(k, item) for k in range(300)] + [(None, item)], ITEMS)
    ids = [*range(300), None]
    assert found(docs, benchmark) == {(1, k, 40, 40) for k in ids} | {(2, k, 40, 39) for k in ids}


def test_blocks_of_a_benchmark_are_not_broadcast_together(spark, monkeypatch):
    items = [[f"i{n}x{k}" for k in range(20)] for n in range(30)]
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], ITEMS)
    docs = spark.createDataFrame([(n, "a b " + " ".join(w) + " c") for n, w in enumerate(items)], DOCS)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    rows = decontaminate.contained(docs, benchmark)
    assert plan_of(rows).split("== Initial Plan ==")[0].count("BroadcastExchange (") <= 1
    assert {tuple(r) for r in rows.collect()} == {(n, n, 20, 20) for n in range(30)}
    assert decontaminate.decontaminate(docs.union(spark.createDataFrame([(99, "a b c")], DOCS)), benchmark).count() == 1


def test_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    items = {n: [f"{n}x{i}" for i in range(n)] for n in (1, 3, 5, 8, 13, 30, 70)}
    texts = []
    for _ in range(60):
        said = []
        for n in rng.choices(list(items), k=rng.randrange(5)):
            at = rng.randrange(max(1, n - 15))
            part = [w if rng.random() < 0.9 else "no" for w in items[n][at:]]
            said += [f"f{rng.randrange(50)}" for _ in range(rng.randrange(9))] + part
        texts.append(" ".join(said))
    # one word again and again, in a text and an item
    texts += ["0 " * 40, "0 " * 7, "", None]
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(99, "0 " * 30), (98, "0 " * 30)], ITEMS)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for percent in (60, 80):
        whole = found(docs, benchmark, percent)
        assert len(whole) > 40
        for words in (1, 2, 7):
            monkeypatch.setattr(decontaminate, "CHUNK_WORDS", words)
            assert found(docs, benchmark, percent) == whole
        monkeypatch.undo()
