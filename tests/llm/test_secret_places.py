"""Every place of a candidate is a finding with its own context."""

import random
import time

from pyspark.sql import functions as F

from shelfmark.llm import secrets

KEY = "a1b2c3d4e5f6a7b8c9d0"


def test_every_place_with_its_context(spark):
    texts = [
        f"\U0001f600 example {KEY} and much more text until it is far away from there, token = {KEY}",
        f"API_KEY={KEY} password=={KEY[:12]}; x{KEY}x {KEY}",
        "YWJjZGVmZ2gxMjM0NTY3OA== then YWJj1GVmZ2g= and YWJj1GVmZ2==",
        None,
        f"{KEY}",
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*texts, texts[4]])], "doc_id long, text string, source string")
    docs = docs.withColumn("doc_id", F.least("doc_id", F.lit(4)))
    rows = secrets.described(secrets.candidates(docs), spark.createDataFrame([("word",)], "word string")).collect()
    got = sorted((r.doc_id, r.start, r.candidate) for r in rows)
    want = [(0, 10, KEY), (0, texts[0].rindex(KEY), KEY)]
    want += [(1, 8, KEY), (1, 39, KEY[:12]), (1, 53, f"x{KEY}x"), (1, 76, KEY)]
    want += [(2, 0, "YWJjZGVmZ2gxMjM0NTY3OA=="), (2, 30, "YWJj1GVmZ2g="), (2, 47, "YWJj1GVmZ2==")]
    want += [(4, 0, KEY), (4, 0, KEY)]
    assert got == want
    assert all(texts[i][at : at + len(c)] == c for i, at, c in got)
    by = {(r.doc_id, r.start): (r.f_named, r.f_assigned, r.f_sample_near) for r in rows}
    assert by[0, 10] == (0.0, 0.0, 1.0) and by[0, want[1][1]] == (1.0, 1.0, 0.0)
    assert by[1, 8] == (1.0, 1.0, 0.0) and by[1, 39] == (1.0, 1.0, 0.0)


def test_contexts_are_those_of_the_text(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        pieces = [rng.choice(["", " ", "\U0001f600\n", " key = '", "words and more words ", "long " * 30, "="]) + rng.choice([KEY, KEY[:12], "a" * 25, "9" * 13]) for _ in range(rng.randint(1, 12))]
        texts.append(" ".join(pieces) + rng.choice(["", " end", "'"]))
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = secrets.candidates(docs).collect()
    assert len(rows) > 200
    for r in rows:
        text, end = texts[r.doc_id], r.start + len(r.candidate)
        assert text[r.start : end] == r.candidate
        assert r.before == text[max(r.start - 48, 0) : r.start] and r.after == text[end : end + 24]


def test_a_text_of_many_candidates_takes_time_in_proportion(spark):
    many = 200_000
    docs = spark.createDataFrame([(1, " ".join(f"{i:013d}" for i in range(many)), "s")], "doc_id long, text string, source string")
    begin = time.monotonic()
    got = secrets.candidates(docs).agg(F.count("*"), F.max("start"), F.count_distinct("before")).first()
    assert tuple(got) == (many, (many - 1) * 14, many)
    assert time.monotonic() - begin < 60


def test_forest_judges_what_does_not_label_itself(spark):
    """Keys and other long strings of which a third say nothing about themselves."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, secret = [], set()
    for i in range(900):
        kind = i % 3
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40)) if kind == 0 else str(rng.randrange(10**15, 10**16)) if kind == 1 else "".join(rng.choices(words, k=4))
        if kind == 0:
            secret.add(i)
        # every second key is assigned to a telling name, one other string in ten to some name
        name = 'token = "' if kind == 0 and i % 2 else "size: " if kind and i % 10 == 0 else ""
        rows.append((i, f"{prose(9)} {name}{value} {prose(9)}", "src"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.scan(docs, spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert len(found) == 900
    flagged = {r.doc_id for r in found if r.is_secret}
    assert len(flagged & secret) / len(secret) > 0.95 and len(flagged - secret) / 600 < 0.02
