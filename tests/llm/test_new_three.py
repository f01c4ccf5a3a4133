"""Hard negatives, fill-in-the-middle and repeated substrings against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import fill_middle, negatives, repeats

# -- hard negatives -----------------------------------------------------------


def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    kept = {}
    for vec_id, label, vector in rows:
        if vec_id is not None and label is not None and vector is not None and None not in vector:
            kept[vec_id] = min(kept.get(vec_id, (label, vector)), (label, vector))
    out = []
    for a, (label, vector) in kept.items():
        if not is_anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(vector, v)), i, own) for i, (own, v) in kept.items() if i != a)
        for p, positive, _ in [s for s in scores if s[2] == label][:positives]:
            fits = [s for s in scores if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(a, positive, n + 1, other, -p, -score) for n, (score, other, _) in enumerate(fits)]
    return sorted(out)


SCHEMA = "vec_id long, label long, vector array<long>, _row string, rank int"


@pytest.mark.parametrize("dims, large", [(1, 3), (7, 200), (8, 200), (19, 100_000), (16, 1 << 20)])
def test_negatives_are_those_of_brute_force(spark, dims, large, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_VALUES", dims * 5)  # several blocks
    rng = random.Random(dims)
    rows = [(i - 40, rng.randrange(3), [rng.randint(-large, large) for _ in range(dims)]) for i in range(300)]
    hot = rows[7][2]  # a third of the rows share a vector
    rows = [(i, label, hot if n % 3 == 0 else v) for n, (i, label, v) in enumerate(rows)]
    found = negatives.hard_negatives(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, lambda i: i % 20 == 0)


def test_odd_vectors(spark):
    rows = [(0, 1, [1, 2, 3]), (0, 1, [1, 2, 3]), (0, 2, [9]), (1, 1, [4, 5]), (2, 2, [2, 2, 1, 7]), (3, None, [1]), (4, 1, None)]
    rows += [(None, 1, [1]), (5, 1, [1, None]), (6, 1, []), (7, 3, [3, 1]), (7, 3, [3, 1])]
    found = negatives.hard_negatives(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA), F.lit(True))
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, lambda i: True)
    empty = negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True))
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [1 << 40], "", 1)], SCHEMA), F.lit(True))


def test_planes_hold_the_numbers():
    values = np.array([[0, -1, 5, -128, 127], [1, 0, 0, 0, 0]])
    assert negatives.bits_of(values).tolist() == [8, 2]
    tables = negatives.Tables(np.array([[3, -4, 5, 6, 7], [1, 1, 1, 1, -1]]), 9)
    assert (tables.score(negatives.pack(values, 9)) == values @ np.array([[3, -4, 5, 6, 7], [1, 1, 1, 1, -1]]).T).all()


# -- fill in the middle -------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "one", " one two\n\nthree  ", "äö  x\x0b\x85 ü€😀 end", "a<P>b c", "x " * 5000, "w" * 3000 + " " * 700 + "tail a b c"]
TEXTS += [" ".join("abcdefghij"[: 1 + (i * i) % 9] * (1 + (i // 50) % 7) for i in range(n)) + " " * (n % 3) for n in (10, 300, 4000)]


def test_boundaries_and_index():
    texts = pa.array(TEXTS)
    found = fill_middle.boundaries(texts)
    want = [[0, *(m.end() for m in TOKEN.finditer(t or ""))] for t in TEXTS]
    assert [found.offsets[a:b].tolist() for a, b in zip(found.starts, found.starts[1:])] == want
    for error in (0, 5, 127):
        index = fill_middle.fit(found, error)
        assert (index.offsets(np.arange(len(found.offsets))) == found.offsets).all()
        assert np.abs(index.residuals.astype(int)).max() <= error
    assert len(fill_middle.fit(found).first) < len(found.offsets) // 20
    cut = texts.slice(2, 5)
    assert fill_middle.boundaries(cut).offsets.tolist() == sum(want[2:7], [])


def brute_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, len(tokens), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_texts_are_cut_as_by_hand(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(3, "one"), (None, "no id at all"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, output string, n int")
    made = fill_middle.fill_in_middle(docs).withColumn("restored", fill_middle.restored())
    got = [tuple(r) for r in made.collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((r[:6] for r in got), key=key) == sorted((brute_fim(*r) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert sorted((r[6], r[0] or -1) for r in got) == sorted((t or "", i or -1) for i, t in rows)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_index_table(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in fill_middle.rank_index(docs).collect():
        want = [0, *(m.end() for m in TOKEN.finditer(TEXTS[row.doc_id] or ""))]
        ends = [r - 1 for r in row.ranks[1:]] + [row.n]
        got = []
        for first, last, low, high in zip(row.ranks, ends, row.low, row.high):
            got += [low + (k - first) * (high - low) // max(last - first, 1) for k in range(first, last + 1)]
        assert [a + b for a, b in zip(got, np.frombuffer(row.residuals, np.int8).tolist())] == want


# -- repeated substrings ------------------------------------------------------


def brute_repeats(texts, length):
    count = {}
    for t in texts:
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            count[s] = count.get(s, 0) + 1
    out = []
    for t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if count[data[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2).tolist()
        out.append((len(data), [tuple(s) for s in spans], bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    words = [word() for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(length // 3) for _ in range(4)]
    texts = [None, "", "short", "a" * (3 * length), "ab" * length + "c", "xyz" * length, "a" * length, "q" + "a" * length]
    for n in range(60):
        parts = [text(rng.randint(1, length // 2))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            cut = rng.randint(0, length // 2)
            parts += [passage[cut : len(passage) - rng.randint(0, 20)], text(rng.randint(1, 30))]
        texts.append(" ".join(parts))
    for n in range(40):  # near copies: a few letters changed
        t = list(texts[10 + n % 7])
        for _ in range(n % 4):
            t[rng.randrange(len(t))] = "Z"
        texts.append("".join(t))
    return texts + texts[20:24] + [shared[0]] * 3


@pytest.mark.parametrize("length, piece", [(64, 1 << 18), (64, 100), (41, 1 << 18), (8, 500), (400, 1 << 18)])
def test_repeats_are_those_of_brute_force(spark, length, piece, monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", piece)
    texts = corpus(length, length)
    docs = spark.createDataFrame([(None if i == 9 else i % 100, t, b"x", 1) for i, t in enumerate(texts)], "doc_id long, text string, digest binary, p int")
    found = repeats.remove_repeats(docs.repartition(5), length).collect()
    want = [(None if i == 9 else i % 100, *w) for i, w in enumerate(brute_repeats(texts, length))]
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found]
    key = lambda r: (r[0] is None, r[0], r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(len(r[2]) for r in got) > 40


def test_many_shuffled_rows_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_BROADCAST_BYTES", -1)
    monkeypatch.setattr(repeats, "_BLOCK", 300)
    texts = corpus(5, 50)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in repeats.remove_repeats(docs, 50).collect()}
    assert got == {i: w[1] for i, w in enumerate(brute_repeats(texts, 50))}


@pytest.mark.parametrize("bucket", [1, 3])
def test_large_buckets_are_refined_by_string(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    texts = corpus(6, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in repeats.remove_repeats(docs, 60).collect()}
    assert got == {i: w[1] for i, w in enumerate(brute_repeats(texts, 60))}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).count() == 0
    one = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r[1:]) for r in repeats.remove_repeats(one).collect()] == [(0, [], b""), (0, [], b"")]
