"""Every operator and stage on small tables with all the odd cases."""

import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import decontaminate, jaccard, mixing, outliers, quality_trees, records, redirects, secrets, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, hood long, size int, _mark string"
LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(60_000))


def rows_of(texts):
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], None if t is None else len(t), 5, 6, 7, "x"))
    return out


ODD = [None, "", " \n\t", "one", "one two", "one two three four five six", "one two three four five six", LONG, LONG + " tail", "a\u2028b \u00e9\u0301 <|endoftext|> #$%"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = rows_of(ODD)
    rows += [rows[5], rows[5], (None, "null id one two three four five", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 0, 1), (8, 0, 1), (5, 1, 0), (None, 1, 1), (3, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(0, " ".join(f"item{i}" for i in range(20))), (1, None), (2, ""), (3, "too short"), (0, " ".join(f"item{i}" for i in range(20)))]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


# -- records ------------------------------------------------------------------


def test_records_round_trip(spark, odd, tmp_path, tokenizer):
    from tokenizers import Tokenizer

    index = records.write_records(odd, str(tmp_path), tokenizer, 2, file_bytes=200_000)
    assert index.select("file").distinct().count() > 1
    encode = Tokenizer.from_file(tokenizer)
    want = []
    for row in odd.collect():
        ids = encode.encode(row.text or "", add_special_tokens=False).ids + [2]
        want.append((row.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = records.read_records(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert sorted(r.n_tokens for r in got if r.doc_id is None) == sorted(w[1] for w in want if w[0] is None)
    got.sort(key=lambda r: (r.shard, r.record))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [records.NULL_ID if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    shuffled = records.fetch_records(index.orderBy(F.rand(1)), str(tmp_path))
    sums = {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in shuffled.where("doc_id is not null").collect()}
    assert sums == {w[0]: w[2] for w in want if w[0] is not None}


def test_damaged_records_are_noticed(spark, odd, tmp_path, tokenizer):
    records.write_records(odd, str(tmp_path), tokenizer, 2)
    path = next(tmp_path.glob("*.records"))
    data = bytearray(path.read_bytes())
    data[30] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(spark, str(tmp_path)).collect()


def test_files_of_lost_attempts_do_not_count(spark, odd, tmp_path, tokenizer):
    records.write_records(odd, str(tmp_path), tokenizer, 2)
    (tmp_path / "part-000000.lost.records").write_bytes(b"half a frame")
    assert records.sweep(spark, str(tmp_path)) == ["part-000000.lost.records"]
    assert records.read_records(spark, str(tmp_path)).count() == odd.count()


def test_no_records(spark, empty, tmp_path, tokenizer):
    records.write_records(empty, str(tmp_path), tokenizer, 2)
    assert records.read_records(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text", ["a \x0b! !\x0b! x", "é ́x I'M don't a\u0085b it'S ª²x\xadk", "Σας ς İX ß", "a​b 1234 12a\xa0b", "a\x1cb! \x1c! x\x0c! <|startoftext|>a"])
def test_words_encode_as_the_whole_text(text, tokenizer):
    encode = records.Encoder(tokenizer)
    assert encode.texts(pa.array([text]))[0].tolist() == encode.whole(text)


# -- toxicity and quality -----------------------------------------------------


@pytest.mark.parametrize("run", [lambda d, k: toxicity.toxicity(d, k, toxicity.fold(5) == 0), lambda d, k: quality_trees.classify(d, k, toxicity.fold(4) == 2)])
def test_classifiers_score_every_row(run, odd, empty, labels):
    got = run(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert run(empty, labels).count() == 0
    none = run(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_held_out_labels_are_not_learned(odd, labels, spark):
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda k: {r.doc_id: r.score for r in toxicity.toxicity(odd, k, toxicity.fold(5) == 0).where("doc_id is not null").collect()}
    assert score(labels) == score(flipped)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = quality_trees.grow(x[:2000], y[:2000])
    assert ((quality_trees.walk(forest, x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.95


def test_walk_equals_a_walk_node_by_node():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    forest = quality_trees.grow(x, (x[:, 1] > 0).astype(float), quality_trees.Settings(trees=5, least=0.1))
    for row, got in zip(x, quality_trees.walk(forest, x)):
        total = forest.base
        for t in range(5):
            k = 0
            while k < forest.feature.shape[1]:
                k = 2 * k + 1 + int(row[forest.feature[t, k]] > forest.threshold[t, k])
            total += forest.leaf[t, k - forest.feature.shape[1]]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


# -- other operators ----------------------------------------------------------


def test_jaccard_odd_cases(odd, empty):
    got = jaccard.similar(odd, 4, 85).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert len(by) == 10 and by[0] == (0, 0) and by[1] == (0, 1) and by[3] == (1, 3) and by[4] == (1, 4)
    assert by[5] == (3, 5) and by[6] == (3, 5) and by[8][1] == 7
    assert jaccard.similar(empty).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 7, 9]
    assert kept.where("doc_id is null").count() == 2


def test_contained_items(spark, odd, empty, benchmark):
    item = [f"item{i}" for i in range(20)]
    two = item[:4] + ["other"] + item[5:11] + ["words"] + item[12:]
    far = [w if i % 3 else "no" for i, w in enumerate(item)]
    texts = ["x y " + " ".join(item) + " z", "Start: " + " ".join(two).upper() + ".", " ".join(far), " ".join(item[:12]), LONG + " " + ", ".join(item)]
    docs = spark.createDataFrame(rows_of(texts), DOCS).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100))
    got = {(r.doc_id, r.item_id): (r.item_words, r.matched) for r in decontaminate.contained(docs, benchmark).collect()}
    assert got == {(0, 0): (20, 20), (1, 0): (20, 18), (4, 0): (20, 20)}
    left = decontaminate.decontaminate(docs, benchmark)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    assert decontaminate.contained(empty, benchmark).count() == 0
    assert decontaminate.contained(odd, benchmark.limit(0)).count() == 0


def test_mix_keeps_to_targets(spark, odd, empty):
    rng = np.random.default_rng(3)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 400, 3000)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 7}" if i % 50 else None, 0, 0, 0, 0, "") for i, t in enumerate(texts)], DOCS)
    got = mixing.mix(docs, group=100, fan=4).collect()
    assert len(got) == 3000
    for source in {r.source for r in got}:
        rows = [r for r in got if r.source == source]
        taken = sum(r.size * r.copies for r in rows)
        assert abs(taken - rows[0].target) <= 400
        assert all(r.copies <= 3 for r in rows)
        assert rows[0].target <= 3 * rows[0].source_size + 1e-6
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    again = mixing.mix(docs.repartition(7), group=100, fan=4).collect()
    assert {r.doc_id: r.copies for r in got} == {r.doc_id: r.copies for r in again}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    few = mixing.mixed_documents(odd)
    assert few.columns == odd.columns


def test_targets_by_rounds(spark):
    """Against the sharing round by round that the targets are defined by."""
    rng = np.random.default_rng(4)
    sizes = {f"s{i:02d}": int(n) for i, n in enumerate(rng.integers(0, 1000, 17))} | {None: 40}
    table = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    names = sorted(k for k in sizes if k) + [None]
    weight = {n: (5.0, 2.0, 1.0)[i % 3] for i, n in enumerate(names)}
    want, total, open_ = {}, float(sum(sizes.values())), set(names)
    while True:
        level = (total - sum(want.values())) / sum(weight[n] for n in open_)
        over = {n for n in open_ if weight[n] * level > 3 * sizes[n]}
        if not over:
            break
        want |= {n: 3.0 * sizes[n] for n in over}
        open_ -= over
    want |= {n: weight[n] * level for n in open_}
    assert got == pytest.approx(want)


def test_pivot_keeps_words_and_is_fair():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 50, 40).astype(float)
    parts = rng.random(40)
    total = np.zeros(40)
    for _ in range(2000):
        got, held = mixing.pivot(parts, sizes, rng.random(40))
        assert got @ sizes == pytest.approx(parts @ sizes)
        assert all(p in (0.0, 1.0) for i, p in enumerate(got) if i != held)
        total += got
    assert np.abs(total / 2000 - parts).max() < 0.06


def test_shards(spark, odd, empty):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, "w" * int(n), f"l{i % 3}", f"s{i % 5}", 0, 0, 0, 0, "") for i, n in enumerate(rng.integers(0, 3000, 4000))], DOCS)
    got = sharding.shard(docs, 7).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 4000 and sums.max() / sums.min() < 1.02 and set(sums.index) == set(range(7))
    for _, rows in got.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    few = sharding.shard(odd, 3).collect()
    assert len(few) == odd.count()
    by = {r.doc_id: (r["size"], r.text_crc32) for r in few if r.doc_id is not None}
    assert by[0] == (16, 0) and by[9] == (16 + len(ODD[9].encode()), zlib.crc32(ODD[9].encode()))
    assert sharding.shard(empty, 3).count() == 0
    assert sharding.shards_for(docs, 1_000_000) == -(-int(got["size"].sum()) // 1_000_000)


def test_equal_texts_share_a_shard(spark):
    docs = spark.createDataFrame([(i, f"text {i // 4}", "en", "s", 0, 0, 0, 0, "") for i in range(4000)], DOCS)
    got = sharding.shard(docs, 8).toPandas()
    split = (got.groupby("text_crc32")["shard"].nunique() > 1).sum()
    assert split <= 14


def test_redirects(spark):
    head = '<html><head><link href="{}" rel="canonical"></head>'
    pages = [
        (1, "http://a.example.net/x", head.format("https://b.com/de/y")),  # leads to a blocked address
        (2, "http://A.Example.net/z?q=1", ""),
        (3, "http://q.net/1", head.format("/2")),
        (4, "http://q.net/2", "<meta http-equiv='refresh' content='0; url=http://x.com/de/1'>"),
        (5, "http://r.net/1", head.format("http://q.net/1")),
        (6, "http://r.net/2", '<link rel=canonical href="http://r.net/3">'),
        (7, "http://r.net/3", head.format("http://sub.example.org/es/1")),
        (8, "http://r.net/4", head.format("http://r.net/3")),
        (9, "http://r.net/4?x=1#top", head.format("http://z.org/")),
        (10, None, None),
        (11, "no scheme", ""),
        (12, "", None),
        (2, "http://A.Example.net/z?q=1", ""),
        (13, "http://sub.example.org/en/17", None),
        (14, "ftp://x.com/fr/?a://b.org/", None),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("address", F.lit(1)).withColumn("rule", F.lit(2))
    got = sorted(redirects.judge(table).collect(), key=lambda r: r.page_id)
    verdict = {r.page_id: r.verdict for r in got}
    assert len(got) == 15
    assert verdict == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "block", 14: "allow"}
    found = {r.page_id: (r.host, r.path, r.rule) for r in got}
    assert found[2] == ("a.example.net", "/z", None) and found[10] == ("", "", None) and found[11] == ("", "", None)
    assert found[13][2] == "example.org/en/1" and found[14] == ("x.com", "/fr/", "com/fr/")
    assert redirects.judge(table.limit(0)).count() == 0
    more = spark.createDataFrame([("http://A.Example.net/z?q=1", "http://x.com/de/9")], "source string, target string")
    assert {r.page_id: r.verdict for r in redirects.judge(table, more).collect()}[2] == "block"


def test_secrets(spark, odd, empty):
    rng = np.random.default_rng(7)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    texts = [f'some words token = "{key()}" more words' for _ in range(60)]
    texts += [f"call 411111111111{i:04d} now" for i in range(200)] + ["averyveryverylongwordindeed here"] * 30
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    words = spark.createDataFrame([("very",), ("long",), ("word",), (None,)], "word string")
    got = secrets.scan(docs, words).collect()
    assert {r.doc_id for r in got if r.is_secret and r.doc_id < 60} == set(range(60))
    assert not [r for r in got if r.is_secret and r.doc_id >= 260]
    first = next(r for r in got if r.doc_id == 0)
    assert texts[0][first.start : first.start + first.length].isalnum() and first.length == 40
    assert secrets.scan(empty, words).count() == 0
    assert secrets.scan(odd, words.limit(0)).count() == 0


def test_outliers(spark, odd, empty):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(500)]

    def prose(n):
        words = [str(w) for w in rng.choice(vocabulary, n)]
        return " ".join(w.capitalize() + "." if i % 9 == 0 else w + ("," if rng.random() < 0.1 else "") for i, w in enumerate(words))

    texts = [prose(int(n)) for n in rng.integers(60, 300, 900)]
    junk = [" ".join(w + "$$$#%" for w in prose(150).split()) for _ in range(30)] + ["7731 99120 1;; 88 " * 30 for _ in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "s" if i % 2 else None, 0, 0, 0, 0, "") for i, t in enumerate(texts + junk)], DOCS)
    got = {r.doc_id: r for r in outliers.quality(docs).collect()}
    assert sum(not got[i].kept for i in range(900)) <= 9
    assert not any(got[i].kept for i in range(900, 940))
    few = {r.doc_id: r for r in outliers.quality(odd).collect() if r.doc_id is not None}
    assert few[0].base_failed and few[0].n_words == 0 and not few[0].kept
    assert outliers.quality(odd).count() == odd.count() and outliers.quality(empty).count() == 0


def test_base_statistics():
    texts = ["a b c a b c x", "line\n\nline\n line\nline", "#$ a|b", None, "x y z x y z x y z"]
    from shelfmark.llm.statistics import base_statistics

    got = {k: v.tolist() for k, v in base_statistics(pa.array(texts)).items()}
    assert got == {
        "n_words": [7, 4, 2, 0, 9],
        "word_chars": [7, 16, 5, 0, 9],
        "n_symbols": [0, 0, 3, 0, 0],
        "n_dup_lines": [0, 2, 0, 0, 0],
        "n_repeat_words": [6, 4, 0, 0, 9],
    }


def test_stages_take_odd_rows(spark, odd, empty, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, empty):
        at = docs
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            if n < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                folder = f"{tmp_path}/{docs is odd}-{n}"
                out.write.parquet(folder)
                at = spark.read.parquet(folder)
            else:
                assert out.count() == at.count()
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
