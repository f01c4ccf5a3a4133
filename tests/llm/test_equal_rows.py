"""Many rows equal in all columns are treated row by row."""

from pyspark.sql import functions as F

from shelfmark.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, _copies long, number long"


def test_equal_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(1, "the same text", "en", "s", 0, 0)] * 3000, DOCS)
    got = sharding.shard(docs, 8).toPandas()
    counts = got.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert len(got) == 3000 and list(counts.index) == list(range(8))
    # 65,536 digits over 3,000 rows: few share a digit
    assert counts["count"].max() - counts["count"].min() <= 3
    assert (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()


def test_equal_rows_without_id_have_slots(spark):
    docs = spark.createDataFrame([(None, None, None, None, 0, 0)] * 500, DOCS)
    got = sharding.shard(docs, 3).collect()
    assert len(got) == 500 and {r.shard for r in got} == {0, 1, 2}
    assert {(r.size, r.text_crc32) for r in got} == {(16, 0)}


def test_mix_of_equal_rows_meets_targets(spark):
    rows = [(1, "a b c d e", "en", "s0", 0, 0)] * 1000
    rows += [(2 + i, "a b c d e", "en", "s1", 0, 0) for i in range(700)]
    rows += [(9000 + i, " ".join(["w"] * (1 + i % 40)), "en", "s2", 0, 0) for i in range(500)]
    rows += [(7, "", "en", "s2", 0, 0)] * 9
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = mixing.mix(docs).collect()
    assert sum(r.rows for r in found) == len(rows)
    longest = {"s0": 5, "s1": 5, "s2": 40}
    aims = {r.source: r.target for r in found}
    for source, target in aims.items():
        taken = sum(r.size * r.copies * r.rows for r in found if r.source == source)
        assert abs(taken - target) <= longest[source]
    # no row is taken more than once more often than another of the same size share
    same = [r.copies for r in found if r.doc_id == 1]
    assert max(same) - min(same) <= 1
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    sums = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    assert sums == {s: sum(r.size * r.copies * r.rows for r in found if r.source == s) for s in aims}


def test_op7_and_documents_agree_on_equal_rows(spark):
    rows = [(1, "a b c", "en", "x", i, 0) for i in range(100)] + [(3, "d e f g", "en", "y", 0, 0)] * 37
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.rows * r.copies
    got = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v}
    each = mixing.mixed_documents(docs).where("doc_id = 1").groupBy("_copies").count().collect()
    assert max(r["count"] for r in each) - min(r["count"] for r in each) <= 1
