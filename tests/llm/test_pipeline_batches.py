"""What the pipeline's Python workers are handed at once."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["size"])

    docs = spark.range(6000, numPartitions=1).select("id", F.repeat(F.lit("word "), 1000).alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    stages = {"toxicity": "drop_toxic", "jaccard": "keep_one", "mixing": "mixed_documents"}
    for module, name in stages.items():
        monkeypatch.setattr(getattr(corpus_pipeline, module), name, lambda docs, *a, **b: docs.mapInArrow(sizes, "size long"))
    monkeypatch.setattr(type(spark), "read", property(lambda self: type("Read", (), {"parquet": lambda self, path: None})()))
    try:
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
            spark.conf.set(key, before)
            found = [r.size for r in stage(spark, docs, "").collect()]
            assert sum(found) > 30_000_000 and max(found) < 1.2 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.set(key, before)
