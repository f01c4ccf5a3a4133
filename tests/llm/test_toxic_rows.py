"""What the toxicity filter keeps when little or nothing is learned."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from shelfmark.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("rows", [[], [(99, 1, 1)], [(1, 1, None), (None, 1, 1)], [(3, 0, 1)]])
def test_rows_stay_if_nothing_speaks_against_them(spark, tmp_path, rows):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "vile words"), (4, ""), (4, "four")], "doc_id long, text string")
    spark.createDataFrame(rows, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert {(1, "one two"), (2, None), (4, ""), (4, "four")} <= {(r.doc_id, r.text) for r in left}


def test_learned_words_still_drop_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'fine'} w{i}") for i in range(400)], "doc_id long, text string")
    spark.createDataFrame([(i, 1, i % 2) for i in range(300)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in left} == set(range(0, 400, 2))


def test_bias_is_not_held_at_zero():
    kept, weights = toxicity.fit([(np.zeros(1, np.uint32), 0)], toxicity.Settings(bits=4))
    assert kept.tolist() == [0] and weights[0] < 0


def test_features_are_taken_of_a_few_texts_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "vile word"), (2, "fine word")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], LABELS)
    sent, sizes, map_in_arrow = [], [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, *schema: sent.append(work) or map_in_arrow(self, work, *schema))
    toxicity.toxicity(docs, labels, toxicity.fold(5) == 0)
    toxicity.drop_toxic(docs, labels, toxicity.fold(5) == 0)
    # learning, scoring, learning again, dropping
    assert len(sent) == 4

    features = toxicity.features
    monkeypatch.setattr(toxicity, "features", lambda texts, bits: sizes.append(texts.nbytes) or features(texts, bits))
    texts = [f"{'vile' if i % 2 else 'fine'} w{i} " * 8000 for i in range(64)]
    batch = pa.record_batch({"doc_id": pa.array(range(64), pa.int64()), "label": pa.array([i % 2 for i in range(64)], pa.int32()), "text": texts})
    for work in sent:
        assert sum(part.num_rows for part in work(iter([batch]))) <= 64
    assert max(sizes) < 1 << 20
