import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import jaccard


@pytest.fixture(scope="module")
def texts():
    """Copies of one text with words replaced: few link, yet most share keys with several others."""
    rng = random.Random(4)
    words = [f"w{n}" for n in range(300)]
    share = [0.01, 0.02, 0.08, 0.1]
    return {i: " ".join(f"x{i}_{n}" if rng.random() < share[i % 4] else w for n, w in enumerate(words)) for i in range(40)}


def tables(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(40)
    sets = jaccard._sets(docs, 5, 80).localCheckpoint()
    shapes = sets.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("node", "n_shingles", "bitmap")])
    return sets, shapes.localCheckpoint()


def test_a_set_is_sent_once_for_keys_of_one_first_set(spark, texts, monkeypatch):
    sent, real = [], jaccard._compared
    monkeypatch.setattr(jaccard, "_compared", lambda there, *rest: (sent.append(there.count()), real(there, *rest))[1])
    sets, shapes = tables(spark, texts)
    jaccard._neighbourhoods(sets, shapes, 80).count()
    # no more than there are pairs of sets, however many keys they share
    assert sent and 0 < sum(sent) <= len(texts) * (len(texts) + 1) // 2
    assert sum(sent) * 2 < sets.select(F.sum(F.size("keys") + F.size("later"))).first()[0]


@pytest.mark.parametrize("key_sets", [jaccard.KEY_SETS, 6, 2])
def test_linked_sets_share_a_neighbourhood(spark, texts, key_sets):
    import pyarrow as pa

    sets, shapes = tables(spark, texts)
    hood = {r.node: r.component for r in jaccard._neighbourhoods(sets, shapes, 80, key_sets).collect()}
    node = {r.doc_id: r.node for r in sets.select("doc_id", "node").collect()}
    members = dict(zip(texts, jaccard.shingle_sets(pa.array(list(texts.values())), 5)))
    links = [(i, j) for i in texts for j in texts if i < j and jaccard._linked(members[i], members[j], 80)]
    assert links and all(hood[node[i]] == hood[node[j]] for i, j in links)
