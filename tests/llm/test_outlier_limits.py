"""Every statistic decides by itself, in large groups and small ones."""

import numpy as np

from shelfmark.llm import outliers

#: a text that is odd in one statistic, and usual values
ODD = {
    "word_length": 15.0,
    "symbols": 0.5,
    "dup_lines": 0.8,
    "repeats": 0.45,
    "digits": 0.4,
    "capitals": 0.5,
    "stops": 0.2,
    "commas": 0.2,
    "others": 0.4,
}


def usual(rng, n):
    def some(share, most):
        return np.where(rng.random(n) < share, rng.random(n) * most, 0.0)

    return {
        "word_length": rng.normal(5, 0.3, n),
        "symbols": some(0.1, 0.05),
        "dup_lines": some(0.2, 0.2),
        "repeats": some(0.2, 0.1),
        "digits": some(0.2, 0.05),
        "capitals": rng.normal(0.013, 0.002, n),
        "stops": rng.normal(0.014, 0.002, n),
        "commas": rng.normal(0.01, 0.002, n),
        "others": some(0.1, 0.05),
    }


def test_each_statistic_alone_rejects(spark):
    rng = np.random.default_rng(11)
    # a share of spoilt rows in a group does not hide others of their kind
    groups = {"small": (300, 0), "large": (3000, 0), "spoilt": (3000, 400)}
    good = {k: outliers.transformed(usual(rng, n)) for k, (n, _) in groups.items()}
    rows = [(k, x.tolist()) for k in groups for x in good[k]]
    bad = outliers.transformed({k: np.full(400, v) for k, v in ODD.items()})
    rows += [("spoilt", x.tolist()) for x in bad]
    settings = outliers.Settings()
    models = outliers.estimates(spark.createDataFrame(rows, "key string, x array<double>").repartition(4), settings).collect()
    assert {m.key for m in models} == set(groups)
    limit = outliers.chi2_quantile(1 - settings.cutoff, 9)
    middle = {k: np.median(v) for k, v in usual(rng, 1000).items()}
    for model in models:
        inverse = np.zeros((9, 9))
        inverse[np.triu_indices(9)] = model.inverse
        inverse = (inverse + inverse.T) / 2

        def distance(x):
            gap = x - np.array(model.centre)
            return np.einsum("ij,jk,ik->i", gap, inverse, gap)

        assert (distance(good[model.key]) <= limit).mean() >= 0.99
        for name, value in ODD.items():
            one = outliers.transformed({k: np.array([value if k == name else m]) for k, m in middle.items()})
            assert distance(one)[0] > limit, (model.key, name)


def test_texts_odd_in_one_statistic(spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) for _ in range(4000)]

    def line(n=12):
        some = [str(w) for w in rng.choice(words, n)]
        return some[0].capitalize() + " " + " ".join(some[1:6]) + ", " + " ".join(some[6:]) + "."

    def text(lines=12):
        return "\n".join(line() for _ in range(lines))

    short = "\n".join(["Some more"] * 40)
    odd = {
        -1: text() + "\n" + short.replace("Some", "One").replace("\n", "\n\n"),
        -2: "\n".join(" ".join(f"{i}{j}77 {w}" for j, w in enumerate(rng.choice(words, 8))) for i in range(10)),
        -3: text().upper(),
        -4: " ".join(w + " #$" for w in rng.choice(words, 150)),
    }
    rows = [(i, text(), "en", "large" if i % 4 else f"small{i % 16}") for i in range(800)]
    rows += [(i - 10 * k, t, "en", s) for k, s in enumerate(("large", "small0")) for i, t in odd.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.quality(docs).collect()}
    assert [i for i in got if i < 0 and got[i].kept] == []
    assert sum(got[i].kept for i in range(800)) >= 792
