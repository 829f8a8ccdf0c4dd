"""The quality classifier is fitted on every labelled row and every pair of a good and a bad one."""

import numpy as np

from annalum.llm import quality_classifier as qc
from tests.llm.test_quality_classifier import sample


def all_pairs(x, good, ridge=qc.RIDGE):
    scale = x.std(0)
    model = qc.Model(x.mean(0), np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * x.shape[1]), 0.0)
    z = model.expand(x)
    d = (z[good == 1][:, None] - z[good == 0][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), d.T @ p / len(d) - ridge * w)
    s = np.sort(z @ w)
    return w, (s[(good == 0).sum() - 1] + s[(good == 0).sum()]) / 2


def test_sums_by_bins_are_those_of_all_pairs():
    x, good = sample(240)
    w, cut = all_pairs(x, good)
    model = qc.fit(x, good)
    np.testing.assert_allclose(model.weights, w, rtol=1e-6, atol=1e-9)
    assert abs(model.cut - cut) < 1e-6


def test_every_labelled_row_and_pair_counts(spark):
    """More rows than the 20,000 of before, in parts of a table: the model of all rows at once, and the exact cut."""
    x, good = sample(qc.FIT_ROWS + 5000)
    table = spark.createDataFrame([(int(g), v.tolist()) for g, v in zip(good, x, strict=True)], "good int, x array<double>").repartition(3)
    model, whole = qc.fit_over(qc.over(table)), qc.fit(x, good)
    np.testing.assert_allclose(model.weights, whole.weights, rtol=1e-6, atol=1e-9)
    assert (model.strength(x) > model.cut).sum() == (whole.strength(x) > whole.cut).sum() == good.sum()


def test_cut_among_equal_strengths():
    x, good = sample(50)
    x, good = np.repeat(x[:2], 3000, 0), np.repeat([0, 1], 3000)
    x[2990:3010] = x[0]
    model = qc.fit(x, good)
    s = np.sort(model.strength(x))
    assert model.cut == (s[2999] + s[3000]) / 2


def test_learning_reads_all_labels(spark):
    texts = [(i, f"good words {i} of a text" if i % 3 else "$$$ %% ## " * (1 + i % 5)) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    seen = []
    before, qc.fit_over = qc.fit_over, lambda over, **k: seen.append(over(qc._shape)) or before(over, **k)
    try:
        qc.learn(docs, labels)
    finally:
        qc.fit_over = before
    kept = labels.filter(~qc.held_out(labels.doc_id, 3, 1)).count()
    assert sum(n for n, *_ in seen[0]) == kept
