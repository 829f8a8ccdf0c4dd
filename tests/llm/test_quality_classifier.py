"""What fitting holds in the driver, and that pairs taken in pieces give the model of all at once."""

import tracemalloc

import numpy as np

from annalum.llm import quality_classifier


def sample(rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng, width = np.random.default_rng(5), len(quality_classifier.features(b""))
    x = rng.normal(size=(rows, width))
    return x, (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=rows) > 0).astype(int)


def test_fitting_holds_no_differences_of_all_pairs():
    """The differences of all PAIRS are 77 MB, and were held twice at once."""
    x, good = sample(quality_classifier.FIT_ROWS)
    tracemalloc.start()
    try:
        quality_classifier.fit(x, good)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 64e6


def test_pairs_in_pieces_give_the_model_of_all_at_once():
    x, good = sample(1_000)
    pairs, ridge = 2 * quality_classifier.STEP + 77, quality_classifier.RIDGE
    model = quality_classifier.fit(x, good, pairs)
    rng, z = np.random.default_rng(quality_classifier.SEED), model.expand(x)
    d = z[rng.choice(np.flatnonzero(good == 1), pairs)] - z[rng.choice(np.flatnonzero(good == 0), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
    np.testing.assert_allclose(model.weights, w, rtol=1e-6, atol=1e-9)
    assert (model.strength(x) > model.cut).sum() == good.sum()
