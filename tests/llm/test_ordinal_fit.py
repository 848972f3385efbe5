from __future__ import annotations

import numpy as np
import pytest

from findloom.llm import toxicity


def loss(w, theta, x, grade, l1, l2):
    """Minus the mean log-likelihood of the grades by the cumulative link, straight from its definition, and the penalties."""
    total = 0.0
    for row, g in zip(x, grade, strict=True):
        below = lambda k: 0.0 if k < 0 else 1.0 if k == len(theta) else 1 / (1 + np.exp(-(theta[k] - row @ w)))  # noqa: B023, E731
        total -= np.log(below(g) - below(g - 1))
    return total / len(grade) + l1 * w.sum() + l2 * (w * w).sum() / 2


@pytest.mark.parametrize("levels, l1, l2", [(3, 0.0, 0.01), (3, 0.01, 0.0), (2, 0.0, 0.05), (4, 0.005, 0.01)])
def test_the_fit_is_where_the_gradient_says(levels, l1, l2):
    """At the fitted point slopes are 0, or not negative where a weight is held at 0: the loss is convex, so it is the best."""
    rng = np.random.default_rng(levels)
    x = (rng.random((120, 6)) < 0.4).astype(float)
    truth = np.array([2.0, 1.0, 0.0, -1.5, 0.5, 0.0])
    grade = np.clip(np.floor(x @ truth + rng.logistic(size=120) * 0.7 + 0.8), 0, levels - 1).astype(int)
    doc, at = np.nonzero(x)
    w, theta = toxicity._descend(doc, at, 6, grade, levels, l1, l2, 6000)
    assert (w >= 0).all() and (np.diff(theta) > 0).all()
    base, step = loss(w, theta, x, grade, l1, l2), 1e-5

    def slope(which, i):
        up, down = ((w.copy(), theta.copy()) for _ in range(2))
        up[which][i] += step
        down[which][i] -= step
        return (loss(*up, x, grade, l1, l2) - loss(*down, x, grade, l1, l2)) / (2 * step)

    for i in range(6):
        assert abs(slope(0, i)) < 5e-3 if w[i] > 1e-3 else slope(0, i) > -5e-3
    assert all(abs(slope(1, k)) < 5e-3 for k in range(levels - 1))
    for _ in range(300):  # and no point near it is better
        v, t = np.maximum(w + rng.normal(size=6) * 0.05, 0), np.sort(theta + rng.normal(size=levels - 1) * 0.05)
        assert loss(v, t, x, grade, l1, l2) > base - 1e-4


def test_severity_follows_the_thresholds():
    model = toxicity.Model(np.zeros(4, np.float32), np.array([-1.0, 2.0]))
    got = model.at_least(np.array([-3.0, 0.0, 5.0]))
    assert got == pytest.approx(1 / (1 + np.exp(np.array([[2.0, 5.0], [-1.0, 2.0], [-6.0, -3.0]]))))
    assert (np.diff(got.sum(1)) > 0).all() and (got[:, 0] > got[:, 1]).all()
