import numpy as np
import pytest

from tidewire.data import from_lists
from tidewire.operators import hawkes, learners

R0 = [[1, 1.2, 3.4, 5.8, 10.3, 11, 13.4], [2, 5, 8.3, 9.1, 15, 18, 20, 33]]
R1 = [[2, 3.2, 11.4, 12.8, 45], [2, 3, 8.8, 9, 15.3, 19]]


def test_expectation_golden(spark):
    np.random.seed(123269)
    events = [[np.cumsum(np.random.rand(4 + i)).tolist() for i in range(3)] for _ in range(2)]
    em = learners.Expectation.uniform(3, 3, max_iter=11, tol=0).fit(from_lists(spark, events), np.full(3, 0.2), np.full((3, 3, 3), 0.4))
    np.testing.assert_allclose(em.mu, [1.2264, 0.2164, 1.6782], rtol=1e-3)
    np.testing.assert_allclose(em.kernel[1, 0], [0.80077, 0.022624, 6.7577e-10], rtol=1e-3)
    assert np.isfinite(em.score()) and em.norms().shape == (3, 3)


def pairs_step(events, ends, edges, mu, kernel):
    """The definition, event by event."""
    d, m = len(mu), len(edges) - 1
    new_mu, new_k = np.zeros(d), np.zeros((d, d, m))
    for nodes in events:
        for u in range(d):
            for k, t in enumerate(nodes[u]):
                n = np.zeros((d, m))
                for v in range(d):
                    for l, s in enumerate(nodes[v]):
                        if s <= t and not (u == v and l == k) and t - s < edges[-1]:
                            n[v, 0 if t == s else sum(e < t - s for e in edges) - 1] += 1
                lam = mu[u] + (n * kernel[u]).sum()
                new_mu[u] += mu[u] / lam
                new_k[u] += n * kernel[u] / lam
    count = np.maximum([sum(len(nodes[v]) for nodes in events) for v in range(d)], 1)
    return new_mu / sum(ends), new_k / (count[None, :, None] * np.diff(edges))


def test_expectation_ties_and_empty_nodes(spark):
    events = [[[], [0.2, 0.2, 0.7], [0.1, 0.4]], [[0.05, 0.4], [], [0.4, 0.9]]]
    edges, mu, kernel = [0, 0.25, 0.75, 1.5], np.array([0.3, 0.4, 0.2]), np.arange(1, 28).reshape(3, 3, 3) / 50
    em = learners.Expectation(edges)
    em.prepare(from_lists(spark, events, [1.2, 1.1]))
    got = em.step(mu, kernel)
    want = pairs_step(events, [1.2, 1.1], edges, mu, kernel)
    np.testing.assert_allclose(got[0], want[0], rtol=1e-12)
    np.testing.assert_allclose(got[1], want[1], rtol=1e-12)


def test_piecewise_compensator(spark):
    edges, mu, kernel = np.array([0, 0.5, 2.0]), np.array([0.3, 0.4]), np.array([[[0.1, 0.2], [0.3, 0.0]], [[0.2, 0.1], [0.05, 0.3]]])
    data = from_lists(spark, [R0], 40.0)
    for r in learners.piecewise_compensators(data, edges, mu, kernel).collect():
        want = mu[r["node"]] * r["t"] + sum(kernel[r["node"], v, m] * max(0, min(r["t"] - s, edges[m + 1]) - edges[m]) for v in range(2) for s in R0[v] if s < r["t"] for m in range(2))
        assert r["compensator"] == pytest.approx(want, rel=1e-12)


def test_sparse_low_rank_golden(spark):
    fit = learners.SparseLowRank(0.7, C=10, ratio=0.7, rho=0.5, max_iter=11, em_max_iter=3).fit(from_lists(spark, [R0]), np.full(2, 0.2), np.full((2, 2), 0.2))
    np.testing.assert_allclose(fit.mu, [0.14551, 0.239859], rtol=1e-5)
    np.testing.assert_allclose(fit.adjacency.ravel(), [2.275416e-01, 8.234672e-02, 1.195861e-02, 4.070548e-10], rtol=1e-5)


def test_gaussians_golden(spark):
    fit = learners.GaussianMixture(5, 3, step_size=1e-3, C=10, ratio=0.7, max_iter=11, em_max_iter=3).fit(from_lists(spark, [R0]), np.full(2, 0.2), np.full((2, 2, 3), 0.2))
    assert fit.std == pytest.approx(0.5305164769729844)
    np.testing.assert_allclose(fit.mu, [0.0979586, 0.15552228], rtol=1e-5)
    np.testing.assert_allclose(fit.amplitudes[0].ravel(), [0.20708954, -0.00627318, 0.08388442, -0.00341803, 0.34805652, -0.00687372], rtol=1e-5)


def test_basis_golden(spark):
    i = np.arange(40)
    g = np.stack([0.029 * np.exp(-0.029 * i), 0.8 * np.exp(-0.1 * i)])
    a = np.full((2, 2, 2), 0.4)
    a[1] = 0.6
    fit = learners.SharedBasis(4, 40, C=0.05, max_iter=5, tol=0).fit(from_lists(spark, [R0, R1]), np.full(2, 0.2), a, g)
    # Published to four decimals; their sweeps stop short of the fixed point, so order matters below that.
    np.testing.assert_allclose(fit.mu, [0.153022, 0.179124], atol=5e-6)
    np.testing.assert_allclose(fit.amplitudes[1].ravel(), [1.48773e-5, 2.06898e-3, 6.60131e-6, 7.28398e-4], rtol=5e-3)
    np.testing.assert_allclose(fit.basis[0, :3], [0.0001699, 0.00031211, 0.00043944], rtol=3e-2)


@pytest.mark.parametrize("some", [1.0, 0.5, 0.0])
def test_basis_function_solves_its_equation(some):
    rng = np.random.default_rng(3)
    fit = learners.SharedBasis(4, 40, C=0.05, ode_max_iter=100_000, ode_tol=1e-14)
    c, d = rng.uniform(0, 50, 40), rng.uniform(0, 5, 40) * (rng.uniform(size=40) < some)
    g, k = fit._smoothed(c, d), fit.alpha / fit.dt**2
    near = np.r_[0, g[:-1]] + np.r_[g[1:], 0]
    np.testing.assert_allclose((4 * k + c) * g * g - 2 * k * near * g, d, atol=1e-9 * max(1, (k * g * g).max()))
    assert (g >= 0).all() and (some == 0) == (g == 0).all()


def test_parametric_scores(spark):
    np.random.seed(13069)
    for i in range(3):
        np.cumsum(np.random.rand(10 + i))
    train = [[np.cumsum(np.random.rand(4 + i)).tolist() for i in range(2)] for _ in range(3)]
    test = [[np.cumsum(np.random.rand(4 + i)).tolist() for i in range(2)] for _ in range(3)]
    mu, a = np.random.rand(2), np.random.rand(2, 2)
    fit = learners.Parametric(3.0, penalty="none")
    c = np.r_[mu, a.ravel()]
    data, other = from_lists(spark, train), from_lists(spark, test)
    assert fit.score(data, c) == pytest.approx(0.59502417, abs=1e-6)
    assert fit.score(other, c) == pytest.approx(0.89322199, abs=1e-6)
    fit.fit(data)
    assert fit.score() > fit.score(data, c)
    assert learners.Parametric(3.0, loss="likelihood", max_iter=15).fit(data).objective < hawkes.LogLikelihood(data, 3.0).loss(np.ones(6))
