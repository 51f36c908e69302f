import numpy as np
import pytest

from tidewire.data import EventData, from_lists
from tidewire.functions.special import finite_difference_gradient
from tidewire.operators import claw, cumulants, rkhs


def test_conditional_law_golden(spark):
    np.random.seed(320982)
    events = [np.cumsum(np.random.random(np.random.randint(20, 25))) * 10 for _ in range(2)]
    data = from_lists(spark, [[e.tolist() for e in events]])
    fit = claw.ConditionalLaw(n_quad=5).fit(data)
    np.testing.assert_allclose(fit.norms, [[-0.81130911, -1.12992177], [-1.16313257, -1.72348019]], atol=1e-6)
    np.testing.assert_allclose(fit.baseline, [0.61213243, 0.808886425], atol=1e-6)
    np.testing.assert_allclose(fit.mean, [0.208121177] * 2, atol=1e-6)
    fit.quadrature = "gauss-"
    np.testing.assert_allclose(fit.solve().norms, [[-77.76904711, 0.69985519], [-42.87140913, 0.13607425]], rtol=1e-4)
    fit.quadrature = "lin"
    np.testing.assert_allclose(fit.solve().norms, [[7.92561315, 1.74540188], [-28.57048537, 10.77926367]], rtol=1e-6)
    fit.quadrature = "log"
    np.testing.assert_allclose(fit.solve().norms, [[35.70738975, 18.96902121], [-51.69638233, -30.33936597]], atol=3e-3)


def test_marks(spark):
    rows = [(0, 0, t, e, float(m)) for e, (t, m) in enumerate(zip([0.1, 0.4, 0.9, 1.4], [0.5, 2, 4.5, 8.5]))] + [(0, 1, t, 10 + e, float(e + 1)) for e, t in enumerate([0.2, 0.7, 1.2, 1.6])]
    events = spark.createDataFrame(rows, "r bigint, node int, t double, eid bigint, mark double")
    data = claw.increments(EventData(events, spark.createDataFrame([(0, 2.0)], "r bigint, end_time double"), 2))
    got = {(r["node"], r["interval"]): r for r in claw.mark_statistics(data, {0: [1, 3]}).collect()}
    assert [got[0, i]["share"] for i in range(3)] == [0.25, 0.5, 0.25]
    assert got[0, 0]["least"] == 0.5 and got[0, 0]["most"] == 4
    assert claw.claws(data, [0, 0.2, 0.5], {0: [1, 3]}).count() == 2 * 4 * 2


def scan_law(y, z, lags, T):
    """The law by the scan that the operator's rules describe."""
    out, n = np.zeros(len(lags) - 1), 0
    for s in z:
        if s + lags[-1] >= T:
            break
        n += 1
        if y[-1] < s:
            break
        for k in range(len(lags) - 1):
            lo, hi = np.searchsorted(y, s + lags[k], "right"), np.searchsorted(y, s + lags[k + 1], "right")
            if lo >= len(y):
                continue
            if hi >= len(y):
                hi = len(y) - 1
                if lo == len(y) - 1:
                    continue
            out[k] += max(hi - 1, 0) - max(lo - 1, 0)
    return out / max(n, 1) / np.diff(lags) - len(y) / T


def test_law_ends(spark):
    rng = np.random.default_rng(5)
    lags = [0, 0.3, 1, 2.5]
    for n in (1, 2, 3, 30):
        y, z = np.sort(rng.uniform(0, 8, n)), np.sort(rng.uniform(0, 10, 12))
        got = {(r["i"], r["j"], r["k"]): r["value"] for r in claw.claws(from_lists(spark, [[y.tolist(), z.tolist()]], 10.0), lags).collect()}
        for i, j in ((0, 1), (1, 0), (0, 0)):
            np.testing.assert_allclose([got[i, j, k] for k in range(3)], scan_law((y, z)[i], (y, z)[j], lags, 10.0), atol=1e-9)


def scan_cumulants(events, T, h):
    d = len(events)
    L = [len(e) / T for e in events]
    C, J = np.zeros((d, d)), np.zeros((d, d))
    for i in range(d):
        for j in range(d):
            for t in events[i]:
                if t >= h and len(events[j]) and events[j][-1] >= t + 2 * h:
                    far = np.abs(events[j] - t)
                    C[i, j] += (far < h).sum() - 2 * h * L[j]
                    J[i, j] += (2 * h - far[far < 2 * h]).sum() - 4 * h * h * L[j]
    C, J = (C + C.T) / 2 / T, (J + J.T) / 2 / T

    def E(i, j, k):
        s = 0.0
        for t in events[k]:
            if t >= h and events[i][-1] >= t + h and events[j][-1] >= t + h:
                s += ((np.abs(events[i] - t) < h).sum() - 2 * h * L[i]) * ((np.abs(events[j] - t) < h).sum() - 2 * h * L[j]) - J[i, j]
        return s / T

    return np.array(L), C, np.array([[(2 * E(i, j, j) + E(j, j, i)) / 3 for j in range(d)] for i in range(d)])


def test_cumulants(spark):
    rng = np.random.default_rng(1)
    days = [[np.sort(rng.uniform(0, 50, n)) for n in (60, 40)] for _ in range(2)]
    got = cumulants.Cumulants(from_lists(spark, [[e.tolist() for e in d] for d in days], 50.0), 2.0)
    want = [scan_cumulants(d, 50.0, 2.0) for d in days]
    np.testing.assert_allclose(got.mean, np.mean([w[0] for w in want], 0))
    np.testing.assert_allclose(got.covariance, np.mean([w[1] for w in want], 0), atol=1e-10)
    np.testing.assert_allclose(got.skewness, np.mean([w[2] for w in want], 0), atol=1e-10)


def test_matching_recovers_norms():
    a, mu = np.array([[0.3, 0.1], [0.2, 0.4]]), np.array([0.5, 0.7])
    c = type("C", (), {})()
    c.mean, c.covariance, c.skewness = cumulants.theoretical(a, mu)
    m = cumulants.CumulantMatching(1.0, penalty="elasticnet")
    m.prepare(c)
    x = np.array([1.5, 0.3, 0.4, 1.9])
    np.testing.assert_allclose(m.loss_and_grad(x)[1], finite_difference_gradient(lambda v: m.loss_and_grad(v)[0], x), rtol=1e-4, atol=1e-6)
    fit = cumulants.CumulantMatching(1.0, max_iter=5000).fit(cumulants=c)
    np.testing.assert_allclose(fit.adjacency, a, atol=1e-4)
    np.testing.assert_allclose(fit.baseline, mu, atol=1e-4)
    for name in ("adam", "adagrad", "rmsprop", "adadelta", "sgd", "momentum"):
        m.max_iter = 50
        m.fit(cumulants=c, start=np.eye(2) * 1.4, solver=name, step=0.001)
        assert m.objective <= m.loss_and_grad((np.eye(2) * 1.4).ravel())[0]


def test_kernel_space(spark):
    data = from_lists(spark, [[np.linspace(0.5, 19.5, 20).tolist()]], 20.0)
    fit = rkhs.KernelSpace(3, 0.5).fit(data)
    assert fit.mean == pytest.approx(1) and np.isfinite(fit.values).all() and fit.baseline >= 0
    ts, edges = np.linspace(0.5, 19.5, 20), fit.edges()
    want = np.histogram([b - a for i, a in enumerate(ts) for b in ts[i + 1 :] if b - a <= 3], edges)[0]
    got = np.zeros(6)
    for r in rkhs.lag_histogram(data, edges).collect():
        got[r["k"]] = r["n"]
    np.testing.assert_array_equal(got, want)
