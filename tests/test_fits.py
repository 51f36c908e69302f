"""The registered fits end by their own stop rules, not by a limit."""

from pathlib import Path

import numpy as np
import pytest

from tidewire.functions import losses, prox
from tidewire.operators import glm, learners, survival
from tidewire.operators.weighted import Sums, dense
from tidewire.plans import hawkes_queries, model_queries
from tidewire.plans.shaping import finished

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def lines(spark, label):
    r = model_queries._lines(spark, FOLDER, label).collect()
    return np.c_[np.array([x["features"] for x in r], float), np.ones(len(r))], np.array([x["label"] for x in r])


def values(spark, name):
    return np.array([r["value"] for r in model_queries.QUERIES[name](spark, FOLDER).orderBy("k").collect()])


def test_linear_regression_reaches_the_closed_form(spark):
    x, y = lines(spark, model_queries._price())
    want = np.linalg.solve(x.T @ x / len(y) + np.diag([0.1] * 3 + [0]), x.T @ y / len(y))
    np.testing.assert_allclose(values(spark, "fit_linear_regression"), want, atol=1e-4)


def test_poisson_regression_has_no_slope_left(spark):
    x, y = lines(spark, model_queries._count())
    c = model_queries.regression(spark, FOLDER, model_queries._count, loss=losses.Poisson(), solver="bfgs", penalty="none").coeffs
    assert np.abs(x.T @ (np.exp(x @ c) - y)).max() / len(y) < 2e-5


def test_unfinished_fit_is_an_error(spark):
    x = model_queries._lines(spark, FOLDER, model_queries._price())
    fit = glm.Regression(losses.Squared(), step=0.5, max_iter=8).fit(x)
    assert not fit.converged
    with pytest.raises(ValueError):
        finished(fit)


@pytest.fixture
def in_memory(monkeypatch):
    """The sums of the Hawkes fits in numpy, so that long runs take no Spark jobs."""
    kept = {}

    def sums(features, mu, weights):
        if id(features) not in kept:
            b = getattr(features, "df", features).select("node", "phi").toArrow().combine_chunks().to_batches()[0]
            kept[id(features)] = features, b.column(0).to_numpy(zero_copy_only=False).astype(int), dense(b, "phi", weights.shape[1])
        _, node, phi = kept[id(features)]
        lam = mu[node] + (phi * weights[node]).sum(1)
        ok = lam > 0
        inv = np.where(ok, 1 / np.where(ok, lam, 1), 0)
        return Sums(len(node), int((~ok).sum()), float(np.log(lam[ok]).sum()), np.bincount(node, inv, len(mu)), np.stack([inv[node == u] @ phi[node == u] for u in range(len(mu))]))

    monkeypatch.setattr(learners, "weighted_sums", sums)


Q = hawkes_queries
BASIS = np.stack([np.exp(-0.5 * np.arange(Q.SIZE)), np.full(Q.SIZE, 0.3)])
HAWKES = {
    "expectation": (lambda: learners.Expectation(Q.EDGES, max_iter=20000), "kernel", (Q.KERNEL,)),
    "sparse_low_rank": (lambda: learners.SparseLowRank(Q.BETA, max_iter=20000), "adjacency", (Q.ALPHA,)),
    "gaussians": (lambda: learners.GaussianMixture(12.0, 3, step_size=1e-3, max_iter=20000), "amplitudes", (np.full((Q.D, Q.D, 3), 0.05),)),
    "shared_basis": (lambda: learners.SharedBasis(Q.STEP * Q.SIZE, Q.SIZE, max_iter=20000), "basis", (np.full((Q.D, Q.D, 2), 0.1), BASIS)),
}


@pytest.mark.parametrize("name", HAWKES)
def test_hawkes_fit_equals_a_long_run(spark, in_memory, name):
    make, what, start = HAWKES[name]
    long = make().fit(Q.test_events(spark, FOLDER), Q.MU, *start)
    assert long.converged
    np.testing.assert_allclose(getattr(getattr(Q, name)(spark, FOLDER), what), getattr(long, what), atol=2e-6)


def test_unfinished_hawkes_fit_is_an_error(spark, in_memory):
    data = Q.test_events(spark, FOLDER)
    for fit in (learners.SparseLowRank(Q.BETA, max_iter=3, em_max_iter=3).fit(data, Q.MU, Q.ALPHA), learners.Expectation(Q.EDGES, max_iter=10).fit(data, Q.MU, Q.KERNEL)):
        with pytest.raises(ValueError):
            finished(fit)


def test_robust_regression_equals_a_long_run(spark):
    from tidewire.session import table

    r = table(spark, FOLDER, "part").selectExpr("p_partkey", "p_size / 50 as x", "p_retailprice / 1000 as y").collect()
    x, y = np.c_[[float(v["x"]) for v in r], np.ones(len(r))], np.array([float(v["y"]) for v in r])
    n = len(y)
    both = np.c_[x, np.eye(n)]
    rows, l2 = prox.ProxSlope(1e-5, fdr=0.05), prox.ProxL2Squared(1e-3, (0, 1))
    step = n / np.linalg.eigvalsh(both.T @ both)[-1]
    c = z = np.zeros(n + 2)
    t = 1.0
    for _ in range(15000):
        v = z - step * both.T @ (both @ z - y) / n
        new = np.r_[l2(v[:2], step), rows(v[2:], step)]
        if (z - new) @ (new - c) > 0:
            t = 1.0
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c, t = new + (t - 1) / new_t * (new - c), new, new_t
    got = {a["row_id"]: a["mu"] for a in model_queries.robust_fit(spark, FOLDER)[1].collect()}
    np.testing.assert_allclose([got.get(a["p_partkey"], 0.0) for a in r], c[2:], atol=1e-5)


def test_case_series_is_a_minimum(spark):
    fit = model_queries.case_series(spark, FOLDER)
    assert fit.history[0]["slope"] < 1e-6


@pytest.mark.parametrize("local", [0, 32 << 20])
def test_case_series_ends_at_a_kink(spark, monkeypatch, local):
    monkeypatch.setattr(survival, "LOCAL_BYTES", local, raising=False)
    fit = survival.LaggedCaseSeries([1, 0], c_tv=20.0, c_group=50.0, max_iter=60)
    rng = np.random.default_rng(3)
    x = [(i, t, f, 1.0) for i in range(40) for t in range(6) for f in range(2) if rng.random() < 0.3]
    y = [(i, t, int(n)) for i in range(40) for t, n in enumerate(rng.poisson(0.3, 6)) if n]
    c = spark.createDataFrame([(i, 6 - i % 2) for i in range(40)], "case_id bigint, censoring bigint")
    fit.fit(spark.createDataFrame(x, "case_id bigint, interval bigint, feature int, value double"), spark.createDataFrame(y, "case_id bigint, interval bigint, y int"), c)
    m = np.zeros((40, 6, 3))
    for i, t, f, _ in x:
        for k in range(2 - f):
            if t + k < 6 - i % 2:
                m[i, t + k, 2 * f + k] = 1
    n = np.zeros((40, 6))
    for i, t, v in y:
        n[i, t] = v if t < 6 - i % 2 else 0
    seen = np.arange(6) < (6 - np.arange(40) % 2)[:, None]

    def whole(w):
        s = m @ w
        z = np.log((np.exp(s) * seen).sum(1))
        loss = (n * (z[:, None] - s)).sum() / (n.sum(1) > 0).sum()
        return loss + 5e-9 * w @ w + abs(w[1] - w[0]) / 20 + (np.sqrt(2) * np.linalg.norm(w[:2]) + abs(w[2])) / 50

    assert fit.converged and fit.history[0]["slope"] < 1e-6 and 0 < (fit.coeffs != 0).sum() and (np.diff(np.r_[0.0, fit.coeffs]) == 0).any()
    least = whole(fit.coeffs)
    for d in rng.normal(size=(300, 3)) * 10 ** rng.uniform(-5, -1, (300, 1)):
        assert whole(fit.coeffs + d) >= least - 1e-13
    assert fit.score() == pytest.approx(((n * (np.log((np.exp(m @ fit.coeffs) * seen).sum(1))[:, None] - m @ fit.coeffs)).sum()) / (n.sum(1) > 0).sum())


def test_shared_basis_takes_few_rounds_over_few_rows(spark):
    fit = Q.shared_basis(spark, "/root/testdata/sf0.01")
    assert len(fit.history) < 500 and fit.history[-1]["rel"] <= fit.tol
    assert sum(len(c.column(0)[0].as_py()) // 4 for c in fit.counts.chunks) < fit.data.n_jumps / 3
    plain = fit.mu, fit.amplitudes, fit.basis
    for a, b in zip(fit.iterate(*plain), plain, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-4)


@pytest.mark.parametrize("local", [0, 32 << 20])
@pytest.mark.parametrize("repeated", [False, True])
def test_packed_sums(spark, monkeypatch, local, repeated):
    from tidewire.operators import weighted

    monkeypatch.setattr(weighted, "LOCAL_BYTES", local)
    rng = np.random.default_rng(5)
    rows = [(int(u), [float(x) for x in rng.integers(0, 2, 4)]) for u in rng.integers(0, 3, 200)]
    df = spark.createDataFrame(rows, "node int, phi array<double>").repartition(3)
    mu, w = np.array([0.0, 0.2, 0.3]), rng.uniform(0.1, 1, (3, 4))
    packed = weighted.iterated(df, len(rows), 4, repeated)
    assert isinstance(packed.chunks, list) == (local > 0)
    a, b = weighted.weighted_sums(packed, mu, w), weighted.weighted_sums(df, mu, w)
    assert (a.n, a.bad) == (b.n, b.bad) and a.bad > 0
    for name in ("logs", "inverse", "over"):
        np.testing.assert_allclose(getattr(a, name), getattr(b, name), rtol=1e-12)
