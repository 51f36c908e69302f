import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.data import event_data, from_lists
from tidewire.operators import hawkes
from tidewire.operators.scan import decayed_sums, running_totals


def strict_past(rows, n_nodes, decays):
    out = {}
    for r, t in {(r, t) for r, _, t in rows}:
        phi = np.zeros((n_nodes, len(decays)))
        for r2, v, s in rows:
            if r2 == r and s < t and v is not None:
                phi[v] += [d * np.exp(-d * (t - s)) if d else 1 for d in decays]
        out[r, t] = phi.ravel()
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_scan_matches_pairs(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(int(r), None if v == 3 else int(v), float(t)) for r, v, t in zip(rng.choice([1, 1, 1, 2, 9], 300), rng.integers(0, 4, 300), np.round(rng.exponential(5, 300), 1))]
    rows += [(1, 0, 5.0)] * 5
    decays = [0.0, 0.3, 50.0]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if parts > 1 else 10000)
    try:
        df = spark.createDataFrame(rows, "r bigint, node int, t double")
        got = decayed_sums(df, 3, decays).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = strict_past(rows, 3, decays)
    assert len(got) == len(rows)
    for x in got:
        np.testing.assert_allclose(x["phi"], want[x["r"], x["t"]], rtol=1e-11, atol=1e-12)


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "r bigint, node int, t double, extra string")
    assert decayed_sums(df, 2, [1.0]).count() == 0


def test_running_totals(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    got = {r["k"]: r["cum_v"] for r in running_totals(df, "k", ["v"], descending=True).collect()}
    v = np.arange(1000) % 7
    assert got[0] == v.sum() and got[999] == v[999] and got[500] == v[500:].sum()


F2 = [[[0.2, 0.3, 0.65, 0.87, 1.0, 10, 12, 22], [3, 40, 60]]]


def test_least_squares_golden(spark):
    m = hawkes.LeastSquares(from_lists(spark, F2, 60.0), 2.0)
    c = [0.1, 0.4, 0.3, 1.0, 0.4, 0.5]
    assert m.loss(c) == pytest.approx(1.05752053, abs=1e-7)
    np.testing.assert_allclose(m.grad(c), [0.4363636, 4.5818182, -0.6009268, 0.4027132, 1.8310919, 0.3308908], atol=1e-6)


F1 = [[[0.1, 0.7, 1.4], [0.2, 0.9, 1.6]]]


def numeric_loss(events, T, lam, n):
    """Least squares and likelihood by quadrature."""
    x = np.linspace(0, T, 200_001)
    mid = (x[1:] + x[:-1]) / 2
    ls = ll = 0.0
    for i, ts in enumerate(events):
        v = np.array([lam(i, s) for s in ts])
        grid = lam(i, mid)
        ls += (grid**2).sum() * (x[1] - x[0]) - 2 * v.sum()
        ll += (grid.sum() * (x[1] - x[0]) - T) - np.log(v).sum()
    return ls / n, ll / n


def past(ts, beta, x):
    x = np.atleast_1d(x)
    return np.where(np.array(ts)[None] < x[:, None], beta * np.exp(-beta * np.clip(x[:, None] - np.array(ts)[None], 0, None)), 0).sum(1)


def test_losses_by_quadrature(spark):
    data = from_lists(spark, F1, 2.0)
    mu, a, b = np.array([0.35, 0.45]), np.array([[0.12, 0.05], [0.08, 0.16]]), np.array([[1.1, 1.7], [0.9, 1.3]])

    def lam(i, x):
        return mu[i] + sum(a[i, j] * past(F1[0][j], b[i, j], x) for j in range(2))

    c = np.r_[mu, a.ravel()]
    ls, ll = numeric_loss(F1[0], 2.0, lam, 6)
    m1, m2 = hawkes.LeastSquares(data, b), hawkes.LogLikelihood(data, b)
    assert m1.loss(c) == pytest.approx(ls, rel=1e-4)
    assert m2.loss(c) == pytest.approx(ll, rel=1e-4)
    for m in (m1, m2):
        g = [(m.loss(c + e) - m.loss(c - e)) / 2e-5 for e in np.eye(6) * 1e-5]
        np.testing.assert_allclose(m.grad(c), g, atol=1e-5)


def test_sum_of_exponentials_and_periods(spark):
    events = [[0.2, 0.9, 1.4], [0.5, 1.1]]
    data = from_lists(spark, [events], 2.0)
    decays, period = [0.7, 1.3], 1.5
    c = np.array([0.25, 0.35, 0.2, 0.4, 0.3, 0.45, 0.05, 0.03, 0.02, 0.04, 0.01, 0.06, 0.04, 0.02])
    b, a = c[:6].reshape(2, 3), c[6:].reshape(2, 2, 2)

    def lam(i, x):
        x = np.atleast_1d(x)
        step = np.minimum(np.floor((x % period) / period * 3), 2).astype(int)
        return b[i][step] + sum(a[i, j, u] * past(events[j], decays[u], x) for j in range(2) for u in range(2))

    ls, _ = numeric_loss(events, 2.0, lam, 5)
    m = hawkes.PeriodicLeastSquares(data, decays, 3, period)
    assert m.loss(c) == pytest.approx(ls, rel=1e-4)
    g = [(m.loss(c + e) - m.loss(c - e)) / 2e-5 for e in np.eye(14) * 1e-5]
    np.testing.assert_allclose(m.grad(c), g, atol=1e-5)
    flat = hawkes.LeastSquares(data, decays)
    one = hawkes.PeriodicLeastSquares(data, decays, 1, period)
    assert flat.loss(np.r_[0.2, 0.3, c[6:]]) == pytest.approx(one.loss(np.r_[0.2, 0.3, c[6:]]), rel=1e-12)


def test_compensator_closed_form(spark):
    events = [[0.2, 0.9, 1.8], [0.5, 1.1]]
    p = hawkes.ExpParameters([0.4, 0.2], [[0.3, 0.2], [0.1, 0.4]], [[1.5, 2.0], [0.7, 1.2]])
    data = from_lists(spark, [events], 2.0)
    for r in hawkes.compensators(data, p).collect():
        i, t = r["node"], r["t"]
        want = p.mu[i] * t + sum(p.alpha[i, j, 0] * sum(1 - np.exp(-p.pair_decays[i, j, 0] * (t - s)) for s in events[j] if s < t) for j in range(2))
        assert r["compensator"] == pytest.approx(want, rel=1e-12)
    gaps = hawkes.residuals(hawkes.compensators(data, p))
    assert gaps.count() == 3
    assert hawkes.residual_summary(gaps).count() == 2 and hawkes.qq_points(gaps).count() == 3


def test_invalid_events(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, -1.0), (1, None, 2.0)], "r bigint, node int, t double")
    d = event_data(df, 2, 1.0)
    assert d.violations()["bad_time"] == 1
    with pytest.raises(ValueError):
        d.checked()


@pytest.mark.parametrize("parts", [1, 6])
def test_ranks_and_previous(spark, parts):
    from tidewire.operators.scan import previous, ranks

    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), float(c), i) for i, (a, b, c) in enumerate(zip(rng.choice([1, 1, 1, 1, 2, 3], 200), rng.integers(0, 2, 200), np.round(rng.normal(size=200), 1)))]
    df = spark.createDataFrame(rows, "a int, b int, v double, i int")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["i"]: (r["rank"], r["total"]) for r in ranks(df, "a", ["v", "i"]).collect()}
        before = {r["i"]: r["before"] for r in previous(df, ["a", "b"], ["v", "i"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for a in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == a), key=lambda r: (r[2], r[3]))
        assert [got[r[3]] for r in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
        for b in (0, 1):
            line = [r for r in own if r[1] == b]
            assert [before[r[3]] for r in line] == [None, *(r[2] for r in line[:-1])]
    assert ranks(df.limit(0), "a", ["v"]).count() == previous(df.limit(0), ["a"], ["v"], "v").count() == 0


def test_any_kernels(spark):
    from tidewire.functions import kernels as K
    from tidewire.operators import general

    class Triangle(K.Kernel):  # a kernel of one's own without a Column form
        support = 2.0

        def shape(self, t):
            return 0.2 * np.maximum(1 - t / 2, 0)

    rng = np.random.default_rng(0)
    events = [np.sort(rng.uniform(0, 30, 40)).round(2) for _ in range(2)]
    data = from_lists(spark, [[e.tolist() for e in events]], 30.0)
    mu = [0.3, 0.5]
    for own in (K.PowerLaw(0.1, 0.5, 1.5, 5), Triangle()):
        kernels = [[K.Exponential(0.2, 1.5), own], [K.TimeFunctionKernel(t=[0, 1, 2], y=[0.3, 0.1, 0]), K.ExponentialSum((0.1, 0.2), (0.5, 2.0))]]
        for r in general.kernel_intensities(data, kernels, mu).collect():
            want = mu[r["node"]] + sum(kernels[r["node"]][j].values(r["t"] - e[e < r["t"]]).sum() for j, e in enumerate(events))
            assert r["intensity"] == pytest.approx(want, rel=1e-10)
        for r in general.kernel_compensators(data, kernels, mu).collect():
            want = mu[r["node"]] * r["t"] + sum(kernels[r["node"]][j].primitive(float(r["t"] - s)) for j, e in enumerate(events) for s in e if s < r["t"])
            assert r["compensator"] == pytest.approx(want, rel=1e-9)
    assert general.matched_bases([[1, 2.0], [4, 1.0]], [[8, 2.1], [1, 2.0]])[0][:2] == (0, 1)


def test_further_realizations(spark):
    a, b = from_lists(spark, F1, 2.0), from_lists(spark, [[[0.3], [0.4, 1.0]]], 2.0)
    later = event_data(b.events.withColumn("r", F.lit(7)), 2, b.ends.withColumn("r", F.lit(7)))
    both = hawkes.LeastSquares(a, [0.7, 1.3]).extended(later)
    whole = hawkes.LeastSquares(a.with_realizations(later), [0.7, 1.3])
    c = np.linspace(0.1, 0.5, 10)
    assert both.loss(c) == pytest.approx(whole.loss(c), rel=1e-12)
    with pytest.raises(ValueError):
        hawkes.LeastSquares(a, [0.7, 1.3]).statistics + hawkes.LeastSquares(b, [0.7]).statistics
