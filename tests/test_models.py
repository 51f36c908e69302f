import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import losses, prox
from tidewire.functions.special import finite_difference_gradient, minimise
from tidewire.operators import binarizer, glm, longitudinal, metrics, quantiles, solvers, survival

ALL = [losses.Squared(), losses.Logistic(), losses.Hinge(), losses.SquaredHinge(), losses.SmoothedHinge(0.4), losses.Poisson(), losses.Poisson("identity"), losses.Huber(0.7), losses.Absolute(), losses.EpsilonInsensitive(0.3), losses.ModifiedHuber()]


def test_columns_and_numpy_agree(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 200)
    for f in ALL:
        y = {"real": rng.normal(0, 2, 200), "unit": rng.integers(0, 2, 200) * 1.0, "sign": rng.integers(0, 2, 200) * 2.0 - 1, "count": rng.poisson(3, 200) * 1.0}[f.labels]
        x = np.abs(z) + 0.1 if isinstance(f, losses.Poisson) and f.link == "identity" else z
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "z double, y double")
        got = np.array([tuple(r) for r in df.select(f.value(F.col("z"), F.col("y")), f.slope(F.col("z"), F.col("y"))).collect()])
        np.testing.assert_allclose(got.T, f.both(x, y), rtol=1e-9, atol=1e-12)
        e = 1e-6
        num = (f.both(x + e, y)[0] - f.both(x - e, y)[0]) / (2 * e)
        assert (np.abs(num - f.both(x, y)[1]) < 1e-4).mean() > 0.98


def rows(spark, x, y):
    return spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y)], "label double, features array<double>")


def test_solvers_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + rng.normal(0, 0.1, 200)
    model = glm.Glm(rows(spark, x, y), losses.Squared())
    c = np.array([0.1, 0.2, 0.3, 0.4])
    np.testing.assert_allclose(model.grad(c), finite_difference_gradient(model.loss, c), atol=1e-6)
    want = np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0]
    for name, tol in (("agd", 1e-2), ("gd", 1e-2), ("bfgs", 1e-5), ("svrg", 0.05), ("saga", 0.1)):
        got = solvers.Solver(name, step=0.3 if name in ("svrg", "saga") else 1 / model.lipschitz_best(), max_iter=15, tol=1e-12).solve(model, start=np.zeros(4))
        np.testing.assert_allclose(got, want, atol=tol)
    assert model.lipschitz_max() >= model.lipschitz_mean() > 0
    with pytest.raises(ValueError):
        glm.checked(rows(spark, [[math.nan]], [1.0]))
    fit = glm.Regression(losses.Squared(), penalty="none", solver="bfgs").fit(rows(spark, x, y))
    assert fit.score(rows(spark, x, y)) > 0.99
    lab = (y > 0) * 3.0 + 2
    logit = glm.Regression(losses.Logistic(), max_iter=10, step=1.0).fit(rows(spark, x, lab))
    assert logit.classes == [2.0, 5.0] and logit.score(rows(spark, x, lab)) > 0.9
    p = rows(spark, x, lab).select(logit.probability().alias("p")).agg(F.min("p"), F.max("p")).first()
    assert 0 < p[0] < p[1] < 1


def test_robust(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = x @ [1.0, -1.0] + 0.5 + rng.normal(0, 0.05, 60)
    y[:3] += 20
    df = spark.createDataFrame([(i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "row_id bigint, label double, features array<double>")
    c, mu = glm.robust_regression(df, C_rows=60 / 1.0, penalty="none", max_iter=12)
    found = {r["row_id"] for r in mu.collect()}
    assert {0, 1, 2} <= found


def test_prox():
    x = np.array([2.0, 3, 1, -4, 5, 2, 2, -1, -1, 9]) * 0.1
    s = prox.ProxL1(0.03, (3, 8))(x, 1.7)
    np.testing.assert_allclose(s[3:8], np.sign(x[3:8]) * np.maximum(np.abs(x[3:8]) - 0.051, 0))
    assert (s[:3] == x[:3]).all()
    n = prox.ProxNuclear(0.5, 2)
    np.testing.assert_allclose(n([3, 0, 0, 1.0]), [2.5, 0, 0, 0.5])
    assert n.value([3, 0, 0, 1.0]) == pytest.approx(2)
    rng = np.random.default_rng(0)
    for p in (prox.ProxL1(0.3), prox.ProxL2Squared(0.3), prox.ProxL2(0.3), prox.ProxElasticNet(0.3, 0.4), prox.ProxTV(0.3), prox.ProxSlope(0.3), prox.ProxGroupL1(0.3, [0, 3], [3, 4])):
        y = rng.normal(size=7)
        z = p(y, 0.9)
        best = 0.5 * ((z - y) ** 2).sum() + 0.9 * p.value(z)
        for _ in range(200):
            w = z + rng.normal(size=7) * 10 ** rng.uniform(-4, 0)
            assert best <= 0.5 * ((w - y) ** 2).sum() + 0.9 * p.value(w) + 1e-12
    assert prox.ProxPositive().value([-1.0]) == math.inf and prox.ProxL1(1.0, positive=True)([-3.0, 3.0]).tolist() == [0, 2]
    b = prox.ProxBinarsity(0.1, [0, 3], [3, 4])(rng.normal(size=7))
    assert abs(b[:3].sum()) < 1e-12 and abs(b[3:].sum()) < 1e-12
    assert prox.ProxEquality()([1.0, 3.0]).tolist() == [2, 2]
    assert prox.ProxMulti([prox.ProxL1(1.0), prox.ProxPositive()])([-3.0, 3.0]).tolist() == [0, 2]


def test_minimise():
    def rosen(x):
        return (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])

    np.testing.assert_allclose(minimise(rosen, [-1.2, 1.0]), [1, 1], atol=1e-6)
    np.testing.assert_allclose(minimise(lambda x: ((x + 1) @ (x + 1), 2 * (x + 1)), [2.0, 3.0], lower=0.0), [0, 0], atol=1e-12)


def test_survival_curves(spark):
    rng = np.random.default_rng(0)
    t = np.round(rng.uniform(0, 10, 100), 1) + 0.1
    e = rng.integers(0, 2, 100)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(t, e)] + [(None, 1)], "time double, event int")
    s, h, want_s, want_h = 1.0, 0.0, {0.0: 1.0}, {0.0: 0.0}
    for u in sorted(set(t[e == 1])):
        d, n = ((t == u) & (e == 1)).sum(), (t >= u).sum()
        s, h = s * (1 - d / n), h + d / n
        want_s[u], want_h[u] = s, h
    for got, want in ((survival.kaplan_meier(df), want_s), (survival.nelson_aalen(df), want_h)):
        got = {r[0]: r[1] for r in got.collect()}
        assert got.keys() == want.keys()
        np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-12)
    last = spark.createDataFrame([(1.0, 1), (2.0, 1)], "time double, event int")
    assert survival.kaplan_meier(last).orderBy("time").collect()[-1]["survival"] == 0
    assert survival.kaplan_meier(last.limit(0)).count() == 1


def test_cox(spark):
    rng = np.random.default_rng(3)
    x, t, e = rng.normal(size=(40, 2)), np.round(rng.uniform(0, 5, 40), 1), rng.integers(0, 2, 40)
    df = spark.createDataFrame([(float(a), int(b), [float(v) for v in c]) for a, b, c in zip(t, e, x)], "time double, event int, features array<double>")
    m = survival.CoxLikelihood(df)
    c = np.array([0.4, -0.3])
    s = x @ c
    want = sum(np.log(np.exp(s[t >= t[i]]).sum()) - s[i] for i in range(40) if e[i]) / e.sum()
    assert m.loss(c) == pytest.approx(want, rel=1e-10)
    np.testing.assert_allclose(m.grad(c), finite_difference_gradient(m.loss, c), atol=1e-6)


def entries(spark, cases):
    return spark.createDataFrame([(i, j, f, float(v)) for i, c in enumerate(cases) for j, row in enumerate(c) for f, v in enumerate(row) if v], "case_id bigint, interval bigint, feature int, value double")


CASES = [[[0, 1, 0], [0, 0, 0], [0, 1, 1]], [[1, 1, 1], [0, 0, 1], [1, 1, 0]]]


def matrix(df, n_cases, n, p):
    m = np.zeros((n_cases, n, p))
    for r in df.collect():
        m[r["case_id"], r["interval"], r["feature"]] += r["value"]
    return m


def test_longitudinal(spark):
    f = entries(spark, CASES)
    c = spark.createDataFrame([(0, 2), (1, 3)], "case_id bigint, censoring bigint")
    m = matrix(longitudinal.lagged(f, c, [1, 2, 1]), 2, 3, 7)
    assert m[0].tolist() == [[0, 0, 1, 0, 0, 0, 0], [0, 0, 0, 1, 0, 0, 0], [0] * 7]
    assert m[1].tolist() == [[1, 0, 1, 0, 0, 1, 0], [0, 1, 0, 1, 0, 1, 1], [1, 0, 1, 0, 1, 0, 1]]
    assert matrix(longitudinal.finite_products(f, 3), 2, 3, 6)[0, 2].tolist() == [0, 1, 1, 0, 0, 1]
    g = entries(spark, [[[0, 1, 0], [0, 0, 0], [0, 0, 1]], [[1, 1, 0], [0, 0, 1], [0, 0, 0]]])
    m = matrix(longitudinal.infinite_products(g, 3), 2, 3, 6)
    assert m[0, 2].tolist() == [0, 0, 1, 0, 0, 1] and m[1, 0].tolist() == [1, 1, 0, 1, 0, 0] and m[1, 1].tolist() == [0, 0, 1, 0, 1, 1]
    y = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 0)], "case_id bigint, interval bigint, y int")
    keep = longitudinal.active_cases(f, y)
    assert sorted(r[0] for r in keep.collect()) == [0, 1]
    assert longitudinal.restrict(f, keep).count() == f.count()
    with pytest.raises(ValueError):
        longitudinal.restrict(f, keep.where("case_id = 0"))
    assert longitudinal.censored(f, c).count() == f.count() - 2


def test_case_series(spark):
    f = entries(spark, [[[0, 1], [0, 1]], [[1, 1], [1, 0]]])
    c = spark.createDataFrame([(0, 2), (1, 2)], "case_id bigint, censoring bigint")
    y = spark.createDataFrame([(0, 0, 1), (1, 1, 1)], "case_id bigint, interval bigint, y int")
    s = survival.CaseSeries(longitudinal.lagged(f, c, [1, 1]), y, c, 4)
    x = np.array([0.0, 0, 1, 0])
    assert s.loss(x) == pytest.approx(-math.log((math.e / (2 * math.e)) / (1 + math.e)) / 2)
    np.testing.assert_allclose(s.grad(x), finite_difference_gradient(s.loss, x), atol=1e-6)
    assert s.lipschitz_max() > 0
    fit = survival.LaggedCaseSeries([1, 1], c_tv=10.0, c_group=20.0, max_iter=3).fit(f, y, c)
    assert np.isfinite(fit.score()) and len(fit.intervals()) == 4


def test_quantiles_and_binarizer(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=101), 1)
    df = spark.createDataFrame([(float(v), "abc"[i % 3], i % 2) for i, v in enumerate(x)] + [(None, None, None)], "x double, c string, `d:discrete` int")
    got = quantiles.quantiles(df, "x", [0, 0.1, 0.33, 0.5, 1])
    np.testing.assert_allclose(got, np.quantile(x, [0, 0.1, 0.33, 0.5, 1]))
    assert metrics.std_mad(df, "x") == pytest.approx(np.median(np.abs(x - np.median(x))) / 0.6744897501960817)
    assert metrics.std_iqr(df, "x") == pytest.approx((np.quantile(x, 0.75) - np.quantile(x, 0.25)) * 0.6744897501960817)
    b = binarizer.Binarizer(["x", "c", "d:discrete"], n_cuts=3).fit(df)
    assert b.kinds == {"x": "continuous", "c": "discrete", "d:discrete": "discrete"}
    edges = b.bounds["x"]
    assert edges[0] == -math.inf and b.sizes() == [4, 3, 2] and b.blocks() == [(0, 4), (4, 3), (7, 2)]
    for r in b.transform(df).where("x is not null").collect():
        assert r["onehot"][0] == sum(e < r["x"] for e in edges) - 1 and r["onehot"][1] == 4 + "abc".index(r["c"])
    unseen = spark.createDataFrame([(0.0, "z", 1)], df.schema)
    with pytest.raises(Exception, match="unseen"):
        b.transform(unseen).collect()


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 0.5), (0.0, 1.0), (2.0, 0.0), (0.0, 0.0)], "truth double, found double")
    assert tuple(metrics.support_metrics(df).first()) == (0.5, 0.5)
    rng = np.random.default_rng(0)
    s, y = np.round(rng.normal(size=80), 1), rng.integers(0, 2, 80)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics.auc(df).first()[0] == pytest.approx(want)
    last = metrics.roc_points(df).orderBy("threshold").first()
    assert last["fpr"] == last["tpr"] == 1


def test_many_categories_are_joined(spark, monkeypatch):
    rows = [(i, f"c{i % 40:02d}", float(i)) for i in range(200)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "id int, name string, onehot_x double")
    few = binarizer.Binarizer(["name", "onehot_x"], n_cuts=3).fit(df)
    want = {r["id"]: r["onehot"] for r in few.transform(df).collect()}
    monkeypatch.setattr(binarizer, "MOST_CATEGORIES", 10)
    many = binarizer.Binarizer(["name", "onehot_x"], n_cuts=3).fit(df)
    assert many.tables and many.blocks() == few.blocks()
    assert {r["id"]: r["onehot"] for r in many.transform(df).collect()} == want
    with pytest.raises(Exception, match="unseen"):
        many.transform(spark.createDataFrame([(1, "zz", 1.0)], df.schema)).collect()


@pytest.mark.parametrize("most", [100_000, 5])
def test_order_statistics(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST_VALUES", most)
    monkeypatch.setattr(quantiles, "_ACCURACY", 50)
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=700), np.full(400, 0.25), rng.normal(size=5) * 1e6]
    y = np.where(rng.uniform(size=len(x)) < 0.1, None, rng.integers(0, 4, len(x)))
    df = spark.createDataFrame([(float(a), None if b is None else int(b), None) for a, b in zip(x, y)], "x double, y int, z double")
    shares = [0.0, 0.01, 0.31, 0.5, 0.77, 1.0]
    got = quantiles.column_quantiles(df, {"x": shares, "y": shares, "z": [0.5]})
    np.testing.assert_allclose(got["x"], np.quantile(x, shares))
    np.testing.assert_allclose(got["y"], np.quantile([b for b in y if b is not None], shares))
    assert got["z"] == []
    assert quantiles.quantiles(df, "x", [0.5], "nearest") == [np.sort(x)[int(np.rint(0.5 * (len(x) - 1)))]]


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_cox_sums_over_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(survival, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    t, e, x = np.r_[rng.integers(1, 12, 120), np.full(60, 5)].astype(float), rng.integers(0, 2, 180), rng.normal(size=(180, 2)) * 3
    rows = spark.createDataFrame([(float(a), int(b), [float(v) for v in c]) for a, b, c in zip(t, e, x)], "time double, event int, features array<double>")
    c = np.array([0.7, -1.2])
    w = np.exp(x @ c)
    risk = np.array([w[t >= a].sum() for a in t])
    pull = np.array([(w[t >= a, None] * x[t >= a]).sum(0) for a in t]) / risk[:, None]
    m = survival.CoxLikelihood(rows)
    value, grad = m.loss_and_grad(c)
    hit = e == 1
    assert value == pytest.approx((np.log(risk) - x @ c)[hit].sum() / hit.sum())
    np.testing.assert_allclose(grad, (pull - x)[hit].sum(0) / hit.sum(), atol=1e-9)
    assert survival.CoxRegression("l1", C=1e9, solver="agd", max_iter=2).fit(rows).coeffs.shape == (2,)
    with pytest.raises(ValueError):
        survival.CoxRegression().fit(rows.withColumn("event", rows["event"] * 0))
