"""Generalised linear and robust models: one aggregate over the rows per evaluation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import losses, prox
from tidewire.functions.special import normal_quantile
from tidewire.operators import solvers
from tidewire.operators.weighted import dense, task_sums
from tidewire.session import written


def two_classes(rows: DataFrame, label: str = "label") -> list[float]:
    """The two label values, ascending; any other number of them is an error."""
    found = sorted(r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().limit(3).collect())
    if len(found) != 2:
        raise ValueError("exactly two classes are needed")
    return found


def checked(rows: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """Rows of a label and complete finite features of one length; else an error."""
    x = rows.select(F.col(label).cast("double").alias("label"), F.col(features).cast("array<double>").alias("features"))
    wrong = ~F.coalesce(F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) | F.col("label").isNull() | F.isnan("label")
    r = x.agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b")).first()
    if not r["n"] or r["wrong"] or r["a"] != r["b"]:
        raise ValueError(f"{r['n']} rows, {r['wrong']} incomplete, {r['a']} to {r['b']} features")
    return x


def linear(coeffs, intercept: bool, features: str = "features") -> Column:
    """The linear prediction; with an intercept it is the last coefficient."""
    w = [float(c) for c in coeffs]
    base = w.pop() if intercept else 0.0
    return F.aggregate(F.zip_with(features, F.array(*(F.lit(v) for v in w)), lambda a, b: a * b), F.lit(base), lambda s, v: s + v)


def loss_table(rows: DataFrame, coeffs, loss: losses.Loss, intercept: bool = True) -> DataFrame:
    """rows with prediction, loss and slope, each row by itself, in Spark expressions."""
    z = rows.withColumn("prediction", linear(coeffs, intercept))
    return z.withColumn("loss", loss.value(F.col("prediction"), F.col("label"))).withColumn("slope", loss.slope(F.col("prediction"), F.col("label")))


class Glm:
    """A model over rows of label and features, kept as a table in one layout.

    Coefficients are those of the features, then the intercept. l2 doesn't act on the intercept.
    Two-class losses take any two labels; the larger is the positive class.
    """

    def __init__(self, rows: DataFrame, loss: losses.Loss, intercept: bool = True, l2: float = 0.0):
        x = checked(rows)
        self.loss_function, self.intercept, self.l2 = loss, intercept, l2
        self.classes = None
        if loss.labels in ("unit", "sign"):
            self.classes = two_classes(x)
            x = x.withColumn("label", F.when(F.col("label") == self.classes[1], 1.0).otherwise(0.0 if loss.labels == "unit" else -1.0))
        self.rows = written(x.withColumn("u", F.pmod(F.xxhash64("label", "features", F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int")), "glm-rows")
        r = self.rows.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("p")).first()
        self.n, self.p = r["n"], r["p"]
        self.size = self.p + intercept
        self.n_calls = 0

    def evaluate(self, points: list, batch: tuple[int, int] | None = None) -> list[tuple[float, np.ndarray]]:
        """Mean loss and gradient at several coefficient vectors, in one pass over all rows or
        over batch (number, batches) of them."""
        c, function, p, intercept = np.stack([np.asarray(x, float) for x in points], axis=1), self.loss_function, self.p, self.intercept
        self.n_calls += 1

        def partial(b):
            x, y = dense(b, "features", p), b.column(0).to_numpy(zero_copy_only=False)
            x = np.c_[x, np.ones(len(x))] if intercept else x
            value, slope = function.both(x @ c, y[:, None])
            return np.r_[len(y), value.sum(axis=0), (slope.T @ x).ravel()]

        rows = self.rows if batch is None else self.rows.where(F.pmod("u", F.lit(batch[1])) == batch[0])
        m = c.shape[1]
        s = task_sums(rows.select("label", "features"), 1 + m + m * self.size, partial)
        w = c.copy()
        if intercept:
            w[-1] = 0
        n, grads = max(s[0], 1), s[1 + m :].reshape(m, self.size)
        return [(s[1 + i] / n + self.l2 / 2 * w[:, i] @ w[:, i], grads[i] / n + self.l2 * w[:, i]) for i in range(m)]

    def loss_and_grad(self, coeffs, batch: tuple[int, int] | None = None) -> tuple[float, np.ndarray]:
        return self.evaluate([coeffs], batch)[0]

    def loss(self, coeffs) -> float:
        return self.loss_and_grad(coeffs)[0]

    def grad(self, coeffs) -> np.ndarray:
        return self.loss_and_grad(coeffs)[1]

    def quadratic(self) -> Quadratic:
        """The same squared loss as a quadratic form, from one pass over the rows."""
        p, intercept, size = self.p, self.intercept, self.size

        def partial(b):
            x, y = dense(b, "features", p), b.column(0).to_numpy(zero_copy_only=False)
            x = np.c_[x, np.ones(len(x))] if intercept else x
            return np.r_[(x.T @ x).ravel(), x.T @ y, y @ y]

        s = task_sums(self.rows.select("label", "features"), size * size + size + 1, partial) / max(self.n, 1)
        curve = np.full(size, self.l2)
        curve[p:] = 0
        return Quadratic(s[: size * size].reshape(size, size) + np.diag(curve), s[size * size : -1], float(s[-1]), self.lipschitz_max)

    def gram(self) -> np.ndarray:
        """X'X without the intercept."""
        p = self.p

        def partial(b):
            x = dense(b, "features", p)
            return (x.T @ x).ravel()

        return task_sums(self.rows.select("features"), p * p, partial).reshape(p, p)

    def _norms(self):
        sq = F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v) + (1.0 if self.intercept else 0.0)
        return self.rows.agg(F.max(sq).alias("m"), F.avg(sq).alias("a")).first()

    def _curve(self) -> float:
        if self.loss_function.curve is None:
            raise ValueError("this loss has no bounded curvature")
        return self.loss_function.curve

    def lipschitz_max(self) -> float:
        return self._curve() * self._norms()["m"] + self.l2

    def lipschitz_mean(self) -> float:
        return self._curve() * self._norms()["a"] + self.l2

    def lipschitz_best(self) -> float:
        top = float(np.linalg.eigvalsh(self.gram())[-1]) + (1.0 if self.intercept else 0.0)
        return self._curve() * top / self.n + self.l2


class Quadratic:
    """c'Gc / 2 - c'b + y / 2: a least-squares loss that needs the rows no more."""

    def __init__(self, gram: np.ndarray, target: np.ndarray, square: float, lipschitz_max):
        self.gram, self.target, self.square, self.lipschitz_max = gram, target, square, lipschitz_max

    def loss_and_grad(self, coeffs, batch=None) -> tuple[float, np.ndarray]:
        c = np.asarray(coeffs, float)
        g = self.gram @ c
        return float(c @ g / 2 - c @ self.target + self.square / 2), g - self.target


PENALTIES = ("none", "l1", "l2", "elasticnet", "tv", "binarsity")


def penalty_prox(penalty: str, C: float, size: int, ratio: float = 0.95, blocks=None) -> prox.Prox:
    """The prox of a penalty of weight 1 / C on the first size coefficients."""
    s, r = 1 / C, (0, size)
    if penalty == "none":
        return prox.ProxZero()
    if penalty == "l1":
        return prox.ProxL1(s, r)
    if penalty == "l2":
        return prox.ProxL2Squared(s, r)
    if penalty == "elasticnet":
        return prox.ProxElasticNet(s, ratio, r)
    if penalty == "tv":
        return prox.ProxTV(s, r)
    if penalty == "binarsity":
        if not blocks:
            raise ValueError("binarsity needs blocks of (start, length)")
        return prox.ProxBinarsity(s, [b[0] for b in blocks], [b[1] for b in blocks], r)
    raise ValueError(f"penalty must be one of {PENALTIES}")


class Regression:
    """A penalised fit of a Glm, and its predictions as Columns."""

    def __init__(self, loss: losses.Loss, penalty: str = "l2", C: float = 1e3, solver: str = "agd", intercept: bool = True, ratio: float = 0.95, blocks=None, step: float | None = None, max_iter: int = 100, tol: float = 1e-5, **options):
        self.loss, self.penalty, self.C, self.solver, self.intercept = loss, penalty, C, solver, intercept
        self.ratio, self.blocks, self.step, self.max_iter, self.tol, self.options = ratio, blocks, step, max_iter, tol, options

    def fit(self, rows: DataFrame, start=None) -> Regression:
        model = Glm(rows, self.loss, self.intercept)
        p = penalty_prox(self.penalty, self.C, model.p, self.ratio, self.blocks)
        s = solvers.Solver(self.solver, step=self.step, max_iter=self.max_iter, tol=self.tol, **self.options)
        # A squared loss is a quadratic form; only stochastic solvers look at the rows again.
        form = model.quadratic() if isinstance(self.loss, losses.Squared) and self.solver not in ("sgd", "svrg", "saga") else model
        self.coeffs = s.solve(form, p, np.zeros(model.size) if start is None else start)
        self.history, self.classes, self.converged = s.history, model.classes, s.converged
        self.weights, self.bias = (self.coeffs[:-1], float(self.coeffs[-1])) if self.intercept else (self.coeffs, 0.0)
        return self

    def decision(self, features: str = "features") -> Column:
        return linear(self.coeffs, self.intercept, features)

    def probability(self, features: str = "features") -> Column:
        """Of the larger class."""
        z = self.decision(features)
        return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))

    def prediction(self, features: str = "features") -> Column:
        """A number, a class, or a count rounded half to even."""
        if self.loss.labels == "count":
            return F.rint(F.exp(F.greatest(F.least(self.decision(features), F.lit(20.0)), F.lit(-20.0))))
        if self.classes:
            return F.when(self.decision(features) >= 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))
        return self.decision(features)

    def score(self, rows: DataFrame) -> float:
        """R squared, accuracy, or the mean Poisson loss."""
        x = rows.withColumn("_p", self.prediction())
        if self.loss.labels == "count":
            return float(loss_table(rows, self.coeffs, self.loss, self.intercept).agg(F.avg("loss")).first()[0])
        if self.classes:
            return float(x.agg(F.avg((F.col("_p") == F.col("label")).cast("double"))).first()[0])
        r = x.agg(F.sum(F.pow(F.col("label") - F.col("_p"), F.lit(2.0))).alias("e"), F.var_pop("label").alias("v"), F.count("*").alias("n")).first()
        return 1 - r["e"] / (r["v"] * r["n"]) if r["v"] else 0.0


class RowIntercepts:
    """Linear regression with an intercept of its own for every row.

    Row intercepts are a table of row_id and mu, joined to the rows; the gradient in them is
    the table of residuals over the number of rows.
    """

    def __init__(self, rows: DataFrame, intercept: bool = True):
        self.rows, self.intercept = rows.select("row_id", F.col("label").cast("double").alias("label"), F.col("features").cast("array<double>").alias("features")), intercept
        r = self.rows.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("p")).first()
        self.n, self.p = r["n"], r["p"]

    def residuals(self, coeffs, mu: DataFrame) -> DataFrame:
        joined = self.rows.join(mu.select("row_id", "mu"), "row_id", "left")
        return joined.withColumn("residual", linear(coeffs, self.intercept) + F.coalesce("mu", F.lit(0.0)) - F.col("label"))

    def loss(self, coeffs, mu: DataFrame) -> float:
        return float(self.residuals(coeffs, mu).agg(F.avg(F.col("residual") * F.col("residual") / 2)).first()[0])

    def grad(self, coeffs, mu: DataFrame) -> tuple[np.ndarray, DataFrame]:
        r, n = self.residuals(coeffs, mu), self.n
        p, intercept = self.p, self.intercept

        def partial(b):
            x = dense(b, "features", p)
            e = b.column(1).to_numpy(zero_copy_only=False)
            return np.r_[e @ x, e.sum()] if intercept else e @ x

        return task_sums(r.select("features", "residual"), p + intercept, partial) / n, r.select("row_id", (F.col("residual") / n).alias("grad"))

    def lipschitz_max(self) -> float:
        sq = F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v)
        return float(self.rows.agg(F.max(sq)).first()[0]) + 1 + self.intercept


def _least(gram: np.ndarray, target: np.ndarray, n: int, shrink: prox.Prox, start: np.ndarray) -> np.ndarray:
    """The least of c'Gc / 2n - c'target / n plus a penalty, by accelerated steps on the driver."""
    if isinstance(shrink, (prox.ProxZero, prox.ProxL2Squared)):
        a, b = getattr(shrink, "range", None) or (0, 0)
        ridge = np.zeros(len(target))
        ridge[a:b] = getattr(shrink, "strength", 0.0)
        return np.linalg.lstsq(gram / n + np.diag(ridge), target / n, rcond=None)[0]
    step = n / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-300)
    c = y = start
    t = 1.0
    for _ in range(100_000):
        new = shrink(y - step * (gram @ y - target) / n, step)
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, t, moved = new + (t - 1) / new_t * (new - c), new_t, np.abs(new - c).max(initial=0.0)
        c = new
        if moved <= 1e-13 * max(np.abs(c).max(initial=0.0), 1e-300):
            break
    return c


def robust_regression(rows: DataFrame, C_rows: float, penalty: str = "l2", C: float = 1e3, fdr: float = 0.05, intercept: bool = True, max_iter: int = 100, tol: float = 1e-7, strict: bool = False) -> tuple[np.ndarray, DataFrame]:
    """Linear regression that finds outliers: row intercepts under a sorted l1 penalty.

    Returns coefficients and a table of row_id, mu. Both blocks are solved exactly in turn: row
    intercepts are the sorted prox of the residuals, coefficients come from X'X on the driver.
    It stops once the coefficients change by no more than tol of the largest; strict makes it an
    error if max_iter ends it before. In the sorted prox only rows above the least penalty
    weight can stay nonzero, which are few if outliers are few; only they reach the driver, and
    more than a million are refused.
    """
    model = RowIntercepts(rows, intercept)
    n, p = model.n, model.p
    size = p + intercept

    def partial(b):
        x, label = dense(b, "features", p), b.column(1).to_numpy(zero_copy_only=False)
        x = np.c_[x, np.ones(len(x))] if intercept else x
        return np.r_[(x.T @ x).ravel(), x.T @ label]

    sums = task_sums(model.rows.select("features", "label"), size * size + size, partial)
    gram, target = sums[: size * size].reshape(size, size), sums[size * size :]
    shrink = penalty_prox(penalty, C, p)
    c = np.linalg.lstsq(gram, target, rcond=None)[0]  # the problem is convex: any start will do
    weight = lambda k: n / C_rows * normal_quantile(1 - fdr * (k + 1) / (2 * n))
    # The mean of the largest k entries exceeds the mean of their weights only if some entry exceeds the least weight.
    least = weight(n - 1) if n else 0.0
    values: list[tuple] = []
    for i in range(max_iter + 1):
        v = model.rows.select("row_id", (F.col("label") - linear(c, intercept)).alias("v"), "features")
        some = v.where(F.abs("v") > least).limit(1_000_001).collect()
        if len(some) > 1_000_000:
            raise ValueError("more than a million rows look like outliers; lower C_rows")
        some.sort(key=lambda r: -abs(r["v"]))
        flat = prox.falling(np.array([abs(r["v"]) for r in some]) - np.array([weight(k) for k in range(len(some))]))
        mu = flat * np.sign([r["v"] for r in some])
        values = [(r["row_id"], float(m)) for r, m in zip(some, mu, strict=True) if m != 0]
        if i == max_iter:
            if strict:
                raise ValueError(f"the robust fit was not done within {max_iter} rounds")
            break
        x = np.array([r["features"] for r in some], float).reshape(len(some), p)
        x = np.c_[x, np.ones(len(x))] if intercept else x
        new = _least(gram, target - x.T @ mu, n, shrink, c)
        far, c = np.abs(new - c).max(initial=0.0), new
        if far <= tol * np.abs(c).max(initial=0.0):
            break
    return c, rows.sparkSession.createDataFrame(values, f"row_id {dict(rows.dtypes)['row_id']}, mu double")
