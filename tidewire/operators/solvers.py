"""First-order solvers on the driver; each evaluation of a model is one Spark aggregate.

A model gives loss_and_grad(coeffs) and, for the stochastic solvers, the same of a batch, and
lipschitz_max() for a default step. Any object with these will do.
"""

from __future__ import annotations

import math

import numpy as np

from tidewire.functions.prox import Prox, ProxL2Squared, ProxZero
from tidewire.functions.special import minimise, relative_distance



def _evaluate(model, points: list, batch: tuple[int, int] | None = None) -> list[tuple[float, np.ndarray]]:
    """Losses and gradients at several points, in one pass where the model can do so."""
    extra = () if batch is None else (batch,)
    if hasattr(model, "evaluate"):
        return model.evaluate(points, *extra)
    return [model.loss_and_grad(x, *extra) for x in points]


SOLVERS = ("gd", "agd", "adagrad", "bfgs", "gfb", "scpg", "sdca", "sgd", "svrg", "saga")


class Solver:
    """gd, gfb, scpg and sdca are proximal gradient descent, agd its accelerated form, adagrad
    scales steps by past gradients; bfgs is for smooth penalties. sgd, svrg and saga go through
    the rows in batches; saga keeps one gradient per batch.

    bb takes Barzilai-Borwein steps (gd, agd, svrg). average is 'last', 'avg' or 'rand': what
    an epoch of svrg ends with. It stops once the objective's relative change is below tol, bfgs once
    no slope is above it; converged tells whether it got there within max_iter.
    """

    def __init__(self, name: str = "agd", step: float | None = None, tol: float = 1e-5, max_iter: int = 100, bb: bool = False, batches: int = 4, average: str = "last", seed: int = 0):
        if name not in SOLVERS or average not in ("last", "avg", "rand"):
            raise ValueError(f"solver must be one of {SOLVERS}, average last, avg or rand")
        self.name, self.step, self.tol, self.max_iter = name, step, tol, max_iter
        self.bb, self.batches, self.average, self.seed = bb, batches, average, seed
        self.history: list[dict] = []
        self.converged = False

    def solve(self, model, prox: Prox | None = None, start=None) -> np.ndarray:
        prox = prox or ProxZero()
        x = np.asarray(start, float).copy()
        step = self.step
        if step is None and self.name != "bfgs":
            try:
                step = 1 / model.lipschitz_max()
            except (AttributeError, ValueError, ZeroDivisionError):
                step = 1e-2
        self.history, self.converged = [], False
        if self.max_iter <= 0:
            return x
        if self.name == "bfgs":
            return self._bfgs(model, prox, x)
        if self.name in ("sgd", "svrg", "saga"):
            return self._stochastic(model, prox, x, step)
        return self._gradient(model, prox, x, step)

    def _done(self, i: int, x, old, value: float, before: float, step: float) -> bool:
        rel = abs(value - before) / max(abs(before), 1.0)
        self.history.append({"n_iter": i, "obj": value, "rel_obj": rel, "rel_delta": relative_distance(x, old), "step": step})
        self.converged = rel < self.tol
        return self.converged

    def _bfgs(self, model, prox, x):
        if not isinstance(prox, (ProxZero, ProxL2Squared)):
            raise ValueError("bfgs needs a smooth penalty")
        a, b = prox.range or (0, len(x))

        def f(c):
            value, grad = model.loss_and_grad(c)
            grad = grad.copy()
            grad[a:b] += prox.strength * c[a:b]
            return value + prox.value(c), grad

        x = minimise(f, x, max_iter=self.max_iter, tol=self.tol)
        value, grad = f(x)
        self.converged = float(np.abs(grad).max(initial=0.0)) < self.tol
        self.history.append({"n_iter": self.max_iter, "obj": value, "rel_obj": 0.0, "rel_delta": 0.0, "step": 1.0})
        return x

    def _gradient(self, model, prox, x, step):
        fast, y, t, seen = self.name == "agd", x.copy(), 1.0, np.zeros_like(x)
        value, grad = model.loss_and_grad(x)
        before = value + prox.value(x)
        last = None
        for i in range(1, self.max_iter + 1):
            at = y if fast else x
            if self.bb and last is not None:
                s, d = at - last[0], grad - last[1]
                if s @ d > 1e-30:
                    step = float(s @ s / (s @ d))
            last = at.copy(), grad.copy()
            if self.name == "adagrad":
                seen += grad * grad
                scaled = step / (np.sqrt(seen) + 1e-12)
                new = prox(x - scaled * grad, float(scaled.mean()))
            else:
                new = prox(at - step * grad, step)
            if fast:
                new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
                y, t = new + (t - 1) / new_t * (new - x), new_t
            # The objective is measured at the new point; the next gradient is taken at y, or there too.
            found = _evaluate(model, [new, y] if fast else [new])
            obj, grad = found[0][0] + prox.value(new), found[-1][1]
            old, x = x, new
            if self._done(i, x, old, obj, before, step):
                break
            before = obj
        return x

    def _stochastic(self, model, prox, x, step):
        rng, m = np.random.default_rng(self.seed), self.batches
        before = model.loss_and_grad(x)[0] + prox.value(x)
        table = np.stack([model.loss_and_grad(x, (b, m))[1] for b in range(m)]) if self.name == "saga" else None
        last = full_grad = None
        for i in range(1, self.max_iter + 1):
            old, points = x.copy(), []
            if self.name == "svrg":
                anchor, full = x.copy(), full_grad if full_grad is not None else model.loss_and_grad(x)[1]
                if self.bb and last is not None:
                    s, d = anchor - last[0], full - last[1]
                    if s @ d > 1e-30:
                        step = float(s @ s / (s @ d)) / m
                last = anchor, full
            for b in rng.permutation(m):
                found = _evaluate(model, [x, anchor] if self.name == "svrg" else [x], (int(b), m))
                g = found[0][1]
                if self.name == "svrg":
                    g = g - found[1][1] + full
                elif self.name == "saga":
                    mean = table.mean(axis=0)
                    g, table[b] = g - table[b] + mean, g
                x = prox(x - step * g, step)
                points.append(x)
            if self.name == "svrg" and self.average != "last":
                x = np.mean(points, axis=0) if self.average == "avg" else points[int(rng.integers(m))]
            value, full_grad = model.loss_and_grad(x)
            obj = value + prox.value(x)
            if self._done(i, x, old, obj, before, step):
                break
            before = obj
        return x
