"""Queries of single operators: prox, kernels, E-steps, gradients, scores, files written and read."""

from __future__ import annotations

import io
import tarfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.data import HOURS, EventData, test_events
from tidewire.functions import kernels as K
from tidewire.functions import losses, prox, special
from tidewire.operators import bands, binarizer, claw, cumulants, general, glm, hawkes, learners, longitudinal, metrics
from tidewire.operators.weighted import weighted_sums
from tidewire.plans import hawkes_queries as H
from tidewire.plans import model_queries as M
from tidewire.plans.shaping import array_table, named_values, r6, rounded, s6, sql_values
from tidewire.session import put, shared_dir, table
from tidewire.sources import arrays, svm_text

QUERIES, SQL = {}, {}
D = H.D


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- proximal operators: every embedding is a coefficient vector ----


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


_E = "e as (select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings)"
_ALL = f"with {_E}, n as (select *, len(x) as d, sqrt(list_sum(list_transform(x, lambda v: v * v))) as norm, list_avg(x) as mean from e), v as (select vec_id, unnest(range(0, d)) as k, unnest(x) as v, d, norm, mean from n)"
_SOFT = "sign(v) * greatest(abs(v) - {0}, 0)"
_BLOCK_NORM = "sqrt(sum(v * v) over (partition by vec_id, k < 5))"
# Name: the prox, and its value of the entry v at place k in SQL.
_PROX = {
    "zero": (prox.ProxZero(), "v"),
    "positive": (prox.ProxPositive(), "greatest(v, 0)"),
    "l1": (prox.ProxL1(0.05), _SOFT.format("0.05::double")),
    "l1_range": (prox.ProxL1(0.05, (2, 5)), f"case when k between 2 and 4 then {_SOFT.format('0.05::double')} else v end"),
    "l1_positive": (prox.ProxL1(0.05, positive=True), "greatest(v - 0.05::double, 0)"),
    "ridge": (prox.ProxL2Squared(0.05), "v / 1.05"),
    "group_l2": (prox.ProxL2(0.02), "v * greatest(1 - 0.02 * sqrt(d) / norm, 0)"),
    "elasticnet": (prox.ProxElasticNet(0.05, 0.9), f"{_SOFT.format('0.045::double')} / 1.005"),
    "equality": (prox.ProxEquality(), "mean"),
    "group_l1": (prox.ProxGroupL1(0.05, [0, 5], [5, 3], (0, 8)), f"case when k < 5 then v * greatest(1 - 0.05 * sqrt(5) / {_BLOCK_NORM}, 0) when k < 8 then v * greatest(1 - 0.05 * sqrt(3) / sqrt(sum(v * v) over (partition by vec_id, k between 5 and 7)), 0) else v end"),
    "composed": (prox.ProxMulti([prox.ProxL1(0.05), prox.ProxL2Squared(0.1)]), f"{_SOFT.format('0.05::double')} / 1.1"),
}


def _prox(name: str) -> None:
    p, sql = _PROX[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = general.proxed(_vectors(spark, folder), p)
        return out.select("vec_id", F.posexplode("x").alias("k", "v")).select("vec_id", F.col("k").cast("bigint").alias("k"), r6("v").alias("v"))

    run.__doc__ = f"The {name} prox of every embedding."
    QUERIES[f"prox_{name}"] = run
    SQL[f"prox_{name}"] = f"{_ALL} select vec_id, k, {s6(sql)} as v from v"


for _name in _PROX:
    _prox(_name)


@query
def prox_l1_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Soft thresholds that grow with the place."""
    d = len(_vectors(spark, folder).first()["x"])
    out = general.proxed(_vectors(spark, folder), prox.ProxL1Weighted(0.01, np.arange(d) + 1.0))
    return out.select("vec_id", F.posexplode("x").alias("k", "v")).select("vec_id", F.col("k").cast("bigint").alias("k"), r6("v").alias("v"))


SQL["prox_l1_weighted"] = f"{_ALL} select vec_id, k, {s6(_SOFT.format('0.01 * (k + 1)'))} as v from v"


@query
def prox_nuclear(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as matrices of two rows, their singular values shrunk."""
    out = general.proxed(_vectors(spark, folder), prox.ProxNuclear(0.3, n_rows=2))
    return out.select("vec_id", F.posexplode("x").alias("k", "v")).select("vec_id", F.col("k").cast("bigint").alias("k"), F.round("v", 5).alias("v"))


SQL["prox_nuclear"] = f"""{_ALL},
g as (select vec_id, sum(v * v) filter (k < d / 2) as a, sum(v * v) filter (k >= d / 2) as c, any_value(d) as d from v group by vec_id),
b as (select x.vec_id, sum(x.v * y.v) as b from v x join v y on x.vec_id = y.vec_id and y.k = x.k + x.d / 2 where x.k < x.d / 2 group by x.vec_id),
l as (select *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 as l1, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 as l2 from g join b using (vec_id)),
f as (select *, greatest(1 - 0.3 / sqrt(l1), 0) as f1, greatest(1 - 0.3 / sqrt(greatest(l2, 1e-300)), 0) as f2 from l),
m as (select vec_id, (f1 - f2) / (l1 - l2) as p, (l1 * f2 - l2 * f1) / (l1 - l2) as q, a, b, c from f)
select x.vec_id, x.k, (round(case when x.k < x.d / 2 then (p * a + q) * x.v + p * b * y.v else p * b * y.v + (p * c + q) * x.v end, 5) + 0.0) as v
from v x join m using (vec_id) join v y on y.vec_id = x.vec_id and y.k = case when x.k < x.d / 2 then x.k + x.d / 2 else x.k - x.d / 2 end"""


@query
def prox_slope(spark: SparkSession, folder: str) -> DataFrame:
    """Sorted l1 over the first six entries: the sizes by rank, whichever entry has them."""
    out = general.proxed(_vectors(spark, folder), prox.ProxSlope(0.1, 0.6, range=(0, 6)))
    six = F.slice(F.reverse(F.array_sort(F.transform(F.slice("x", 1, 6), F.abs))), 1, 6)
    return out.select("vec_id", F.posexplode(six).alias("k", "v")).select("vec_id", F.col("k").cast("bigint").alias("k"), r6("v").alias("v"))


_SIX = [float(0.1 * w) for w in prox.ProxSlope(0.1, 0.6).weights(6)]
SQL["prox_slope"] = f"""{_ALL}, {sql_values('w', 'k, w', list(enumerate(_SIX)))},
s as (select vec_id, row_number() over (partition by vec_id order by abs(v) desc) - 1 as k, abs(v) as v from v where k < 6),
z as (select vec_id, k, v - w as z from s join w using (k)),
m as (select a.vec_id, a.k as a, b.k as b, avg(z.z) as mean from z a join z b on a.vec_id = b.vec_id and a.k <= b.k join z on z.vec_id = a.vec_id and z.k between a.k and b.k group by a.vec_id, a.k, b.k),
h as (select z.vec_id, z.k, m.a, max(mean) as top from z join m on m.vec_id = z.vec_id and m.a <= z.k and m.b >= z.k group by z.vec_id, z.k, m.a)
select vec_id, k, {s6('greatest(min(top), 0)')} as v from h group by vec_id, k"""


@query
def prox_total_variation(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the total-variation prox meets its optimality conditions: running sums of what it
    takes off lie within the strength, and on its edge wherever neighbours differ."""
    s = 0.1
    x = _vectors(spark, folder)
    both = general.proxed(x, prox.ProxTV(s)).withColumnRenamed("x", "y").join(x, "vec_id").select("vec_id", F.posexplode(F.arrays_zip("x", "y")).alias("k", "e"))
    from pyspark.sql import Window

    w = Window.partitionBy("vec_id").orderBy("k")  # a vector's entries
    u = both.select("vec_id", "k", F.sum(F.col("e.x") - F.col("e.y")).over(w).alias("u"), (F.lead("e.y").over(w) - F.col("e.y")).alias("step"))
    fine = F.when(F.col("step").isNull(), F.abs("u") < 1e-9).when(F.abs("step") > 1e-12, F.abs(F.col("u") + s * F.signum("step")) < 1e-9).otherwise(F.abs("u") < s + 1e-9)
    return u.groupBy("vec_id").agg(F.count_if(~fine).alias("broken"))


SQL["prox_total_variation"] = "select vec_id, 0::bigint as broken from embeddings"


@query
def prox_binarsity(spark: SparkSession, folder: str) -> DataFrame:
    """Within blocks of four, total variation and then centring: sums of blocks, and whether
    the shape is that of the total-variation prox."""
    x = _vectors(spark, folder)
    out = general.proxed(x, prox.ProxBinarsity(0.1, [0, 4], [4, 4], (0, 8)))
    tv = general.proxed(general.proxed(x, prox.ProxTV(0.1, (0, 4))), prox.ProxTV(0.1, (4, 8))).withColumnRenamed("x", "y")
    both = out.join(tv, "vec_id").select("vec_id", F.posexplode(F.arrays_zip("x", "y")).alias("k", "e")).where("k < 8")
    return both.groupBy("vec_id", F.floor(F.col("k") / 4).alias("b")).agg(r6(F.sum("e.x")).alias("s"), r6(F.max(F.col("e.x") - F.col("e.y")) - F.min(F.col("e.x") - F.col("e.y"))).alias("bend"))


SQL["prox_binarsity"] = "select vec_id, b::bigint as b, 0.0::double as s, 0.0::double as bend from embeddings, range(0, 2) z(b)"

# ---- kernels, time functions, baselines ----

_EXP, _SUMS = K.Exponential(0.4, 1.5), K.ExponentialSum((0.2, 0.3), (1.0, 2.0))


@query
def kernel_primitives(spark: SparkSession, folder: str) -> DataFrame:
    """Primitives, norms and bounds of kernels at the days since the first order's month began."""
    days = table(spark, folder, "orders").select(F.dayofmonth("o_orderdate").alias("d")).distinct()
    x = sorted(r["d"] for r in days.collect())  # at most 31
    kernels = {"exp": _EXP, "sum": _SUMS, "power": H.POWER, "curve": K.TimeFunctionKernel(H.CURVE), "zero": K.Zero()}
    rows = [(n, d, *(round(float(v), 5) + 0.0 for v in (k.primitive(float(min(d, 6) if n == "curve" else d)), k.norm(), k.future_bound(float(d))))) for n, k in kernels.items() for d in x]
    return spark.createDataFrame(rows, "kernel string, d int, primitive double, norm double, bound double")


_D5 = lambda x: f"(round({x}, 5) + 0.0)"
SQL["kernel_primitives"] = f"""with x as (select distinct day(o_orderdate)::int as d from orders),
v as (
  select 'exp' as kernel, d, 0.4 * (1 - exp(-1.5 * d)) as p, 0.4::double as n, 0.6 * exp(-1.5 * d) as b from x
  union all select 'sum', d, 0.2 * (1 - exp(-1.0 * d)) + 0.3 * (1 - exp(-2.0 * d)), 0.5, 0.2 * exp(-1.0 * d) + 0.6 * exp(-2.0 * d) from x
  union all select 'power', d, 0.05 * (pow(0.5 + least(d, 12), -0.3) - pow(0.5, -0.3)) / -0.3, 0.05 * (pow(12.5, -0.3) - pow(0.5, -0.3)) / -0.3, case when d < 12 then 0.05 * pow(0.5 + d, -1.3) else 0 end from x
  union all select 'curve', d, [0.3, 0.525, 0.8, 1.05, 1.2, 1.25][least(d, 6)], 1.25, [0.3, 0.3, 0.3, 0.3, 0.3, 0.0][least(d, 6)] from x
  union all select 'zero', d, 0, 0, 0 from x)
select kernel, d, {_D5('p')} as primitive, {_D5('n')} as norm, {_D5('b')} as bound from v"""


@query
def timefunc_modes(spark: SparkSession, folder: str) -> DataFrame:
    """A time function under every way of running between its points and beyond them."""
    e = test_events(spark, folder).events.select("eid", F.pmod("t", F.lit(12.0)).alias("x"))
    modes = [(b, i) for b in (K.ZERO, K.CONSTANT, K.CONTINUE, K.CYCLIC) for i in (K.LINEAR, K.CONST_LEFT, K.CONST_RIGHT)]
    f = [K.TimeFunction(([1.0, 2.0, 4.0], [0.5, 0.1, 0.3]), b, i, border_value=0.7) for b, i in modes]
    return e.select("eid", *(r6(g.column(F.col("x"))).alias(f"{b}_{i}") for g, (b, i) in zip(f, modes, strict=True)))


def _mode_sql() -> str:
    inner = {"linear": "case when {x} < 2 then 0.5 - 0.4 * ({x} - 1) else 0.1 + 0.1 * ({x} - 2) end", "const_left": "case when {x} < 2 then 0.1 else 0.3 end", "const_right": "case when {x} < 2 then 0.5 else 0.1 end"}
    sides = {"zero": (0.0, 0.0), "constant": (0.7, 0.7), "continue": (0.5, 0.3)}
    out = []
    for b in ("zero", "constant", "continue", "cyclic"):
        for i, f in inner.items():
            x = "c" if b == "cyclic" else "x"
            low, high = sides.get(b, (0.0, 0.0))
            beyond = "" if b == "cyclic" else f"when x > 4 then {high}"
            out.append(s6(f"(case when {x} < 1 then {low} {beyond} when {x} = 4 then 0.3 else {f.format(x=x)} end)::double") + f" as {b}_{i}")
    return ", ".join(out)


SQL["timefunc_modes"] = f"with {H._EV}, x as (select eid, t - 12 * floor(t / 12) as x from ev), y as (select *, case when x > 4 then x - 1 - 3 * floor((x - 1) / 3) + 1 else x end as c from x) select eid, {_mode_sql()} from y"


@query
def baseline_primitives(spark: SparkSession, folder: str) -> DataFrame:
    """Integrals of the periodic baseline up to every half hour of three days, and its steps' starts."""
    rows = [(k, round(K.piecewise_baseline_primitive(k / 2, H.STEPS, H.PERIOD), 6), K.baseline_starts(4, H.PERIOD)[k % 4]) for k in range(144)]
    return spark.createDataFrame(rows, "k int, primitive double, start double")


SQL["baseline_primitives"] = f"""with k as (select k::int as k, k / 2.0::double as t from range(0, 144) z(k)), s as (select unnest([0, 1, 2, 3]) as i, unnest([0.1, 0.3, 0.2, 0.5]) as v)
select k, {s6('sum(v * (floor(t / 24) * 6 + least(greatest(t - 24 * floor(t / 24) - 6 * i, 0), 6)))::double')} as primitive, (k % 4 * 6)::double as start from k, s group by k, t"""


@query
def stationary_process(spark: SparkSession, folder: str) -> DataFrame:
    """Spectral radius, stationary intensities and cumulants of kernel norms from the orders' shares."""
    s = table(spark, folder, "orders").agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("f"), F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("o")).first()
    a = np.array([[0.5 * s["f"], 0.2], [0.1, 0.5 * s["o"]]])
    x = K.stationary_intensity(a, [0.3, 0.4])
    m, c, k = cumulants.theoretical(a[:1, :1], [0.3])
    return named_values(spark, radius=K.spectral_radius(a), first=x[0], second=x[1], mean=m[0], covariance=c[0, 0], skewness=k[0, 0])


SQL["stationary_process"] = f"""with s as (select 0.5 * avg((o_orderstatus = 'F')::int) as p, 0.5 * avg((o_orderstatus = 'O')::int) as q from orders),
d as (select *, (1 - p) * (1 - q) - 0.02 as det, 1 / (1 - p) as r from s)
select {s6('(p + q + sqrt((p - q) * (p - q) + 0.08)) / 2')} as radius, {s6('((1 - q) * 0.3 + 0.2 * 0.4) / det')} as first, {s6('(0.1 * 0.3 + (1 - p) * 0.4) / det')} as second,
  {s6('0.3 * r')} as mean, {s6('0.3 * r * r * r')} as covariance, {s6('3 * r * r * (0.3 * r * r * r) - 2 * r * r * r * (0.3 * r)')} as skewness from d"""

# ---- point processes ----


@query
def sumexp_loglik_grad(spark: SparkSession, folder: str) -> DataFrame:
    g = hawkes.LogLikelihood(test_events(spark, folder), H.DECAYS).grad(np.r_[H.MU, H.ALPHA2.ravel()])
    return array_table(spark, g[:D, None, None], "i j u").withColumns({"j": F.lit(-1), "u": F.lit(-1)}).unionByName(array_table(spark, g[D:].reshape(D, D, 2), "i j u"))


SQL["sumexp_loglik_grad"] = f"""with {H._EV}, {H._NO}, {H._DE}, {H._MU}, {H._AL2}, {H._R}, {H._G2}, {H._LAM2}, {H._SRC2}, n as (select count(*) as n from ev)
select node as i, -1 as j, -1 as u, {s6(f'({H._WHOLE} - sum(1 / lam)) / any_value(n)')} as value from lam2, n group by node
union all select g2.node, v, u, {s6('(any_value(s) - sum(g / lam)) / any_value(n)')} from g2 join lam2 using (eid) join src2 on src2.j = v and src2.u = g2.u, n group by g2.node, v, g2.u"""
SQL["sumexp_loglik_grad"] = SQL["sumexp_loglik_grad"].replace("select g2.node, v, u,", "select g2.node, v, g2.u,")


@query
def exp_ls_grad(spark: SparkSession, folder: str) -> DataFrame:
    g = hawkes.LeastSquares(test_events(spark, folder), H.BETA).grad(np.r_[H.MU, H.ALPHA.ravel()])
    return array_table(spark, g[:D, None], "i j").withColumn("j", F.lit(-1)).unionByName(array_table(spark, g[D:].reshape(D, D), "i j"))


SQL["exp_ls_grad"] = f"""with {H._EV}, {H._NO}, {H._MU}, {H._AL}, {H._R}, {H._G}, {H._SRC}, n as (select count(*) as n from ev),
pr as (select p.node as j, q.node as k, sum({H.BETA / 2} * exp(-{H.BETA} * abs(p.t - q.t)) * (1 - exp(-{2 * H.BETA} * ({H._T} - greatest(p.t, q.t))))) as v from ev p join ev q on p.r = q.r group by p.node, q.node),
w as (select i, sum(a * s) as ws from al join src using (j) group by i), c as (select node as i, count(*) as c from ev group by node),
es as (select node as i, v as j, sum(g) as s from g group by node, v), wq as (select i, k as j, sum(a * v) as q from al join pr using (j) group by i, k)
select mu.i, -1 as j, {s6(f'2 * (m * {H._WHOLE} + ws - c) / n')} as value from mu join w using (i) join c using (i), n
union all select mu.i, src.j, {s6('2 * (m * src.s + q - es.s) / n')} from mu cross join src join wq on wq.i = mu.i and wq.j = src.j join es on es.i = mu.i and es.j = src.j, n"""

_AMPLITUDES = np.stack([H.ALPHA / 2, H.ALPHA / 3, H.ALPHA / 4], axis=2)


@query
def gaussian_estep(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of normal features over intensity, by target, source and mean."""
    f = bands.gaussian_features(test_events(spark, folder), H.GAUSS_MEANS, H.GAUSS_STD)
    s = weighted_sums(f, H.MU, _AMPLITUDES.reshape(D, -1))
    return array_table(spark, s.over.reshape(D, D, 3), "u v m", decimals=4)


_GA = sql_values("ga", "u, v, m, a", [(u, v, m, float(_AMPLITUDES[u, v, m])) for u in range(D) for v in range(D) for m in range(3)])
_GF = f"gf as (select e.eid, e.node as u, p.node as v, m::int as m, sum(exp(-0.5 * pow((e.t - p.t - 4.0 * m) / {H._GS}, 2)) / ({H._GS} * sqrt(2 * pi()))) as g from ev e join ev p on p.r = e.r and p.t < e.t and e.t - p.t < 60 cross join range(0, 3) z(m) group by e.eid, e.node, p.node, m)"
SQL["gaussian_estep"] = f"""with {H._EV}, {H._MU}, {_GA}, {_GF}, l as (select eid, u, any_value(mu.m) + sum(g * a) as lam from gf join ga using (u, v, m) join mu on mu.i = u group by eid, u),
s as (select gf.u, v, m, sum(g / lam) as s from gf join l using (eid) group by gf.u, v, m)
select ga.u, ga.v, ga.m, (round(coalesce(s, 0), 4) + 0.0) as value from ga left join s using (u, v, m)"""

_BASIS = np.stack([0.5 ** np.arange(H.SIZE), np.full(H.SIZE, 0.3)])
_MIX = np.stack([H.ALPHA, H.ALPHA / 2], axis=2)


@query
def basis_estep(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of lag counts over intensity under mixtures of two bases, by target, source and step."""
    kernel = np.einsum("uvd,dm->uvm", _MIX, _BASIS)
    s = weighted_sums(bands.step_counts(test_events(spark, folder), H.STEP, H.SIZE), H.MU, kernel.reshape(D, -1))
    return array_table(spark, s.over.reshape(D, D, H.SIZE), "u v m", decimals=4)


_BK = sql_values("bk", "u, v, m, k", [(u, v, m, float(np.einsum("d,d->", _MIX[u, v], _BASIS[:, m]))) for u in range(D) for v in range(D) for m in range(H.SIZE)])
SQL["basis_estep"] = f"""with {H._EV}, {H._MU}, {_BK},
c as (select e.eid, e.node as u, p.node as v, floor((e.t - p.t) / 2)::int as m, count(*) as n from ev e join ev p on p.r = e.r and p.t <= e.t and p.eid <> e.eid and floor((e.t - p.t) / 2) < {H.SIZE} group by all),
l as (select eid, any_value(mu.m) + sum(n * k) as lam from c join bk using (u, v, m) join mu on mu.i = u group by eid),
s as (select c.u, v, c.m, sum(n / lam) as s from c join l using (eid) group by c.u, v, c.m)
select bk.u, bk.v, bk.m, (round(coalesce(s, 0), 4) + 0.0) as value from bk left join s using (u, v, m)"""


@query
def piecewise_compensators(spark: SparkSession, folder: str) -> DataFrame:
    """Compensators of piecewise constant kernels at the events."""
    c = learners.piecewise_compensators(test_events(spark, folder), H.EDGES, H.MU, H.KERNEL)
    return c.select("eid", r6("compensator").alias("compensator"))


SQL["piecewise_compensators"] = f"""with {H._EV}, {H._KE}, {H._M0}, e as (select * from (values (0, 0.0, 2.0), (1, 2.0, 6.0), (2, 6.0, 24.0)) b(m, lo, hi))
select ev.eid, {s6('any_value(m0.m) * any_value(ev.t) + coalesce(sum(k * greatest(0, least(ev.t - p.t, hi) - lo)), 0)')} as compensator
from ev join m0 on m0.u = ev.node left join ev p on p.r = ev.r and p.t < ev.t left join k0 on k0.u = ev.node and k0.v = p.node left join e on e.m = k0.m group by ev.eid"""


@query
def mixed_kernel_compensators(spark: SparkSession, folder: str) -> DataFrame:
    """Compensators under power-law, exponential and zero kernels at the events."""
    c = general.kernel_compensators(test_events(spark, folder), H.MIXED, [0.1] * D)
    return c.select("eid", r6("compensator").alias("compensator"))


SQL["mixed_kernel_compensators"] = f"""with {H._EV}, {H._AL}
select b.eid, {s6(f"0.1 * b.t + coalesce(sum(case when (b.node + p.node) % 3 = 0 then 0.05 * (pow(0.5 + least(b.t - p.t, 12), -0.3) - pow(0.5, -0.3)) / -0.3 when (b.node + p.node) % 3 = 1 then a * (1 - exp(-{H.BETA} * (b.t - p.t))) else 0 end), 0)")} as compensator
from ev b left join ev p on p.r = b.r and p.t < b.t left join al on al.i = b.node and al.j = p.node group by b.eid, b.t"""


@query
def delayed_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events with those of two nodes put off."""
    d = claw.delayed(test_events(spark, folder), [1, 3], 0.25)
    return d.events.select("eid", r6("t").alias("t"))


SQL["delayed_events"] = f"with {H._EV} select eid, {s6('t + case when node in (1, 3) then 0.25 else 0 end')} as t from ev"


@query
def joined_realizations(spark: SparkSession, folder: str) -> DataFrame:
    """Least-squares losses of a model extended by the realizations of odd number."""
    d = test_events(spark, folder)
    half = [EventData(d.events.where(F.pmod("r", F.lit(2)) == k), d.ends.where(F.pmod("r", F.lit(2)) == k), D) for k in (0, 1)]
    return named_values(spark, loss=hawkes.LeastSquares(half[0], H.BETA).extended(half[1]).loss(np.r_[H.MU, H.ALPHA.ravel()]))


SQL["joined_realizations"] = H.SQL["exp_ls_loss"]


@query
def kernel_integrals(spark: SparkSession, folder: str) -> DataFrame:
    """Norms and primitives of piecewise constant kernels after one step on the data."""
    em = learners.Expectation(H.EDGES)
    em.prepare(test_events(spark, folder))
    em.mu, em.kernel = em.step(H.MU, H.KERNEL)
    return array_table(spark, em.primitives(), "u v m").join(array_table(spark, em.norms(), "u v", "norm"), ["u", "v"])


SQL["kernel_integrals"] = f"""with {H._EV}, {H._R}, {H._NK}, {H._KE}, {H._M0}, {H._em_sql(0)}, w as (select *, k * case m when 0 then 2.0 when 1 then 4.0 else 18.0 end as x from k1)
select u, v, m, {s6('sum(x) over (partition by u, v order by m)')} as value, {s6('sum(x) over (partition by u, v)')} as norm from w"""

# ---- models, preprocessing, scores ----


@query
def batch_gradients(spark: SparkSession, folder: str) -> DataFrame:
    """The gradients of four batches of rows, weighed by their sizes: that of all rows."""
    m = glm.Glm(M._lines(spark, folder, M._price()), losses.Squared())
    sizes = {r["b"]: r["count"] for r in m.rows.groupBy(F.pmod("u", F.lit(4)).alias("b")).count().collect()}
    parts = [(n, *m.loss_and_grad(M.W, (b, 4))) for b, n in sizes.items()]
    return array_table(spark, sum(n * np.r_[v, g] for n, v, g in parts) / m.n, "k")


SQL["batch_gradients"] = M.SQL["linreg_loss_grad"]


@query
def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """R squared, accuracy and mean Poisson loss of fixed coefficients."""
    out = {}
    for name, loss, label, classes in (("r2", losses.Squared(), M._price(), None), ("accuracy", losses.Logistic(), M._returned(), [0.0, 1.0]), ("poisson", losses.Poisson(), M._count(), None)):
        fit = glm.Regression(loss)
        fit.coeffs, fit.classes = np.array(M.W), classes
        out[name] = fit.score(M._lines(spark, folder, label))
    return named_values(spark, **out)


SQL["model_scores"] = f"""with x as (select {M._Z} as z, l_extendedprice / 50000 as y, (l_returnflag = 'R') as r, (l_linenumber - 1)::double as c from lineitem)
select {s6('1 - sum((y - z) * (y - z)) / (var_pop(y) * count(*))')} as r2, {s6('avg(((z >= 0) = r)::int)')} as accuracy, {s6(f"avg(exp(z) - c * z + {M._FACT.replace('greatest(y, 1)', 'greatest(c, 1)')})")} as poisson from x"""


@query
def positive_cases(spark: SparkSession, folder: str) -> DataFrame:
    return longitudinal.positive_cases(M._series(spark, folder)[1])


SQL["positive_cases"] = "select distinct user_id as case_id from events where event_type = 'purchase'"


@query
def case_series_lipschitz(spark: SparkSession, folder: str) -> DataFrame:
    return named_values(spark, lipschitz=M._case_series(spark, folder).lipschitz_max())


SQL["case_series_lipschitz"] = f"""with {M._FT}, {M._LG}, {M._RW}, n as (select count(*) as n from ce),
sq as (select rw.case_id, rw.interval, coalesce(sum(value * value), 0) as q from rw left join lg using (case_id, interval) group by rw.case_id, rw.interval),
dt as (select a.case_id, a.interval as i, b.interval as j, sum(a.value * b.value) as d from lg a join lg b on a.case_id = b.case_id and a.feature = b.feature group by a.case_id, a.interval, b.interval),
ds as (select a.case_id, max(a.q + b.q - 2 * coalesce(d, 0)) as m from sq a join sq b on a.case_id = b.case_id left join dt on dt.case_id = a.case_id and dt.i = a.interval and dt.j = b.interval group by a.case_id)
select {s6('max(ds.m * total) / (4 * any_value(n))')} as lipschitz from ds join nz using (case_id), n where total > 0"""


@query
def column_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Detected types of columns of lineitem."""
    names = ["l_quantity", "l_linenumber", "l_returnflag", "l_shipmode", "l_discount", "l_extendedprice"]
    x = table(spark, folder, "lineitem")
    have = [n for n in names if n in x.columns]
    b = binarizer.Binarizer(have, n_cuts=3).fit(x)
    return spark.createDataFrame(sorted(b.kinds.items()), "name string, kind string").where("name in ('l_quantity', 'l_linenumber', 'l_returnflag', 'l_discount', 'l_extendedprice')")


_KIND = "case when count(try_cast({0} as double)) = count({0}) and count(distinct {0}) > 15 then 'continuous' else 'discrete' end as kind from lineitem"
SQL["column_kinds"] = " union all ".join(f"select '{c}' as name, {_KIND.format(c)}" for c in ("l_quantity", "l_linenumber", "l_returnflag", "l_discount", "l_extendedprice"))


@query
def binarizer_remove_first(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the ones of orders without the first category of each column."""
    o = table(spark, folder, "orders")
    b = binarizer.Binarizer(["o_orderstatus", "o_orderpriority"], remove_first=True).fit(o)
    return b.transform(o).select("o_orderkey", F.array_join(F.transform("onehot", lambda v: v.cast("string")), ",").alias("places"))


SQL["binarizer_remove_first"] = """with s as (select x, row_number() over (order by x) - 2 as k, count(*) over () - 1 as n from (select distinct o_orderstatus as x from orders)),
p as (select x, row_number() over (order by x) - 2 as k from (select distinct o_orderpriority as x from orders))
select o_orderkey, concat_ws(',', case when s.k >= 0 then s.k::varchar end, case when p.k >= 0 then (p.k + n)::varchar end) as places
from orders join s on s.x = o_orderstatus join p on p.x = o_orderpriority"""


@query
def history_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Every order total's distance from the least one."""
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("obj"))
    return metrics.distance_to_best(o).select("o_orderkey", F.round("distance", 4).alias("distance"))


SQL["history_distances"] = "select o_orderkey, round(o_totalprice - (select min(o_totalprice) from orders), 4) as distance from orders"


@query
def finite_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Gradient and curvature of the least-squares loss by differences, against the closed forms."""
    m, c = hawkes.LeastSquares(test_events(spark, folder), H.BETA), np.r_[H.MU, H.ALPHA.ravel()]
    g = np.abs(special.finite_difference_gradient(m.loss, c) - m.grad(c)) <= 1e-5 * np.maximum(np.abs(m.grad(c)), 1)
    h = special.finite_difference_hessian(m.loss, c, 1e-3)[:3, :3]
    return named_values(spark, right=int(g.sum()), curved=int(np.allclose(h, m.hessian(c)[:3, :3], rtol=1e-3)), apart=special.relative_distance(c, 2 * c))


SQL["finite_differences"] = f"select 30::bigint as right, 1::bigint as curved, {s6(f'{float(np.linalg.norm(np.r_[H.MU, H.ALPHA.ravel()]))!r}::double / greatest(2 * {float(np.linalg.norm(np.r_[H.MU, H.ALPHA.ravel()]))!r}::double, 1)')} as apart"

# ---- files ----


def _nation_lines(spark: SparkSession, folder: str) -> list[tuple]:
    """Region, key and line of the nations, a table of fixed size."""
    return [(r[0], r[1], f"{r[0] % 2} {r[1] + 1}:0.5 {r[1] + 30}:{r[0]}") for r in table(spark, folder, "nation").select("n_regionkey", "n_nationkey").orderBy("n_nationkey").collect()]


@query
def svmlight_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """kdd2010 written as SVMlight text and read again: entries and sums by label and index."""
    k = table(spark, folder, "kdd2010").where("label is not null and not exists(vals, v -> v is null) and not exists(cols, c -> c is null) and size(cols) > 0")
    path = f"{shared_dir(spark)}/svmlight-{uuid.uuid4().hex}"
    svm_text.write_svmlight(k, path, "label", "cols", "vals")
    back = svm_text.read_svmlight(spark, path).select("label", F.explode(F.arrays_zip("idx", "val")).alias("e"))
    return back.groupBy("label", F.col("e.idx").alias("idx")).agg(F.count("*").alias("n"), r6(F.sum("e.val")).alias("total"))


SQL["svmlight_round_trip"] = f"""with k as (select label, unnest(cols) as c, unnest(vals) as v from kdd2010
  where label is not null and len(cols) > 0 and len(list_filter(vals, lambda v: v is null)) = 0 and len(list_filter(cols, lambda c: c is null)) = 0)
select label, c::bigint - (select case when min(c) + 1 = 0 then 0 else 0 end from k) as idx, count(*) as n, {s6('sum(v)')} as total from k group by label, c"""


@query
def tar_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the members of an archive, with its size and checksum known."""
    out = io.BytesIO()
    rows = _nation_lines(spark, folder)
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for region in sorted({r[0] for r in rows}):
            text = "".join(r[2] + "\n" for r in rows if r[0] == region).encode()
            info = tarfile.TarInfo(f"Day{region}.svm")
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    return arrays.read_tar_lines(spark, put(spark, "days.tar.gz", out.getvalue()))


SQL["tar_lines"] = """select 'Day' || n_regionkey || '.svm' as member, row_number() over (partition by n_regionkey order by n_nationkey) as line_no,
  (n_regionkey % 2) || ' ' || (n_nationkey + 1) || ':0.5 ' || (n_nationkey + 30) || ':' || n_regionkey as raw from nation"""


@query
def npz_events(spark: SparkSession, folder: str) -> DataFrame:
    """Times by node from an array file: nations by region."""
    rows = _nation_lines(spark, folder)
    times = [[float(r[1]) for r in rows if r[0] == region] for region in sorted({r[0] for r in rows})]
    wide = np.full((len(times), max(map(len, times))), np.nan)
    for i, t in enumerate(times):
        wide[i, : len(t)] = t
    out = io.BytesIO()
    np.savez(out, times=wide)
    return arrays.read_npz_events(spark, put(spark, "times.npz", out.getvalue())).select("key", "node", "t")


SQL["npz_events"] = "select 'times' as key, n_regionkey::int as node, n_nationkey::double as t from nation"


@query
def file_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Size and SHA-256 of a text file."""
    text = "\n".join(r[2] for r in _nation_lines(spark, folder)).encode()
    return arrays.checksums(spark, put(spark, "nations.svm", text)).select("size", "sha256")


SQL["file_checksums"] = "with t as (select string_agg((n_regionkey % 2) || ' ' || (n_nationkey + 1) || ':0.5 ' || (n_nationkey + 30) || ':' || n_regionkey, chr(10) order by n_nationkey) as x from nation) select strlen(x)::bigint as size, sha256(x) as sha256 from t"


@query
def matrix_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A matrix written as a table and read again."""
    path = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    arrays.write_matrix(spark, H.ALPHA, path)
    return arrays.read_matrix(spark, path).select(F.col("i").cast("int").alias("i"), F.posexplode("values").alias("j", "value")).select("i", "j", r6("value").alias("value"))


SQL["matrix_round_trip"] = f"with {H._AL} select i, j, {s6('a')} as value from al"
