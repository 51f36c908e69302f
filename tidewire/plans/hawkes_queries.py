"""Point-process queries on the events table: users are realizations, event types nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.data import EVENT_TYPES, HOURS, EventData, test_events
from tidewire.functions import kernels as K
from tidewire.operators import bands, claw, cumulants, general, hawkes, learners, rkhs
from tidewire.operators.scan import decayed_sums
from tidewire.operators.weighted import weighted_sums
from tidewire.plans.shaping import array_table, finished, named_values, r6, rounded, s6, sql_values

D = len(EVENT_TYPES)
BETA, DECAYS = 0.5, [0.5, 2.0]
_I, _J = np.indices((D, D))
MU = 0.01 + 0.002 * np.arange(D)
ALPHA = 0.02 + 0.005 * ((_I + 2 * _J) % D)
ALPHA2 = np.stack([ALPHA / 2, ALPHA / 3], axis=2)
EDGES = [0.0, 2.0, 6.0, 24.0]
KERNEL = np.stack([ALPHA / 2, ALPHA / 4, ALPHA / 20], axis=2)
LAGS = [0.0, 1.0, 4.0, 12.0]
STEP, SIZE = 2.0, 4
H = 6.0
GAUSS_MEANS, GAUSS_STD = np.arange(3) * 4.0, 12 / (3 * np.pi)
ONE = hawkes.ExpParameters(MU, ALPHA, BETA)
SUM = hawkes.ExpParameters(MU, ALPHA2, DECAYS)
POWER = K.PowerLaw(0.05, 0.5, 1.3, 12.0)
CURVE = K.TimeFunction(([0.0, 1.0, 3.0, 6.0], [0.4, 0.2, 0.3, 0.0]))
STEPS, PERIOD = [0.1, 0.3, 0.2, 0.5], 24.0

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _one_node(folder_data: EventData) -> EventData:
    return EventData(folder_data.events.withColumn("node", F.lit(0)), folder_data.ends, 1)


_CASE = "case event_type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(EVENT_TYPES)) + " end"
_EV = f"ev as (select event_id as eid, user_id as r, {_CASE} as node, (epoch_us(ts) - 1704067200000000) / 3.6e9 as t, value as mark from events)"
_T = f"{HOURS!r}::double"
_MU = sql_values("mu", "i, m", [(i, float(MU[i])) for i in range(D)])
_AL = sql_values("al", "i, j, a", [(i, j, float(ALPHA[i, j])) for i in range(D) for j in range(D)])
_AL2 = sql_values("al2", "i, j, u, b, a", [(i, j, u, DECAYS[u], float(ALPHA2[i, j, u])) for i in range(D) for j in range(D) for u in range(2)])
_DE = sql_values("de", "u, b", [(u, DECAYS[u]) for u in range(2)])
_NO = sql_values("no", "v", [(v,) for v in range(D)])
_R = "rr as (select distinct user_id as r from events)"


@query
def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return test_events(spark, folder).events.groupBy("node").agg(F.count("*").alias("n"))


SQL["event_counts"] = f"with {_EV} select node, count(*) as n from ev group by node"


@query
def mean_intensity(spark: SparkSession, folder: str) -> DataFrame:
    return cumulants.rates(test_events(spark, folder)).groupBy("node").agg(r6(F.avg("rate")).alias("rate"))


SQL["mean_intensity"] = f"""with {_EV}, {_NO}, {_R}, c as (select r, node, count(*) as n from ev group by r, node)
select v as node, {s6(f"avg(coalesce(n, 0) / {_T})")} as rate from rr cross join no left join c on c.r = rr.r and c.node = v group by v"""


@query
def exp_features(spark: SparkSession, folder: str) -> DataFrame:
    f = hawkes.exp_features(test_events(spark, folder), [BETA])
    return f.select("eid", F.posexplode("phi").alias("v", "g")).select("eid", "v", r6("g").alias("g"))


_G = f"g as (select e.eid, e.r, e.node, e.t, v, coalesce(sum({BETA} * exp(-{BETA} * (e.t - p.t))), 0) as g from ev e cross join no left join ev p on p.r = e.r and p.node = v and p.t < e.t group by e.eid, e.r, e.node, e.t, v)"
SQL["exp_features"] = f"with {_EV}, {_NO}, {_G} select eid, v, {s6('g')} as g from g"


@query
def sumexp_features(spark: SparkSession, folder: str) -> DataFrame:
    f = hawkes.exp_features(test_events(spark, folder), DECAYS)
    return f.select("eid", F.posexplode("phi").alias("p", "g")).select("eid", F.floor(F.col("p") / 2).cast("int").alias("v"), (F.col("p") % 2).alias("u"), r6("g").alias("g"))


_G2 = "g2 as (select e.eid, e.r, e.node, e.t, v, u, coalesce(sum(b * exp(-b * (e.t - p.t))), 0) as g from ev e cross join no cross join de left join ev p on p.r = e.r and p.node = v and p.t < e.t group by e.eid, e.r, e.node, e.t, v, u)"
SQL["sumexp_features"] = f"with {_EV}, {_NO}, {_DE}, {_G2} select eid, v, u, {s6('g')} as g from g2"


@query
def exp_intensity_at_events(spark: SparkSession, folder: str) -> DataFrame:
    return hawkes.intensities(test_events(spark, folder), ONE).select("eid", "node", r6("intensity").alias("intensity"))


_LAM = f"lam as (select eid, r, node, t, m + sum(a * g) as lam from g join al on al.i = g.node and al.j = g.v join mu on mu.i = g.node group by eid, r, node, t, m)"
SQL["exp_intensity_at_events"] = f"with {_EV}, {_NO}, {_MU}, {_AL}, {_G}, {_LAM} select eid, node, {s6('lam')} as intensity from lam"


@query
def sumexp_intensity_at_events(spark: SparkSession, folder: str) -> DataFrame:
    return hawkes.intensities(test_events(spark, folder), SUM).select("eid", "node", r6("intensity").alias("intensity"))


_LAM2 = "lam2 as (select eid, r, node, t, m + sum(a * g) as lam from g2 join al2 on al2.i = g2.node and al2.j = g2.v and al2.u = g2.u join mu on mu.i = g2.node group by eid, r, node, t, m)"
SQL["sumexp_intensity_at_events"] = f"with {_EV}, {_NO}, {_DE}, {_MU}, {_AL2}, {_G2}, {_LAM2} select eid, node, {s6('lam')} as intensity from lam2"


@query
def powerlaw_convolution(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of a power-law kernel of finite support over the past, by source node."""
    c = bands.kernel_convolution(test_events(spark, folder), POWER.value, POWER.support)
    return c.select("eid", F.col("s_node").alias("v"), r6("value").alias("value"))


SQL["powerlaw_convolution"] = f"""with {_EV} select e.eid, p.node as v, {s6("sum(case when e.t - p.t < 12 then 0.05 * pow(0.5 + (e.t - p.t), -1.3) else 0 end)")} as value
from ev e join ev p on p.r = e.r and p.t < e.t and e.t - p.t <= 12 group by e.eid, p.node"""


@query
def timefunc_values(spark: SparkSession, folder: str) -> DataFrame:
    """A piecewise linear time function at the hours of the week-half of every event."""
    e = test_events(spark, folder).events
    return e.select("eid", r6(CURVE.column(F.pmod("t", F.lit(8.0)))).alias("value"))


SQL["timefunc_values"] = f"""with {_EV}, x as (select eid, t - 8 * floor(t / 8) as x from ev)
select eid, {s6("case when x < 1 then 0.4 - 0.2 * x when x < 3 then 0.2 + 0.05 * (x - 1) when x < 6 then 0.3 - 0.1 * (x - 3) else 0 end::double")} as value from x"""


@query
def piecewise_baseline_values(spark: SparkSession, folder: str) -> DataFrame:
    e = test_events(spark, folder).events
    return e.select("eid", K.piecewise_baseline(F.col("t"), STEPS, PERIOD).alias("value"))


SQL["piecewise_baseline_values"] = f"with {_EV} select eid, [0.1, 0.3, 0.2, 0.5][cast(least(floor((t - 24 * floor(t / 24)) / 24 * 4), 3) as int) + 1]::double as value from ev"


@query
def exp_compensator_at_events(spark: SparkSession, folder: str) -> DataFrame:
    return hawkes.compensators(test_events(spark, folder), ONE).select("eid", "node", r6("compensator").alias("compensator"))


_COMP = f"""h as (select e.eid, e.r, e.node, e.t, v, coalesce(sum(1 - exp(-{BETA} * (e.t - p.t))), 0) as h from ev e cross join no left join ev p on p.r = e.r and p.node = v and p.t < e.t group by e.eid, e.r, e.node, e.t, v),
comp as (select eid, r, node, t, m * t + sum(a * h) as c from h join al on al.i = h.node and al.j = h.v join mu on mu.i = h.node group by eid, r, node, t, m)"""
SQL["exp_compensator_at_events"] = f"with {_EV}, {_NO}, {_MU}, {_AL}, {_COMP} select eid, node, {s6('c')} as compensator from comp"


def _residuals(spark: SparkSession, folder: str) -> DataFrame:
    return hawkes.residuals(hawkes.compensators(test_events(spark, folder), ONE))


@query
def interarrival_residuals(spark: SparkSession, folder: str) -> DataFrame:
    return _residuals(spark, folder).select("eid", "node", r6("residual").alias("residual"))


_RES = "res as (select * from (select eid, r, node, t, c - lag(c) over (partition by r, node order by t, eid) as residual from comp) where residual is not null)"
_RESIDUALS = f"with {_EV}, {_NO}, {_MU}, {_AL}, {_COMP}, {_RES}"
SQL["interarrival_residuals"] = f"{_RESIDUALS} select eid, node, {s6('residual')} as residual from res"


@query
def qq_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(hawkes.qq_points(_residuals(spark, folder)), "residual", "expected")


SQL["qq_points"] = f"""{_RESIDUALS}, k as (select node, residual, row_number() over (partition by node order by residual) - 1 as k, count(*) over (partition by node) as n from res)
select node, k, {s6('residual')} as residual, {s6('-ln(1 - (k + 0.5) / n)')} as expected from k"""


@query
def residual_ks(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(hawkes.residual_summary(_residuals(spark, folder)), "mean", "variance", "ks", "lag1")


SQL["residual_ks"] = f"""{_RESIDUALS}, k as (select *, row_number() over (partition by node order by residual) as k, count(*) over (partition by node) as m, 1 - exp(-residual) as f,
  lag(residual) over (partition by r, node order by t, eid) as before from res)
select node, count(*) as n, {s6('avg(residual)')} as mean, {s6('var_samp(residual)')} as variance, {s6('max(greatest(abs(k / m - f), abs(f - (k - 1) / m)))')} as ks, {s6('corr(residual, before)')} as lag1 from k group by node"""


@query
def intensity_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Intensities of all nodes on a grid of 48 hours and at every event."""
    g = hawkes.intensity_grid(test_events(spark, folder), ONE, 48.0)
    return g.select("r", r6("t").alias("t"), "node", r6("intensity").alias("intensity"))


SQL["intensity_grid"] = f"""with {_EV}, {_NO}, {_MU}, {_AL}, {_R},
pt as (select distinct r, t from (select r, t from ev union all select r, (k * 48)::double from rr cross join range(0, 15) x(k))),
s as (select pt.r, pt.t, p.node as j, sum({BETA} * exp(-{BETA} * (pt.t - p.t))) as g from pt join ev p on p.r = pt.r and p.t < pt.t group by pt.r, pt.t, p.node)
select pt.r, {s6('pt.t')} as t, v as node, {s6('m + coalesce(sum(a * g), 0)')} as intensity
from pt cross join no join mu on mu.i = v left join s on s.r = pt.r and s.t = pt.t left join al on al.i = v and al.j = s.j group by pt.r, pt.t, v, m"""


@query
def exp_loglik_loss(spark: SparkSession, folder: str) -> DataFrame:
    data = test_events(spark, folder)
    loss = hawkes.LogLikelihood(data, BETA).loss(np.r_[MU, ALPHA.ravel()])
    return named_values(spark, n_jumps=data.n_jumps, loss=loss)


_SRC = f"src as (select node as j, sum(1 - exp(-{BETA} * ({_T} - t))) as s from ev group by node)"
_WHOLE = f"(select count(*) from rr) * {_T}"
SQL["exp_loglik_loss"] = f"""with {_EV}, {_NO}, {_MU}, {_AL}, {_R}, {_G}, {_LAM}, {_SRC}
select (select count(*) from ev) as n_jumps, {s6(f"(((select sum(m) from mu) - {D}) * {_WHOLE} + (select sum(a * s) from al join src using (j)) - (select sum(ln(lam)) from lam)) / (select count(*) from ev)")} as loss"""


@query
def exp_loglik_grad(spark: SparkSession, folder: str) -> DataFrame:
    g = hawkes.LogLikelihood(test_events(spark, folder), BETA).grad(np.r_[MU, ALPHA.ravel()])
    return array_table(spark, g[:D, None], "i j").withColumn("j", F.lit(-1)).unionByName(array_table(spark, g[D:].reshape(D, D), "i j"))


SQL["exp_loglik_grad"] = f"""with {_EV}, {_NO}, {_MU}, {_AL}, {_R}, {_G}, {_LAM}, {_SRC}, n as (select count(*) as n from ev),
q as (select lam.node as i, sum(1 / lam) as q from lam group by lam.node),
p as (select g.node as i, v as j, sum(g / lam) as p from g join lam using (eid) group by g.node, v)
select i, -1 as j, {s6(f'({_WHOLE} - q) / n')} as value from q, n
union all select i, p.j, {s6('(s - p) / n')} from p join src on src.j = p.j, n"""


@query
def sumexp_loglik_loss(spark: SparkSession, folder: str) -> DataFrame:
    data = test_events(spark, folder)
    return named_values(spark, loss=hawkes.LogLikelihood(data, DECAYS).loss(np.r_[MU, ALPHA2.ravel()]))


_SRC2 = f"src2 as (select node as j, u, sum(1 - exp(-b * ({_T} - t))) as s from ev cross join de group by node, u)"
SQL["sumexp_loglik_loss"] = f"""with {_EV}, {_NO}, {_DE}, {_MU}, {_AL2}, {_R}, {_G2}, {_LAM2}, {_SRC2}
select {s6(f"(((select sum(m) from mu) - {D}) * {_WHOLE} + (select sum(a * s) from al2 join src2 using (j, u)) - (select sum(ln(lam)) from lam2)) / (select count(*) from ev)")} as loss"""


@query
def ls_feature_integrals(spark: SparkSession, folder: str) -> DataFrame:
    return array_table(spark, hawkes.source_integrals(test_events(spark, folder), DECAYS), "v u")


SQL["ls_feature_integrals"] = f"with {_EV}, {_DE}, {_SRC2} select j as v, u, {s6('s')} as value from src2"


@query
def ls_feature_products(spark: SparkSession, folder: str) -> DataFrame:
    """Integrals of products of the features of two nodes and decays."""
    p = hawkes.least_squares_statistics(test_events(spark, folder), DECAYS).products
    return array_table(spark, p.reshape(D, 2, D, 2), "v u w x", decimals=4)


SQL["ls_feature_products"] = f"""with {_EV}, {_DE}
select p.node as v, d.u, q.node as w, f.u as x, (round(sum(d.b * f.b / (d.b + f.b) * exp(-d.b * (greatest(p.t, q.t) - p.t) - f.b * (greatest(p.t, q.t) - q.t)) * (1 - exp(-(d.b + f.b) * ({_T} - greatest(p.t, q.t))))), 4) + 0.0) as value
from ev p join ev q on p.r = q.r cross join de d cross join de f group by p.node, d.u, q.node, f.u"""


@query
def ls_event_sums(spark: SparkSession, folder: str) -> DataFrame:
    s = hawkes.least_squares_statistics(test_events(spark, folder), DECAYS).event_sums
    return array_table(spark, s.reshape(D, D, 2), "i v u", decimals=4)


SQL["ls_event_sums"] = f"with {_EV}, {_NO}, {_DE}, {_G2} select node as i, v, u, (round(sum(g), 4) + 0.0) as value from g2 group by node, v, u"


@query
def exp_ls_loss(spark: SparkSession, folder: str) -> DataFrame:
    return named_values(spark, loss=hawkes.LeastSquares(test_events(spark, folder), BETA).loss(np.r_[MU, ALPHA.ravel()]))


SQL["exp_ls_loss"] = f"""with {_EV}, {_NO}, {_MU}, {_AL}, {_R}, {_G}, {_LAM}, {_SRC},
pr as (select p.node as j, q.node as k, sum({BETA / 2} * exp(-{BETA} * abs(p.t - q.t)) * (1 - exp(-{2 * BETA} * ({_T} - greatest(p.t, q.t))))) as v from ev p join ev q on p.r = q.r group by p.node, q.node)
select {s6(f"((select sum(m * m) from mu) * {_WHOLE} + 2 * (select sum(m * a * s) from al join mu using (i) join src using (j)) + (select sum(x.a * y.a * v) from al x join al y on x.i = y.i join pr on pr.j = x.j and pr.k = y.j) - 2 * (select sum(lam) from lam)) / (select count(*) from ev)")} as loss"""


@query
def em_bin_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier events by node and lag bin; ties count in the first bin."""
    c = bands.bin_counts(test_events(spark, folder), EDGES)
    m = len(EDGES) - 1
    e = c.select("eid", F.posexplode("phi").alias("p", "n")).where("n > 0")
    return e.select("eid", F.floor(F.col("p") / m).cast("int").alias("v"), (F.col("p") % m).alias("m"), F.col("n").cast("bigint").alias("n"))


_BIN = "case when l <= 2 then 0 when l <= 6 then 1 else 2 end"
_NK = f"nk as (select eid, r, node, t, v, {_BIN} as m, count(*) as n from (select e.eid, e.r, e.node, e.t, p.node as v, e.t - p.t as l from ev e join ev p on p.r = e.r and p.t <= e.t and p.eid <> e.eid and e.t - p.t < 24) group by all)"
SQL["em_bin_counts"] = f"with {_EV}, {_NK} select eid, v, m, n from nk"


def _em(spark: SparkSession, folder: str, steps: int) -> DataFrame:
    em = learners.Expectation(EDGES)
    em.prepare(test_events(spark, folder))
    mu, kernel = MU, KERNEL
    for _ in range(steps):
        mu, kernel = em.step(mu, kernel)
    base = array_table(spark, mu[:, None, None], "u v m").withColumns({"v": F.lit(-1), "m": F.lit(-1)})
    return base.unionByName(array_table(spark, kernel, "u v m"))


@query
def em_step_1(spark: SparkSession, folder: str) -> DataFrame:
    return _em(spark, folder, 1)


@query
def em_step_2(spark: SparkSession, folder: str) -> DataFrame:
    return _em(spark, folder, 2)


_KE = sql_values("k0", "u, v, m, k", [(u, v, m, float(KERNEL[u, v, m])) for u in range(D) for v in range(D) for m in range(3)])
_M0 = sql_values("m0", "u, m", [(i, float(MU[i])) for i in range(D)])


def _em_sql(i: int) -> str:
    return f"""l{i} as (select ev.eid, ev.node as u, any_value(mm.m) as mu, any_value(mm.m) + coalesce(sum(n * k), 0) as lam from ev join m{i} mm on mm.u = ev.node left join nk on nk.eid = ev.eid left join k{i} kk on kk.u = ev.node and kk.v = nk.v and kk.m = nk.m group by ev.eid, ev.node),
m{i + 1} as (select u, sum(mu / lam) / ({_WHOLE}) as m from l{i} group by u),
k{i + 1} as (select kk.u, kk.v, kk.m, coalesce(any_value(s.s), 0) / (any_value(c.n) * any_value(case kk.m when 0 then 2.0 when 1 then 4.0 else 18.0 end)) as k from k{i} kk join (select node, count(*) as n from ev group by node) c on c.node = kk.v
  left join (select l.u, nk.v, nk.m, sum(nk.n * kk.k / l.lam) as s from nk join l{i} l using (eid) join k{i} kk on kk.u = l.u and kk.v = nk.v and kk.m = nk.m group by l.u, nk.v, nk.m) s on s.u = kk.u and s.v = kk.v and s.m = kk.m group by kk.u, kk.v, kk.m)"""


SQL["em_step_1"] = f"with {_EV}, {_R}, {_NK}, {_KE}, {_M0}, {_em_sql(0)} select u, -1 as v, -1 as m, {s6('m')} as value from m1 union all select u, v, m, {s6('k')} from k1"
SQL["em_step_2"] = f"with {_EV}, {_R}, {_NK}, {_KE}, {_M0}, {_em_sql(0)}, {_em_sql(1)} select u, -1 as v, -1 as m, {s6('m')} as value from m2 union all select u, v, m, {s6('k')} from k2"


@query
def piecewise_score(spark: SparkSession, folder: str) -> DataFrame:
    return named_values(spark, score=learners.piecewise_score(test_events(spark, folder), EDGES, MU, KERNEL))


SQL["piecewise_score"] = f"""with {_EV}, {_R}, {_KE}, {_M0},
ns as (select eid, node, v, {_BIN} as m, count(*) as n from (select e.eid, e.node, p.node as v, e.t - p.t as l from ev e join ev p on p.r = e.r and p.t < e.t and e.t - p.t < 24) group by all),
l as (select ev.eid, any_value(m0.m) + coalesce(sum(n * k), 0) as lam from ev join m0 on m0.u = ev.node left join ns on ns.eid = ev.eid left join k0 on k0.u = ev.node and k0.v = ns.v and k0.m = ns.m group by ev.eid),
x as (select node as v, m, sum(greatest(0, least({_T} - t, hi) - lo)) as x from ev cross join (values (0, 0.0, 2.0), (1, 2.0, 6.0), (2, 6.0, 24.0)) b(m, lo, hi) group by node, m)
select {s6(f"(({D} - (select sum(m) from m0)) * {_WHOLE} - (select sum(k * x) from k0 join x on x.v = k0.v and x.m = k0.m) + (select sum(ln(lam)) from l)) / (select count(*) from ev)")} as score"""


@query
def lowrank_estep(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the pulls of every source node on every target node under given kernels."""
    f = hawkes.exp_features(test_events(spark, folder), [BETA])
    s = weighted_sums(f, MU, ALPHA)
    return array_table(spark, ALPHA * s.over, "u v")


SQL["lowrank_estep"] = f"with {_EV}, {_NO}, {_MU}, {_AL}, {_G}, {_LAM} select g.node as u, v, {s6('sum(a * g / lam)')} as value from g join lam using (eid) join al on al.i = g.node and al.j = v group by g.node, v"


@query
def lowrank_update(spark: SparkSession, folder: str) -> DataFrame:
    """One EM step inside the alternating direction method, from no pull."""
    fit = learners.SparseLowRank(BETA)
    fit.prepare(test_events(spark, folder))
    mu, a = fit.update(MU, ALPHA, np.full((D, D), 0.01))
    return array_table(spark, mu[:, None], "u v").withColumn("v", F.lit(-1)).unionByName(array_table(spark, a, "u v"))


SQL["lowrank_update"] = f"""with {_EV}, {_NO}, {_MU}, {_AL}, {_R}, {_G}, {_LAM}, {_SRC},
c as (select g.node as u, v, sum(a * g / lam) as c from g join lam using (eid) join al on al.i = g.node and al.j = v group by g.node, v)
select node as u, -1 as v, {s6(f'sum(m / lam) / ({_WHOLE})')} as value from lam join mu on mu.i = node group by node
union all select u, v, {s6('(-(s + 0.1 * 0.01) + sqrt((s + 0.1 * 0.01) * (s + 0.1 * 0.01) + 8 * 0.1 * c)) / 0.4')} from c join src on src.j = v"""


@query
def gaussian_features(spark: SparkSession, folder: str) -> DataFrame:
    f = bands.gaussian_features(test_events(spark, folder), GAUSS_MEANS, GAUSS_STD)
    e = f.select("eid", F.posexplode("phi").alias("p", "g"))
    return e.select("eid", F.floor(F.col("p") / 3).cast("int").alias("v"), (F.col("p") % 3).alias("m"), r6("g").alias("g")).where("g <> 0")


_GS = f"{float(GAUSS_STD)!r}::double"
SQL["gaussian_features"] = f"""with {_EV}, x as (select e.eid, p.node as v, m, {s6(f"sum(exp(-0.5 * pow((e.t - p.t - 4.0 * m) / {_GS}, 2)) / ({_GS} * sqrt(2 * pi())))")} as g
from ev e join ev p on p.r = e.r and p.t < e.t and e.t - p.t < 60 cross join range(0, 3) z(m) group by e.eid, p.node, m) select eid, v, m::int as m, g from x where g <> 0"""


@query
def basis_counts(spark: SparkSession, folder: str) -> DataFrame:
    c = bands.step_counts(test_events(spark, folder), STEP, SIZE)
    e = c.select("eid", F.posexplode("phi").alias("p", "n")).where("n > 0")
    return e.select("eid", F.floor(F.col("p") / SIZE).cast("int").alias("v"), (F.col("p") % SIZE).alias("m"), F.col("n").cast("bigint").alias("n"))


SQL["basis_counts"] = f"with {_EV} select e.eid, p.node as v, floor((e.t - p.t) / 2)::int as m, count(*) as n from ev e join ev p on p.r = e.r and p.t <= e.t and p.eid <> e.eid and floor((e.t - p.t) / 2) < {SIZE} group by all"


@query
def basis_exposure(spark: SparkSession, folder: str) -> DataFrame:
    """How long each step of a kernel's support could act, by source node."""
    return array_table(spark, learners.bin_exposure(test_events(spark, folder), np.arange(SIZE + 1) * STEP), "v m", decimals=4)


SQL["basis_exposure"] = f"with {_EV} select node as v, m::int as m, (round(sum(greatest(0, least({_T} - t, 2.0 * m + 2) - 2.0 * m)), 4) + 0.0) as value from ev cross join range(0, {SIZE}) z(m) group by node, m"


@query
def claw_counts(spark: SparkSession, folder: str) -> DataFrame:
    c = claw.law_counts(test_events(spark, folder), LAGS)
    return c.groupBy("i", "j", "k").agg(F.sum("n").alias("n"), F.sum("n_terms").alias("n_terms"))


_CL = f"""sp as (select r, node as i, min(t) as a, max(t) as z, arg_min(eid, (t, eid)) as ea, arg_max(eid, (t, eid)) as ez from ev group by r, node),
zz as (select r, node as j, t, eid from ev where t + 12 < {_T}),
te as (select zz.r, i, j, count(*) filter (zz.t <= z) + max((zz.t > z)::int) as n_terms from zz join sp using (r) group by zz.r, i, j),
hi as (select y.r, y.node as i, zz.j, case when y.t - zz.t <= 1 then 0 when y.t - zz.t <= 4 then 1 else 2 end as k, count(*) as n
  from ev y join zz on zz.r = y.r and y.t > zz.t and y.t - zz.t <= 12 join sp on sp.r = y.r and sp.i = y.node where y.eid <> ea and y.eid <> ez group by all),
cl as (select te.r, te.i, te.j, kk.k, coalesce(n, 0) as n, n_terms from te cross join (values (0), (1), (2)) kk(k) left join hi on hi.r = te.r and hi.i = te.i and hi.j = te.j and hi.k = kk.k)"""
SQL["claw_counts"] = f"with {_EV}, {_CL} select i, j, k, sum(n)::bigint as n, sum(n_terms)::bigint as n_terms from cl group by i, j, k"


@query
def claws(spark: SparkSession, folder: str) -> DataFrame:
    """Conditional laws: the rate of i after events of j above its mean, by lag."""
    return claw.claws(test_events(spark, folder), LAGS).select("i", "j", "k", r6("value").alias("value"))


SQL["claws"] = f"""with {_EV}, {_NO}, {_R}, {_CL}, ra as (select rr.r, v as i, count(ev.eid) / {_T} as rate from rr cross join no left join ev on ev.r = rr.r and ev.node = v group by rr.r, v)
select ra.i, n2.v as j, kk.k, {s6("avg(coalesce(cl.n / greatest(n_terms, 1), 0) / w - rate)")} as value
from ra cross join no n2 cross join (values (0, 1.0), (1, 3.0), (2, 8.0)) kk(k, w) left join cl on cl.r = ra.r and cl.i = ra.i and cl.j = n2.v and cl.k = kk.k group by ra.i, n2.v, kk.k"""


@query
def mark_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of events by interval of their value, cuts at 10 and 40 for every type."""
    s = claw.mark_statistics(test_events(spark, folder), {i: [10.0, 40.0] for i in range(D)})
    return rounded(s, "share", "least", "most")


SQL["mark_probabilities"] = f"""with {_EV}, s as (select node, case when mark < 10 then 0 when mark < 40 then 1 else 2 end as k from ev where mark is not null),
e as (select node, min(mark) as least, max(mark) as most, count(mark) as c from ev group by node)
select e.node, z.k as interval, count(s.k) as n, {s6("count(s.k) / any_value(c)")} as share, {s6("any_value(least)")} as least, {s6("any_value(most)")} as most
from e cross join (values (0), (1), (2)) z(k) left join s on s.node = e.node and s.k = z.k group by e.node, z.k"""


def _cumulants(spark: SparkSession, folder: str) -> cumulants.Cumulants:
    return cumulants.Cumulants(test_events(spark, folder), H)


@query
def cumulant_covariance(spark: SparkSession, folder: str) -> DataFrame:
    data = test_events(spark, folder)
    c = cumulants._symmetric(cumulants.covariance_terms(data, H)).groupBy("i", "j").agg(F.sum("c").alias("c"))
    return c.select("i", "j", r6(F.col("c") / data.n_realizations).alias("c"))


_CU = f"""ra as (select rr.r, v as j, count(ev.eid) / {_T} as rate, max(ev.t) as last from rr cross join no left join ev on ev.r = rr.r and ev.node = v group by rr.r, v),
cu as (select r, i, j, (sum(near) - sum(rate * 12)) / {_T} as c, (sum(weight) - sum(rate * 144)) / {_T} as k from (
  select e.r, e.node as i, ra.j, e.eid, ra.rate, count(p.eid) filter (abs(p.t - e.t) < 6) as near, coalesce(sum(12 - abs(p.t - e.t)), 0) as weight
  from ev e join ra on ra.r = e.r and ra.last >= e.t + 12 left join ev p on p.r = e.r and p.node = ra.j and abs(p.t - e.t) < 12 where e.t >= 6 group by e.r, e.node, ra.j, e.eid, ra.rate) group by r, i, j),
sy as (select r, i, j, sum(c) as c, sum(k) as k from (select r, i, j, c / 2 as c, k / 2 as k from cu union all select r, j, i, c / 2, k / 2 from cu) group by r, i, j)"""
SQL["cumulant_covariance"] = f"with {_EV}, {_NO}, {_R}, {_CU} select i, j, {s6('sum(c) / (select count(*) from rr)')} as c from sy group by i, j"


@query
def cumulant_skewness(spark: SparkSession, folder: str) -> DataFrame:
    return array_table(spark, _cumulants(spark, folder).skewness, "i j")


SQL["cumulant_skewness"] = f"""with {_EV}, {_NO}, {_R}, {_CU},
nn as (select e.r, e.eid, e.t, e.node as k, ra.j as v, ra.last, count(p.eid) - ra.rate * 12 as d from ev e join ra on ra.r = e.r left join ev p on p.r = e.r and p.node = ra.j and abs(p.t - e.t) < 6 where e.t >= 6 group by e.r, e.eid, e.t, e.node, ra.j, ra.last, ra.rate),
ee as (select a.r, a.v as i, b.v as j, a.k, sum(a.d * b.d - coalesce(sy.k, 0)) / {_T} as e from nn a join nn b on a.eid = b.eid and a.r = b.r left join sy on sy.r = a.r and sy.i = a.v and sy.j = b.v
  where a.last >= a.t + 6 and b.last >= b.t + 6 group by a.r, a.v, b.v, a.k),
tt as (select i, j, k, sum(e) / (select count(*) from rr) as e from ee group by i, j, k),
ij as (select a.v as i, b.v as j from no a cross join no b)
select ij.i, ij.j, {s6('(2 * coalesce(x.e, 0) + coalesce(y.e, 0)) / 3')} as value from ij left join tt x on x.i = ij.i and x.j = ij.j and x.k = ij.j left join tt y on y.i = ij.j and y.j = ij.j and y.k = ij.i"""


@query
def autocorr_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a user's events by lag, in bins of four hours up to 24."""
    return rkhs.lag_histogram(_one_node(test_events(spark, folder)), np.arange(7) * 4.0).select("k", "n")


SQL["autocorr_histogram"] = f"with {_EV} select least(floor((a.t - b.t) / 4), 5)::int as k, count(*) as n from ev a join ev b on a.r = b.r and (b.t < a.t or (b.t = a.t and b.eid < a.eid)) and a.t - b.t <= 24 group by 1"


@query
def lag_exposure(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rkhs.lag_exposure(_one_node(test_events(spark, folder)), np.arange(7) * 4.0), "exposure")


SQL["lag_exposure"] = f"with {_EV} select k::int as k, {s6(f'sum(greatest(0, least({_T} - t - 4 * k, 4)))')} as exposure from ev cross join range(0, 6) z(k) group by k"


@query
def process_interval(spark: SparkSession, folder: str) -> DataFrame:
    """The first three events of every realization and node between hours 100 and 400."""
    e = test_events(spark, folder).events.where("t between 100 and 400")
    w = Window.partitionBy("r", "node").orderBy("t", "eid")
    return e.withColumn("k", F.row_number().over(w)).where("k <= 3").select("eid", "r", "node", r6("t").alias("t"), "k")


SQL["process_interval"] = f"with {_EV}, w as (select *, row_number() over (partition by r, node order by t, eid) as k from ev where t between 100 and 400) select eid, r, node, {s6('t')} as t, k from w where k <= 3"


@query
def node_order(spark: SparkSession, folder: str) -> DataFrame:
    """Past events of all nodes at every event, ties left out: the count channel of the scan."""
    data = test_events(spark, folder)
    f = decayed_sums(data.events, D, [0.0])
    return f.select("eid", F.aggregate("phi", F.lit(0.0), lambda s, x: s + x).cast("bigint").alias("past"))


SQL["node_order"] = f"with {_EV} select e.eid, count(p.eid) as past from ev e left join ev p on p.r = e.r and p.t < e.t group by e.eid"


MIXED = [[POWER if (i + j) % 3 == 0 else K.Exponential(float(ALPHA[i, j]), BETA) if (i + j) % 3 == 1 else K.Zero() for j in range(D)] for i in range(D)]


@query
def mixed_kernel_intensity(spark: SparkSession, folder: str) -> DataFrame:
    """Intensities under a matrix of power-law, exponential and zero kernels with periodic baselines."""
    base = lambda t: K.piecewise_baseline(t, STEPS, PERIOD)
    return general.kernel_intensities(test_events(spark, folder), MIXED, base).select("eid", r6("intensity").alias("intensity"))


SQL["mixed_kernel_intensity"] = f"""with {_EV}, {_AL}, b as (select eid, r, node, t, [0.1, 0.3, 0.2, 0.5][cast(least(floor((t - 24 * floor(t / 24)) / 24 * 4), 3) as int) + 1]::double as b from ev)
select b.eid, {s6(f"b + coalesce(sum(case when (b.node + p.node) % 3 = 0 and b.t - p.t < 12 then 0.05 * pow(0.5 + (b.t - p.t), -1.3) when (b.node + p.node) % 3 = 1 then a * {BETA} * exp(-{BETA} * (b.t - p.t)) else 0 end), 0)")} as intensity
from b left join ev p on p.r = b.r and p.t < b.t left join al on al.i = b.node and al.j = p.node group by b.eid, b.b"""


# Fits: iterative. Their SQL states what holds at the parameters returned: that one further
# step moves none by more than a bound, or that slopes vanish where they should.

#: A bound that the fits are not meant to reach: they end by their stop rules.
ROUNDS = 5000


def _steady(spark: SparkSession, value, further, names: str, far: float) -> DataFrame:
    """The parameters' indices, whether each is at least 0, and whether a further step moves it
    by no more than far."""
    value, further = np.asarray(value, float), np.asarray(further, float)
    rest = np.abs(further - value) <= far
    rows = [(*(int(i) for i in at), bool(value[at] >= 0), bool(rest[at])) for at in np.ndindex(value.shape)]
    return spark.createDataFrame(rows, ", ".join([*(f"{n} int" for n in names.split()), "positive boolean", "steady boolean"]))


def _steady_sql(names: str, *sizes: int) -> str:
    parts = ", ".join(f"range(0, {n}) z{k}({name})" for k, (name, n) in enumerate(zip(names.split(), sizes, strict=True)))
    return f"select {', '.join(f'{n}::int as {n}' for n in names.split())}, true as positive, true as steady from {parts}"


def expectation(spark: SparkSession, folder: str):
    return finished(learners.Expectation(EDGES, max_iter=ROUNDS).fit(test_events(spark, folder), MU, KERNEL))


@query
def fit_expectation(spark: SparkSession, folder: str) -> DataFrame:
    """The kernels of the fit are what one further step makes of them."""
    em = expectation(spark, folder)
    return _steady(spark, em.kernel, em.step(em.mu, em.kernel)[1], "u v m", 2e-5)


SQL["fit_expectation"] = _steady_sql("u v m", D, D, 3)


def sparse_low_rank(spark: SparkSession, folder: str):
    return finished(learners.SparseLowRank(BETA, max_iter=ROUNDS).fit(test_events(spark, folder), MU, ALPHA))


@query
def fit_sparse_low_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the stop rule is met, norms are at least 0 and some exactly 0, and likelihoods are
    better than without any pull."""
    fit = sparse_low_rank(spark, folder)
    other = hawkes.LogLikelihood(fit.data, BETA)
    alone = np.array(fit.data.node_counts) / fit.data.total_time
    better = fit.score() > -other.loss(np.r_[alone, np.zeros(D * D)])
    return named_values(spark, done=int(fit.history[-1]["rel"] <= fit.tol), positive=int((fit.adjacency >= 0).all()), better=int(better))


SQL["fit_sparse_low_rank"] = "select 1::bigint as done, 1::bigint as positive, 1::bigint as better"


def gaussians(spark: SparkSession, folder: str):
    return finished(learners.GaussianMixture(12.0, 3, step_size=1e-3, max_iter=ROUNDS).fit(test_events(spark, folder), MU, np.full((D, D, 3), 0.05)))


@query
def fit_gaussians(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the stop rule ended the fit with finite amplitudes and a likelihood above that of
    its start. The rule ends it where changes fall off, which is not yet a fixed point."""
    fit = gaussians(spark, folder)
    n, start = D, np.full((D, D, 3), 0.05)

    def likelihood(mu, a) -> float:
        s = weighted_sums(fit.features, mu, a.reshape(n, -1))
        return s.logs - np.sum(mu) * fit.data.total_time - np.einsum("uvm,vm->", a, fit.integrals)

    better = likelihood(fit.mu, fit.amplitudes) > likelihood(MU, start)
    return named_values(spark, done=int(fit.converged), finite=int(np.isfinite(fit.amplitudes).all()), better=int(better))


SQL["fit_gaussians"] = "select 1::bigint as done, 1::bigint as finite, 1::bigint as better"


def shared_basis(spark: SparkSession, folder: str):
    g = np.stack([np.exp(-0.5 * np.arange(SIZE)), np.full(SIZE, 0.3)])
    return finished(learners.SharedBasis(STEP * SIZE, SIZE, max_iter=ROUNDS).fit(test_events(spark, folder), MU, np.full((D, D, 2), 0.1), g))


@query
def fit_shared_basis(spark: SparkSession, folder: str) -> DataFrame:
    """The basis functions of the fit are what a further iteration makes of them."""
    fit = shared_basis(spark, folder)
    return _steady(spark, fit.basis, fit.iterate(fit.mu, fit.amplitudes, fit.basis)[2], "d m", 1e-3)


SQL["fit_shared_basis"] = _steady_sql("d m", 2, SIZE)


def _slopes(spark: SparkSession, fit, penalty: float) -> DataFrame:
    """Whether slopes vanish where coefficients are positive, and don't fall where they are 0."""
    c = fit.coeffs
    g = fit.model(fit.data).grad(c) + penalty * c
    fine = np.where(c > 0, np.abs(g) < 1e-5, g > -1e-5) & (c >= 0)
    return spark.createDataFrame([(k, bool(x)) for k, x in enumerate(fine)], "k int, optimal boolean")


@query
def fit_least_squares(spark: SparkSession, folder: str) -> DataFrame:
    """Optimality of the penalised least-squares fit, coefficient by coefficient."""
    return _slopes(spark, learners.Parametric(BETA, max_iter=2000).fit(test_events(spark, folder)), 1e-3)


SQL["fit_least_squares"] = f"select k::int as k, true as optimal from range(0, {D + D * D}) z(k)"


@query
def fit_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Optimality of the penalised likelihood fit, coefficient by coefficient."""
    return _slopes(spark, learners.Parametric(BETA, loss="likelihood", max_iter=500, tol=1e-6).fit(test_events(spark, folder), np.r_[MU, ALPHA.ravel()]), 1e-3)


SQL["fit_likelihood"] = SQL["fit_least_squares"]


@query
def fit_periodic_least_squares(spark: SparkSession, folder: str) -> DataFrame:
    """Optimality of the fit with a periodic baseline."""
    return _slopes(spark, learners.Parametric(DECAYS, n_baselines=4, period=PERIOD, max_iter=4000).fit(test_events(spark, folder)), 1e-3)


SQL["fit_periodic_least_squares"] = f"select k::int as k, true as optimal from range(0, {4 * D + 2 * D * D}) z(k)"


def conditional_law(spark: SparkSession, folder: str):
    return claw.ConditionalLaw(delta_lag=1.0, max_lag=24.0, n_quad=10, max_support=24.0).fit(test_events(spark, folder))


@query
def fit_conditional_law(spark: SparkSession, folder: str) -> DataFrame:
    """Mean intensities, and whether baselines and norms give them back and the integral
    equations hold at the quadrature nodes."""
    fit = conditional_law(spark, folder)
    x, w = fit._nodes()
    keys = [(j, 0) for j in range(D)]
    system = np.eye(D * len(x)) + np.block([[fit._gauss_block(x, w, a, b) for b in keys] for a in keys])
    solved = [np.allclose(system @ fit.kernels[i].ravel(), np.concatenate([fit.law((i, *a), x) for a in keys]), atol=1e-9) for i in range(D)]
    back = np.linalg.solve(np.eye(D) - fit.norms, fit.baseline)
    return spark.createDataFrame([(i, round(float(fit.mean[i]), 6), bool(abs(back[i] - fit.mean[i]) < 1e-9), bool(solved[i])) for i in range(D)], "i int, mean double, balanced boolean, solved boolean")


SQL["fit_conditional_law"] = f"with {_EV}, {_R} select node as i, {s6(f'count(*) / ({_WHOLE})')} as mean, true as balanced, true as solved from ev group by node"


@query
def fit_cumulants(spark: SparkSession, folder: str) -> DataFrame:
    """Mean intensities, and whether the matching ends at a point without slope below its start."""
    fit = cumulants.CumulantMatching(H, max_iter=5000).fit(cumulants=_cumulants(spark, folder))
    value, grad = fit.loss_and_grad(fit.solution.ravel())
    begin, steep = fit.loss_and_grad(fit.start().ravel())
    flat = bool(np.abs(grad).max() <= 1e-3 * max(np.abs(steep).max(), 1e-12))
    return spark.createDataFrame([(i, round(float(m), 6), bool(value <= begin), flat) for i, m in enumerate(fit.c.mean)], "node int, rate double, lower boolean, flat boolean")


SQL["fit_cumulants"] = f"select node, rate, true as lower, true as flat from ({SQL['mean_intensity']})"


@query
def fit_kernel_space(spark: SparkSession, folder: str) -> DataFrame:
    """The autocorrelation that the kernel is inverted from, and whether branching ratio and
    baseline give the mean intensity back."""
    fit = rkhs.KernelSpace(24.0, 2.0).fit(_one_node(test_events(spark, folder)))
    back = bool(abs(fit.baseline - fit.mean * max(1 - fit.branching, 0)) < 1e-12 and (fit.values >= 0).all())
    return spark.createDataFrame([(float(x), round(float(v), 6) + 0.0, back) for x, v in zip(fit.lags, fit.autocorrelation, strict=True)], "lag double, autocorrelation double, balanced boolean")


SQL["fit_kernel_space"] = f"""with {_EV}, {_R}, k as (select k from range(0, 12) z(k)),
n as (select least(floor((a.t - b.t) / 2), 11)::int as k, count(*) as n from ev a join ev b on a.r = b.r and (b.t < a.t or (b.t = a.t and b.eid < a.eid)) and a.t - b.t <= 24 group by 1),
x as (select k, sum(greatest(0, least({_T} - t - 2 * k, 2))) as x from ev cross join k group by k)
select k * 2 + 1.0::double as lag, {s6(f'coalesce(n, 0) / x - (select count(*) from ev) / ({_WHOLE})')} as autocorrelation, true as balanced from x left join n using (k)"""


@query
def simulated_events(spark: SparkSession, folder: str) -> DataFrame:
    """As many realizations as there are users: whether each node has its stationary number of
    events, within six standard deviations, and none lies outside the time or twice."""
    from tidewire.operators import simulate

    n = test_events(spark, folder).n_realizations
    kernels = simulate.exponential_kernels(ALPHA, BETA)
    d = simulate.hawkes(spark, kernels, list(MU), n=n, end_time=HOURS)
    expected = K.stationary_intensity(ALPHA, MU) * n * HOURS
    r = np.linalg.inv(np.eye(D) - ALPHA)
    spread = np.sqrt(np.diag(r @ np.diag(K.stationary_intensity(ALPHA, MU)) @ r.T) * n * HOURS)
    found = np.array(d.node_counts)
    # Realizations start without a past: what the first events miss is below two lifetimes of a kernel's pull.
    missing = 4 / BETA * n * K.stationary_intensity(ALPHA, MU)
    wrong = sum(d.violations().values()) + d.n_jumps - d.events.select("r", "t").distinct().count()
    return spark.createDataFrame([(i, bool(-6 * spread[i] - missing[i] <= found[i] - expected[i] <= 6 * spread[i]), int(wrong)) for i in range(D)], "node int, within boolean, wrong bigint")


SQL["simulated_events"] = f"select node::int as node, true as within, 0::bigint as wrong from range(0, {D}) z(node)"
