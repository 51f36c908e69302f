"""Regression, survival, case-series, preprocessing and metric queries on the star tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import losses, prox
from tidewire.operators import binarizer, glm, longitudinal, metrics, quantiles, solvers, survival
from tidewire.plans.shaping import array_table, finished, named_values, r6, rounded, s6, sql_values
from tidewire.session import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- generalised linear models: rows of lineitem ----

#: No line of the tables lies on a kink of a loss.
W = [0.5, -0.3, 0.8, 0.20317]


def _lines(spark: SparkSession, folder: str, label: Column) -> DataFrame:
    x = table(spark, folder, "lineitem")
    return x.select(label.cast("double").alias("label"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("features"))


def _price() -> Column:
    return F.col("l_extendedprice") / 50000


def _returned() -> Column:
    return F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)


def _count() -> Column:
    return F.col("l_linenumber") - 1


_Z = "(0.20317 + 0.5 * (l_quantity / 50) - 0.3 * (l_discount * 10) + 0.8 * (l_tax * 10))::double"
_SIGN = "case when l_returnflag = 'R' then 1.0 else -1.0 end::double"
_FACT = "coalesce(list_sum(list_transform(range(1, greatest(y, 1)::bigint + 1), lambda i: ln(i))), 0)"
# Name: loss, labels of Spark, labels of SQL, loss and slope in SQL over z and y.
_MODELS = {
    "linreg": (losses.Squared(), _price, "l_extendedprice / 50000", "(z - y) * (z - y) / 2", "z - y"),
    "logreg": (losses.Logistic(), _returned, "case when l_returnflag = 'R' then 1.0 else 0.0 end::double", "ln(1 + exp(-abs(z))) + greatest(z, 0) - y * z", "1 / (1 + exp(-z)) - y"),
    "poisreg": (losses.Poisson(), _count, "l_linenumber - 1", f"exp(z) - y * z + {_FACT}", "exp(z) - y"),
    "poisreg_identity": (losses.Poisson("identity"), _count, "l_linenumber - 1", f"greatest(z, 1e-12) - y * ln(greatest(z, 1e-12)) + {_FACT}", "1 - y / greatest(z, 1e-12)"),
    "hinge": (losses.Hinge(), _returned, _SIGN, "greatest(0, 1 - y * z)", "case when y * z < 1 then -y else 0 end"),
    "quadratic_hinge": (losses.SquaredHinge(), _returned, _SIGN, "pow(greatest(0, 1 - y * z), 2) / 2", "-y * greatest(0, 1 - y * z)"),
    "smoothed_hinge": (losses.SmoothedHinge(0.5), _returned, _SIGN, "case when y * z >= 1 then 0 when 1 - y * z >= 0.5 then 1 - y * z - 0.25 else pow(1 - y * z, 2) end", "case when y * z >= 1 then 0 when 1 - y * z >= 0.5 then -y else -y * (1 - y * z) / 0.5 end"),
    "huber": (losses.Huber(0.4), _price, "l_extendedprice / 50000", "case when abs(z - y) <= 0.4 then pow(z - y, 2) / 2 else 0.4 * (abs(z - y) - 0.2) end", "greatest(least(z - y, 0.4), -0.4)"),
    "absolute": (losses.Absolute(), _price, "l_extendedprice / 50000", "abs(z - y)", "sign(z - y)"),
    "eps_insensitive": (losses.EpsilonInsensitive(0.3), _price, "l_extendedprice / 50000", "greatest(abs(z - y) - 0.3, 0)", "case when abs(z - y) > 0.3 then sign(z - y) else 0 end"),
    "modified_huber": (losses.ModifiedHuber(), _returned, _SIGN, "case when y * z >= 1 then 0 when y * z >= -1 then pow(1 - y * z, 2) else -4 * y * z end", "case when y * z >= 1 then 0 when y * z >= -1 then -2 * y * (1 - y * z) else -4 * y end"),
}


def _model(name: str):
    loss, label, sql_label, value, slope = _MODELS[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        v, g = glm.Glm(_lines(spark, folder, label()), loss).loss_and_grad(W)
        return array_table(spark, np.r_[v, g], "k")

    run.__doc__ = f"Mean {name} loss (k = 0) and its gradient at fixed coefficients."
    QUERIES[f"{name}_loss_grad"] = run
    base = f"with x as (select {_Z} as z, ({sql_label})::double as y, l_quantity / 50 as a, l_discount * 10 as b, l_tax * 10 as c from lineitem), s as (select *, {slope} as s, {value} as v from x)"
    SQL[f"{name}_loss_grad"] = f"""{base} select 0 as k, {s6('avg(v)')} as value from s union all select 1, {s6('avg(s * a)')} from s union all select 2, {s6('avg(s * b)')} from s
union all select 3, {s6('avg(s * c)')} from s union all select 4, {s6('avg(s)')} from s"""


for _name in _MODELS:
    _model(_name)


@query
def logreg_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted chances and classes of lines, row by row."""
    x = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("features"))
    fit = glm.Regression(losses.Logistic())
    fit.coeffs, fit.classes = np.array(W), [0.0, 1.0]
    return x.select("l_orderkey", "l_linenumber", r6(fit.probability()).alias("p"), fit.prediction().alias("y"))


SQL["logreg_probabilities"] = f"with x as (select l_orderkey, l_linenumber, {_Z} as z from lineitem) select l_orderkey, l_linenumber, {s6('1 / (1 + exp(-z))')} as p, case when z >= 0 then 1.0 else 0.0 end::double as y from x"


@query
def lipschitz(spark: SparkSession, folder: str) -> DataFrame:
    m = glm.Glm(_lines(spark, folder, _returned()), losses.Logistic(), l2=0.1)
    return named_values(spark, most=m.lipschitz_max(), mean=m.lipschitz_mean())


SQL["lipschitz"] = f"with x as (select 1 + pow(l_quantity / 50, 2) + pow(l_discount * 10, 2) + pow(l_tax * 10, 2) as s from lineitem) select {s6('max(s) / 4 + 0.1')} as most, {s6('avg(s) / 4 + 0.1')} as mean from x"


@query
def gram_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return array_table(spark, glm.Glm(_lines(spark, folder, _price()), losses.Squared()).gram(), "i j", decimals=3)


SQL["gram_matrix"] = """with x as (select unnest([0, 1, 2]) as i, unnest([l_quantity / 50, l_discount * 10, l_tax * 10]) as v, l_quantity / 50 as a, l_discount * 10 as b, l_tax * 10 as c from lineitem)
select i, j::int as j, (round(sum(v * case j when 0 then a when 1 then b else c end), 3) + 0.0) as value from x cross join range(0, 3) z(j) group by i, j"""


@query
def row_intercepts_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Linear loss with an intercept of its own for every part."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_retailprice") / 1000).alias("label"), F.array((F.col("p_size") / 50).cast("double")).alias("features"))
    mu = p.select("row_id", (F.pmod("row_id", F.lit(7)) / 10).alias("mu"))
    m = glm.RowIntercepts(p)
    return named_values(spark, loss=m.loss([0.4, 0.3], mu), slope=float(m.grad([0.4, 0.3], mu)[0][0]))


SQL["row_intercepts_loss"] = f"""with r as (select 0.4 * (p_size / 50) + 0.3 + (p_partkey % 7) / 10 - p_retailprice / 1000 as r, p_size / 50 as x from part)
select {s6('avg(r * r / 2)')} as loss, {s6('avg(r * x)')} as slope from r"""


# ---- survival: lines by days to shipping ----


def _lives(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "lineitem")
    days = F.datediff(F.col("l_shipdate"), F.to_date(F.lit("1992-01-01"))).cast("double")
    return x.select(F.greatest(days, F.lit(0.0)).alias("time"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("event"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("features"))


_LIVES = "li as (select greatest(date_diff('day', date '1992-01-01', l_shipdate::date), 0)::double as time, (l_returnflag = 'R')::int as e, l_quantity / 50 as a, l_discount * 10 as b from lineitem)"
_RISK = f"{_LIVES}, pt as (select time, sum(e) as d, count(*) as m from li group by time), rk as (select * from (select time, d, sum(m) over (order by time desc) as n from pt) where d > 0)"


@query
def kaplan_meier(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(survival.kaplan_meier(_lives(spark, folder)), "survival")


SQL["kaplan_meier"] = f"""with {_RISK}, c as (select time, case when max((d >= n)::int) over (order by time) > 0 then 0 else exp(sum(case when d < n then ln(1 - d / n) else 0 end) over (order by time)) end as s from rk)
select time, {s6('s')} as survival from c where time > 0 or exists (select 1 from rk where time = 0) union all select 0::double, 1::double where not exists (select 1 from rk where time = 0)"""


@query
def nelson_aalen(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(survival.nelson_aalen(_lives(spark, folder)), "hazard")


SQL["nelson_aalen"] = f"""with {_RISK}, c as (select time, sum(d / n) over (order by time) as h from rk)
select time, {s6('h')} as hazard from c where time > 0 or exists (select 1 from rk where time = 0) union all select 0::double, 0::double where not exists (select 1 from rk where time = 0)"""

COX = [0.3, -0.2]


@query
def cox_risk_sets(spark: SparkSession, folder: str) -> DataFrame:
    r = survival.CoxLikelihood(_lives(spark, folder)).risk_sets(COX)
    return r.select("time", "d", F.round(F.col("risk") * F.exp("top"), 4).alias("risk"))


_COX = f"{_LIVES}, sc as (select *, 0.3 * a - 0.2 * b as s from li), pt as (select time, sum(e) as d, sum(e * s) as es, sum(exp(s)) as w, sum(a * exp(s)) as wa, sum(b * exp(s)) as wb, sum(e * a) as xa, sum(e * b) as xb from sc group by time), rs as (select time, d, es, xa, xb, sum(w) over q as risk, sum(wa) over q as ra, sum(wb) over q as rb from pt window q as (order by time desc))"
SQL["cox_risk_sets"] = f"with {_COX} select time, d::double as d, (round(risk, 4) + 0.0) as risk from rs"


@query
def cox_loss_grad(spark: SparkSession, folder: str) -> DataFrame:
    v, g = survival.CoxLikelihood(_lives(spark, folder)).loss_and_grad(COX)
    return array_table(spark, np.r_[v, g], "k")


SQL["cox_loss_grad"] = f"""with {_COX}, n as (select sum(e) as n from li), t as (select sum(d * ln(risk) - es) as l, sum(d * ra / risk - xa) as a, sum(d * rb / risk - xb) as b from rs where d > 0)
select 0 as k, {s6('l / n')} as value from t, n union all select 1, {s6('a / n')} from t, n union all select 2, {s6('b / n')} from t, n"""


# ---- case series: users by day, purchases as events, other types as exposures ----

_TYPES = ["click", "error", "signup", "view"]
LAGS = [1, 2, 1, 0]
_STARTS = np.r_[0, np.cumsum(np.array(LAGS) + 1)][:-1]
P = int(sum(LAGS) + len(LAGS))
SCCS = [round(0.1 * (k - 3), 1) for k in range(P)]


def _series(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, folder, "events")
    day = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 8.64e10)
    at = e.select(F.col("user_id").alias("case_id"), day.alias("interval"), "event_type")
    feature = F.array_position(F.array(*(F.lit(x) for x in _TYPES)), F.col("event_type")).cast("int") - 1
    features = at.where("event_type <> 'purchase'").select("case_id", "interval", feature.alias("feature"), F.lit(1.0).alias("value")).distinct()
    labels = at.where("event_type = 'purchase'").groupBy("case_id", "interval").agg(F.count("*").alias("y"))
    censoring = at.select("case_id").distinct().withColumn("censoring", 10 + F.pmod("case_id", F.lit(20)))
    return features, labels, censoring


_FT = f"""da as (select user_id as case_id, floor((epoch_us(ts) - 1704067200000000) / 8.64e10)::bigint as interval, event_type from events),
ft as (select distinct case_id, interval, list_position({_TYPES!r}, event_type) - 1 as feature, 1.0::double as value from da where event_type <> 'purchase'),
lb as (select case_id, interval, count(*) as y from da where event_type = 'purchase' group by all),
ce as (select distinct case_id, 10 + case_id % 20 as censoring from da)"""
_OFF = sql_values("o", "feature, n, st", [(i, LAGS[i], int(_STARTS[i])) for i in range(4)])
_LG = f"{_OFF}, lg as (select ft.case_id, ft.interval + k as interval, st + k as feature, value from ft join o using (feature) join range(0, 3) z(k) on k <= n join ce using (case_id) where ft.interval + k < censoring)"


@query
def lagged_exposures(spark: SparkSession, folder: str) -> DataFrame:
    f, _, c = _series(spark, folder)
    return longitudinal.lagged(f, c, LAGS)


SQL["lagged_exposures"] = f"with {_FT}, {_LG} select case_id, interval, feature, value from lg"


def _case_series(spark: SparkSession, folder: str) -> survival.CaseSeries:
    f, y, c = _series(spark, folder)
    return survival.CaseSeries(longitudinal.lagged(f, c, LAGS), y, c, P)


@query
def sccs_loss_grad(spark: SparkSession, folder: str) -> DataFrame:
    v, g = _case_series(spark, folder).loss_and_grad(SCCS)
    return array_table(spark, np.r_[v, g], "k")


_RW = f"""{sql_values('co', 'feature, c', list(enumerate(SCCS)))},
iv as (select case_id, unnest(range(0, censoring)) as interval from ce),
rw as (select iv.case_id, iv.interval, coalesce(y, 0) as y from iv left join lb using (case_id, interval)),
sc as (select rw.case_id, rw.interval, y, coalesce(sum(value * c), 0) as s from rw left join lg using (case_id, interval) left join co using (feature) group by rw.case_id, rw.interval, y),
nz as (select case_id, sum(y) as total, ln(sum(exp(s))) as z, count(*) as m from sc group by case_id)"""
SQL["sccs_loss_grad"] = f"""with {_FT}, {_LG}, {_RW}, n as (select count(*) as n from ce)
select 0 as k, {s6('sum(y * (z - s)) / any_value(n)')} as value from sc join nz using (case_id), n where total > 0
union all select co.feature + 1, {s6('coalesce(sum(value * (total * exp(s - z) - y)), 0) / any_value(n)')} from n, co left join lg on lg.feature = co.feature left join sc on sc.case_id = lg.case_id and sc.interval = lg.interval left join nz on nz.case_id = sc.case_id and total > 0 group by co.feature"""


@query
def sccs_score_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(survival.score_ratios(_case_series(spark, folder)), "observed", "expected")


SQL["sccs_score_ratio"] = f"with {_FT}, {_LG}, {_RW} select feature, {s6('sum(value * y)')} as observed, {s6('sum(value * total / m)')} as expected from lg join sc using (case_id, interval) join nz using (case_id) group by feature"


@query
def exposure_products(spark: SparkSession, folder: str) -> DataFrame:
    return longitudinal.finite_products(_series(spark, folder)[0], 4)


_PAIR = "4 + a.feature * 4 - a.feature * (a.feature + 1) // 2 + b.feature - a.feature - 1"
SQL["exposure_products"] = f"with {_FT} select * from ft union all select a.case_id, a.interval, {_PAIR}, a.value * b.value from ft a join ft b on a.case_id = b.case_id and a.interval = b.interval and a.feature < b.feature"


@query
def first_exposure_products(spark: SparkSession, folder: str) -> DataFrame:
    return longitudinal.infinite_products(_series(spark, folder)[0], 4)


SQL["first_exposure_products"] = f"with {_FT}, fi as (select case_id, feature, min(interval) as t from ft group by all) select * from ft union all select a.case_id, greatest(a.t, b.t), {_PAIR}, 1.0 from fi a join fi b on a.case_id = b.case_id and a.feature < b.feature"


@query
def active_cases(spark: SparkSession, folder: str) -> DataFrame:
    f, y, _ = _series(spark, folder)
    return longitudinal.active_cases(f, y)


SQL["active_cases"] = f"with {_FT} select case_id from ft group by case_id having sum(value) > 0 and case_id in (select case_id from lb where y <> 0)"


@query
def censored_exposures(spark: SparkSession, folder: str) -> DataFrame:
    f, _, c = _series(spark, folder)
    return longitudinal.censored(f, c)


SQL["censored_exposures"] = f"with {_FT} select case_id, interval, feature, value from ft join ce using (case_id) where interval < censoring"


# ---- binarizer, quantiles, scales, ranking ----

CUTS = 4


@query
def binarizer_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """Inner boundaries of the bins of two columns of part, by quantiles and by equal steps."""
    p = table(spark, folder, "part")
    rows = [(c, m, k, round(float(v), 6)) for c in ("p_retailprice", "p_size") for m in ("quantile", "linspace") for k, v in enumerate(binarizer.boundaries(p, c, CUTS, m)[1:-1])]
    return spark.createDataFrame(rows, "name string, method string, k int, value double")


_NEAR = "select unnest(list_distinct(list_transform([0.0, 0.2, 0.4, 0.6, 0.8, 1.0], lambda q: list_sort(l)[cast(round_even(q * (len(l) - 1), 0) as bigint) + 1]))) as v"
SQL["binarizer_boundaries"] = "\nunion all ".join(
    f"(select '{c}' as name, 'quantile' as method, (row_number() over (order by v) - 2)::int as k, round(v, 6) as value from ({_NEAR} from (select list({c}::double) as l from part)) qualify k >= 0 and v < (select max({c}) from part))"
    f"\nunion all select '{c}', 'linspace', (i - 1)::int, round(lo + (hi - lo) * i / 5, 6) from (select min({c})::double as lo, max({c})::double as hi from part), range(1, 5) z(i)"
    for c in ("p_retailprice", "p_size")
)


@query
def binarizer_onehot(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the ones of lines: quantity in bins, flag and status as categories."""
    x = table(spark, folder, "lineitem")
    b = binarizer.Binarizer(["l_quantity", "l_returnflag", "l_linestatus"], n_cuts=CUTS).fit(x)
    one = b.transform(x)
    return one.select("l_orderkey", "l_linenumber", *(F.col("onehot")[i].alias(n) for i, n in enumerate(("quantity", "flag", "status"))))


SQL["binarizer_onehot"] = """with q as (select list_sort(list(l_quantity)) as l from lineitem),
b as (select distinct v from (select unnest(list_transform([0.2, 0.4, 0.6, 0.8], lambda q: l[cast(round_even(q * (len(l) - 1), 0) as bigint) + 1])) as v, l[1] as lo, l[len(l)] as hi from q) where v > lo and v < hi),
f as (select l_returnflag as x, row_number() over (order by l_returnflag) - 1 as k from (select distinct l_returnflag from lineitem)), s as (select l_linestatus as x, row_number() over (order by l_linestatus) - 1 as k from (select distinct l_linestatus from lineitem))
select l_orderkey, l_linenumber, (select count(*) from b where v < l_quantity) as quantity, (select count(*) + 1 from b) + f.k as flag, (select count(*) + 1 from b) + (select count(*) from f) + s.k as status
from lineitem join f on f.x = l_returnflag join s on s.x = l_linestatus"""


@query
def scale_estimates(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "lineitem")
    return named_values(spark, mad=metrics.std_mad(x, "l_extendedprice"), iqr=metrics.std_iqr(x, "l_extendedprice"), decimals=4)


SQL["scale_estimates"] = """with m as (select median(l_extendedprice) as m from lineitem)
select round(median(abs(l_extendedprice - m)) / 0.6744897501960817, 4) as mad, (select round((quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) * 0.6744897501960817, 4) from lineitem) as iqr from lineitem, m"""


@query
def exact_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    q = quantiles.quantiles(table(spark, folder, "orders"), "o_totalprice", [0.01, 0.5, 0.99])
    return array_table(spark, q, "k", decimals=4)


SQL["exact_quantiles"] = "select unnest([0, 1, 2]) as k, round(unnest(quantile_cont(o_totalprice, [0.01, 0.5, 0.99])), 4) as value from orders"


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_quantity").alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))


@query
def auc_rank(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.auc(_scores(spark, folder)), "auc")


SQL["auc_rank"] = f"with c as (select l_quantity as s, sum((l_returnflag = 'R')::int) as p, sum((l_returnflag <> 'R')::int) as q from lineitem group by 1), w as (select *, sum(q) over (order by s) - q / 2 as below from c) select {s6('sum(p * below) / (sum(p) * sum(q))')} as auc from w"


@query
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.roc_points(_scores(spark, folder)), "fpr", "tpr")


SQL["roc_points"] = f"with c as (select l_quantity as threshold, sum((l_returnflag = 'R')::int) as p, sum((l_returnflag <> 'R')::int) as q from lineitem group by 1) select threshold, {s6('sum(q) over (order by threshold desc) / sum(q) over ()')} as fpr, {s6('sum(p) over (order by threshold desc) / sum(p) over ()')} as tpr from c"


def _coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """True and found coefficients: the first entries of embeddings and their soft thresholds."""
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("truth"))
    return e.select("vec_id", F.when(F.pmod("vec_id", F.lit(3)) == 0, 0.0).otherwise(F.col("truth")).alias("truth"), prox.soft_column(F.col("truth"), 0.05).alias("found"))


_COEF = "co as (select vec_id, case when vec_id % 3 = 0 then 0 else embedding[1]::double end as truth, sign(embedding[1]::double) * greatest(abs(embedding[1]::double) - 0.05::double, 0) as found from embeddings)"


@query
def support_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.support_metrics(_coefficients(spark, folder)), "fdp", "recall")


SQL["support_metrics"] = f"with {_COEF} select {s6('count(*) filter (abs(found) > 1e-8 and abs(truth) <= 1e-8) / greatest(count(*) filter (abs(found) > 1e-8), 1)')} as fdp, {s6('count(*) filter (abs(found) > 1e-8 and abs(truth) > 1e-8) / count(*) filter (abs(truth) > 1e-8)')} as recall from co"


@query
def prox_formulas(spark: SparkSession, folder: str) -> DataFrame:
    """Soft threshold, ridge and elastic net of the first entries of the embeddings."""
    x = table(spark, folder, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return x.select("vec_id", r6(prox.soft_column(F.col("x"), 0.05)).alias("l1"), r6(F.col("x") / 1.05).alias("l2"), r6(prox.soft_column(F.col("x"), 0.05 * 0.9) / (1 + 0.05 * 0.1)).alias("elasticnet"))


_X = "embedding[1]::double"
SQL["prox_formulas"] = f"select vec_id, {s6(f'sign({_X}) * greatest(abs({_X}) - 0.05::double, 0)')} as l1, {s6(f'{_X} / 1.05')} as l2, {s6(f'sign({_X}) * greatest(abs({_X}) - 0.045::double, 0) / 1.005')} as elasticnet from embeddings"


@query
def prox_group(spark: SparkSession, folder: str) -> DataFrame:
    """Group shrinkage of whole embeddings: each is one block."""
    x = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    scale = F.greatest(1 - F.lit(0.05) * F.sqrt(F.size("x").cast("double")) / norm, F.lit(0.0))
    return x.withColumn("s", scale).select("vec_id", r6(F.col("x")[0] * F.col("s")).alias("first"), r6("s").alias("scale"))


SQL["prox_group"] = f"with x as (select vec_id, {_X} as x, greatest(1 - 0.05 * sqrt(len(embedding)) / sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))), 0) as s from embeddings) select vec_id, {s6('x * s')} as first, {s6('s')} as scale from x"


@query
def distance_histories(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals by their distance from the customer's least order."""
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", F.round(F.col("o_totalprice") - F.min("o_totalprice").over(Window.partitionBy("o_custkey")), 4).alias("distance"))


SQL["distance_histories"] = "select o_orderkey, round(o_totalprice - min(o_totalprice) over (partition by o_custkey), 4) as distance from orders"


# ---- fits: iterative; their SQL computes them another way, or states what holds at them ----

#: Far more rounds than the fits need until they stop by themselves.
ROUNDS = 100_000


def regression(spark: SparkSession, folder: str, label, **options) -> glm.Regression:
    return finished(glm.Regression(max_iter=ROUNDS, **options).fit(_lines(spark, folder, label())))


@query
def fit_linear_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients of a ridge regression of prices, at the minimum."""
    fit = regression(spark, folder, _price, loss=losses.Squared(), solver="agd", penalty="l2", C=10.0, step=0.3, tol=1e-16)
    return array_table(spark, fit.coeffs, "k", decimals=4)


# Gradient descent on the normal equations, to their solution.
_W4 = ["w0", "w1", "w2", "w3"]
_G4 = [[f"g{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
_X4 = ["a", "b", "c", "1.0"]
SQL["fit_linear_regression"] = f"""with recursive x as (select (l_extendedprice / 50000)::double as y, (l_quantity / 50)::double as a, (l_discount * 10)::double as b, (l_tax * 10)::double as c from lineitem),
g as (select {', '.join(f'avg({_X4[i]} * {_X4[j]}) as g{i}{j}' for i in range(4) for j in range(i, 4))}, {', '.join(f'avg({_X4[i]} * y) as t{i}' for i in range(4))} from x),
d as (select 0 as n, 0.0::double as w0, 0.0::double as w1, 0.0::double as w2, 0.0::double as w3
  union all
  select n + 1, {', '.join(f"{w} - 0.5 * ({' + '.join(f'{_G4[i][j]} * w{j}' for j in range(4))} - t{i}{f' + 0.1 * w{i}' if i < 3 else ''})" for i, w in enumerate(_W4))} from d, g where n < 3000)
select k::int as k, (round([w0, w1, w2, w3][k + 1], 4) + 0.0) as value from d, range(0, 4) z(k) where n = 3000"""


def _optimal(name: str, label, check, **options):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        fit = regression(spark, folder, label, **options)
        model = glm.Glm(_lines(spark, folder, label()), fit.loss)
        return spark.createDataFrame([(k, bool(x)) for k, x in enumerate(check(fit, model))], "k int, optimal boolean")

    run.__doc__ = f"Optimality of {name}, coefficient by coefficient."
    QUERIES[name], SQL[name] = run, "select k::int as k, true as optimal from range(0, 4) z(k)"


def _flat(weight: float):
    """Slopes of a loss with a ridge penalty of that weight on all but the intercept."""
    return lambda fit, model: np.abs(model.grad(fit.coeffs) + weight * np.r_[fit.coeffs[:-1], 0]) < 1e-4


def _fixed(fit, model):
    """A further proximal step leaves the coefficients where they are."""
    p = glm.penalty_prox(fit.penalty, fit.C, model.p, fit.ratio, fit.blocks)
    return np.abs(p(fit.coeffs - 0.3 * model.grad(fit.coeffs), 0.3) - fit.coeffs) < 1e-4


_optimal("fit_logistic_regression", _returned, _flat(1e-3), loss=losses.Logistic(), solver="bfgs", penalty="l2")
_optimal("fit_poisson_regression", _count, _flat(0.0), loss=losses.Poisson(), solver="bfgs", penalty="none")
_optimal("fit_elasticnet_regression", _price, _fixed, loss=losses.Squared(), solver="agd", penalty="elasticnet", C=50.0, step=0.3, tol=1e-14)
_optimal("fit_binarsity_regression", _price, _fixed, loss=losses.Squared(), solver="gd", penalty="binarsity", blocks=[(0, 3)], step=0.3, tol=1e-14)


@query
def fit_cox(spark: SparkSession, folder: str) -> DataFrame:
    """Optimality of a Cox fit under a ridge penalty, and of a second one from where it ended."""
    fit = survival.CoxRegression("l2", C=1e3, solver="bfgs", tol=1e-5, warm_start=True).fit(_lives(spark, folder))
    first = finished(fit).coeffs
    fit.solver.max_iter = 1
    again = np.abs(fit.fit(_lives(spark, folder)).coeffs - first) < 1e-3
    flat = np.abs(fit.model.grad(first) + 1e-3 * first) < 1e-4
    return spark.createDataFrame([(k, bool(a), bool(b)) for k, (a, b) in enumerate(zip(flat, again, strict=True))], "k int, optimal boolean, warm boolean")


SQL["fit_cox"] = "select k::int as k, true as optimal, true as warm from range(0, 2) z(k)"


def case_series(spark: SparkSession, folder: str):
    return finished(survival.LaggedCaseSeries(LAGS, c_tv=100.0, c_group=100.0).fit(*_series(spark, folder)))


@query
def fit_case_series(spark: SparkSession, folder: str) -> DataFrame:
    """Half widths of the intervals of the lagged effects, and whether the fit is a minimum."""
    fit = case_series(spark, folder)
    done = fit.history[0]["slope"] < 1e-5
    rows = [(k, round((b - a) / 2, 6) if math.isfinite(b) else None, bool(done and a < c < b)) for k, (c, (a, b)) in enumerate(zip(fit.coeffs, fit.intervals(), strict=True))]
    return spark.createDataFrame(rows, "k int, width double, optimal boolean")


SQL["fit_case_series"] = f"""with {_FT}, {_LG}, {_RW}, ob as (select feature, sum(value * y) as o, sum(value * total / m) as e from lg join sc using (case_id, interval) join nz using (case_id) group by feature)
select k::int as k, {s6('1.959963984540054 * sqrt(1 / (o + 0.5) + 1 / (e + 0.5))')} as width, true as optimal from range(0, {P}) z(k) left join ob on ob.feature = k"""


def robust_fit(spark: SparkSession, folder: str):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_retailprice") / 1000).alias("label"), F.array((F.col("p_size") / 50).cast("double")).alias("features"))
    return glm.robust_regression(p, C_rows=100000.0, max_iter=1000, strict=True)


@query
def fit_robust_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of which every fiftieth has its price shifted: the rows found to be outliers. The
    penalty on row intercepts is scaled by the rows and the spread of the prices."""
    shift = F.when(F.pmod("p_partkey", F.lit(50)) == 0, F.when(F.pmod("p_partkey", F.lit(100)) == 0, 4.0).otherwise(-4.0)).otherwise(0.0)
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_retailprice") / 1000 + shift).alias("label"), F.array((F.col("p_size") / 50).cast("double")).alias("features"))
    found = glm.robust_regression(p, C_rows=p.count() / metrics.std_mad(p, "label"), penalty="none", max_iter=1000, strict=True)[1]
    return found.select("row_id", F.signum("mu").cast("int").alias("side"))


SQL["fit_robust_regression"] = "select p_partkey as row_id, (case when p_partkey % 100 = 0 then 1 else -1 end)::int as side from part where p_partkey % 50 = 0"
