"""Queries of the tree engine on the driver's tables, with SQL for the same results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, objectives
from ..operators import binning, explain, histogram, ranking, sampling, scoring, splits, survival
from .model import Model, Node, Tree
from .train import label_quantiles, train
from .tree_sql import Grown, nodes_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- cuts, bins and categories


@query("""
WITH v AS (SELECT DISTINCT 0 AS feat, CAST(l_discount AS REAL) AS x FROM lineitem UNION SELECT DISTINCT 1, CAST(l_tax AS REAL) FROM lineitem UNION SELECT DISTINCT 2, CAST(l_quantity AS REAL) FROM lineitem),
n AS (SELECT feat, x, lead(x) OVER (PARTITION BY feat ORDER BY x) AS y FROM v)
SELECT feat, CAST(row_number() OVER (PARTITION BY feat ORDER BY x) - 1 AS INTEGER) AS idx, round(CAST(CAST(x + (y - x) / CAST(2 AS REAL) AS REAL) AS DOUBLE), 5) AS cut FROM n WHERE y IS NOT NULL
""")
def cuts_midpoint_lossless(spark, sf_dir):
    c = binning.cuts(binning.value_weights(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax", "l_quantity"]))
    return c.select("feat", F.col("idx").cast("int").alias("idx"), F.round(F.col("cut").cast("double"), 5).alias("cut"))


def _quantile_sql(weight: str, bins: int) -> str:
    return f"""
WITH v AS (SELECT CAST(o_totalprice AS REAL) AS x, CAST(sum({weight}) AS DOUBLE) AS w FROM orders GROUP BY 1),
r AS (SELECT x, sum(w) OVER (ORDER BY x) - w / 2 AS mid, sum(w) OVER () AS total FROM v),
t AS (SELECT k, min(x) AS cut FROM r, range(1, {bins}) AS g(k) WHERE mid >= k * total / {bins} GROUP BY k)
SELECT 0 AS feat, CAST(row_number() OVER (ORDER BY cut) - 1 AS INTEGER) AS idx, round(CAST(cut AS DOUBLE), 3) AS cut FROM (SELECT DISTINCT cut FROM t)
"""


def _quantile_cuts(spark, sf_dir, weight, bins):
    c = binning.cuts(binning.value_weights(table(spark, sf_dir, "orders"), ["o_totalprice"], weight), bins)
    return c.select("feat", F.col("idx").cast("int").alias("idx"), F.round(F.col("cut").cast("double"), 3).alias("cut"))


@query(_quantile_sql("1", 16))
def cuts_quantile_exact(spark, sf_dir):
    return _quantile_cuts(spark, sf_dir, None, 16)


@query(_quantile_sql("o_custkey % 3 + 1", 8))
def cuts_quantile_weighted(spark, sf_dir):
    return _quantile_cuts(spark, sf_dir, F.col("o_custkey") % 3 + 1, 8)


@query("""
SELECT CAST(CASE WHEN l_quantity < 10.5 THEN 0 WHEN l_quantity < 20.5 THEN 1 WHEN l_quantity < 40 THEN 2 ELSE 3 END AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1
""")
def bin_assign(spark, sf_dir):
    b = binning.bin_of(binning.as_feature("l_quantity"), [10.5, 20.5, 40.0]).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CASE WHEN l_discount = 0 THEN NULL WHEN l_discount < 0.045 THEN 0 ELSE 1 END AS bin, count(*) AS n FROM lineitem GROUP BY 1
""")
def bin_missing_sentinel(spark, sf_dir):
    b = binning.search_bin(binning.as_feature("l_discount", 0.0), [0.045])
    return table(spark, sf_dir, "lineitem").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH f AS (SELECT o_orderpriority AS name, min(o_orderkey) AS first FROM orders GROUP BY 1)
SELECT name, CAST(row_number() OVER (ORDER BY first, name) - 1 AS INTEGER) AS code FROM f
""")
def cat_learn_first_appearance(spark, sf_dir):
    return binning.learn_categories(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey").select("name", F.col("code").cast("int").alias("code"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS code, count(*) AS n FROM orders GROUP BY 1")
def cat_recode_by_value(spark, sf_dir):
    got = binning.recode(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"], "code", unseen="null")
    return got.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---- objectives

_P = "((o_totalprice - 150000.0) / 200000.0)"
_LABELS = {"bin": "CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END", "count": "CAST(o_custkey % 5 AS DOUBLE)", "pos": "(o_totalprice / 100000.0 + 0.1)"}


def _orders(spark, sf_dir, label: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_P).alias("p"), F.expr(_LABELS[label]).alias("y"))


_SIG = "(1 / (1 + exp(-p)))"
#: objective, label, gradient and hessian in SQL
_GRADIENTS = {
    "squarederror": ("reg:squarederror", "pos", "p - y", "1.0"),
    "logistic": ("binary:logistic", "bin", f"{_SIG} - y", f"greatest({_SIG} * (1 - {_SIG}), 1e-16)"),
    "squaredlogerror": ("reg:squaredlogerror", "pos", "(ln(1 + p) - ln(1 + y)) / (p + 1)", "greatest((1 - (ln(1 + p) - ln(1 + y))) / pow(p + 1, 2), 1e-6)"),
    "hinge": ("binary:hinge", "bin", "CASE WHEN p * (2 * y - 1) < 1 THEN -(2 * y - 1) ELSE 0.0 END", "CASE WHEN p * (2 * y - 1) < 1 THEN 1.0 ELSE 0.0 END"),
    "poisson": ("count:poisson", "count", "exp(p) - y", "exp(p + 0.7)"),
    "gamma": ("reg:gamma", "pos", "1 - y / exp(p)", "y / exp(p)"),
    "tweedie": ("reg:tweedie", "count", "-y * exp(-0.5 * p) + exp(0.5 * p)", "0.5 * y * exp(-0.5 * p) + 0.5 * exp(0.5 * p)"),
    "pseudohuber": ("reg:pseudohubererror", "pos", "(p - y) / sqrt(1 + pow(p - y, 2))", "1 / ((1 + pow(p - y, 2)) * sqrt(1 + pow(p - y, 2)))"),
    "expectile": ("reg:expectileerror", "pos", "CASE WHEN p >= y THEN 0.7 ELSE 0.3 END * (p - y)", "CASE WHEN p >= y THEN 0.7 ELSE 0.3 END"),
    "absolute": ("reg:absoluteerror", "pos", "(p - y) * 0.25 / sqrt(0.0625 + pow(p - y, 2))", "0.25 / sqrt(0.0625 + pow(p - y, 2))"),
    "quantile": ("reg:quantileerror", "pos", "0.125 * (tanh((p - y) / 0.01) + 1 - 0.6)", "12.5 * greatest(CASE WHEN p = y THEN 1.0 ELSE tanh((p - y) / 0.01) / ((p - y) / 0.01) END, 3e-4)"),
}
_PARAMS = {"max_delta_step": 0.7, "tweedie_variance_power": 1.5, "huber_slope": 1.0, "expectile_alpha": 0.3, "scale": 0.25, "level": 0.3, "scale_pos_weight": 1.0}


def _gradient_query(name: str, objective: str, label: str):
    def run(spark, sf_dir):
        o = objectives.SCALAR[objective]
        p, y = F.col("p"), F.col("y")
        return _orders(spark, sf_dir, label).select("o_orderkey", F.round(o.grad(p, y, _PARAMS), 9).alias("g"), F.round(o.hess(p, y, _PARAMS), 9).alias("h"))

    return run


for _name, (_objective, _label, _g, _h) in _GRADIENTS.items():
    query(f"WITH t AS (SELECT o_orderkey, {_P} AS p, {_LABELS[_label]} AS y FROM orders) SELECT o_orderkey, round({_g}, 9) AS g, round({_h}, 9) AS h FROM t", f"grad_{_name}")(_gradient_query(_name, _objective, _label))


@query(f"""
WITH t AS (SELECT o_orderkey, {_P} AS m0, -{_P} AS m1, 0.25 AS m2, o_custkey % 3 AS y FROM orders),
e AS (SELECT o_orderkey, y, exp(m0) AS a, exp(m1) AS b, exp(m2) AS c FROM t)
SELECT o_orderkey, round(b / (a + b + c) - CASE WHEN y = 1 THEN 1 ELSE 0 END, 4) AS g, round(2 * (b / (a + b + c)) * (1 - b / (a + b + c)), 4) AS h FROM e
""")
def grad_softmax(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.expr(_P), -F.expr(_P), F.lit(0.25)).alias("m"), (F.col("o_custkey") % 3).alias("y"))
    g, h = objectives.softmax_gradients(F.col("m"), F.col("y"), 1)
    return o.select("o_orderkey", F.round(g, 4).alias("g"), F.round(h, 4).alias("h"))


_COX = f"SELECT o_orderkey, {_P} AS m, (o_custkey % 40 + 1) * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS t FROM orders"


@query(f"""
WITH t AS ({_COX}),
r AS (SELECT *, sum(exp(m)) OVER (ORDER BY abs(t) RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM t),
a AS (SELECT *, sum(CASE WHEN t > 0 THEN 1 / risk ELSE 0 END) OVER (ORDER BY abs(t) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
             sum(CASE WHEN t > 0 THEN 1 / risk / risk ELSE 0 END) OVER (ORDER BY abs(t) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM r)
SELECT o_orderkey, round(exp(m) * a - CASE WHEN t > 0 THEN 1 ELSE 0 END, 4) AS g, round(exp(m) * a - exp(2 * m) * b, 4) AS h FROM a
""")
def grad_cox(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_P} AS m", "(o_custkey % 40 + 1) * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS t", "1.0D AS w")
    g = survival.cox_gradients(o, "m", "t", "w", ["o_orderkey"])
    return g.select("o_orderkey", F.round(F.col("g0").cast("double"), 4).alias("g"), F.round(F.col("h0").cast("double"), 4).alias("h"))


@query(f"""
WITH t AS ({_COX}), r AS (SELECT *, sum(exp(m)) OVER (ORDER BY abs(t) RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM t)
SELECT round(sum(ln(risk) - m) / count(*), 6) AS cox_nloglik FROM r WHERE t > 0
""")
def metric_cox_nloglik(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr(f"{_P} AS m", "(o_custkey % 40 + 1) * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS t", "1.0D AS w")
    return survival.cox_nloglik(o, "m", "t", "w").select(F.round("cox_nloglik", 6).alias("cox_nloglik"))


@query(f"""
WITH t AS (SELECT o_orderkey, {_P} AS m, {_LABELS['pos']} AS y FROM orders), z AS (SELECT *, (ln(y) - m) AS z FROM t)
SELECT o_orderkey, round((1 - 2 / (1 + exp(-z))), 6) AS g, round(2 * (1 / (1 + exp(-z))) * (1 - 1 / (1 + exp(-z))), 6) AS h FROM z
""")
def grad_aft_logistic(spark, sf_dir):
    o = _orders(spark, sf_dir, "pos")
    g, h = survival.aft_gradients(F.col("p"), F.col("y"), F.col("y"), "logistic", 1.0)
    return o.select("o_orderkey", F.round(g, 6).alias("g"), F.round(h, 6).alias("h"))


# ---- intercepts


def _one(spark: SparkSession, **values: float) -> DataFrame:
    return spark.range(1).select(*[F.round(F.lit(float(v)), 6).alias(k) for k, v in values.items()])


@query(f"SELECT round(avg({_LABELS['bin']}), 6) AS base_score FROM orders")
def base_score_mean(spark, sf_dir):
    own = _orders(spark, sf_dir, "bin").withColumn("w", F.lit(1.0))
    return _one(spark, base_score=objectives.base_score(own, "binary:logistic", "y", "w", _PARAMS))


@query(f"WITH t AS (SELECT {_LABELS['pos']} AS y FROM orders) SELECT round(sum(y / sqrt(1 + y * y)) / sum(1 / ((1 + y * y) * sqrt(1 + y * y))), 6) AS base_score FROM t")
def base_score_newton(spark, sf_dir):
    own = _orders(spark, sf_dir, "pos").withColumn("w", F.lit(1.0))
    return _one(spark, base_score=objectives.base_score(own, "reg:pseudohubererror", "y", "w", _PARAMS))


@query(f"""
WITH t AS (SELECT {_LABELS['pos']} AS y FROM orders), m AS (SELECT avg(y) AS m FROM t), s AS (SELECT pow(avg(sqrt(abs(m - y))), 2) AS s FROM t, m)
SELECT round(any_value(m) - sum((m - y) * s / sqrt(s * s + pow(m - y, 2))) / sum(s / sqrt(s * s + pow(m - y, 2))), 6) AS base_score FROM t, m, s
""")
def base_score_absolute(spark, sf_dir):
    own = _orders(spark, sf_dir, "pos").withColumn("w", F.lit(1.0))
    return _one(spark, base_score=objectives.base_score(own, "reg:absoluteerror", "y", "w", _PARAMS))


@query("""
WITH c AS (SELECT label AS class, ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM embeddings)) AS l FROM embeddings GROUP BY 1)
SELECT class, round(l - avg(l) OVER (), 6) AS margin FROM c
""")
def base_score_class_frequency(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("y"), F.lit(1.0).alias("w"))
    n = e.agg(F.max("y")).first()[0] + 1
    m = objectives.class_margins(e, "y", "w", n)
    return spark.range(1).select(F.posexplode(F.array(*[F.round(F.lit(x), 6) for x in m])).alias("class", "margin"))


@query("""
WITH r AS (SELECT o_totalprice AS y, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders),
q AS (SELECT level, level * (n + 1) AS x, y, i FROM r, (VALUES (0.1), (0.5), (0.9)) AS l(level))
SELECT round(CAST(level AS DOUBLE), 1) AS level, round(max(CASE WHEN i = floor(x) THEN y END) + (any_value(x) - floor(any_value(x))) * (max(CASE WHEN i = floor(x) + 1 THEN y END) - max(CASE WHEN i = floor(x) THEN y END)), 4) AS value FROM q GROUP BY level
""")
def base_score_label_quantiles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("y"), F.lit(1.0).alias("w"))
    levels = [0.1, 0.5, 0.9]
    got = label_quantiles(o, "y", "w", levels, False)
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.round(F.lit(v), 4).alias("value")) for a, v in zip(levels, got, strict=True)])).alias("r")).select("r.*")


# ---- histograms and splits

_S = 2.0**20
_LI = """
WITH t AS (SELECT nullif(l_discount, 0) AS f0, l_tax AS f1, l_quantity AS f2, l_linestatus AS s,
  CAST(round((0.5 - CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 1048576) AS BIGINT) AS g, CAST(262144 AS BIGINT) AS h FROM lineitem),
b AS (SELECT s, g, h, CASE WHEN f0 IS NOT NULL THEN dense_rank() OVER (ORDER BY f0 NULLS LAST) - 1 END AS b0, dense_rank() OVER (ORDER BY f1) - 1 AS b1, dense_rank() OVER (ORDER BY f2) - 1 AS b2 FROM t),
u AS (SELECT s, 0 AS feat, b0 AS bin, g, h FROM b UNION ALL SELECT s, 1, b1, g, h FROM b UNION ALL SELECT s, 2, b2, g, h FROM b)
"""


def _binned(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("f0", F.when(F.col("l_discount") != 0, F.col("l_discount")))
    names = ["f0", "l_tax", "l_quantity"]
    edges = binning.collect_cuts(binning.cuts(binning.value_weights(li, names)), 3)
    y = (F.col("l_returnflag") == "R").cast("double")
    o = objectives.SCALAR["binary:logistic"]
    cols = [binning.bin_of(binning.as_feature(f), e).alias(f"b{i}") for i, (f, e) in enumerate(zip(names, edges, strict=True))]
    return li.select(F.col("l_linestatus").alias("node"), *cols, histogram.fixed(o.grad(F.lit(0.0), y, {}), _S).alias("gq"), histogram.fixed(o.hess(F.lit(0.0), y, {}), _S).alias("hq"))


_BINS = {0: "b0", 1: "b1", 2: "b2"}


@query(_LI + "SELECT feat, CAST(bin AS INTEGER) AS bin, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h FROM u WHERE bin IS NOT NULL GROUP BY 1, 2")
def hist_root(spark, sf_dir):
    return histogram.histogram(_binned(spark, sf_dir), _BINS, []).select("feat", "bin", "g", "h")


@query(_LI + "SELECT s AS node, feat, CAST(bin AS INTEGER) AS bin, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h FROM u WHERE bin IS NOT NULL GROUP BY 1, 2, 3")
def hist_level(spark, sf_dir):
    return histogram.histogram(_binned(spark, sf_dir), _BINS, ["node"])


@query(_LI + "SELECT feat, CAST(bin AS INTEGER) AS bin, CAST(sum(CASE WHEN s = 'F' THEN 0 ELSE g END) AS BIGINT) AS g, CAST(sum(CASE WHEN s = 'F' THEN 0 ELSE h END) AS BIGINT) AS h FROM u WHERE bin IS NOT NULL GROUP BY 1, 2")
def hist_subtract(spark, sf_dir):
    b = _binned(spark, sf_dir)
    whole = histogram.histogram(b, _BINS, [])
    return histogram.subtract(whole, histogram.histogram(b.where("node = 'F'"), _BINS, []), []).select("feat", "bin", "g", "h")


@query(_LI + "SELECT s AS node, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h, count(*) AS n FROM b GROUP BY 1")
def node_sums(spark, sf_dir):
    return histogram.node_sums(_binned(spark, sf_dir), ["node"])


@query(f"WITH t AS (SELECT {_P} AS p, {_LABELS['bin']} AS y FROM orders), m AS (SELECT count(*) AS n, max(abs({_SIG} - y)) AS g, max({_SIG} * (1 - {_SIG})) AS h FROM t) SELECT n, floor(log2(pow(2.0, 62) / n / g)) AS log_scale_g, floor(log2(pow(2.0, 62) / n / h)) AS log_scale_h FROM m")
def fixed_point_scale(spark, sf_dir):
    o = objectives.SCALAR["binary:logistic"]
    own = _orders(spark, sf_dir, "bin").select(o.grad(F.col("p"), F.col("y"), {}).alias("g0"), o.hess(F.col("p"), F.col("y"), {}).alias("h0"))
    n, tops = histogram.bounds(own, ["g0"], ["h0"])
    a, b = (histogram.power_of_two(n, x) for x in tops[0])
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(math.log2(a)).alias("log_scale_g"), F.lit(math.log2(b)).alias("log_scale_h"))


_CANDIDATES = _LI + """, n AS (SELECT s, CAST(sum(g) AS DOUBLE) / 1048576 AS ng, CAST(sum(h) AS DOUBLE) / 1048576 AS nh FROM b GROUP BY 1),
k AS (SELECT s, feat, bin, CAST(sum(g) AS DOUBLE) / 1048576 AS g, CAST(sum(h) AS DOUBLE) / 1048576 AS h FROM u WHERE bin IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT s, feat, bin, sum(g) OVER w AS fg, sum(h) OVER w AS fh, sum(g) OVER v AS bg, sum(h) OVER v AS bh, sum(h) OVER (PARTITION BY s, feat) AS th FROM k
      WINDOW w AS (PARTITION BY s, feat ORDER BY bin ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY s, feat ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
e AS (SELECT s, feat, bin AS seq, bin + 1 AS bin, false AS default_left, fg AS gl, fh AS hl FROM c UNION ALL
      SELECT c.s, feat, 100000 - bin, bin, true, ng - bg, nh - bh FROM c JOIN n ON c.s = n.s WHERE th <> nh),
x AS (SELECT e.*, CAST(CAST(gl * gl / (hl + 1) AS REAL) + CAST((ng - gl) * (ng - gl) / (nh - hl + 1) AS REAL) - CAST(ng * ng / (nh + 1) AS REAL) AS DOUBLE) AS gain FROM e JOIN n ON e.s = n.s WHERE hl >= 1 AND nh - hl >= 1)
"""


@query(_CANDIDATES + "SELECT s AS node, feat, CAST(bin AS INTEGER) AS bin, default_left, round(gain, 2) AS gain FROM x WHERE gain > 0.01")
def split_candidates(spark, sf_dir):
    b = _binned(spark, sf_dir)
    got = splits.candidates(histogram.histogram(b, _BINS, ["node"]), histogram.node_sums(b, ["node"]), ["node"], (_S, _S), splits.Rules())
    return got.where(F.col("gain") > 0.01).select("node", "feat", F.col("bin").cast("int").alias("bin"), "default_left", F.round(F.col("gain").cast("double"), 2).alias("gain"))


@query(_CANDIDATES + ", r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY gain DESC, feat, seq) AS i FROM x) SELECT s AS node, feat, CAST(bin AS INTEGER) AS bin, default_left, round(gl, 4) AS gl, round(hl, 4) AS hl FROM r WHERE i = 1")
def split_best(spark, sf_dir):
    b = _binned(spark, sf_dir)
    got = splits.candidates(histogram.histogram(b, _BINS, ["node"]), histogram.node_sums(b, ["node"]), ["node"], (_S, _S), splits.Rules())
    best = splits.best_rows(got, ["node"])
    return best.select("node", "feat", F.col("bin").cast("int").alias("bin"), "default_left", F.round(F.col("gl") / _S, 4).alias("gl"), F.round(F.col("hl") / _S, 4).alias("hl"))


# ---- metrics

_MV = {
    "rmse": ("sqrt(avg(pow(p - y, 2)))", "pos", "p"), "mae": ("avg(abs(p - y))", "pos", "p"), "mape": ("avg(abs((p - y) / y))", "pos", "p"),
    "rmsle": ("sqrt(avg(pow(ln(1 + p) - ln(1 + y), 2)))", "pos", "p"), "mphe": ("avg(sqrt(1 + pow(p - y, 2)) - 1)", "pos", "p"),
    "logloss": ("avg(-(y * ln(p) + (1 - y) * ln(1 - p)))", "bin", _SIG), "error": ("avg(CASE WHEN p > 0.5 THEN 1 - y ELSE y END)", "bin", _SIG),
    "error@0.6": ("avg(CASE WHEN p > 0.6 THEN 1 - y ELSE y END)", "bin", _SIG), "poisson-nloglik": ("avg(p - y * ln(p) + ln(CAST(factorial(CAST(y AS INTEGER)) AS DOUBLE)))", "count", "exp(p)"),
    "gamma-deviance": ("avg(2 * (ln(p / y) + y / p - 1))", "pos", "exp(p)"), "gamma-nloglik": ("avg(ln(p) + y / p)", "pos", "exp(p)"),
    "tweedie-nloglik@1.5": ("avg(2 * y * pow(p, -0.5) + 2 * pow(p, 0.5))", "count", "exp(p)"), "quantile": ("avg(CASE WHEN y >= p THEN 0.3 * (y - p) ELSE 0.7 * (p - y) END)", "pos", "p"),
    "expectile": ("avg(CASE WHEN p >= y THEN 0.7 ELSE 0.3 END * pow(p - y, 2))", "pos", "p"),
}


def _metric_query(name: str, label: str, link: str):
    def run(spark, sf_dir):
        own = _orders(spark, sf_dir, label).select(F.expr(link).alias("p"), "y", F.lit(1.0).alias("w"))
        return own.agg(F.round(metrics.mean_loss(name, F.col("p"), F.col("y"), F.col("w"), {"level": 0.3, "expectile_alpha": 0.3}), 6).alias("value"))

    return run


for _name, (_sql, _label, _link) in _MV.items():
    _key = "metric_" + _name.replace("-", "_").replace("@", "_").replace(".", "_")
    query(f"WITH t AS (SELECT {_P} AS p, {_LABELS[_label]} AS y FROM orders), u AS (SELECT {_link} AS p, y FROM t) SELECT round({_sql}, 6) AS value FROM u", _key)(_metric_query(_name, _label, _link))

_SCORES = "SELECT CAST(o_custkey % 50 AS REAL) AS score, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders"


def _scored(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("cast(o_custkey % 50 as float) as score", "CASE WHEN o_orderstatus = 'F' THEN 1.0D ELSE 0.0D END AS y", "1.0D as w")


@query(f"""
WITH t AS ({_SCORES}), g AS (SELECT score, sum(y) AS tp, sum(1 - y) AS fp FROM t GROUP BY 1), c AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) AS tps FROM g)
SELECT round(CAST(sum(fp * (tps - tp / 2)) / (sum(tp) * sum(fp)) AS DOUBLE), 6) AS auc FROM c
""")
def metric_auc(spark, sf_dir):
    return metrics.auc(_scored(spark, sf_dir), "score", "y", "w").select(F.round("auc", 6).alias("auc"))


@query(f"""
WITH t AS ({_SCORES}), g AS (SELECT score, CAST(sum(y) AS DOUBLE) AS tp, CAST(sum(1 - y) AS DOUBLE) AS fp FROM t GROUP BY 1),
c AS (SELECT tp, fp, sum(tp) OVER w AS b, sum(tp) OVER w - tp AS a, sum(fp) OVER w - fp AS f0 FROM g WINDOW w AS (ORDER BY score DESC)),
k AS (SELECT *, 1 + fp / tp AS k, f0 - fp / tp * a AS m FROM c WHERE tp > 0)
SELECT round(sum(CASE WHEN m = 0 THEN tp / k ELSE tp / k - m / (k * k) * ln((k * b + m) / CASE WHEN k * a + m > 0 THEN k * a + m ELSE 1 END) END) / sum(tp), 6) AS aucpr FROM k
""")
def metric_aucpr(spark, sf_dir):
    return metrics.aucpr(_scored(spark, sf_dir), "score", "y", "w").select(F.round("aucpr", 6).alias("aucpr"))


_MC = f"WITH t AS (SELECT {_P} AS a, -{_P} AS b, 0.25 AS c, o_custkey % 3 AS y FROM orders)"


@query(_MC + " SELECT round(avg(-ln(exp(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END) / (exp(a) + exp(b) + exp(c)))), 5) AS mlogloss, round(avg(CASE WHEN CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END = y THEN 0.0 ELSE 1.0 END), 5) AS merror FROM t")
def metric_multiclass(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.array(F.expr(_P), -F.expr(_P), F.lit(0.25)).alias("m"), (F.col("o_custkey") % 3).alias("y"))
    return own.agg(*[F.round(F.avg(metrics.class_loss(n, F.col("m"), F.col("y"))), 5).alias(n) for n in ("mlogloss", "merror")])


# ---- ranking

_EV = "SELECT event_id, user_id, round(value, 1) AS score, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS y FROM events"
_RANKED = f"WITH t AS ({_EV}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) - 1 AS pos, row_number() OVER (PARTITION BY user_id ORDER BY y DESC, event_id) - 1 AS ideal FROM t)"


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "round(value, 1) as score", "CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS y")


@query(_RANKED + """, d AS (SELECT user_id, sum(CASE WHEN pos < 5 THEN (pow(2, y) - 1) / log2(pos + 2) ELSE 0 END) AS dcg, sum(CASE WHEN ideal < 5 THEN (pow(2, y) - 1) / log2(ideal + 2) ELSE 0 END) AS idcg FROM r GROUP BY 1)
SELECT user_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 1 END, 6) AS ndcg FROM d""")
def rank_ndcg(spark, sf_dir):
    return ranking.ndcg(_events(spark, sf_dir), "user_id", "score", "y", "event_id", 5).select("user_id", F.round("ndcg", 6).alias("ndcg"))


@query(_RANKED + """, h AS (SELECT *, CASE WHEN y > 0 THEN 1 ELSE 0 END AS hit, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS hits FROM r)
SELECT user_id, round(CASE WHEN sum(hit) > 0 THEN sum(CASE WHEN pos < 10 AND hit = 1 THEN hits / (pos + 1.0) ELSE 0 END) / least(sum(hit), 10) ELSE 1 END, 6) AS map FROM h GROUP BY 1""")
def rank_map(spark, sf_dir):
    return ranking.average_precision(_events(spark, sf_dir), "user_id", "score", "y", "event_id", 10).select("user_id", F.round("map", 6).alias("map"))


@query(_RANKED + " SELECT user_id, round(sum(CASE WHEN pos < 3 AND y > 0 THEN 1.0 ELSE 0 END) / least(3, count(*)), 6) AS pre FROM r GROUP BY 1")
def rank_precision(spark, sf_dir):
    return ranking.precision(_events(spark, sf_dir), "user_id", "score", "y", "event_id", 3).select("user_id", F.round("pre", 6).alias("pre"))


@query(f"""WITH t AS ({_EV}), p AS (SELECT a.user_id, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM t a JOIN t b ON a.user_id = b.user_id AND (a.y > b.y OR a.y = b.y AND a.event_id < b.event_id) GROUP BY 1)
SELECT user_id, round(auc, 6) AS auc FROM p WHERE user_id IN (SELECT user_id FROM t GROUP BY 1 HAVING count(*) >= 3)""")
def rank_group_auc(spark, sf_dir):
    return ranking.group_auc(_events(spark, sf_dir), "user_id", "score", "y", "event_id").select("user_id", F.round("auc", 6).alias("auc"))


@query(f"""WITH t AS ({_EV}), r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, max(CAST(score AS REAL)) OVER (PARTITION BY user_id) <> min(CAST(score AS REAL)) OVER (PARTITION BY user_id) AS spread,
  row_number() OVER (PARTITION BY user_id ORDER BY y DESC) - 1 AS ideal FROM t WINDOW w AS (PARTITION BY user_id ORDER BY CAST(score AS REAL) DESC, event_id)),
i AS (SELECT user_id, sum(CASE WHEN ideal < 32 THEN (pow(2, y) - 1) / log2(ideal + 2) ELSE 0 END) AS idcg FROM r GROUP BY 1),
p AS (SELECT a.user_id, CASE WHEN a.y > b.y THEN a.event_id ELSE b.event_id END AS hi, CASE WHEN a.y > b.y THEN b.event_id ELSE a.event_id END AS lo,
  CAST(CASE WHEN a.y > b.y THEN CAST(a.score AS REAL) - CAST(b.score AS REAL) ELSE CAST(b.score AS REAL) - CAST(a.score AS REAL) END AS DOUBLE) AS d,
  abs((pow(2, a.y) - pow(2, b.y)) * (1 / log2(a.pos + 2) - 1 / log2(b.pos + 2))) / idcg AS delta, a.spread
  FROM r a JOIN r b ON a.user_id = b.user_id AND a.pos < b.pos AND a.pos < 32 AND a.y <> b.y JOIN i ON i.user_id = a.user_id),
q AS (SELECT user_id, hi, lo, 1 / (1 + exp(-d)) AS sig, CASE WHEN spread THEN delta / (abs(d) + 0.01) ELSE delta END AS delta FROM p),
l AS (SELECT user_id, hi, lo, CAST(CAST((sig - 1) * delta AS REAL) AS DOUBLE) AS lam, CAST(CAST(greatest(sig * (1 - sig), 1e-16) * delta * 2 AS REAL) AS DOUBLE) AS hes FROM q),
z AS (SELECT user_id, -2 * sum(lam) AS total FROM l GROUP BY 1),
e AS (SELECT hi AS event_id, user_id, lam AS g, hes AS h FROM l UNION ALL SELECT lo, user_id, -lam, hes FROM l),
s AS (SELECT event_id, sum(g) * max(CASE WHEN total > 0 THEN log2(1 + total) / total ELSE 1 END) AS g, sum(h) * max(CASE WHEN total > 0 THEN log2(1 + total) / total ELSE 1 END) AS h FROM e JOIN z USING (user_id) GROUP BY 1)
SELECT event_id, round(coalesce(g, 0), 4) + 0.0 AS g, round(coalesce(h, 0), 4) + 0.0 AS h FROM t LEFT JOIN s USING (event_id)""")
def rank_lambda_gradients(spark, sf_dir):
    own = _events(spark, sf_dir).withColumn("m", F.col("score").cast("float"))
    return ranking.lambda_gradients(own, "user_id", "event_id", "m", "y", "rank:ndcg", {}).select("event_id", *[(F.round(F.col(f"{x}0").cast("double"), 4) + 0.0).alias(x) for x in "gh"])


# ---- a fixed model: scoring, leaves, importance, explanation


def fixed_model() -> Model:
    """Three small trees, one with categories, over columns of lineitem."""
    one = Tree([Node(cover=100, feat=0, cond=24.5, default_left=True, gain=8.0, left=1, right=2), Node(0.25, 60, parent=0), Node(cover=40, feat=1, cond=0.045, gain=3.0, left=3, right=4, parent=0), Node(-0.5, 30, parent=2), Node(0.75, 10, parent=2)])
    two = Tree([Node(cover=100, feat=2, cats=(1, 3), gain=2.0, left=1, right=2, default_left=False), Node(-0.125, 50, parent=0), Node(0.5, 50, parent=0)])
    three = Tree([Node(cover=100, feat=1, cond=0.075, gain=1.0, left=1, right=2, default_left=False), Node(0.0625, 80, parent=0), Node(-0.25, 20, parent=0)])
    return Model("binary:logistic", ["l_quantity", "disc", "l_linenumber"], [one, two, three], 0.5, [0.0], {}, {}, [False, False, True])


def _fixed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("disc", F.when(F.col("l_discount") != 0, F.col("l_discount")))


_LEAVES = """
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, CAST(nullif(l_discount, 0) AS REAL) AS disc FROM lineitem),
v AS (SELECT *, CASE WHEN l_quantity < 24.5 THEN 1 WHEN disc < CAST(0.045 AS REAL) THEN 3 ELSE 4 END AS a, CASE WHEN l_linenumber IN (1, 3) THEN 2 ELSE 1 END AS b, CASE WHEN disc < CAST(0.075 AS REAL) THEN 1 ELSE 2 END AS c FROM t),
m AS (SELECT *, CASE a WHEN 1 THEN 0.25 WHEN 3 THEN -0.5 ELSE 0.75 END + CASE b WHEN 2 THEN 0.5 ELSE -0.125 END + CASE c WHEN 1 THEN 0.0625 ELSE -0.25 END AS margin FROM v)
"""


@query(_LEAVES + "SELECT a AS leaf_0, b AS leaf_1, c AS leaf_2, count(*) AS n FROM v GROUP BY 1, 2, 3")
def score_leaf_ids(spark, sf_dir):
    got = scoring.with_leaves(_fixed(spark, sf_dir), fixed_model())
    return got.groupBy(*[F.get("leaves", F.lit(i)).alias(f"leaf_{i}") for i in range(3)]).agg(F.count(F.lit(1)).alias("n"))


@query(_LEAVES + "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-CAST(margin AS DOUBLE))), 5) AS prediction FROM m")
def score_fixed_model(spark, sf_dir):
    got = scoring.predict(_fixed(spark, sf_dir), fixed_model())
    return got.select("l_orderkey", "l_linenumber", F.round(F.col("prediction").cast("double"), 5).alias("prediction"))


@query(_LEAVES + "SELECT l_orderkey, l_linenumber, round(CAST(margin AS DOUBLE), 5) AS prediction FROM m")
def score_fixed_model_arrow(spark, sf_dir):
    got = scoring._walked(_fixed(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "disc"), fixed_model(), None, math.nan, "margins")
    return got.select("l_orderkey", "l_linenumber", F.round(F.get("margins", F.lit(0)).cast("double"), 5).alias("prediction"))


@query("SELECT * FROM (VALUES ('disc', 2.0, 2.0, 4.0, 70.0, 140.0), ('l_quantity', 1.0, 8.0, 8.0, 100.0, 100.0), ('l_linenumber', 1.0, 2.0, 2.0, 100.0, 100.0)) AS t(feature, weight, gain, total_gain, cover, total_cover)")
def importance(spark, sf_dir):
    m = fixed_model()
    kinds = ("weight", "gain", "total_gain", "cover", "total_cover")
    rows = [F.struct(F.lit(f).alias("feature"), *[F.lit(m.get_score(k)[f]).alias(k) for k in kinds]) for f in m.get_score()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(_LEAVES + """, s AS (SELECT *,
  CASE WHEN l_quantity < 24.5 THEN 0.25 - 0.075 ELSE -0.1875 - 0.075 END AS q,
  CASE a WHEN 1 THEN 0 WHEN 3 THEN -0.5 + 0.1875 ELSE 0.75 + 0.1875 END + CASE c WHEN 1 THEN 0.0625 ELSE -0.25 END - 0.0 AS d, CASE b WHEN 2 THEN 0.5 ELSE -0.125 END - 0.1875 AS n FROM v)
SELECT l_orderkey, l_linenumber, round(CAST(q AS DOUBLE), 5) AS c_quantity, round(CAST(d AS DOUBLE), 5) AS c_disc, round(CAST(n AS DOUBLE), 5) AS c_linenumber FROM s""")
def saabas_fixed_model(spark, sf_dir):
    got = explain.explain(_fixed(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "disc"), fixed_model(), "saabas")
    at = lambda i: F.round(F.get("contributions", F.lit(i)).cast("double"), 5)
    return got.select("l_orderkey", "l_linenumber", at(0).alias("c_quantity"), at(1).alias("c_disc"), at(2).alias("c_linenumber"))


@query(_LEAVES + "SELECT l_orderkey, l_linenumber, round(CAST(margin AS DOUBLE), 4) AS total FROM m")
def shap_sums_to_margin(spark, sf_dir):
    got = explain.explain(_fixed(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "disc"), fixed_model())
    total = F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    return got.select("l_orderkey", "l_linenumber", F.round(total, 4).alias("total"))


# ---- sampling


@query()
def sample_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(sampling.row_kept(F.col("o_orderkey"), 0.5, 7, 1)).select("o_orderkey")


@query()
def sample_gradient_based(spark, sf_dir):
    own = _orders(spark, sf_dir, "bin").select("o_orderkey", (F.col("p") - F.col("y")).alias("g0"), F.lit(1.0).alias("h0"))
    return sampling.gradient_based(own, "g0", "h0", "o_orderkey", 0.3, 7, 1).select("o_orderkey", F.round("g0", 5).alias("g"), F.round("h0", 5).alias("h"))


# ---- training


def _train_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_quantity", F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("disc"), "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query("""
WITH t AS (SELECT l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), m AS (SELECT avg(y) AS m, count(*) AS n FROM t),
k AS (SELECT q, sum(m - y) AS g, sum(m * (1 - m)) AS h FROM t, m GROUP BY 1), c AS (SELECT q, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER () AS g, sum(h) OVER () AS h, lead(q) OVER (ORDER BY q) AS nq FROM k WINDOW w AS (ORDER BY q ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) AS s FROM c WHERE nq IS NOT NULL AND hl >= 1 AND h - hl >= 1 ORDER BY s DESC, q LIMIT 1)
SELECT round((q + nq) / 2, 4) AS cond, round(-gl / (hl + 1) * 0.3, 4) AS left_value, round(-(g - gl) / (h - hl + 1) * 0.3, 4) AS right_value FROM b
""")
def train_stump(spark, sf_dir):
    m = train({"max_depth": 1}, _train_table(spark, sf_dir).select("l_quantity", "y"), label="y", num_boost_round=1)
    n = m.trees[0].nodes
    values = {"cond": n[0].cond, "left_value": n[1].value, "right_value": n[2].value} if len(n) > 1 else {"cond": math.nan, "left_value": n[0].value, "right_value": n[0].value}
    return spark.range(1).select(*[F.round(F.lit(v), 4).alias(k) for k, v in values.items()])


def _nodes(spark: SparkSession, m: Model) -> DataFrame:
    rows = [(i, j, n.feat, round(float(n.cond), 4), round(n.value, 4), round(n.cover, 1)) for i, t in enumerate(m.trees) for j, n in enumerate(t.nodes)]
    return spark.createDataFrame(rows, "tree int, node int, feat int, cond double, value double, cover double")


def _training(name: str, params: dict, rounds: int = 2, make=_train_table, sql: str | None = None, **options):
    def run(spark, sf_dir):
        return _nodes(spark, train(params, make(spark, sf_dir), num_boost_round=rounds, **options))

    query(sql, name)(run)


_BINARY = Grown(
    "SELECT l_quantity AS f0, nullif(l_discount, 0) AS f1, l_tax AS f2, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem",
    3, "1 / (1 + exp(-m)) - y", "1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m)))", "(SELECT ln(avg(y) / (1 - avg(y))) FROM t)",
)
_LIFE = Grown(
    "SELECT o_custkey % 11 AS f0, o_orderkey % 5 AS f1, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * (o_custkey % 40 + 1) AS y FROM orders",
    2, "exp(m) * a - CASE WHEN y > 0 THEN 1 ELSE 0 END", "exp(m) * a - exp(2 * m) * b", "0",
    extra=(
        "SELECT *, sum(exp(m)) OVER (ORDER BY abs(y) RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM {source}",
        "SELECT *, sum(CASE WHEN y > 0 THEN 1 / risk ELSE 0 END) OVER (ORDER BY abs(y) RANGE UNBOUNDED PRECEDING) AS a, sum(CASE WHEN y > 0 THEN 1 / risk / risk ELSE 0 END) OVER (ORDER BY abs(y) RANGE UNBOUNDED PRECEDING) AS b FROM {source}",
    ), added=("risk", "a", "b"),
)
_F = "(1 / (1 + exp(m - ln(y))))"
_BOUNDED = Grown(
    "SELECT o_custkey % 11 AS f0, o_orderkey % 5 AS f1, o_totalprice / 1000 AS y, o_orderstatus = 'F' AS seen FROM orders",
    2, f"CASE WHEN seen THEN 1 - 2 * {_F} ELSE -{_F} END", f"CASE WHEN seen THEN 2 ELSE 1 END * {_F} * (1 - {_F})", "ln(0.5)",
)


def _level(a: float) -> Grown:
    """Trees of one quantile: smoothed by the scale of the residuals, from the label's quantile on."""
    s = "(SELECT pow(avg(sqrt(abs(m - y))), 2) FROM {source})"
    x = f"((m - y) / (0.04 * {s}))"
    th = f"((exp(least(2 * {x}, 60)) - 1) / (exp(least(2 * {x}, 60)) + 1))"
    at = f"({a} * ((SELECT count(*) FROM t) + 1))"
    nth = "(SELECT y FROM (SELECT y, row_number() OVER (ORDER BY y) AS r FROM t) WHERE r = floor({x}) + {k})"
    low, high = nth.format(x=at, k=0), nth.format(x=at, k=1)
    return Grown("SELECT o_custkey % 11 AS f0, o_totalprice / 100000 AS y FROM orders", 1, f"0.5 * {s} * ({th} + 1 - 2 * {a})", f"12.5 * greatest(CASE WHEN {x} = 0 THEN 1 ELSE {th} / {x} END, 3e-4)", f"{low} + ({at} - floor({at})) * ({high} - {low})")


def _rank_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id", "value", "event_id % 7 as a", "CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS y", "event_id")


def _survival_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey % 11 as a", "o_orderkey % 5 as b", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * (o_custkey % 40 + 1) as t")


def _bounds_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey % 11 as a", "o_orderkey % 5 as b", "o_totalprice / 1000 as lo", "CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 ELSE double('Infinity') END as hi")


def _classes_table(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    wide = len(e.first()["embedding"])
    return e.select(*[F.get("embedding", F.lit(i)).alias(f"v{i}") for i in range(wide)], F.col("label").alias("y"))


def _category_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderpriority", "o_custkey % 11 as a", "o_totalprice / 100000 as y", "o_orderkey")


_training("train_depthwise", {"max_depth": 3}, label="y", sql=nodes_sql([_BINARY], "depthwise", 3, 2))
_training("train_lossguide", {"grow_policy": "lossguide", "max_depth": 0, "max_leaves": 5}, label="y", sql=nodes_sql([_BINARY], "lossguide", 4, 2))
_training("train_symmetric", {"grow_policy": "symmetric", "max_depth": 2}, label="y", sql=nodes_sql([_BINARY], "symmetric", 2, 2))
_training("train_constrained", {"max_depth": 3, "monotone_constraints": {"l_quantity": 1}, "interaction_constraints": [["disc", "l_tax"]], "subsample": 0.8, "colsample_bynode": 0.7}, label="y")
_training("train_multiclass", {"objective": "multi:softprob", "num_class": 10, "max_depth": 2, "max_bin": 32}, make=_classes_table, label="y")
_training("train_quantiles", {"objective": "reg:quantileerror", "quantile_alpha": [0.1, 0.9], "max_depth": 2}, make=_category_table, label="y", features=["a"], sql=nodes_sql([_level(0.1), _level(0.9)], "depthwise", 2, 2))
_training("train_categories", {"objective": "reg:gamma", "max_depth": 2, "enable_categorical": True}, make=_category_table, label="y", row_id="o_orderkey")
_training("train_ranking", {"objective": "rank:ndcg", "max_depth": 2, "max_bin": 32}, make=_rank_table, label="y", qid="user_id", row_id="event_id")
_training("train_cox", {"objective": "survival:cox", "max_depth": 2}, make=_survival_table, label="t", sql=nodes_sql([_LIFE], "depthwise", 2, 2))
_training("train_aft", {"objective": "survival:aft", "aft_loss_distribution": "logistic", "max_depth": 2}, make=_bounds_table, label_lower_bound="lo", label_upper_bound="hi", sql=nodes_sql([_BOUNDED], "depthwise", 2, 2))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train three rounds and score the same table."""
    data = _train_table(spark, sf_dir)
    model = train({"max_depth": 3}, data, label="y", num_boost_round=3)
    return scoring.predict(data, model)


from . import api_queries  # noqa: E402, F401  (registers its queries)
