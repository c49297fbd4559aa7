"""Queries of sources, sinks, models and the training interface, with SQL for the same results."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, objectives
from ..operators import binning, explain, histogram, ranking, scoring
from ..sources import inputs, shared, sinks
from .estimators import TreeClassifier, TreeRegressor
from .model import Model, Node, Tree
from .queries import _LEAVES, _fixed, fixed_model, query, table
from .train import CustomMetric, CustomObjective, train


def _folder(spark, name: str) -> str:
    return f"{shared.folder(spark)}/boscage-query-{name}-{uuid.uuid4().hex}"


def _sums(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(F.col(c).cast("double")), 2).alias(c) for c in columns])


# ---- sources


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS o_totalprice, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS kinds, count(o_custkey) AS present FROM (SELECT o_totalprice, o_orderpriority, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS o_custkey FROM orders)")
def source_csv_types(spark, sf_dir):
    """A table written as compressed CSV files and read again: numbers, declared text, empty fields."""
    path = _folder(spark, "csv") + ".csv"
    own = table(spark, sf_dir, "orders").selectExpr("o_totalprice", "o_orderpriority", "CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS o_custkey")
    own.repartition(3).write.option("header", True).option("compression", "gzip").csv(path)
    got = inputs.read(spark, path, text_columns=["o_orderpriority"])
    return got.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("o_totalprice"), F.countDistinct("o_orderpriority").alias("kinds"), F.count("o_custkey").alias("present"))


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_tax), 2) AS l_tax FROM lineitem")
def source_parquet_pattern(spark, sf_dir):
    """Several Parquet files by a pattern in the last part of a path."""
    path = _folder(spark, "parts")
    own = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_tax")
    for i in range(3):
        own.where(F.pmod(F.xxhash64("l_extendedprice", "l_tax"), F.lit(3)) == i).write.parquet(f"{path}/part-{i}.parquet")
    return _sums(inputs.read(spark, f"{path}/part-?.parquet"), "l_extendedprice", "l_tax")


@query("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS c_acctbal, round(sum(c_nationkey), 2) AS c_nationkey FROM customer")
def source_arrow_table(spark, sf_dir):
    """An Arrow table with a dictionary column, as a library user hands it over."""
    held = table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment").toArrow()
    held = held.set_column(2, "c_mktsegment", held.column(2).dictionary_encode())
    return _sums(inputs.read(spark, held), "c_acctbal", "c_nationkey")


@query("SELECT r_regionkey, r_name FROM region")
def source_pandas_categories(spark, sf_dir):
    own = table(spark, sf_dir, "region").select("r_regionkey", "r_name").toPandas()
    return inputs.read(spark, own.assign(r_name=own["r_name"].astype("category")))


# ---- scoring interface


@query(_LEAVES + "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-CAST(margin AS DOUBLE))), 5) AS prediction FROM m")
def score_named_binding(spark, sf_dir):
    """Columns are bound by name: others beside them and another order change nothing."""
    own = _fixed(spark, sf_dir).select(F.lit("x").alias("other"), "disc", "l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    return scoring.predict(own, fixed_model()).select("l_orderkey", "l_linenumber", F.round(F.col("prediction").cast("double"), 5).alias("prediction"))


@query(_LEAVES + "SELECT round(1 / (1 + exp(-CAST(margin AS DOUBLE))), 5) AS prediction, count(*) AS n FROM m GROUP BY 1")
def sink_predictions(spark, sf_dir):
    """Files in, predictions as Parquet out, read again."""
    path = _folder(spark, "predictions")
    source = _folder(spark, "features") + ".parquet"
    _fixed(spark, sf_dir).select("l_quantity", "disc", "l_linenumber").write.parquet(source)
    sinks.predict_files(spark, source, fixed_model(), path)
    return spark.read.parquet(path).groupBy(F.round(F.col("prediction").cast("double"), 5).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query(_LEAVES + "SELECT l_orderkey, l_linenumber, round(CAST(margin AS DOUBLE), 5) AS prediction FROM m")
def model_file_round_trip(spark, sf_dir):
    """Scores of a model that was written to the shared folder and read again."""
    path = _folder(spark, "model") + ".json"
    fixed_model().save_model(path)
    got = scoring.predict(_fixed(spark, sf_dir), Model.load_model(path), output_margin=True)
    return got.select("l_orderkey", "l_linenumber", F.round(F.col("prediction").cast("double"), 5).alias("prediction"))


@query(_LEAVES + """SELECT l_orderkey, l_linenumber,
  round(CAST(CASE b WHEN 2 THEN 0.5 ELSE -0.125 END + CASE c WHEN 1 THEN 0.0625 ELSE -0.25 END AS DOUBLE), 5) AS last_two, round(CAST(CASE a WHEN 1 THEN 0.25 WHEN 3 THEN -0.5 ELSE 0.75 END AS DOUBLE), 5) AS first_one,
  round(CAST(margin + l_linenumber AS DOUBLE), 5) AS from_margin FROM m""")
def score_parts_of_a_model(spark, sf_dir):
    """A range of rounds, a number of trees, and start margins in place of the intercept."""
    m = fixed_model()
    own = _fixed(spark, sf_dir).withColumn("start", F.col("l_linenumber").cast("float"))
    got = scoring.predict(own, m, output_margin=True, rounds=(1, 3), column="last_two")
    got = scoring.predict(got, m, output_margin=True, n_trees=1, column="first_one")
    got = scoring.predict(got, m, output_margin=True, base_margin=["start"], column="from_margin")
    return got.select("l_orderkey", "l_linenumber", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("last_two", "first_one", "from_margin")])


@query(_LEAVES + "SELECT l_orderkey, l_linenumber, round(exp(CAST(margin AS DOUBLE)), 4) AS as_exp, round(CAST(margin AS DOUBLE), 5) AS as_is FROM m")
def score_named_links(spark, sf_dir):
    """A link by name, and the strict shape: an array for one output too."""
    got = scoring.predict(_fixed(spark, sf_dir), fixed_model(), link="exp", column="as_exp")
    got = scoring.predict(got, fixed_model(), link="identity", strict_shape=True, column="as_is")
    return got.select("l_orderkey", "l_linenumber", F.round(F.col("as_exp").cast("double"), 4).alias("as_exp"), F.round(F.get("as_is", F.lit(0)).cast("double"), 5).alias("as_is"))


def _classes() -> Model:
    leaf = lambda v: Node(v, 1.0, parent=0)
    stump = lambda f, c, a, b: Tree([Node(cover=2.0, feat=f, cond=c, gain=1.0, left=1, right=2, default_left=True), leaf(a), leaf(b)])
    trees = [stump(0, 25.0, 0.5, -0.25), stump(1, 0.05, 0.125, 0.25), stump(0, 10.0, -0.5, 0.75)]
    return Model("multi:softprob", ["l_quantity", "disc"], trees, 0.5, [0.0, 0.25, -0.25], {"num_class": 3}, {}, [False, False])


_CLASSES = """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 25 THEN 0.5 ELSE -0.25 END AS a,
  0.25 + CASE WHEN nullif(l_discount, 0) IS NULL OR CAST(l_discount AS REAL) < CAST(0.05 AS REAL) THEN 0.125 ELSE 0.25 END AS b, -0.25 + CASE WHEN l_quantity < 10 THEN -0.5 ELSE 0.75 END AS c FROM lineitem),
e AS (SELECT *, exp(CAST(a AS DOUBLE)) AS x, exp(CAST(b AS DOUBLE)) AS y, exp(CAST(c AS DOUBLE)) AS z FROM t)
"""


@query(_CLASSES + "SELECT l_orderkey, l_linenumber, round(x / (x + y + z), 4) AS p0, round(y / (x + y + z), 4) AS p1, round(z / (x + y + z), 4) AS p2, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS best FROM e")
def score_classes(spark, sf_dir):
    m = _classes()
    got = scoring.predict(_fixed(spark, sf_dir), m, column="p")
    best = Model("multi:softmax", m.features, m.trees, m.base_score, m.base_margins, m.params, {}, m.categorical)
    got = scoring.predict(got, best, column="best")
    return got.select("l_orderkey", "l_linenumber", *[F.round(F.get("p", F.lit(k)).cast("double"), 4).alias(f"p{k}") for k in range(3)], F.col("best").cast("int").alias("best"))


@query(_CLASSES + "SELECT round(CAST(b AS DOUBLE), 5) AS margin, count(*) AS n FROM e GROUP BY 1")
def score_class_view(spark, sf_dir):
    """One class of a model of several as a model of its own."""
    m = _classes().class_view(1)
    m.objective = "reg:squarederror"
    got = scoring.predict(_fixed(spark, sf_dir), m, output_margin=True)
    return got.groupBy(F.round(F.col("prediction").cast("double"), 5).alias("margin")).agg(F.count(F.lit(1)).alias("n"))


@query(_LEAVES + "SELECT l_orderkey, l_linenumber, round(CAST(margin AS DOUBLE), 4) AS total FROM m")
def shap_interactions_sum_to_margin(spark, sf_dir):
    own = _fixed(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "disc")
    total = F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    return explain.explain(own, fixed_model(), "interactions").select("l_orderkey", "l_linenumber", F.round(total, 4).alias("total"))


@query(_LEAVES + "SELECT l_orderkey, l_linenumber, round(CAST(l_linenumber + CASE b WHEN 2 THEN 0.5 ELSE -0.125 END AS DOUBLE), 4) AS total FROM m")
def shap_of_some_rounds(spark, sf_dir):
    own = _fixed(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "disc", F.col("l_linenumber").cast("float").alias("start"))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    return explain.explain(own, fixed_model(), rounds=(1, 2), base_margin=["start"]).select("l_orderkey", "l_linenumber", F.round(total, 4).alias("total"))


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS at, CASE WHEN c_acctbal < 1000 THEN 1.0 ELSE 2.0 END AS margin FROM customer")
def score_array(spark, sf_dir):
    """A dense array on the driver."""
    m = Model("reg:squarederror", ["x"], [Tree([Node(cover=2.0, feat=0, cond=1000.0, left=1, right=2), Node(1.0, 1.0, parent=0), Node(2.0, 1.0, parent=0)])], 0.0, [0.0], {}, {}, [False])
    x = np.array([[r[0]] for r in table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_acctbal").collect()], np.float64)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(scoring.predict_array(x, m)[:, 0])], "at long, margin double")


# ---- categories, weights and start values


@query("SELECT c_custkey, CAST(k AS INTEGER) AS code FROM customer JOIN (SELECT c_name AS name, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS k FROM customer GROUP BY 1) USING (name) ".replace("USING (name)", "ON c_name = name"))
def cat_lookup_many_names(spark, sf_dir):
    """Thousands of names by first appearance, found again through maps by checksum, or by a join where they are too many for maps."""
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return binning.with_codes(own, "c_name", "c_custkey").select("c_custkey", "code")


@query("WITH v AS (SELECT CAST(o_totalprice AS REAL) AS x FROM orders), c AS (SELECT CAST(1000 + 100 * i AS REAL) AS cut FROM range(1200) t(i)) SELECT x, count(cut) AS n, 0 AS dummy FROM (SELECT DISTINCT x FROM v) LEFT JOIN c ON cut <= x GROUP BY x".replace("x, count(cut) AS n, 0 AS dummy", "round(CAST(x AS DOUBLE), 2) AS x, CAST(count(cut) AS INTEGER) AS bin"))
def bin_assign_wide(spark, sf_dir):
    """Bins among 1,200 cuts, by halving steps over one literal."""
    own = table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("float").alias("x")).distinct()
    return own.select(F.round(F.col("x").cast("double"), 2).alias("x"), binning.bin_of(F.col("x"), [1000.0 + 100 * i for i in range(1200)]).alias("bin"))


@query("""WITH v AS (SELECT CAST(o_totalprice AS REAL) AS x, CAST(count(*) AS DOUBLE) AS w FROM orders GROUP BY 1), r AS (SELECT x, sum(w) OVER (ORDER BY x) - w / 2 AS mid, sum(w) OVER () AS total FROM v),
t AS (SELECT least(floor(mid * 64 / total), 63) AS k, min(x) AS cut FROM r GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY cut) - 1 AS INTEGER) AS idx, round(CAST(cut AS DOUBLE), 3) AS cut FROM (SELECT DISTINCT cut FROM t WHERE k > 0)""")
def cuts_by_ranges(spark, sf_dir):
    """Exact cuts of a feature whose values are cut into ranges."""
    own = binning.value_weights(table(spark, sf_dir, "orders"), ["o_totalprice"])
    return binning.cuts(own, 64, whole=500, range_=400).select(F.col("idx").cast("int").alias("idx"), F.round(F.col("cut").cast("double"), 3).alias("cut"))


@query("SELECT feat, n, round(total, 2) AS total FROM (SELECT 0 AS feat, count(DISTINCT l_quantity) AS n, sum(l_tax) AS total FROM lineitem WHERE l_tax > 0 UNION ALL SELECT 1, count(DISTINCT l_linenumber), sum(l_tax) FROM lineitem WHERE l_tax > 0)")
def value_weights_by_row_weight(spark, sf_dir):
    """Distinct values with the weights of their rows; rows of weight 0 count for nothing."""
    got = binning.value_weights(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber"], F.col("l_tax"))
    return got.groupBy("feat").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 2).alias("total"))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) // 25 AS q FROM events")
def ranking_group_sizes(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id", "event_id")
    n = own.count()
    sizes = [25] * (n // 25) + ([n % 25] if n % 25 else [])
    return ranking.with_sizes(own, sizes, "event_id", "q").select("user_id", "q")


@query("""WITH t AS (SELECT l_orderkey % 4 AS node, CASE WHEN l_discount <> 0 THEN CAST(l_discount * 100 AS INTEGER) END AS b0, CAST(l_tax * 100 AS INTEGER) AS b1, CAST(l_quantity AS BIGINT) AS g, CAST(l_linenumber AS BIGINT) AS h FROM lineitem),
u AS (SELECT node, 0 AS feat, b0 AS bin, g, h FROM t UNION ALL SELECT node, 1, b1, g, h FROM t UNION ALL SELECT node, -1, 0, g, h FROM t)
SELECT CAST(node + 3 AS INTEGER) AS node, feat, bin, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h FROM u WHERE bin IS NOT NULL GROUP BY 1, 2, 3""")
def hist_by_batches(spark, sf_dir):
    """Histograms of four leaves of a tree over a binned column, by dense sums per task."""
    tree = Tree([Node(feat=2, bin=2, left=1, right=2), Node(feat=2, bin=1, left=3, right=4, parent=0), Node(feat=2, bin=3, left=5, right=6, parent=0), *[Node(parent=p) for p in (1, 1, 2, 2)]])
    own = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_discount") != 0, F.round(F.col("l_discount") * 100).cast("int")).alias("b0"), F.round(F.col("l_tax") * 100).cast("int").alias("b1"), F.pmod("l_orderkey", F.lit(4)).cast("int").alias("b2"),
        F.col("l_quantity").cast("long").alias("gq0"), F.col("l_linenumber").cast("long").alias("hq0"),
    )
    got = histogram.by_batches(own, [tree], {0: [3, 4, 5, 6]}, [0, 1], [16, 16, 4])
    return got.select("node", "feat", "bin", "g", "h")


# ---- training interface: stumps whose sums SQL can make


def _stump_sql(y: str, g: str, h: str, start: str, eta: str = "0.3", where: str = "", out: str = "") -> str:
    """One split of l_quantity from the sums of gradients by value."""
    return f"""WITH t AS (SELECT l_quantity AS q, l_linenumber AS w, {y} AS y FROM lineitem {where}), s AS (SELECT {start} AS m FROM t),
k AS (SELECT q, sum({g}) AS g, sum({h}) AS h FROM t, s GROUP BY 1), c AS (SELECT q, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER () AS g, sum(h) OVER () AS h, lead(q) OVER (ORDER BY q) AS nq FROM k WINDOW w AS (ORDER BY q ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) AS s FROM c WHERE nq IS NOT NULL AND hl >= 1 AND h - hl >= 1 ORDER BY s DESC, q LIMIT 1), r AS (SELECT (q + nq) / 2 AS cond, -gl / (hl + 1) * {eta} AS lv, -(g - gl) / (h - hl + 1) * {eta} AS rv FROM b)
""" + (out or "SELECT round(cond, 4) AS cond, round(lv, 4) AS left_value, round(rv, 4) AS right_value FROM r")


def _fit_stump(p: dict, own: DataFrame, **more) -> Model:
    """One round.  Training makes no split where none gains anything; the SQL's is the best one even then."""
    m = train(p, own, label="y", num_boost_round=1, **more)
    return train(p, own, label="y", num_boost_round=1, least_gain=-math.inf, **more) if m.trees[-1].nodes[0].leaf else m


def _stump(spark, m: Model) -> DataFrame:
    """A row, or none where no split is allowed at all."""
    n = m.trees[-1].nodes
    if n[0].leaf:
        return spark.createDataFrame([], "cond double, left_value double, right_value double")
    return spark.createDataFrame([(round(n[0].cond, 4), round(n[1].value, 4), round(n[2].value, 4))], "cond double, left_value double, right_value double")


def _quantities(spark, sf_dir, y: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_quantity", F.expr(y).cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("w"))


_PRICE = "l_extendedprice / 1000"


@query(_stump_sql(_PRICE, "m - y", "1", "avg(y)"))
def train_stump_squared(spark, sf_dir):
    own = _quantities(spark, sf_dir, _PRICE).drop("w")
    return _stump(spark, _fit_stump({"max_depth": 1, "objective": "reg:squarederror"}, own))


@query(_stump_sql(_PRICE, "w * (m - y)", "w", "sum(w * y) / sum(w)"))
def train_stump_weighted(spark, sf_dir):
    own = _quantities(spark, sf_dir, _PRICE)
    return _stump(spark, _fit_stump({"max_depth": 1, "objective": "reg:squarederror"}, own, weight="w"))


@query(_stump_sql(_PRICE, "m - y", "1", "min(52.5)", eta="0.5"))
def train_stump_custom(spark, sf_dir):
    """A custom objective and a given start value."""
    own = _quantities(spark, sf_dir, _PRICE).drop("w")
    fn = CustomObjective("squares", lambda p, y: (p - y, np.ones(len(y))))
    return _stump(spark, _fit_stump({"max_depth": 1, "objective": "reg:squarederror", "base_score": 52.5, "eta": 0.5}, own, custom_objective=fn))


@query(_stump_sql("CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END", "CASE WHEN y = 1 THEN 3 ELSE 1 END * (0.25 - y)", "CASE WHEN y = 1 THEN 3 ELSE 1 END * 0.25 * 0.75", "min(0)"))
def train_stump_positive_weight(spark, sf_dir):
    """scale_pos_weight, and a start value through the logit."""
    own = _quantities(spark, sf_dir, "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END").drop("w")
    return _stump(spark, _fit_stump({"max_depth": 1, "scale_pos_weight": 3.0, "base_score": 0.25}, own))


@query(_stump_sql(_PRICE, "m - y", "1", "avg(y)", out="SELECT 1 AS tables, round(cond, 4) AS cond, round(lv, 4) AS left_value, round(rv, 4) AS right_value FROM r"))
def train_cached(spark, sf_dir):
    """Two trainings over one binned table in a folder of the user's."""
    path = _folder(spark, "cache")
    p = {"max_depth": 1, "objective": "reg:squarederror", "cache_path": path}
    own = _quantities(spark, sf_dir, _PRICE).drop("w")
    _fit_stump(p, own)
    got = _stump(spark, _fit_stump(p, own))
    return got.withColumn("tables", F.lit(len(inputs._listing(spark, path))))


@query(_stump_sql(_PRICE, "m - y", "1", "avg(y)", out=", e AS (SELECT avg(pow(y - m - CASE WHEN q < cond THEN lv ELSE rv END, 2)) AS mse FROM t, s, r) SELECT 0 AS round, round(sqrt(mse), 3) AS rmse FROM e"))
def train_history(spark, sf_dir):
    """The history of an evaluation table that is the training table itself."""
    own, history = _quantities(spark, sf_dir, _PRICE).drop("w"), {}
    train({"max_depth": 1, "objective": "reg:squarederror"}, own, label="y", num_boost_round=1, evals=[(own, "t")], evals_result=history)
    return spark.createDataFrame([(i, round(v, 3)) for i, v in enumerate(history["t"]["rmse"])], "round int, rmse double")


@query("SELECT 2 AS rounds, 1 AS stopped_by_callback, 0 AS best")
def train_early_stopping(spark, sf_dir):
    """A metric that never improves stops after one more round; a callback may stop too."""
    own, history = _quantities(spark, sf_dir, _PRICE).drop("w"), {}
    p = {"max_depth": 1, "objective": "reg:squarederror"}
    a = train(p, own, label="y", num_boost_round=5, evals=[(own, "t")], evals_result=history, early_stopping_rounds=1, custom_metrics=[CustomMetric("flat", lambda df: 1.0)])
    b = train(p, own, label="y", num_boost_round=5, callbacks=[lambda i, line: False])
    return spark.createDataFrame([(len(history["t"]["flat"]), b.num_trees, a.best_iteration)], "rounds int, stopped_by_callback int, best int")


@query(_stump_sql(_PRICE, "m - y", "1", "avg(y)", out=", j AS (SELECT q, sum(m + CASE WHEN q < cond THEN lv ELSE rv END - y) AS g, count(*) AS h FROM t, s, r GROUP BY 1), d AS (SELECT q, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER () AS g, sum(h) OVER () AS h, lead(q) OVER (ORDER BY q) AS nq FROM j WINDOW w AS (ORDER BY q ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) AS s FROM d WHERE nq IS NOT NULL AND hl >= 1 AND h - hl >= 1 ORDER BY s DESC, q LIMIT 1) SELECT round((q + nq) / 2, 4) AS cond, round(-gl / (hl + 1) * 0.3, 4) AS left_value, round(-(g - gl) / (h - hl + 1) * 0.3, 4) AS right_value FROM f"))
def train_continued(spark, sf_dir):
    """A second round on a model of one."""
    own, p = _quantities(spark, sf_dir, _PRICE).drop("w"), {"max_depth": 1, "objective": "reg:squarederror"}
    first = _fit_stump(p, own)
    return _stump(spark, _fit_stump(p, own, init_model=first))


@query(_stump_sql(_PRICE, "m - y", "1", "avg(y)", out="SELECT q AS l_quantity, round(m + CASE WHEN q < cond THEN lv ELSE rv END, 3) AS prediction, count(*) AS n FROM t, s, r GROUP BY 1, 2"))
def estimator_regressor(spark, sf_dir):
    own = _quantities(spark, sf_dir, _PRICE).drop("w")
    fitted = TreeRegressor(n_estimators=1, label="y", max_depth=1).fit(own)
    return fitted.predict(own).groupBy("l_quantity", F.round(F.col("prediction").cast("double"), 3).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT l_linestatus AS y, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS x, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT y AS prediction, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def estimator_classifier(spark, sf_dir):
    """Classes that one feature tells apart come back under their own names."""
    own = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("x"), "l_linestatus")
    fitted = TreeClassifier(n_estimators=2, label="l_linestatus", max_depth=1, base_score=0.5).fit(own)
    return fitted.predict(own).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


# ---- metrics through the evaluation of a table


@query("""WITH t AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CAST(CAST(l_discount * 10 - l_tax * 10 AS REAL) AS DOUBLE) AS m, l_linenumber AS w FROM lineitem), p AS (SELECT *, 1 / (1 + exp(-m)) AS p FROM t)
SELECT round(sqrt(sum(w * pow(p - y, 2)) / sum(w)), 4) AS rmse, round(sum(w * abs(p - y)) / sum(w), 4) AS mae, round(sum(w * -(y * ln(p) + (1 - y) * ln(1 - p))) / sum(w), 4) AS logloss, round(sum(w * CASE WHEN p > 0.6 THEN 1 - y ELSE y END) / sum(w), 4) AS error_at FROM p""")
def evaluate_table(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_discount") * 10 - F.col("l_tax") * 10).cast("float").alias("m"), F.col("l_linenumber").cast("double").alias("w"))
    got = metrics.evaluate(own, ["rmse", "mae", "logloss", "error@0.6"], "binary:logistic", ["m"], "y", "w", {})
    return spark.createDataFrame([(round(got["rmse"], 4), round(got["mae"], 4), round(got["logloss"], 4), round(got["error@0.6"], 4))], "rmse double, mae double, logloss double, error_at double")


@query("""WITH t AS (SELECT user_id, event_id, CAST(round(value, 1) AS REAL) AS s, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS y, user_id % 3 + 1 AS w FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) - 1 AS pos, row_number() OVER (PARTITION BY user_id ORDER BY y DESC, event_id) - 1 AS ideal FROM t),
d AS (SELECT user_id, max(w) AS w, sum(CASE WHEN pos < 5 THEN (pow(2, y) - 1) / log2(pos + 2) ELSE 0 END) AS dcg, sum(CASE WHEN ideal < 5 THEN (pow(2, y) - 1) / log2(ideal + 2) ELSE 0 END) AS idcg FROM r GROUP BY 1),
p AS (SELECT a.user_id, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS auc FROM t a JOIN t b ON a.user_id = b.user_id AND (a.y > b.y OR a.y = b.y AND a.event_id < b.event_id) GROUP BY 1)
SELECT round(sum(CASE WHEN idcg > 0 THEN w * dcg / idcg ELSE 1 END) / sum(w), 5) AS ndcg, (SELECT round(avg(auc), 5) FROM p WHERE user_id IN (SELECT user_id FROM t GROUP BY 1 HAVING count(*) >= 3)) AS auc FROM d""")
def evaluate_ranking(spark, sf_dir):
    """Ranking metrics by the weights of the queries."""
    own = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "cast(round(value, 1) as float) as m", "CASE event_type WHEN 'purchase' THEN 2.0D WHEN 'click' THEN 1.0D ELSE 0.0D END AS y", "cast(user_id % 3 + 1 as double) as w")
    got = metrics.evaluate(own, ["ndcg@5", "auc"], "rank:ndcg", ["m"], "y", "w", {}, "user_id", "event_id")
    return spark.createDataFrame([(round(got["ndcg@5"], 5), round(got["auc"], 5))], "ndcg double, auc double")


@query("""WITH t AS (SELECT o_totalprice / 1000 AS y, CAST(CAST(o_custkey % 40 + 60 AS REAL) AS DOUBLE) AS a, CAST(CAST(o_custkey % 40 + 90 AS REAL) AS DOUBLE) AS b FROM orders)
SELECT round(avg((CASE WHEN y >= a THEN 0.2 * (y - a) ELSE 0.8 * (a - y) END + CASE WHEN y >= b THEN 0.9 * (y - b) ELSE 0.1 * (b - y) END) / 2), 4) AS quantile FROM t""")
def evaluate_quantiles(spark, sf_dir):
    own = table(spark, sf_dir, "orders").selectExpr("o_totalprice / 1000 as y", "cast(o_custkey % 40 + 60 as float) as m0", "cast(o_custkey % 40 + 90 as float) as m1", "1.0D as w")
    got = metrics.evaluate(own, ["quantile"], "reg:quantileerror", ["m0", "m1"], "y", "w", {"quantile_alpha": [0.2, 0.9]})
    return spark.createDataFrame([(round(got["quantile"], 4),)], "quantile double")


@query("SELECT CAST(0.5 AS DOUBLE) AS p, round(ln(0.25 / 0.75), 5) AS logit, round(ln(2.5), 5) AS log")
def start_margins(spark, sf_dir):
    """Start values through the links of their objectives."""
    rows = [(float(objectives.to_margin("reg:squarederror", 0.5)), round(float(objectives.to_margin("binary:logistic", 0.25)), 5), round(float(objectives.to_margin("count:poisson", 2.5)), 5))]
    return spark.createDataFrame(rows, "p double, logit double, log double")


@query("SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0")
def source_missing_sentinel(spark, sf_dir):
    """Null, NaN and a sentinel are one thing."""
    v = F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice")).otherwise(F.when(F.col("o_custkey") % 2 == 0, F.lit(-999.0)).otherwise(F.lit(math.nan)))
    own = table(spark, sf_dir, "orders").withColumn("v", v).withColumn("f", binning.as_feature("v", -999.0))
    return own.agg(F.round(F.sum(F.when(F.col("f").isNotNull(), F.col("v"))), 2).alias("total"), F.count("f").alias("n"))
