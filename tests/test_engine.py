"""The tree engine against brute force and its own invariants."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boscage.functions import metrics, objectives
from boscage.functions.params import interactions, normalise, per_feature
from boscage.operators import binning, explain, ranking, sampling, scoring, splits, survival
from boscage.plans.estimators import TreeClassifier, TreeRanker, TreeRegressor
from boscage.plans.model import Model
from boscage.plans.queries import fixed_model
from boscage.plans.train import CustomMetric, CustomObjective, train
from boscage.sources import inputs
from boscage.sources.sinks import predict_to_parquet


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 400
    f = rng.integers(0, 8, (n, 3)).astype(float)
    y = ((f[:, 0] > 3) ^ (f[:, 1] > 5)).astype(float)
    rows = [(i, float(a) if i % 9 else None, float(b), float(c), float(t), float(1 + i % 3), i % 7) for i, (a, b, c), t in zip(range(n), f, y, strict=True)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, w double, q long").repartition(3).cache()


X = ["a", "b", "c"]
P = {"max_depth": 3, "eta": 0.5}


def nodes(m):
    return json.dumps(m.to_dict()["learner"]["gradient_booster"])


def brute_force(pdf, rounds, depth, eta, lam=1.0, objective="logistic"):
    """Exact greedy trees over raw values, float64; missing tried on both sides."""
    x, y = pdf[X].to_numpy(float), pdf["y"].to_numpy(float)
    m = np.full(len(y), math.log(y.mean() / (1 - y.mean())) if objective == "logistic" else y.mean())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m)) if objective == "logistic" else m
        g, h = p - y, p * (1 - p) if objective == "logistic" else np.ones(len(y))
        out = np.zeros(len(y))

        def grow(rows, d):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if d < depth:
                for f in range(3):
                    v = x[rows, f]
                    some = np.unique(v[~np.isnan(v)])
                    for left_missing in (False, True) if np.isnan(v).any() else (False,):
                        cuts = (some[:-1] + some[1:]) / 2
                        cuts = np.append(cuts, np.inf) if np.isnan(v).any() and not left_missing else cuts
                        for c in cuts if not left_missing else cuts[::-1]:
                            left = np.where(np.isnan(v), left_missing, v < c)
                            gl, hl = g[rows][left].sum(), h[rows][left].sum()
                            if hl < 1 or hs - hl < 1:
                                continue
                            gain = gl**2 / (hl + lam) + (gs - gl) ** 2 / (hs - hl + lam) - gs**2 / (hs + lam)
                            if gain > best[0] * (1 + 1e-6):
                                best = (gain, left)
            if best[1] is None:
                out[rows] = -gs / (hs + lam) * eta
            else:
                grow(rows[best[1]], d + 1)
                grow(rows[~best[1]], d + 1)

        grow(np.arange(len(y)), 0)
        m = m + out
    return m


def test_training_equals_brute_force(data):
    m = train(P, data, label="y", features=X, num_boost_round=3, row_id="id")
    got = scoring.predict(data, m, output_margin=True).orderBy("id").toPandas()
    want = brute_force(got, 3, 3, 0.5)
    assert np.allclose(got["prediction"], want, atol=2e-4)


def test_partitions_do_not_matter(data):
    a = train(P, data, label="y", features=X, num_boost_round=2, row_id="id")
    b = train(P, data.repartition(7), label="y", features=X, num_boost_round=2, row_id="id")
    assert nodes(a) == nodes(b)


def test_weights_and_missing(data):
    ones = data.withColumn("one", F.lit(1.0))
    base = train(P, data, label="y", features=X, num_boost_round=1, row_id="id")
    assert nodes(train(P, ones, label="y", features=X, weight="one", num_boost_round=1, row_id="id")) == nodes(base)
    none = data.withColumn("zero", F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0))
    a = train(P, none, label="y", features=X, weight="zero", num_boost_round=1, row_id="id")
    b = train(P, data.where("id % 2 = 0"), label="y", features=X, num_boost_round=1, row_id="id")
    pa, pb = (scoring.predict(data, x).agg(F.sum("prediction")).first()[0] for x in (a, b))
    assert abs(pa - pb) < 1e-3
    sentinel = data.withColumn("a", F.coalesce("a", F.lit(-999.0)))
    assert nodes(train(P | {"missing": -999.0}, sentinel, label="y", features=X, num_boost_round=1, row_id="id")) == nodes(base)


def test_continuation_and_json(data, tmp_path):
    whole = train(P, data, label="y", features=X, num_boost_round=3, row_id="id")
    first = train(P, data, label="y", features=X, num_boost_round=1, row_id="id")
    path = str(tmp_path / "m.json")
    first.save_model(path)
    assert nodes(Model.load_model(path)) == nodes(first)
    more = train(P, data, label="y", features=X, num_boost_round=2, init_model=path, row_id="id")
    assert more.num_trees == 3
    a, b = (scoring.predict(data, m).orderBy("id").toPandas()["prediction"] for m in (whole, more))
    assert np.allclose(a, b, atol=1e-5)
    part = scoring.predict(data, whole, rounds=(0, 1)).orderBy("id").toPandas()["prediction"]
    assert np.allclose(part, scoring.predict(data, first).orderBy("id").toPandas()["prediction"], atol=1e-6)


def paths(t, at=0, seen=()):
    n = t.nodes[at]
    if n.leaf:
        yield seen
    else:
        yield from paths(t, n.left, (*seen, n.feat))
        yield from paths(t, n.right, (*seen, n.feat))


def test_growth_policies_and_constraints(data):
    m = train(P | {"grow_policy": "lossguide", "max_leaves": 4, "max_depth": 0}, data, label="y", features=X, num_boost_round=1)
    assert sum(n.leaf for n in m.trees[0].nodes) <= 4
    m = train(P | {"max_leaves": 3}, data, label="y", features=X, num_boost_round=1)
    assert sum(n.leaf for n in m.trees[0].nodes) <= 3
    m = train(P | {"grow_policy": "symmetric"}, data, label="y", features=X, num_boost_round=1)
    depth = {0: 0}
    by = {}
    for i, n in enumerate(m.trees[0].nodes):
        if not n.leaf:
            depth[n.left] = depth[n.right] = depth[i] + 1
            by.setdefault(depth[i], set()).add((n.feat, n.bin))
    assert all(len(x) == 1 for x in by.values())
    m = train(P | {"interaction_constraints": [["a", "b"]]}, data, label="y", features=X, num_boost_round=2)
    assert all(set(p) <= {0, 1} or set(p) <= {2} for t in m.trees for p in paths(t))
    m = train(P | {"monotone_constraints": {"a": 1}}, data, label="y", features=X, num_boost_round=2)
    grid = data.sparkSession.createDataFrame([(i, float(i), 2.0, 2.0) for i in range(8)], "id long, a double, b double, c double")
    p = [r.prediction for r in scoring.predict(grid, m).orderBy("id").collect()]
    assert p == sorted(p)
    assert len(train(P | {"colsample_bytree": 0.3}, data, label="y", features=X, num_boost_round=1).used_features()) <= 1


@pytest.mark.parametrize("extra", [
    {"objective": "reg:squarederror"}, {"objective": "reg:absoluteerror"}, {"objective": "count:poisson"}, {"objective": "reg:pseudohubererror"},
    {"objective": "reg:quantileerror", "quantile_alpha": [0.2, 0.8]}, {"objective": "multi:softprob", "num_class": 2}, {"subsample": 0.5, "sampling_method": "gradient_based"},
])
def test_objectives_learn(data, extra):
    r = {}
    train(P | {"eta": 0.3, "max_depth": 2} | extra, data, label="y", features=X, num_boost_round=2, evals=[(data, "t")], evals_result=r)
    (history,) = r["t"].values()
    assert history[-1] <= history[0] + 0.05 and all(math.isfinite(v) for v in history)


@pytest.mark.parametrize("extra", [{}, {"objective": "multi:softprob", "num_class": 2}])
def test_symmetric_growth_in_tasks_equals_driver(data, monkeypatch, extra):
    p = {"grow_policy": "symmetric", "max_depth": 3} | extra
    driver = train(p, data, label="y", features=X, num_boost_round=2, row_id="id")
    monkeypatch.setattr("boscage.plans.train.DRIVER_ROWS", 0)
    tasks = train(p, data, label="y", features=X, num_boost_round=2, row_id="id")
    assert nodes(tasks) == nodes(driver)
    assert all(len(t.nodes) > 1 for t in tasks.trees)


def test_early_stopping_callbacks_and_custom(data):
    r = {}
    m = train(P, data, label="y", features=X, num_boost_round=6, evals=[(data, "t")], evals_result=r, early_stopping_rounds=1, custom_metrics=[CustomMetric("flat", lambda df: 1.0)])
    assert len(r["t"]["flat"]) == 2 and m.best_iteration == 0
    m = train(P, data, label="y", features=X, num_boost_round=6, callbacks=[lambda i, line: i < 1])
    assert m.num_trees == 2
    own = CustomObjective("sq", lambda p, y: (p - y, np.ones(len(y))))
    a = train(P | {"objective": "reg:squarederror"}, data, label="y", features=X, num_boost_round=1, custom_objective=own, row_id="id")
    b = train(P | {"objective": "reg:squarederror"}, data, label="y", features=X, num_boost_round=1, row_id="id")
    assert nodes(a) == nodes(b)


def test_categories(spark):
    rows = [(i, "xyz"[i % 3], float(i % 5), float(i % 3 == 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, c string, v double, y double")
    m = train({"max_depth": 1, "enable_categorical": True}, df, label="y", row_id="id", num_boost_round=1)
    assert m.get_categories() == {"c": ["x", "y", "z"]} and m.trees[0].nodes[0].cats == (1,)
    new = spark.createDataFrame([(0, "y", 1.0), (1, "unseen", 1.0), (2, "x", 1.0)], "id long, c string, v double")
    p = [r.prediction for r in scoring.predict(new.where("id <> 1"), m).orderBy("id").collect()]
    assert p[0] > p[1]
    with pytest.raises(Exception, match="unseen category"):
        scoring.predict(new, m).collect()
    with pytest.raises(ValueError, match="unseen category"):
        train({"enable_categorical": True}, df, label="y", row_id="id", num_boost_round=1, evals=[(new.withColumn("y", F.lit(1.0)), "e")])
    with pytest.raises(ValueError, match="only numeric"):
        train({}, df, label="y")
    with pytest.raises(ValueError, match="unseen"):
        binning.recode(new, "c", ["x", "y"], "code")


@pytest.mark.parametrize("extra", [{}, {"max_cat_to_onehot": 10}, {"lambda": 0.0, "max_cat_threshold": 3}])
@pytest.mark.parametrize("policy", ["symmetric", "depthwise", "lossguide"])
def test_category_margins_equal_predictions(spark, extra, policy, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, "abcdefg"[rng.integers(7)] if i % 11 else None, float(rng.integers(6)), float(rng.integers(2))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, v double, y double").cache()
    p = {"max_depth": 3, "enable_categorical": True, "grow_policy": policy, "max_leaves": 8, "eta": 0.7} | extra
    r = {}
    m = train(p, df, label="y", row_id="id", num_boost_round=3, evals=[(df, "t")], evals_result=r)
    assert any(n.cats for t in m.trees for n in t.nodes)
    q = scoring.predict(df, m).toPandas()
    loss = -np.mean(np.where(q["y"] == 1, np.log(q["prediction"]), np.log(1 - q["prediction"])))
    assert abs(loss - r["t"]["logloss"][-1]) < 1e-5
    monkeypatch.setattr("boscage.plans.train.DRIVER_ROWS", 0)
    monkeypatch.setattr("boscage.plans.train.COMPILED_NODES", 0)
    assert nodes(train(p, df, label="y", row_id="id", num_boost_round=3)) == nodes(m)


def test_wide_bins(spark):
    rng = np.random.default_rng(5)
    x = rng.permutation(40_000).astype(float)
    df = spark.createDataFrame([(int(i), float(v), float(v > 30_000)) for i, v in enumerate(x)], "id long, v double, y double")
    m = train({"max_bin": 65_535, "max_depth": 1, "objective": "reg:squarederror"}, df, label="y", row_id="id", num_boost_round=1)
    n = m.trees[0].nodes[0]
    assert n.bin > 30_000 and 30_000 < n.cond <= 30_001
    edges = sorted({float(np.float32(v)) for v in rng.normal(size=1000)})
    some = [float(np.float32(v)) for v in [*rng.normal(size=200), *edges[:50], edges[0] - 1, edges[-1] + 1]]
    own = spark.createDataFrame([(v,) for v in some] + [(None,)], "v float")
    got = [r[0] for r in own.select(binning.bin_of(F.col("v"), edges)).collect()]
    assert got == [int(np.searchsorted(edges, v, "right")) for v in some] + [None]


def test_many_categories(spark):
    names = [f"näme {i}" for i in range(3000)]
    df = spark.createDataFrame([(x,) for x in [*names[::7], "none", None]], "c string")
    got = [r[0] for r in df.select(binning.lookup(names, F.col("c"))).collect()]
    assert got == [*range(0, 3000, 7), None, None]
    with pytest.raises(ValueError, match="categories"):
        binning.learn_categories(spark.range(66_000).selectExpr("cast(id as string) c", "id"), "c", "id")


@pytest.mark.parametrize("n", [3000, 70_000])
def test_codes_of_any_number_of_names(spark, n):
    own = spark.range(2 * n).selectExpr("id", "concat('n', pmod(id * 7919 + 3, %d)) c" % n).union(spark.createDataFrame([(-1, None)], "id long, c string"))
    got = {r.id: r.code for r in binning.with_codes(own, "c", "id").collect()}
    assert got == {-1: None} | {i: i % n for i in range(2 * n)}
    tied = spark.range(n).selectExpr("id", "cast(id as string) c", "id div 10 as o")
    got = [r.code for r in binning.with_codes(tied, "c", "o").orderBy("id").collect()]
    order = {i: k for k, i in enumerate(sorted(range(n), key=lambda i: (i // 10, str(i))))}
    assert got == [order[i] for i in range(n)]


def test_weighted_ranking_metrics(spark):
    rows = [(1, 0, 3.0, 0.0, 1.0), (1, 1, 2.0, 2.0, 1.0), (2, 2, 3.0, 1.0, 9.0), (2, 3, 1.0, 0.0, 9.0), (3, 4, 1.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "q long, row long, m float, y double, w double")
    ndcg = 1 / math.log2(3)
    got = metrics.evaluate(df, ["ndcg", "ndcg@1-"], "rank:ndcg", ["m"], "y", "w", {}, "q", "row")
    assert abs(got["ndcg"] - (ndcg + 9 + 1) / 15) < 1e-9 and abs(got["ndcg@1-"] - 9 / 15) < 1e-9
    with pytest.raises(ValueError, match="label"):
        metrics.evaluate(df, ["map"], "rank:map", ["m"], "y", "w", {}, "q", "row")
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), i, float(rng.integers(5)), float(rng.integers(3))) for i in range(90)] + [(9, 100, 1.0, 1.0)]
    got = {r.q: r.auc for r in ranking.group_auc(spark.createDataFrame(rows, "q long, row long, m double, y double"), "q", "m", "y", "row").collect()}
    for q in range(3):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1]))
        pairs = [(a[2] > b[2]) + (a[2] == b[2]) / 2 for a, b in itertools.combinations(own, 2)]
        assert abs(got[q] - np.mean(pairs)) < 1e-12
    assert set(got) == {0, 1, 2}
    big = rng.integers(0, 50, 2500).astype(float)
    want = sum(((big[i] > big[i + 1 :]).sum() + (big[i] == big[i + 1 :]).sum() / 2) for i in range(len(big))) / (2500 * 2499 / 2)
    assert abs(ranking.ordered_share(big) - want) < 1e-12


def test_aft_score_is_the_negative_loss(spark):
    rows = [(i, float(i % 7), float(1 + i % 5), float(1 + i % 5) if i % 3 else math.inf) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, lo double, hi double")
    r = {}
    own = TreeRegressor(n_estimators=2, features=["x"], bounds=("lo", "hi"), objective="survival:aft", max_depth=2)
    own.fit(df, [(df, "t")])
    assert abs(own.score(df) + own.evals_result_["t"]["aft-nloglik"][-1]) < 1e-5


def test_row_sampling_ignores_partitions(data):
    p = P | {"subsample": 0.5}
    a = train(p, data.repartition(5), label="y", features=X, num_boost_round=2)
    b = train(p, data.repartition(2).orderBy("c"), label="y", features=X, num_boost_round=2)
    assert nodes(a) == nodes(b)


def test_compiled_and_walked_scores_agree(data):
    m = train(P, data, label="y", features=X, num_boost_round=2)
    a = scoring.with_margins(data, m).orderBy("id").select(F.get("margins", F.lit(0))).toPandas().iloc[:, 0]
    b = scoring._walked(data, m, None, math.nan, "margins").orderBy("id").select(F.get("margins", F.lit(0))).toPandas().iloc[:, 0]
    assert np.allclose(a, b, atol=1e-6)
    a = scoring.with_leaves(data, m).orderBy("id").toPandas()["leaves"].map(list).tolist()
    assert a == scoring._walked(data, m, None, math.nan, "leaves").orderBy("id").toPandas()["leaves"].map(list).tolist()


def expected(tree, x, known, at=0):
    n = tree.nodes[at]
    if n.leaf:
        return n.value
    if n.feat in known:
        v = x[n.feat]
        if n.cats is not None:
            left = int(v) not in n.cats
        else:
            left = n.default_left if math.isnan(v) else v < n.cond
        return expected(tree, x, known, n.left if left else n.right)
    a, b = tree.nodes[n.left], tree.nodes[n.right]
    return (a.cover * expected(tree, x, known, n.left) + b.cover * expected(tree, x, known, n.right)) / (a.cover + b.cover)


def test_shap_is_shapley():
    m = fixed_model()
    e = explain.Explainer(m)
    rng = np.random.default_rng(1)
    x = np.stack([rng.uniform(20, 30, 20), rng.uniform(0, 0.1, 20), rng.integers(0, 5, 20)], 1).astype(np.float32)
    x[3, 1] = np.nan
    got = e.shap(x)[:, 0]
    for row, out in zip(x, got, strict=True):
        for f in range(3):
            total = 0.0
            rest = [i for i in range(3) if i != f]
            for k in range(3):
                for s in itertools.combinations(rest, k):
                    weight = math.factorial(k) * math.factorial(2 - k) / 6
                    total += weight * sum(expected(t, row, {*s, f}) - expected(t, row, set(s)) for t in m.trees)
            assert abs(out[f] - total) < 1e-6
    w = scoring.Walker(m)
    assert np.allclose(got.sum(1), w.margins(x)[:, 0], atol=1e-6)
    assert np.allclose(e.saabas(x)[:, 0].sum(1), w.margins(x)[:, 0], atol=1e-6)
    pairs = e.interactions(x)[:, 0]
    assert np.allclose(pairs.sum(2), got, atol=1e-9) and np.allclose(pairs, pairs.transpose(0, 2, 1))


def test_cuts_and_bins(spark):
    df = spark.createDataFrame([(float(v), float(1 + v % 2)) for v in range(100)], "x double, w double")
    cuts = binning.collect_cuts(binning.cuts(binning.value_weights(df, ["x"]), 4), 1)[0]
    assert cuts == [25.0, 50.0, 75.0]
    edges = [1.0, 2.0, 5.5]
    own = spark.createDataFrame([(0.0,), (1.0,), (5.4,), (9.0,), (None,), (float("nan"),)], "x double")
    a = [r[0] for r in own.select(binning.bin_of(binning.as_feature("x"), edges)).collect()]
    b = [r[0] for r in own.select(binning.search_bin(binning.as_feature("x"), edges)).collect()]
    assert a == b == [0, 1, 2, 3, None, None]
    with pytest.raises(ValueError, match="infinite"):
        binning.guard(spark.createDataFrame([(float("inf"),)], "x double"), ["x"])


def test_split_scan_by_brute_force():
    rng = np.random.default_rng(2)
    rules = splits.Rules(min_child_weight=0.0)
    for _ in range(100):
        g, h = rng.integers(-50, 50, 6), rng.integers(1, 20, 6)
        mg, mh = (int(rng.integers(-40, 40)), int(rng.integers(1, 9))) if rng.random() < 0.5 else (0, 0)
        s = splits.Scan((int(g.sum()) + mg, int(h.sum()) + mh), (1.0, 1.0), rules)
        got = s.numeric(0, np.arange(6), g, h)
        best = -np.inf
        for cut in range(1, 7):
            for side in (0, 1):
                gl, hl = g[:cut].sum() + side * mg, h[:cut].sum() + side * mh
                if hl > 0 and s.h - hl > 0:
                    best = max(best, gl**2 / (hl + 1) + (s.g - gl) ** 2 / (s.h - hl + 1) - s.g**2 / (s.h + 1))
        assert (best <= 1e-5 and got.feat < 0) or abs(got.gain - best) < 1e-3 * max(1, best)


def test_small_gains_of_large_sums():
    h = np.array([12_000_000] * 3)
    g = 16_000_000 + np.array([4000, 1000, -5000])
    s = splits.Scan((int(g.sum()), int(h.sum())), (1.0, 1.0), splits.Rules())
    gl, hl = np.cumsum(g)[:2].astype(float), np.cumsum(h)[:2].astype(float)
    exact = gl**2 / (hl + 1) + (s.g - gl) ** 2 / (s.h - hl + 1) - s.g**2 / (s.h + 1)
    got = s.numeric(0, np.arange(3), g, h)
    assert exact.argmax() == 1 and got.bin == 2 and abs(got.gain - exact[1]) < 1e-4


def test_split_without_a_gain(spark):
    df = spark.createDataFrame([(float(v), float(k % 2)) for v in range(4) for k in range(10)], "v double, y double")
    p = {"max_depth": 1, "objective": "reg:squarederror", "base_score": 0.0}
    assert train(p, df, label="y", num_boost_round=1).trees[0].nodes[0].leaf
    n = train(p, df, label="y", num_boost_round=1, least_gain=-math.inf).trees[0].nodes
    assert n[0].feat == 0 and n[0].gain < 0 and len(n) == 3


def test_gradient_sampling_threshold(spark):
    rng = np.random.default_rng(4)
    s = rng.exponential(size=500)
    df = spark.createDataFrame([(float(v),) for v in s], "s double")
    tau = sampling.threshold(df, "s", 0.3)
    assert abs(np.minimum(1, s / tau).sum() - 150) < 1e-3
    for rate, own in ((0.9, s), (0.5, np.round(s, 1)), (0.05, s**4)):
        tau = sampling.threshold(spark.createDataFrame([(float(v),) for v in own], "s double"), "s", rate)
        assert abs(np.minimum(1, own / tau).sum() - rate * len(own)) < 1e-3 * len(own)
    kept = spark.range(10000).where(sampling.row_kept(F.col("id"), 0.25, 1, 2)).count()
    assert 2300 < kept < 2700


def test_gradient_sampling_of_several_outputs(spark, data, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, [*(rng.normal(size=2) * (20 if i % 50 == 0 else 1)), 1.0, 0.5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "row long, g0 double, g1 double, h0 double, h1 double")
    got = sampling.gradient_based_outputs(df, 2, "row", 0.3, 1, 0).toPandas().sort_values("row")
    was = df.toPandas().sort_values("row")
    big = was["row"].to_numpy() % 50 == 0
    for i in (0, 1):
        kept = got[f"g{i}"].to_numpy() != 0
        assert abs(kept.mean() - 0.3) < 0.03 and kept[big].mean() > 0.85
        assert abs(got[f"h{i}"].sum() / was[f"h{i}"].sum() - 1) < 0.1
    assert ((got["g0"] != 0) != (got["g1"] != 0)).any()
    calls = []
    monkeypatch.setattr(sampling, "gradient_based_outputs", lambda d, *a, own=sampling.gradient_based_outputs: calls.append(a) or own(d, *a))
    train({"objective": "multi:softprob", "num_class": 2, "max_depth": 2, "subsample": 0.5, "sampling_method": "gradient_based"}, data, label="y", features=X, num_boost_round=1, row_id="id")
    assert [a[0] for a in calls] == [2]


def test_ranking(spark):
    rows = [(q, i, float((i * 7 + q) % 11), i % 3) for q in range(4) for i in range(12)]
    df = spark.createDataFrame(rows, "q long, id long, s double, y int")
    m = train({"objective": "rank:ndcg", "max_depth": 2}, df.withColumn("x", F.col("y") * 1.0), label="y", qid="q", features=["s", "x"], num_boost_round=2, row_id="id")
    assert TreeRanker(qid="q").set_params(label="y").load_model is not None and m.num_trees == 2
    for kind in ("rank:ndcg", "rank:map", "rank:pairwise"):
        g, h = ranking.lambda_arrays(np.array([0.1, 0.3, 0.2, 0.9]), np.array([1, 0, 0, 1]), kind, {})
        assert abs(g.sum()) < 1e-6 and (h >= 0).all() and g[0] < 0
    with pytest.raises(ValueError, match="contiguous"):
        ranking.check_order(spark.createDataFrame([(1, 0), (2, 1), (1, 2)], "q long, id long"), "q", "id")
    assert ranking.parse_metric("ndcg@5-") == ("ndcg", 5, 0.0)


def test_aucpr_by_group(spark):
    rng = np.random.default_rng(8)
    rows = [(q, i, float(rng.integers(0, 6)), float(rng.random() < 0.4) if q else 1.0, 1.0) for q in range(5) for i in range(20 + q)]
    df = spark.createDataFrame(rows, "q long, row long, s double, y double, w double")
    each = [metrics.aucpr(df.where(F.col("q") == q), "s", "y", "w").first()[0] for q in range(1, 5)]
    got = metrics.evaluate(df, ["aucpr"], "rank:pairwise", ["s"], "y", "w", normalise({"objective": "rank:pairwise"}), "q", "row")
    assert abs(got["aucpr"] - np.mean(each)) < 1e-9
    assert abs(got["aucpr"] - metrics.aucpr(df, "s", "y", "w").first()[0]) > 1e-3
    with pytest.raises(ValueError, match="labels"):
        ranking.group_aucpr(df.withColumn("y", F.col("y") * 2), "q", "s", "y")


def test_aft_gradients_are_derivatives(spark):
    rows = [(m, lo, hi) for m in (0.1, 0.7) for lo, hi in ((2.0, 2.0), (1.0, 3.0), (2.0, float("inf")), (0.0, 2.0))]
    df = spark.createDataFrame(rows, "m double, lo double, hi double")
    for kind in ("logistic", "extreme"):
        g, h = survival.aft_gradients(F.col("m"), F.col("lo"), F.col("hi"), kind, 1.2)
        e = 1e-4
        loss = [survival.aft_nloglik(F.col("m") + d, F.col("lo"), F.col("hi"), kind, 1.2) for d in (-e, 0.0, e)]
        for r in df.select(g.alias("g"), h.alias("h"), *[x.alias(f"l{i}") for i, x in enumerate(loss)]).collect():
            assert abs(r.g - (r.l2 - r.l0) / (2 * e)) < 1e-3
            assert abs(r.h - (r.l2 - 2 * r.l1 + r.l0) / e**2) < 1e-2
    one = df.where("lo = 1").withColumn("w", F.lit(2.0)).where("m < 0.5")
    want = -math.log(survival.aft_normal((math.log(3) - 0.1) / 1.2)[1] - survival.aft_normal(-0.1 / 1.2)[1])
    assert abs(survival.aft_normal_nloglik(one, "m", "lo", "hi", "w", 1.2).first()[0] - want) < 1e-9
    for r in survival.aft_normal_gradients(df, "m", "lo", "hi", 1.2).collect():
        f = lambda m, r=r: -math.log(survival.aft_normal((math.log(r.hi) - m) / 1.2)[1] - (survival.aft_normal((math.log(r.lo) - m) / 1.2)[1] if r.lo else 0)) if r.lo != r.hi and r.hi < 1e9 else None
        if f(r.m) is not None:
            assert abs(r.g0 - (f(r.m + 1e-4) - f(r.m - 1e-4)) / 2e-4) < 1e-3


def test_parameters_are_checked(data):
    for bad in ({"nope": 1}, {"tree_method": "hist"}, {"eta": -1}, {"max_depth": 99}, {"subsample": 0}, {"objective": "multi:softprob"}, {"quantile_alpha": 0.5}, {"eta": 0.1, "learning_rate": 0.2}):
        with pytest.raises(ValueError):
            normalise(bad)
    assert normalise({"learning_rate": 0.1, "nthread": 4})["eta"] == 0.1
    assert per_feature("(1,0)", ["a", "b", "c"], "m") == [1.0, 0.0, 0.0]
    assert interactions([["a", 1]], ["a", "b", "c"]) == [frozenset((0, 1)), frozenset((2,))]
    with pytest.raises(ValueError, match="label"):
        train({}, data, label="a", features=["b"])
    with pytest.raises(ValueError, match="fit"):
        metrics.check("mlogloss", "reg:squarederror")
    with pytest.raises(ValueError):
        objectives.to_margin("reg:logistic", 2.0)


def test_inputs_and_sinks(spark, data, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        data.where(f"id % 2 = {i}").coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        next(p for p in (tmp_path / f"p{i}").iterdir() if p.suffix == ".parquet").rename(tmp_path / "in" / f"x{i}.parquet")
    assert inputs.read(spark, str(tmp_path / "in")).count() == 400
    assert inputs.read(spark, str(tmp_path / "in" / "x?.parquet")).count() == 400
    with pytest.raises(ValueError):
        inputs.resolve(spark, str(tmp_path / "**" / "x.parquet"))
    (tmp_path / "a.csv").write_text("c,v\nx,1\n,2.5\ny,\n")
    got = inputs.read(spark, str(tmp_path / "a.csv"), text_columns=["c"]).orderBy("v").collect()
    assert [(r.c, r.v) for r in got] == [("y", None), ("x", 1.0), (None, 2.5)]
    with pytest.raises(ValueError, match="not numeric"):
        inputs.read(spark, str(tmp_path / "a.csv"))
    m = train(P, str(tmp_path / "in"), label="y", features=X, num_boost_round=1, spark=spark)
    predict_to_parquet(data, m, str(tmp_path / "out"), ordered_by="id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
    with pytest.raises(Exception, match="already exists"):
        predict_to_parquet(data, m, str(tmp_path / "out"))


def test_estimators(data):
    c = TreeClassifier(n_estimators=2, features=X, label="name", max_depth=3)
    own = data.withColumn("name", F.when(F.col("y") == 1, "yes").otherwise("no"))
    assert c.fit(own).score(own) > 0.7 and c.classes_ == ["no", "yes"]
    assert abs(sum(c.feature_importances_) - 1) < 1e-9
    r = TreeRegressor(n_estimators=2, features=X, label="y", max_depth=3)
    assert r.fit(data).score(data) > 0.1 and r.get_params()["max_depth"] == 3
    with pytest.raises(ValueError):
        TreeRegressor(nope=1)


def test_streaming_scores(spark, data, tmp_path):
    from boscage.streaming.scoring import write_scored

    m = train(P, data, label="y", features=X, num_boost_round=1)
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = write_scored(stream, m, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
