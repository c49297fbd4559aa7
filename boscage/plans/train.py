"""Training: rounds of gradients, histograms and splits over a binned table.

The binned table is written once.  A round is an aggregate for the bounds of
the gradients, one scan per level for all nodes and outputs, and one
aggregate per evaluation table; rows never leave their partition.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import metrics, objectives
from ..functions import params as parameters
from ..operators import binning, grow, histogram, ranking, sampling, survival
from ..operators.scoring import COMPILED_NODES, leaf_value, with_margins
from ..operators.splits import LEAST_GAIN, Rules, Scan, Split, best_of, symmetric
from ..sources import cache, inputs, shared
from .model import Model, Tree

#: Histogram rows up to which a level is searched on the driver; beyond it tasks search and send a row per node and feature.
DRIVER_ROWS = 2_000_000
#: Rounds after which the table of margins is written, which cuts its lineage.
CUT_ROUNDS = 8


class CustomObjective:
    """fn(batch of margins, labels) -> (grad, hess), called on Arrow batches of rows
    (kind 'scalar' or 'multiclass') or on whole groups (kind 'ranking')."""

    def __init__(self, name: str, fn: Callable, kind: str = "scalar"):
        if kind not in ("scalar", "multiclass", "ranking"):
            raise ValueError("kind must be scalar, multiclass or ranking")
        self.name, self.fn, self.kind = name, fn, kind


class CustomMetric:
    """fn(DataFrame with label, weight and margins) -> float."""

    def __init__(self, name: str, fn: Callable[[DataFrame], float], greater_is_better: bool = False):
        self.name, self.fn, self.greater_is_better = name, fn, greater_is_better


class _Table:
    """A binned table: y, w, row, draw, qid?, upper?, b0..., m0..."""

    def __init__(self, df: DataFrame, path: str | None):
        self.df, self.held, self.paths, self.rounds = df, None, [path] if path else [], 0

    def update(self, step: dict[str, Any] | Callable[[DataFrame], DataFrame]) -> None:
        """New margins by expressions or by a function, kept; the older copy goes."""
        new, old = step(self.df) if callable(step) else self.df.withColumns(step), []
        self.rounds += 1
        if self.rounds % CUT_ROUNDS == 0:
            new, path = shared.written(new)  # holds all columns, so the older copy isn't read again
            old, self.paths = self.paths, [path]
        new = new.persist(StorageLevel.MEMORY_AND_DISK)
        new.count()
        if self.held is not None:
            self.held.unpersist()
        for p in old:
            shared.delete(self.df.sparkSession, p)
        self.df = self.held = new

    def close(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        for p in self.paths:
            shared.delete(self.df.sparkSession, p)


def prepare(df: DataFrame, model: Model, roles: inputs.Roles, edges: list[list[float]], missing: float, prior: Model | None, folder: str | None = None) -> _Table:
    """The binned table of a data set, written to the shared folder, or held in the folder given."""
    source = df
    out = [(F.col(roles.label).cast("double") if roles.label else F.lit(0.0)).alias("y"), (F.col(roles.weight).cast("double") if roles.weight else F.lit(1.0)).alias("w")]
    out.append((F.col(roles.row_id).cast("long") if roles.row_id else F.monotonically_increasing_id()).alias("row"))
    # what row sampling draws by: the given id, or the row's contents, never its place
    own = [c for c in (roles.label, roles.upper, roles.weight, roles.qid, *model.features) if c]
    out.append((F.col(roles.row_id).cast("long") if roles.row_id else F.xxhash64(*own)).alias("draw"))
    if roles.qid:
        out.append(F.col(roles.qid).cast("long").alias("qid"))
    if roles.upper:
        out.append(F.col(roles.upper).cast("double").alias("upper"))
    for i, f in enumerate(model.features):
        names = model.categories.get(f)
        if names:
            out.append(binning.known_code(names, f).alias(f"b{i}"))
        elif model.categorical[i]:
            out.append(binning.as_feature(f, missing).cast("int").alias(f"b{i}"))
        else:
            out.append(binning.bin_of(binning.as_feature(f, missing), edges[i]).alias(f"b{i}"))
    start = [F.col(c).cast("float") for c in roles.base_margin] or [F.lit(float(m)).cast("float") for m in model.base_margins]
    if prior is not None:
        df = with_margins(df, prior, roles.base_margin or None, missing)
        start = [F.get("margins", F.lit(k)) for k in range(model.outputs)]
    binned = df.select(*out, *[m.alias(f"m{k}") for k, m in enumerate(start)])
    if folder:
        what = {"features": model.features, "categories": model.categories, "categorical": model.categorical, "edges": edges, "missing": missing, "roles": vars(roles), "margins": model.base_margins, "prior": prior.to_dict() if prior else None}
        return _Table(cache.held(binned, folder, cache.name_of(source, what)), None)
    written, path = shared.written(binned)
    return _Table(written, path)


def _gradients(df: DataFrame, objective: str, custom: CustomObjective | None, q: dict, k: int, roles: inputs.Roles, round_: int) -> DataFrame:
    """df with float g0, h0, ... weighted."""
    y, w = F.col("y"), F.col("w")
    if q["scale_pos_weight"] != 1 and objective in objectives.SCALAR and objectives.SCALAR[objective].weighs_positives:
        w = w * F.when(y == 1, F.lit(float(q["scale_pos_weight"]))).otherwise(F.lit(1.0))
    if custom is not None:
        return _custom(df, custom, k)
    if objective in objectives.SCALAR:
        o, out = objectives.SCALAR[objective], {}
        scales = [0.0] * k
        if objective in objectives.SCALED:
            r = df.agg(*[objectives.residual_scale(F.col(f"m{i}").cast("double"), y, F.col("w")).alias(f"s{i}") for i in range(k)]).first()
            scales = [r[f"s{i}"] or 0.0 for i in range(k)]
        for i in range(k):
            own = q | {"scale": scales[i], "level": (q["quantile_alpha"] or [0.5])[min(i, len(q["quantile_alpha"] or [0.5]) - 1)]}
            p = F.col(f"m{i}").cast("double")
            out |= {f"g{i}": (o.grad(p, y, own) * w).cast("float"), f"h{i}": (o.hess(p, y, own) * w).cast("float")}
        return df.withColumns(out)
    if objective.startswith("multi:"):
        m, out = F.array(*[F.col(f"m{i}") for i in range(k)]), {}
        for i in range(k):
            g, h = objectives.softmax_gradients(m, y, i)
            out |= {f"g{i}": (g * w).cast("float"), f"h{i}": (h * w).cast("float")}
        return df.withColumns(out)
    if objective.startswith("rank:"):
        got = ranking.lambda_gradients(df, "qid", "row", "m0", "y", objective, q, q["seed"] + round_)
        if roles.weight:
            got = got.join(ranking.group_weights(df, "qid", "w"), "qid").withColumns({x: (F.col(x) * F.col("group_weight")).cast("float") for x in ("g0", "h0")}).drop("group_weight")
        return got
    if objective == "survival:cox":
        return survival.cox_gradients(df, "m0", "y", "w", df.columns)
    kind, sigma = q["aft_loss_distribution"], q["aft_loss_distribution_scale"]
    if kind == "normal":
        got = survival.aft_normal_gradients(df, "m0", "y", "upper", sigma)
        return got.withColumns({x: (F.col(x) * w).cast("float") for x in ("g0", "h0")})
    g, h = survival.aft_gradients(F.col("m0").cast("double"), y, F.col("upper"), kind, sigma)
    return df.withColumns({"g0": (g * w).cast("float"), "h0": (h * w).cast("float")})


def _custom(df: DataFrame, custom: CustomObjective, k: int) -> DataFrame:
    fn, names = custom.fn, [f"m{i}" for i in range(k)]

    def one(pdf):
        m = pdf[names].to_numpy(np.float32)
        g, h = fn(m if custom.kind == "multiclass" else m[:, 0], pdf["y"].to_numpy(np.float32))
        g, h = np.asarray(g, np.float64).reshape(len(pdf), k), np.asarray(h, np.float64).reshape(len(pdf), k)
        if not (np.isfinite(g).all() and np.isfinite(h).all() and (h >= 0).all()):
            raise ValueError(f"{custom.name}: gradients must be finite and hessians not negative")
        w = pdf["w"].to_numpy()[:, None]
        return pdf.assign(**{f"g{i}": (g * w)[:, i].astype(np.float32) for i in range(k)}, **{f"h{i}": (h * w)[:, i].astype(np.float32) for i in range(k)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", g{i} float" for i in range(k)) + "".join(f", h{i} float" for i in range(k))
    if custom.kind == "ranking":
        return df.groupBy("qid").applyInPandas(lambda pdf: one(pdf.sort_values("row")), schema)
    return df.mapInPandas(lambda it: (one(pdf) for pdf in it), schema)


def _scan(plan: grow.Plan, categorical: list[int], request: grow.Request, sums: tuple[int, int], feat: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> Split:
    if feat not in request.features:
        return Split()
    scan = Scan(sums, plan.scale, plan.rules, request.bounds)
    if categorical[feat]:
        use = bins < categorical[feat]
        return scan.categorical(feat, bins[use], g[use], h[use], categorical[feat])
    return scan.numeric(feat, bins, g, h, int(np.sign(plan.monotone[feat])))


Held = dict[tuple[int, int], tuple[tuple[int, int], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]]


def _siblings(trees: list[Tree], requests: dict[int, list[grow.Request]], held: Held) -> dict[tuple[int, int], int]:
    """Of two children whose parent's histogram is held, the heavier one (output, node) and
    its sibling: it is the parent less the sibling."""
    out = {}
    for k, rs in requests.items():
        by = {r.node: r for r in rs}
        for n, r in by.items():
            up = trees[k].nodes[n].parent
            if (k, up) not in held:
                continue
            other = trees[k].nodes[up].left + trees[k].nodes[up].right - n
            if other in by and (k, other) not in out and r.features <= held[k, up][1].keys() and r.features <= by[other].features:
                mine, its = trees[k].nodes[n].cover, trees[k].nodes[other].cover
                if mine > its or (mine == its and n > other):
                    out[k, n] = other
    return out


def _less(parent: tuple, child: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A feature's histogram (bins, g, h) less that of one child: exact, as sums are integers."""
    bins, g, h = parent[0], parent[1].copy(), parent[2].copy()
    at = np.searchsorted(bins, child[0])
    g[at] -= child[1]
    h[at] -= child[2]
    some = (g != 0) | (h != 0)
    return bins[some], g[some], h[some]


def _tables(hist: DataFrame) -> Held:
    """A small histogram table as sums and sorted arrays per output, node and feature."""
    got = hist.toArrow()
    k, n, f, b, g, h = (got.column(c).to_numpy() for c in ("cls", "node", "feat", "bin", "g", "h"))
    order = np.lexsort((b, f, n, k))
    k, n, f, b, g, h = (x[order] for x in (k, n, f, b, g, h))
    edge = np.flatnonzero((np.diff(k) != 0) | (np.diff(n) != 0) | (np.diff(f) != 0)) + 1
    out: Held = {}
    for i, j in zip(np.append(0, edge), np.append(edge, len(k)), strict=True) if len(k) else ():
        key, feat = (int(k[i]), int(n[i])), int(f[i])
        sums, t = out.get(key, ((0, 0), {}))
        if feat < 0:
            sums = (int(g[i]), int(h[i]))
        else:
            t[feat] = (b[i:j].astype(int), g[i:j].astype(np.int64), h[i:j].astype(np.int64))
        out[key] = (sums, t)
    return out


def _search(df: DataFrame, trees: list[Tree], plans: list[grow.Plan], requests: dict[int, list[grow.Request]], categorical: list[int], policy: str, held: Held) -> dict[int, dict[int, grow.Found]]:
    """Histograms and best splits of the requested nodes of all outputs: one scan."""
    feats = sorted(set().union(*(r.features for rs in requests.values() for r in rs)))
    by = {(k, r.node): r for k, rs in requests.items() for r in rs}
    sizes = [c or len(e) + 1 for c, e in zip(categorical, plans[0].cuts, strict=True)]
    size = len(by) * sum(sizes[f] for f in feats)
    out: dict[int, dict[int, grow.Found]] = {k: {} for k in requests}
    if size <= DRIVER_ROWS:
        derived = _siblings(trees, requests, held)
        wanted = {k: [r.node for r in rs if (k, r.node) not in derived] for k, rs in requests.items()}
        found = _tables(histogram.by_batches(df, trees, {k: n for k, n in wanted.items() if n}, feats, sizes))
        for (k, n), other in derived.items():
            sums, t = held[k, trees[k].nodes[n].parent]
            less, own = found.get((k, other), ((0, 0), {}))
            empty = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))
            found[k, n] = ((sums[0] - less[0], sums[1] - less[1]), {f: _less(t[f], own.get(f, empty)) for f in by[k, n].features if f in t})
        for (k, n), r in by.items():
            sums, t = found.get((k, n), ((0, 0), {}))
            out[k][n] = grow.Found(sums, best_of([_scan(plans[k], categorical, r, sums, f, *x) for f, x in sorted(t.items())]), t)
            held.pop((k, trees[k].nodes[n].parent), None)
            # features without a present row are held too, as empty
            held[k, n] = (sums, {f: t.get(f, (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))) for f in feats if f in r.features})
        while len(held) > 1 and sum(len(x[0]) for _, t in held.values() for x in t.values()) > 2 * DRIVER_ROWS:
            held.pop(next(iter(held)))  # its children are both read instead
        return out
    hist = histogram.by_batches(df, trees, {k: [r.node for r in rs] for k, rs in requests.items()}, feats, sizes)
    hist = hist.persist(StorageLevel.MEMORY_AND_DISK)
    sums = {(r["cls"], r["node"]): (int(r["g"]), int(r["h"])) for r in hist.where("feat = -1").collect()}

    if policy == "symmetric":
        joint = _level_splits(hist, plans, requests, sums)
        for k, rs in requests.items():
            for i, r in enumerate(rs):
                out[k][r.node] = grow.Found(sums.get((k, r.node), (0, 0)), joint[k][i] if k in joint else Split(), None)
        hist.unpersist()
        return out

    def scan(pdf):
        k, n, f = (int(pdf[c].iloc[0]) for c in ("cls", "node", "feat"))
        pdf = pdf.sort_values("bin")
        s = _scan(plans[k], categorical, by[k, n], sums[k, n], f, pdf["bin"].to_numpy(int), pdf["g"].to_numpy(np.int64), pdf["h"].to_numpy(np.int64))
        cats = list(s.cats) if s.cats is not None else None
        return type(pdf)([(k, n, s.feat, s.gain, s.bin, s.default_left, s.left[0], s.left[1], cats, *s.weights)], columns=names)

    names = ["cls", "node", "feat", "gain", "bin", "default_left", "gl", "hl", "cats", "wl", "wr"]
    schema = "cls int, node int, feat int, gain double, bin int, default_left boolean, gl long, hl long, cats array<int>, wl double, wr double"
    found: dict[tuple[int, int], list[Split]] = {}
    for r in hist.where("feat >= 0").groupBy("cls", "node", "feat").applyInPandas(scan, schema).where("feat >= 0").collect():
        g, h = sums[r["cls"], r["node"]]
        found.setdefault((r["cls"], r["node"]), []).append(Split(r["gain"], r["feat"], r["bin"], r["default_left"], (r["gl"], r["hl"]), (g - r["gl"], h - r["hl"]), tuple(r["cats"]) if r["cats"] is not None else None, (r["wl"], r["wr"])))
    for (k, n) in by:
        out[k][n] = grow.Found(sums.get((k, n), (0, 0)), best_of(found.get((k, n), [])), None)
    hist.unpersist()
    return out


def _level_splits(hist: DataFrame, plans: list[grow.Plan], requests: dict[int, list[grow.Request]], sums: dict[tuple[int, int], tuple[int, int]]) -> dict[int, list[Split]]:
    """The symmetric split of each output's level, a part per node: a task sums the
    gains of all nodes for one feature and sends that feature's best split back."""

    def scan(pdf):
        k, f = int(pdf["cls"].iloc[0]), int(pdf["feat"].iloc[0])
        nodes = [r.node for r in requests[k]]
        chosen = None
        if f in requests[k][0].features:
            own = {int(n): x.sort_values("bin") for n, x in pdf.groupby("node")}
            cells = [{f: (own[n]["bin"].to_numpy(int), own[n]["g"].to_numpy(np.int64), own[n]["h"].to_numpy(np.int64))} if n in own else {} for n in nodes]
            total, chosen = symmetric([Scan(sums.get((k, r.node), (0, 0)), plans[k].scale, plans[k].rules, r.bounds) for r in requests[k]], cells, [f], plans[k].sizes, plans[k].monotone)
        rows = [] if chosen is None else [(k, f, total, chosen[0].bin, chosen[0].default_left, None if chosen[0].cats is None else list(chosen[0].cats), [s.gain for s in chosen], [s.left[0] for s in chosen], [s.left[1] for s in chosen], [s.weights[0] for s in chosen], [s.weights[1] for s in chosen])]
        return type(pdf)(rows, columns=names)

    names = ["cls", "feat", "total", "bin", "default_left", "cats", "gain", "gl", "hl", "wl", "wr"]
    schema = "cls int, feat int, total double, bin int, default_left boolean, cats array<int>, gain array<double>, gl array<long>, hl array<long>, wl array<double>, wr array<double>"
    best: dict[int, Any] = {}
    for r in hist.where("feat >= 0").groupBy("cls", "feat").applyInPandas(scan, schema).collect():
        old = best.get(r["cls"])
        if old is None or (-r["total"], r["feat"]) < (-old["total"], old["feat"]):
            best[r["cls"]] = r
    out = {}
    for k, r in best.items():
        each = zip(requests[k], r["gain"], r["gl"], r["hl"], r["wl"], r["wr"], strict=True)
        out[k] = [Split(gain, r["feat"], r["bin"], r["default_left"], (gl, hl), (sums[k, q.node][0] - gl, sums[k, q.node][1] - hl), None if r["cats"] is None else tuple(r["cats"]), (wl, wr)) for q, gain, gl, hl, wl, wr in each]
    return out


def _grow_round(df: DataFrame, model: Model, q: dict, edges: list[list[float]], sizes: list[int], round_: int, least_gain: float = LEAST_GAIN) -> list[Tree]:
    """The trees of one round from a table with g0, h0, ..."""
    k = model.outputs
    n, tops = histogram.bounds(df, [f"g{i}" for i in range(k)], [f"h{i}" for i in range(k)])
    scales = [(histogram.power_of_two(n, a), histogram.power_of_two(n, b)) for a, b in tops]
    df = df.withColumns({f"{x}q{i}": histogram.fixed(F.col(f"{x}{i}"), scales[i][j]) for i in range(k) for j, x in enumerate("gh")})
    df = df.where(" or ".join(f"g{i} <> 0 or h{i} <> 0" for i in range(k)))
    rules = Rules(q["lambda"], q["alpha"], q["gamma"], q["max_delta_step"], q["min_child_weight"], q["max_cat_to_onehot"], q["max_cat_threshold"], least_gain)
    monotone = parameters.per_feature(q["monotone_constraints"], model.features, "monotone_constraints")
    groups = parameters.interactions(q["interaction_constraints"], model.features)
    fw = parameters.per_feature(q["feature_weights"], model.features, "feature_weights") if q["feature_weights"] is not None else None
    rates = (q["colsample_bytree"], q["colsample_bylevel"], q["colsample_bynode"])
    plans = [grow.Plan(rules, scales[i], q["eta"], q["max_depth"], q["max_leaves"], edges, monotone, groups, rates, fw, (q["seed"], round_, i), sizes) for i in range(k)]
    trees = [Tree() for _ in range(k)]
    growers = {i: grow.GROWERS[q["grow_policy"]](trees[i], plans[i]) for i in range(k)}
    requests = {i: next(g) for i, g in growers.items()}
    held: Held = {}
    while requests:
        found = _search(df, trees, plans, requests, sizes, q["grow_policy"], held)
        after = {}
        for i in requests:
            try:
                after[i] = growers[i].send(found[i])
            except StopIteration:
                continue
        requests = after
    return trees


def train(
    params: dict[str, Any], data: Any, label: str | None = None, num_boost_round: int = 10, evals: Sequence[tuple[Any, str]] = (), early_stopping_rounds: int | None = None,
    evals_result: dict | None = None, verbose_eval: bool = False, callbacks: Sequence[Callable] = (), header: bool = True, weight: str | None = None, feature_types: dict[str, str] | Sequence[str] | None = None,
    base_margin: str | list[str] | None = None, init_model: Model | str | None = None, qid: str | None = None, label_lower_bound: str | None = None, label_upper_bound: str | None = None,
    features: Sequence[str] | None = None, row_id: str | None = None, custom_objective: CustomObjective | None = None, custom_metrics: Sequence[CustomMetric] = (), spark: SparkSession | None = None,
    exact_cuts: bool = True, given_cuts: list[list[float]] | None = None, group: list[int] | None = None, eval_qid: Sequence[str] | None = None, eval_group: Sequence[list[int]] | None = None,
    least_gain: float = LEAST_GAIN,
) -> Model:
    """A boosted model of a DataFrame, of files, or of what createDataFrame takes.

    features: the columns to use; without it all that have no role.  Cuts are
    exact by default; exact_cuts=False takes mergeable sketches instead.  Columns
    may be given by number.  Queries are a column (qid) or group sizes in the
    order of row_id; eval_qid and eval_group say the same of the evaluation
    tables, in their order.  A node whose best split gains no more than
    least_gain stays a leaf; with -inf it takes that split whatever it gains.
    """
    q = parameters.normalise(params)
    objective = q["objective"]
    objectives.check(objective)
    spark = spark or SparkSession.getActiveSession()
    roles = inputs.Roles(label or label_lower_bound, weight, qid, label_upper_bound, [base_margin] if isinstance(base_margin, str) else list(base_margin or []), row_id)
    declared = feature_types if isinstance(feature_types, dict) else {}
    df = inputs.read(spark, data, header, [c for c, t in declared.items() if t == "c"])
    named = {c: df.columns[c] for c in (label, weight, qid, label_lower_bound, label_upper_bound, row_id) if isinstance(c, int) and not isinstance(c, bool)}
    if named:
        label, weight, qid, label_lower_bound, label_upper_bound, row_id = (named.get(c, c) for c in (label, weight, qid, label_lower_bound, label_upper_bound, row_id))
        roles = inputs.Roles(label or label_lower_bound, weight, qid, label_upper_bound, roles.base_margin, row_id)
    whole = data
    if group is not None or eval_group is not None:
        if qid or not row_id or (group is None) != (eval_group is None and bool(evals)) and evals:
            raise ValueError("group sizes need row_id, no qid, and eval_group for evaluation tables")
        qid = roles.qid = "_query"
        df = ranking.with_sizes(df, list(group or ()), row_id, qid)
        evals = [(ranking.with_sizes(inputs.read(spark, e, header, [c for c, t in declared.items() if t == "c"]), list(s), row_id, qid), name) for (e, name), s in zip(evals, eval_group or (), strict=True)]
    if eval_qid is not None:
        if len(eval_qid) != len(evals):
            raise ValueError("eval_qid needs a column for each evaluation table")
        evals = [(e if c == qid else inputs.read(spark, e, header, [x for x, t in declared.items() if t == "c"]).withColumnRenamed(c, qid), name) for (e, name), c in zip(evals, eval_qid, strict=True)]
    if qid:
        ranking.check_qid(df, qid)
    if features is not None:
        df = df.select(*dict.fromkeys([*features, *[c for c in df.columns if c in roles.excluded()]]))
    if not isinstance(declared, dict) or (feature_types is not None and not declared and not isinstance(feature_types, dict)):
        own = [c for c in df.columns if c not in roles.excluded()]
        declared = dict(zip(own, feature_types, strict=True))
    text = [c for c, t in df.dtypes if t == "string" and c not in roles.excluded()]
    cats = [c for c, t in declared.items() if t == "c"] + [c for c in text if q["enable_categorical"] and c not in declared]
    names = inputs.features_of(df, roles, cats)
    if objective.startswith("rank:") and not qid:
        raise ValueError("ranking needs qid")
    if objective == "survival:aft":
        if not label_upper_bound:
            raise ValueError("survival:aft needs label_lower_bound and label_upper_bound")
        survival.check_bounds(df, roles.label, roles.upper)
    if weight:
        inputs.check_weight(df, weight)
    prior = Model.load_model(init_model) if isinstance(init_model, str) else init_model
    if prior is not None:
        if len(prior.features) == len(names) and prior.features == [f"f{i}" for i in range(len(names))]:
            prior.features = list(names)  # a model without names takes those of the table
        if prior.objective != objective or prior.features != names:
            raise ValueError("init_model has another objective or other features")
        if objective.startswith("multi:") and prior.outputs != q["num_class"]:
            raise ValueError(f"init_model has {prior.outputs} classes")
        if any(a != (f in cats) for a, f in zip(prior.categorical, names, strict=False)):
            raise ValueError("init_model has other feature types")
    if custom_objective is None and objective in ("rank:ndcg", "rank:map"):
        ranking.check_labels(df, roles.label, objective[5:], q["ndcg_exp_gain"])
    for c in roles.base_margin:
        m = F.col(c).cast("double")
        if df.where(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf"))).limit(1).count():
            raise ValueError(f"{c}: start margins must be finite")
    if not objective.startswith("survival:"):
        bad = df.where(~F.coalesce(objectives.label_rule(objective, F.col(roles.label), q["num_class"]), F.lit(False))).limit(1)
        if custom_objective is None and bad.count():
            raise ValueError(f"a label doesn't fit {objective}")

    clean = df.withColumns({f: binning.as_feature(f, q["missing"]) for f in names if f not in cats})
    binning.guard(clean, [f for f in names if f not in cats])
    categories, sizes = {}, []
    for f in names:
        if f in text:
            found = binning.learn_categories(df.withColumn("_order", F.col(row_id) if row_id else F.monotonically_increasing_id()), f, "_order")
            categories[f] = prior.categories[f] if prior else [r["name"] for r in found.orderBy("code").collect()]
            if prior:
                binning.check_known(df, {f: categories[f]})
            sizes.append(len(categories[f]))
        elif f in cats:
            inputs.check_codes(df, f, q["missing"])
            top = df.agg(F.max(F.col(f).cast("int"))).first()[0]
            sizes.append(int(top or 0) + 1)
        else:
            sizes.append(0)
    numeric = [i for i, s in enumerate(sizes) if not s]
    edges: list[list[float]] = [[] for _ in names]
    if given_cuts is not None:
        edges = [list(x) for x in given_cuts]
    elif numeric:
        own = [names[i] for i in numeric]
        got = binning.collect_cuts(binning.cuts(binning.value_weights(clean, own, F.col(weight) if weight else None), q["max_bin"]), len(own)) if exact_cuts else binning.approximate_cuts(clean, own, q["max_bin"])
        for i, e in zip(numeric, got, strict=True):
            edges[i] = e

    model = Model(objective, names, [], 0.5, [0.0], {k: v for k, v in q.items()}, categories, [bool(s) for s in sizes])
    _intercept(df, model, roles, q, prior)
    if roles.base_margin and len(roles.base_margin) != model.outputs:
        raise ValueError(f"base_margin needs {model.outputs} columns")
    table = prepare(clean, model, roles, edges, q["missing"], prior, q["cache_path"])
    sets = []
    for e, name in evals:
        own = inputs.read(spark, e, header, cats)
        if features is not None:
            own = own.select(*dict.fromkeys([*features, *[c for c in own.columns if c in roles.excluded()]]))
        inputs.check_same_features(own, names, roles)
        binning.check_known(own, categories)
        own = own.withColumns({f: binning.as_feature(f, q["missing"]) for f in names if f not in cats})
        # the same data shares the margins of the training table
        sets.append((table if e is whole and group is None else prepare(own, model, roles, edges, q["missing"], prior, q["cache_path"]), name))
    wanted = q["eval_metric"] or [objectives.default_metric(objective)]
    wanted = [wanted] if isinstance(wanted, str) else list(wanted)
    if custom_objective is None:
        for m in wanted:
            metrics.check(m, objective)
    history: dict[str, dict[str, list[float]]] = {name: {} for _, name in sets}
    if early_stopping_rounds and not sets:
        raise ValueError("early stopping needs evals")
    best, best_at = None, 0
    k = model.outputs
    start = len(prior.trees) // k if prior else 0
    if prior:
        model.trees = list(prior.trees)
    try:
        for round_ in range(start, start + num_boost_round):
            g = _gradients(table.df, objective, custom_objective, q, k, roles, round_)
            if q["subsample"] < 1:
                if q["sampling_method"] == "gradient_based" and k == 1:
                    g = sampling.gradient_based(g.withColumns({"g0": F.col("g0").cast("double"), "h0": F.col("h0").cast("double")}), "g0", "h0", "draw", q["subsample"], q["seed"], round_)
                elif q["sampling_method"] == "gradient_based":
                    g = sampling.gradient_based_outputs(g, k, "draw", q["subsample"], q["seed"], round_)
                else:
                    g = g.where(sampling.row_kept(F.col("draw"), q["subsample"], q["seed"], round_))
            joint = objective in objectives.JOINT and not objective.startswith("multi:") or custom_objective is not None or q["sampling_method"] == "gradient_based"
            if joint:  # gradients that cost a shuffle or Python are made once per round
                g = g.persist(StorageLevel.MEMORY_AND_DISK)
            trees = _grow_round(g, model, q, edges, sizes, round_, least_gain)
            if joint:
                g.unpersist()
            model.trees += trees
            columns = {i: F.col(f"b{i}") for i in range(len(names))}
            if sum(len(t.nodes) for t in trees) <= COMPILED_NODES:
                step = {f"m{i}": (F.col(f"m{i}") + leaf_value(t, columns, binned=True)).cast("float") for i, t in enumerate(trees)}
            else:
                step = functools.partial(histogram.with_leaf_values, trees=trees)
            table.update(step)
            line = {}
            for own, name in sets:
                if own is not table:
                    own.update(step)
                got = metrics.evaluate(own.df, wanted, objective, [f"m{i}" for i in range(k)], "y", "w", q, "qid" if qid else None, "row", "upper" if roles.upper else None)
                got |= {c.name: float(c.fn(own.df)) for c in custom_metrics}
                for m, v in got.items():
                    history[name].setdefault(m, []).append(v)
                line[name] = got
            if verbose_eval:
                print(round_, line)
            stop = any(c(round_, line) is False for c in callbacks)
            if early_stopping_rounds:
                m, v = list(line[sets[-1][1]].items())[-1]
                better = metrics.improves(m) or any(c.name == m and c.greater_is_better for c in custom_metrics)
                if best is None or (v > best if better else v < best):
                    best, best_at = v, round_
                stop |= round_ - best_at >= early_stopping_rounds
                model.best_iteration, model.best_score = best_at, best
            if stop:
                break
    finally:
        for own in {id(t): t for t in [table, *[t for t, _ in sets]]}.values():
            own.close()
    if evals_result is not None:
        evals_result.clear()
        evals_result.update(history)
    return model


def _intercept(df: DataFrame, model: Model, roles: inputs.Roles, q: dict, prior: Model | None) -> None:
    """base_score and start margins of a model, estimated unless given."""
    objective = model.objective
    if prior is not None:
        model.base_score, model.base_margins = prior.base_score, list(prior.base_margins)
        return
    own = df.select((F.col(roles.label).cast("double") if roles.label else F.lit(0.0)).alias("y"), (F.col(roles.weight).cast("double") if roles.weight else F.lit(1.0)).alias("w"))
    if objective.startswith("multi:"):
        if q["base_score"] is not None:
            model.base_score, model.base_margins = q["base_score"], [float(q["base_score"])] * q["num_class"]
        else:
            model.base_margins = objectives.class_margins(own, "y", "w", q["num_class"])
    elif objective == "reg:quantileerror":
        levels = q["quantile_alpha"]
        model.base_margins = [float(q["base_score"])] * len(levels) if q["base_score"] is not None else label_quantiles(own, "y", "w", levels, bool(roles.weight))
        model.base_score = model.base_margins[0]
    else:
        default = 0.0 if objective.startswith("rank:") else None  # the gradients of a pair cancel
        score = q["base_score"] if q["base_score"] is not None else default if default is not None else objectives.base_score(own, objective, "y", "w", q)
        model.base_score = float(np.float32(score))
        model.base_margins = [float(np.float32(objectives.to_margin(objective, model.base_score)))]


def label_quantiles(df: DataFrame, y: str, w: str, levels: list[float], weighted: bool) -> list[float]:
    """Label quantiles: interpolated at level * (n + 1), or by steps of the weights.

    Running counts over distinct labels find the two neighbours; only these are read.
    """
    from ..operators.ordered import running

    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("wsum"))
    run = running(counts, y, {"upto": F.col("n"), "weight": F.col("wsum")})
    n, total = counts.agg(F.sum("n"), F.sum("wsum")).first()
    if not n:
        return [0.5] * len(levels)

    def at(rank: int) -> float:
        return run.where(F.col("upto") >= rank).agg(F.min(y)).first()[0]

    out = []
    for a in levels:
        if weighted:
            got = run.where(F.col("weight") >= a * total).agg(F.min(y)).first()[0]
            out.append(float(got))
        elif a <= 1 / (n + 1):
            out.append(float(at(1)))
        elif a >= n / (n + 1):
            out.append(float(at(n)))
        else:
            x = a * (n + 1)
            i = math.floor(x)
            lo, hi = at(i), at(i + 1)
            out.append(float(lo + (x - i) * (hi - lo)))
    return out
