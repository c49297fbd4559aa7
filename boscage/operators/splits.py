"""Split search over histograms: as window expressions, and as an array scan.

The array scan takes one node and feature at a time.  It runs on the driver
while a level's histogram is small and inside grouped tasks beyond that, so
what reaches the driver is a row per node.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Rules:
    """Regularisation of a split."""

    l2: float = 1.0
    l1: float = 0.0
    gamma: float = 0.0
    max_delta_step: float = 0.0
    min_child_weight: float = 1.0
    max_cat_to_onehot: int = 4
    max_cat_threshold: int = 64
    #: What the gain of a split must pass; -inf takes the best allowed one whatever it gains.
    least_gain: float = LEAST_GAIN


@dataclass(frozen=True)
class Split:
    """gain (float32), feature, first bin that goes right, where missing goes,
    sums of the left side, and the categories that go right."""

    gain: float = 0.0
    feat: int = -1
    bin: int = 0
    default_left: bool = False
    left: tuple[int, int] = (0, 0)
    right: tuple[int, int] = (0, 0)
    cats: tuple[int, ...] | None = None
    weights: tuple[float, float] = field(default=(0.0, 0.0), compare=False)


def soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def weight(g, h, r: Rules, low: float = -np.inf, high: float = np.inf):
    """Best leaf value of sums g, h inside its bounds."""
    g, h = np.asarray(g, float), np.asarray(h, float)
    w = np.where(h > 0, -soft(g, r.l1) / np.where(h > 0, h + r.l2, 1.0), 0.0)
    if r.max_delta_step:
        w = np.clip(w, -r.max_delta_step, r.max_delta_step)
    return np.clip(w, low, high)


def gain_given(g, h, w, r: Rules):
    """Loss decrease of a leaf with value w, in double: gains are small differences of these
    and are cut to float32 at the end only, or they drown in the sums of a large table."""
    g, h = np.asarray(g, float), np.asarray(h, float)
    return np.where(h > 0, -(2.0 * g * w + (h + r.l2) * w * w + 2.0 * r.l1 * np.abs(w)), 0.0)


class Scan:
    """Candidates of one node: sums as integers, with the scales of the fixed point."""

    def __init__(self, node: tuple[int, int], scale: tuple[float, float], rules: Rules, bounds: tuple[float, float] = (-np.inf, np.inf)):
        self.g, self.h = node
        self.sg, self.sh = scale
        self.rules, self.bounds = rules, bounds
        w = weight(self.g / self.sg, self.h / self.sh, rules, *bounds)
        self.parent = gain_given(self.g / self.sg, self.h / self.sh, w, rules)

    def gains(self, gl: np.ndarray, hl: np.ndarray, monotone: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gains of left sums (-inf where not allowed) and both weights."""
        r = self.rules
        a, b = gl / self.sg, hl / self.sh
        c, d = (self.g - gl) / self.sg, (self.h - hl) / self.sh
        wl, wr = weight(a, b, r, *self.bounds), weight(c, d, r, *self.bounds)
        gain = gain_given(a, b, wl, r) + gain_given(c, d, wr, r) - self.parent - r.gamma
        ok = (hl > 0) & (self.h - hl > 0) & (b >= r.min_child_weight) & (d >= r.min_child_weight)
        if monotone:
            ok &= (wr - wl) * monotone >= 0
        return np.where(ok & ~np.isnan(gain), gain, -np.inf).astype(np.float32), wl, wr

    def _best(self, best: Split, feat: int, gl, hl, bins, default_left: bool, monotone: int = 0, cats=None) -> Split:
        if not len(gl):
            return best
        gain, wl, wr = self.gains(gl, hl, monotone)
        i = int(np.argmax(gain))  # the first of equal ones
        if gain[i] > self.rules.least_gain and (best.feat < 0 or gain[i] > best.gain):
            left = int(gl[i]), int(hl[i])
            return Split(float(gain[i]), int(feat), int(bins[i]), default_left, left, (self.g - left[0], self.h - left[1]), None if cats is None else cats(i), (float(wl[i]), float(wr[i])))
        return best

    def numeric(self, feat: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray, monotone: int = 0) -> Split:
        """Missing right while bins go left one by one; then, if rows miss the
        feature, missing left while bins go right one by one."""
        best = self._best(Split(), feat, np.cumsum(g), np.cumsum(h), bins + 1, False, monotone)
        if int(g.sum()) != self.g or int(h.sum()) != self.h:
            gr, hr = np.cumsum(g[::-1]), np.cumsum(h[::-1])
            best = self._best(best, feat, self.g - gr, self.h - hr, bins[::-1], True, monotone)
        return best

    def categorical(self, feat: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: int) -> Split:
        """One category to the right if there are few, else prefixes of the
        categories in the order of their weights, from either end."""
        dense_g, dense_h = np.zeros(n, np.int64), np.zeros(n, np.int64)
        dense_g[bins], dense_h[bins] = g, h
        missing = int(g.sum()) != self.g or int(h.sum()) != self.h
        best = Split()
        if n < self.rules.max_cat_to_onehot:
            for code in range(n):
                one = lambda _, code=code: (code,)
                best = self._best(best, feat, np.array([self.g - dense_g[code]]), np.array([self.h - dense_h[code]]), [0], True, cats=one)
                if missing:
                    rest = np.array([int(g.sum()) - dense_g[code]]), np.array([int(h.sum()) - dense_h[code]])
                    best = self._best(best, feat, *rest, [0], False, cats=one)
            return best
        order = np.argsort(weight(dense_g / self.sg, dense_h / self.sh, self.rules), kind="stable")
        upto = min(n - 1, self.rules.max_cat_threshold - 1)
        for first, default_left in ((order, False), (order[::-1], True)):
            cg, ch = np.cumsum(dense_g[first])[:upto], np.cumsum(dense_h[first])[:upto]
            if default_left:  # the prefix goes right, missing stays left
                best = self._best(best, feat, self.g - cg, self.h - ch, [0] * len(cg), True, cats=lambda i, f=first: tuple(sorted(int(x) for x in f[: i + 1])))
            else:
                best = self._best(best, feat, cg, ch, [0] * len(cg), False, cats=lambda i, f=first: tuple(sorted(int(x) for x in f[i + 1 :])))
        return best


def best_of(splits: list[Split]) -> Split:
    """The largest gain; of equal ones the lower feature."""
    return min((s for s in splits if s.feat >= 0), key=lambda s: (-s.gain, s.feat), default=Split())


def child_bounds(s: Split, monotone: int, bounds: tuple[float, float]) -> tuple[tuple[float, float], tuple[float, float]]:
    """Bounds of both children: they part at the middle of their weights."""
    if not monotone:
        return bounds, bounds
    mid = sum(s.weights) / 2
    low, high = bounds
    return ((low, mid), (mid, high)) if monotone > 0 else ((mid, high), (low, mid))


def symmetric(scans: list[Scan], found: list[dict[int, tuple]], feats: list[int], sizes: list[int] | None = None, monotone: list[float] | None = None) -> tuple[float, list[Split] | None]:
    """One split for all nodes of a level, with its gain: the largest sum of gains, each node's valid.

    found[i]: {feat: (bins, g, h)} of node i; sizes: categories of each feature,
    0 for a numeric one.  A category set is the same in all nodes: its order
    comes from the statistics of the whole level.
    """
    best, out = scans[0].rules.least_gain * len(scans), None
    for f in feats:
        n = sizes[f] if sizes else 0
        every = np.arange(n) if n else np.unique(np.concatenate([x[f][0] for x in found if f in x] or [np.zeros(0, int)]))
        if not len(every):
            continue
        g, h = np.zeros((len(scans), len(every)), np.int64), np.zeros((len(scans), len(every)), np.int64)
        for i, x in enumerate(found):
            if f in x:
                use = x[f][0] < n if n else slice(None)
                at = np.searchsorted(every, x[f][0][use])
                g[i, at], h[i, at] = x[f][1][use], x[f][2][use]
        way = int(np.sign(monotone[f])) if monotone else 0
        for default_left, bins, left_g, left_h, cats in (_level_sets if n else _level_cuts)(scans, g, h, every):
            each = [s.gains(a, b, way) for s, a, b in zip(scans, left_g, left_h, strict=True)]
            if not len(bins):
                continue
            total = np.sum([e[0].astype(float) for e in each], axis=0)
            i = int(np.argmax(total))
            if total[i] > best:
                best = float(total[i])
                own = cats[i] if cats is not None else None
                side = default_left[i] if isinstance(default_left, list) else default_left
                out = [Split(float(e[0][i]), f, int(bins[i]), side, (int(a[i]), int(b[i])), (s.g - int(a[i]), s.h - int(b[i])), own, (float(e[1][i]), float(e[2][i]))) for s, e, a, b in zip(scans, each, left_g, left_h, strict=True)]
    return best, out


def _level_cuts(scans: list[Scan], g: np.ndarray, h: np.ndarray, every: np.ndarray):
    """(where missing goes, bins, left sums of each node, no sets) of the cuts of a numeric feature."""
    yield False, every + 1, np.cumsum(g, axis=1), np.cumsum(h, axis=1), None
    tops = np.array([s.g for s in scans]), np.array([s.h for s in scans])
    if (g.sum(axis=1) != tops[0]).any() or (h.sum(axis=1) != tops[1]).any():
        yield True, every[::-1], tops[0][:, None] - np.cumsum(g[:, ::-1], axis=1), tops[1][:, None] - np.cumsum(h[:, ::-1], axis=1), None


def _level_sets(scans: list[Scan], g: np.ndarray, h: np.ndarray, every: np.ndarray):
    """The same for category sets, which go right: single ones while there are few
    categories, else prefixes of one order, with missing on either side."""
    rules, n = scans[0].rules, len(every)
    tops = np.array([s.g for s in scans])[:, None], np.array([s.h for s in scans])[:, None]
    if n < rules.max_cat_to_onehot:
        seen = g.sum(axis=1)[:, None], h.sum(axis=1)[:, None]
        pair = [np.stack([t - x, s - x], axis=2).reshape(len(scans), 2 * n) for t, s, x in zip(tops, seen, (g, h), strict=True)]
        yield [True, False] * n, np.zeros(2 * n, int), *pair, [(c,) for c in range(n) for _ in (0, 1)]
        return
    limit = min(n, rules.max_cat_threshold)
    if limit < 2:
        return
    order = np.argsort(weight(g.sum(axis=0) / scans[0].sg, h.sum(axis=0) / scans[0].sh, rules), kind="stable")
    first = [tuple(sorted(int(x) for x in order[:k])) for k in range(n + 1)]
    right = [np.cumsum(x[:, order[: limit - 1]], axis=1) for x in (g, h)]
    yield True, np.zeros(limit - 1, int), tops[0] - right[0], tops[1] - right[1], first[1:limit]
    back = order[::-1][: limit - 1]
    yield False, np.zeros(limit - 1, int), np.cumsum(g[:, back], axis=1), np.cumsum(h[:, back], axis=1), [first[n - 1 - k] for k in range(limit - 1)]


# ---- the same as window expressions over a histogram table


def _weight(g: Column, h: Column, r: Rules) -> Column:
    shrunk = F.signum(g) * F.greatest(F.abs(g) - r.l1, F.lit(0.0))
    w = F.when(h > 0, -shrunk / (h + r.l2)).otherwise(F.lit(0.0))
    return F.greatest(F.least(w, F.lit(r.max_delta_step)), F.lit(-r.max_delta_step)) if r.max_delta_step else w


def _gain(g: Column, h: Column, r: Rules) -> Column:
    w = _weight(g, h, r)
    return (-(2.0 * g * w + (h + r.l2) * w * w + 2.0 * r.l1 * F.abs(w))).cast("float")


def candidates(hist: DataFrame, sums: DataFrame, keys: list[str], scale: tuple[float, float], rules: Rules) -> DataFrame:
    """(keys, feat, seq, bin, default_left, gl, hl, gain) of every allowed numeric split.

    hist: keys, feat, bin, g, h; sums: keys, g, h of whole nodes.
    """
    both = hist.join(F.broadcast(sums.select(*keys, F.col("g").alias("ng"), F.col("h").alias("nh"))), keys)
    part = Window.partitionBy(*keys, "feat")
    up = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = part.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = both.select(
        *keys, "feat", "bin", "ng", "nh",
        F.sum("g").over(up).alias("fg"), F.sum("h").over(up).alias("fh"),
        F.sum("g").over(down).alias("bg"), F.sum("h").over(down).alias("bh"),
        F.sum("g").over(part).alias("tg"), F.sum("h").over(part).alias("th"),
    )
    forward = F.struct(F.lit(False).alias("default_left"), (F.col("bin") + 1).alias("bin"), F.col("fg").alias("gl"), F.col("fh").alias("hl"), F.col("bin").alias("seq"))
    backward = F.struct(F.lit(True).alias("default_left"), F.col("bin").alias("bin"), (F.col("ng") - F.col("bg")).alias("gl"), (F.col("nh") - F.col("bh")).alias("hl"), (100_000 - F.col("bin")).alias("seq"))
    missing = (F.col("tg") != F.col("ng")) | (F.col("th") != F.col("nh"))
    each = cum.select(*keys, "feat", "ng", "nh", F.explode(F.when(missing, F.array(forward, backward)).otherwise(F.array(forward))).alias("c"))
    sg, sh = scale
    gl, hl = F.col("c.gl") / sg, F.col("c.hl") / sh
    gr, hr = (F.col("ng") - F.col("c.gl")) / sg, (F.col("nh") - F.col("c.hl")) / sh
    gain = (_gain(gl, hl, rules) + _gain(gr, hr, rules) - _gain(F.col("ng") / sg, F.col("nh") / sh, rules) - F.lit(rules.gamma).cast("float")).cast("float")
    ok = (hl > 0) & (hr > 0) & (hl >= rules.min_child_weight) & (hr >= rules.min_child_weight)
    return each.where(ok).select(*keys, "feat", "c.seq", "c.bin", "c.default_left", "c.gl", "c.hl", gain.alias("gain")).where(F.col("gain") > LEAST_GAIN)


def best_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best candidate of each node: gain, then feature, then order of enumeration."""
    best = F.max_by(F.struct("feat", "bin", "default_left", "gl", "hl", "gain"), F.struct("gain", (-F.col("feat")).alias("f"), (-F.col("seq")).alias("s")))
    return found.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def with_gain(s: Split, gain: float) -> Split:
    return replace(s, gain=gain)
