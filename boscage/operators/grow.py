"""Tree growth: which nodes need a histogram next, and what their splits become.

A grower is a generator.  It yields requests (node, bounds, features) and is
sent what was found for them, so the trees of several outputs share each scan.
"""

from __future__ import annotations

import heapq
from collections.abc import Generator
from dataclasses import dataclass

import numpy as np

from ..plans.model import FLOAT_MAX, FLOAT_MIN, Node, Tree
from .sampling import columns
from .splits import Rules, Scan, Split, child_bounds, symmetric, weight

UNBOUND = (-np.inf, np.inf)


@dataclass
class Request:
    node: int
    bounds: tuple[float, float]
    features: frozenset[int]


@dataclass
class Found:
    """Sums of a node with missing rows, its best split, and its histogram.

    The histogram is None where tasks searched; under symmetric growth best is
    then the node's part of the split of its level.
    """

    sums: tuple[int, int]
    best: Split
    hist: dict | None


@dataclass
class Plan:
    """All that growth depends on."""

    rules: Rules
    scale: tuple[float, float]
    eta: float
    max_depth: int
    max_leaves: int
    cuts: list[list[float]]
    monotone: list[float]
    groups: list[frozenset[int]] | None
    sampling: tuple[float, float, float]
    weights: list[float] | None
    key: tuple
    sizes: list[int] | None = None

    def __post_init__(self):
        every = list(range(len(self.cuts)))
        self.tree_set = columns(every, self.sampling[0], self.weights, *self.key, "tree")

    def features(self, depth: int, node: int, path: frozenset[int]) -> frozenset[int]:
        level = columns(self.tree_set, self.sampling[1], self.weights, *self.key, "level", depth)
        own = set(columns(level, self.sampling[2], self.weights, *self.key, "node", node))
        if self.groups is not None and path:
            own &= set().union(*(g for g in self.groups if path <= g))
        return frozenset(own)

    def threshold(self, feat: int, bin_: int) -> float:
        edges = self.cuts[feat]
        return FLOAT_MIN if bin_ <= 0 else FLOAT_MAX if bin_ > len(edges) else edges[bin_ - 1]

    def node(self, sums: tuple[int, int], bounds: tuple[float, float]) -> Node:
        g, h = sums[0] / self.scale[0], sums[1] / self.scale[1]
        w = float(weight(g, h, self.rules, *bounds))
        return Node(value=float(np.float32(w * self.eta)), cover=float(np.float32(h)), base_weight=float(np.float32(w)))

    def apply(self, tree: Tree, at: int, s: Split, bounds: tuple[float, float]) -> tuple:
        """Split a leaf; returns ((child, bounds), (child, bounds))."""
        both = child_bounds(s, int(np.sign(self.monotone[s.feat])), bounds)
        cond = 0.0 if s.cats is not None else self.threshold(s.feat, s.bin)
        left, right = tree.split(at, s.feat, cond, s.bin, s.default_left, s.gain, s.cats, self.node(s.left, both[0]), self.node(s.right, both[1]))
        return (left, both[0]), (right, both[1])


Grower = Generator[list[Request], dict[int, Found], None]


def _root(tree: Tree, plan: Plan, found: Found) -> None:
    tree.nodes[0] = plan.node(found.sums, UNBOUND)


def depthwise(tree: Tree, plan: Plan) -> Grower:
    level, depth, leaves = [(0, UNBOUND, frozenset())], 0, 1
    while level:
        last = plan.max_depth and depth >= plan.max_depth
        if last and depth:
            return
        got = yield [Request(n, b, frozenset() if last else plan.features(depth, n, path)) for n, b, path in level]
        if not depth:
            _root(tree, plan, got[0])
        after = []
        for n, b, path in level:
            s = got[n].best
            if s.feat < 0 or (plan.max_leaves and leaves >= plan.max_leaves):
                continue
            leaves += 1
            after += [(c, cb, path | {s.feat}) for c, cb in plan.apply(tree, n, s, b)]
        level, depth = after, depth + 1


def lossguide(tree: Tree, plan: Plan) -> Grower:
    heap: list[tuple] = []
    new, leaves = [(0, UNBOUND, frozenset(), 0)], 1
    while True:
        open_ = [x for x in new if not plan.max_depth or x[3] < plan.max_depth]
        if open_ or 0 in {x[0] for x in new}:
            got = yield [Request(n, b, plan.features(d, n, path)) for n, b, path, d in (open_ or new)]
            if 0 in got:
                _root(tree, plan, got[0])
            for n, b, path, d in open_:
                if got[n].best.feat >= 0:
                    heapq.heappush(heap, (-got[n].best.gain, n, got[n].best, b, path, d))
        if not heap or (plan.max_leaves and leaves >= plan.max_leaves):
            return
        _, n, s, b, path, d = heapq.heappop(heap)
        leaves += 1
        new = [(c, cb, path | {s.feat}, d + 1) for c, cb in plan.apply(tree, n, s, b)]


def by_symmetry(tree: Tree, plan: Plan) -> Grower:
    level, depth, leaves, path = [(0, UNBOUND)], 0, 1, frozenset()
    while not plan.max_depth or depth < plan.max_depth or not depth:
        feats = plan.features(depth, 0, path)
        got = yield [Request(n, b, feats) for n, b in level]
        if not depth:
            _root(tree, plan, got[0])
        if plan.max_leaves and 2 * leaves > plan.max_leaves or (plan.max_depth and depth >= plan.max_depth):
            return
        if any(got[n].hist is None for n, _ in level):
            chosen = [got[n].best for n, _ in level]
        else:
            scans = [Scan(got[n].sums, plan.scale, plan.rules, b) for n, b in level]
            _, chosen = symmetric(scans, [got[n].hist for n, _ in level], sorted(feats), plan.sizes, plan.monotone)
        if chosen is None or chosen[0].feat < 0:
            return
        level = [child for (n, b), s in zip(level, chosen, strict=True) for child in plan.apply(tree, n, s, b)]
        depth, leaves, path = depth + 1, 2 * leaves, path | {chosen[0].feat}


GROWERS = {"depthwise": depthwise, "lossguide": lossguide, "symmetric": by_symmetry}
