"""Union-find inside one task: labels by minimum, relabelled in bulk."""

from __future__ import annotations

import numpy as np


class Labels:
    """Component labels of n items; a join relabels the smaller side."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members: dict[int, list[int]] = {i: [i] for i in range(n)}
        self.edges: list[tuple[int, int]] = []

    def join(self, x: int, y: int) -> None:
        a, b = int(self.of[x]), int(self.of[y])
        if a == b:
            return
        self.edges.append((x, y))
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.of[moved] = a
        self.members[a] += moved
