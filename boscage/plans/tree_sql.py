"""SQL that grows small trees, for comparison with training.

Each level is a handful of tables: sums per node and value, running sums,
gains of all cuts with missing rows on either side, and the rows moved to the
children.  Features need few distinct values, so that cuts are midpoints.
"""

from __future__ import annotations

from dataclasses import dataclass

INFINITE = 3.4028234663852886e38


@dataclass
class Grown:
    """Rows (id, features, y, m, ...) come from ``rows``; g and h are SQL over them."""

    rows: str
    features: int
    g: str
    h: str
    start: str
    eta: float = 0.3
    least: float = 1.0
    #: Tables over {source} that add columns which g and h need, one over the other, and those columns.
    extra: tuple[str, ...] = ()
    added: tuple[str, ...] = ()

    def _gain(self, g: str, h: str) -> str:
        return f"(({g}) * ({g}) / (({h}) + 1))"

    def _cuts(self) -> str:
        each = " UNION ".join(f"SELECT DISTINCT {f} AS feat, f{f} AS v FROM t WHERE f{f} IS NOT NULL" for f in range(self.features))
        mid = "CAST(CAST(CAST(v AS REAL) + (CAST({other} AS REAL) - CAST(v AS REAL)) / CAST(2 AS REAL) AS REAL) AS DOUBLE)"
        up, down = mid.format(other="lead(v) OVER w"), mid.format(other="lag(v) OVER w")
        return f"e AS MATERIALIZED (SELECT feat, v, coalesce({up}, {INFINITE}) AS above, coalesce({down}, -{INFINITE}) AS below FROM ({each}) WINDOW w AS (PARTITION BY feat ORDER BY v))"

    def _found(self, at: str, dense: bool) -> list[str]:
        """Tables {at}_s (sums of nodes) and {at}_c (gain of each cut of each node)."""
        each = " UNION ALL ".join(f"SELECT node, {f} AS feat, f{f} AS v, g, h FROM {at} WHERE f{f} IS NOT NULL" for f in range(self.features))
        own = f"{at}_k AS MATERIALIZED (SELECT node, feat, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({each}) GROUP BY 1, 2, 3)"
        grid = f"SELECT s.node, e.feat, e.v, coalesce(k.g, 0) AS g, coalesce(k.h, 0) AS h, coalesce(k.n, 0) AS n FROM {at}_s s CROSS JOIN e LEFT JOIN {at}_k k ON k.node = s.node AND k.feat = e.feat AND k.v = e.v" if dense else f"SELECT * FROM {at}_k"
        left, right = self._gain("gl", "hl"), self._gain("gg - gl", "hh - hl")
        return [
            f"{at}_s AS MATERIALIZED (SELECT node, sum(g) AS gg, sum(h) AS hh, count(*) AS nn FROM {at} GROUP BY 1)",
            own,
            f"{at}_r AS MATERIALIZED (SELECT node, feat, v, sum(g) OVER u AS fg, sum(h) OVER u AS fh, sum(g) OVER p AS tg, sum(h) OVER p AS th, sum(n) OVER p AS tn, g, h FROM ({grid}) "
            "WINDOW u AS (PARTITION BY node, feat ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY node, feat))",
            f"{at}_a AS MATERIALIZED (SELECT r.node, r.feat, r.v, e.above AS cond, false AS dl, fg AS gl, fh AS hl, gg, hh, nn - tn AS missing FROM {at}_r r JOIN e USING (feat, v) JOIN {at}_s USING (node) "
            f"UNION ALL SELECT r.node, r.feat, r.v, e.below, true, gg - (tg - fg + g), hh - (th - fh + h), gg, hh, nn - tn FROM {at}_r r JOIN e USING (feat, v) JOIN {at}_s USING (node))",
            f"{at}_c AS MATERIALIZED (SELECT *, CASE WHEN hl >= {self.least} AND hh - hl >= {self.least} THEN {left} + {right} - {self._gain('gg', 'hh')} END AS gain FROM {at}_a WHERE {'true' if dense else 'NOT dl OR missing > 0'})",
        ]

    def _order(self) -> str:
        return "feat, dl, CASE WHEN dl THEN -v ELSE v END"

    def _moved(self, at: str, new: str) -> str:
        value = "CASE b.feat " + " ".join(f"WHEN {f} THEN a.f{f}" for f in range(self.features)) + " END"
        to = f"CASE WHEN b.node IS NULL THEN a.node WHEN {value} IS NULL THEN CASE WHEN dl THEN b.l ELSE b.l + 1 END WHEN CAST({value} AS REAL) < CAST(cond AS REAL) THEN b.l ELSE b.l + 1 END"
        return f"{new} AS MATERIALIZED (SELECT a.* EXCLUDE (node), {to} AS node FROM {at} a LEFT JOIN {at}_b b ON b.node = a.node)"

    def tree(self, name: str, source: str, policy: str, steps: int) -> tuple[list[str], str]:
        """Tables of one tree over ``source`` (t's columns and m), and the SQL of its nodes; {name}_z holds the rows with m moved on."""
        out = []
        for i, sql in enumerate(self.extra):
            out.append(f"{name}_y{i} AS MATERIALIZED ({sql.format(source=source)})")
            source = f"{name}_y{i}"
        g, h = self.g.format(source=source), self.h.format(source=source)
        out.append(f"{name}0 AS MATERIALIZED (SELECT *, CAST({g} AS DOUBLE) AS g, CAST({h} AS DOUBLE) AS h, 0 AS node FROM {source})")
        splits, every = [], []
        for d in range(steps):
            at = f"{name}{d}"
            out += self._found(at, policy == "symmetric")
            done = " + ".join(f"(SELECT count(*) FROM {x})" for x in splits) or "0"
            if policy == "symmetric":
                every_node = f"(SELECT count(*) FROM {at}_s)"
                out.append(f"{at}_p AS MATERIALIZED (SELECT feat, dl, v, sum(gain) AS total FROM {at}_c GROUP BY 1, 2, 3 HAVING count(gain) = {every_node} AND (NOT dl OR sum(missing) > 0) AND sum(gain) > 1e-6 * {every_node} ORDER BY CAST(total AS FLOAT) DESC, {self._order()} LIMIT 1)")
                chosen = f"SELECT c.* FROM {at}_c c JOIN {at}_p p USING (feat, dl, v)"
            else:
                chosen = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY CAST(gain AS FLOAT) DESC, {self._order()}) AS place FROM {at}_c WHERE gain > 1e-6) WHERE place = 1"
                if policy == "lossguide":
                    chosen = f"SELECT * FROM ({chosen}) ORDER BY CAST(gain AS FLOAT) DESC, node LIMIT 1"
            out.append(f"{at}_b AS MATERIALIZED (SELECT node, feat, cond, dl, 1 + 2 * ({done}) + 2 * (row_number() OVER (ORDER BY node) - 1) AS l FROM ({chosen}))")
            splits.append(f"{at}_b")
            every.append(f"SELECT node, gg, hh FROM {at}_s")
            out.append(self._moved(at, f"{name}{d + 1}"))
        last = f"{name}{steps}"
        every.append(f"SELECT node, sum(g), sum(h) FROM {last} GROUP BY 1")
        out.append(f"{name}_n AS MATERIALIZED (SELECT node, any_value(gg) AS g, any_value(hh) AS h FROM ({' UNION ALL '.join(every)}) GROUP BY 1)")
        out.append(f"{name}_f AS MATERIALIZED ({' UNION ALL '.join(f'SELECT node, feat, cond FROM {x}' for x in splits)})")
        value = f"-n.g / (n.h + 1) * {self.eta}"
        out.append(f"{name}_z AS MATERIALIZED (SELECT a.* EXCLUDE ({', '.join(('node', 'g', 'h', 'm', *self.added))}), CAST(CAST(a.m + {value} AS REAL) AS DOUBLE) AS m FROM {last} a JOIN {name}_n n USING (node))")
        nodes = f"SELECT node, coalesce(f.feat, -1) AS feat, coalesce(f.cond, 0) AS cond, {value} AS value, n.h AS cover FROM {name}_n n LEFT JOIN {name}_f f USING (node)"
        return out, nodes


def nodes_sql(outputs: list[Grown], policy: str, steps: int, rounds: int) -> str:
    """Nodes of the trees of some rounds; each output has trees of its own over the same rows."""
    first = outputs[0]
    tables = [f"t AS MATERIALIZED ({first.rows})", first._cuts()]
    parts = []
    for k, own in enumerate(outputs):
        source = f"o{k}"
        tables.append(f"{source} AS MATERIALIZED (SELECT *, CAST(CAST(({own.start}) AS REAL) AS DOUBLE) AS m FROM t)")
        for r in range(rounds):
            more, nodes = own.tree(f"x{k}_{r}_", source, policy, steps)
            tables += more
            source = f"x{k}_{r}__z"
            parts.append(f"SELECT {r * len(outputs) + k} AS tree, * FROM ({nodes})")
    return "WITH " + ",\n".join(tables) + "\nSELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(feat AS INTEGER) AS feat, round(cond, 4) AS cond, round(value, 4) AS value, round(cover, 1) AS cover FROM (" + " UNION ALL ".join(parts) + ")"
