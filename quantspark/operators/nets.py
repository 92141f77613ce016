"""The pieces of one page and layer as a graph, on arrays, for grouped tasks.

Half-edge 2 i is the first end of piece i, 2 i + 1 its second. What depends on
the order of pieces (which ends found a place, which piece a run takes) loops
over arrays that hold the choices in order; all distances and angles are
computed at once.
"""

from __future__ import annotations

import numpy as np

Ends = list[tuple[float, float, float, float]]


def near_pairs(x: np.ndarray, y: np.ndarray, reach: float, size: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, of points at most `reach` apart, reach being at most `size`: points sorted by cell meet those of
    their own cell and the eight around it."""
    cx, cy = np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64)
    cx, cy = cx - cx.min(initial=0) + 1, cy - cy.min(initial=0) + 1
    wide = int(cy.max(initial=0)) + 2
    cell = cx * wide + cy
    order = np.argsort(cell, kind="stable")
    ranked = cell[order]
    out_i, out_j = [], []
    for step in (d * wide + e for d in (-1, 0, 1) for e in (-1, 0, 1)):
        a = np.searchsorted(ranked, cell + step)
        n = np.searchsorted(ranked, cell + step, "right") - a
        j = np.repeat(np.arange(len(x)), n)
        i = order[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(len(j))]
        ok = (i < j) & (np.hypot(x[j] - x[i], y[j] - y[i]) <= reach)
        out_i.append(i[ok])
        out_j.append(j[ok])
    return np.concatenate(out_i), np.concatenate(out_j)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0..n-1 the least node that edges (a, b) lead to: labels spread along edges and then jump."""
    own = np.arange(n)
    while True:
        was = own.copy()
        np.minimum.at(own, a, was[b])
        np.minimum.at(own, b, was[a])
        own = own[own]
        if (own == was).all():
            return own


class Net:
    """The graph of some pieces; ends at most tol from the end that founded a place lie at that place."""

    def __init__(self, ends: Ends, tol: float):
        at = np.array(ends, float).reshape(-1, 2)
        self.x, self.y, self.n = at[:, 0], at[:, 1], len(at) // 2
        size = max(tol, 0.5)
        self.close = near_pairs(self.x, self.y, tol, size)
        self.node = self._places(np.floor(self.x / size), np.floor(self.y / size))

    def _places(self, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        """The founder of each half-edge's place: the first that it meets, by cell and then by age, or itself."""
        i, j = self.close
        by = np.lexsort((i, cy[i], cx[i], j))
        choices, start = i[by].tolist(), np.searchsorted(j[by], np.arange(len(cx) + 1)).tolist()
        founder = list(range(len(cx)))
        for h in range(len(cx)):
            founder[h] = next((i for i in choices[start[h] : start[h + 1]] if founder[i] == i), h)
        return np.array(founder, np.int64)

    def groups(self) -> list[list[int]]:
        """Pieces joined by ends at most tol apart, in order of their first piece."""
        i, j = self.close
        own = labels(self.n, i // 2, j // 2)
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        return [g.tolist() for g in np.split(order, cuts)] if self.n else []

    def _onward(self, straight_deg: float) -> tuple[list[int], list[int]]:
        """For a run that arrives by a half-edge, the half-edges by which it may go on, best first: where two ends meet the
        other, elsewhere those within the angle, the straightest first, of equals the last. As (choices, starts)."""
        dx, dy = self.x.reshape(-1, 2) @ [-1.0, 1.0], self.y.reshape(-1, 2) @ [-1.0, 1.0]
        far = np.hypot(dx, dy)
        ux, uy = (np.divide(d, far, out=np.zeros(self.n), where=far > 0) for d in (dx, dy))
        ring = self.node[0::2] == self.node[1::2]
        away = np.stack([np.ones(self.n), np.where(ring, 1.0, -1.0)], 1).ravel()  # directions in which a half-edge leaves its place
        hx, hy = np.repeat(ux, 2) * away, np.repeat(uy, 2) * away
        order = np.argsort(self.node, kind="stable")
        ranked = self.node[order]
        first, after = np.searchsorted(ranked, self.node), np.searchsorted(ranked, self.node, "right")
        n = after - first
        a = np.repeat(np.arange(len(n)), n)
        z = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(a))]
        turn = -hx[a] * hx[z] - hy[a] * hy[z]
        ok = (a // 2 != z // 2) & ((n[a] == 2) | (turn >= np.cos(np.radians(straight_deg))))
        a, z, turn = a[ok], z[ok], turn[ok]
        by = np.lexsort((-z, -turn, a))
        return z[by].tolist(), np.searchsorted(a[by], np.arange(len(n) + 1)).tolist()

    def branches(self, straight_deg: float) -> list[list[int]]:
        """Runs between junctions: from the places where not just two ends meet, in the order in which they were founded; then
        what is left, as rings."""
        choices, start = self._onward(straight_deg)
        meet = np.bincount(self.node, minlength=len(self.node))[self.node]
        from_places = np.lexsort((np.arange(len(self.node)), self.node))
        seeds = [*from_places[meet[from_places] != 2].tolist(), *range(0, 2 * self.n, 2)]
        taken, out = bytearray(self.n), []
        for h in seeds:
            run: list[int] = []
            leave = h if not taken[h >> 1] else -1
            while leave >= 0:
                taken[leave >> 1] = 1
                run.append(leave >> 1)
                arrive = leave ^ 1
                leave = next((g for g in choices[start[arrive] : start[arrive + 1]] if not taken[g >> 1]), -1)
            if run:
                out.append(run)
        return out


def pruned(ends: Ends, tol: float, least: float) -> list[int]:
    """What `prune_stubs` keeps of one group: pieces under `least` go while one of their ends is theirs alone, four rounds."""
    at = np.array(ends, float).reshape(-1, 2)
    _, node = np.unique(np.rint(at / max(tol, 0.5)).astype(np.int64), axis=0, return_inverse=True)
    node = node.reshape(-1, 2)
    short = np.hypot(*(at[1::2] - at[0::2]).T) < least
    left = np.ones(len(node), bool)
    for _ in range(4):
        held = np.bincount(node[left, 0], minlength=node.max(initial=0) + 1)
        two = left & (node[:, 0] != node[:, 1])  # a ring's ends are one piece at one node
        held += np.bincount(node[two, 1], minlength=len(held))
        gone = left & short & (held[node] == 1).any(1)
        if not gone.any():
            break
        left &= ~gone
    return np.flatnonzero(left).tolist()


def bridge_dashes(segments: Ends, tol: float, gap: float, angle_deg: float = 8.0) -> list[tuple[list[int], float]]:
    """Groups of segments and the length of the gaps bridged in each: ends at most tol apart join, then collinear ends up to
    `gap` apart, shortest gaps first. For one drawing's pieces in hand; plans merge dashes by `islands.merge_collinear`."""
    at = np.array(segments, float).reshape(-1, 2)
    x, y = at[:, 0], at[:, 1]
    span = at[1::2] - at[0::2]
    far = np.hypot(*span.T)
    head = np.repeat(np.divide(span, far[:, None], out=np.zeros_like(span), where=far[:, None] > 0), 2, axis=0)
    i, j = near_pairs(x, y, max(gap, tol), max(gap, tol, 0.5))
    other = i // 2 != j // 2
    i, j = i[other], j[other]
    step = np.stack([x[i] - x[j], y[i] - y[j]], 1)
    d = np.hypot(*step.T)
    unit = np.divide(step, d[:, None], out=np.zeros_like(step), where=d[:, None] > 0)
    along = lambda a, b: np.abs((a * b).sum(1)) >= np.cos(np.radians(angle_deg))
    touch = d <= tol
    bridge = ~touch & (d <= gap) & along(head[i], head[j]) & along(unit, head[i]) & along(unit, head[j])
    kind, size = (~touch).astype(int), np.where(touch, 0.0, d)
    by = np.lexsort((j // 2, i // 2, size, kind))
    by = by[(touch | bridge)[by]]
    of, members, bridged = list(range(len(span))), [[k] for k in range(len(span))], [0.0] * len(span)
    for a, b, length in zip((i[by] // 2).tolist(), (j[by] // 2).tolist(), size[by].tolist(), strict=True):
        a, b = of[a], of[b]
        if a != b:
            if len(members[a]) < len(members[b]):
                a, b = b, a
            for k in members[b]:
                of[k] = a
            members[a] += members[b]
            bridged[a] += bridged[b] + length
            members[b] = []
    return sorted((sorted(m), g) for m, g in zip(members, bridged, strict=True) if m)
