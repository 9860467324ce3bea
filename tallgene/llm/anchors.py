"""Anchors-hierarchy metric trees over integer points, and nearest-entry assignment by shrinking candidate lists."""

from __future__ import annotations

import math

import numpy as np

#: Points of a leaf at most, unless they are all equal.
LEAF = 24
#: Up to this size of a component, and 1024 of them, float64 holds every squared distance exactly.
EXACT = 1 << 20


class AnchorTree:
    """Balls over ``points`` (n x w, integers as float64), built middle-out.

    About the root of n anchors are taken one by one: the next one is the point farthest from its anchor in the widest ball,
    and takes over the points that are nearer to it; points within half the distance of two anchors stay without a look. Every
    anchor's points become a tree in the same way, and anchors are then joined two by two, the smallest joint ball first. A
    node keeps the span of its points in ``order``, their sum and their number.
    """

    PARTS = ("points", "order", "low", "high", "left", "right", "center", "radius", "total")

    def __init__(self, **parts: np.ndarray):
        for name in self.PARTS:
            setattr(self, name, parts[name])

    @classmethod
    def build(cls, points: np.ndarray) -> AnchorTree:
        self = cls.__new__(cls)
        self.points = points
        self._nodes: list[tuple] = []  # children or members, center, radius, sum
        root = self._grow(np.arange(len(points)))
        self._lay_out(root)
        return self

    def _node(self, members: np.ndarray, children: tuple[int, int] | None) -> int:
        mine = self.points[members]
        total = mine.sum(0)
        center = total / len(members)
        radius = math.sqrt(float(((mine - center) ** 2).sum(1).max()))
        self._nodes.append((members, children, center, radius, total))
        return len(self._nodes) - 1

    def _grow(self, members: np.ndarray) -> int:
        groups = _anchors(self.points[members]) if len(members) > LEAF else []
        if len(groups) < 2:
            return self._node(members, None)
        open_ = [self._grow(members[g]) for g in groups]
        center = np.array([self._nodes[i][2] for i in open_])
        radius = np.array([self._nodes[i][3] for i in open_])
        apart = np.sqrt(np.maximum(0, ((center[:, None] - center[None]) ** 2).sum(2)))
        joint = np.maximum((apart + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
        np.fill_diagonal(joint, np.inf)
        for _ in range(len(open_) - 1):
            a, b = sorted(divmod(int(joint.argmin()), len(joint)))
            both = np.r_[self._nodes[open_[a]][0], self._nodes[open_[b]][0]]
            open_[a] = self._node(both, (open_[a], open_[b]))
            center[a], radius[a] = self._nodes[open_[a]][2], self._nodes[open_[a]][3]
            apart = np.sqrt(((center - center[a]) ** 2).sum(1))
            row = np.maximum((apart + radius + radius[a]) / 2, np.maximum(radius, radius[a]))
            row[np.isinf(joint[a])] = np.inf
            row[a] = np.inf
            joint[a] = joint[:, a] = row
            joint[b] = joint[:, b] = np.inf
        return open_[0]

    def _lay_out(self, root: int) -> None:
        """Nodes top down as arrays; members of a node are a span of the points' new order."""
        place, spans, todo = {}, [], [(root, 0)]
        while todo:
            node, low = todo.pop()
            place[node] = len(spans)
            members, children = self._nodes[node][:2]
            spans.append((node, low, low + len(members)))
            if children:
                todo.append((children[1], low + len(self._nodes[children[0]][0])))
                todo.append((children[0], low))
        self.low, self.high = (np.array([s[i] for s in spans], np.int64) for i in (1, 2))
        kids = [self._nodes[s[0]][1] for s in spans]
        self.left, self.right = (np.array([place[k[i]] if k else -1 for k in kids], np.int64) for i in (0, 1))
        self.center, self.radius, self.total = (np.array([self._nodes[s[0]][i] for s in spans]) for i in (2, 3, 4))
        self.order = np.concatenate([self._nodes[s[0]][0] for s in spans if not self._nodes[s[0]][1]])
        self.points = self.points[self.order]
        del self._nodes

    def arrays(self, prefix: str) -> dict[str, np.ndarray]:
        return {f"{prefix}{name}": getattr(self, name) for name in self.PARTS}

    @classmethod
    def of(cls, arrays, prefix: str) -> AnchorTree:
        return cls(**{name: arrays[f"{prefix}{name}"] for name in cls.PARTS})

    def owners(self, entries: np.ndarray, settle) -> None:
        """Calls ``settle(entry, low, high, total)`` with arrays that cover every point once; its nearest entry is ``entry``, ties to the lower index.

        A ball hands the entries that can be nearest to one of its points to both its halves. An entry goes if another one is nearer
        all over the ball: the difference of squared distances is linear, so its least value is that of the center less
        2 * radius * distance of the entries. A ball with one entry left is settled whole, by its cached sum.
        """
        entries = entries.astype(np.float64)
        squares = (entries * entries).sum(1)
        gaps = np.sqrt(np.maximum(0, squares[:, None] + squares[None] - 2 * entries @ entries.T))
        first = np.zeros(len(entries), bool)
        first[np.unique(entries, axis=0, return_index=True)[1]] = True  # an entry equal to an earlier one never wins
        nodes, open_ = np.zeros(1, np.int64), first[None]
        while len(nodes):
            c, r = self.center[nodes], self.radius[nodes]
            size = (c * c).sum(1)
            far = size[:, None] - 2 * c @ entries.T + squares[None]
            far[~open_] = np.inf
            best = far.argmin(1)
            slack = 1e-9 * (1 + size + r * r + squares.max())
            open_ = open_ & (far - far[np.arange(len(nodes)), best][:, None] <= 2 * r[:, None] * gaps[best] * (1 + 1e-9) + slack[:, None])
            alone = open_.sum(1) == 1
            if alone.any():
                at = nodes[alone]
                settle(best[alone], self.low[at], self.high[at], self.total[at])
            leaf = ~alone & (self.left[nodes] < 0)
            if leaf.any():
                self._leaves(nodes[leaf], open_[leaf], entries, squares, settle)
            inner = ~alone & (self.left[nodes] >= 0)
            nodes, open_ = np.r_[self.left[nodes[inner]], self.right[nodes[inner]]], np.r_[open_[inner], open_[inner]]

    def _leaves(self, nodes, open_, entries, squares, settle) -> None:
        sizes = self.high[nodes] - self.low[nodes]
        at = np.repeat(self.low[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        far = squares[None] - 2 * self.points[at] @ entries.T  # exact, and so are ties
        far[~np.repeat(open_, sizes, axis=0)] = np.inf
        settle(far.argmin(1), at, at + 1, self.points[at])


def _anchors(points: np.ndarray) -> list[np.ndarray]:
    """Members of about the root of n anchors; one group if all points are equal."""
    n = len(points)
    anchors = [points[0]]
    away = np.sqrt(((points - points[0]) ** 2).sum(1))
    owner = np.zeros(n, np.int64)
    for _ in range(math.isqrt(n - 1)):
        widest = int(away.argmax())
        if away[widest] == 0:
            break
        new = points[widest]
        half = np.sqrt(((np.array(anchors) - new) ** 2).sum(1)) / 2
        look = np.flatnonzero(away > half[owner])
        to_new = np.sqrt(((points[look] - new) ** 2).sum(1))
        taken = to_new < away[look]
        away[look[taken]], owner[look[taken]] = to_new[taken], len(anchors)
        anchors.append(new)
    order = np.argsort(owner, kind="stable")
    return [g for g in np.split(order, np.cumsum(np.bincount(owner, minlength=len(anchors)))[:-1]) if len(g)]
