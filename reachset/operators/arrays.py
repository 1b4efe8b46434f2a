"""Graph searches over arrays: a whole wave of nodes at a time, for searches that settle many nodes.

A wave holds the nodes that are at most one mean edge length behind the nearest open one; a node that a later wave improves is
taken up again, so results are exact for any lengths from 0 on.
"""

from __future__ import annotations

import numpy as np

INF = float("inf")
MOST_BESIDE = 6


class Arrays:
    """Edges by their first node: those of x are at[x] to at[x + 1] in to and length."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        order = np.argsort(a * max(n, 1) + b, kind="stable") if n < 2**31 else np.lexsort((b, a))
        self.n, self.to, self.length = n, b[order].astype(np.int64), w[order].astype(np.float64)
        self.at = np.searchsorted(a[order], np.arange(n + 1))
        self.degree = np.diff(self.at)
        self.step = max(float(self.length.mean()), 1e-300) if len(w) else 1.0
        self._d, self._inside, self._slot = np.empty(0), np.zeros(0, bool), np.empty(0, np.int32)
        self._waits: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        #: Where no node has more than MOST_BESIDE edges: their ends and lengths in rows of one width, filled up by endless loops.
        self.beside = None
        width = int(self.degree.max()) if n else 0
        if 0 < width <= MOST_BESIDE:
            owner = np.repeat(np.arange(n), self.degree)
            column = np.arange(len(self.to)) - self.at[owner]
            ends, lengths = np.repeat(np.arange(n), width).reshape(n, width), np.full((n, width), INF)
            ends[owner, column], lengths[owner, column] = self.to, self.length
            self.beside = ends, lengths

    def edges_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many edges each node has, their places)."""
        many = self.degree[nodes]
        ends = np.cumsum(many)
        return many, np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[nodes] - ends + many, many)

    def offers(self, nodes: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | int]:
        """(neighbours, distances by way of the nodes, how many each node has) for nodes at distances d."""
        if self.beside is None:
            many, e = self.edges_of(nodes)
            return self.to[e], np.repeat(d, many) + self.length[e], many
        ends, lengths = self.beside
        return ends.take(nodes, axis=0).ravel(), (lengths.take(nodes, axis=0) + d[:, None]).ravel(), ends.shape[1]

    def nearest(self, sources: np.ndarray, cutoff: float = INF) -> tuple[np.ndarray, np.ndarray]:
        """Distance of every node to the nearest source and that one's place; ties go to the earlier source, -1: none in reach."""
        d, label = np.full(self.n, INF), np.full(self.n, len(sources), np.int64)
        d[sources[::-1]], label[sources[::-1]] = 0.0, np.arange(len(sources))[::-1]
        self.spread(d, label, np.unique(sources), cutoff)
        label[np.isinf(d)] = -1
        return d, label

    def spread(self, d: np.ndarray, label: np.ndarray, waiting: np.ndarray, cutoff: float = INF) -> np.ndarray:
        """Carry distances and labels on from the waiting nodes to all that they improve, in place; returns the nodes it settles."""
        if self._waits is None:
            self._waits = np.zeros(self.n, bool), np.zeros(self.n, bool), np.empty(self.n, np.int64)
        inside, settled, slot = self._waits  # set back at the end
        inside[waiting] = settled[waiting] = True
        seen = [waiting]
        while len(waiting):
            far = d[waiting]
            now = far <= far.min() + self.step
            wave, waiting = waiting[now], waiting[~now]
            inside[wave] = False
            v, y, many = self.offers(wave, far[now])
            c = np.repeat(label[wave], many)
            old = d[v]
            better = np.flatnonzero(((y < old) | ((y == old) & (c < label[v]))) & (y <= cutoff) & (y < INF))
            v, y, c = v[better], y[better], c[better]
            order = np.lexsort((c, y))[::-1]  # of several offers to a node the best is written last
            v = v[order]
            d[v], label[v] = y[order], c[order]
            v = v[~inside[v]]
            slot[v] = np.arange(len(v))
            v = v[slot[v] == np.arange(len(v))]
            inside[v] = True
            waiting = np.concatenate([waiting, v])
            v = v[~settled[v]]
            settled[v] = True
            seen.append(v)
        nodes = np.concatenate(seen)
        settled[nodes] = False
        return nodes

    def balls(self, sources: np.ndarray, cutoffs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(nodes in ascending order, their distances) within its cutoff for each source, searched side by side.

        The fields of a search stay for the next one; what it touched is set back."""
        n, k = self.n, len(sources)
        if len(self._d) < k * n:
            self._d, self._inside, self._slot = np.full(k * n, INF), np.zeros(k * n, bool), np.empty(k * n, np.int32)
        d, inside, slot = self._d, self._inside, self._slot
        waiting = np.arange(k) * n + sources
        d[waiting], inside[waiting] = 0.0, True
        touched = [waiting]
        while len(waiting):
            far = d[waiting]
            now = far <= far.min() + self.step
            wave, waiting = waiting[now], waiting[~now]
            inside[wave] = False
            row = wave // n
            node = wave - row * n
            v, y, many = self.offers(node, far[now])
            v = v + np.repeat(wave - node, many)
            better = np.flatnonzero((y < d[v]) & (y <= (np.repeat(cutoffs[row], many) if k > 1 else cutoffs[0])))
            v, y = v[better], y[better]
            order = np.argsort(-y)
            v = v[order]
            new = np.isinf(d[v])
            d[v] = y[order]
            out = ~inside[v]
            v, new = v[out], new[out]
            slot[v] = np.arange(len(v), dtype=np.int32)
            one = slot[v] == np.arange(len(v))
            v = v[one]
            inside[v] = True
            touched.append(v[new[one]])
            waiting = np.concatenate([waiting, v])
        nodes = np.sort(np.concatenate(touched))
        dist = d[nodes]
        d[nodes] = INF
        cuts = np.searchsorted(nodes, np.arange(k + 1) * n)
        return [((nodes[x:y] - i * n).astype(np.int32), dist[x:y]) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))]

    def distances(self, sources: np.ndarray, cutoff: float = INF) -> np.ndarray:
        """A row of distances for each source, searched side by side."""
        n, k = self.n, len(sources)
        d = np.full(k * n, INF)
        waiting = np.arange(k) * n + sources
        d[waiting] = 0.0
        inside, slot = np.zeros(k * n, bool), np.empty(k * n, np.int32)
        inside[waiting] = True
        while len(waiting):
            far = d[waiting]
            now = far <= far.min() + self.step
            wave, waiting = waiting[now], waiting[~now]
            inside[wave] = False
            node = wave % n
            v, y, many = self.offers(node, far[now])
            v = v + np.repeat(wave - node, many)
            better = np.flatnonzero((y < d[v]) & (y <= cutoff))
            v, y = v[better], y[better]
            order = np.argsort(-y)
            v = v[order]
            d[v] = y[order]
            v = v[~inside[v]]
            slot[v] = np.arange(len(v))
            v = v[slot[v] == np.arange(len(v))]
            inside[v] = True
            waiting = np.concatenate([waiting, v])
        return d.reshape(k, n)

    def before(self, d: np.ndarray, label: np.ndarray, sources: np.ndarray) -> np.ndarray:
        """Predecessor of every node on a shortest path from its source; -1 for sources and nodes out of reach."""
        u = np.repeat(np.arange(self.n), self.degree)
        fits = (d[u] + self.length == d[self.to]) & (label[u] == label[self.to]) & np.isfinite(d[u])
        u, v = u[fits], self.to[fits]
        out = np.full(self.n, -1)
        is_source = np.zeros(self.n, bool)
        is_source[sources] = True
        done = is_source | np.isinf(d)
        nearer = d[u] < d[v]
        todo = nearer & ~done[v]
        out[v[todo][::-1]] = u[todo][::-1]
        done[v[todo]] = True
        while len(todo := np.flatnonzero(done[u] & ~done[v])):  # nodes that only edges of length 0 reach
            out[v[todo]] = u[todo]
            done[v[todo]] = True
        return out


def best_member(net: Arrays, current: int, objective: str, epsilon: float) -> tuple[int, int]:
    """(node with the least largest distance (or sum of distances) to all nodes, searches made); ties go to the lowest node.

    The current node stays unless a better one gains more than epsilon. Searches bound the values of all nodes from below; only
    nodes whose bound can still win are searched, so the result is that of a search from every node.
    """
    n, made = net.n, 1
    bound, open_ = np.zeros(n), np.ones(n, bool)
    marks: list[np.ndarray] = []

    def take(s: int, d: np.ndarray) -> float:
        nonlocal bound
        mine = float(d.max()) if objective == "minimax" else float(d.sum())
        open_[s] = False
        if objective == "minimax":
            np.maximum(bound, np.maximum(d, mine - d), out=bound)
        else:
            np.maximum(bound, mine - n * d, out=bound)
        return mine

    d = net.distances(np.array([current]))[0]
    if np.isinf(d).any():
        return current, made  # not connected: every node's value is infinite
    now = take(current, d)
    best, at = now, current
    if objective == "minisum":
        # far marks in all directions; the larger of two marks' differences sums up by sorting, for all nodes at once
        least = d
        for _ in range(MARKS):
            f = int(np.argmax(least))
            if least[f] == 0:
                break
            made += 1
            x = net.distances(np.array([f]))[0]
            mine = take(f, x)
            if (mine, f) < (best, at):
                best, at = mine, f
            marks.append(x)
            least = np.minimum(least, x)
        for i, x in enumerate(marks):
            for y in marks[:i]:
                np.maximum(bound, (_spread(x + y) + _spread(x - y)) / 2, out=bound)
    slack = 1e-9

    def can_win() -> np.ndarray:
        left = np.flatnonzero(open_ & (bound <= best + slack * max(1.0, best)))
        return left[(bound[left] < best) | (left < at)]

    left = can_win() if objective == "minisum" else ()
    if len(left) > FEW:
        seeds = np.unique(np.linspace(0, n - 1, min(n, GROUPS)).astype(np.int64))
        group = net.nearest(seeds)[1]
        pool = np.arange(n)  # marks lie far out at first, then around the nodes that are left
        while True:
            sums, at_left = _sums_to(net, pool, at, left, group, len(seeds))
            made += len(sums)
            size, before, own = np.bincount(group, minlength=len(seeds)).astype(float), len(left), left
            for every in (max(1, before // FEW), 1):  # a few nodes first, so that fewer can win
                part = np.searchsorted(own, left[::every])
                x = own[part]
                bound[x] = np.maximum(bound[x], _grouped(sums, at_left[:, part], size, best))
                for s in x[np.argsort(bound[x], kind="stable")[:SIDE_BY_SIDE]].tolist():
                    if open_[s] and bound[s] < best:
                        made += 1
                        mine = take(s, net.distances(np.array([s]))[0])
                        if (mine, s) < (best, at):
                            best, at = mine, s
                left = can_win()
            if len(left) <= FEW or 4 * len(left) > 3 * before:
                break
            made += 1
            d = net.distances(np.array([at]))[0]
            around = float(d[left].max())
            ring = np.flatnonzero((d >= around) & (d <= around + 2 * net.step))
            pool = ring if len(ring) else pool
    while True:
        left = can_win()
        if not len(left):
            break
        tried = left[np.argsort(bound[left], kind="stable")[: 1 if objective == "minimax" else max(1, min(SIDE_BY_SIDE, 500_000 // n))]]
        found = net.distances(tried)
        made += len(tried)
        for s, d in zip(tried.tolist(), found):
            mine = take(s, d)
            if (mine, s) < (best, at):
                best, at = mine, s
            far = int(np.argmax(d))
            if objective == "minimax" and open_[far]:
                made += 1
                x = net.distances(np.array([far]))[0]
                mine = take(far, x)
                if (mine, far) < (best, at):
                    best, at = mine, far
    return (at if best < now - epsilon else current), made


#: Far nodes searched at first for bounds of sums; searches side by side.
MARKS, SIDE_BY_SIDE = 12, 8
#: Nodes that may be left before closer bounds are worth their searches; marks and groups of nodes for those.
FEW, MORE_MARKS, GROUPS = 100, 64, 3_000


def _sums_to(net: Arrays, pool: np.ndarray, start: int, left: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks from the pool that lie far from start and each other: (sums of distances to each group of nodes, distances to left), a row each."""
    least = net.distances(np.array([start]))[0][pool]
    sums, at_left = [], []
    for _ in range(min(MORE_MARKS, len(pool))):
        x = net.distances(pool[[int(np.argmax(least))]])[0]
        least = np.minimum(least, x[pool])
        sums.append(np.bincount(group, weights=x, minlength=groups))
        at_left.append(x[left])
    return np.array(sums), np.array(at_left)


def _grouped(sums: np.ndarray, at: np.ndarray, size: np.ndarray, best: float) -> np.ndarray:
    """Lower bounds of the sums of distances from nodes, whose distances to the marks are the columns of at.

    A node v is at least d(m, v) - d(m, x) from x for any mark m; of each group of nodes the sum over the best mark counts.
    Nodes that a quarter of the marks puts above best get no closer bound."""
    out = np.empty(at.shape[1])
    for lo in range(0, len(out), 128):
        x = np.arange(lo, min(lo + 128, len(out)))
        most = np.zeros((len(x), len(size)))
        for marks in (slice(0, None, 4), slice(1, None, 4), slice(2, None, 4), slice(3, None, 4)):
            for s, d in zip(sums[marks], at[marks]):
                np.maximum(most, s - d[x][:, None] * size, out=most)
            out[x] = most.sum(axis=1) * (1 - 1e-12)
            open_ = out[x] <= best
            x, most = x[open_], most[open_]
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    """For every element the sum of its differences, taken positive, to all."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    total, place = np.cumsum(s), np.arange(1, len(s) + 1)
    out = np.empty(len(s))
    out[order] = s * place - total + (total[-1] - total) - s * (len(s) - place)
    return out
