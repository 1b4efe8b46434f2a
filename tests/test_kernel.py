"""The one-task coverage runs against a naive version that recomputes everything from the distances of all pairs, and against the loops."""

import itertools
import os
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachset.operators import arrays as A
from reachset.operators import coverage as V
from reachset.operators import kernel as K

INF = float("inf")


def network(seed, n=60, extra=35, parts=1):
    rng = np.random.default_rng(seed)
    edges = {}
    for p in range(parts):
        own = list(range(p, n, parts))
        for i, x in enumerate(own[1:], 1):
            edges[own[rng.integers(max(0, i - 4), i)], x] = int(rng.integers(40, 200))
        for _ in range(extra // parts):
            a, b = sorted(rng.choice(own, 2, replace=False).tolist())
            edges[a, b] = int(rng.integers(40, 200))
    return n, edges


def all_pairs(n, edges):
    d = np.full((n, n), INF)
    np.fill_diagonal(d, 0)
    for (a, b), w in edges.items():
        d[a, b] = d[b, a] = min(d[a, b], w)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :])
    return d


class Naive:
    def __init__(self, n, edges, radius, limit=10**9, objective="minimax"):
        self.n, self.edges, self.radius, self.limit, self.objective = n, edges, radius, limit, objective
        self.d, self.steps = all_pairs(n, edges), []

    def assign(self, c):
        dist = self.d[c].min(axis=0)
        label = np.where(np.isinf(dist), -1, self.d[c].argmin(axis=0))
        return dist, label

    def record(self, kind, c):
        dist, _ = self.assign(c)
        far = int(dist.argmax())
        self.steps.append((kind, tuple(c), float(dist.max()), far if dist.max() > 0 else None))
        return dist.max(), far

    def initial(self):
        far = lambda x: int(np.where(np.isinf(self.d[x]), -1, self.d[x]).argmax())
        a = far(far(0))
        return [a, far(a)] if far(a) != a else [a]

    def pull(self, c):
        dist, label = self.assign(c)
        new = list(c)
        for i, s in enumerate(c):
            own = [x for x in range(self.n) if label[x] == i]
            inner = all_pairs(self.n, {e: w for e, w in self.edges.items() if label[e[0]] == i == label[e[1]]})
            value = (lambda x: inner[x, own].max()) if self.objective == "minimax" else (lambda x: inner[x, own].sum())
            best = min(own, key=lambda x: (value(x), x))
            if value(best) < value(s) - 1e-6:
                new[i] = best
        return new

    def pull_and_seed(self):
        c = self.initial()
        top, far = self.record("init", c)
        while top > self.radius:
            new = self.pull(c)
            if new != c:
                c = new
                top, far = self.record("move", c)
            else:
                self.record("stuck", c)
                c = [*c, far]
                top, far = self.record("add", c)
        self.record("final", c)

    def gonzalez(self):
        c = self.initial()[:1]
        top, far = self.record("init", c)
        while top > self.radius:
            c = [*c, far]
            top, far = self.record("add", c)
        self.record("final", c)

    def greedy(self):
        near, open_, c = self.d <= self.radius, np.ones(self.n, bool), []
        while open_.any():
            pick = int((near & open_).sum(axis=1).argmax())
            c.append(pick)
            open_ &= ~near[pick]
            self.record("init" if len(c) == 1 else "add", c)
        self.record("final", c)


def frames(spark, n, edges):
    rows = [(a, b, w) for (a, b), w in edges.items()]
    adj = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "u long, v long, w long")
    return spark.range(n).select(F.col("id").alias("node")), adj


def log(df):
    return [(r.kind, tuple(r.centers), r.max_dist, r.farthest) for r in df.orderBy("step").collect()]


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 1), (3, 3)])
def test_runs_against_naive_ones(spark, seed, parts):
    n, edges = network(seed, parts=parts)
    nodes, adj = frames(spark, n, edges)
    p = V.Params(radius=260.0, budget_s=INF)
    for name, run in (("pullseed", Naive.pull_and_seed), ("gonzalez", Naive.gonzalez), ("lscp", Naive.greedy)):
        naive = Naive(n, edges, 260.0)
        run(naive)
        assert log(V.steps(nodes, adj, p, name)) == naive.steps, name


def test_minisum_runs_against_a_naive_one(spark):
    n, edges = network(5)
    nodes, adj = frames(spark, n, edges)
    naive = Naive(n, edges, 260.0, objective="minisum")
    naive.pull_and_seed()
    assert log(V.steps(nodes, adj, V.Params(radius=260.0, objective="minisum", budget_s=INF), "pullseed")) == naive.steps


def test_fixed_k_fills_up_before_its_first_step(spark):
    n, edges = network(7)
    nodes, adj = frames(spark, n, edges)
    naive = Naive(n, edges, 0.0)
    c = naive.initial()
    while len(c) < 6:
        c = [*c, int(naive.assign(c)[0].argmax())]
    want = [("init", tuple(c))]
    while (new := naive.pull(c)) != c:
        c = new
        want.append(("move", tuple(c)))
    want += [("stuck", tuple(c)), ("final", tuple(c))]
    p = V.Params(radius=10.0, k=6, budget_s=INF)
    assert [(k, c) for k, c, _, _ in log(V.steps(nodes, adj, p, "fixedk"))] == want


def test_prune_takes_out_what_others_cover(spark):
    n, edges = network(8, n=80)
    nodes, adj = frames(spark, n, edges)
    d = all_pairs(n, edges)
    steps = V.steps(nodes, adj, V.Params(radius=400.0, prune=True, budget_s=INF), "gonzalez").orderBy("step").collect()
    last = [s for s in steps if s.kind in ("init", "add")][-1].centers
    label = d[last].argmin(axis=0)
    alive = dict.fromkeys(range(len(last)))
    for i in sorted(alive, key=lambda i: ((label == i).sum(), i)):
        left = [last[j] for j in alive if j != i]
        if left and d[left].min(axis=0).max() <= 400:
            del alive[i]
    assert steps[-1].kind == "final" and steps[-1].centers == [last[j] for j in alive]
    assert d[steps[-1].centers].min(axis=0).max() <= 400


def test_post_pull_goes_on_until_nothing_moves_and_the_budget_ends_runs(spark):
    n, edges = network(9)
    nodes, adj = frames(spark, n, edges)
    steps = V.steps(nodes, adj, V.Params(radius=300.0, post_pull=True, budget_s=INF), "gonzalez").orderBy("step").collect()
    naive = Naive(n, edges, 300.0)
    c = next(s for s in reversed(steps) if s.kind in ("init", "add")).centers
    while (new := naive.pull(c)) != c:
        c = new
    assert steps[-1].centers == c
    short = V.steps(nodes, adj, V.Params(radius=100.0, max_steps=3, budget_s=INF), "gonzalez").orderBy("step").collect()
    assert [s.kind for s in short] == ["init", "add", "add", "abort"]


def test_loops_over_frames_agree_with_the_kernel(spark):
    n, edges = network(11, n=30, extra=12)
    nodes, adj = frames(spark, n, edges)
    p = V.Params(radius=420.0, budget_s=INF, k=4, prune=True)
    for name, loop in V.ALGORITHMS.items():
        assert log(V.steps_df(loop(V.Run(nodes, adj, p)))) == log(K.steps(nodes, adj, p, name)), name


def arrays(n, edges):
    pairs = [(a, b, w) for (a, b), w in edges.items()] + [(b, a, w) for (a, b), w in edges.items()]
    u, v, w = (np.array(x) for x in zip(*pairs))
    return K.Network(np.arange(n), u, v, w.astype(float))


def test_assignments_stay_right_when_centres_come_move_and_go():
    rng = np.random.default_rng(2)
    n, edges = network(4, n=70, parts=2)
    d = all_pairs(n, edges)
    a = K.Assignment(arrays(n, edges), [3])
    for _ in range(60):
        c = list(a.centers)
        kind = rng.integers(3)
        if kind == 0 or len(c) == 1:
            c.append(int(rng.integers(n)))
        elif kind == 1:
            c[rng.integers(len(c))] = int(rng.integers(n))
        else:
            c.pop()
        a.become(c)
        dist = d[c].min(axis=0)
        assert a.dist == dist.tolist()
        assert a.label == np.where(np.isinf(dist), -1, d[c].argmin(axis=0)).tolist()


def test_lazy_center_is_optimal_with_enough_rounds():
    for seed in range(12):
        n, edges = network(seed, n=40)
        d = all_pairs(n, edges)
        rng = np.random.default_rng(seed)
        members = sorted(rng.choice(n, 25, replace=False).tolist())
        current = members[int(rng.integers(25))]
        best = K.lazy_center(arrays(n, edges), members, current, d[current].tolist(), rounds=100)
        ecc = d[np.ix_(members, members)].max(axis=1)
        assert d[best, members].max() == ecc.min()
        assert best == current or d[best, members].max() < d[current, members].max()


def test_walked_median_never_gets_worse_and_is_exact_on_trees():
    for seed in range(12):
        n, edges = network(seed, n=40, extra=0)
        d = all_pairs(n, edges)
        best = K.walked_median(arrays(n, edges), [0] * n, 0, list(range(n)), seed, d[seed].sum())
        assert d[best].sum() == d.sum(axis=1).min()
        n, edges = network(seed, n=40)
        d = all_pairs(n, edges)
        best = K.walked_median(arrays(n, edges), [0] * n, 0, list(range(n)), seed, d[seed].sum())
        assert d[best].sum() <= d[seed].sum()


def test_starts(spark):
    n, edges = network(12)
    nodes, adj = frames(spark, n, edges)
    naive = Naive(n, edges, 1.0)
    get = lambda **k: [r.node for r in K.initial(nodes, adj, V.Params(**k)).orderBy("idx").collect()]
    a, b = naive.initial()
    assert get() == [a, b]
    assert get(init="single") == [int(np.maximum(naive.d[a], naive.d[b]).argmin())]
    assert get(init="manual", manual=(7, 3, 7)) == [7, 3]
    assert get(init="random", k=5) == sorted(range(n), key=lambda x: ((x * 7919 + 42 * 104_729) % 10_007, x))[:5]


def test_empty_network(spark):
    nodes, adj = frames(spark, 0, {})
    for name in K.ALGORITHMS:
        assert list(itertools.chain(V.steps(nodes, adj, V.Params(), name).collect())) == []


@pytest.mark.parametrize("seed", range(12))
def test_array_searches_against_heaps(seed):
    """Distances, labels, predecessors and best members on random networks with edges of length 0 and fractions."""
    import heapq
    import random

    from reachset.operators.arrays import Arrays, best_member

    rng = random.Random(seed)
    n, edges = 60, {}
    for i in range(1, n):
        edges[(i, rng.randrange(i))] = rng.choice([0.0, 0.5, 1.0, 2.0, 9.0])
    for _ in range(rng.randrange(60)):
        a, b = rng.sample(range(n), 2)
        edges.setdefault((max(a, b), min(a, b)), rng.choice([1.0, 3.0]))
    rows = [(a, b, w) for (a, b), w in edges.items()] + [(b, a, w) for (a, b), w in edges.items()]
    net = Arrays(n, *(np.array(c) for c in zip(*rows)))

    def search(s):
        best, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            x, u = heapq.heappop(heap)
            for a, v, w in rows if x == best[u] else ():
                if a == u and x + w < best.get(v, K.INF):
                    best[v] = x + w
                    heapq.heappush(heap, (x + w, v))
        return best

    far = [search(s) for s in range(n)]
    sources = np.array([7, 31, 7, 2])
    d, label = net.nearest(sources, 8.0)
    want = [min((far[s][x], i) for i, s in enumerate(sources.tolist())) for x in range(n)]
    assert list(zip(d.tolist(), label.tolist())) == [x if x[0] <= 8 else (K.INF, -1) for x in want]
    for x, p in enumerate(net.before(d, label, sources).tolist()):
        if label[x] >= 0 and x not in (7, 31, 2):
            assert label[p] == label[x] and any((a, b) == (p, x) and d[p] + w == d[x] for a, b, w in rows)
            steps = 0
            while x not in (7, 31, 2):
                x, steps = net.before(d, label, sources)[x], steps + 1
                assert steps <= n
    assert net.distances(np.array([3, 4])).tolist() == [[far[s][x] for x in range(n)] for s in (3, 4)]
    for objective, value in (("minimax", max), ("minisum", sum)):
        values = [value(far[s].values()) for s in range(n)]
        best = min((v, s) for s, v in enumerate(values))
        assert best_member(net, 5, objective, 1e-6)[0] == (best[1] if best[0] < values[5] - 1e-6 else 5)


@pytest.mark.parametrize("algorithm,more", [("gonzalez", {}), ("gonzalez", {"prune": True}), ("lscp", {"prune": True}), ("pullseed", {}), ("gonzalez", {"post_pull": True})])
def test_brief_logs_hold_the_last_centre_only(spark, algorithm, more):
    """All else is as in the full log, totals by blocks included."""
    rows = [(i, i + 1, 60 + 7 * i % 80) for i in range(120)] + [(200 + i, 201 + i, 90) for i in range(30)]
    adj = spark.createDataFrame(rows + [(v, u, w) for u, v, w in rows], "u long, v long, w long")
    nodes = adj.selectExpr("u AS node").distinct()
    p = V.Params(radius=300.0, **more)
    full, brief = ([r.asDict() for r in K.steps(nodes, adj, p, algorithm, b).orderBy("step").collect()] for b in (False, True))
    at = lambda r: {k: v for k, v in r.items() if k not in ("centers", "elapsed_ms")}
    assert len(full) > 20 and [at(r) for r in brief] == [at(r) for r in full]
    assert [r["centers"] for r in brief] == [r["centers"][-1:] for r in full]


@pytest.mark.parametrize(("algorithm", "more"), [("pullseed", {}), ("gonzalez", {"prune": True, "post_pull": True}), ("fixedk", {"k": 4, "prune": True}), ("lscp", {"prune": True})])
def test_assignments_in_arrays_give_the_logs_of_those_in_lists(monkeypatch, algorithm, more):
    monkeypatch.setattr(K, "MANY", 1)  # all searches of cells over arrays, side by side
    for seed, parts in ((1, 1), (2, 1), (3, 3)):
        n, edges = network(seed, n=150, extra=80, parts=parts)
        logs = []
        for wide, at_once in ((10**9, 1), (1, 10**6), (20, 400)):
            monkeypatch.setattr(K, "WIDE", wide)
            monkeypatch.setattr(K, "SIDE_BY_SIDE", at_once)
            loop = K.Loop(arrays(n, edges), asdict(V.Params(radius=300.0, budget_s=INF, exact_limit=8, **more)))
            K.ALGORITHMS[algorithm](loop)
            logs.append([{k: v for k, v in s.items() if k != "elapsed_ms"} for s in loop.steps])
        assert logs[0] == logs[1] == logs[2]
        assert len(logs[0]) > 2


@pytest.mark.parametrize("hub", [False, True])
def test_searches_side_by_side_against_all_pairs(hub):
    n, edges = network(5, n=80, parts=2)
    if hub:  # a node with many edges: no rows of one width
        edges |= {(0, x): 500 + x for x in range(10, 40)}
    d = all_pairs(n, edges)
    net = arrays(n, edges).arrays
    assert (net.beside is None) == hub
    for sources, cutoffs in (([3], [400.0]), ([5, 5, 60], [250.0, INF, 0.0]), ([7, 8], [300.0, 100.0])):
        for s, cutoff, (nodes, dist) in zip(sources, cutoffs, net.balls(np.array(sources), np.array(cutoffs))):
            near = np.flatnonzero((d[s] <= cutoff) & np.isfinite(d[s]))
            assert nodes.tolist() == near.tolist()
            assert dist.tolist() == d[s, near].tolist()


def test_medians_by_closer_bounds_against_all_pairs(monkeypatch):
    """With few nodes and groups, so that small networks take the rounds of marks too."""
    calls = []
    bounds = A._grouped
    monkeypatch.setattr(A, "_grouped", lambda sums, at, size, best: calls.append((sums, at, size, found := bounds(sums, at, size, best))) or found)
    for name, value in (("FEW", 1), ("MORE_MARKS", 8), ("GROUPS", 25), ("MARKS", 2)):
        monkeypatch.setattr(A, name, value)
    for seed in range(8):
        n, edges = network(seed, n=120, extra=90)
        total = all_pairs(n, edges).sum(axis=1)
        best = int(total.argmin())
        assert A.best_member(arrays(n, edges).arrays, seed, "minisum", 1e-6)[0] == (best if total[best] < total[seed] - 1e-6 else seed)
    assert len(calls) >= 16
    n, edges = network(3, n=120, extra=90)
    d = all_pairs(n, edges)
    group = np.arange(n) % 25
    sums = np.array([np.bincount(group, weights=d[m]) for m in (4, 50, 99)])
    found = bounds(sums, d[[4, 50, 99]], np.bincount(group).astype(float), INF)
    assert (found <= d.sum(axis=1)).all() and found.max() > 0


@pytest.mark.parametrize("wide", [10**9, 1])
def test_added_centres_search_where_they_are_nearer(monkeypatch, wide):
    """Distances, labels, totals and counted nodes against all pairs, with edges of length 0, parts and a centre given twice."""
    monkeypatch.setattr(K, "WIDE", wide)
    rng = np.random.default_rng(8)
    n, edges = network(6, n=90, extra=60, parts=2)
    edges = {e: 0 if i % 9 == 0 else w for i, (e, w) in enumerate(edges.items())}
    d = all_pairs(n, edges)
    net = arrays(n, edges)
    c = [3, 40, 11]
    a = K.Assignment(net, c, 150.0)
    a.measure()
    a.forget()
    for x in [3, *rng.permutation(n)[:25].tolist()]:
        was, searches, settled = d[c].min(axis=0), net.searches, net.settled
        c.append(x)
        m = a.add(x).measure()
        dist = d[c].min(axis=0)
        assert a.centers == c and list(a.dist) == dist.tolist()
        assert list(a.label) == np.where(np.isinf(dist), -1, d[c].argmin(axis=0)).tolist()
        assert m == {"max_dist": dist.max(), "mean_dist": pytest.approx(dist.mean()), "covered": (dist <= 150).mean(), "farthest": int(dist.argmax()) if dist.max() > 0 else None}
        assert net.searches == searches + 1
        assert net.settled - settled == (d[x] < was).sum()
    reached = sorted(net.reached(7, 300.0))
    assert reached == np.flatnonzero(d[7] <= 300).tolist() == sorted(net.search(7, cutoff=300.0)[0])


def test_places_of_ids_close_together_and_far_apart():
    for ids in ([], [5], [-3, -1, 0, 4], [1, 10**12, 10**15]):
        x = np.array((ids * 3)[::-1], np.int64)
        assert K.distinct(x).tolist() == ids
        assert K.places(np.array(ids, np.int64), x).tolist() == [ids.index(y) for y in x.tolist()]


@pytest.mark.parametrize(("algorithm", "more"), [("pullseed", {}), ("fixedk", {"k": 6}), ("gonzalez", {"post_pull": True})])
def test_helpers_give_the_logs_of_one_process(monkeypatch, algorithm, more):
    monkeypatch.setattr(K, "MANY", 9)
    n, edges = network(3, n=150, extra=80)
    one = arrays(n, edges)
    many = K.Network(np.arange(n), *(np.array(x) for x in zip(*[(a, b, float(w)) for (x, y), w in edges.items() for a, b in ((x, y), (y, x))])), cores=3)
    logs = []
    for net in (one, many):
        loop = K.Loop(net, asdict(V.Params(radius=300.0, budget_s=INF, exact_limit=4, **more)))
        K.ALGORITHMS[algorithm](loop)
        logs.append([{k: v for k, v in s.items() if k != "elapsed_ms"} for s in loop.steps])
    assert logs[0] == logs[1] and len(logs[0]) > 2
    assert one._helpers is None and len(many._helpers.pids) == 3
    pids = many._helpers.pids
    many.close()
    for pid in pids:  # ended and taken back
        with pytest.raises(ProcessLookupError):
            os.kill(pid, 0)


def test_what_fails_in_a_helper_fails_the_task():
    n, edges = network(3, n=40)
    net = arrays(n, edges)
    net.cores = 2
    busy = net.helpers.start([(0, [1, 2, n + 5], 1), (1, [3, 4], 3)], np.ones(n + 6))
    with pytest.raises(IndexError):
        list(net.helpers.results(busy))
    net.close()
