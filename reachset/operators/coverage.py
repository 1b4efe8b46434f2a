"""Coverage algorithms with a log of steps.

``steps`` runs a network of up to ``kernel.MOST_EDGES`` directed edges in one task (see ``kernel``) and larger ones by the
loops of this module, which run on the driver over DataFrame operators. The loops move a centre by exact distances within its
cell, whatever its size; the kernel does so up to exact_limit members, beyond that by the lazy 1-centre or the centroid walk.

Rules: ties in distance go to the earlier centre; the farthest node is the one of largest distance, lowest id; an
unreached node is infinitely far, so pruning never strips a component of its only centre; a step beyond the budget logs
``abort`` and ends without ``final``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import centers as C
from . import kernel, paths
from .lineage import settle

INF = float("inf")
STEP = (
    "step int, kind string, centers array<long>, k int, max_dist double, mean_dist double, covered double, farthest long, "
    "moved array<struct<`from`:long,`to`:long>>, added array<long>, removed array<long>, elapsed_ms double"
)


@dataclass(frozen=True)
class Params:
    radius: float = 500.0
    objective: str = "minimax"
    init: str = "diameter"
    k: int = 5
    manual: tuple[int, ...] = ()
    candidate_cap: int = 1500
    exact_limit: int = 120
    post_pull: bool = False
    prune: bool = False
    max_steps: int = 3000
    budget_s: float = 120.0
    seed: int = 42
    scope: str = "graph"


@dataclass
class Run:
    """One run over nodes(node), an adjacency and optionally a distance relation (src, node, d) of the whole graph.

    With distances, an assignment is a filter and an aggregate; without, it is a block-wise search.
    """

    nodes: DataFrame
    adj: DataFrame
    params: Params
    distances: DataFrame | None = None
    steps: list[dict] = field(default_factory=list)
    began: float = field(default_factory=time.monotonic)
    _memo: tuple | None = None

    def _centers(self, c: list[int]) -> DataFrame:
        return self.nodes.sparkSession.createDataFrame([(int(s), i) for i, s in enumerate(c)], "src long, label int")

    def assign(self, c: list[int]) -> DataFrame:
        if self._memo and self._memo[0] == tuple(c):
            return self._memo[1]
        out = paths.nearest_of(self.distances, self._centers(c)) if self.distances is not None else paths.multi_source(self.adj, c).select("node", "d", "label")
        if self._memo:
            self._memo[1].unpersist()
        self._memo = (tuple(c), out.persist())
        return self._memo[1]

    def extend(self, c: list[int]) -> None:
        """Make the assignment of c from that of all but its last centre: search from that one alone, as far as a node may be off."""
        if self.distances is not None or not self._memo or self._memo[0] != tuple(c[:-1]):
            return
        old = self._memo[1]
        top = old.agg(F.max("d")).first()[0]
        whole = old.count() == self.nodes.count()
        new = paths.multi_source(self.adj, [c[-1]], cutoff=float(top) if whole else None).select("node", "d", F.lit(len(c) - 1).alias("label"))
        both = old.select("node", "d", "label").unionByName(new).groupBy("node").agg(F.min(F.struct("d", "label")).alias("m")).select("node", "m.d", "m.label")
        self._memo = (tuple(c), settle(both).persist())
        old.unpersist()

    def measure(self, c: list[int]) -> dict:
        r = self.params.radius
        d = F.coalesce(F.col("d").cast("double"), F.lit(INF))
        all_ = self.nodes.join(self.assign(c), "node", "left").select("node", d.alias("d"))
        row = all_.agg(F.max("d"), F.avg("d"), F.avg((F.col("d") <= r).cast("double")), F.max(F.struct("d", (-F.col("node")).alias("node")))).first()
        return {"max_dist": row[0], "mean_dist": row[1], "covered": row[2], "farthest": None if row[0] == 0 else -row[3]["node"]}

    def record(self, kind: str, c: list[int], moved=(), added=(), removed=(), measured: dict | None = None) -> dict:
        m = measured or self.measure(c)
        self.steps.append({"step": len(self.steps), "kind": kind, "centers": list(c), "k": len(c), **m, "moved": [{"from": a, "to": b} for a, b in moved], "added": list(added), "removed": list(removed), "elapsed_ms": (time.monotonic() - self.began) * 1000})
        return m

    def over_budget(self, c: list[int]) -> bool:
        if len(self.steps) < self.params.max_steps and time.monotonic() - self.began <= self.params.budget_s:
            return False
        self.record("abort", c)
        return True

    def initial(self) -> list[int]:
        p = self.params
        if p.init == "manual" and p.manual:
            return list(dict.fromkeys(p.manual))
        if p.init == "random":
            order = F.pmod(F.col("node") * 7919 + p.seed * 104_729, F.lit(10_007))
            n = max(1, p.k)
            return [r["node"] for r in self.nodes.orderBy(order, "node").limit(n).collect()]
        start = self.nodes.agg(F.min("node")).first()[0]
        ends = []
        for _ in range(3):
            ends.append(paths.farthest(self.assign([ends[-1] if ends else start])).first()["node"])
        a, b = ends[1], ends[2]
        if p.init != "single":
            return [a, b] if a != b else [a]
        x, y = self.assign([a]).select("node", F.col("d").alias("x")), None
        y = self._one(b)
        best = x.join(y, "node").orderBy(F.greatest("x", "y"), "node").limit(1).first()
        return [best["node"]]

    def _one(self, b: int) -> DataFrame:
        out = paths.nearest_of(self.distances, self._centers([b])) if self.distances is not None else paths.multi_source(self.adj, [b])
        return out.select("node", F.col("d").alias("y"))

    def pull(self, c: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
        """Move every centre to the best member of its cell, all from one assignment."""
        a = self.assign(c)
        if self.params.scope == "graph" and self.distances is not None:
            new = C.centers_by_distance(self.distances, a, self._centers(c), self.params.objective)
        else:
            new = C.centers_in_cells(self.adj, a, self._centers(c), self.params.objective)
        to = {r["label"]: r["new"] for r in new.filter("cur <> new").orderBy("label").collect()}  # a row per centre at most
        return [to.get(i, s) for i, s in enumerate(c)], [(c[i], to[i]) for i in sorted(to)]


def pull_and_seed(run: Run) -> Run:
    c = run.initial()
    m = run.record("init", c)
    while m["max_dist"] > run.params.radius:
        if run.over_budget(c):
            return run
        new, moved = run.pull(c)
        if moved:
            c = new
            m = run.record("move", c, moved=moved)
        else:
            run.record("stuck", c, measured=m)
            c = [*c, m["farthest"]]
            m = run.record("add", c, added=[m["farthest"]])
    return _finish(run, c)


def gonzalez(run: Run) -> Run:
    c = run.initial()[:1]
    m = run.record("init", c)
    while m["max_dist"] > run.params.radius:
        if run.over_budget(c):
            return run
        c = [*c, m["farthest"]]
        run.extend(c)
        m = run.record("add", c, added=[c[-1]])
    return _finish(run, c)


def greedy_cover(run: Run, reach: DataFrame, candidates: DataFrame | None = None) -> Run:
    """reach(src, node, d) holds what each candidate covers; the largest gain is taken, lowest id on ties."""
    near = reach.filter(F.col("d") <= run.params.radius).select("src", "node")
    open_ = settle(near.join(candidates, "src", "left_semi") if candidates is not None else near)
    c: list[int] = []
    while True:
        top = open_.groupBy("src").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "src").limit(1).first()
        if top is None:
            m = run.measure(c) if c else None
            if c and m["max_dist"] <= run.params.radius:
                break
            if not c:
                run.steps.append({"step": 0, "kind": "init", "centers": [], "k": 0, "max_dist": INF, "mean_dist": INF, "covered": 0.0, "farthest": None, "moved": [], "added": [], "removed": [], "elapsed_ms": 0.0})
            pick = m["farthest"] if c else run.nodes.agg(F.min("node")).first()[0]
        else:
            pick = top["src"]
        if c and run.over_budget(c):
            return run
        c = [*c, pick]
        # what the pick covers is taken out of all covers
        done = open_.filter(F.col("src") == pick).select("node") if top is not None else near.filter(F.col("src") == pick).select("node")
        open_ = settle(open_.join(done, "node", "left_anti"))
        run.record("init" if len(c) == 1 and not run.steps else "add", c, added=[pick])
    return _finish(run, c)


def fixed_k(run: Run) -> Run:
    c = run.initial()
    while run.params.init in ("diameter", "single") and len(c) < run.params.k:
        c = [*c, paths.farthest(run.assign(c)).first()["node"]]
    m = run.record("init", c)
    while True:
        if run.over_budget(c):
            return run
        new, moved = run.pull(c)
        if not moved:
            break
        c = new
        m = run.record("move", c, moved=moved)
    run.record("final" if m["max_dist"] <= run.params.radius else "stuck", c, measured=m)
    if run.params.prune:
        c = prune(run, c)
    run.record("final", c)
    return run


def post_pull(run: Run, c: list[int]) -> list[int]:
    while not run.over_budget(c):
        new, moved = run.pull(c)
        if not moved:
            break
        c = new
        run.record("move", c, moved=moved)
    return c


def prune(run: Run, c: list[int]) -> list[int]:
    """Take out centres whose nodes others cover, smallest cell first; nothing if coverage is incomplete."""
    if run.measure(c)["max_dist"] > run.params.radius:
        return c
    r = run.params.radius
    src = run.distances if run.distances is not None else paths.reach(run.adj, run._centers(c).select(F.col("src").alias("node")), r)
    near = src.filter(F.col("d") <= r).join(F.broadcast(run._centers(c)), "src").select("label", "node").persist()
    sizes = {x["label"]: x["size"] for x in C.cell_sizes(run.assign(c)).collect()}
    gone: set[int] = set()
    for i in sorted(range(len(c)), key=lambda i: (sizes.get(i, 0), i)):
        if len(c) - len(gone) == 1:
            break
        alive = near.filter(~F.col("label").isin([-1, *gone]))
        only = alive.groupBy("node").agg(F.count("*").alias("n"), F.max(F.col("label") == i).alias("own")).filter("own and n = 1")
        if only.isEmpty():
            gone.add(i)
            run.record("remove", [s for j, s in enumerate(c) if j not in gone], removed=[c[i]])
    return [s for j, s in enumerate(c) if j not in gone]


def _finish(run: Run, c: list[int]) -> Run:
    if run.params.post_pull:
        c = post_pull(run, c)
    if run.params.prune:
        c = prune(run, c)
    run.record("final", c)
    return run


def lscp(run: Run) -> Run:
    """Greedy cover; of more than candidate_cap nodes that many are candidates, in a fixed pseudorandom order of ids."""
    p = run.params
    candidates = None
    if run.nodes.count() > p.candidate_cap:
        order = F.pmod(F.col("node") * 7919 + p.seed * 104_729, F.lit(10_007))
        candidates = run.nodes.orderBy(order, "node").limit(p.candidate_cap).select(F.col("node").alias("src"))
    sources = run.nodes if candidates is None else candidates.withColumnRenamed("src", "node")
    return greedy_cover(run, paths.reach(run.adj, sources, p.radius))


ALGORITHMS = {"pullseed": pull_and_seed, "gonzalez": gonzalez, "lscp": lscp, "fixedk": fixed_k}


def steps(nodes: DataFrame, adj: DataFrame, params: Params, algorithm: str, brief: bool = False) -> DataFrame:
    """The log of a run: in one task where the network fits, else by the loops above; brief: see ``kernel.steps``."""
    adj = settle(adj)
    if kernel.fits(adj):
        return kernel.steps(nodes, adj, params, algorithm, brief)
    return steps_df(ALGORITHMS[algorithm](Run(nodes, adj, params)))


def steps_df(run: Run) -> DataFrame:
    return run.nodes.sparkSession.createDataFrame([{k: (float(v) if k in ("max_dist", "mean_dist", "covered") and v is not None else v) for k, v in s.items()} for s in run.steps], STEP)


def estimate_seconds(n: int, m: int, total_m: float, radius: float, algorithm: str, per_item: float = 1.5e-7, cap: int = 1500) -> float:
    """Runtime model from the size of the network."""
    k = max(1.0, 60 * total_m / (2 * radius * radius))
    per = (n + m) * per_item
    return {"pullseed": 20 * k * per, "gonzalez": k * per, "lscp": cap * 0.2 * per + k * per, "fixedk": 150 * per}[algorithm]
