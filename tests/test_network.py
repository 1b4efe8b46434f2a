"""Invariants of the coverage engine on hand-made graphs and grids."""

import pytest
from pyspark.sql import functions as F

from reachset.functions import geo
from reachset.operators import centers, coverage, paths, topology
from reachset.sources import network

SEARCHES = ["path_multi_source", "path_argmax", "path_matrix", "path_diameter", "cov_record", "cov_assignment", "out_nodes"]
TIES = [(0, 0, 1, 5), (1, 1, 2, 5), (2, 0, 3, 5), (3, 3, 2, 5), (4, 1, 1, 7), (5, 0, 1, 9), (6, 6, 7, 2)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(TIES, "edge_id long, u long, v long, length_m long")


@pytest.fixture(scope="module")
def grid(spark):
    n, rows = 7, []
    for i in range(n):
        for j in range(n):
            if j + 1 < n:
                rows.append((len(rows), i * n + j, i * n + j + 1, 100 + (i * 7 + j * 3) % 5))
            if i + 1 < n:
                rows.append((len(rows), i * n + j, (i + 1) * n + j, 100 + (i * 5 + j) % 7))
    e = spark.createDataFrame(rows, "edge_id long, u long, v long, length_m long")
    adj = topology.adjacency(e).persist()
    nodes = adj.select(F.col("u").alias("node")).distinct().persist()
    return nodes, adj, paths.reach(adj, nodes).persist()


def test_adjacency_and_degree(edges):
    assert {(r.u, r.v): r.w for r in topology.adjacency(edges).collect()}[(1, 0)] == 5
    assert {r.node_id: r.degree for r in topology.degree(edges).collect()}[1] == 5
    assert topology.simple_graph(edges).count() == 5


def test_components(edges):
    assert {(r.node_id, r.comp) for r in topology.components(edges).collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (6, 6), (7, 6)}


@pytest.mark.parametrize("block", [1, 3, 100])
def test_search_ties_go_to_the_first_source(edges, block):
    got = {r.node: (r.d, r.label) for r in paths.multi_source(topology.adjacency(edges), [2, 0, 2], block_nodes=block).collect()}
    assert got == {2: (0, 0), 0: (0, 1), 1: (5, 0), 3: (5, 0)}


def test_search_agrees_with_reach_and_cells_are_connected(grid):
    nodes, adj, dist = grid
    a = paths.multi_source(adj, [3, 40, 22], block_nodes=10)
    c = adj.sparkSession.createDataFrame([(3, 0), (40, 1), (22, 2)], "src long, label int")
    want = {(r.node, r.d, r.label) for r in paths.nearest_of(dist, c).collect()}
    assert {(r.node, r.d, r.label) for r in a.collect()} == want
    labels = {r.node: r.label for r in a.collect()}
    assert all(r.pred is None or labels[r.pred] == r.label for r in a.collect())
    inner = paths.masked(adj, a.select("node", "label"))
    assert paths.multi_source(inner.select("u", "v", "w"), [3, 40, 22]).count() == nodes.count()


@pytest.mark.parametrize("objective", ["minimax", "minisum"])
def test_cell_centre_is_never_worse(grid, objective):
    _, adj, dist = grid
    c = adj.sparkSession.createDataFrame([(0, 0), (48, 1)], "src long, label int")
    a = paths.nearest_of(dist, c)
    for new in (centers.centers_in_cells(adj, a, c, objective), centers.centers_by_distance(dist, a, c, objective)):
        assert {r.label for r in new.collect()} == {0, 1}


@pytest.mark.parametrize("name", ["pullseed", "gonzalez", "lscp"])
def test_algorithms_cover(grid, name):
    nodes, adj, dist = grid
    run = coverage.Run(nodes, adj, coverage.Params(radius=250.0, prune=True), dist)
    run = coverage.greedy_cover(run, dist) if name == "lscp" else coverage.ALGORITHMS[name](run)
    assert run.steps[-1]["kind"] == "final" and run.steps[-1]["max_dist"] <= 250.0 and run.steps[-1]["covered"] == 1.0
    last = run.steps[-1]["centers"]
    assert len(last) == len(set(last))
    assert coverage.steps_df(run).count() == len(run.steps)


def test_prune_keeps_the_only_centre_of_a_component(edges, spark):
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 6, 7)], "node long")
    run = coverage.Run(nodes, topology.adjacency(edges), coverage.Params(radius=20.0))
    assert set(coverage.prune(run, [0, 2, 6])) in ({0, 6}, {2, 6})


def test_abort(grid):
    nodes, adj, dist = grid
    run = coverage.gonzalez(coverage.Run(nodes, adj, coverage.Params(radius=10.0, max_steps=3), dist))
    assert [s["kind"] for s in run.steps] == ["init", "add", "add", "abort"]


def test_geometry(spark):
    line = F.array(geo.point(F.lit(0.0), F.lit(0.0)), geo.point(F.lit(3.0), F.lit(4.0)), geo.point(F.lit(3.0), F.lit(10.0)))
    row = spark.range(1).select(geo.length(line, geo.planar).alias("n"), geo.point_along(line, F.lit(8.0), geo.planar).alias("p"), F.size(geo.split_equal(line, F.lit(4), geo.planar)).alias("k"), geo.wkt_line(F.lit("linestring (34.1 32.1, 34.2 32.1)")).alias("w")).first()
    assert row.n == 11.0 and (row.p.lon, row.p.lat) == (3.0, 7.0) and row.k == 4 and row.w[1].lon == 34.2
    with pytest.raises(Exception, match="not a LINESTRING"):
        spark.range(1).select(geo.wkt_line(F.lit("POINT (1 2)"))).collect()


def test_tag_filters_are_unanchored(spark):
    tags = spark.createDataFrame([(1, {"highway": "motorway_link"}), (2, {"highway": "path"}), (3, {}), (4, {"highway": "residential", "foot": "none"})], "id int, tags map<string,string>")
    assert {r.id for r in tags.filter(network.tag_filter(F.col("tags"), "walk")).collect()} == {2}


def test_osm_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"elements":[{"type":"node","id":1,"lat":32.0,"lon":34.0},{"type":"node","id":2,"lat":32.0,"lon":34.001},{"type":"way","id":9,"nodes":[1,2,2,5],"tags":{"highway":"x"}}]}')
    nodes, ways = network.read_osm_json(spark, str(tmp_path / "a.json"))
    e = network.way_edges(ways, nodes).collect()
    assert len(e) == 1 and e[0].length_m == pytest.approx(94.3, abs=0.1)


def test_query_cache(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert network.cached_query(spark, str(tmp_path), "q", make).count() == 3
    assert len(calls) == 1


def test_subdivide_query_takes_every_way(spark, tmp_path):
    """Ways 20 and 21 share their inner vertex; only a query over all ways sees it."""
    from reachset.plans import registry

    parts = [(w, i, v, 1, 1.0) for w, vs in ((20, (1, 2, 3)), (21, (4, 2, 5)), (22, (6, 7, 8))) for i, v in enumerate(vs)]
    spark.createDataFrame(parts, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(w, "1-URGENT", "F") for w in (20, 21, 22)], "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert {(r.line_id, r.parts) for r in registry.geo_subdivide(spark, str(tmp_path)).collect()} == {(20, 2), (21, 2), (22, 1)}


def test_registered_coverage_takes_the_whole_network(spark, tmp_path):
    """Registered queries against brute force over all pairs, on more than 400 nodes."""
    import heapq

    from reachset.plans import fixtures, registry

    spark.range(480).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    d = str(tmp_path)
    adj = {}
    for r in topology.adjacency(fixtures.net(spark, d)[1]).collect():
        adj.setdefault(r.u, []).append((r.v, r.w))

    def search(s):
        best, heap = {s: 0}, [(0, s)]
        while heap:
            x, u = heapq.heappop(heap)
            for v, w in adj[u] if x == best[u] else ():
                if x + w < best.get(v, x + w + 1):
                    best[v] = x + w
                    heapq.heappush(heap, (x + w, v))
        return best

    far = {s: search(s) for s in adj}
    end = lambda s: min(far[s], key=lambda n: (-far[s][n], n))
    a = end(end(min(adj)))
    assert [r.node for r in registry.cov_init_diameter(spark, d).orderBy("idx").collect()] == [a, end(a)]
    inf, c = float("inf"), [a]
    steps = []
    while True:
        dist = {n: min(far[s].get(n, inf) for s in c) for n in adj}
        top = min(dist, key=lambda n: (-dist[n], n))
        steps.append((list(c), dist[top]))
        if dist[top] <= 1200:
            break
        c.append(top)
    got = registry._steps(spark, d, "gonzalez", radius=1200.0).orderBy("step").collect()
    assert [(s.centers, s.max_dist) for s in got if s.kind != "final"] == steps
    assert sum(r["size"] for r in registry.clus_group(spark, d).collect()) == len(far[0].keys() | far[60].keys() | far[130].keys())


@pytest.mark.parametrize("name", ["out_geojson_step", "view_edge_state", "out_step_sf"])
def test_results_on_a_network_of_several_components(spark, tmp_path, name):
    """Among 1369 nodes three edges are reached from neither source."""
    import duckdb

    from reachset.plans import registry

    d = str(tmp_path)
    spark.range(1369).select(F.col("id").alias("c_custkey")).write.parquet(f"{d}/customer.parquet")
    for table, columns in (("lineitem", "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"), ("orders", "o_orderkey long, o_custkey long, o_totalprice double")):
        spark.createDataFrame([], columns).write.parquet(f"{d}/{table}.parquet")
    con = duckdb.connect()
    for table in ("customer", "lineitem", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet/*.parquet'")
    got = getattr(registry, name)(spark, d)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.sql(registry.oracle_sql()[name]).fetchall()))


@pytest.mark.parametrize("name", ["out_qgis", "view_moves_marks"])
def test_logs_of_orders_with_one_key_and_of_lines_without_number(spark, tmp_path, name):
    import duckdb

    from reachset.plans import registry

    d = str(tmp_path)
    spark.range(30).select(F.col("id").alias("c_custkey")).write.parquet(f"{d}/customer.parquet")
    orders = [(1, 7, 10.0, "1-URGENT", "O"), (1, 8, 20.0, "2-HIGH", "F"), (2, None, 5.0, None, "O"), (3, 9, 1.0, "5-LOW", "F"), (3, 9, 1.0, "5-LOW", "F"), (4, 11, 2.0, "5-LOW", "F"), (None, 3, 2.0, "5-LOW", "F")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    lines = [(1, 2, 5, 1, 1.0), (1, None, 9, 1, 1.0), (1, 1, None, 1, 1.0), (1, 1, 6, None, 1.0), (2, 1, 4, 1, None), (2, 1, 4, 2, 3.0), (3, None, None, 1, 1.0), (3, None, 2, 1, 1.0), (4, 1, 3, 1, 1.0), (None, 1, 3, 1, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{d}/lineitem.parquet")
    con = duckdb.connect()
    for table in ("customer", "lineitem", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet/*.parquet'")
    got = getattr(registry, name)(spark, d)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.sql(registry.oracle_sql()[name]).fetchall()))


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_take_no_rounds_over_tables(spark, tmp_path, monkeypatch, name):
    """A network that one task holds is searched there, however many blocks of ids it has; the result is that of the SQL."""
    import duckdb

    from reachset.plans import registry

    d = str(tmp_path)
    spark.range(480).select(F.col("id").alias("c_custkey")).write.parquet(f"{d}/customer.parquet")
    monkeypatch.setattr(paths, "settle", lambda df: pytest.fail("a round over tables"))
    got = getattr(registry, name)(spark, d).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{d}/customer.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(registry.oracle_sql()[name]).fetchall()))


def test_registered_greedy_cover_takes_all_nodes_as_candidates(spark, tmp_path):
    """On more nodes than the default number of candidates, against a greedy cover over the balls of all nodes."""
    from reachset.plans import fixtures, registry

    d = str(tmp_path)
    spark.range(1700).select(F.col("id").alias("c_custkey")).write.parquet(f"{d}/customer.parquet")
    rows = topology.adjacency(fixtures.net(spark, d)[1]).collect()
    ball = {r.u: {r.u: 0} for r in rows}
    out = {}
    for r in rows:
        out.setdefault(r.u, []).append((r.v, r.w))
    for s, found in ball.items():
        wave = [s]
        while wave:
            wave = [v for u in wave for v, w in out[u] if found[u] + w <= 500 and found[u] + w < found.get(v, 501) and not found.update({v: found[u] + w})]
    open_, want = set(ball), []
    while open_:
        pick = min(ball, key=lambda x: (-len(open_ & ball[x].keys()), x))
        open_ -= ball[pick].keys()
        want.append((len(want), len(want) + 1, pick))
    assert len(ball) > coverage.Params().candidate_cap
    assert sorted(map(tuple, registry.cov_lscp(spark, d).collect())) == want


def _line(*points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def test_snap_lines_of_parts(spark):
    rows = [(1, [_line((0, 0), (10, 0)), _line((10.1, 0), (10.1, 7))]), (2, [_line((50, 50), (50.1, 50.1))]), (3, [_line((80, 80)), _line((90, 90), (90, 90)), None]), (4, None), (5, [_line((90, 0), (92, 0))])]
    lines = spark.createDataFrame(rows, f"line_id long, parts array<{geo.LINE}>")
    nodes, edges = network.snap_lines(lines, 0.5, 4.0)
    got = sorted((r.line_id, r.part, r.piece, round(r.length_m, 6)) for r in edges.collect())
    # the two parts of line 1 meet; line 2 is a loop on the grid; points, nulls and lines without length give nothing
    assert got == [(1, 0, 1, 3.333333), (1, 0, 2, 3.333333), (1, 0, 3, 3.333333), (1, 1, 1, 3.5), (1, 1, 2, 3.5), (5, 0, 1, 2.0)]
    at = {(round(r.lon, 3), round(r.lat, 3)): r.node_id for r in nodes.collect()}
    assert (10.0, 0.0) in at and (10.1, 0.0) not in at  # a node lies at its first point
    assert sorted(at.values()) == list(range(len(at))) and len(at) == 9
    kept, left = network.snap_lines(lines, 0.5, 4.0, largest=True)
    assert kept.count() == 6 and left.count() == 5
    assert network.snap_lines(lines, 0.0)[0].count() == 8  # only equal points meet
    assert network.snap_lines(lines.limit(0), 0.5, 4.0, largest=True)[1].count() == 0


def test_prepared_lines(spark):
    # a cross that two lines share a vertex in, with a bend; an island that goes
    rows = [(1, _line((0, 0), (100, 0), (300, 0))), (2, _line((100, 0), (100, 100), (200, 100))), (3, _line((900, 900), (910, 900))), (4, None), (5, _line((1, 1)))]
    lines = spark.createDataFrame(rows, f"line_id long, geom {geo.LINE}")
    got = sorted(r.length_m for r in network.prepare_lines(lines, 0.0).collect())
    assert got == [100.0, 200.0, 200.0]
    got = sorted(r.length_m for r in network.prepare_lines(lines, 100.0).collect())
    assert got == [50.0] * 6 + [100.0] * 2  # one point, two points, two points
    assert network.prepare_lines(lines.limit(0)).count() == 0


def test_outer_rings(spark):
    ring = [[0, 0], [0.5, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    texts = [f'[{{"geojson":{{"type":"Polygon","coordinates":[{ring},[[0,0],[1,1],[1,0],[0,0]]]}}}}]', f'[{{"geojson":{{"type":"MultiPolygon","coordinates":[[{ring}],[{ring}]]}}}}]', '[{"geojson":{"type":"Point","coordinates":[1,2]}}]', "[]", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", network.outer_rings(F.col("t")).alias("r")).orderBy("i").collect()
    assert [None if r.r is None else [len(x) for x in r.r] for r in rows] == [[5], [5, 5], None, None, None]
    assert [(p.lon, p.lat) for p in rows[0].r[0]] == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]


def test_limits():
    with pytest.raises(ValueError, match="empty"):
        network.check_limits(0)
    with pytest.warns(UserWarning, match="40000 nodes"):
        network.check_limits(40_000, large=30_000)
    with pytest.warns(UserWarning, match="151 km2"):
        network.check_limits(10, 151.0)
