"""What a task holds, and what is sent, must not outgrow the input."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph
from graphloom.operators import algebra, community, generators, layout, sampled, sparsify, tiled
from graphloom.operators import triangles as tri
from graphloom.plans import fixtures as fx

SMALL = "/root/testdata/sf0.001"


def test_co_orders_partitions_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(fx, "DEALT", 1000, raising=False)
    g = fx.co_orders(spark, SMALL)
    orders: dict = {}
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    want = Counter(pair for parts in orders.values() for pair in combinations(sorted(parts), 2))
    assert {(r.src, r.dst): r.w for r in g.edges.collect()} == want
    assert g.edges.rdd.getNumPartitions() >= sum(map(len, orders.values())) // 1000


def test_edges_go_to_tiles_in_packs_and_keep_their_triangles(spark):
    rng = random.Random(3)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(60)]
    edges = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(1200)})
    g = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, w double"))
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for tile in (tri.TILE, 400):
        assert {(r.src, r.dst): r.t for r in tri.edge_triangles(g, tile).collect()} == {(a, b): len(near[a] & near[b]) for a, b in edges if near[a] & near[b]}
    many = Graph.from_edges(spark.range(20000).select(F.col("id").alias("src"), (F.col("id") * 7919 % 20000).alias("dst")).where("src <> dst"))
    assert tri._tiles(many, tri.TILE)[0].count() < many.edges.count()


def test_scores_are_made_once_for_both_ends(spark):
    calls = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    g = Graph.from_edges(spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0)], "src long, dst long, w double"))
    scores = g.edges.select("src", "dst", F.col("w").alias("score")).mapInArrow(rows, "src long, dst long, score double")
    found = {(r.src, r.dst): round(r.score, 6) for r in sparsify.local_filter(g, scores).collect()}
    assert found == {(0, 1): 0.0, (1, 2): 1.0, (0, 2): 1.0} and calls.value == 3


def test_louvain_level_goes_on_while_a_node_would_gain(spark):
    # two ends whose draws agree twice trade places or stay in both rounds, which raises nothing
    side = [F.floor(2 * uniform(f"louvain0:{i}", "id")).alias(f"s{i}") for i in (0, 1)]
    sides = {(r.s0, r.s1): r.id for r in spark.range(50).select("id", *side).collect()}
    a, b = next((r.id, sides[r.s0, r.s1]) for r in spark.range(50).select("id", *side).collect() if sides[r.s0, r.s1] != r.id)
    g = Graph.from_edges(spark.createDataFrame([(a, b)], "src long, dst long"))
    assert {r.subset for r in community.louvain(g).collect()} == {min(a, b)}


def test_lfr_plan_does_not_grow_with_the_communities(spark):
    g, label = generators.lfr(spark, 900, 3, 8, -2.0, 10, 20, 0.2)
    sizes, rng = [], np.random.default_rng(0)
    while sum(sizes) < 900:
        sizes.append(int(rng.integers(10, 21)))
    assert [r.subset for r in label.orderBy("id").collect()] == [i for i, s in enumerate(sizes) for _ in range(s)][:900]
    assert "filter([" not in label._jdf.queryExecution().optimizedPlan().toString()


def test_forest_fires_of_many_waves_burn_side_by_side(spark, monkeypatch):
    g = Graph.from_edges(spark.range(60).select((2 * F.col("id")).alias("src"), (2 * F.col("id") + 1).alias("dst"))).cut()
    # each fire burns its one edge or none: the draws say which
    fire = spark.range(4000).select("id", F.floor(uniform("start0", "id") * 120).cast("long").alias("at"))
    lit = fire.withColumn("d", F.col("at").bitwiseXOR(F.lit(1))).where(uniform("burn0", "id", "at", "d") < 0.4)
    want, total = Counter(), 0
    burnt = sorted((r.id, r.at // 2) for r in lit.collect())
    for wave in range(1000):
        if total >= 300:
            break
        mine = [e for i, e in burnt if i // 4 == wave]
        want.update(mine)
        total += len(mine)
    calls = []
    real = sparsify.cumulated
    monkeypatch.setattr(sparsify, "cumulated", lambda *a: calls.append(1) or real(*a))
    got = {r.src // 2: r.score for r in sparsify.forest_fire(g, fires=4).collect() if r.score}
    assert got == {e: c / max(want.values()) for e, c in want.items()}
    assert len(calls) < 20 < wave


def test_exact_repulsion_by_blocks(spark):
    pos = spark.range(70).select("id", uniform("px", "id").alias("x"), uniform("py", "id").alias("y"))
    rows = [(r.id, r.x, r.y) for r in pos.collect()]
    got = {r.id: (r.fx, r.fy) for r in layout.exact_repulsion(pos, 16).collect()}
    for i, x, y in rows:
        parts = [((x - u) / ((x - u) ** 2 + (y - v) ** 2), (y - v) / ((x - u) ** 2 + (y - v) ** 2)) for j, u, v in rows if j != i]
        assert np.allclose(got[i], np.sum(parts, axis=0))


def test_searches_by_tiles_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(tiled, "SIDE", 8)
    monkeypatch.setattr(tiled, "WIDE", 4)
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (6, 7), (7, 8), (8, 9), (20, 21), (21, 22)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(i,) for i in (*range(10), 20, 21, 22, 30)], "id long")).cut()
    search = tiled.Searches(g, g.nodes)
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want, score = set(), Counter()
    for s in (*range(10), 20, 21, 22, 30):
        dist, paths, order = {s: 0}, Counter({s: 1}), [s]
        for v in order:
            for w in near.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                paths[w] += paths[v] * (dist[w] == dist[v] + 1)
        dep = Counter()
        for w in reversed(order):
            for v in near.get(w, ()):
                dep[v] += paths[v] / paths[w] * (1 + dep[w]) * (dist[v] + 1 == dist[w])
            score[w] += dep[w] * (w != s)
        want |= {(s, v, dist[v], float(paths[v])) for v in order}
    assert {tuple(r) for r in search.reached().collect()} == want
    got = {r.id: r.score for r in search.dependencies().collect()}
    assert got.keys() == score.keys() and all(abs(got[i] - score[i]) < 1e-9 for i in got)


def test_resistances_come_from_a_solve_for_each_node(spark, monkeypatch):
    monkeypatch.setattr(tiled, "SIDE", 8)
    monkeypatch.setattr(tiled, "WIDE", 4)
    rng = random.Random(6)
    edges = sorted({tuple(sorted(rng.sample(range(lo, lo + 11), 2))) for lo in (0, 11) for _ in range(30)})
    w = {e: rng.randint(1, 5) for e in edges}
    g = Graph.from_edges(spark.createDataFrame([(a, b, float(w[a, b])) for a, b in edges], "src long, dst long, w double"), spark.range(23))
    lap = np.zeros((23, 23))
    for (a, b), x in w.items():
        lap[a, b] = lap[b, a] = -x
    np.fill_diagonal(lap, -lap.sum(1))
    inv = np.linalg.pinv(lap)
    pairs = [(0, 10), (3, 5), (3, 3), (12, 21), (0, 12), (5, 22)]
    kept = []
    monkeypatch.setattr(tiled.Rounds, "put", lambda self, name, df, put=tiled.Rounds.put: kept.append(name) or put(self, name, df))
    found = {(r.src, r.dst): r.r for r in algebra.effective_resistance(g, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = {(a, b): inv[a, a] + inv[b, b] - 2 * inv[a, b] if a // 11 == b // 11 and b < 22 else float("inf") for a, b in pairs}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in pairs if want[k] < 9) and all(found[k] == v for k, v in want.items() if v > 9)
    assert kept.count("state") > 2  # rows of blocks, not of pairs and nodes


def test_many_insertions_are_searched_from_the_fewer_ends(spark, monkeypatch):
    rng = random.Random(8)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)})
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    sizes = []
    for where in (tiled, sampled):
        monkeypatch.setattr(where, "bfs", lambda g, sources, *more, bfs=where.bfs: sizes.append(sources.distinct().count()) or bfs(g, sources, *more))
    dyn = sampled.DynamicBetweenness(Graph.from_edges(frame(edges[::2]), spark.range(60)), 0.5)
    ends = {x for r in dyn.paths.collect() for x in (r.u, r.v)}
    assert len({x for e in edges[1::2] for x in e}) > 50 > len(ends)
    dyn.insert(frame(edges[1::2]))
    assert max(sizes) <= len(ends)
    again = sampled.draw_paths(Graph.from_edges(frame(edges), spark.range(60)), sampled.draw_pairs(dyn.g, dyn.samples))
    assert {(r.sample, r.dist, *r.inner) for r in dyn.paths.collect()} == {(r.sample, r.dist, *r.inner) for r in again.collect()}


def test_sweeps_leave_out_rows_alone_and_send_no_table_to_all(spark, monkeypatch):
    from graphloom.operators import coloring

    n = 30
    m = np.eye(n) * 4
    for a, b in ((0, 1), (1, 2), (2, 0), (7, 8)):
        m[a, b] = m[b, a] = -1.0
    frame = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, v double")
    vec = lambda v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")
    rounds = []

    def put(self, name, df, put=coloring.Rounds.put):
        out = put(self, name, df)
        if name == "x" and self.versions[name] and "coloring" not in self.folder:
            rounds.append((out.count(), "Broadcast" in df._jdf.queryExecution().toString()))
        return out

    monkeypatch.setattr(coloring.Rounds, "put", put)
    b = np.arange(n) % 5
    got = {r.i: r.v for r in coloring.gauss_seidel(frame, vec(b), vec(np.ones(n)), 20).collect()}
    assert np.allclose([got[i] for i in range(n)], np.linalg.solve(m, b))
    assert len(rounds) == 60 and set(rounds) == {(5, False)}


def test_rounds_of_louvain_send_no_table_to_all(spark, monkeypatch):
    plans = []

    def put(self, name, df, put=community.Rounds.put):
        out = put(self, name, df)
        if name[0] == "x" and name != "x0":
            plans.append(df._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(community.Rounds, "put", put)
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    found = {r.id: r.subset for r in community.louvain(Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    assert plans and not any("Broadcast" in p for p in plans)


def test_blocks_of_searches_are_small_and_partitions_hold_few(spark, monkeypatch):
    assert tiled.SIDE * tiled.WIDE * tiled.Solves.bytes <= 2_000_000
    monkeypatch.setattr(tiled, "SIDE", 8)
    monkeypatch.setattr(tiled, "WIDE", 4)
    monkeypatch.setattr(tiled, "ROOM", 2 * 8 * 4 * tiled.Searches.bytes)
    edges = [(i, i + 1) for i in range(30)] + [(i, i + 2) for i in range(29)]
    search = tiled.Searches(Graph.from_edges(spark.createDataFrame(edges, "src long, dst long")), spark.createDataFrame([(0,), (30,)], "id long"))
    assert search._parts() * 2 >= search.state.count() > 3
    tiles = {(r.to, r["from"]): (np.frombuffer(r.cells, np.int32), np.frombuffer(r.ws)) for r in search.tiles.collect()}
    got = {(to * 8 + c // 8, from_ * 8 + c % 8) for (to, from_), (cells, ws) in tiles.items() for c in cells.tolist()}
    assert got == {(b, a) for a, b in edges} | set(edges) and all(set(ws) == {1.0} for _, ws in tiles.values())
    search.close()


def test_near_links_look_where_points_are_dense_and_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    dense = np.mod(rng.normal(0, 0.004, (700, 2)), 1)  # around the corner, where all sides meet
    xy = np.r_[dense, rng.random((60, 2)), np.tile(dense[:1], (30, 1)), np.tile([[0.5, 0.5]], (25, 1)), rng.normal(0.5, 1e-5, (20, 2))].tolist()
    ids = [int(i) for i in rng.permutation(len(xy))]
    pts = spark.createDataFrame([(i, x, y) for i, (x, y) in zip(ids, xy, strict=True)], "id long, x double, y double")
    for radius, most in ((0.1, 5), (0.4, 3)):
        top = {}
        for i, (x, y) in zip(ids, xy, strict=True):
            far = []
            for j, (u, v) in zip(ids, xy, strict=True):
                gx, gy = min(abs(x - u), 1 - abs(x - u)), min(abs(y - v), 1 - abs(y - v))
                if i != j and gx * gx + gy * gy <= radius * radius:
                    far.append((gx * gx + gy * gy, j))
            top[i] = {j for _, j in sorted(far)[:most]}
        want = {(i, j) for i in top for j in top[i] if i < j and i in top[j]}
        monkeypatch.setattr(generators, "CELL", 50)
        assert {(r.src, r.dst) for r in generators.near_links(pts, radius, most).collect()} == want
    loop = generators.Rounds(spark, "test")
    asks, points = generators._asks(pts.where("id is not null").dropDuplicates(["x", "y"]), 0.1, 5, loop)
    pairs = asks.join(points.groupBy("m", "cx", "cy", "z").count(), ["m", "cx", "cy", "z"]).groupBy().sum("count").first()[0]
    assert pairs < 200_000  # 700 points that are all within radius of one another make 490,000
    loop.close()


def test_pairs_are_hashed_as_arrays_and_equal_the_plain_hash(spark, monkeypatch):
    import hashlib

    ids = sorted({*range(0, 130), *range(990, 1010), 99_999, 100_000, 10**12})
    monkeypatch.setattr(generators, "WIDTH", 40)
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    for salt in (9, "salted"):
        drawn = generators.pairwise(spark, 0, 0.3, salt, frame)
        assert "Join" not in drawn._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        got = [(r.src, r.dst) for r in drawn.collect()]
        want = {(u, v) for u in ids for v in ids if u < v and int(hashlib.md5(f"{u}:{v}:{salt}".encode()).hexdigest()[:8], 16) < 0.3 * 2**32}
        assert len(got) == len(want) and set(got) == want


def test_gt_files_are_made_and_read_without_copying_them_for_each_node(spark, tmp_path):
    import time

    from graphloom.sources.readers import read_graph
    from graphloom.sources.writers import graph_tool

    for top, big in ((200, False), (60_000, True), (3_000_000, False)):
        edges = {(0, top), (3, 5), (3, 4), (top - 1, top), (top, top)}
        g = Graph.from_edges(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.range(top + 1))
        began = time.time()
        graph_tool(g, f"{tmp_path}/{top}.gt", big)
        got = read_graph(spark, f"{tmp_path}/{top}.gt", "gt")
        assert sorted((r.src, r.dst) for r in got.edges.collect()) == sorted(edges) and got.nodes.count() == top + 1
        assert time.time() - began < 120  # minutes a million nodes where each copied what came before


def test_edges_drawn_node_by_node_are_checked_where_they_are(spark):
    from graphloom.plans import catalog, more

    assert catalog.QUERIES

    def rows(edges):
        made = spark.createDataFrame([(0,)], "z long").mapInArrow(lambda it, e=edges: pa.Table.from_arrays([pa.array(c) for c in zip(*e, strict=True)], names=["src", "dst"]).to_batches(2) if next(it, None) is not None else [], "src long, dst long")
        return [tuple(r) for r in more._drawn_by_node(made, 5.0).collect()], "Exchange hashpartitioning(src" in more._drawn_by_node(made, 5.0)._jdf.queryExecution().toString()

    assert rows([(0, 2), (1, 2), (0, 3), (1, 3), (2, 3)]) == ([(True, True, True)], False)
    assert rows([(0, 2), (1, 2), (0, 3), (1, 3), (1, 3)])[0] == [(False, True, True)]
    assert rows([(0, 2), (1, 3), (0, 2), (1, 4), (2, 4)])[0] == [(False, True, True)]
    assert rows([(0, 2), (1, 3), (1, 2), (5, 4), (6, 4)])[0] == [(True, False, True)]
    g = generators.erdos_renyi(spark, 300, 0.1, 1)
    assert [tuple(r) for r in more._drawn_by_node(g.edges, 0.1 * 300 * 299 / 2).collect()] == [(True, True, True)]
