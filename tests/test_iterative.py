"""The iterative operators against plain computations on small graphs."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import algebra, centrality, cliques, coloring, community, components, flows, multigrid, rooted, sampled, sparsify, spectral, traversal
from graphloom.plans.fixpoint import components as linked
from graphloom.plans.fixpoint import cut
from graphloom.streaming import fold


def made(spark, edges, n):
    rows = [(a, b, float(w)) for a, b, w in ((*e, 1.0)[:3] for e in edges)]
    return Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, w double"), spark.createDataFrame([(i,) for i in range(n)], "id long")).cut()


def drawn(n, p, seed):
    rng = random.Random(seed)
    return [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]


def plain_bfs(n, edges, s):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    dist, front, d = {s: 0}, {s}, 0
    while front:
        d += 1
        front = {v for u in front for v in near[u]} - dist.keys()
        dist |= {v: d for v in front}
    return dist


def test_top_closeness_prunes(spark):
    n, rng, ends, edges = 250, random.Random(2), [0], []
    for v in range(1, n):  # preferential attachment
        for u in {rng.choice(ends) for _ in range(2)}:
            edges.append((u, v))
            ends += [u, v]
    g = made(spark, edges, n)
    search = centrality.TopCloseness(g, 3)
    got = [(r.id, r.score) for r in search.run().collect()]
    sums = {s: sum(plain_bfs(n, edges, s).values()) for s in range(n)}
    want = sorted(range(n), key=lambda s: (sums[s], s))[:3]
    assert [i for i, _ in got] == want and got[0][1] == pytest.approx(1 / sums[want[0]])
    assert search.visited < n * n / 5
    few = [(r.id, r.score) for r in centrality.top_closeness(made(spark, [(0, 1)], 4), 4).collect()]
    assert few == [(0, 1.0), (1, 1.0), (2, None), (3, None)]


def test_sampled_betweenness_and_insertions(spark):
    n, edges = 40, drawn(40, 0.1, 3)
    g = made(spark, edges, n)
    exact = {r.id: r.score / (n * (n - 1)) for r in centrality.betweenness(g)[0].collect()}
    assert all(abs(r.score - exact[r.id]) <= 0.1 for r in sampled.approx_betweenness(g, 0.1).collect())
    dyn = sampled.DynamicBetweenness(made(spark, edges[::2], n), 0.15)
    before = dyn.samples
    dyn.insert(spark.createDataFrame(edges[1::2], "src long, dst long"))
    assert 0 < dyn.redrawn <= before
    again = sampled.draw_paths(g, sampled.draw_pairs(g, before))
    strip = lambda df: sorted((r["sample"], r.u, r.v, r.dist, tuple(r.inner)) for r in df.collect())
    assert strip(dyn.paths) == strip(again)
    dyn.insert(spark.createDataFrame(edges[:3], "src long, dst long"))
    assert dyn.redrawn == 0
    dyn.grow()
    assert strip(dyn.paths)[:before] == strip(again) and dyn.scores().count() == n
    for r in again.collect():  # a path of the graph
        if r.dist is not None:
            way = [r.v, *r.inner, r.u]
            assert len(way) == r.dist + 1 and all((min(a, b), max(a, b)) in set(edges) for a, b in zip(way, way[1:]))


def test_nearest_nodes_by_buckets(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.choice([0.0, 0.3, 1.0, 2.5, 7.0])) for a, b in drawn(40, 0.12, 5)]
    g = made(spark, edges, 42)
    start = g.nodes.where("id = 0")
    want = sorted((round(r.dist, 9), r.id) for r in traversal.dijkstra(g, start).collect())
    for delta in (0.5, None, 100.0):
        assert [(round(r.dist, 9), r.id) for r in traversal.nearest(g, start, 12, delta).collect()] == want[:12]
    assert len(traversal.nearest(g, start, 1000).collect()) == len(want)
    search = traversal.NearestNodes(g, start, 1.0)
    first = search.next_bucket().collect()
    assert all(r.dist < 1.0 for r in first) and search.settled == len(first) == sum(d < 1 for d, _ in want)
    search.close()
    with pytest.raises(ValueError):
        traversal.NearestNodes(made(spark, [(0, 1, -1.0)], 2), start)


def test_rooted_forest_and_path_minima(spark):
    rng = random.Random(6)
    edges = [(i, i + 1, rng.random()) for i in range(50)] + [(60, i, rng.random()) for i in range(61, 90)] + [(95, 96, 0.5)]
    g = made(spark, edges, 100)
    up = {r.id: (r.parent, r.w) for r in rooted.rooted(g.edges).collect()}
    assert len(up) == len(edges) and all({(i, p), (p, i)} & {(a, b) for a, b, _ in edges} for i, (p, _) in up.items())
    assert all(up[i][0] == i - 1 for i in range(1, 51)) and all(up[i][0] == 60 for i in range(61, 90))
    pairs = [(a, b) for a in range(0, 100, 3) for b in range(1, 100, 7)]

    def plain(a, b):
        def path(x):
            out = [x]
            while out[-1] in up:
                out.append(up[out[-1]][0])
            return out

        pa, pb = path(a), path(b)
        if pa[-1] != pb[-1]:
            return "apart"
        top = next(x for x in pa if x in pb)
        low = [up[x][1] for p in (pa, pb) for x in p[: p.index(top)]]
        return min(low) if low else None

    got = {(r.src, r.dst): r.low for r in rooted.path_minima(g.edges, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    known = {i for e in edges for i in e[:2]}
    want = {(a, b): plain(a, b) for a, b in pairs if a in known and b in known}
    assert got == {k: v for k, v in want.items() if v != "apart"}


def test_union_of_maximum_forests_of_real_weights(spark):
    rng = random.Random(7)
    edges = [(a, b, rng.choice([rng.random(), 0.5])) for a, b in drawn(14, 0.4, 7)]
    g = made(spark, edges, 14)
    got = {(r.src, r.dst) for r in components.union_maximum_forest(g).collect()}

    def joined(than, a, b):
        up = list(range(14))
        for x, y, w in edges:
            if w > than:
                a1, b1 = x, y
                while up[a1] != a1:
                    a1 = up[a1]
                while up[b1] != b1:
                    b1 = up[b1]
                up[a1] = b1
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        return a == b

    assert got == {(a, b) for a, b, w in edges if not joined(w, a, b)}


def test_components_of_a_long_path(spark):
    n = 3000
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    e = spark.createDataFrame(list(zip(ids, ids[1:])) + [(n + 5, n + 6), (n + 7, n + 7)], "src long, dst long")
    got = {r.id: r.component for r in linked(e).collect()}
    assert set(got.values()) == {0, n + 5, n + 7} and len(got) == n + 3


def test_louvain_levels_rise(spark):
    edges = [(a + 10 * k, b + 10 * k) for k in range(4) for a, b in itertools.combinations(range(10), 2)] + [(10 * k, 10 * ((k + 1) % 4) + 1) for k in range(4)]
    g = made(spark, edges, 40)
    levels = []
    found = community.louvain(g, history=levels)
    groups = defaultdict(set)
    for r in found.collect():
        groups[r.subset].add(r.id)
    assert sorted(map(sorted, groups.values())) == [list(range(10 * k, 10 * k + 10)) for k in range(4)]
    assert levels == sorted(levels) and levels[-1] == pytest.approx(community.modularity(g, found).first()[0])
    assert community.louvain(made(spark, [(0, 1, 0.0)], 3)).count() == 3


def test_eigenvectors_equal_dense_ones(spark):
    edges = drawn(30, 0.2, 9)
    g = made(spark, edges, 30)
    a = np.zeros((30, 30))
    for s, t in edges:
        a[s, t] = a[t, s] = 1
    want = np.linalg.eigvalsh(a)
    m = algebra.adjacency(g)
    values, x = spectral.eigenvectors(m, 3)
    assert values == pytest.approx(want[::-1][:3], abs=1e-6)
    assert all(r.residual < 1e-5 for r in spectral.residuals(m, values, x).collect())
    low, _ = spectral.eigenvectors(algebra.laplacian(g), 2, largest=False)
    lap = np.diag(a.sum(1)) - a
    keep = a.sum(1) > 0
    assert low == pytest.approx(np.linalg.eigvalsh(lap[np.ix_(keep, keep)])[:2], abs=1e-5)


def test_spectral_partition_finds_the_bridge(spark):
    edges = [(a + 8 * k, b + 8 * k) for k in range(2) for a, b in itertools.combinations(range(8), 2)] + [(3, 11)]
    parts = {r.id: r.subset for r in spectral.spectral_partition(made(spark, edges, 16), 2).collect()}
    assert len({parts[i] for i in range(8)}) == 1 and len({parts[i] for i in range(8, 16)}) == 1 and parts[0] != parts[8]
    for edges, n in ((drawn(25, 0.3, 2), 26), ([], 3)):
        g = made(spark, edges, n)
        for found in (spectral.spectral_coloring(g), coloring.greedy_coloring(g)):
            color = {r.id: r.color for r in found.collect()}
            assert len(color) == n and all(color[a] != color[b] for a, b in edges)
        deg = Counter(v for e in edges for v in e)
        assert all(c <= deg[i] for i, c in color.items())


def test_gauss_seidel_equals_sweeps_in_colour_order(spark):
    edges = drawn(15, 0.3, 4)
    g = made(spark, edges, 15)
    a = np.eye(15)
    for s, t in edges:
        a[s, t] = a[t, s] = -1
        a[s, s] += 1
        a[t, t] += 1
    b = np.arange(15) % 4 * 1.0
    color = {r.id: r.color for r in coloring.greedy_coloring(g).collect()}
    x = np.zeros(15)
    for _ in range(3):
        for i in sorted(range(15), key=lambda i: (color[i], i)):
            x[i] = (b[i] - a[i] @ x + a[i, i] * x[i]) / a[i, i]
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(15) for j in range(15) if a[i, j]], "i long, j long, v double")
    vec = lambda v: spark.createDataFrame([(i, float(c)) for i, c in enumerate(v)], "i long, v double")
    got = {r.i: r.v for r in coloring.gauss_seidel(m, vec(b), vec(np.zeros(15)), 3).collect()}
    assert [got[i] for i in range(15)] == pytest.approx(x)


def test_multilevel_solver_takes_fewer_rounds(spark):
    n = 12
    edges = [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, (i + 1) * n + j) for i in range(n - 1) for j in range(n)]
    g = made(spark, edges, n * n)
    lap = cut(algebra.laplacian(g))
    b = spark.createDataFrame([(i, 1.0 if i == 0 else -1.0 if i == n * n - 1 else 0.0) for i in range(n * n)], "i long, v double")
    h = multigrid.Hierarchy(lap, coarsest=12)
    assert len(h.levels) >= 2 and {level.kind for level in h.levels} & {"aggregate"}
    x, rounds = h.solve(b)
    h.close()
    res = algebra.axpy(b, algebra.matvec(lap, x), -1.0).agg(F.max(F.abs("v"))).first()[0]
    assert res < 1e-6
    with pytest.raises(RuntimeError):
        algebra.conjugate_gradient(lap, b, rounds=3 * rounds // 2)  # needs nearly twice the rounds


def test_flow_and_cut(spark):
    rng = random.Random(8)
    edges = [(a, b, rng.randint(1, 9)) for a, b in drawn(9, 0.5, 8)]
    g = made(spark, edges, 9)
    best = min(sum(w for a, b, w in edges if (a in side) != (b in side)) for k in range(8) for rest in itertools.combinations(range(1, 8), k) for side in [{0, *rest}])
    f = flows.max_flow(g, 0, 8).collect()
    cap = {(a, b): w for a, b, w in edges}
    net = Counter()
    for r in f:
        assert abs(r.flow) <= cap[r.src, r.dst] + 1e-6
        net[r.dst] += r.flow
        net[r.src] -= r.flow
    assert net[8] == pytest.approx(best, abs=1e-5) and all(abs(net[i]) < 1e-5 for i in range(1, 8))
    one_way = Graph(g.nodes, spark.createDataFrame([(0, 1, 3.0), (1, 2, 2.0), (2, 0, 9.0)], "src long, dst long, w double"), True)
    assert flows.max_flow_value(one_way, 0, 2).first()[0] == pytest.approx(2.0)
    assert flows.max_flow_value(made(spark, [(0, 1, 5.0)], 3), 0, 2).first()[0] == 0


def test_largest_clique(spark):
    for seed in range(2):
        edges = drawn(16, 0.5, seed)
        near = set(edges)
        want = max(k for k in range(1, 17) if any(all(p in near for p in itertools.combinations(c, 2)) for c in itertools.combinations(range(16), k)))
        got = [r.id for r in cliques.max_clique(made(spark, edges, 16), first=4).collect()]
        assert len(got) == want and all(p in near for p in itertools.combinations(got, 2))
    assert cliques.max_clique(made(spark, [(1, 2)], 3)).count() == 2


def test_uniform_forests_follow_resistances(spark):
    edges = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4), (6, 7)]
    g = made(spark, edges, 8)
    hit = Counter()
    for salt in range(24):
        t = [(r.src, r.dst) for r in components.uniform_forest(g, salt).collect()]
        assert len(t) == 5 and (6, 7) in t
        hit.update(t)
    assert all(6 <= hit[e] <= 23 for e in edges[:6])  # two thirds each


def test_ordered_propagation_and_parameters(spark):
    edges = [(a + 6 * k, b + 6 * k) for k in range(3) for a, b in itertools.combinations(range(6), 2)] + [(0, 6), (6, 12)]
    g = made(spark, edges, 19)
    groups = defaultdict(set)
    for r in community.degree_ordered_propagation(g).collect():
        groups[r.subset].add(r.id)
    assert {frozenset(s) for s in groups.values()} >= {frozenset({18})} and max(map(len, groups.values())) <= 18
    scores = g.edges.select("src", "dst", (F.col("src") % 5).cast("double").alias("score"))
    t, kept = sparsify.parameter_for(g, scores, 0.4).first()
    values = sorted(((a % 5) for a, _ in edges), reverse=True)
    wanted = -(-4 * len(edges) // 10)
    assert t == values[wanted - 1] and kept == sum(v >= t for v in values) >= wanted


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    src, place = tmp_path / "in", f"file://{tmp_path}/fold"
    schema = "seq long, u long, v long, on boolean"
    rows = [(1, 1, 2, True), (2, 1, 3, True), (3, 1, 2, False), (4, 2, 3, True), (5, 1, 3, False), (6, 1, 2, True)]
    want = {}
    for part in (rows[:2], rows[2:4], rows[4:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(src))
        want |= {(u, v): on for _, u, v, on in part}
        got = {(r.u, r.v): r.on for r in fold.fold_stream(spark.readStream.schema(schema).parquet(str(src)), place).collect()}
        assert got == want
