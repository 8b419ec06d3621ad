"""Growth and churn against plain simulations with the same draws."""

import hashlib
import math
from collections import defaultdict

import pytest

from graphloom.graph import Graph
from graphloom.operators import dynamic, growth


def u(salt, *ids):
    return int(hashlib.md5(":".join([*map(str, ids), salt]).encode()).hexdigest()[:8], 16) / 2**32


def burnt_by(fire, start, out, into, p, back):
    reached, front = {start}, [start]
    while front:
        fresh = set()
        for by in front:
            for way, near, chance in ((0, out, p), (1, into, back)):
                k = math.floor(math.log(1 - u("many0", fire, by, way)) / math.log(chance)) if chance > 0 else 0
                fresh |= set(sorted(near[by] - reached, key=lambda x: (u("burn0", fire, by, x), x))[:k])
        reached, front = reached | fresh, sorted(fresh)
    return reached


@pytest.mark.parametrize(("directed", "share"), [(False, 0.0), (True, 0.5)])
def test_forest_fire_equals_a_plain_simulation(spark, directed, share):
    p, back = 0.6, 0.5
    seed = [(0, 1), (1, 2), (2, 0), (2, 3)]
    g = Graph.from_edges(spark.createDataFrame(seed, "src long, dst long"), directed=directed)
    comers = list(range(10, 18 if not directed else 30))
    events = growth.forest_fire_growth(g, spark.createDataFrame([(i,) for i in comers], "id long"), p, directed, back, share)
    got = {(r.u, r.v) for r in events.where("type = 'EDGE_ADDITION'").collect()}

    names, waiting, want, links = [0, 1, 2, 3], list(comers), set(), list(seed)
    while waiting:
        size = max(1, int(len(names) * share))
        step, waiting = waiting[:size], waiting[size:]
        out, into = defaultdict(set), defaultdict(set)
        for a, b in links:
            out[a].add(b)
            into[b].add(a)
            if not directed:
                out[b].add(a)
        for v in step:
            fired = burnt_by(v, names[math.floor(u("ambassador0", v) * len(names))], out, into if directed else defaultdict(set), p, p * back)
            want |= {(v, x) for x in fired}
        links += [(v, x) for v, x in want if v in step]
        names += step
    assert got == want and len(want) > len(comers)
    rows = events.orderBy("seq").collect()
    born = {r.u: r.seq for r in rows if r.type == "NODE_ADDITION"}
    assert sorted(born) == comers and all(born[r.u] < r.seq and born.get(r.v, -1) < r.seq for r in rows if r.type == "EDGE_ADDITION")


def test_forest_fire_edges_of_its_domain(spark):
    one, none = spark.createDataFrame([(5,)], "id long"), spark.createDataFrame([], "id long")
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long"), one)
    assert growth.forest_fire_growth(g, none, 0.3).collect() == []
    assert [(r.type, r.u, r.v) for r in growth.forest_fire_growth(g, spark.createDataFrame([(9,)], "id long"), 0.0).orderBy("seq").collect()] == [("NODE_ADDITION", 9, None), ("EDGE_ADDITION", 9, 5)]
    with pytest.raises(ValueError, match="needs a node"):
        growth.forest_fire_growth(Graph(none, g.edges), one, 0.3)
    with pytest.raises(ValueError, match="chances"):
        growth.forest_fire_growth(g, one, 1.0)
    assert growth.batches(10, 9, 0.3) == [3, 3, 3] and growth.batches(3, 2, 0) == [1, 1]


def test_pub_web_churn_folds_to_the_web_of_its_points(spark):
    start = [(i, (i * 0.377) % 1, (i * 0.618) % 1) for i in range(60)]
    events = growth.pub_web_churn(spark.createDataFrame(start, "id long, x double, y double"), 2, 4, 0.1, 0.2, 3, 0.1)
    rows = events.orderBy("seq").collect()
    alive, at = dict.fromkeys(range(0), None), {i: (x, y) for i, x, y in start}
    for r in rows:
        if r.type == "NODE_ADDITION":
            assert r.u not in alive
            alive[r.u] = r.step
        if r.type == "NODE_REMOVAL":
            del alive[r.u]
        if r.type == "EDGE_ADDITION":
            assert r.u in alive and r.v in alive
    for i in range(60, 72):
        c, turn, far = math.floor(u("c0", i) * 5), u("t0", i) * 2 * math.pi, u("g0", i) * 0.1
        at[i] = ((u("cx0", c) + far * math.cos(turn)) % 1, (u("cy0", c) + far * math.sin(turn)) % 1) if c < 4 else (u("x0", i), u("y0", i))
    assert len(alive) == 60 and sum(r.type == "NODE_REMOVAL" for r in rows) == 12

    def d2(a, b):
        return sum(min(abs(p - q), 1 - abs(p - q)) ** 2 for p, q in zip(at[a], at[b], strict=True))

    top = {a: set(sorted((b for b in alive if b != a and d2(a, b) <= 0.04), key=lambda b: (d2(a, b), b))[:3]) for a in alive}
    want = {(a, b): pytest.approx(0.01 / d2(a, b)) for a in alive for b in top[a] if a < b and a in top[b]}
    assert {(r.u, r.v): r.w for r in dynamic.fold_edges(events).collect()} == want and want
    assert {r.id for r in dynamic.fold_nodes(events).collect()} == set(alive)
    assert {r.type for r in rows if r.step} == {"NODE_ADDITION", "NODE_REMOVAL", "EDGE_ADDITION", "EDGE_REMOVAL"}
