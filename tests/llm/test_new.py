"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import embedding_dedup, curriculum, hard_negatives, jaccard, periodic
from tests.llm.test_llm import docs, some

SMALL = "/root/testdata/sf0.01"


# -- 11
def plain_runs(w):
    """All runs by definition: the smallest period of every maximal stretch."""
    n, found = len(w), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, p)):
                found.add((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_document(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        w = []
        while len(w) < rng.randint(0, 150):
            block = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 9))]
            w += block * rng.randint(1, 7) + block[: rng.randrange(len(block) + 1)]
        ids = np.array(w, np.int64)
        assert [tuple(r) for r in periodic.runs(ids).tolist()] == plain_runs(w)


def test_lag_counts_of_heavy_and_light_words():
    rng = np.random.default_rng(1)
    ids = np.where(rng.random(9000) < 0.5, 0, rng.integers(1, 400, 9000))
    got = periodic.lag_counts(ids, 2250)
    want = np.array([0] + [(ids[p:] == ids[:-p]).sum() for p in range(1, 2251)])
    assert (got == want).all()
    periods = np.tile(rng.integers(0, 1000, 700), 40)
    assert periodic.runs(periods).tolist() == [[0, 28000, 700]]
    assert periodic.runs(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]


def test_periodic_runs_over_odd_rows(spark, tmp_path):
    rows = some(3, 80) + [(500 + i, "a b c " * 9 + "d " * 7 + "x y") for i in range(40)] + [(700, "a a a a a a"), (701, "a a a a a")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(plain_document(i, t) for i, t in rows)
    assert periodic.periodic_runs(docs(spark, [])).count() == 0
    whole = {r.doc_id: r for r in periodic.periodic_runs(docs(spark, [(1, "go " * 8 + "home"), (2, None)])).collect()}
    assert [tuple(x) for x in whole[1].runs] == [(0, 8, 1)] and whole[1].collapsed == "go home" and whole[2].collapsed == "" and whole[2].n_words == 0


def test_periodic_runs_over_whole_table(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in periodic.op11_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(texts)
    for r in texts:
        if len(r.text) < 4000:
            assert got[r.doc_id] == plain_document(r.doc_id, r.text)


# -- 12
def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - 2 * sum(sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        above = {s for s in names if s not in capped and w[s] * rest / free > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in capped else w[s] * rest / free for s in names}
        capped |= above


def sourced(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 7) for i, t, s in rows], "doc_id long, text string, source string, words string, size long")


def mixed_rows(seed=5):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])) for i, t in some(seed, 300)]
    return rows + [(9000, "one two", "tiny"), (9001, "", "void"), (9000, "one two", "tiny"), (None, None, None), (None, "x y z", None), (None, "x y z", None)]


def test_mixture_equals_brute_force(spark):
    rows = mixed_rows()
    got = curriculum.mixture(sourced(spark, rows)).collect()
    again = curriculum.mixture(sourced(spark, rows[::-1]).repartition(5), buckets=3).collect()
    strip = lambda rs: Counter((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken, tuple(map(tuple, r.pieces))) for r in rs)
    assert strip(got) == strip(again) and len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    want, taken = plain_targets(totals), Counter()
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == sum(p.words for p in r.pieces) <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in want)
    turn = {s: i % 3 for i, s in enumerate([*sorted((s for s in totals if s is not None), key=str.encode), None])}
    for s in totals:  # a stream: epochs one after another, positions by the inverse of the schedule's integral
        knots = curriculum.SCHEDULES[turn[s]]
        grid = np.linspace(0, 1, 200_001)
        rate = np.interp(grid, [t for t, _ in knots], [w for _, w in knots])
        upto = np.r_[0, np.cumsum((rate[1:] + rate[:-1]) / 2)]
        done = 0
        for p in sorted((p for r in got if r.source == s for p in r.pieces), key=lambda p: (p.epoch, p.position)):
            assert abs(np.interp((done + p.words / 2) / want[s], upto / upto[-1], grid) - p.position) < 1e-4
            done += p.words
    assert curriculum.mixture(sourced(spark, [])).count() == 0


def test_training_order_brings_texts(spark):
    rows = mixed_rows(6)
    df = sourced(spark, rows)
    got = curriculum.training_order(df, share=1.2).collect()
    assert got == sorted(got, key=lambda r: r.position)
    mixed = curriculum.mixture(df, share=1.2).collect()
    assert sum(r.words for r in got) == sum(r.taken for r in mixed)
    assert Counter((r.doc_id, r.source, p.epoch, p.words) for r in mixed for p in r.pieces) == Counter((r.doc_id, r.source, r.epoch, r.words) for r in got)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.words and r["size"] == 7 for r in got)


def test_schedules_of_one_segment_and_bad_ones():
    assert curriculum.areas(((0.0, 4.0), (1.0, 2.0))) == [0.0, 3.0]
    with pytest.raises(ValueError):
        curriculum.areas(((0.0, 0.0), (1.0, 0.0)))
    with pytest.raises(ValueError):
        curriculum.areas(((0.0, 1.0), (0.5, 1.0)))


# -- 13
VECTORS = "id long, label int, x array<double>, cell string, rank int"


def plain_negatives(rows, chosen):
    first = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            first[i] = min(first.get(i, (label, x)), (label, x))
    lengths = Counter(len(x) for _, x in first.values())
    d = min((-n, d) for d, n in lengths.items())[1] if lengths else 0
    first = {i: r for i, r in first.items() if len(r[1]) == d}
    out = []
    dot = lambda a, b: int(sum(p * q for p, q in zip(a, b)))
    for a in filter(chosen, first):
        scores = sorted((-dot(first[a][1], x), i, label == first[a][0]) for i, (label, x) in first.items() if i != a)
        for neg, p, _ in [s for s in scores if s[2]][:5]:
            fit = [(i, -n) for n, i, same in scores if not same and 30 * -neg <= 100 * -n <= 90 * -neg][:10]
            out += [(a, p, k + 1, i, -neg, n) for k, (i, n) in enumerate(fit)]
    return out


def vectors(seed, n=600, d=8, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 60
    rows = [(i, int(rng.integers(labels)), np.floor(centres[rng.integers(6)] + rng.normal(size=d) * 25).tolist()) for i in range(n)]
    rows += [(n + i, int(rng.integers(labels)), rows[3][2]) for i in range(200)]  # copies
    rows += [(5, 3, rows[5][2]), (5, 0, rows[6][2]), (5000, None, rows[1][2]), (5001, 1, None), (5002, 1, [None] * d), (5003, 1, [float("nan")] * d), (5004, 1, [float("inf")] * d), (None, 2, rows[2][2]), (5005, 1, [1.0]), (5010, 77, rows[4][2]), (5020, 1, [0.0] * d)]
    return rows


@pytest.mark.parametrize(("pivots", "block_bytes"), [(16, 32 << 20), (3, 64 * 8 * 12)])
def test_hard_negatives_equal_brute_force(spark, pivots, block_bytes):
    rows = vectors(pivots)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTORS)
    got = hard_negatives.mine(df, F.col("id") % 10 == 0, pivots=pivots, block_bytes=block_bytes).collect()
    assert Counter(map(tuple, got)) == Counter(plain_negatives(rows, lambda i: i % 10 == 0))


def test_hard_negatives_of_odd_tables(spark):
    one = lambda rows: hard_negatives.mine(spark.createDataFrame([(*r, "", 0) for r in rows], VECTORS), F.col("id") % 10 == 0).collect()
    assert one([]) == [] and one([(0, 1, [1.0, 2.0])]) == [] and one([(0, 1, None)]) == []
    assert sorted(tuple(r) for r in one([(0, 1, [10.0]), (1, 1, [10.0]), (2, 2, [5.0]), (3, 2, [5.0]), (4, 2, [10.0])])) == [(0, 1, 1, 2, 100, 50), (0, 1, 2, 3, 100, 50)]


def test_brackets_hold():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(400, 12)) * 40, rng.normal(size=(30, 12)) * 40
    p = hard_negatives.Pivots(x[:200], (x**2).sum(1).max(), 8)
    a, b, square = p.distances(q, anchors=True)[:, None], p.distances(x)[None], (q**2).sum(1)[:, None]
    best, worst = p.scores(np.abs(a - b).max(2), square) + p.slack(square), p.scores((a + b).min(2), square) - p.slack(square)
    assert ((worst <= q @ x.T) & (q @ x.T <= best)).all()


# -- near-dedup of pages that share a template
def test_template_pages_form_few_pairs(spark, monkeypatch):
    rng = random.Random(4)
    shared = " ".join(f"t{i}" for i in range(200))
    rows = [(i, shared + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " and more") for i in range(5)]
    written, keep = [], jaccard.Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(jaccard.Scratch, "keep", counted)
    found = jaccard.groups(docs(spark, rows)).collect()
    assert max(written) < 60 * len(rows)  # all pairs would be 46,360 rows in one table; shingles are 49 a page
    members = defaultdict(set)
    for r in found:
        members[r.component].add(r.doc_id)
    assert sorted(sorted(m) for m in members.values() if len(m) > 1) == [[i, 1000 + i] for i in range(5)]


def test_embedding_tiles_cover_every_visit():
    rng = np.random.default_rng(3)
    x = embedding_dedup.unit(rng.normal(size=(900, 16)))
    grid = embedding_dedup.fit(x, np.zeros(len(x), int), 900, 0.8, occupancy=2)
    assert len(grid.left) == len(grid.right) == 21 and grid.slack > 0
    tiles, cells = grid.visited_tiles(x)
    for seen, t, c in zip(grid.visits(x), tiles, cells, strict=True):
        assert sorted(seen.tolist()) == sorted(i for part in c for i in part) and len(set(t)) == len(t)
        assert all(set(grid.tiles(np.array(part)).tolist()) == {at} for at, part in zip(t, c, strict=True))
    # more vectors than the codebooks of old could tell apart
    assert len(embedding_dedup.fit(x[:600], np.zeros(600, int), 10**8, 0.9, fit_sample=200).left) == 600
