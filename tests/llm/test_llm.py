import hashlib
import random
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import bpe, embedding_dedup, imatch, language, line_dedup, packing, quality, simhash, toxicity, warc

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, again long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "clash", 1) for i, t in rows], DOCS)


def some(seed=0, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta,", "über", "naïve", "x", "12", "the", "of"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, text(rng.randint(1, 60)) + ("\n" + "a repeated line that is long enough to count here" if i % 3 == 0 else "")) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, rows[5][1]), (n + 4, rows[5][1]), (None, rows[7][1]), (n + 6, "w " * 20000)]
    return rows


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def connect(n, links):
    up = list(range(n))
    for a, b in links:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    for i in range(n):
        while up[i] != up[up[i]]:
            up[i] = up[up[i]]
    return up


# -- 1
def plain_simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rows = some(1)
    rows += [(i + 1000, t and t.upper()) for i, t in rows[:9]]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = [plain_simhash(t) for _, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64) for r in got) == sorted((i is None, i or 0, f) for (i, _), f in zip(rows, fp))
    up = connect(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2])
    least = defaultdict(list)
    for k, (i, _) in zip(up, rows):
        least[k] += [i] if i is not None else []
    want = sorted((i if i is not None else -1, min(least[k])) for k, (i, _) in zip(up, rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in got) == want


def test_simhash_links_of_dense_keys(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)} | {0, 3}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    from graphloom.plans.fixpoint import components

    got = {r.id: r.component for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    up = connect(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) % 2**64).bit_count() <= 2])
    assert {f: got.get(f, f) for f in fps} == {f: fps[u] for f, u in zip(fps, up)}


def test_simhash_filter_and_empty(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "something else here entirely"), (None, "a b c d")]
    kept = simhash.keep_first(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == docs(spark, rows).columns
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def plain_shingles(text, width=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def near_copies(seed=21):
    """Texts with near copies about a similarity of 0.8, a large group of them, and a passage that many hold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda k: [word() for _ in range(k)]

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[rng.randrange(len(words))] = word()
        return words

    out, hot, passage = [], text(120), text(30)
    for _ in range(40):
        base = text(rng.randint(30, 200))
        out += [base, *(edited(base, rng.randint(1, max(1, len(base) // 30))) for _ in range(2))]
    out += [edited(hot, rng.randint(1, 3)) for _ in range(80)] + [[*text(40), *passage, *text(10)] for _ in range(60)] + [edited([*passage, *text(2)], 1) for _ in range(30)]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_keep_first_leaves_no_near_copy(spark):
    rows = near_copies()
    sets = [plain_shingles(t) for _, t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    up = connect(len(rows), alike)
    assert len(set(up)) < len(rows) - 60
    assert sorted(r.doc_id for r in simhash.keep_first(docs(spark, rows)).collect()) == sorted(set(up))


def test_keep_first_chooses_rows_of_null_and_repeated_ids(spark):
    one, two, three, four, five = (" ".join(f"{c}{i}" for i in range(12)) for c in "abcde")
    rows = [(None, one), (None, two), (None, two), (None, three), (7, three), (9, one), (5, four), (5, five), (5, five), (6, five), (None, None), (8, "")]
    kept = simhash.keep_first(docs(spark, rows)).collect()
    want = [(None, two), (7, three), (9, one), (5, four), (5, five), (8, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, want))


# -- 2, 7, 9
def held_out(spark, frame, label, sf=SMALL):
    l = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    return frame.join(l, "doc_id").where("held_out").toPandas()


def test_quality_held_out(spark):
    pdf = held_out(spark, quality.op2_quality(spark, SMALL), "quality")
    assert len(pdf) > 40 and (pdf.predicted == pdf.quality).mean() > 0.93
    assert pdf.score.between(0, 1).all()


def test_quality_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.fit(x[:2000], y[:2000], rounds=40)
    assert (0, 1) in model.pairs and ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert np.ptp(quality.fit(x[:5], np.ones(5)).score(x)) == 0 and 0 < quality.fit(x[:0], y[:0]).score(x)[0] < 1


@pytest.mark.parametrize("filter_", [lambda d: quality.keep_good(d, quality.Model(3.0)), lambda d: toxicity.keep_ordinary(d, toxicity.Model(base=-3.0))])
def test_filters_keep_columns_and_edge_cases(spark, filter_):
    d = docs(spark, some(2))
    out = filter_(d)
    assert out.columns == d.columns and out.count() == d.count() and filter_(docs(spark, [])).count() == 0


def test_quality_equals_brute_force(spark):
    """The score by its definition: look up every feature's bin and every pair's cell, one row and one table at a time."""
    import bisect
    import math

    rng = np.random.default_rng(5)
    x = rng.random((400, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(int), rounds=20, pair_rounds=10)
    rows = [(i, t) for i, t in some(15)] + [(None, None), (3, "A|B " * 5000)]

    def plain(text):
        f = quality.features(text)
        bins = [bisect.bisect_right(list(e), v) for e, v in zip(model.edges, f)]
        z = model.base + sum(float(t[b]) for t, b in zip(model.tables, bins))
        for (i, j), grid in zip(model.pairs, model.grids):
            z += float(grid[model.coarse[i][bins[i]]][model.coarse[j][bins[j]]])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    got = sorted((str(r.doc_id), r.score) for r in quality.scores(docs(spark, rows), model).collect())
    want = sorted((str(i), plain(t)) for i, t in rows)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    assert quality.scores(docs(spark, []), model).count() == 0


def test_toxicity_held_out(spark):
    pdf = held_out(spark, toxicity.op7_toxicity(spark, SMALL), "toxic")
    assert pdf.score.between(0, 1).all()
    ordinary = pdf[pdf.toxic == 0]
    assert (ordinary.predicted == 0).mean() > 0.97
    bad = pdf[pdf.toxic == 1]
    assert bad.score.mean() > 4 * ordinary.score.mean() and (bad.predicted == 1).mean() >= 0.6
    assert np.mean([np.mean(s > ordinary.score) + np.mean(s == ordinary.score) / 2 for s in bad.score]) > 0.9


def test_toxicity_finds_its_stretches():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    text = lambda bad: " ".join(rng.choice(["zworst", "zvile"]) if bad and rng.random() < 0.05 else word() for _ in range(150))
    y = np.array([i % 2 for i in range(300)])
    texts = [text(k).encode() for k in y]
    model = toxicity.fit(texts[:240], y[:240])
    assert b"zvile" in model.toxic and b"zvile" not in model.ordinary
    right = [(model.score(t.decode()) > 0.5) == k for t, k in zip(texts[240:], y[240:])]
    assert np.mean(right) > 0.9
    assert 0 <= model.score(None) <= 1 and  model.distances(b"").size == 0 and model.score("") == model.score(None)
    assert toxicity.fit([], np.zeros(0)).score("x") == 0.5


def plain_toxicity(model, text):
    """The score by its definition: each window is compressed anew under each dictionary."""
    import math

    import zstandard

    data = (text or "").lower().encode()
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(content, window):
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=words, compression_params=how).compress(window))

    reach, at = dict.fromkeys(toxicity.LEVELS, 0), 0
    while data and (at == 0 or at < len(data) - 16):
        w = data[at : at + 60]
        d = length(model.ordinary, w) - length(model.toxic, w)
        for k in reach:
            reach[k] += d >= k
        at += 44
    z = model.base
    for i, n in enumerate(reach.values()):
        z += model.weights[2 * i] * math.log(1 + n) + model.weights[2 * i + 1] * math.sqrt(1000 * n / (len(data) + 200))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_toxicity_equals_brute_force(spark):
    d = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text")
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(small, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in d.orderBy("doc_id").limit(25).collect()] + [(None, "you idiot"), (-1, None), (-2, ""), (-3, "é" * 30000), (-3, "a"), (-4, "trash " * 3000)]
    got = sorted((str(r.doc_id), r.score) for r in toxicity.scores(docs(spark, rows), model).collect())
    want = sorted((str(i), plain_toxicity(model, t)) for i, t in rows)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
    assert toxicity.scores(docs(spark, []), model).count() == 0


def test_labelled_sample_is_bounded(spark):
    from graphloom.llm.labelled import fetch, sample

    d = docs(spark, [(1, "same")] * 40 + [(i, f"text {i}") for i in range(2, 30)] + [(None, "x")])
    labels = spark.createDataFrame([(i, 1) for i in range(0, 5000)] + [(1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    assert sample(d, labels, "quality", 5, 0, 10).count() == 10
    everything = fetch(sample(d, labels, "quality", 5, 0, 1000))
    assert set(everything.doc_id) == {i for i in range(1, 30) if zlib.crc32(str(i).encode()) % 5} and (everything.y == 1).all()


def test_language_held_out(spark):
    out = language.op9_language(spark, SMALL)
    lang = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    pdf = out.where("held_out").join(lang, "doc_id").toPandas()
    assert (pdf.lang == pdf.lang_pred).mean() > 0.95 and pdf.score.between(0, 1).all()


def test_language_equals_brute_force(spark):
    """Convolution, pooling and softmax by loops over windows, places and filters."""
    import math

    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(256, 2)).astype(np.float32)
    filters = [rng.normal(size=(k * 2, 3)).astype(np.float32) for k in language.WIDTHS]
    net = language.Network(["a", "b"], vectors, filters, [np.float32(rng.normal(size=3)) for _ in language.WIDTHS], rng.normal(size=(9, 2)).astype(np.float32), np.zeros(2, np.float32))

    def plain(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        data, logs = text.lower().encode(), []
        for at in range(0, len(data), 128):
            w = data[at : at + 128].ljust(128, b"\0")
            hidden = []
            for f, bias, k in zip(net.filters, net.biases, language.WIDTHS):
                for j in range(3):
                    best = max(sum(float(vectors[w[p + o]][d]) * float(f[o * 2 + d][j]) for o in range(k) for d in range(2)) for p in range(128 - k + 1))
                    hidden.append(max(0.0, best + float(bias[j])))
            z = [sum(h * float(net.out[i][c]) for i, h in enumerate(hidden)) for c in range(2)]
            top = max(z)
            logs.append([v - top - math.log(sum(math.exp(u - top) for u in z)) for v in z])
        mean = [sum(l[c] for l in logs) / len(logs) for c in range(2)]
        p = [math.exp(m) for m in mean]
        c = 0 if p[0] >= p[1] else 1
        return net.names[c], p[c] / sum(p)

    rows = [(i, t) for i, t in some(16)[:12]] + [(100, None), (101, ""), (102, "12 !"), (None, "Über alles"), (103, "é" * 700)]
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in language.predictions(docs(spark, rows), net).collect())
    want = sorted((str(i), *plain(t)) for i, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-4)


def test_language_edge_cases(spark):
    rows = [(i, t) for i, t in some(3) if i is not None] + [(900, "123 !!"), (901, None)]
    d = docs(spark, rows)
    net = language.train(d)
    got = by_id(language.predictions(d, net))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[1].lang_pred == "en" and len(got) == len(rows)
    none = language.train(docs(spark, []))
    assert by_id(language.predictions(d, none))[1].lang_pred == "und"


def test_language_learns_a_rare_language(spark):
    rows = [(i, f"the usual words number {i}", "en") for i in range(3000)] + [(i, f"harvinaiset sanat {i}", "fi") for i in range(3000, 3006)] + [(i, f"les mots {i}", "fr") for i in range(4000, 4200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.train(d, max_rows=60)
    assert net.names == ["en", "fi", "fr"]
    assert language.train(d, max_rows=3).names == net.names


# -- 3
def test_word_encoder_is_exact():
    e = packing.WordEncoder.of(packing.vocabulary())
    rng = random.Random(5)
    alpha = list("abZ 's\n\t,.!é日😀1 İ́　\x1c") + ["don't", "<|endoftext|>", " the "]
    for _ in range(1500):
        t = "".join(rng.choice(alpha) for _ in range(rng.randint(0, 40)))
        ids = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert e.encode(t) == struct.pack(f"<{len(ids)}I", *ids), t
    long = "word, " * 9000
    assert b"".join(map(e.encode, packing.segments(long, 1000))) == e.encode(long)


def test_best_fit_equals_plain_search():
    rng = random.Random(6)
    lengths = sorted((rng.choice([4096, rng.randint(1, 4096), rng.randint(1, 300)]) for _ in range(2000)), reverse=True)
    which, offset = packing.best_fit(lengths)
    fill, want = [], []
    for n in lengths:
        fits = [(4096 - f - n, w) for w, f in enumerate(fill) if 4096 - f >= n]
        w = min(fits)[0] if fits else None
        want.append(w)
        got = [4096 - fill[which[len(want) - 1]] - n] if which[len(want) - 1] < len(fill) else [None]
        assert got[0] == w
        if w is None:
            fill.append(0)
        assert offset[len(want) - 1] == fill[which[len(want) - 1]]
        fill[which[len(want) - 1]] += n
    assert max(fill) <= 4096


def test_packing(spark):
    rows = [(i, t) for i, t in some(7) if i is not None]
    out = packing.pack_documents(docs(spark, rows), packing.vocabulary(), group_size=25).collect()
    e = packing.WordEncoder.of(packing.vocabulary())
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
    for i, t in rows:
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(docs(spark, []), packing.vocabulary()).count() == 0


# -- 4
def test_embedding_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 16))
    x = [(centers[i % 40] + rng.normal(size=16) * 0.12).tolist() for i in range(500)]
    x += [(centers[0] + rng.normal(size=16) * 0.02).tolist() for _ in range(300)] + [x[3]] * 20
    rows = [(i, v, [0, 1, 1][i % 3]) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0, None] + [0.0] * 14, 1), (n + 4, x[0], None), (n + 5, [1.0, 2.0], 1), (3, x[3], 0), (None, x[0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows[:n]])
    m = (u @ u.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(m, False)
    want = m.sum(1)
    have = np.array([got[i].n_links for i in range(n)])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    up = connect(n, list(zip(*np.nonzero(m))))
    assert np.mean([got[i].component_id == up[i] for i in range(n)]) > 0.97
    for i in range(n, n + 6):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert got[None].n_links == 0 and not got[None].kept and len(got) == n + 7
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# -- 5, 8, 10 have SQL; small tables that are not in the folders
def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return sorted([dict(zip(cols, r)) for r in cur.fetchall()], key=lambda r: str(r))


def rows_of(df):
    return sorted([r.asDict() for r in df.collect()], key=lambda r: str(r))


def test_imatch(spark):
    rows = [(i, t) for i, t in some(9) if i is not None]
    d = docs(spark, rows)
    got = imatch.edited_fingerprints(d)
    cols = got.columns
    want = duck(f"select {', '.join(cols)} from ({imatch.ORACLE})", documents=d)
    assert rows_of(got) == want
    f = {r.doc_id: r for r in got.collect()}
    assert f[63].fingerprint == f[64].fingerprint == f[5].fingerprint
    assert imatch.edited_fingerprints(docs(spark, [])).count() == 0
    one = imatch.edited_fingerprints(docs(spark, [(1, "alone here")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"alonealone").hexdigest()
    odd = imatch.edited_fingerprints(docs(spark, [(None, "a b"), (None, None), (2, "x"), (2, "y z")]))
    assert odd.count() == 4


def test_line_dedup(spark):
    long = "This is a Line that repeats in many documents"
    rows = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\n" + ("short\n" * 3)) for i in range(6)] + [(3, f"{long}\n{long}"), (9, None), (10, ""), (None, long), (11, "é" * 39), (12, long + "\r")]
    d = docs(spark, rows)
    out = line_dedup.dedup_lines(d, counts=True, count_chars="n_chars")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text if r.text is not None else "", r.n_lines, r.n_dropped) for r in out.collect())
    want = []
    for i, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if i == 12 or x.strip(" \t\r").lower() != long.lower()]
        want.append((i if i is not None else -1, "\n".join(keep), len(ls), len(ls) - len(keep)))
    assert got == sorted(want)
    assert out.columns[2:] == d.columns and {r.n_chars for r in out.where("doc_id = 0").collect()} == {len("own 0\nshort\nshort\nshort\n")}
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    four = docs(spark, [(i, long) for i in range(4)])
    assert line_dedup.dedup_lines(four, counts=True).where("n_dropped > 0").count() == 0


def test_line_dedup_streams_in_the_order_of_its_deal(spark):
    d = docs(spark, some(14))
    plan = line_dedup.first_occurrences(line_dedup.hashes(d, min_chars=1))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h" in plan and "hashpartitioning" not in plan
    assert plan.count("Sort [h") == 1 and plan.index("Window") < plan.index("rangepartitioning")
    marked = line_dedup.first_occurrences(line_dedup.hashes(docs(spark, [(1, "aa\nbb\naa"), (1, "aa"), (2, "aa"), (None, "aa")]), min_chars=1)).collect()
    assert sum(r["first"] for r in marked) == 3 and len(marked) == 6


def test_line_dedup_odd_documents(spark):
    line = "the same long line in far too many documents"
    rows = [(1, "\n".join([line] * 200)), (2, "\n".join([line, "own"] * 70)), (3, line), (3, line), (4, line), (5, "x " * 30000), (6, line), (7, line + "\n" + line)]
    d = docs(spark, rows).withColumn("n_lines", F.lit("mine")).withColumn("__bits_of", F.lit(1))
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(d, counts=True).collect())
    want = [(i, t if i in (5, 7) else "\n".join(x for x in t.split("\n") if x != line), t.count("\n") + 1, 0 if i in (5, 7) else t.split("\n").count(line)) for i, t in rows]
    assert got == sorted(want)
    assert line_dedup.dedup_lines(d).columns == d.columns


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a/ü", big), (3, "http://b", big), (9, None, big), (4, "http://c", None), (6, "u\r\nX: y", "small"), (7, "v", "small"), (8, "w", "\r\n\r\n" + "é" * 60), (3, "http://b", big), (None, "n", big)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(warc.decide(p), f"file://{tmp_path}/w")
    got = sorted(((r.page_id if r.page_id is not None else -1), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read(index, payload=True).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = 3 if h == big and i != 3 else None
        want.append(((i if i is not None else -1), "revisit" if first else "response", first, len(b), hashlib.sha256(b).hexdigest(), None if first else b))
    key = lambda r: (r[0], r[3])
    assert [(*r[:5], None if r[5] is None else bytes(r[5])) for r in sorted(got, key=key)] == sorted(want, key=key)
    some_ = warc.read(index.where("page_id in (4, 8)")).collect()
    assert sorted(r.page_id for r in some_) == [4, 8]
    assert warc.ranges([(0, 10), (10, 10), (100000, 5)], gap=100) == [[0, 1], [2]]
    assert warc.read(warc.write(warc.decide(p.limit(0)), f"file://{tmp_path}/e")).count() == 0


# -- 6
@pytest.fixture(scope="module")
def pairs():
    from public_tokenizers import PATTERN

    return bpe.BytePairs.of(bpe.vocabulary(), PATTERN)


def test_bpe_equals_the_library(pairs):
    import tiktoken
    from public_tokenizers import PATTERN

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    rng = random.Random(10)
    alpha = list("ab 's\n\té日😀1.,!　\x1c\x85") + ["don't", "   ", " naïve", "tion"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * 500, " " * 70 + "x", ""]
    for t in texts:
        assert pairs.encode(t) == enc.encode_ordinary(t), t
        assert pairs.decode(pairs.encode(t)) == t.encode()


def test_bpe_append_and_edit(pairs):
    rng = random.Random(11)
    data = bytes(rng.choice(b"abcdeinrst") for _ in range(400))
    p = bpe.Prefixes(pairs, data[:100])
    p.append(data[100:])
    assert p.ids() == bpe.merge(data, pairs.ranks) == pairs.ids_of(data)
    assert p.ids(57) == bpe.merge(data[:57], pairs.ranks)
    for _ in range(20):
        a = rng.randrange(350)
        b, new = a + rng.randrange(9), bytes(rng.choice(b"abxyz") for _ in range(rng.randrange(6)))
        data = data[:a] + new + data[b:]
        p.replace(a, b, new)
        assert p.data == data and p.last == bpe.Prefixes(pairs, data).last


def test_bpe_table(spark, pairs):
    from public_tokenizers import PATTERN

    rows = some(12)
    got = bpe.encode_documents(docs(spark, rows), bpe.vocabulary(), PATTERN, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted(t or "" for _, t in rows)


# -- pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "line_dedup", "simhash", "packing"] and cp.ORACLE_SQL is None
    d = spark.read.parquet(f"{TINY}/documents.parquet")
    kept = d
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, TINY)
        assert out.columns == d.columns
        before, after = {r.doc_id for r in kept.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and len(after) > 0.5 * len(before)
        kept = spark.createDataFrame(out.collect(), d.schema)
    packed = cp.STAGES[-1][1](spark, kept, TINY)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}
    assert cp.run(spark, TINY).count() > 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(i, t, "en", "s", 0) for i, t in some(13)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    empty = d.limit(0)
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sets = [plain_shingles(r[1]) for r in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    # models of one class keep all; line dedup keeps every document; one document of each group stays
    want = {"quality": len(rows), "toxicity": len(rows), "line_dedup": len(rows), "simhash": len(set(connect(len(rows), alike)))}
    for name, stage in cp.STAGES:
        out = stage(spark, d, str(tmp_path)).collect()
        if name in want:
            assert len(out) == want[name], name
        else:
            assert sorted({str(r.doc_id) for r in out}) == sorted({str(r[0]) for r in rows})
            assert sum(r.start == 0 for r in out) == len(rows)
        assert stage(spark, empty, str(tmp_path)).count() == 0
