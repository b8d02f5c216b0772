"""Near-duplicates of texts and vectors against brute force, on small tables with ties, nulls and hot groups."""

import random

import numpy as np
import pytest

from hopframe.llm import _runtime, ann, components, embdedup, minmax, queries
from hopframe.llm.pivots import usable


def _roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def _documents():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "one", "One", "two words", "TWO  Words", "Ünï ünï", "ünï ünï", "a b c d e f g"]
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 150]))]
        for _ in range(rng.choice([1, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["hot copy of the same text again and again"] * 40
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(30_000)))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [4, 5])
@pytest.mark.parametrize("block", [1024, 3])
def test_texts(spark, monkeypatch, width, block):
    monkeypatch.setattr(minmax, "BLOCK", block)  # small blocks: the way of large groups
    rows = _documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_shingles", "'x' as rep", "2 as key")
    got = {r.doc_id: r for r in minmax.near_duplicates(docs, width=width).collect()}
    sets = {i: _shingles(t, width) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = _roots(sets, links)
    assert {i: r.component_id for i, r in got.items()} == roots
    assert all(r.n_shingles == len(sets[i]) and r.kept == (roots[i] == i) for i, r in got.items())


def test_texts_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minmax.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in minmax.near_duplicates(odd).collect() if r.doc_id is not None)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]
    nulls = [r for r in minmax.near_duplicates(odd).collect() if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in nulls] == [(None, True)]


def test_signatures_estimate_similarity_without_bias():
    rng = np.random.default_rng(0)
    mult, add = minmax._coefficients(80)
    shares = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**64, 150, np.uint64))
        a, b = minmax.signature(pool[:100], mult, add), minmax.signature(pool[50:150], mult, add)
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 1 / 3) < 0.02


@pytest.mark.parametrize("hub", [256, 5])
def test_chains_and_stars_are_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    monkeypatch.setattr(components, "MOST_HUBS", 10_000)
    rng = random.Random(hub)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)] + [(5000, i) for i in range(3000, 3400)] + [(5000, 159)]
    loose = [(rng.randrange(10_000, 10_400), rng.randrange(10_000, 10_400)) for _ in range(300)]
    edges = spark.createDataFrame([*chain, *star, *loose, (5, 5), (None, 3), (200, 150)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    all_ = [(a, b) for a, b in [*chain, *star, *loose, (200, 150)] if a != b]
    assert got == _roots({x for e in all_ for x in e}, all_)
    assert components.connected_components(edges.limit(0)).collect() == []


def _vectors():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        base = rng.normal(size=64)
        for _ in range(rng.choice([1, 2, 9])):
            noise = rng.normal(size=64) * rng.choice([0.0, 0.1, 0.3, 0.42])
            rows.append(((base + noise) * rng.choice([0.5, 2.0])).astype(np.float32).tolist())
    rows += [rows[0]] * 30 + [(np.array(rows[3]) + 1e-3 * i).tolist() for i in range(40)]
    labels = [int(i % 3) for i in range(len(rows))]
    odd = [(None, 0), ([], 0), ([0.0] * 64, 0), ([float("nan")] + [1.0] * 63, 0), ([None] + [1.0] * 63, 0), ([float("inf")] * 64, 1), ([1.0] * 3, 0), ([2.0] * 3, 0), (rows[0], None)]
    return [(i, v, k) for i, (v, k) in enumerate([*zip(rows, labels, strict=True), *odd])]


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embdedup, "BLOCK", block)
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as w", "2 as near", "3 as v")
    got = {r.vec_id: r for r in embdedup.near_duplicates(df).collect()}
    good = {i: (np.array(v, np.float32).astype(float), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = []
    for a, (x, k) in good.items():
        for b, (y, m) in good.items():
            if a < b and k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.append((a, b))
    roots = _roots([i for i, _, _ in rows], links)
    degree = {i: sum(i in e for e in links) for i, _, _ in rows}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (degree[i], roots[i], roots[i] == i) for i in roots}


@pytest.mark.parametrize(("n", "spread"), [(2, 0.03), (300, 0.02), (300, 0.035), (300, 0.05), (900, 0.05)])
def test_vectors_in_a_cone(spark, n, spread):
    rng = np.random.default_rng(n)
    x = 1 / 8 + rng.normal(size=(n, 64)) * spread
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T
    links = [(a, b) for a in range(n) for b in range(a) if near[a, b] >= 0.93]
    roots = _roots(range(n), links)
    degree = np.bincount(np.array(links).reshape(-1), minlength=n)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_duplicates(df).collect()}
    assert links and got == {i: (degree[i], roots[i]) for i in range(n)}


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in embdedup.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert ann.nearest(df, df.vec_id >= 0).collect() == []


def _recall(got, ids, x, asked, k=10):
    """Share of the k nearest found; ranks and scores must be right for what was found."""
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[ids == ids[q]] = np.inf
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[q])
        n = min(k, int(np.isfinite(d).sum()))
        assert [r for r, _, _ in own] == list(range(1, n + 1))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own) and len({v for _, v, _ in own}) == n
        at = {int(i): e for i, e in zip(ids, d, strict=True)}
        assert all(np.isclose(s, at[v], rtol=1e-12, atol=0) for _, v, s in own)
        hits += sum(s <= np.sort(d)[n - 1] * (1 + 1e-12) for _, _, s in own) / n
    return hits / len(asked)


_KINDS = {
    "uniform": lambda rng, g: g / np.linalg.norm(g, axis=1, keepdims=True),
    "shifted": lambda rng, g: g + 10,
    "norms": lambda rng, g: g * np.exp(rng.normal(size=(len(g), 1))),
    "clusters": lambda rng, g: 3 * rng.normal(size=(50, g.shape[1]))[rng.integers(0, 50, len(g))] + g / 2,
    "one direction": lambda rng, g: np.ones(g.shape[1]) + g * 1e-3,
    "hot": lambda rng, g: np.where(np.arange(len(g))[:, None] % 3 == 0, g[:1], g),
}


@pytest.mark.parametrize("kind", _KINDS)
@pytest.mark.parametrize("rows_of_a_block", [32_768, 500])
def test_search_finds_nine_of_ten_and_measures_exactly(spark, monkeypatch, kind, rows_of_a_block):
    rng, n = np.random.default_rng(2), 6000
    x = _KINDS[kind](rng, rng.normal(size=(n, 32))).astype(np.float32)
    if rows_of_a_block < n:  # many cells, of several blocks each where it is hot, and queries in turns
        monkeypatch.setattr(ann, "BLOCK_BYTES", rows_of_a_block * 32 * 8)
        monkeypatch.setattr(ann, "QUERY_BLOCK", 13)
    odd = [(n + 1, None), (n + 2, [0.0] * 32), (n + 3, [float("nan")] * 32), (None, [1.0] * 32)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "2 as v", "3 as q").repartition(3)
    got = ann.nearest(df, df.vec_id % 100 == 0).collect()
    assert len(got) == 600 and _recall(got, np.arange(n), x.astype(float), range(0, n, 100)) >= 0.93


def test_search_of_few_vectors_and_of_several_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4 if i % 3 else 9).tolist()) for i in range(700)]
    df = spark.createDataFrame([*rows, (0, rows[1][1]), (0, rows[1][1])], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.vec_id.isin(1, 3, 99, 100)).collect()
    for length in (4, 9):
        own = [(i, v) for i, v in rows if len(v) == length]
        ids, x = np.array([i for i, _ in own]), np.array([v for _, v in own])
        mine = [r for r in got if r.query_id in ids and not (r.query_id == 1 and r.vec_id == 0)]
        asked = [int(np.flatnonzero(ids == q)[0]) for q in (3, 99, 100) if q in ids]
        assert _recall(mine, ids, x, asked) >= 0.9
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1][:2] == [(1, 0, 0.0), (2, 0, 0.0)]
    few = df.where("vec_id < 4")
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest(few.distinct(), few.vec_id == 2).collect()) == [(2, 0), (2, 1)]


def test_search_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    got = queries.op5_permutation_search(spark, "/root/testdata/sf0.1").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    assert _recall(got, ids, x, np.flatnonzero(ids % 100 == 0)) >= 0.95


def test_usable(spark):
    df = spark.createDataFrame([(None,), ([],), ([0.0],), ([-0.0, 0.0],), ([float("nan")],), ([1.0, None],), ([1.0],)], "v array<double>")
    assert [r[0] for r in df.select(usable("v")).collect()] == [False] * 6 + [True]


def test_shared_folder_is_the_sessions_own(spark):
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "file://")
    assert _runtime.shared_dir(spark).startswith(own.rstrip("/"))
    df = _runtime.materialize(spark.range(3), "x")
    assert df.count() == 3
