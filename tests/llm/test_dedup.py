"""SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import lsh, simhash
from quern.llm.components import components


def grouped(n, linked, ids):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[x if ids[x] > ids[y] else y] = y if ids[x] > ids[y] else x
    return [ids[find(a)] for a in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_chains_stars_and_loops(rows):
    n = 200
    chain = [(k, k + 1) for k in range(n)]
    star = [(1000, k) for k in range(1001, 1300)]
    edges = rows("a long, b long", *chain, *star, (5000, 5000), (None, 3), (7, None), *chain)
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {k: 1000 for k in range(1000, 1300)}
    assert components(rows("a long, b long")).count() == 0


def near_texts():
    rng = random.Random(5)
    words = ["w%d" % k for k in range(400)]
    texts = [None, "", "  \n", "one", "One", "one two", "éa ÉA x\xa0y z"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 200))]
        texts.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base).upper())
    return texts


def test_simhash_equals_brute_force(rows):
    texts = near_texts()
    ids = list(range(10, 10 + len(texts)))
    docs = rows("doc_id long, text string, fp string, component int", *[(i, t, "x", 1) for i, t in zip(ids, texts)])
    fps = [plain_fingerprint(t) for t in texts]
    want = grouped(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2, ids)
    for levels in (None, 6):
        got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(docs, levels=levels).collect()}
        assert got == dict(zip(ids, zip(fps, want)))


@pytest.mark.parametrize("levels", [4, 8, 12])
def test_tree_loses_no_pair(rows, levels):
    rng = random.Random(levels)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(3)} | set(base) | {0, (1 << 64) - 1})
    table = rows("fp long, rep long", *[(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)])
    edges = simhash.links(table, 2, levels)
    got = {r.node: r.component for r in components(edges).collect()}
    want = grouped(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2, list(range(len(fps))))
    assert all(got.get(k, k) == w for k, w in enumerate(want))


@pytest.mark.parametrize("levels", [4, 5, 9, 16])
def test_fitted_tree_meets_every_pair_once(levels):
    """On clustered and biased fingerprints, fitted on few of them: each pair within the radius
    shares exactly one leaf where one of them is at home."""
    rng = np.random.default_rng(levels)
    bits = rng.random((400, 64)) < rng.random(64)
    base = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    flips = np.uint64(1) << rng.integers(0, 64, (400, 3)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips[:, 0], base ^ flips[:, 1] ^ flips[:, 2]]))
    tree = simhash.fit_tree(fps[::5], levels, 8)
    assert len(tree.vantage) > 10 and set(tree.vantage.tolist()) <= set(fps.tolist()) and tree.nbytes < 1 << 20
    at, leaf, home = tree.descend(fps, 2)
    assert home.sum() == len(fps) and len(np.unique(np.stack([at, leaf]), axis=1)[0]) == len(at)
    own = dict(zip(at[home].tolist(), leaf[home].tolist()))
    visits = {}
    for a, x in zip(at.tolist(), leaf.tolist()):
        visits.setdefault(a, set()).add(x)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    assert len(near) > 300
    for a, b in near.tolist():
        assert max(own[a], own[b]) in visits[a] & visits[b]
    if levels == 5:
        assert len(set(own.values())) > 100


def test_depth_grows_with_the_table():
    assert [simhash.levels_for(n) for n in (0, 10, 10**6, 10**7, 10**8, 10**9, 10**10, 10**15)] == [4, 4, 5, 7, 10, 12, 15, 16]


def test_links_through_texts_without_an_id(spark, rows, monkeypatch):
    marks = rows("id long, fp long", (4, 0), (None, 3), (9, 15), (None, 0x7FF << 40))
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: marks)
    got = {(r.id, r.fp): r.component for r in simhash.near_duplicates(marks).collect()}
    assert got == {(4, 0): 4, (None, 3): 4, (9, 15): 4, (None, 0x7FF << 40): None}


def test_a_very_long_text_is_counted_by_parts(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    texts = [" ".join(f"w{k % 13}" for k in range(n)) for n in (1, 3, 8, 9, 10, 50, 200)] + [None]
    assert simhash.fingerprint(texts).tolist() == [plain_fingerprint(t) for t in texts]


def test_large_leaves_are_split(rows, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_HOMES", 3)
    fps = [1 << a | 1 << b for a in range(8) for b in range(a)]
    table = rows("fp long, rep long", *[(f, k) for k, f in enumerate(fps)])
    got = {r.node: r.component for r in components(simhash.links(table, 2, 4)).collect()}
    assert got == dict.fromkeys(range(len(fps)), 0)


def test_simhash_nulls_repeats_and_empty(rows):
    docs = rows("doc_id long, text string", (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "only here x y z"), (9, None), (8, ""))
    got = sorted((r.id or 0, r.component or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (3, 3), (8, 8), (9, 8)]
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def vectors(n_clusters=30, dim=64, cosine=0.95, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_clusters):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        out.append(c)
        for _ in range(4):
            d = rng.normal(size=dim)
            d -= d @ c * c
            d /= np.linalg.norm(d)
            out.append(cosine * c + np.sqrt(1 - cosine**2) * d)
    return np.array(out)


def pairs_of(m, least=0.9):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    return {(a, b) for a in range(len(m)) for b in range(a + 1, len(m)) if s[a, b] >= least}


@pytest.mark.parametrize("block", [4096, 4])
def test_embeddings_recall_and_counts(rows, monkeypatch, block):
    monkeypatch.setattr(lsh, "BLOCK", block)
    m = vectors()
    want = pairs_of(m)
    got = {r.vec_id: r for r in lsh.near_duplicates(rows("vec_id long, embedding array<double>, label int", *[(k, v.tolist(), 0) for k, v in enumerate(m)])).collect()}
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.9 * len(want) <= found <= len(want)
    assert all(got[k].kept == (got[k].component_id == k) for k in got)
    exact = {k: sum(k in p for p in want) for k in got}
    assert all(got[k].n_links <= exact[k] for k in got)


@pytest.mark.parametrize("dim", [64, 256, 768, 1024, 1536])
def test_recall_at_the_threshold(dim):
    """Random pairs at cosine 0.9, the worst that have to be found, by width."""
    rng, n = np.random.default_rng(dim), 1000
    a, d = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d -= (a * d).sum(axis=1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * d
    met = lsh._meet(lsh.bucket_keys(a), lsh.bucket_keys(b)) < np.iinfo(np.int64).max
    print(dim, lsh.tables_for(dim), met.mean())
    assert met.mean() >= 0.95


def test_embeddings_without_ids_link_and_bridge(rows):
    def at(degrees):
        return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]

    e = rows("vec_id long, embedding array<double>", (5, at(0)), (None, at(0.5)), (None, at(25)), (7, at(50)), (None, at(120)), (9, at(200)), (9, at(220)))
    got = sorted(lsh.near_duplicates(e, tables=24).collect(), key=lambda r: (r.vec_id or 0, r.n_links, r.component_id or 0))
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [
        (None, 0, None, False), (None, 2, 5, False), (None, 3, 5, False), (5, 2, 5, True), (7, 1, 5, False), (9, 1, 9, True), (9, 1, 9, True),
    ]


def test_different_vectors_of_one_id(rows):
    e = rows("vec_id long, embedding array<double>", (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [0.02, 1.0]))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lsh.near_duplicates(e).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_embeddings_that_link_with_nothing(rows):
    nan, inf = float("nan"), float("inf")
    e = rows(
        "vec_id long, embedding array<double>",
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.001]), (10, [1e-200, 0.0]),
    )
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in lsh.near_duplicates(e).collect())
    # The row without an id links like any other.
    assert [g for g in got if g[0] in (0, 1, 2, 10)] == [(0, 4, 1, False), (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (10, 4, 1, False)]
    assert all(g[1] == 0 and g[3] for g in got if g[0] in (3, 4, 5, 6, 7, 8, 9))
    assert lsh.near_duplicates(e.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("dim", [2, 3, 64, 300])
def test_codes_lose_no_link(dim):
    """Rows kept by codes hold all pairs above the cosine: random ones, near pairs, single axes."""
    import pyarrow as pa

    rng = np.random.default_rng(dim)
    v = rng.normal(size=(400, dim))
    v[100:200] = v[:100] + 0.4 * rng.normal(size=(100, dim))
    v[200:202] = np.eye(dim)[:2]
    v[202:300] = lsh.hadamard(np.eye(lsh.padded_width(dim)))[rng.integers(0, dim, 98), :dim] + 0.1 * rng.normal(size=(98, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    bits, angle = lsh.codes(v)
    code = [b.tobytes() + np.float32(a).tobytes() + np.int32(dim).tobytes() for b, a in zip(bits, angle)]
    for task in (np.zeros(400, np.int64), np.repeat(np.arange(10) * lsh._BLOCKS**2, 40)):
        batch = pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.arange(400)), pa.array(np.ones(400, np.int32)), pa.array(code)], names=["task", "node", "place", "code"])
        kept = {n for b in lsh._kept(0.9)(iter([batch])) for n in b["node"].to_pylist()}
        s = (v @ v.T >= 0.9) & (task[:, None] == task)
        np.fill_diagonal(s, False)
        assert set(np.flatnonzero(s.any(axis=1)).tolist()) <= kept
        assert dim < 64 or len(kept) < 400
