import numpy as np
import pytest

from tidemark.llm import embedding_neighbours as E
from tests.llm.test_simhash import union_find


def brute(rows, least=0.95):
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    u = {i: E.unit(np.array([rows[i][1]], np.float32).astype(float))[0] for i in good}
    for a in good:
        for b in good:
            if a != b and len(u[a]) == len(u[b]) and u[a] @ u[b] >= least:
                links[a].add(b)
    root = union_find(len(rows), [(a, b) for a in links for b in links[a]])
    least_id = {}
    for i, (k, _) in enumerate(rows):
        least_id[root[i]] = k if k is None or root[i] not in least_id else min(k, least_id[root[i]])
    return links, [least_id[r] for r in root]


def compare(spark, rows, **kw):
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, n long")
    got = {r.vec_id: r for r in E.near_duplicates(df, **kw).collect()}
    links, root = brute(rows)
    want = sum(map(len, links.values()))
    found = sum(r.n_links for r in got.values())
    exact = all(got[k].n_links == len(links[i]) and got[k].component_id == root[i] for i, (k, _) in enumerate(rows) if k is not None)
    return got, want, found, exact


def clusters(rng, n, dim, size, noise):
    out = []
    while len(out) < n:
        c = rng.normal(size=dim)
        out += [(c + rng.normal(size=dim) * noise * rng.random()).astype(np.float32).tolist() for _ in range(rng.integers(1, size))]
    return list(enumerate(out[:n]))


def test_recall(spark):
    rng = np.random.default_rng(1)
    for dim, (tables, width) in ((64, (None, None)), (64, (12, 3)), (64, (24, 4)), (20, (None, None))):
        got, want, found, _ = compare(spark, clusters(rng, 500, dim, 7, 0.35), tables=tables, width=width)
        assert want > 100 and want * 0.97 <= found <= want, (dim, tables, width, found / want)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 40)
    rng = np.random.default_rng(2)
    rows = clusters(rng, 260, 32, 2, 0) + [(260 + i, x) for i, (_, x) in enumerate(clusters(rng, 150, 32, 151, 0.15))]
    got, want, found, exact = compare(spark, rows)
    assert want > 5000 and found <= want and found >= 0.99 * want


def test_edges(spark):
    a, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(9, a), (4, a), (5, [x * 1e30 for x in a]), (6, None), (7, []), (8, [0.0, 0.0, 0.0]), (1, [1.0, None, 3.0]), (2, [nan, 1.0, 1.0]), (3, [inf, 1.0, 1.0]), (None, a), (10, [1.0, 2.0, 3.0, 0.0]), (11, [3.0, -2.0, 1.0])]
    got, want, found, exact = compare(spark, rows)
    assert exact and len(got) == 12 and got[None].n_links == 0 and not got[None].kept
    assert got[9].n_links == 2 and got[9].component_id == 4 and got[4].kept and not got[9].kept and got[6].kept
    twice = spark.createDataFrame([(1, a), (1, a), (2, a)], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in E.near_duplicates(twice).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert E.near_duplicates(twice.limit(0)).count() == 0


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    links, root = brute(rows)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(map(len, links.values()))
    assert all(got[k].n_links <= len(links[i]) for i, (k, _) in enumerate(rows))


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    assert np.allclose(E.hadamard(E.hadamard(x)), x) and np.allclose((E.hadamard(x) ** 2).sum(1), (x**2).sum(1))
    with pytest.raises(ValueError):
        E.hadamard(np.zeros((2, 6)))
