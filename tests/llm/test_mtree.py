import numpy as np
import pytest

from spindrift.llm import mtree

SCHEMA = "vec_id bigint, embedding array<float>, id string, tree int, TEXT string"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [None if y is None else float(y) for y in v], "x", 1, "y") for i, v in zip(ids, x)], SCHEMA).repartition(3)


def brute(ids, x, k):
    x = np.asarray(x, np.float32).astype(float)
    out = {}
    for i, q in zip(ids, x):
        d = np.sqrt(((x - q) ** 2).sum(1))
        out[i] = [(int(j), d_) for d_, j in sorted((d_, j) for d_, j in zip(d, ids) if j != i)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["neighbor_id"], r["distance"]))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert [i for i, _ in a[k]] == [i for i, _ in b[k]]
        assert np.allclose([d for _, d in a[k]], [d for _, d in b[k]], atol=1e-7)


@pytest.mark.parametrize("page, rows", [(4, 50), (16, 10_000), (64, 37)])
def test_against_all_pairs(spark, page, rows):
    rng = np.random.default_rng(page)
    x = np.concatenate([rng.normal(c, 0.2, (60, 8)) for c in rng.normal(size=(4, 8))])
    x[50:70] = x[10]  # ties
    same(got(mtree.knn(frame(spark, range(len(x)), x), 7, page=page, tree_rows=rows)), brute(range(len(x)), x, 7))


def test_bounds_save_distances():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c * 10, 0.1, (500, 4)) for c in rng.normal(size=(8, 4))])
    t = mtree.Tree.build(np.arange(4000), x, x.mean(0), 32)
    computed = [t.search(q, 5, float(np.sqrt(((q - x.mean(0)) ** 2).sum())))[2] for q in x[::100]]
    assert np.mean(computed) < 0.2 * len(x)
    assert sum(len(p[1]) for p in t.pages if p[0]) == 4000 and max(len(p[1]) for p in t.pages if p[0]) <= 32


def test_all_alike():
    x = np.ones((300, 3))
    t = mtree.Tree.build(np.arange(300), x, x[0], 8)
    d, i, _ = t.search(x[0], 4, 0.0, own=0)
    assert i.tolist() == [1, 2, 3, 4] and d.tolist() == [0, 0, 0, 0]


def test_edges(spark):
    x = [[1, 2], [1, 2], None, [], [1, 2, 3], [None, 1], [float("nan"), 1], [3, 4], [float("inf"), 0]]
    df = frame(spark, range(9), x)
    same(got(mtree.knn(df.union(df), 3)), {0: [(1, 0.0), (7, 8**0.5)], 1: [(0, 0.0), (7, 8**0.5)], 7: [(0, 8**0.5), (1, 8**0.5)]})
    assert mtree.knn(df.limit(0)).count() == 0
    assert mtree.knn(frame(spark, [5], [[1, 1]])).count() == 0


def test_lengths_are_apart(spark):
    x = [[1, 2], [1, 3, 0], [1, 4], [5], [1, 3, 1], [8, 8]]
    df = frame(spark, range(6), x)
    found = got(mtree.knn(df, 2, tree_rows=1))
    assert {q: [i for i, _ in r] for q, r in found.items()} == {0: [2, 5], 2: [0, 5], 5: [2, 0], 1: [4], 4: [1]}


def test_queries_side_by_side_are_queries_one_by_one():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (400, 6)) for c in rng.normal(size=(5, 6))])
    x[100:120] = x[7]
    t = mtree.Tree.build(np.arange(2000), x, x.mean(0), 32)
    q = x[::7]
    best = mtree.Best(len(q), 9)
    away = mtree._distances(q, x.mean(0))
    computed = t.search_all(q, np.arange(2000)[::7], best, away)
    want = brute(range(2000), x.astype(np.float32), 9)
    alone = sum(t.search(v, 9, away[i], own=int(i * 7))[2] for i, v in enumerate(q))
    assert [b.tolist() for b in best.i] == [t.search(v, 9, away[i], own=int(i * 7))[1].tolist() for i, v in enumerate(q)] and computed == alone
    assert np.mean([[j for j, _ in want[i * 7]] == b.tolist() for i, b in enumerate(best.i)]) > 0.99  # but for rounding to 32 bits


def test_page_by_page_is_query_by_query():
    rng = np.random.default_rng(8)
    for scale, shift in ((1, 0), (1e-6, 3), (1e12, 0), (1e120, 0), (1, 1e6)):
        x = np.concatenate([rng.normal(c, 0.3, (400, 6)) for c in rng.normal(size=(5, 6))]) * scale + shift
        x[100:120] = x[7]
        t = mtree.Tree.build(np.arange(2000), x, x[0], 32)
        q, own = x[::7], np.arange(2000)[::7]
        away = mtree._distances(q, x[0])
        one, all_ = mtree.Best(len(q), 9), mtree.Best(len(q), 9)
        t.search_all(q[:150], own[:150], part := mtree.Best(150, 9), away[:150])
        all_.d[:150], all_.i[:150] = part.d, part.i
        t.sweep(q[150:], own[150:], rest := mtree.Best(len(q) - 150, 9), away[150:])
        all_.d[150:], all_.i[150:] = rest.d, rest.i
        d = np.sqrt(((q[:, None] - x) ** 2).sum(2))
        for k in range(len(q)):
            d[k, own[k]] = np.inf
        order = np.lexsort((np.broadcast_to(np.arange(2000), d.shape), d))[:, :9]
        assert (all_.i == order).all(), (scale, shift)


def test_queries_are_every_so_many(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8))
    want = {q: n for q, n in brute(range(700), x, 5).items() if q % 50 == 0}
    same(got(mtree.knn(frame(spark, range(700), x), 5, page=16, tree_rows=60, every=50)), want)
    assert got(mtree.knn(frame(spark, [1, 2], x[:2]), 5, every=50)) == {}


def test_slices():
    extent = {0: (1, 2, 3), 1: (1, 2, 4), 2: (1, 2, 0), 3: (1, 2, 20), 4: (1, 2, 5), 5: (1, 7, 1), 6: (1, 7, 9)}
    assert mtree._slices(extent, 8) == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 1, 3), (4, 4, 1), (5, 5, 1), (6, 6, 2)]
