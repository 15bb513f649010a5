import numpy as np

from spindrift.llm import sortpass
from tests.llm.test_mtree import frame


def planted(seed=0, groups=40, size=5, others=400, dim=64):
    rng = np.random.default_rng(seed)
    x, group = [], []
    for g in range(groups):
        base = rng.normal(size=dim)
        for _ in range(size):
            x.append(base + rng.normal(0, 0.1, dim))
            group.append(g)
    x += list(rng.normal(size=(others, dim)))
    return np.array(x), group + [-1] * others


def test_recall_against_all_pairs(spark):
    x, _ = planted()
    order = np.random.default_rng(1).permutation(len(x))
    x = x[order].astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(u @ u.T >= sortpass.COSINE, 1))
    got = {r["vec_id"]: r["duplicate_of"] for r in sortpass.near_duplicates(frame(spark, range(len(x)), x)).collect()}
    root = lambda i: got.get(i, i)
    assert np.mean([root(a) == root(b) for a, b in near]) >= 0.95
    linked = {int(i) for p in near for i in p}
    assert got.keys() <= linked


def test_neighbours_across_partitions(spark, monkeypatch):
    """With partitions smaller than the window, the pairs are those of one partition."""
    x, _ = planted(2, 10, 4, 60)
    rows = sortpass.usable(frame(spark, range(len(x)), x), "vec_id", "embedding")
    pairs = lambda: {tuple(sorted((r["a"], r["b"]))) for r in sortpass.near_pairs(rows, sortpass._means(rows), range(5)).collect()}
    whole = pairs()
    for n in (300, 40):
        monkeypatch.setattr(sortpass, "PART_ROWS", n)
        assert pairs() == whole


def test_dense_clouds(spark):
    """Backgrounds of vectors that are all rather like each other, but not enough, around each pair."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3, 64))
    x = np.concatenate([c + rng.normal(0, 0.5, (1300, 64)) for c in centre])
    pairs = {}
    for k in rng.choice(len(x), 150, replace=False):
        near = x[k] + rng.normal(0, 0.28, 64)
        pairs[len(x)] = int(k)
        x = np.concatenate([x, near[None]])
    u = x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)
    near = np.argwhere(np.triu(u @ u.T >= sortpass.COSINE, 1))
    assert len(near) > 60
    got = {r["vec_id"]: r["duplicate_of"] for r in sortpass.near_duplicates(frame(spark, range(len(x)), x)).collect()}
    assert np.mean([got.get(a, a) == got.get(b, b) for a, b in near]) >= 0.95


def test_passes_follow_size_and_density():
    some = [sortpass.passes_for(n, 0.0, 0.95, 24, 0.98) for n in (100, 10**5, 10**7, 10**9)]
    assert some == sorted(set(some)) and sortpass.passes_for(10**5, 0.8, 0.95, 24, 0.98) > 2 * some[1]


def test_what_is_missing():
    for y in (0.05, 0.3, 0.8, 0.97):
        for k in (1, 2, 5):
            m = y ** (k + 2)
            assert abs(sortpass.missing(m * (1 - y) / (1 - m), k) - y ** (k + 3)) < 1e-6
    assert sortpass.missing(0, 1) < 1e-6


def test_lengths_are_apart(spark):
    x = [[1, 2], [2, 4.01], [1, 2, 3], [2, 4, 6], [1, 2, 0], [5], [6], [-1], [1, 2, 3]]
    got = {(r["vec_id"], r["duplicate_of"]) for r in sortpass.near_duplicates(frame(spark, range(9), x)).collect()}
    assert got == {(1, 0), (3, 2), (8, 2), (6, 5)}


def test_sketches_bound_the_cosine():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 48))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([48] * 200, pa.int32()), pa.array(x.tolist())], ["id", "n", "vec"])
    out = next(iter(sortpass._hash(range(1), {48: (200, np.zeros(48))}, 0)([batch])))
    lo, hi, sketch = next(iter(sortpass._runs(out.column(0).to_numpy(), out.column(3))))
    head = np.ascontiguousarray(sketch[:, :8]).view(np.float32)
    y, lost = sketch[:, 8:] * head[:, :1], head[:, 1]
    u = sortpass._unit(x)
    assert (np.abs(u @ u.T - y @ y.T) <= lost[:, None] + lost + lost[:, None] * lost + 1e-6).all() and lost.max() < 0.02


def test_many_copies(spark):
    x = np.tile(np.random.default_rng(0).normal(size=8), (500, 1))
    got = sortpass.near_duplicates(frame(spark, range(500), x)).collect()
    assert len(got) == 499 and {r["duplicate_of"] for r in got} == {0}


def test_edges(spark):
    x = [[1, 2], [2, 4], None, [], [1, 2, 3], [None, 1], [float("nan"), 1], [0, 0], [0, 0], [-1, -2]]
    df = frame(spark, range(10), x)
    assert {(r["vec_id"], r["duplicate_of"]) for r in sortpass.near_duplicates(df.union(df)).collect()} == {(1, 0)}  # 7 and 8 are zeros
    assert sortpass.near_duplicates(df.limit(0)).count() == 0
