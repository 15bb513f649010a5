import numpy as np
import pytest

from spindrift.llm import simhash
from tests.llm.frames import docs, empty


def brute(prints, radius):
    """Least id of each component, over all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (int.from_bytes(prints[a]) ^ int.from_bytes(prints[b])).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids if find(i) != i}


@pytest.mark.parametrize("radius", [0, 3, 17, 30])
@pytest.mark.parametrize("n", [1, 1000, 250_000, 8_000_000, 1 << 32])
def test_layouts_leave_no_pair_out(n, radius):
    parts = simhash.layout(n, radius)
    assert [f for f, _, _ in parts] == list(np.cumsum([0] + [w for _, w, _ in parts])[:-1]) and sum(w for _, w, _ in parts) <= 128
    assert sum(t + 1 for _, _, t in parts) > radius  # else all segments could differ by more than their balls hold


def test_segments_are_the_bits():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, (50, 16), dtype=np.uint8)
    both = raw.reshape(-1).view(">i8").astype(np.int64).reshape(-1, 2)
    hi, lo = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
    bits = np.unpackbits(raw, axis=1)
    for first, width in ((0, 14), (50, 14), (51, 20), (60, 30), (64, 9), (100, 28)):
        assert simhash._segment(hi, lo, first, width).tolist() == [int("".join(map(str, b[first : first + width])), 2) for b in bits]


def planted(radius, bases=60):
    rng = np.random.default_rng(radius)
    prints = {}
    for i in range(bases):
        base = rng.integers(0, 2, 128)
        for j in range(6):
            flip = base.copy()
            flip[rng.choice(128, rng.integers(0, radius + 4), replace=False)] ^= 1
            prints[i * 10 + j] = np.packbits(flip.astype(np.uint8)).tobytes()
    return prints


def halves(prints):
    return [(k, int.from_bytes(v[:8], signed=True), int.from_bytes(v[8:], signed=True)) for k, v in prints.items()]


@pytest.mark.parametrize("group_rows", [20, 1 << 17])
@pytest.mark.parametrize("radius, like", [(0, 1), (3, 1000), (17, 300), (17, 1 << 24)])
def test_finds_every_pair(spark, radius, like, group_rows, monkeypatch):
    """Fingerprints at distances around the radius, through the real join, against all pairs; also as cut for larger tables."""
    prints = planted(radius)
    chosen = simhash.layout(like, radius)
    monkeypatch.setattr(simhash, "layout", lambda n, r: chosen)
    unique = spark.createDataFrame([(min(k for k, w in prints.items() if w == v), *h) for (_, *h), v in zip(halves(prints), prints.values())], "node bigint, hi bigint, lo bigint").distinct()
    got = {r["node"]: r["root"] for r in simhash.components(simhash.near_edges(unique, len(prints), radius, group_rows)).collect()}
    same = {k: min(j for j, w in prints.items() if w == v) for k, v in prints.items()}
    assert {k: got.get(v, v) for k, v in same.items() if got.get(v, v) != k} == brute(prints, radius)


@pytest.mark.parametrize("radius", [3, 17])
def test_a_group_of_many_alike(radius, monkeypatch):
    """Buckets of far more rows than are compared pair by pair: one segment holds them all."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    prints, base = {}, [rng.integers(0, 2, 128) for _ in range(3)]
    for k in (1, 2):
        base[k][:20] = base[0][:20]
    for i in range(400):
        flip = base[i % 3].copy()
        flip[20 + rng.choice(108, rng.integers(0, radius + 3), replace=False)] ^= 1
        prints[i] = np.packbits(flip.astype(np.uint8)).tobytes()
    prints = {min(k for k, w in prints.items() if w == v): v for v in prints.values()}
    parts = tuple((f, w, 0) for f, w in [(0, 20)] + [(20 + 4 * i, 4) for i in range(17)])
    rows = halves(prints)
    pairs = []
    for batch in simhash._spread(parts, 0)([pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], ["node", "hi", "lo"])]):
        pairs += simhash._verify(parts, 0, radius)(pa.Table.from_batches([batch])).to_pylist()
    forest = simhash.Forest(400)
    forest.join(np.array([p["a"] for p in pairs], int), np.array([p["b"] for p in pairs], int))
    assert {k: int(forest.root[k]) for k in prints if forest.root[k] != k} == brute(prints, radius)


def test_documents_against_all_pairs(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in df.collect()}
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_duplicates(df).collect()}
    assert got == brute({k: v for k, v in prints.items() if v}, simhash.RADIUS)


def test_near_copies_are_caught_and_others_left(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(3000)]
    rows, copies = [], set()
    for i in range(120):
        text = list(rng.choice(words, 300))
        rows.append((i * 10, " ".join(text), "en", "s", 0))
        if i % 3 == 0:
            for j in range(1, 4):
                new = list(text)
                for k in rng.choice(300, 9, replace=False):
                    new[k] = rng.choice(words)
                rows.append((i * 10 + j, " ".join(new), "en", "s", 0))
                copies.add(i * 10 + j)
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert all(k // 10 == v // 10 for k, v in got.items())
    assert len(copies & got.keys()) >= 0.95 * len(copies) and not got.keys() - copies


def test_edges(spark):
    df = docs(spark)
    assert {(r["doc_id"], r["duplicate_of"]) for r in simhash.near_duplicates(df).collect()} == {(2, 1)}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 1, 3, 4, 5, 6, 7, 8]
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.drop_near_duplicates(empty(spark)).count() == 0
    assert simhash.fingerprint(None) is None and simhash.fingerprint(" \n") is None and simhash.fingerprint("!!!") == simhash.fingerprint(" !!! ")
    with pytest.raises(ValueError):
        simhash.near_duplicates(df, radius=41)


def test_thousands_of_copies(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('one two three four five six seven eight nine ten ', id % 2) as text")
    got = simhash.near_duplicates(df).collect()
    assert len(got) >= 2998 and {r["duplicate_of"] for r in got} <= {0, 1}


def test_an_id_with_two_texts_is_named_once(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "one two three four"), (5, "one two three four"), (5, "alpha beta gamma delta"), (5, "quite another text here")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["duplicate_of"]) for r in got} == {(5, 1)} and len(got) == 1
