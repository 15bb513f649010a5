from collections import defaultdict

import numpy as np
import pytest

from spindrift.llm import bpe, packing
from tests.llm.frames import docs, empty


def naive(sizes, capacity, rule):
    """The same rule, one bin at a time, with all bins open."""
    top = np.array(capacity, float)
    items = [np.array([n, 1, n * n]) / top for n in map(float, sizes)]
    weight = np.mean(items, axis=0) / np.mean(items, axis=0).sum()
    bins, out = [], []
    for v in items:
        best, score = None, None
        for b, free in enumerate(bins):
            if (free - v >= -1e-12).all():
                s = ((free - v) ** 2) @ weight if rule == "norm" else -(free @ (weight * v))
                if score is None or s < score - 1e-15:
                    best, score = b, s
        if best is None:
            bins.append(1 - v)
            best = len(bins) - 1
        else:
            bins[best] = bins[best] - v
        out.append(best)
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(100, 5, 10_000), (100, 50, 4_000)])
def test_same_as_naive(rule, capacity):
    sizes = np.sort(np.random.default_rng(1).integers(1, 60, 700))[::-1]
    assert packing.pack(sizes, capacity, rule).tolist() == naive(sizes, capacity, rule)


def test_too_large_and_none():
    with pytest.raises(ValueError):
        packing.pack(np.array([11]), (10, 1, 1000))
    assert packing.pack(np.zeros(0, int), (10, 1, 100)).tolist() == []


def check(rows, tokens, documents, cost):
    used = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        u = used[r["bin_id"]]
        u[0], u[1], u[2] = u[0] + r["tokens"], u[1] + 1, u[2] + r["tokens"] ** 2
    assert all(a <= tokens and b <= documents and c <= cost for a, b, c in used.values())
    return used


def test_documents(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = packing.pack_documents(df, 512, 8, 512 * 256, group_items=100).collect()
    used = check(rows, 512, 8, 512 * 256)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    words = {k: len(v) for k, v in ids.items()}
    # the sequences themselves: every place is taken once, from 0 on, and the documents come back whole
    sequences, back = defaultdict(dict), defaultdict(list)
    for r in rows:
        for j in range(r["tokens"]):
            assert sequences[r["bin_id"]].setdefault(r["place"] + j, ids[r["doc_id"]][r["start"] + j]) is ids[r["doc_id"]][r["start"] + j]
    assert all(sorted(s) == list(range(used[b][0])) and len(s) <= 512 for b, s in sequences.items())
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        back[r["doc_id"]] += [sequences[r["bin_id"]][r["place"] + j] for j in range(r["tokens"])]
    assert back == {k: v for k, v in ids.items() if v}
    have = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == have[r["doc_id"]]
        have[r["doc_id"]] += r["tokens"]
    assert dict(have) == {k: v for k, v in words.items() if v}
    assert sum(words.values()) / (512 * len(used)) > 0.6


def test_edges(spark):
    rows = packing.pack_documents(docs(spark), 100, 3, 100 * 50).collect()
    check(rows, 100, 3, 5000)
    count = defaultdict(int)
    for r in rows:
        count[r["doc_id"]] += r["tokens"]
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.encode(docs(spark)).collect()}
    assert dict(count) == {1: 2 * n[1], 2: n[2], 5: n[5], 6: n[6], 7: n[7], 8: n[8]} and n[6] > 30_000
    assert packing.pack_documents(empty(spark)).count() == 0
