from collections import defaultdict

import pytest

from spindrift.llm import sharding
from tests.llm.frames import EDGE, docs, empty


@pytest.mark.parametrize("target", [2_000, 20_000])
def test_ranges(spark, target):
    rows = [(i, "x" * (1 + i * 37 % 900), "en", "hot" if i % 3 else f"s{i % 40:02}", 0) for i in range(1500)] + [(9999, "y" * 30_000, "en", "s01", 0)]
    got = sharding.shard(docs(spark, rows), target_bytes=target).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    size, lo, hi, n = defaultdict(int), {}, {}, defaultdict(int)
    for r in got:
        s, k = r["shard"], r["source"]
        size[s] += len(r["text"])
        n[s] += 1
        lo[s], hi[s] = min(lo.get(s, k), k), max(hi.get(s, k), k)
    order = sorted(size)
    assert all(hi[a] <= lo[b] for a, b in zip(order, order[1:]))  # ranges of the key, in its order
    assert all(size[s] <= sharding.SLACK * target or n[s] == 1 or size[s] - 30_000 <= sharding.SLACK * target for s in order)
    assert len(order) >= sum(size.values()) / target / 1.3
    assert got == sharding.shard(docs(spark, rows), target_bytes=target).collect() or {(r["doc_id"], r["shard"]) for r in got} == {(r["doc_id"], r["shard"]) for r in sharding.shard(docs(spark, rows), target_bytes=target).collect()}


def test_shards_are_whole_partitions(spark):
    rows = [(i, "x" * 500, "en", f"s{i % 7}", 0) for i in range(300)]
    parts = sharding.shard(docs(spark, rows), target_bytes=10_000).rdd.mapPartitionsWithIndex(lambda p, it: [(r["shard"], p) for r in it]).collect()
    assert len(set(parts)) == len({s for s, _ in parts}) == len({p for _, p in parts})


def test_edges(spark):
    df = docs(spark)
    got = sharding.shard(df, target_bytes=1000)
    assert got.columns == [c for c in df.columns if c != "shard"] + ["shard"]
    rows = got.collect()
    assert len(rows) == len(EDGE)
    nulls = [r["shard"] for r in rows if r["source"] is None]
    assert max(nulls) <= min(r["shard"] for r in rows if r["source"] is not None)
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.shard(empty(spark)).count() == 0
    assert {r["shard"] for r in sharding.shard(df, target_bytes=10**9).collect()} == {0}


def _brute(rows, key):
    """Rows of a shard in order of (null first, key); what any range partition must keep."""
    return [r for r in sorted(rows, key=lambda r: (r[key] is not None, r[key] if r[key] is not None else 0))]


@pytest.mark.parametrize("kind, values", [
    ("bigint", [-(2**63), -50, -5, 0, 1, 2, 3, 9, 10, 11, 20, 100, 101, 2**63 - 1]), ("double", [float("-inf"), -1e300, -2.5, -2.25, -1e-9, 0.0, 1e-300, 0.1, 1.0, 9.5, 10.0, 1e300, float("inf")]),
    ("date", ["1905-01-02", "1969-12-31", "1970-01-01", "2024-02-29", "9999-12-31"]), ("timestamp", ["1969-12-31 23:59:59.9", "1970-01-01 00:00:00", "2024-01-01 00:00:00.25", "2024-01-01 00:00:00.3"]),
    ("decimal(20,4)", ["-100.5", "-9.25", "0", "0.0001", "2", "10", "123456789012345.1234", "123456789012345.1235"]), ("string", ["", "\0", "\0\1", "a", "a\0", "a\0b", "a\1", "ab", "b"]),
])
def test_order_of_keys(spark, kind, values):
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "i int, v string").selectExpr("i", f"cast(v as {kind}) as v")
    got = df.select("i", sharding._order_key(df["v"], df["i"], dict(df.dtypes)["v"]).alias("k")).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["k"])] == list(range(len(values)))


def test_number_keys_against_a_sorted_list(spark):
    rows = [(i, "x" * (50 + i % 90), None if i % 97 == 0 else (i * 7919) % 2003 - 1000) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key bigint")
    got = sharding.shard(df, key_col="key", target_bytes=5_000).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    inorder = [r["key"] for s in sorted(by) for r in _brute(by[s], "key")]
    assert inorder == [r[2] for r in _brute(rows, 2)]
    assert all(sum(len(r["text"]) for r in part) <= sharding.SLACK * 5_000 for part in by.values())
