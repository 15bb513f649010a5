from spindrift.llm import linededup
from tests.llm.frames import docs, empty


def brute(rows):
    """Keep flags by (id, text) in order of id, by a plain walk."""
    seen, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        for p, line in enumerate(t.split("\n")):
            x = line.strip(" ")
            out.setdefault(i, []).append(x == "" or seen.setdefault(x, (i, p)) == (i, p))
    return out


def test_bitmaps_against_a_walk(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r for r in linededup.keep_bitmaps(df).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert {k: linededup.decode_runs(r["keep_runs"]).tolist() for k, r in got.items()} == want
    assert all(r["n_kept"] == sum(want[k]) and r["n_lines"] == len(want[k]) for k, r in got.items())


def test_edges(spark):
    got = {r["doc_id"]: r["keep_runs"] for r in linededup.keep_bitmaps(docs(spark)).collect()}
    assert got == {1: "2", 2: "0,2", 4: "1", 5: "2", 6: "1", 7: "1", 8: "1"}
    assert linededup.keep_bitmaps(empty(spark)).count() == 0


def test_applied(spark):
    df = docs(spark)
    out = linededup.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 0, 1, 1, 3, 4, 5, 6, 7, 8]
    rows = [(1, "a long passage\nown one", "en", "s", 22), (2, "own two\n a long passage \n\nlast", "en", "s", 30), (3, "x\nx\ny", "en", "s", 5), (4, "y", "en", "s", 1)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in linededup.drop_repeated_lines(docs(spark, rows)).collect()}
    assert got == {1: ("a long passage\nown one", 22), 2: ("own two\n\nlast", 13), 3: ("x\ny", 3)}
    assert linededup.drop_repeated_lines(empty(spark)).count() == 0


def test_runs_round_trip():
    for runs, flags in (("2", [1, 1]), ("0,1,2", [0, 1, 1]), ("1,1,1", [1, 0, 1])):
        assert linededup.decode_runs(runs).astype(int).tolist() == flags


def test_a_line_that_is_everywhere(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "concat('hot line\nown ', id) as text").repartition(7)
    got = {r["doc_id"]: r["keep_runs"] for r in linededup.keep_bitmaps(df).collect()}
    assert got.pop(0) == "2" and set(got.values()) == {"0,1,1"} and len(got) == 1999


def test_runs_of_lines_before_the_shuffle(monkeypatch):
    """Firsts of any run lengths, then the walk over them all, leave what one walk over all lines leaves."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = [(int(i), p, int(h)) for i in rng.permutation(60) for p, h in enumerate(rng.integers(0, 25, rng.integers(1, 9)))]
    rows += [r for r in rows if r[0] < 5]  # repeated rows
    last = {i: max(p for j, p, _ in rows if j == i) + 1 for i, _, _ in rows}
    seen = {}
    for i, p, h in sorted(set(rows)):
        seen.setdefault(h, (i, p))
    for size in (1, 7, 50, 1000):
        monkeypatch.setattr(linededup, "LOCAL_LINES", size)
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int32()), pa.array([last[r[0]] for r in part], pa.int32()), *[pa.array([r[2] or None for r in part], pa.int64()) for _ in (1, 2)]], ["id", "pos", "n", "h1", "h2"]) for part in (rows[k : k + 5] for k in range(0, len(rows), 5))]
        got = [r for b in linededup._local(batches) for r in b.to_pylist()]
        firsts = sorted((r["h1"], r["h2"], r["id"], r["pos"]) for r in got if r["kind"] == 0)
        drops = {(r["id"], r["pos"]) for r in got if r["kind"] == 1}
        if firsts:
            ordered = pa.RecordBatch.from_arrays([pa.array([r[k] for r in firsts]) for k in range(4)], ["h1", "h2", "id", "pos"])
            drops |= {(r["id"], r["pos"]) for b in linededup._stream([ordered]) for r in b.to_pylist()}
        assert drops == {(i, p) for i, p, h in rows if h and seen[h] != (i, p)}
        assert {r["id"]: r["pos"] for r in got if r["kind"] == 2} == last
