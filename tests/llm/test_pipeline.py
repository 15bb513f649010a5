import numpy as np

import corpus_pipeline
from spindrift.llm import linededup, packing, simhash
from tests.llm.frames import CLASHES, docs
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute as brute_prints


def test_stages_on_their_own_input(spark, data):
    """Each stage over all that its predecessor kept, against brute-force versions of what it does."""
    rows = source = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in rows.collect()}
        rows = stage(spark, rows, data)
        after = {r["doc_id"]: r for r in rows.collect()}
        assert rows.columns == source.columns and after.keys() <= before.keys()
        if name == "line dedup":
            flags = brute_lines([(i, r["text"]) for i, r in before.items()])
            want = {}
            for i, r in before.items():
                kept = [x for x, k in zip(r["text"].split("\n"), flags[i]) if k]
                if all(flags[i]) or any(x.strip(" ") for x in kept):
                    want[i] = "\n".join(kept)
            assert {i: r["text"] for i, r in after.items()} == want
        elif name == "simhash near-dedup":
            prints = {i: simhash.fingerprint(r["text"]) for i, r in before.items()}
            gone = brute_prints({i: p for i, p in prints.items() if p}, simhash.RADIUS)
            assert after.keys() == before.keys() - gone.keys()
        else:
            assert all(after[i] == before[i] for i in after)
    rows = corpus_pipeline.STAGES[-1][1](spark, rows, data).collect()
    check(rows, packing.TOKENS, packing.DOCUMENTS, packing.COST)
    assert {r["doc_id"] for r in rows} == {i for i, r in after.items() if r["text"]}


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and set(rows[0].asDict()) == {"bin_id", "doc_id", "piece", "start", "tokens", "place"}
    check(rows, packing.TOKENS, packing.DOCUMENTS, packing.COST)
    assert corpus_pipeline.ORACLE_SQL is None
    assert np.all([r["tokens"] > 0 for r in rows])


def test_edges(spark, tmp_path):
    """Nulls, blanks, long texts, repeated rows and clashing names; without labels every document is judged by what the other stages do."""
    clashing = lambda df: df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHES if c != "TEXT"])  # noqa: E731  (no file holds text and TEXT)
    clashing(docs(spark, clash=False)).write.parquet(str(tmp_path / "documents.parquet"))
    for rows in ([], [(i, i % 2, (i + 1) % 2) for i in range(1, 9)]):
        spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        check(got, packing.TOKENS, packing.DOCUMENTS, packing.COST)
        assert rows or ({r["doc_id"] for r in got} == {1, 5, 6, 7, 8} and sum(r["doc_id"] == 1 for r in got) == 2)
    clashing(docs(spark, [], clash=False)).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert "pipeline" in q and "pipeline" not in s
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in q) == 1
    assert s["op8_linededup"] == linededup.ORACLE_BITMAPS
