"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from spindrift import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    theirs = sorted(repr(tuple(plain(r[columns.index(c)]) for c in order)) for r in cursor.fetchall())
    ours = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    assert ours == theirs


def test_every_query_has_a_home():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"duplicate_clusters_fuzzy"}


def test_filters_reach_the_scan(spark, data):
    plan = catalog.queries()["company_directory_open_counts"](spark, data)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan


def test_top_k_is_one_operator(spark, data):
    plan = catalog.queries()["board_sort_relevance_topk"](spark, data)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_entry_runs(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(e.queries())


@pytest.mark.parametrize("name", ["prefill_labels", "score_feed_rules"])
def test_small_files_of_many_rows_get_all_cores(spark, data, name):
    assert catalog.queries()[name](spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_totals_need_no_reasons(spark, data):
    plan = catalog.queries()["score_feed_rules"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "geography" not in plan and "aggregate(" not in plan
