"""Named queries with the SQL that says the same, and the inputs that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW = "TIMESTAMP '1998-10-05 12:00:00'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in a task for every core at least. Narrow tables of many rows are small files, which give few tasks; queries
    that do much for each row would run on as few cores."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def now():
    return F.expr(NOW)


#: Orders as listings and customers as companies, in SQL that both engines read. {o} is the table.
LISTING_COLUMNS = {
    "id": "o_orderkey",
    "company_id": "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END",
    "source_id": "CAST(o_orderkey % 25 AS INT)",
    "title": "CASE o_orderkey % 5 WHEN 0 THEN 'Research Intern Summer 1998' WHEN 1 THEN 'Data Science Intern' WHEN 2 THEN 'Lab Assistant' WHEN 3 THEN 'Financial Analyst' ELSE 'Quality 100% Associate' END",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'open_verified' WHEN 'P' THEN 'open_unverified' ELSE 'expired' END",
    "review_status": "CASE WHEN o_orderkey % 7 = 0 THEN 'needs_review' ELSE 'approved' END",
    "public_safe": "(o_orderkey % 10 <> 3)",
    "deadline": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "deadline_text": "CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 2 = 0 THEN 'Rolling' ELSE NULL END",
    "first_seen_at": "o_orderdate",
    "relevance_score": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS INT) END",
    "paid_status": "CASE o_orderkey % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'stipend' WHEN 2 THEN 'unpaid' ELSE 'unknown' END",
    "location": "CASE o_orderkey % 6 WHEN 0 THEN 'Long Beach, CA' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Boston, MA' WHEN 3 THEN 'Hybrid - Irvine' WHEN 4 THEN NULL ELSE 'Chicago, IL' END",
    "eligibility": "CASE o_orderkey % 9 WHEN 0 THEN 'All majors' WHEN 1 THEN 'PhD only' WHEN 2 THEN 'Juniors and seniors' WHEN 3 THEN 'Graduate students only' ELSE NULL END",
    "focus_area": "CASE o_orderkey % 8 WHEN 0 THEN 'Clinical Research' WHEN 1 THEN 'Quality Control' WHEN 2 THEN 'Regulatory Affairs' ELSE NULL END",
    "posting_url": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'https://jobs.example.com/' || CAST(o_orderkey AS VARCHAR(20)) END",
    "start_date_text": "CASE WHEN o_orderkey % 3 = 0 THEN 'Summer 1998' ELSE NULL END",
}
LISTINGS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in LISTING_COLUMNS.items()) + " FROM orders"


def listings(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Orders as listings; only the columns that are named, so that scans stay narrow."""
    chosen = names or LISTING_COLUMNS
    return table(spark, sf_dir, "orders").select(*[F.expr(LISTING_COLUMNS[n]).alias(n) for n in chosen])
