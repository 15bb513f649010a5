"""Read-path queries: views, search, sorts, buckets, counts, queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.score import personal_bonus
from spindrift.operators import views
from spindrift.plans.registry import LISTINGS_SQL, NOW, listings, now, query, table
from spindrift.sources.sinks import export_json, submissions

VISIBLE_SQL = "public_safe AND review_status = 'approved' AND status IN ('open_verified', 'open_unverified')"


@query("SELECT c_custkey, c_name, c_mktsegment, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS BIGINT) AS open_count FROM customer")
def company_directory_open_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the number of its open orders, 0 where there is none."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = customer.join(orders, customer.c_custkey == orders.o_custkey, "left")
    return joined.select("c_custkey", "c_name", "c_mktsegment", F.coalesce("n", F.lit(0)).cast("bigint").alias("open_count"))


def _companies(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.expr("c_custkey % 4 <> 0").alias("public_safe"))


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.expr("n_nationkey % 3 <> 0").alias("public_safe"))


BOARD_SQL = f"SELECT o.id, o.title, o.status, o.deadline, o.first_seen_at, o.relevance_score, o.paid_status, c.c_name AS company_name, n.n_name AS source_name FROM ({LISTINGS_SQL}) o JOIN customer c ON o.company_id = c.c_custkey LEFT JOIN nation n ON o.source_id = n.n_nationkey AND n.n_nationkey % 3 <> 0 WHERE {VISIBLE_SQL}"
_BOARD = ("id", "company_id", "source_id", "title", "status", "review_status", "public_safe", "deadline", "first_seen_at", "relevance_score", "paid_status")


def _board(spark, sf_dir):
    return views.public_opportunities(listings(spark, sf_dir, *_BOARD), _companies(spark, sf_dir), _sources(spark, sf_dir)).drop("company_id")


@query(BOARD_SQL)
def public_board_view(spark, sf_dir):
    return _board(spark, sf_dir)


@query(f"SELECT c.c_custkey AS id, c.c_name AS name, true AS public_safe, CAST((SELECT count(*) FROM ({LISTINGS_SQL}) o WHERE o.company_id = c.c_custkey AND {VISIBLE_SQL}) AS BIGINT) AS open_count FROM customer c WHERE c.c_custkey % 4 <> 0")
def public_companies_view(spark, sf_dir):
    return views.public_companies(_companies(spark, sf_dir), listings(spark, sf_dir, "company_id", "status", "review_status", "public_safe"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS balance FROM customer WHERE c_custkey % 2 = 0")
def masked_contacts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return c.select("c_custkey", "c_name", views.mask(F.expr("c_custkey % 3 = 0"), F.col("c_mktsegment")).alias("segment"), views.mask(F.expr("c_custkey % 5 = 0"), F.col("c_acctbal")).alias("balance"))


@query("SELECT e.event_id, e.event_type, CASE WHEN c.c_custkey % 3 <> 0 THEN c.c_name END AS speaker FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def event_with_optional_speaker(spark, sf_dir):
    e, c = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return e.join(c, e.user_id == c.c_custkey, "left").select("event_id", "event_type", views.mask(F.expr("c_custkey % 3 <> 0"), F.col("c_name")).alias("speaker"))


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'red')")
def array_membership_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.array_contains(F.split("p_name", " "), "red")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, supplier_id FROM (SELECT p_partkey, p_name, p_size, CAST(p_partkey % 100 AS BIGINT) AS supplier_id FROM part) JOIN supplier ON supplier_id = s_suppkey AND s_acctbal > 0 WHERE p_size > 10")
def inner_pair_view(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name", F.expr("p_partkey % 100").cast("bigint").alias("supplier_id"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return p.join(s, F.col("supplier_id") == F.col("s_suppkey")).drop("s_suppkey")


@query(f"SELECT id, title, company_name FROM ({BOARD_SQL}) WHERE title ILIKE '%science%' OR company_name ILIKE '%science%'")
def board_search_ilike(spark, sf_dir):
    return views.search(_board(spark, sf_dir), " scien_ce%".replace("_", ""), "title", "company_name").select("id", "title", "company_name")


def _sorted(sort, order):
    @query(f"SELECT id, title, company_name, relevance_score FROM ({BOARD_SQL}) ORDER BY {order}, id LIMIT 200")
    def run(spark, sf_dir):
        return views.board(_board(spark, sf_dir), sort=sort).select("id", "title", "company_name", "relevance_score")

    return run


def _register_sorts():
    from spindrift.plans.registry import QUERIES, SQL

    for name, order in (("deadline", "deadline ASC NULLS LAST"), ("newest", "first_seen_at DESC NULLS LAST"), ("company", "company_name ASC NULLS LAST"), ("relevance", "relevance_score DESC NULLS LAST")):
        f = _sorted(name, order)
        QUERIES[f"board_sort_{name}_topk"], SQL[f"board_sort_{name}_topk"] = QUERIES.pop("run"), SQL.pop("run")
        f.__name__ = f"board_sort_{name}_topk"


_register_sorts()
DAYS_SQL = f"CAST(floor((epoch_ms(CAST(deadline AS TIMESTAMP)) - epoch_ms({NOW})) / 86400000.0) AS INT)"


@query(f"SELECT id, CASE WHEN {DAYS_SQL} BETWEEN 0 AND 14 THEN 'closing' WHEN epoch_ms({NOW}) - epoch_ms(first_seen_at) < 604800000 THEN 'fresh' ELSE 'rest' END AS bucket FROM ({LISTINGS_SQL})")
def board_buckets(spark, sf_dir):
    return listings(spark, sf_dir, "id", "deadline", "first_seen_at").select("id", views.bucket(F.col("deadline"), F.col("first_seen_at"), now()).alias("bucket"))


BONUS_SQL = """
 (CASE WHEN focus_area IN ('Clinical Research') THEN 15 ELSE 0 END + CASE WHEN paid_status IN ('paid', 'stipend') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(coalesce(location, ''), '(?i)remote|hybrid') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(coalesce(location, ''), '(?i)long beach|los angeles|orange|irvine|torrance|carson|carlsbad') THEN 10 ELSE 0 END
 + CASE WHEN contains(lower(coalesce(eligibility, '')), 'junior') THEN 10 WHEN regexp_matches(lower(coalesce(eligibility, '')), 'all students|all majors|undergrad') THEN 5 ELSE 0 END
 + CASE WHEN contains(lower(concat_ws(' ', start_date_text, title)), 'summer') THEN 8 ELSE 0 END)
"""


@query(f"SELECT id, CAST({BONUS_SQL} AS INT) AS bonus, CAST(coalesce(relevance_score, 0) + {BONUS_SQL} AS INT) AS total FROM ({LISTINGS_SQL}) ORDER BY total DESC, id LIMIT 200")
def personal_bonus_rank(spark, sf_dir):
    o = listings(spark, sf_dir, "id", "focus_area", "paid_status", "location", "eligibility", "start_date_text", "title", "relevance_score")
    b = personal_bonus(*[F.col(c) for c in ("focus_area", "paid_status", "location", "eligibility", "start_date_text", "title")], areas=("Clinical Research",), want_paid=True, want_remote=True, near=True, standing="junior", term="summer")
    return o.select("id", b["points"].alias("bonus"), (F.coalesce("relevance_score", F.lit(0)) + b["points"]).alias("total")).orderBy(F.desc("total"), "id").limit(200)


@query(f"SELECT id, title, relevance_score, name FROM (SELECT o.id, o.title, o.relevance_score, c.c_name AS name FROM ({LISTINGS_SQL}) o LEFT JOIN customer c ON o.company_id = c.c_custkey WHERE review_status = 'needs_review') ORDER BY relevance_score DESC NULLS LAST, id LIMIT 100")
def review_queue_topk(spark, sf_dir):
    o = listings(spark, sf_dir, "id", "title", "relevance_score", "review_status", "company_id").where("review_status = 'needs_review'")
    top = o.orderBy(F.desc_nulls_last("relevance_score"), "id").limit(100)  # the join adds columns only, so it comes after
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return top.join(c, top.company_id == c.c_custkey, "left").select("id", "title", "relevance_score", "name")


@query(f"SELECT CAST(count(*) FILTER (WHERE review_status = 'needs_review') AS BIGINT) AS needs_review, CAST(count(*) FILTER (WHERE status IN ('open_verified', 'open_unverified') AND deadline BETWEEN CAST({NOW} AS DATE) AND CAST({NOW} AS DATE) + 14) AS BIGINT) AS closing_soon, (SELECT CAST(count(*) AS BIGINT) FROM events WHERE event_type = 'signup') AS new_submissions, CAST(count(*) FILTER (WHERE {VISIBLE_SQL}) AS BIGINT) AS visible FROM ({LISTINGS_SQL})")
def dashboard_counts(spark, sf_dir):
    o = listings(spark, sf_dir, "review_status", "status", "deadline", "public_safe")
    today = F.to_date(now())
    n = o.agg(F.count_if(F.col("review_status") == "needs_review").alias("needs_review"), F.count_if(F.col("status").isin("open_verified", "open_unverified") & F.col("deadline").between(today, F.date_add(today, 14))).alias("closing_soon"), F.count_if(views.visible(F.col("public_safe"), F.col("review_status"), F.col("status"))).alias("visible"))
    return n.crossJoin(table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "signup").alias("new_submissions")))


@query(f"SELECT id, relevance_score, CAST(row_number() OVER (ORDER BY relevance_score DESC NULLS FIRST, id) AS BIGINT) AS place FROM ({LISTINGS_SQL}) WHERE status = 'open_verified' ORDER BY place LIMIT 500")
def export_ordered(spark, sf_dir):
    o = listings(spark, sf_dir, "id", "relevance_score", "status").where("status = 'open_verified'").drop("status")
    top = o.orderBy(F.desc_nulls_first("relevance_score"), "id").limit(500)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_first("relevance_score"), "id")).cast("bigint"))


@query("SELECT CAST(5 AS BIGINT) AS records, (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) AS names")
def export_json_document(spark, sf_dir):
    doc = export_json(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.lit("1998-10-05"))
    records = F.from_json(F.get_json_object("json", "$.records"), "array<struct<r_regionkey:int,r_name:string>>")
    return doc.select(F.size(records).cast("bigint").alias("records"), F.array_join(F.array_sort(F.transform(records, lambda r: r["r_name"])), ",").alias("names"))


@query("SELECT '{\"link\":\"' || url || '\",\"note\":\"n' || CAST(page_id AS VARCHAR) || '\"}' AS payload, 'new' AS status FROM pages WHERE page_id % 4 <> 0 AND (starts_with(url, 'http://') OR starts_with(url, 'https://'))")
def public_submissions(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("link"), F.expr("'n' || page_id").alias("note"), F.expr("case when page_id % 4 = 0 then 'bot' end").alias("trap"))
    return submissions(p)


QUEUE_SQL = "SELECT o_orderkey AS id, CAST(o_orderkey % 100 AS BIGINT) AS job_source_id, CASE o_orderstatus WHEN 'O' THEN 'queued' ELSE 'completed' END AS status, o_orderdate AS scheduled_for, o_orderdate - INTERVAL 1 DAY AS created_at FROM orders"


@query(f"SELECT id, job_source_id, 'running' AS status, scheduled_for FROM (SELECT r.*, s.s_nationkey AS p FROM ({QUEUE_SQL}) r JOIN supplier s ON r.job_source_id = s.s_suppkey AND s.s_acctbal > 0 WHERE r.status = 'queued' AND r.scheduled_for <= {NOW}) ORDER BY p, scheduled_for, created_at, id LIMIT 50")
def queue_claim_topk(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey % 100").alias("job_source_id"), F.expr("case o_orderstatus when 'O' then 'queued' else 'completed' end").alias("status"), F.col("o_orderdate").alias("scheduled_for"), F.expr("o_orderdate - interval 1 day").alias("created_at"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("priority"), F.expr("s_acctbal > 0").alias("enabled"))
    return views.claim(runs, sources, now(), 50).select("id", "job_source_id", "status", "scheduled_for")


@query("SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation, region WHERE n_name = 'NATION_3' AND r_regionkey = 2")
def cross_lookup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation").where("n_name = 'NATION_3'"), table(spark, sf_dir, "region").where("r_regionkey = 2")
    return n.crossJoin(r).select("n_nationkey", "n_name", "r_regionkey", "r_name")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 500 OFFSET 500")
def paged_scan(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(500).limit(500)


@query(f"SELECT id, paid_status, status FROM ({LISTINGS_SQL}) WHERE status <> 'expired' AND NOT (paid_status IN ('unpaid', 'unknown')) AND deadline >= DATE '1998-01-01' AND deadline <= DATE '1998-12-31'")
def parameter_filters(spark, sf_dir):
    o = listings(spark, sf_dir, "id", "paid_status", "status", "deadline")
    return o.where((F.col("status") != "expired") & ~F.col("paid_status").isin("unpaid", "unknown") & (F.col("deadline") >= F.lit("1998-01-01").cast("date")) & (F.col("deadline") <= F.lit("1998-12-31").cast("date"))).drop("deadline")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def exists_semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def embedded_rows(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda r: r["role"]), ">").alias("roles"))


@query("SELECT o_orderkey, c_name AS company, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0 WHERE o_orderkey % 10 = 0")
def embedded_company(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select("o_orderkey", "o_custkey")
    e = views.embed(o, c, "o_custkey", "companies", "c_name", "c_mktsegment")
    return e.select("o_orderkey", F.col("companies.c_name").alias("company"), F.col("companies.c_mktsegment").alias("segment"))


@query("SELECT e.event_type, (SELECT count(*) FROM events) AS total, count(*) AS n FROM events e GROUP BY e.event_type")
def count_only_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type")
    return e.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(e.agg(F.count("*").alias("total")))
