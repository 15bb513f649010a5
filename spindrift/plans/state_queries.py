"""Queries of the write path: observations, versions, merges, tasks, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import merge, state, validate
from spindrift.plans.ingesting import bridge, persist
from spindrift.plans.registry import LISTINGS_SQL, NOW, listings, query, table
from spindrift.plans.resolve_queries import DICE

#: Events as observations in order of arrival: every 7th carries a time two days back, so some are stale.
OBS_COLUMNS = {
    "source": "event_type",
    "identity_key": "'k' || CAST(user_id AS VARCHAR(20))",
    "run_id": "'r' || CAST(event_id % 40 AS VARCHAR(20))",
    "seq": "event_id",
    "observed_at": "CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 2 DAY ELSE ts END",
    "hash": "'h' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR(20))",
    "score": "CAST(event_id % 71 AS INT)",
    "status": "CASE WHEN event_id % 9 = 0 THEN 'closed' ELSE 'open' END",
}
OBS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in OBS_COLUMNS.items()) + " FROM events"


def done_sql(obs: str) -> str:
    """What ``state.outcomes`` says of the observations of a SELECT, as the table ``done``."""
    return f"""
WITH o AS ({obs}),
s AS (SELECT *, coalesce(observed_at < max(observed_at) OVER (PARTITION BY source, identity_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM o),
a AS (SELECT *, lag(hash) OVER w AS old_hash, lag(status) OVER w AS old_status, row_number() OVER w AS rn FROM s WHERE NOT stale WINDOW w AS (PARTITION BY source, identity_key ORDER BY seq)),
f AS (SELECT *, rn = 1 AS created, rn > 1 AND hash IS DISTINCT FROM old_hash AS changed, rn > 1 AND coalesce(old_status IN ('closed', 'missing', 'closure_candidate') AND status IN ('open', 'reopened'), false) AS reopened FROM a),
done AS (
 SELECT source, identity_key, run_id, seq, observed_at, hash, score, status, stale, created, changed, reopened,
  CASE WHEN created AND score >= 35 THEN 'source_new' WHEN created THEN NULL WHEN reopened THEN 'source_reopened' WHEN changed THEN 'source_changed' END AS task,
  CASE WHEN reopened AND status = 'open' THEN 'reopened' ELSE status END AS new_status FROM f
 UNION ALL SELECT source, identity_key, run_id, seq, observed_at, hash, score, status, stale, false, false, false, NULL, status FROM s WHERE stale)
"""


DONE_SQL = done_sql(OBS_SQL)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*[F.expr(e).alias(n) for n, e in OBS_COLUMNS.items()])


def _done(spark, sf_dir):
    return state.outcomes(observations(spark, sf_dir))


@query(DONE_SQL + "SELECT source, identity_key, min_by(observed_at, seq) AS first_seen_at, max(observed_at) AS last_seen_at, max_by(hash, seq) AS hash, max_by(score, seq) AS score, max_by(new_status, seq) AS current_status FROM done WHERE NOT stale GROUP BY source, identity_key")
def observation_latest_state(spark, sf_dir):
    return state.latest_state(_done(spark, sf_dir))


#: Half of the keys were seen before the first event, some of them at a time that makes early events stale.
_SEED = "SELECT source, identity_key, TIMESTAMP '1990-01-01 00:00:00' AS first_seen_at, min(observed_at) + INTERVAL 1 DAY AS last_seen_at, 'h1' AS hash, 'closed' AS status FROM o WHERE CAST(substring(identity_key, 2, 20) AS BIGINT) % 2 = 0 GROUP BY source, identity_key"


@query(f"""WITH o AS ({OBS_SQL}), g AS ({_SEED}), u AS (SELECT source, identity_key, seq, observed_at, hash, score, status, first_seen_at AS f FROM (SELECT *, NULL AS first_seen_at FROM o) UNION ALL SELECT source, identity_key, -1, last_seen_at, hash, NULL, status, first_seen_at FROM g),
s AS (SELECT *, coalesce(observed_at < max(observed_at) OVER (PARTITION BY source, identity_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM u),
a AS (SELECT *, lag(status) OVER (PARTITION BY source, identity_key ORDER BY seq) AS old FROM s WHERE NOT stale)
SELECT source, identity_key, coalesce(max(f), min_by(observed_at, seq) FILTER (WHERE seq >= 0)) AS first_seen_at, max(observed_at) FILTER (WHERE seq >= 0) AS last_seen_at, max_by(hash, seq) AS hash, max_by(score, seq) AS score, max_by(CASE WHEN old IN ('closed', 'missing', 'closure_candidate') AND status = 'open' THEN 'reopened' ELSE status END, seq) AS current_status FROM a GROUP BY source, identity_key HAVING max(seq) >= 0""")
def observation_seeded_state(spark, sf_dir):
    o = observations(spark, sf_dir)
    seen = o.where("cast(substring(identity_key, 2, 20) as bigint) % 2 = 0").groupBy("source", "identity_key").agg((F.min("observed_at") + F.expr("interval 1 day")).alias("last_seen_at"))
    seed = seen.withColumns({"first_seen_at": F.expr("timestamp '1990-01-01 00:00:00'"), "hash": F.lit("h1"), "current_status": F.lit("closed")})
    return state.latest_state(state.outcomes(o, seed))


#: A JSON object for each event, keys in either order, whose fields go on and off.
CONTENT = "CASE WHEN event_id % 2 = 0 THEN '{\"h\":\"' || hash || '\",\"n\":' || n || ',\"o\":{\"a\":1,\"b\":[1,2]}}' ELSE '{\"o\":{\"b\":[1,2],\"a\":1},\"n\":' || n || ',\"h\":\"' || hash || '\"}' END"
_N = "CASE WHEN event_id % 5 = 0 THEN 'null' WHEN event_id % 3 = 0 THEN '\"' || (event_id % 2) || '\"' ELSE CAST(event_id % 2 AS VARCHAR(20)) END"
_SIDE = lambda c: f"coalesce({c}, 'null')"


@query(DONE_SQL + f""", v AS (SELECT source, identity_key, run_id, min(seq) AS seq FROM done WHERE created OR changed GROUP BY source, identity_key, run_id),
x AS (SELECT v.*, d.hash AS h, nullif(({_N}), 'null') AS n FROM v JOIN (SELECT *, seq AS event_id FROM done) d USING (source, identity_key, run_id, seq)),
l AS (SELECT *, lag(h) OVER w AS ph, lag(n) OVER w AS pn, row_number() OVER w AS rn FROM x WINDOW w AS (PARTITION BY source, identity_key ORDER BY seq))
SELECT source, identity_key, run_id, seq, CASE WHEN rn = 1 THEN '{{}}' ELSE '{{' || concat_ws(',', CASE WHEN h <> ph THEN '"h":{{"before":"' || ph || '","after":"' || h || '"}}' END, CASE WHEN n IS DISTINCT FROM pn THEN '"n":{{"before":' || {_SIDE('pn')} || ',"after":' || {_SIDE('n')} || '}}' END) || '}}' END AS field_diff FROM l""")
def version_diffs(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("event_id", F.col("seq"))
    o = o.withColumn("n", F.expr(_N)).withColumn("content", F.expr(CONTENT)).drop("n", "event_id")
    return state.versions(state.outcomes(o)).select("source", "identity_key", "run_id", "seq", "field_diff")


@query(DONE_SQL + "SELECT source, identity_key, seq, observed_at FROM done WHERE stale")
def observation_stale_rejected(spark, sf_dir):
    return _done(spark, sf_dir).where("stale").select("source", "identity_key", "seq", "observed_at")


@query(DONE_SQL + "SELECT source, identity_key, seq, created, changed, reopened, task, new_status FROM done")
def observation_outcomes(spark, sf_dir):
    return _done(spark, sf_dir).select("source", "identity_key", "seq", "created", "changed", "reopened", "task", "new_status")


@query(DONE_SQL + "SELECT source, identity_key, run_id, min(seq) AS seq, min_by(observed_at, seq) AS observed_at, min_by(hash, seq) AS hash, NOT min_by(created, seq) AS is_material_change FROM done WHERE created OR changed GROUP BY source, identity_key, run_id")
def version_history(spark, sf_dir):
    return state.versions(_done(spark, sf_dir))


@query(DONE_SQL + "SELECT source, identity_key, task, hash, min(seq) AS seq FROM done d WHERE task IS NOT NULL AND NOT (source = 'error' AND hash = 'h1') GROUP BY source, identity_key, task, hash")
def review_task_emission(spark, sf_dir):
    done = _done(spark, sf_dir)
    already = done.where("source = 'error' and hash = 'h1' and task is not null").select(*state.KEY, "task", "hash").distinct()
    return state.tasks(done, already)


@query(DONE_SQL + "SELECT run_id, CAST(count(*) AS BIGINT) AS seen, count(*) FILTER (WHERE created) AS new, count(*) FILTER (WHERE changed) AS changed, count(*) FILTER (WHERE NOT created AND NOT changed) AS unchanged, count(*) FILTER (WHERE task IS NOT NULL) AS reviewed, count(*) FILTER (WHERE stale) AS stale FROM done GROUP BY run_id")
def run_counters(spark, sf_dir):
    return state.counters(_done(spark, sf_dir))


NEXT = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 2 = 0"


def _next(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return c.select("c_custkey", F.expr("case when c_custkey % 3 = 0 then upper(c_name) else c_name end").alias("c_name"), F.expr("case when c_custkey % 4 = 0 then null else c_mktsegment end").alias("c_mktsegment"), F.expr("case when c_custkey % 5 = 0 then 0 else c_nationkey end").alias("c_nationkey"))


@query("WITH n AS (" + NEXT + "), j AS (SELECT n.c_custkey, b.c_name bn, n.c_name an, b.c_mktsegment bm, n.c_mktsegment am, CAST(b.c_nationkey AS VARCHAR) bk, CAST(n.c_nationkey AS VARCHAR) ak FROM n JOIN customer b USING (c_custkey)) SELECT c_custkey, 'c_name' AS field, bn AS before, an AS after FROM j WHERE bn IS DISTINCT FROM an UNION ALL SELECT c_custkey, 'c_mktsegment', bm, am FROM j WHERE bm IS DISTINCT FROM am UNION ALL SELECT c_custkey, 'c_nationkey', bk, ak FROM j WHERE bk IS DISTINCT FROM ak")
def version_field_diff(spark, sf_dir):
    before = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return state.field_diff(before, _next(spark, sf_dir), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


#: After: "k" as a number more, as text or as it is; objects with their keys turned, which is no difference; a field that comes, one that goes.
_BEFORE = """'{"k":' || k || ',"o":{"x":1,"y":[2,{"p":1,"q":2}]},"gone":true,"void":null}'"""
_AFTER = """CASE WHEN event_id % 7 = 0 THEN '{"void":0,"o":{"y":[{"p":1,"q":2},2],"x":1},"k":' || k || '}' ELSE '{"o":{"y":[2,{"q":2,"p":1}],"x":1},"k":' || CASE WHEN event_id % 3 = 0 THEN CAST(k + 1 AS VARCHAR(20)) WHEN event_id % 3 = 1 THEN '"' || k || '"' ELSE k || '.0' END || CASE WHEN event_id % 5 = 0 THEN ',"extra":"x"}' ELSE ',"gone":null}' END END"""


@query("""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, 'k' AS field, CAST(k AS VARCHAR) AS before, CAST(CASE WHEN event_id % 3 = 0 THEN k + 1 ELSE k END AS VARCHAR) AS after FROM e WHERE event_id % 7 <> 0 AND event_id % 3 < 2
UNION ALL SELECT event_id, 'gone', 'true', NULL FROM e
UNION ALL SELECT event_id, 'extra', NULL, 'x' FROM e WHERE event_id % 7 <> 0 AND event_id % 5 = 0
UNION ALL SELECT event_id, 'void', NULL, '0' FROM e WHERE event_id % 7 = 0
UNION ALL SELECT event_id, 'o', '{"x":1,"y":[2,{"p":1,"q":2}]}', '{"x":1,"y":[{"p":1,"q":2},2]}' FROM e WHERE event_id % 7 = 0""")
def json_field_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return state.variant_diff(e.select("event_id", F.expr(_BEFORE).alias("b"), F.expr(_AFTER).alias("a")), "event_id", "b", "a")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT DISTINCT c_custkey + 1000000000, 'new' FROM customer WHERE c_custkey % 10 = 0")
def insert_if_absent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    tens = c.where("c_custkey % 10 = 0")
    new = tens.select((F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), F.lit("new").alias("c_name"))
    return merge.insert_if_absent(c, new.unionByName(new).unionByName(tens.withColumn("c_name", F.lit("conflict"))), "c_custkey")


@query("WITH n AS (" + NEXT + ") SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 2 <> 0 UNION ALL SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM n")
def upsert_do_update(spark, sf_dir):
    return merge.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), _next(spark, sf_dir), "c_custkey")


@query(f"SELECT id, CASE WHEN coalesce(review_status = 'approved' AND public_safe, false) THEN 'touch_and_flag' ELSE 'update_fields' END AS policy FROM ({LISTINGS_SQL})")
def update_policy_split(spark, sf_dir):
    return listings(spark, sf_dir, "id", "review_status", "public_safe").select("id", merge.update_policy(F.col("review_status"), F.col("public_safe")).alias("policy"))


@query(f"SELECT id, concat_ws('|', CASE WHEN id % 3 = 0 AND title IS DISTINCT FROM 'New' THEN 'title' END, CASE WHEN id % 4 = 0 AND location IS NOT NULL THEN 'location' END, CASE WHEN id % 5 = 0 AND deadline IS DISTINCT FROM DATE '1999-01-01' THEN 'deadline' END) AS changed FROM ({LISTINGS_SQL})")
def changed_fields(spark, sf_dir):
    o = listings(spark, sf_dir, "id", "title", "location", "deadline")
    pairs = [("title", F.col("title"), F.expr("case when id % 3 = 0 then 'New' else title end")), ("location", F.col("location"), F.expr("case when id % 4 = 0 then null else location end")), ("deadline", F.col("deadline"), F.expr("case when id % 5 = 0 then date '1999-01-01' else deadline end"))]
    return o.select("id", F.array_join(state.changed_names(pairs), "|").alias("changed"))


@query("SELECT DISTINCT unnest(json_keys(p)) AS key FROM (SELECT props AS p FROM events UNION ALL SELECT '{\"a\": 1, \"k\": 2}')")
def json_key_union(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()
    return keys.unionByName(spark.sql("select explode(json_object_keys('{\"a\": 1, \"k\": 2}')) as key")).distinct()


@query("SELECT 'price_positive' AS rule, count(*) FILTER (WHERE NOT (l_extendedprice > 1000)) AS violations FROM lineitem UNION ALL SELECT 'discount_range', count(*) FILTER (WHERE NOT (l_discount BETWEEN 0.01 AND 0.09)) FROM lineitem UNION ALL SELECT 'returned_is_final', count(*) FILTER (WHERE NOT (l_returnflag <> 'R' OR l_linestatus = 'F')) FROM lineitem UNION ALL SELECT 'line_unique', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) UNION ALL SELECT 'order_known', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))")
def validation_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = validate.check(li, {"price_positive": "l_extendedprice > 1000", "discount_range": "l_discount between 0.01 and 0.09", "returned_is_final": "l_returnflag <> 'R' or l_linestatus = 'F'"})
    rows = rows.unionByName(validate.unique(li, "line_unique", "l_orderkey", "l_linenumber"))
    return rows.unionByName(validate.references(li, "order_known", "l_orderkey", table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), "o_orderkey"))


LINKS_SQL = "SELECT o_custkey AS opportunity_id, o_orderkey % 50 AS posting_id, (o_orderkey % 200 = 0) AS is_primary, o_orderkey AS seq FROM orders"


@query(f"WITH l AS (SELECT opportunity_id, posting_id, max(is_primary) AS was, min(seq) AS seq FROM ({LINKS_SQL}) GROUP BY opportunity_id, posting_id) SELECT opportunity_id, posting_id, row_number() OVER (PARTITION BY opportunity_id ORDER BY was DESC, seq, posting_id) = 1 AS is_primary FROM l")
def link_primary_election(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("opportunity_id"), F.expr("o_orderkey % 50").alias("posting_id"), F.expr("o_orderkey % 200 = 0").alias("is_primary"), F.col("o_orderkey").alias("seq"))
    return merge.elect_primary(links)


_TARGET = "CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'open_verified' WHEN o_orderkey % 16 = 4 THEN 'open_unverified' ELSE 'expired' END WHEN 1 THEN 'hidden' END"
_DECIDE = {"id": "o_orderkey", "action": "CASE o_orderkey % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'duplicate' END", "target_status": _TARGET, "duplicate_of": "CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey - 1 END", "notes": "CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE ' seen ' || CAST(o_orderkey AS VARCHAR(20)) || ' ' END", "make_company_public": "o_orderkey % 3 = 1"}
DECISIONS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _DECIDE.items()) + " FROM orders WHERE o_orderkey % 5 = 0"
_YES = "(action = 'approve' AND target_status IN ('open_verified', 'open_unverified'))"


def _decisions(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(*[F.expr(e).alias(n) for n, e in _DECIDE.items()])


@query(f"WITH j AS (SELECT o.id, o.status, o.review_status, o.public_safe, d.action, d.target_status, d.duplicate_of, d.notes FROM ({LISTINGS_SQL}) o LEFT JOIN ({DECISIONS}) d ON o.id = d.id) SELECT id, CASE WHEN {_YES} OR action = 'reject' THEN target_status WHEN action = 'duplicate' AND duplicate_of IS NOT NULL THEN 'duplicate' ELSE status END AS status, CASE WHEN {_YES} THEN 'approved' WHEN action = 'reject' THEN 'rejected' ELSE review_status END AS review_status, CASE WHEN {_YES} THEN true WHEN action = 'reject' OR (action = 'duplicate' AND duplicate_of IS NOT NULL) THEN false ELSE public_safe END AS public_safe, CASE WHEN {_YES} THEN nullif(trim(notes), '') ELSE 'old' END AS review_notes, CASE WHEN {_YES} AND target_status = 'open_verified' THEN {NOW} WHEN {_YES} THEN NULL ELSE TIMESTAMP '1997-01-01 00:00:00' END AS last_checked_at, CASE WHEN action = 'duplicate' THEN duplicate_of END AS duplicate_of FROM j")
def officer_decisions(spark, sf_dir):
    o = listings(spark, sf_dir, "id", "status", "review_status", "public_safe").withColumns({"review_notes": F.lit("old"), "last_checked_at": F.expr("timestamp '1997-01-01 00:00:00'"), "duplicate_of": F.lit(None).cast("bigint")})
    return merge.decide(o, _decisions(spark, sf_dir), F.expr(NOW))


@query(f"SELECT c_custkey AS id, c_custkey % 4 = 0 OR c_custkey IN (SELECT o.company_id FROM ({LISTINGS_SQL}) o JOIN ({DECISIONS}) d ON o.id = d.id WHERE {_YES} AND make_company_public AND o.company_id IS NOT NULL) AS public_safe FROM customer")
def company_publishing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey % 4 = 0").alias("public_safe"))
    return merge.publish_companies(c, listings(spark, sf_dir, "id", "company_id"), _decisions(spark, sf_dir))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN {NOW} ELSE TIMESTAMP '1997-01-01 00:00:00' END AS updated_at FROM customer UNION ALL SELECT c_custkey + 1000000000, c_name, {NOW} FROM customer WHERE c_custkey % 10 = 0")
def update_stamps(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr("timestamp '1997-01-01 00:00:00'").alias("updated_at"))
    new = old.withColumn("c_name", F.expr("case when c_custkey % 3 = 0 then upper(c_name) else c_name end"))
    more = old.where("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000)
    return merge.stamp_updates(old, new.unionByName(more), "c_custkey", F.expr(NOW))


_TK = lambda e: f"lower(replace({e}, '%', ''))"


def _fk(e: str, g: str = ", 'g'", slash: str = "\\") -> str:
    """A title without season and year, in the dialect of either engine."""
    return f"trim(regexp_replace(regexp_replace({_TK(e)}, '{slash}b(fall|winter|spring|summer|20[0-9][0-9]){slash}b', ''{g}), '{slash}s+', ' '{g}))"


_CURATED = {"status": "CASE WHEN id % 19 = 0 THEN 'hidden' WHEN id % 23 = 0 THEN 'closed' ELSE status END", "review_status": "CASE WHEN id % 29 = 0 THEN 'rejected' ELSE review_status END", "employer": "'c' || company_id"}
_KEPT = [f for f in merge.FLAGGED if f not in ("application_type", "source_status_raw")]
_MOVED = {"title": "CASE WHEN id % 20 = 0 THEN title || ' II' ELSE title END", "posting_url": "CASE WHEN id % 30 = 0 THEN NULL ELSE posting_url END"}


@query(f"""WITH e AS (SELECT * REPLACE ({", ".join(f"{x} AS {n}" for n, x in _CURATED.items() if n != "employer")}), 'c' || CAST(company_id AS VARCHAR) AS employer FROM ({LISTINGS_SQL})),
k AS (SELECT *, concat_ws('|', employer, {_TK("title")}, coalesce(posting_url, '')) AS dk, concat_ws('|', employer, {_fk("title")}) AS fk FROM e WHERE status <> 'hidden'),
m AS (SELECT * REPLACE ({", ".join(f"{x} AS {n}" for n, x in _MOVED.items())}), id % 4 = 0 AS news, CAST(id % 71 AS INT) AS points FROM e WHERE id % 10 = 0),
p AS (SELECT *, concat_ws('|', coalesce(employer, 'unknown-company'), {_TK("title")}, coalesce(posting_url, '')) AS dk, concat_ws('|', coalesce(employer, 'unknown-company'), {_fk("title")}) AS fk FROM m),
h AS (SELECT p.id AS p, k.id AS k, 1 AS tier, 1.0 AS s FROM p JOIN k USING (posting_url) UNION ALL SELECT p.id, k.id, 2, 1.0 FROM p JOIN k USING (dk) UNION ALL SELECT p.id, k.id, 3, 1.0 FROM p JOIN k USING (fk)
 UNION ALL SELECT * FROM (SELECT p.id, k.id, 4, {DICE("lower(p.title)", "lower(k.title)")} AS s FROM p JOIN k USING (company_id)) WHERE s >= 0.8),
b AS (SELECT p, k, tier FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY tier, s DESC, k) AS rn FROM h) WHERE rn = 1),
j AS (SELECT p.id, p.points, p.news, p.dk, b.tier, b.k, coalesce(k.review_status IN ('approved', 'rejected'), false) OR k.status IN ('closed', 'expired') AS safe, concat_ws('|', {", ".join(f"CASE WHEN p.{f} IS DISTINCT FROM k.{f} THEN '{f}' END" for f in _KEPT)}) AS changed FROM p LEFT JOIN b ON p.id = b.p LEFT JOIN k ON k.id = b.k)
SELECT 'k' || CAST(id AS VARCHAR) AS identity_key, CASE WHEN tier <= 2 AND safe THEN 'touch' WHEN tier <= 2 THEN 'update' WHEN tier IS NOT NULL THEN 'link' WHEN points >= 35 THEN 'insert' ELSE 'none' END AS action,
 CASE WHEN tier IS NULL AND points >= 35 THEN sha256('opportunity|' || dk) ELSE CAST(k AS VARCHAR) END AS opportunity_id, CASE WHEN tier <= 2 AND safe THEN changed END AS changed,
 CASE WHEN tier <= 2 AND safe AND (changed <> '' OR news) THEN 'source_changed' WHEN tier = 3 THEN 'possible_repost' WHEN tier = 4 THEN 'possible_duplicate' END AS task,
 CASE WHEN tier <= 2 OR (tier IS NULL AND points >= 35) THEN 'exact' WHEN tier = 3 THEN 'annual_family' WHEN tier = 4 THEN 'probable' END AS link_type, coalesce(tier <= 2 OR (tier IS NULL AND points >= 35), false) AS primary FROM j""")
def feed_bridge(spark, sf_dir):
    """Every tenth listing comes back as a posting, some with another title or without a link."""
    o = listings(spark, sf_dir).withColumns({n: F.expr(x) for n, x in _CURATED.items()})
    o = o.withColumns({"dedupe_key": F.concat_ws("|", "employer", F.expr(_TK("title")), F.coalesce("posting_url", F.lit(""))), "family_key": F.concat_ws("|", "employer", F.expr(_fk("title", "", "\\\\"))), "application_type": F.lit(None).cast("string"), "source_status_raw": F.lit("open")})
    p = o.where("id % 10 = 0").withColumns({n: F.expr(x) for n, x in _MOVED.items()})
    p = p.select(F.expr("'k' || id").alias("identity_key"), "employer", F.col("posting_url").alias("canonical_url"), "company_id", *[c for c in merge.FLAGGED if c != "posting_url"], F.expr("id % 4 = 0").alias("material_changed"), F.expr("cast(id % 71 as int)").alias("score"))
    return bridge(p, o).withColumn("changed", F.array_join("changed", "|"))


#: Events as postings of forty runs of four sources. Some runs are over, some may be resumed, some fetches failed.
_FEED = OBS_COLUMNS | {"source": "'s' || CAST(event_id % 4 AS VARCHAR(20))", "identity_key": "'s' || CAST(event_id % 4 AS VARCHAR(20)) || ':k' || CAST(user_id AS VARCHAR(20))"}
_RUN = {"id": "'r' || CAST(n AS VARCHAR(20))", "source": "'s' || CAST(CASE WHEN n = 39 THEN 0 ELSE n % 4 END AS VARCHAR(20))", "status": "CASE WHEN n % 5 = 0 THEN 'completed' WHEN n % 5 = 1 THEN 'failed' WHEN n = 17 THEN 'queued' ELSE 'running' END", "error_class": "CASE WHEN n % 5 = 1 THEN CASE WHEN n % 2 = 0 THEN 'unexpected' ELSE 'timeout' END END", "log": "'{\"persistenceError\":1}'"}
_ADMIT = "n < 38 AND n % 5 <> 0 AND n <> 17 AND (n % 5 <> 1 OR n % 2 = 0)"


@query(done_sql("SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FEED.items()) + f" FROM (SELECT *, event_id % 40 AS n FROM events) WHERE {_ADMIT} AND n % 9 <> 4") + f""", c AS (SELECT run_id, count(*) FILTER (WHERE created) AS new, count(*) FILTER (WHERE changed) AS changed, count(*) FILTER (WHERE NOT created AND NOT changed) AS unchanged, count(*) FILTER (WHERE task IS NOT NULL) AS reviewed, count(*) FILTER (WHERE stale) AS stale FROM done GROUP BY run_id),
r AS (SELECT n, CAST(count(*) AS BIGINT) AS seen FROM (SELECT event_id % 40 AS n FROM events) WHERE {_ADMIT} GROUP BY n)
SELECT 'r' || CAST(n AS VARCHAR) AS run_id, 's' || CAST(n % 4 AS VARCHAR) AS source, CASE WHEN n % 9 = 4 THEN 'failed' WHEN n % 7 = 0 THEN 'partial' ELSE 'completed' END AS status, seen, coalesce(new, 0) AS new, coalesce(changed, 0) AS changed, coalesce(unchanged, 0) AS unchanged, coalesce(reviewed, 0) AS reviewed, coalesce(stale, 0) AS stale FROM r LEFT JOIN c ON c.run_id = 'r' || CAST(n AS VARCHAR)""")
def persist_feed(spark, sf_dir):
    """Final runs of a feed persisted whole: who may write, what it saw, and what came of it."""
    e = table(spark, sf_dir, "events")
    null = F.lit(None).cast("string")
    p = e.select(*[F.expr(x).alias(n) for n, x in _FEED.items()], F.lit("{}").alias("content"), F.expr("'employer ' || (user_id % 50)").alias("employer"), F.expr("'role ' || (user_id % 90)").alias("title"), F.expr("'https://x.example.com/' || user_id").alias("canonical_url"), F.lit(None).cast("date").alias("deadline"), *[null.alias(c) for c in merge.FLAGGED if c not in ("title", "posting_url", "deadline")]).drop("source")
    fetches = e.groupBy(F.expr("event_id % 40").alias("n")).agg(F.count("*").alias("seen")).selectExpr("'r' || n as run_id", "'s' || (n % 4) as source", "n % 9 <> 4 as ok", "seen", "0 as issues", "if(n % 7 = 0, 1, 0) as skipped")
    runs = spark.range(38).unionByName(spark.range(39, 40)).withColumnRenamed("id", "n").select(*[F.expr(x).alias(n) for n, x in _RUN.items()])
    sources = spark.range(4).selectExpr("'s' || id as id", "if(id = 0, 1L, null) as company_id")
    companies = spark.range(1, 30).selectExpr("id", "'employer ' || id as name")
    o = listings(spark, sf_dir).withColumns({"dedupe_key": F.col("title"), "family_key": F.col("title"), "application_type": null, "source_status_raw": null})
    return persist(fetches, p, runs, sources, companies, o).runs


@query("SELECT 'history' AS rule, count(*) AS violations FROM orders WHERE o_orderkey % 50 = 0 OR (o_orderkey % 30 = 0 AND o_orderstatus <> 'X')")
def append_only_check(spark, sf_dir):
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.where("o_orderkey % 50 <> 0").withColumn("o_orderstatus", F.expr("case when o_orderkey % 30 = 0 then 'X' else o_orderstatus end"))
    return validate.append_only(before, after, "history", "o_orderkey")


@query("SELECT DISTINCT 'n' || CAST(o_custkey AS VARCHAR) AS dedupe_key, 'needs_review' AS status, 'pending' AS review_status, false AS public_safe FROM orders WHERE o_custkey % 3 <> 0")
def create_pending_opportunity(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    have = o.where("o_custkey % 3 = 0").select(F.expr("'n' || o_custkey").alias("dedupe_key"))
    new = o.select(F.expr("'n' || o_custkey").alias("dedupe_key"), F.lit("open_verified").alias("status"), F.lit("approved").alias("review_status"), F.lit(True).alias("public_safe"))
    return merge.create_pending(have, new)


@query("SELECT c_custkey AS draft_id, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'error' ELSE 'insert' END AS action, CASE c_custkey % 5 WHEN 2 THEN 'possible_repost' WHEN 3 THEN 'possible_duplicate' END AS task, CASE WHEN c_custkey % 5 IN (0, 1) THEN c_custkey + 7 END AS existing_id FROM customer")
def quick_add_outcomes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return merge.quick_add(c.select(F.col("c_custkey").alias("draft_id"), F.expr("element_at(array('same_url', 'strict_key', 'family', 'fuzzy', 'none'), cast(c_custkey % 5 + 1 as int))").alias("kind"), (F.col("c_custkey") + 7).alias("opportunity_id")))
