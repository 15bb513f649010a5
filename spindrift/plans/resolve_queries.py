"""Queries of entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions.similarity import dice
from spindrift.functions.text import clean_text
from spindrift.operators import resolve
from spindrift.plans.registry import query, table

#: Dice similarity of two texts in DuckDB: bigrams as lists, counted with repeats.
GRAMS = lambda e: f"list_transform(range(1, CAST(length({e}) AS BIGINT)), lambda i: substring({e}, i, 2))"
DICE = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * list_sum(list_transform(list_intersect({GRAMS(a)}, {GRAMS(b)}), lambda g: least(len(list_filter({GRAMS(a)}, lambda z: z = g)), len(list_filter({GRAMS(b)}, lambda z: z = g))))) / (length({a}) + length({b}) - 2) END"
_ZERO = lambda a, b: f"coalesce({DICE(a, b)}, 0.0)"


@query(f"WITH n AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT a.p_brand, a.p_name AS a, b.p_name AS b, round({_ZERO('a.p_name', 'b.p_name')}, 6) AS score FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name")
def dice_pairs_within_brand(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    a, b = n.select("p_brand", F.col("p_name").alias("a")), n.select("p_brand", F.col("p_name").alias("b"))
    return a.join(b, "p_brand").where("a < b").withColumn("score", F.round(dice(F.col("a"), F.col("b")), 6))


_NAMES = "SELECT CAST(p_partkey AS BIGINT) AS draft_id, CASE p_partkey % 3 WHEN 0 THEN p_name || ' laboratories' WHEN 1 THEN p_name || ' laboratory' ELSE p_name END AS name FROM part"
_KNOWN = "SELECT DISTINCT min(p_partkey) AS id, p_name || ' laboratories' AS name FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name"


@query(f"WITH d AS ({_NAMES}), c AS ({_KNOWN}), s AS (SELECT a.name AS l, b.name AS r, {_ZERO('a.name', 'b.name')} AS score FROM (SELECT DISTINCT name FROM d WHERE length(name) >= 2) a, (SELECT DISTINCT name FROM c) b), h AS (SELECT draft_id, id, d.name = c.name AS exact, score FROM d JOIN s ON d.name = s.l JOIN c ON c.name = s.r), r AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY exact DESC, score DESC, id) AS rn FROM h WHERE score >= 0.85) SELECT d.draft_id, CASE WHEN exact THEN 'exact' WHEN score IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS kind, id AS company_id, CASE WHEN NOT exact THEN round(score, 6) END AS score FROM d LEFT JOIN r ON d.draft_id = r.draft_id AND rn = 1")
def company_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = p.select(F.col("p_partkey").alias("draft_id"), F.expr("case p_partkey % 3 when 0 then p_name || ' laboratories' when 1 then p_name || ' laboratory' else p_name end").alias("name"))
    c = p.where("p_partkey % 2 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.concat("p_name", F.lit(" laboratories")).alias("name"))
    return resolve.match_company(d, c).withColumn("score", F.round("score", 6))


_E = {"id": "p_partkey", "posting_url": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'u' || CAST(p_partkey % 700 AS VARCHAR(20)) END", "dedupe_key": "p_brand || '|' || p_name || '|' || CAST(p_size AS VARCHAR(20))", "family_key": "p_brand || '|' || p_name", "title": "p_name || ' Specialist'", "company_id": "p_brand"}
_DRAFT = {"draft_id": "p_partkey", "posting_url": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'u' || CAST(p_partkey % 900 + 500 AS VARCHAR(20)) END", "dedupe_key": "p_brand || '|' || p_name || '|' || CAST(p_size % 9 AS VARCHAR(20))", "family_key": "p_brand || '|' || CASE WHEN p_partkey % 4 = 0 THEN 'other ' ELSE '' END || p_name", "title": "CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'senior ' || p_name END || ' specialist'", "company_id": "p_brand"}
_COLS = lambda d: ", ".join(f"{e} AS {n}" for n, e in d.items())


@query(f"""WITH e AS (SELECT {_COLS(_E)} FROM part WHERE p_partkey % 2 = 0), d AS (SELECT {_COLS(_DRAFT)} FROM part WHERE p_partkey % 20 = 1 OR p_partkey % 20 = 4),
h AS (SELECT draft_id, id, 1 AS tier, 1.0 AS score FROM d JOIN e USING (posting_url) UNION ALL SELECT draft_id, id, 2, 1.0 FROM d JOIN e USING (dedupe_key) UNION ALL SELECT draft_id, id, 3, 1.0 FROM d JOIN e USING (family_key)
 UNION ALL SELECT draft_id, id, 4, s FROM (SELECT draft_id, e.id, {_ZERO('lower(d.title)', 'lower(e.title)')} AS s FROM d JOIN e USING (company_id)) WHERE s >= 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY tier, score DESC, id) AS rn FROM h)
SELECT d.draft_id, CASE tier WHEN 1 THEN 'same_url' WHEN 2 THEN 'strict_key' WHEN 3 THEN 'family' WHEN 4 THEN 'fuzzy' ELSE 'none' END AS kind, id AS opportunity_id, CASE WHEN tier = 4 THEN round(score, 6) END AS score FROM d LEFT JOIN r ON d.draft_id = r.draft_id AND rn = 1""")
def opportunity_match_cascade(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = p.where("p_partkey % 2 = 0").select(*[F.expr(x).alias(n) for n, x in _E.items()])
    d = p.where("p_partkey % 20 = 1 or p_partkey % 20 = 4").select(*[F.expr(x).alias(n) for n, x in _DRAFT.items()])
    return resolve.match_opportunity(d, e).withColumn("score", F.round("score", 6))


_POST = {"identity_key": "'k' || lpad(CAST(p_partkey AS VARCHAR(20)), 8, '0')", "canonical_url": "'u' || CAST(p_partkey % 611 AS VARCHAR(20))", "employer": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE lower(p_brand) || ' biosciences' END", "title": "p_name || CASE p_partkey % 4 WHEN 0 THEN ' intern summer 2026' WHEN 1 THEN ' intern fall 2025' ELSE ' intern' END", "location": "CASE p_partkey % 3 WHEN 0 THEN 'irvine' WHEN 1 THEN 'boston' END", "material_hash": "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 3 THEN 'h2' ELSE 'h1' END"}
_CAND = dict(_POST, identity_key="'k' || lpad(CAST(p_partkey - p_partkey % 3 AS VARCHAR(20)), 8, '0') || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'x' END || CAST(p_partkey % 4 AS VARCHAR(20)) || CAST(p_partkey AS VARCHAR(20))", canonical_url="'u' || CAST(p_partkey AS VARCHAR(20))")
_CAND["identity_key"] = "CASE WHEN p_partkey % 5 = 0 THEN 'k' || lpad(CAST(p_partkey - 1 AS VARCHAR(20)), 8, '0') ELSE 'n' || CAST(p_partkey AS VARCHAR(20)) END"
_FAM = lambda e: f"nullif(trim(regexp_replace(regexp_replace({e}, '\\b(20\\d{{2}}|19\\d{{2}}|spring|summer|fall|autumn|winter)\\b', '', 'g'), '\\s+', ' ', 'g')), '')"


_APART = "concat_ws('|', " + ", ".join(f"CASE WHEN lower(trim(coalesce(c.{x}, ''))) <> lower(trim(coalesce(p.{x}, ''))) THEN '{n}' END" for x, n in (("employer", "employerNameNormalized"), ("title", "titleNormalized"), ("location", "locationNormalized"))) + ")"


@query(f"""WITH p AS (SELECT {_COLS(_POST)} FROM part WHERE p_partkey % 2 = 0), c AS (SELECT {_COLS(_CAND)} FROM part WHERE p_partkey % 40 IN (0, 3, 5, 11, 13)),
e AS (SELECT a.employer AS ce, b.employer AS pe, {_ZERO('a.employer', 'b.employer')} AS es FROM (SELECT DISTINCT employer FROM c WHERE employer IS NOT NULL) a, (SELECT DISTINCT employer FROM p WHERE employer IS NOT NULL) b),
t AS (SELECT a.title AS ct, b.title AS pt, {_ZERO('a.title', 'b.title')} AS ts, {_ZERO(_FAM('a.title'), _FAM('b.title'))} AS fs FROM (SELECT DISTINCT title FROM c) a, (SELECT DISTINCT title FROM p) b),
x AS (SELECT c.identity_key AS ck, p.identity_key AS pk, t.ct, t.pt, c.location AS cl, p.location AS pl, es, ts, fs FROM c JOIN e ON c.employer = ce JOIN p ON p.employer = pe JOIN t ON c.title = t.ct AND p.title = t.pt WHERE es >= 0.85),
h AS (SELECT c.identity_key AS ck, p.identity_key AS pk, 1 AS tier, CAST(1.0 AS DOUBLE) AS conf FROM c JOIN p ON c.identity_key = p.identity_key
 UNION ALL SELECT c.identity_key, p.identity_key, 2, 0.95 FROM c JOIN p ON c.canonical_url = p.canonical_url
 UNION ALL SELECT ck, pk, 3, least(0.9, (es + ts) / 2 + 0.05) FROM x WHERE cl IS NOT DISTINCT FROM pl AND ts >= 0.85
 UNION ALL SELECT ck, pk, 4, 0.6 FROM x WHERE ct <> pt AND ({_FAM('ct')} <> ct OR {_FAM('pt')} <> pt) AND coalesce(cl = pl, true) AND fs >= 0.85),
r AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY tier, conf DESC, pk) AS rn FROM h)
SELECT c.identity_key, CASE WHEN tier IS NULL AND c.employer IS NULL THEN 'insufficient_information' WHEN tier = 1 THEN 'exact_identity' WHEN tier = 2 THEN 'exact_url' WHEN tier = 3 THEN 'probable_same_posting' WHEN tier = 4 THEN 'possible_annual_family' ELSE 'likely_distinct' END AS match_type,
 round(CASE WHEN tier IS NULL AND c.employer IS NULL THEN 0.0 ELSE coalesce(conf, 0.9) END, 6) AS confidence, pk AS matched_key,
 CASE tier WHEN 1 THEN 'identityKey' WHEN 2 THEN 'canonicalUrl' WHEN 3 THEN 'employerNameNormalized|titleNormalized' || CASE WHEN c.location IS NOT NULL THEN '|locationNormalized' ELSE '' END WHEN 4 THEN 'employerNameNormalized|titleNormalized (family)' ELSE '' END AS contributing,
 CASE WHEN tier <= 2 THEN concat_ws('|', nullif({_APART}, ''), CASE WHEN c.material_hash <> p.material_hash THEN 'materialHash' END) WHEN tier = 3 THEN {_APART} WHEN tier = 4 THEN 'titleNormalized' ELSE '' END AS conflicting,
 CASE WHEN tier = 1 THEN coalesce(c.material_hash <> p.material_hash, false) OR (c.material_hash IS NULL AND {_APART} <> '') ELSE coalesce(tier > 1, false) END AS review
FROM c LEFT JOIN r ON c.identity_key = r.ck AND rn = 1 LEFT JOIN p ON p.identity_key = r.pk""")
def assess_duplicate(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    p = t.where("p_partkey % 2 = 0").select(*[F.expr(x).alias(n) for n, x in _POST.items()])
    c = t.where("p_partkey % 40 in (0, 3, 5, 11, 13)").select(*[F.expr(x).alias(n) for n, x in _CAND.items()])
    return resolve.assess_duplicates(c, p).withColumns({"confidence": F.round("confidence", 6), "contributing": F.array_join("contributing", "|"), "conflicting": F.array_join("conflicting", "|")})


_ROWS = {"id": "p_partkey", "url": "CASE WHEN p_partkey % 4 = 0 THEN 'u' || CAST(p_partkey % 300 AS VARCHAR(20)) END", "dedupe_key": "p_name || '|' || p_brand || '|' || CAST(p_size AS VARCHAR(20))", "family_key": "p_name || '|' || p_brand"}


@query(f"""WITH a AS (SELECT {_COLS(_ROWS)} FROM part), u AS (SELECT url AS key, id FROM a WHERE url IN (SELECT url FROM a WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1)),
b AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM u)), s AS (SELECT dedupe_key AS key, id FROM b WHERE dedupe_key IN (SELECT dedupe_key FROM b GROUP BY dedupe_key HAVING count(*) > 1)),
c AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM s)), f AS (SELECT family_key AS key, id FROM c WHERE family_key IN (SELECT family_key FROM c GROUP BY family_key HAVING count(*) > 1)),
x AS (SELECT 'url' AS pass, * FROM u UNION ALL SELECT 'dedupe_key', * FROM s UNION ALL SELECT 'family_key', * FROM f)
SELECT pass, key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM x GROUP BY pass, key""")
def duplicate_clusters_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(*[F.expr(x).alias(n) for n, x in _ROWS.items()])
    found = resolve.duplicate_clusters(rows)
    return found.select("pass", "key", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query()
def duplicate_clusters_fuzzy(spark, sf_dir):
    """Greedy matching in order of id; tested against a plain loop."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("company"), F.concat(F.col("p_name"), F.lit(" specialist")).alias("title"))
    return resolve.fuzzy_clusters(rows).withColumn("score", F.round("score", 6))


@query("SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, min(doc_id) AS first_doc, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY k HAVING count(*) > 1")
def exact_text_groups(spark, sf_dir):
    """Documents that are the same but for case and white space; hashes are shuffled, and the text of groups' first ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce(clean_text(F.col("text")), F.lit(""))).alias("k"))
    groups = d.groupBy(F.sha2("k", 256).alias("h")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    return groups.join(d, F.col("first_doc") == F.col("doc_id")).select("k", "first_doc", "n")


_FEEDROWS = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 1 WHEN p_partkey % 4 = 1 THEN 2 END AS job_source_id, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ab' WHEN 2 THEN p_name || ' laboratory' WHEN 3 THEN 'zzzz qqqq' ELSE p_name || ' laboratories' END AS employer FROM part"


@query(f"""WITH d AS ({_FEEDROWS}), c AS ({_KNOWN}), s AS (SELECT a.employer AS l, b.name AS r, {_ZERO('a.employer', 'b.name')} AS score FROM (SELECT DISTINCT employer FROM d WHERE employer IS NOT NULL) a, (SELECT DISTINCT name FROM c) b),
h AS (SELECT p_partkey, id, employer = name AS exact, score FROM d JOIN s ON employer = l JOIN c ON name = r),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY exact DESC, score DESC, id) AS rn FROM h WHERE score >= 0.85)
SELECT d.p_partkey AS identity_key, CASE WHEN job_source_id = 1 THEN (SELECT min(id) FROM c) ELSE r.id END AS company_id, CASE WHEN job_source_id = 1 THEN 'source' WHEN exact THEN 'exact' WHEN r.id IS NOT NULL THEN 'fuzzy' WHEN length(employer) >= 3 THEN 'new' ELSE 'none' END AS kind FROM d LEFT JOIN r ON d.p_partkey = r.p_partkey AND rn = 1""")
def feed_company_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = p.where("p_partkey % 2 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.concat("p_name", F.lit(" laboratories")).alias("name"))
    sources = c.agg(F.min("id").alias("company_id")).select(F.lit(1).alias("id"), "company_id").unionByName(spark.range(1).select(F.lit(2).alias("id"), F.lit(-5).cast("bigint").alias("company_id")))
    rows = p.select(F.col("p_partkey").alias("identity_key"), F.expr("case when p_partkey % 4 = 0 then 1 when p_partkey % 4 = 1 then 2 end").alias("job_source_id"), F.expr("case p_partkey % 7 when 0 then null when 1 then 'ab' when 2 then p_name || ' laboratory' when 3 then 'zzzz qqqq' else p_name || ' laboratories' end").alias("employer"))
    return resolve.feed_company(rows, sources, c)
