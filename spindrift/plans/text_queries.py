"""Queries of the scalar library: text, markup, URLs, dates, classes, scores, keys, prefill."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import classify, dates, hashing, score, text, url
from spindrift.functions.prefill import prefill
from spindrift.plans.registry import LISTINGS_SQL, NOW, listings, now, query, spread, table

#: Part names dressed up as messy titles, company names and places; SQL for both engines.
TITLE = "CASE p_partkey % 6 WHEN 0 THEN '  ' || p_name || ' Intern — Summer 2026 ' WHEN 1 THEN 'R&amp;D ' || p_name || ' (Fall)' WHEN 2 THEN p_name || '/Lab, Winter 2025!' WHEN 3 THEN 'Ingeniería ' || p_name WHEN 4 THEN '<b>' || p_name || '</b> Co-op autumn 1999' ELSE '' END"
COMPANY = "CASE p_partkey % 6 WHEN 0 THEN p_brand || ', Inc.' WHEN 1 THEN ' ' || p_brand || '  LLC' WHEN 2 THEN '\"' || p_brand || '\" Co. Inc' WHEN 3 THEN p_brand || ' Limited' WHEN 4 THEN 'Café ' || p_name || ' GmbH' ELSE p_name || ' S.A.' END"
PLACE = "CASE p_partkey % 4 WHEN 0 THEN 'Long Beach, CA; (' || p_name || ')' WHEN 1 THEN 'São Paulo &amp; ' || p_name WHEN 2 THEN '' ELSE ' St. Louis - ' || p_name END"
NONE = lambda e: f"nullif({e}, '')"
SQUEEZE = lambda e: f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def _part(spark, sf_dir, expr):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(expr).alias("x"))


@query(f"SELECT doc_id, {NONE(SQUEEZE('text'))} AS clean FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


_CURATED = "trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(x)), '[.,''\"()]', '', 'g'), '\\s+', ' ', 'g')), '\\b(inc|incorporated|llc|ltd|corp|corporation|co|company|plc|gmbh)$', ''))"


@query(f"SELECT p_partkey, {_CURATED} AS key FROM (SELECT p_partkey, {COMPANY} AS x FROM part)")
def normalize_company(spark, sf_dir):
    return _part(spark, sf_dir, COMPANY).select("p_partkey", text.company_key(F.col("x")).alias("key"))


_NAMED_SQL = lambda e: f"replace(replace(replace(replace({e}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(f"SELECT p_partkey, nullif(trim(regexp_replace(lower(trim(regexp_replace({_NAMED_SQL('nfc_normalize(x)')}, '\\s+', ' ', 'g'))), '\\s*\\b(inc|incorporated|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|sa|ag|nv|bv|srl)\\b\\.?$', '')), '') AS name FROM (SELECT p_partkey, {COMPANY} AS x FROM part)")
def normalize_employer(spark, sf_dir):
    return _part(spark, sf_dir, COMPANY).select("p_partkey", text.employer_name(F.col("x")).alias("name"))


_TITLE_SQL = SQUEEZE("regexp_replace(regexp_replace(lower(trim(x)), '[-–—]', ' ', 'g'), '[^0-9A-Za-z_\\s]', '', 'g')")


@query(f"SELECT p_partkey, {_TITLE_SQL} AS key FROM (SELECT p_partkey, {TITLE} AS x FROM part)")
def normalize_title(spark, sf_dir):
    return _part(spark, sf_dir, TITLE).select("p_partkey", text.title_key(F.col("x")).alias("key"))


@query("SELECT p_partkey, " + SQUEEZE(f"regexp_replace({_TITLE_SQL}, '\\b(20\\d{{2}}|spring|summer|fall|winter)\\b', '', 'g')") + f" AS family FROM (SELECT p_partkey, {TITLE} AS x FROM part)")
def title_family(spark, sf_dir):
    return _part(spark, sf_dir, TITLE).select("p_partkey", text.title_family(F.col("x")).alias("family"))


_STRIP = lambda e: f"regexp_replace({e}, '<[^>]*>', ' ', 'g')"
_JOB = NONE(SQUEEZE("regexp_replace(regexp_replace(lower(" + SQUEEZE(_NAMED_SQL(SQUEEZE(_NAMED_SQL(_STRIP("x"))))) + "), '[–—]', '-', 'g'), '[^\\p{L}\\p{N}\\s/-]', ' ', 'g')"))


@query(f"SELECT p_partkey, {_JOB} AS title FROM (SELECT p_partkey, {TITLE} AS x FROM part)")
def job_title_unicode(spark, sf_dir):
    return _part(spark, sf_dir, TITLE).select("p_partkey", text.job_title(F.col("x")).alias("title"))


@query("SELECT p_partkey, " + NONE(SQUEEZE(f"regexp_replace({_JOB}, '\\b(20\\d{{2}}|19\\d{{2}}|spring|summer|fall|autumn|winter)\\b', '', 'g')")) + f" AS family FROM (SELECT p_partkey, {TITLE} AS x FROM part)")
def job_title_family(spark, sf_dir):
    return _part(spark, sf_dir, TITLE).select("p_partkey", text.job_title_family(F.col("x")).alias("family"))


@query("SELECT p_partkey, " + NONE(SQUEEZE("regexp_replace(lower(" + SQUEEZE(_NAMED_SQL("nfc_normalize(x)")) + "), '[^\\p{L}\\p{N}\\s,.-]', ' ', 'g')")) + f" AS place FROM (SELECT p_partkey, {PLACE} AS x FROM part)")
def normalize_location(spark, sf_dir):
    return _part(spark, sf_dir, PLACE).select("p_partkey", text.location_key(F.col("x")).alias("place"))


@query("SELECT p_partkey, " + NONE("lower(" + SQUEEZE(_NAMED_SQL("nfc_normalize(x)")) + ")") + f" AS department FROM (SELECT p_partkey, {COMPANY} AS x FROM part)")
def normalize_department(spark, sf_dir):
    return _part(spark, sf_dir, COMPANY).select("p_partkey", text.department_key(F.col("x")).alias("department"))


_ALL_NAMED = "text"
for _n, _v in text.NAMED.items():
    _ALL_NAMED = f"replace({_ALL_NAMED}, '&{_n};', '{_v.replace(chr(39), chr(39) * 2)}')"
_HTML_SQL = "regexp_replace(html, '(?i)<script[^>]*>[\\s\\S]*?</script>|<style[^>]*>[\\s\\S]*?</style>', ' ', 'g')"
_HTML_SQL = _ALL_NAMED.replace("text", f"regexp_replace({_HTML_SQL}, '<[^>]*>', ' ', 'g')", 1)
_WIDE = lambda e: f"trim(regexp_replace({e}, '[\\s\\x{{A0}}\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]+', ' ', 'g'))"


@query(f"SELECT page_id, nullif({_WIDE(_HTML_SQL)}, '') AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(f"SELECT page_id, md5({_ALL_NAMED.replace('text', 'html', 1)}) AS decoded FROM pages")
def decode_entities_named(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.decode_named(F.col("html"))).alias("decoded"))


def _tracking(names, flag):
    group = "|".join(names)
    return f"regexp_replace(regexp_replace(regexp_replace(u, '{flag}([?&])(?:(?:{group})=[^&]*(?:&|$))+', '\\1', 'g'), '[?&]$', ''), '[?&]$', '')"


_BASE = "regexp_replace(CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END, '#.*$', '')"


@query(f"WITH a AS (SELECT page_id, {_BASE} AS u FROM pages), b AS (SELECT page_id, {_tracking(url.FEED_TRACKING, '(?i)')} AS u FROM a), c AS (SELECT page_id, CASE WHEN regexp_matches(u, '^[a-z]+://[^/?]+$') THEN u || '/' ELSE u END AS u FROM b) SELECT page_id, CASE WHEN regexp_matches(u, '^[a-z]+://[^/]+/.*/$') THEN regexp_replace(u, '/$', '') ELSE u END AS canonical FROM c")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.canonical_url(F.col("url")).alias("canonical"))


@query(f"WITH a AS (SELECT page_id, {_BASE} AS u FROM pages), b AS (SELECT page_id, {_tracking(url.CURATED_TRACKING, '')} AS u FROM a) SELECT page_id, regexp_replace(u, '/$', '') AS canonical FROM b")
def normalize_url_csv(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.curated_url(F.col("url")).alias("canonical"))


@query("WITH a AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS k FROM pages), b AS (SELECT * FROM a UNION ALL SELECT page_id + 1000000000, k FROM a WHERE page_id % 3 = 0) SELECT k AS key, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS members FROM b GROUP BY k HAVING count(*) > 1")
def url_duplicate_groups(spark, sf_dir):
    """Pages that are the same but for query and fragment; every third one comes a second time with a tracking query."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    again = p.where("page_id % 3 = 0").select((F.col("page_id") + 1_000_000_000).alias("page_id"), F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?utm_source=x#top")).alias("url"))
    p = p.unionByName(again).select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("key"))
    return p.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("members")).where("n > 1")


#: Order dates written in the ways that people write them.
WRITTEN = "CASE o_orderkey % 8 WHEN 0 THEN {mdy} WHEN 1 THEN 'open until ' || {mdy} WHEN 2 THEN {ymd} WHEN 3 THEN 'Rolling' WHEN 4 THEN {long} WHEN 5 THEN '02/31/2026' WHEN 6 THEN {slash} ELSE ' TBD ' END"
WRITTEN_SPARK = WRITTEN.format(mdy="date_format(o_orderdate, 'MM/dd/yyyy')", ymd="date_format(o_orderdate, 'yyyy-MM-dd')", long="date_format(o_orderdate + interval 10 year, 'MMMM d, yyyy')", slash="date_format(o_orderdate, 'yyyy/MM/dd')")
WRITTEN_DUCK = WRITTEN.format(mdy="strftime(o_orderdate, '%m/%d/%Y')", ymd="strftime(o_orderdate, '%Y-%m-%d')", long="strftime(o_orderdate + INTERVAL 10 YEAR, '%B %-d, %Y')", slash="strftime(o_orderdate, '%Y/%m/%d')")
_MDY = "regexp_extract(x, '(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{2,4}})', {i})"
_YEAR = f"CASE WHEN length({_MDY.format(i=3)}) = 2 THEN '20' || {_MDY.format(i=3)} ELSE lpad({_MDY.format(i=3)}, 4, '0') END"
_DEADLINE = f"CASE WHEN regexp_matches(trim(x), '(?i)^(rolling|tbd)$') THEN NULL WHEN regexp_matches(x, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}') THEN TRY_CAST(({_YEAR}) || '-' || lpad({_MDY.format(i=1)}, 2, '0') || '-' || lpad({_MDY.format(i=2)}, 2, '0') AS DATE) ELSE CAST(try_strptime(x, '%B %-d, %Y') AS DATE) END"


@query(f"SELECT o_orderkey, {_DEADLINE} AS deadline FROM (SELECT o_orderkey, {WRITTEN_DUCK} AS x FROM orders)")
def parse_dates_mixed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_deadline(F.expr(WRITTEN_SPARK)).alias("deadline"))


_STAMP = "CASE o_orderkey % 5 WHEN 0 THEN {ymd} WHEN 1 THEN {ymd} || 'T23:30:00-07:00' WHEN 2 THEN {ymd} || ' 01:00:00' WHEN 3 THEN {mdy} ELSE 'July 5, 2026' END"
_ISO = "CASE WHEN o_orderkey % 5 IN (0, 2, 3) THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 5 = 1 THEN CAST(o_orderdate AS DATE) + 1 END"


@query(f"SELECT o_orderkey, {_ISO} AS day FROM orders")
def parse_iso_dates(spark, sf_dir):
    x = F.expr(_STAMP.format(ymd="date_format(o_orderdate, 'yyyy-MM-dd')", mdy="date_format(o_orderdate, 'M/d/yyyy')"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_iso_date(x).alias("day"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 4) AND ({_DEADLINE}) IS NOT NULL THEN 'hard' WHEN regexp_matches(x, '(?i)rolling|ongoing|until filled|no deadline|open until') THEN 'rolling' WHEN ({_DEADLINE}) IS NOT NULL THEN 'hard' ELSE 'unknown' END AS kind FROM (SELECT o_orderkey, {WRITTEN_DUCK} AS x FROM orders)")
def deadline_kind(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(WRITTEN_SPARK).alias("x"))
    return x.select("o_orderkey", dates.deadline_kind(F.col("x"), dates.parse_deadline(F.col("x"))).alias("kind"))


@query(f"SELECT o_orderkey, CAST(floor((epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) - epoch_ms({NOW})) / 86400000.0) AS INT) AS days FROM orders")
def days_until_deadline(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.days_until(F.to_date("o_orderdate"), now()).alias("days"))


#: Words of interest that are put before a document's text.
SIGNAL = "CASE doc_id % 12 WHEN 0 THEN 'unpaid stipend' WHEN 1 THEN '$18/hr remote' WHEN 2 THEN 'volunteer, not remote' WHEN 3 THEN 'hybrid internship' WHEN 4 THEN 'Full-time on-site research fellowship' WHEN 5 THEN 'remote and in-office' WHEN 6 THEN 'entry level PCR and sequencing' WHEN 7 THEN 'Interns wanted' WHEN 8 THEN 'scholarship award; part time co-op' WHEN 9 THEN 'Financial analyst, machine learning' WHEN 10 THEN 'immunology, oncology' ELSE '' END"


def _signals(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(f"({SIGNAL}) || ' ' || text").alias("x"))


_SIGNAL_SQL = f"(SELECT doc_id, ({SIGNAL}) || ' ' || text AS x FROM documents)"
_IS = lambda p, e="x": f"regexp_matches({e}, '(?i){p}')"


@query(f"SELECT doc_id, CASE WHEN {_IS('stipend|scholarship|award')} THEN 'stipend' WHEN {_IS('unpaid|volunteer|no pay|credit only')} THEN 'unpaid' WHEN {_IS('paid|\\$|hour|salary|hr\\b|wage')} THEN 'paid' ELSE 'unknown' END AS paid FROM {_SIGNAL_SQL}")
def paid_status(spark, sf_dir):
    return _signals(spark, sf_dir).select("doc_id", classify.paid_status(F.col("x")).alias("paid"))


_R, _H = f"({_IS('\\bremote\\b')} AND NOT {_IS('\\bnot remote\\b')})", f"({_IS('\\bhybrid\\b')} AND NOT {_IS('\\bnot hybrid\\b')})"
_ON = _IS("\\b(on-?site|in-?office|in person|on ?campus|in-?person)\\b")


@query(f"SELECT doc_id, CASE WHEN {_H} THEN 'hybrid' WHEN {_R} AND {_ON} THEN 'unknown' WHEN {_R} THEN 'remote' WHEN {_ON} THEN 'onsite' ELSE 'unknown' END AS kind, CASE WHEN {_H} THEN false WHEN {_R} THEN {_ON} WHEN {_ON} THEN false ELSE {_IS('\\bnot remote\\b')} END AS ambiguous FROM {_SIGNAL_SQL}")
def remote_type(spark, sf_dir):
    r = classify.remote_type(F.lit(None).cast("string"), F.lit("Here"), F.col("x"))
    return _signals(spark, sf_dir).select("doc_id", r["type"].alias("kind"), r["ambiguous"].alias("ambiguous"))


@query(f"SELECT doc_id, CASE WHEN x = '' THEN NULL WHEN {_IS('full.?time')} THEN 'full_time' WHEN {_IS('part.?time')} THEN 'part_time' WHEN {_IS('\\bco.?op\\b')} THEN 'co_op' WHEN {_IS('\\bfellowship\\b')} THEN 'fellowship' WHEN {_IS('\\bintern(ship)?\\b')} THEN 'internship' ELSE trim(x) END AS kind FROM (SELECT doc_id, {SIGNAL} AS x FROM documents)")
def employment_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.employment_type(F.expr(SIGNAL)).alias("kind"))


_INT, _FEL = "\\bintern(ship)?\\b", "\\bfellowship\\b"


@query(f"SELECT doc_id, CASE WHEN {_IS(_INT, 'c')} THEN 'internship' WHEN {_IS(_FEL, 'c')} THEN 'fellowship' WHEN {_IS('\\b(research|scientist|analyst)\\b', 'c')} THEN 'research' WHEN {_IS('\\b(entry.?level|new grad|new graduates?)\\b', 'c')} THEN 'entry_level' ELSE 'other' END AS kind, CASE WHEN {_IS(_INT, 'c')} THEN NOT {_IS(_INT, 't')} WHEN {_IS(_FEL, 'c')} THEN NOT {_IS(_FEL, 't')} ELSE true END AS inferred FROM (SELECT doc_id, t, concat_ws(' ', t, left(x, 500)) AS c FROM (SELECT doc_id, x, CASE WHEN doc_id % 2 = 0 THEN 'Summer Internship' ELSE 'Position' END AS t FROM {_SIGNAL_SQL}))")
def opportunity_class(spark, sf_dir):
    c = classify.opportunity_class(F.expr("case when doc_id % 2 = 0 then 'Summer Internship' else 'Position' end"), F.lit(None).cast("string"), F.col("x"))
    return _signals(spark, sf_dir).select("doc_id", c["class"].alias("kind"), c["inferred"].alias("inferred"))


_FOCUS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(left(x, 1000), '(?i)\\b({p})\\b') THEN '{n}'" for n, p in classify.FOCUS.items()) + " END"


@query(f"SELECT doc_id, {_FOCUS_SQL} AS area FROM {_SIGNAL_SQL}")
def focus_area(spark, sf_dir):
    return _signals(spark, sf_dir).select("doc_id", classify.focus_area(F.lit(None).cast("string"), F.col("x")).alias("area"))


_D = f"CAST(floor((epoch_ms(CAST(deadline AS TIMESTAMP)) - epoch_ms({NOW})) / 86400000.0) AS INT)"
_ROLL = "regexp_matches(coalesce(deadline_text, ''), '(?i)rolling|ongoing|until filled')"
_RULES = [
    (f"CASE WHEN {_D} < 0 THEN -30 WHEN {_D} <= 7 THEN 5 WHEN {_D} <= 60 THEN 15 WHEN {_D} IS NOT NULL THEN 10 WHEN {_ROLL} THEN 10 ELSE -5 END",
     f"CASE WHEN {_D} < 0 THEN 'deadline passed ' || CAST(-{_D} AS VARCHAR) || 'd ago' WHEN {_D} <= 7 THEN 'deadline in ' || CAST({_D} AS VARCHAR) || 'd (urgent but applicable)' WHEN {_D} <= 60 THEN 'deadline in ' || CAST({_D} AS VARCHAR) || 'd' WHEN {_D} IS NOT NULL THEN 'deadline in ' || CAST({_D} AS VARCHAR) || 'd (plenty of time)' WHEN {_ROLL} THEN 'rolling deadline' ELSE 'no deadline information' END"),
    ("CASE paid_status WHEN 'paid' THEN 15 WHEN 'stipend' THEN 10 WHEN 'unpaid' THEN -5 ELSE 0 END", "CASE paid_status WHEN 'paid' THEN 'paid position' WHEN 'stipend' THEN 'stipend offered' ELSE 'unpaid' END"),
    ("CASE WHEN location IS NULL THEN -3 WHEN regexp_matches(lower(location), 'long beach|irvine|remote|hybrid|ca') THEN 10 ELSE 0 END", "CASE WHEN location IS NULL THEN 'no location listed' ELSE 'accessible location (' || location || ')' END"),
    ("CASE WHEN regexp_matches(lower(coalesce(eligibility, '')), 'junior|senior|all majors|students') THEN 10 ELSE 0 END", "'eligibility matches undergraduates'"),
    ("CASE WHEN regexp_matches(lower(coalesce(eligibility, '')), 'graduate students? only|phd only|masters? only') THEN -15 ELSE 0 END", "'restricted to graduate students'"),
    ("CASE WHEN focus_area = 'Clinical Research' THEN 10 ELSE 0 END", "'priority focus area (' || focus_area || ')'"),
    ("CASE WHEN posting_url IS NULL THEN -10 ELSE 0 END", "'no application link'"),
]
_SCORE_SQL = "CAST(greatest(0, least(100, 40 + " + " + ".join(f"({p})" for p, _ in _RULES) + ")) AS INT)"
_REASONS_SQL = "concat_ws('; ', " + ", ".join(f"CASE WHEN ({p}) <> 0 THEN CASE WHEN ({p}) > 0 THEN '+' ELSE '' END || CAST(({p}) AS VARCHAR) || ': ' || ({t}) END" for p, t in _RULES) + ")"


def _curated(spark, sf_dir):
    o = listings(spark, sf_dir, "id", "deadline", "deadline_text", "paid_status", "location", "eligibility", "focus_area", "posting_url")
    s = score.curated_score(*[F.col(c) for c in ("deadline", "deadline_text", "paid_status", "location", "eligibility", "focus_area", "posting_url")], now(), priority=("Clinical Research",))
    return o.select("id", s.alias("s"))


@query(f"SELECT id, {_SCORE_SQL} AS score, {_REASONS_SQL} AS reasons FROM ({LISTINGS_SQL})")
def score_csv_rules(spark, sf_dir):
    return _curated(spark, sf_dir).select("id", F.col("s.score").alias("score"), F.array_join("s.reasons", "; ").alias("reasons"))


@query(f"SELECT id, unnest(string_split({_REASONS_SQL}, '; ')) AS reason FROM ({LISTINGS_SQL})")
def score_reasons_exploded(spark, sf_dir):
    return _curated(spark, sf_dir).select("id", F.explode("s.reasons").alias("reason"))


_FEED = {
    "title_raw": "CASE p_partkey % 7 WHEN 0 THEN 'Biotech Intern ' || p_name WHEN 1 THEN 'Senior Research Manager ' || p_name WHEN 2 THEN 'Director of ' || p_name WHEN 3 THEN 'Lab Tech ' || p_name WHEN 4 THEN 'Postdoctoral Fellow' ELSE p_name END",
    "location": "CASE p_partkey % 4 WHEN 0 THEN 'irvine, ca' WHEN 1 THEN 'boston, ma' WHEN 2 THEN 'south bay' END",
    "department": "CASE p_partkey % 5 WHEN 0 THEN 'research & development' WHEN 1 THEN 'sales' WHEN 2 THEN 'clinical' END",
    "kind": "CASE p_partkey % 6 WHEN 0 THEN 'internship' WHEN 1 THEN 'fellowship' WHEN 2 THEN 'research' WHEN 3 THEN 'entry_level' ELSE 'other' END",
    "remote": "CASE p_partkey % 8 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE 'unknown' END",
    "url": "CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'https://x.example.com/' END",
    "description": "CASE p_partkey % 10 WHEN 0 THEN 'Open to undergraduate students' WHEN 1 THEN 'A PhD is required' WHEN 2 THEN 'Recent graduate welcome' WHEN 3 THEN 'Graduate students only' WHEN 4 THEN 'Must have a PhD' WHEN 5 THEN 'MS preferred' WHEN 6 THEN 'BS or MS preferred' WHEN 7 THEN 'Join us' END",
    "closes": "CASE p_partkey % 3 WHEN 0 THEN DATE '1998-10-05' WHEN 1 THEN DATE '1998-09-01' ELSE DATE '1999-12-31' END",
}
_T, _X = "lower(title_raw)", "lower(coalesce(description, ''))"
_STRONG, _SOME = "regexp_matches(lower(title_raw), 'biotech')", "regexp_matches(lower(title_raw), 'research|lab tech')"
_TOP = f"regexp_matches({_T}, 'director')"
_DEG = f"(regexp_matches({_X}, 'phd is required|must have a phd') OR regexp_matches({_T}, 'postdoctoral'))"
_UNDER, _RECENT, _GRAD = f"contains({_X}, 'undergraduate')", f"contains({_X}, 'recent graduate')", f"contains({_X}, 'graduate students only')"
_FEED_SCORE = f"""40 + CASE WHEN {_STRONG} THEN 20 WHEN {_SOME} THEN 10 ELSE 0 END + CASE WHEN department IN ('research & development', 'clinical') THEN 8 WHEN department = 'sales' THEN -20 ELSE 0 END
 + CASE WHEN {_UNDER} THEN 15 WHEN {_RECENT} THEN 8 ELSE 0 END + CASE WHEN {_GRAD} THEN -15 ELSE 0 END
 + CASE kind WHEN 'internship' THEN 15 WHEN 'fellowship' THEN 12 WHEN 'research' THEN 8 WHEN 'entry_level' THEN 10 ELSE 0 END
 + CASE WHEN remote = 'remote' THEN 10 WHEN coalesce(location, '') IN ('irvine, ca', 'south bay') THEN CASE WHEN remote = 'hybrid' THEN 6 ELSE 12 END ELSE 0 END
 + CASE WHEN {_TOP} THEN -25 WHEN regexp_matches({_T}, 'manager') THEN -15 ELSE 0 END
 + CASE WHEN {_DEG} THEN -20 WHEN regexp_matches({_X}, '^ms preferred|graduate students only') THEN -8 ELSE 0 END
 + CASE WHEN description IS NULL OR NOT ({_UNDER} OR {_RECENT} OR {_GRAD}) THEN -5 ELSE 0 END
 + CASE WHEN url = '' THEN -10 ELSE 0 END + CASE WHEN closes = DATE '1998-10-05' THEN 5 WHEN closes = DATE '1998-09-01' THEN -15 ELSE 0 END"""


@query("SELECT p_partkey, CAST(raw AS INT) AS raw_total, CAST(greatest(0, least(100, raw)) AS INT) AS total FROM (SELECT p_partkey, " + _FEED_SCORE + " AS raw FROM (SELECT p_partkey, " + ", ".join(f"{e} AS {n}" for n, e in _FEED.items()) + " FROM part))")
def score_feed_rules(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", *[F.expr(e).alias(n) for n, e in _FEED.items()])
    none = F.array().cast("array<string>")
    s = score.feed_score(F.col("title_raw"), text.job_title(F.col("title_raw"), full=False), F.col("location"), F.col("department"), none, F.col("kind"), F.col("remote"), F.col("url"), F.col("description"), F.col("closes"), none, now())
    return p.select("p_partkey", s["raw_total"].alias("raw_total"), s["total"].alias("total"))


@query("SELECT p_partkey, 'board:' || lower(trim(p_brand)) || ':' || CAST(p_partkey AS VARCHAR) AS key FROM part")
def identity_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.identity_key("board", F.col("p_brand"), F.col("p_partkey")).alias("key"))


@query("""SELECT p_partkey, sha256('{"canonicalUrl":"u' || CAST(p_partkey AS VARCHAR) || '","classification":"other","closesAt":null,"deadlineKind":"hard","departments":["' || p_brand || '","' || p_type || '"],"descriptionNormalized":"a \\"q\\" é / end","employmentType":null,"locationRaw":null,"offices":[],"remoteType":"unknown","titleRaw":"' || p_name || '"}') AS hash FROM part""")
def material_hash(spark, sf_dir):
    null = F.lit(None).cast("string")
    fields = {"canonicalUrl": F.expr("'u' || p_partkey"), "classification": F.lit("other"), "closesAt": null, "deadlineKind": F.lit("hard"), "departments": F.array("p_type", "p_brand"), "descriptionNormalized": F.lit('a "q" é / end'), "employmentType": null, "locationRaw": null, "offices": F.array().cast("array<string>"), "remoteType": F.lit("unknown"), "titleRaw": F.col("p_name")}
    return table(spark, sf_dir, "part").select("p_partkey", hashing.material_hash(fields).alias("hash"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'AB' WHEN s_suppkey % 3 = 1 THEN 'S' ELSE '?' END AS initials FROM supplier")
def initials(spark, sf_dir):
    x = F.expr("case s_suppkey % 3 when 0 then 'alpha 3rd beta gamma' when 1 then s_name || ' 42' else '1st 2nd' end")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.initials(x).alias("initials"))


@query("SELECT DISTINCT area FROM (SELECT unnest(['Clinical Research', 'Quality Control', 'Education & Outreach']) AS area UNION ALL SELECT p_type FROM part WHERE p_type IS NOT NULL)")
def focus_area_union(spark, sf_dir):
    own = table(spark, sf_dir, "part").agg(F.collect_set("p_type").alias("s"))
    preset = F.array(*map(F.lit, ("Clinical Research", "Education & Outreach", "Quality Control")))
    return own.select(F.explode(F.array_sort(F.array_union(preset, "s"))).alias("area"))


_PASTE = "'Research Intern at Acme ' || p_brand || chr(10) || 'Location: Irvine, CA' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'Apply by 03/15/2026' ELSE 'Duration: 10 weeks' END || chr(10) || 'Pay: $20/hour hybrid' || chr(10) || 'https://x.example.com/' || CAST(p_partkey AS VARCHAR(20)) || '?utm_source=a' || chr(10) || '12 weeks'"


@query("SELECT p_partkey, 'Research Intern' AS title, 'Acme Brand' AS company, 'https://x.example.com/' || CAST(p_partkey AS VARCHAR) AS posting_url, 'Irvine, CA (hybrid)' AS location, CASE WHEN p_partkey % 2 = 0 THEN '03/15/2026' END AS deadline_text, 'paid' AS paid_guess, CASE WHEN p_partkey % 2 = 0 THEN '12 weeks' ELSE '10 weeks' END AS start_date_text FROM part")
def prefill_labels(spark, sf_dir):
    p = prefill(F.expr(_PASTE.replace("Acme ' || p_brand", "Acme Brand'")))
    names = ("title", "company", "posting_url", "location", "deadline_text", "paid_guess", "start_date_text")
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", p.alias("p")).select("p_partkey", *[F.col(f"p.{n}").alias(n) for n in names])


_AT = "^(.{4,60}?)\\s+at\\s+([A-Z][A-Za-z0-9_&.,'' -]{2,50})$"


@query(f"WITH l AS (SELECT doc_id, trim(unnest(string_split_regex(text, '\\r?\\n'))) AS line, unnest(range(len(string_split_regex(text, '\\r?\\n')))) AS pos FROM documents), f AS (SELECT doc_id, min_by(line, pos) AS line FROM l WHERE length(line) BETWEEN 8 AND 90 AND NOT contains(line, ':') AND NOT regexp_matches(line, '(?i)^https?://') GROUP BY doc_id) SELECT doc_id, CASE WHEN regexp_matches(line, '{_AT}') THEN trim(regexp_replace(regexp_extract(line, '{_AT}', 1), '\\s+', ' ', 'g')) ELSE line END AS title FROM f")
def prefill_document_titles(spark, sf_dir):
    """Titles guessed from whole documents; an employer behind "at" is split off."""
    return table(spark, sf_dir, "documents").select("doc_id", prefill(F.col("text"))["title"].alias("title")).where("title is not null")
