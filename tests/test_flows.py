"""Feeds, CSV imports, state machine, resolution and merges as small scenarios."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from spindrift.operators import merge, resolve, state, validate, views
from spindrift.plans import importing, ingesting
from spindrift.sources import csv_rows, jobs_json, sinks


def now():
    return F.expr("timestamp '2026-07-01 12:00:00'")


def job(i, **kw):
    base = {"id": i, "title": "Genomics Intern", "updated_at": "2026-06-15T14:00:00-07:00", "location": {"name": "Irvine, CA"}, "absolute_url": f"https://b.example.com/jobs/{i}?utm_source=x", "content": "<p>Open to undergraduate students</p>", "departments": [{"id": 1, "name": " R&amp;D "}], "offices": [], "metadata": [], "first_published": "2026-06-01", "application_deadline": "2026-07-15"}
    return base | kw


@pytest.fixture()
def payloads(spark, tmp_path):
    def write(**files):
        for name, content in files.items():
            (tmp_path / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))
        return jobs_json.read_payloads(spark, str(tmp_path))

    return write


def test_payload_to_postings(payloads):
    p = payloads(a={"jobs": [job(1), job(2, title="Senior Director", location=None, content=None, application_deadline="soon", absolute_url="ftp://x")]})
    rows = {r["external_id"]: r for r in jobs_json.postings(p, "LabCo", now()).collect()}
    one, two = rows["1"], rows["2"]
    assert one["identity_key"].endswith(":labco:1") and one["canonical_url"] == "https://b.example.com/jobs/1" and one["issue"] is None
    assert (one["title"], one["location"], one["classification"], one["closes_at"]) == ("genomics intern", "irvine, ca", "internship", dt.date(2026, 7, 15))
    assert one["departments"] == ["R&amp;D"] and one["department"] == "r&d"
    assert one["score"]["raw_total"] == 40 + 20 + 8 + 15 + 15 + 12 + 5 and one["score"]["total"] == 100
    assert two["issue"] == "invalid_url" and {"url_invalid", "location_missing", "description_missing", "deadline_invalid"} <= set(two["flags"])


def test_hash_ignores_key_order_and_markup(payloads):
    j = job(1)
    p = payloads(a={"jobs": [j]}, b={"jobs": [dict(reversed(list(j.items())))]}, c={"jobs": [j | {"content": "<div>Open to <b>undergraduate</b> students</div>"}]}, d={"jobs": [j | {"application_deadline": "2026-07-16"}]})
    h = {r["path"][-6]: r["material_hash"] for r in jobs_json.postings(p, "x", now()).collect()}
    assert h["a"] == h["b"] == h["c"] != h["d"]


def test_payload_errors(payloads):
    p = payloads(a="{broken", b={"x": 1}, c={"jobs": []}, d={"jobs": [job(1), job(None)]}, e={"jobs": [job(None)]})
    got = {r["path"][-6]: (r["ok"], r["error"], r["seen"], r["skipped"], r["status"]) for r in jobs_json.fetch_result(p, jobs_json.postings(p, "x", now())).collect()}
    assert got == {"a": (False, "invalid_json", 0, 0, "failed"), "b": (False, "invalid_shape", 0, 0, "failed"), "c": (True, None, 0, 0, "completed"), "d": (True, None, 2, 1, "partial"), "e": (False, None, 1, 1, "failed")}


CSV = """Company Name,Internship Title / Position,Link to Posting,Location,Application Deadline,Paid/Unpaid,Mystery
Acme Bio,Lab Intern Summer 2026,https://a.example.com/1,Irvine,03/15/2026,Paid,x
,,,,,,
Acme Bio,Lab Intern Summer 2026,https://a.example.com/1,Irvine,03/15/2026,Paid,
Acme Bio Inc.,Lab Intern Fall 2026,https://a.example.com/2,,Rolling,,
Acme Bio,Lab Interns Summer 26,,,,,
,Only title,,,,,
Approved Co,Fixed Role,https://a.example.com/9,Boston,,,
Brand New Labs,Chemist,,,,$20/hr,
Brand New Lab,Analyst,,,,,
"""


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "in.csv"
    path.write_text(CSV)
    drafts = csv_rows.drafts(csv_rows.read_csv(spark, str(path)))
    companies = spark.createDataFrame([("c9", "approved")], "id string, name_key string")
    existing = spark.createDataFrame([("o9", "approved co|fixed role|https://a.example.com/9", "approved co|fixed role", "https://a.example.com/9", "Fixed Role", "c9", "approved", True, "Irvine", None, None, None, None, "unknown", None, None)], "id string, dedupe_key string, family_key string, posting_url string, title string, company_id string, review_status string, public_safe boolean, location string, eligibility string, focus_area string, deadline date, deadline_text string, paid_status string, application_type string, source_status_raw string")
    return drafts, importing.import_csv(drafts, companies, existing, now())


def test_headers():
    mapping, rest = csv_rows.map_headers(["Company", "Company URL", "Title", "Link", "Mystery"])
    assert mapping == {"company_name": "Company", "title": "Title", "posting_url": "Link"} and rest == ["Company URL", "Mystery"]


def test_csv_drafts(imported):
    rows = {r["row_number"]: r for r in imported[0].collect()}
    assert sorted(rows) == [2, 3, 4, 5, 6, 7, 8, 9] and rows[6]["error"] == "Missing company name"
    assert rows[2]["dedupe_key"] == "acme bio|lab intern summer 2026|https://a.example.com/1" and rows[4]["family_key"] == "acme bio|lab intern"


def test_csv_import_sees_its_own_rows(imported):
    r = imported[1]
    audit = {x["row_number"]: (x["outcome"], x["match"]) for x in r.audit.collect()}
    assert audit == {2: ("inserted", "none"), 3: ("updated", "same_url"), 4: ("inserted", "family"), 5: ("inserted", "fuzzy"), 6: ("error", None), 7: ("touched", "same_url"), 8: ("inserted", "none"), 9: ("inserted", "none")}
    assert [x["changed"] for x in r.touched.collect()] == [["location"]]
    assert sorted(x["type"] for x in r.tasks.collect()) == ["changed_fields", "possible_duplicate", "possible_duplicate_company", "possible_repost"]
    assert tuple(r.summary.first()) == (8, 5, 2, 1, 1, 2)
    assert {x["name_key"] for x in r.new_companies.collect()} == {"acme bio", "brand new labs"}


OBS = "source string, identity_key string, run_id string, seq bigint, observed_at timestamp, hash string, score int, status string"


def obs(spark, *rows):
    day = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([("s", k, run, seq, day + dt.timedelta(days=d), h, sc, stat) for seq, (k, run, d, h, sc, stat) in enumerate(rows)], OBS)


SCENES = [
    ("new", "r1", 1, "A", 35, "open"), ("low", "r1", 1, "A", 34, "open"),
    ("new", "r1", 1, "A", 35, "open"),  # replay
    ("new", "r2", 2, "B", 35, "open"), ("new", "r3", 3, "A", 35, "open"),  # A, B, A
    ("new", "r4", 2, "C", 35, "open"),  # stale
    ("new", "r5", 3, "C", 35, "closed"),  # equal time
    ("new", "r6", 4, "D", 35, "open"),  # reopened, also changed
    ("new", "r7", 5, "D", 35, "open"),
]


def test_state_machine(spark):
    done = state.outcomes(obs(spark, *SCENES))
    got = [(r["stale"], r["created"], r["changed"], r["reopened"], r["task"], r["new_status"]) for r in done.orderBy("seq").collect()]
    F_, T_ = False, True
    assert got == [(F_, T_, F_, F_, "source_new", "open"), (F_, T_, F_, F_, None, "open"), (F_, F_, F_, F_, None, "open"), (F_, F_, T_, F_, "source_changed", "open"), (F_, F_, T_, F_, "source_changed", "open"), (T_, F_, F_, F_, None, "open"), (F_, F_, T_, F_, "source_changed", "closed"), (F_, F_, T_, T_, "source_reopened", "reopened"), (F_, F_, F_, F_, None, "open")]
    assert [(r["run_id"], r["hash"]) for r in state.versions(done).where("identity_key = 'new'").orderBy("seq").collect()] == [("r1", "A"), ("r2", "B"), ("r3", "A"), ("r5", "C"), ("r6", "D")]
    last = state.latest_state(done).where("identity_key = 'new'").first()
    assert (last["hash"], last["current_status"], last["first_seen_at"].day, last["last_seen_at"].day) == ("D", "open", 2, 6)


def test_seed_and_open_tasks(spark):
    seed = spark.createDataFrame([("s", "k", dt.datetime(2026, 1, 5), "A", "missing")], "source string, identity_key string, last_seen_at timestamp, hash string, current_status string")
    i = ingesting.ingest(obs(spark, ("k", "r1", 1, "B", 50, "open"), ("k", "r2", 9, "A", 50, "open")), seed)
    assert [(r["stale"], r["task"]) for r in i.outcomes.orderBy("seq").collect()] == [(True, None), (False, "source_reopened")]
    assert state.tasks(i.outcomes, i.tasks.select("source", "identity_key", "task", "hash")).count() == 0
    c = {r["run_id"]: (r["new"], r["changed"], r["unchanged"], r["reviewed"], r["stale"]) for r in i.counters.collect()}
    assert c == {"r1": (0, 0, 1, 0, 1), "r2": (0, 0, 1, 1, 0)}


def test_stream_equals_batch(spark, tmp_path):
    from spindrift.streaming import observing

    rows = obs(spark, *SCENES).coalesce(1)
    rows.where("seq < 4").write.parquet(str(tmp_path / "in"))
    out = observing.observe(observing.read_landed(spark, str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    rows.where("seq >= 4").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    cols = ["seq", "stale", "created", "changed", "reopened", "task", "new_status"]
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*cols).orderBy("seq").collect()
    assert streamed == state.outcomes(obs(spark, *SCENES)).select(*cols).orderBy("seq").collect()


def test_diffs(spark):
    assert state.deep_diff({"a": {"b": 1, "c": [1]}, "d": None}, {"a": {"b": 2, "c": [1]}}) == [("a.b", 1, 2)] and state.deep_diff(1, 2) == [("$", 1, 2)]
    df = spark.createDataFrame([(1, '{"a":1,"n":null}', '{"a":2,"b":"x"}')], "k int, x string, y string")
    assert {(r["field"], r["before"], r["after"]) for r in state.variant_diff(df, "k", "x", "y").collect()} == {("a", "1", "2"), ("b", None, "x")}


POSTING = "identity_key string, canonical_url string, employer string, title string, location string, material_hash string"


@pytest.mark.parametrize(
    "candidate, corpus, expected",
    [
        (("k", "u", "acme bio", "lab intern", None, "h"), [], ("insufficient_information", 0.0, False)),
        (("k", "u", "acme bio", "lab intern", None, "h"), [("k", "u", "acme bio", "lab intern", None, "h")], ("exact_identity", 1.0, False)),
        (("k", "u", "acme bio", "lab intern", None, "g"), [("k", "u", "acme bio", "lab intern", None, "h")], ("exact_identity", 1.0, True)),
        (("n", "u", "acme bio", "lab intern", None, "h"), [("k", "u", "acme bio", "lab intern", None, "h")], ("exact_url", 0.95, True)),
        (("n", "v", "acme bio", "lab intern", None, "h"), [("k", "u", "acme bio", "lab intern", None, "h")], ("probable_same_posting", 0.9, True)),
        (("n", "v", "acme bio", "lab intern", "irvine", "h"), [("k", "u", "acme bio", "lab intern", None, "h")], ("likely_distinct", 0.9, False)),
        (("n", "v", "acme bio", "lab intern summer 2026", None, "h"), [("k", "u", "acme bio", "lab intern fall 2025", None, "h")], ("possible_annual_family", 0.6, True)),
        (("n", "v", None, "lab intern", None, "h"), [("k", "u", "acme bio", "lab intern", None, "h")], ("insufficient_information", 0.0, False)),
        (("n", "v", "acme bio", "zzz qqq", None, "h"), [("k", "u", "acme bio", "lab intern", None, "h")], ("likely_distinct", 0.9, False)),
    ],
)
def test_assess_duplicate(spark, candidate, corpus, expected):
    r = resolve.assess_duplicates(spark.createDataFrame([candidate], POSTING), spark.createDataFrame(corpus, POSTING)).first()
    assert (r["match_type"], r["confidence"], r["review"]) == expected


def most_rows(df):
    """The most rows that any step of the plan has given."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        inner = [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        n = p.metrics().get("numOutputRows")
        return max([n.get().value() if n.isDefined() else 0, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_alike_postings_do_not_meet_as_pairs(spark):
    places, titles = (None, "irvine", "boston"), ("lab intern", "lab intern summer 2026", "lab intern fall 2025")
    rows = lambda k, n: [(f"{k}{i}", f"{k}{i if k == 'n' else i % 2}", "acme bio", titles[i % 3], places[i // 3 % 3], "h") for i in range(n)]
    c, p = spark.createDataFrame(rows("n", 300), POSTING), spark.createDataFrame(rows("k", 300), POSTING)
    found = resolve.assess_duplicates(c, p)
    assert most_rows(found) <= 1200
    got = {r["identity_key"]: (r["match_type"], r["matched_key"]) for r in found.collect()}
    first = {(t, x): min(f"k{i}" for i in range(300) if titles[i % 3] == t and places[i // 3 % 3] == x) for t in titles for x in places}
    assert got == {f"n{i}": ("probable_same_posting", first[titles[i % 3], places[i // 3 % 3]]) for i in range(300)}


def test_families_of_any_place(spark):
    """The least key counts, of an unknown place too; where the candidate has no place, of all."""
    c = spark.createDataFrame([("n1", "v", "acme bio", "lab intern summer 2026", "irvine", "h"), ("n2", "v", "acme bio", "lab intern summer 2026", None, "h")], POSTING)
    far = [("a", "u", "acme bio", "lab intern fall 2025", "boston", "h"), ("b", "u", "acme bio", "lab intern fall 2025", None, "h"), ("c", "u", "acme bio", "lab intern fall 2025", "irvine", "h")]
    got = {r["identity_key"]: r["matched_key"] for r in resolve.assess_duplicates(c, spark.createDataFrame(far, POSTING)).collect()}
    assert got == {"n1": "b", "n2": "a"}


def test_similar_names_loses_nothing(spark, data):
    from tests.test_functions import plain_dice

    names = sorted({f"{a} {b}" for a in ("acme", "acme bio", "acme bios", "bio", "aaa aa", "aaaa a") for b in ("labs", "lab", "laboratory", "x")} | {"", "a"})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for least in (0.8, 0.85):
        got = {(r["l"], r["r"]) for r in resolve.similar_names(df, df, least).collect()}
        assert got == {(a, b) for a in names for b in names if a == b or plain_dice(a, b) >= least}


def test_greedy_clusters(spark, data):
    import __spark_entry__ as e
    from tests.test_functions import plain_dice

    rows = spark.read.parquet(f"{data}/part.parquet").select("p_partkey", "p_brand", "p_name").orderBy("p_partkey").collect()
    taken, expected = set(), set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] == b[1] and not {a[0], b[0]} & taken and plain_dice(f"{a[2]} specialist", f"{b[2]} specialist") >= 0.8:
                taken |= {a[0], b[0]}
                expected.add((a[0], b[0]))
    assert {(r["id"], r["other"]) for r in e.queries()["duplicate_clusters_fuzzy"](spark, data).collect()} == expected


def test_greedy_clusters_without_companies(spark):
    rows = [(1, None, "lab aide one"), (2, "", "lab aide ones"), (3, "c", "lab aide one"), (4, None, None), (5, "c", "Lab Aide One"), (6, None, "lab aide one"), (7, "d", "lab aide one")]
    got = resolve.fuzzy_clusters(spark.createDataFrame(rows, "id bigint, company string, title string")).collect()
    assert sorted((r["id"], r["other"]) for r in got) == [(1, 2), (3, 5)]
    assert resolve.fuzzy_clusters(spark.createDataFrame([], "id bigint, company string, title string")).count() == 0


def test_merge_policies(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in merge.insert_if_absent(t, spark.createDataFrame([(2, "x"), (3, "z"), (3, "y"), (None, "m")], "k int, v string"), "k").collect()) == [(0, "m"), (0, "n"), (1, "a"), (2, "b"), (3, "y")]
    assert sorted(tuple(r) for r in merge.upsert(t.where("k is not null"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string"), "k").collect() if r["v"]) == [(1, "a"), (3, "c")]
    links = spark.createDataFrame([(1, 10, False, 5), (1, 11, True, 6), (1, 11, False, 1), (2, 20, False, 2), (2, 21, False, 1)], "opportunity_id int, posting_id int, is_primary boolean, seq int")
    assert {(r["opportunity_id"], r["posting_id"]) for r in merge.elect_primary(links).where("is_primary").collect()} == {(1, 11), (2, 21)}


def test_claim_guards_its_limit(spark):
    for n in (0, 51):
        with pytest.raises(ValueError):
            views.claim(None, None, now(), n)


def test_validation(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, -1)], "k int, v int")
    assert {r["rule"]: r["violations"] for r in validate.check(df, {"positive": "v > 0"}).unionByName(validate.unique(df, "key", "k")).collect()} == {"positive": 1, "key": 1}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "r", "u", "body"), ("s", "r", "u", "body")], "source_id string, run_id string, url string, body string")
    stored = sinks.payload_rows(rows)
    first = stored.first()
    assert stored.count() == 1 and first["path"] == f"s/r/{first['sha256'][:2]}/{first['sha256']}.txt"
    assert sinks.payload_rows(rows, stored).count() == 0
    sinks.write_payloads(stored, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/metadata")).count() == 1
    sinks.export_csv(spark.range(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    forms = spark.createDataFrame([("http://a", None), ("ftp://a", None), ("https://b", "bot")], "link string, trap string")
    assert sinks.submissions(forms).count() == 1


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert views.maybe_single(df.where("k = 1")) == {"k": 1, "v": "a"} == views.single(df.where("k = 1")) and views.maybe_single(df.where("k = 9")) is None
    for bad in ("k = 2", "k = 9"):
        with pytest.raises(ValueError):
            views.single(df.where(bad))


def test_officer_decisions_keep_notes(spark):
    rows = spark.createDataFrame([(1, "expired", "needs_review", False, None, None, None)], "id int, status string, review_status string, public_safe boolean, review_notes string, last_checked_at timestamp, duplicate_of int")
    d = spark.createDataFrame([(1, "approve", "open_verified", None, " ok ")], "id int, action string, target_status string, duplicate_of int, notes string")
    r = merge.decide(rows, d, now()).first()
    assert (r["status"], r["review_status"], r["public_safe"], r["review_notes"]) == ("open_verified", "approved", True, "ok") and r["last_checked_at"] is not None


def test_first_seen_is_kept(spark):
    seed = spark.createDataFrame([("s", "k", dt.datetime(2026, 1, 1), "A", "open", dt.datetime(2025, 1, 1), '{"a":1}')], "source string, identity_key string, last_seen_at timestamp, hash string, current_status string, first_seen_at timestamp, content string")
    rows = obs(spark, ("k", "r1", 5, "B", 50, "open"), ("k", "r2", 6, "C", 50, "open"), ("n", "r1", 5, "B", 50, "open")).withColumn("content", F.concat(F.lit('{"a":"'), "hash", F.lit('"}')))
    done = state.outcomes(rows, seed)
    assert {r["identity_key"]: r["first_seen_at"] for r in state.latest_state(done).collect()} == {"k": dt.datetime(2025, 1, 1), "n": dt.datetime(2026, 1, 6)}
    got = {(r["identity_key"], r["run_id"]): r["field_diff"] for r in state.versions(done).collect()}
    assert got == {("k", "r1"): '{"a":{"before":1,"after":"B"}}', ("k", "r2"): '{"a":{"before":"B","after":"C"}}', ("n", "r1"): "{}"}


VALUES = [
    ('{"a":1}', '{"a":"1"}', {"a": ("1", "1")}), ('{"o":{"x":1,"y":2}}', '{"o":{"y":2,"x":1}}', {}), ('{"l":[1,2]}', '{"l":[2,1]}', {"l": ("[1,2]", "[2,1]")}), ('{"a":1}', '{"a":1.0}', {}), ('{"a":null}', "{}", {}), ('{"a":true}', '{"a":"true"}', {"a": ("true", "true")}),
    (None, '{"a":1}', {"a": (None, "1")}), ('{"a":"x"}', None, {"a": ("x", None)}), ("{}", "{}", {}),
]


def test_json_values_differ_by_type(spark):
    df = spark.createDataFrame([(i, b, a) for i, (b, a, _) in enumerate(VALUES)], "k int, x string, y string")
    got = {i: {} for i in range(len(VALUES))}
    for r in state.variant_diff(df, "k", "x", "y").collect():
        got[r["k"]][r["field"]] = (r["before"], r["after"])
    assert got == {i: f for i, (_, _, f) in enumerate(VALUES)}
    assert {r["k"]: set(json.loads(r["d"])) for r in df.select("k", state.object_diff("x", "y").alias("d")).collect()} == {i: set(f) for i, f in got.items()}


FLAGS = ", ".join(f"{c} {'date' if c == 'deadline' else 'string'}" for c in merge.FLAGGED)


def listing(i, **kw):
    base = dict.fromkeys(merge.FLAGGED) | {"id": i, "company_id": "c1", "status": "needs_review", "review_status": "pending", "public_safe": False, "title": "Lab Intern", "posting_url": f"u{i}", "dedupe_key": f"d{i}", "family_key": f"f{i}"}
    return base | kw


def bridged(spark, opportunities, postings):
    o = spark.createDataFrame(opportunities, f"id string, company_id string, status string, review_status string, public_safe boolean, dedupe_key string, family_key string, {FLAGS}")
    p = spark.createDataFrame([dict.fromkeys(merge.FLAGGED) | {"title": "Lab Intern", "employer": "Acme", "company_id": "c1", "material_changed": False, "score": 50, "company_kind": "exact"} | x for x in postings], f"identity_key string, canonical_url string, employer string, company_id string, material_changed boolean, score int, company_kind string, {', '.join(f for f in FLAGS.split(', ') if not f.startswith('posting_url'))}")
    return ingesting.bridge(p.drop("posting_url"), o)


STATES = [
    ({}, False, ("update", None, "exact")), ({}, True, ("update", None, "exact")), ({"review_status": "rejected"}, False, ("touch", None, "exact")), ({"review_status": "rejected"}, True, ("touch", "source_changed", "exact")),
    ({"review_status": "approved"}, False, ("touch", None, "exact")), ({"review_status": "approved", "public_safe": True, "location": "Irvine"}, False, ("touch", "source_changed", "exact")), ({"status": "closed"}, True, ("touch", "source_changed", "exact")),
    ({"status": "expired", "location": "x"}, False, ("touch", "source_changed", "exact")), ({"status": "broken_link"}, False, ("touch", None, "exact")), ({"status": "hidden"}, False, ("insert", None, "exact")), ({"status": "duplicate"}, True, ("insert", None, "exact")),
]


def test_protected_listings_stay(spark):
    have = [listing(str(i), company_id=f"c{i}", **change) for i, (change, _, _) in enumerate(STATES)]
    new = [{"identity_key": f"k{i}", "canonical_url": f"u{i}", "company_id": f"c{i}", "material_changed": news} for i, (_, news, _) in enumerate(STATES)]
    got = {r["identity_key"]: (r["action"], r["task"], r["link_type"]) for r in bridged(spark, have, new).collect()}
    assert got == {f"k{i}": expected for i, (_, _, expected) in enumerate(STATES)}


def test_bridge_links_and_pending_listings(spark):
    have = [listing("1", posting_url="a", family_key="acme|lab intern"), listing("2", posting_url="b", title="Lab Interns", company_id="c2")]
    new = [{"identity_key": "fam", "canonical_url": "x"}, {"identity_key": "fuz", "canonical_url": "y", "employer": "Other", "company_id": "c2"}, {"identity_key": "one", "canonical_url": "z", "title": "Chemist"}, {"identity_key": "two", "canonical_url": "z", "title": "Chemist", "company_kind": "fuzzy"}, {"identity_key": "low", "canonical_url": "w", "title": "Driver", "score": 34}]
    actions = bridged(spark, have, new)
    got = {r["identity_key"]: (r["action"], r["task"], r["link_type"], r["primary"]) for r in actions.collect()}
    assert got == {"fam": ("link", "possible_repost", "annual_family", False), "fuz": ("link", "possible_duplicate", "probable", False), "one": ("insert", None, "exact", True), "two": ("insert", "possible_duplicate", "exact", True), "low": ("none", None, None, False)}
    links = spark.createDataFrame([("1", "fam", "annual_family", False), ("2", "z", "exact", True)], "opportunity_id string, posting_id string, match_type string, is_primary boolean")
    new = {r["posting_id"]: (r["match_type"], r["is_primary"]) for r in ingesting.new_links(actions, links).collect()}
    assert new == {"fuz": ("probable", False), "one": ("exact", True), "two": ("exact", False)}


def test_runs_are_admitted_once(spark):
    runs = spark.createDataFrame([("a", "s", "running", None, None), ("b", "s", "completed", None, None), ("c", "s", "failed", "unexpected", '{"persistenceError":1}'), ("d", "s", "failed", "timeout", '{"persistenceError":1}'), ("e", "s", "queued", None, None), ("f", "t", "running", None, None), ("g", "s", "cancelled", None, None)], "id string, source string, status string, error_class string, log string")
    fetches = spark.createDataFrame([(x, "s") for x in "abcdefgh"], "run_id string, source string")
    got = {r["run_id"]: r["refused"] for r in ingesting.admit_runs(fetches, runs).collect()}
    assert got == {"a": None, "b": "finalized", "c": None, "d": "finalized", "e": "not_running", "f": "wrong_source", "g": "finalized", "h": "not_found"}


def test_from_payloads_to_listings(spark, payloads):
    """Two runs of one board: a landed file each, the second with a posting changed and one less sure of its employer."""
    first = payloads(a={"jobs": [job(1), job(2, title="Senior Director", content="lead", departments=[], location={"name": "Boston, MA"}, application_deadline=None)]})
    rows = jobs_json.postings(first, "labco", now()).unionByName(jobs_json.postings(payloads(b={"jobs": [job(1, title="Genomics Research Intern")]}).where("path like '%b.json'"), "labco", now()))
    run = F.when(F.col("path").endswith("a.json"), "r1").otherwise("r2")
    p = rows.where("issue is null").select(run.alias("run_id"), "identity_key", F.row_number().over(resolve.Window.orderBy("path", "identity_key")).cast("bigint").alias("seq"), F.when(run == "r1", F.expr("timestamp '2026-07-01 10:00:00'")).otherwise(F.expr("timestamp '2026-07-02 10:00:00'")).alias("observed_at"), F.col("material_hash").alias("hash"), F.col("score.total").alias("score"), F.lit("open").alias("status"), F.to_json(F.struct("title", "location")).alias("content"), F.lit("Lab Company Inc.").alias("employer"), F.col("title_raw").alias("title"), "canonical_url", F.col("location_raw").alias("location"), "focus_area", F.col("closes_at").alias("deadline"), *[F.lit(None).cast("string").alias(c) for c in ("eligibility", "deadline_text", "paid_status", "application_type", "source_status_raw")])
    fetches = spark.createDataFrame([("r1", "src", True, 2, 0, 0), ("r2", "src", True, 1, 0, 1), ("r3", "src", True, 1, 0, 0)], "run_id string, source string, ok boolean, seen bigint, issues int, skipped int")
    runs = spark.createDataFrame([(r, "src", s, None, None) for r, s in (("r1", "running"), ("r2", "running"), ("r3", "completed"))], "id string, source string, status string, error_class string, log string")
    sources = spark.createDataFrame([("src", None)], "id string, company_id string")
    companies = spark.createDataFrame([("c1", "else")], "id string, name string")
    none = spark.createDataFrame([], f"id string, company_id string, status string, review_status string, public_safe boolean, dedupe_key string, family_key string, {FLAGS}")
    r = ingesting.persist(fetches, p, runs, sources, companies, none)
    assert {tuple(x) for x in r.runs.collect()} == {("r1", "src", "completed", 2, 2, 0, 0, 1, 0), ("r2", "src", "partial", 1, 0, 1, 0, 1, 0)}
    assert [x["name_key"] for x in r.new_companies.collect()] == ["lab company"]
    assert sorted(x["action"] for x in r.actions.collect()) == ["insert", "none"]
    made = r.created.first()
    assert r.created.count() == 1 and (made["title"], made["status"], made["public_safe"]) == ("Genomics Research Intern", "needs_review", False) and made["company_id"] == r.new_companies.first()["id"]
    assert [(x["match_type"], x["is_primary"]) for x in r.links.collect()] == [("exact", True)]
    diffs = {x["field_diff"] for x in r.ingest.versions.where("run_id = 'r2'").collect()}
    assert diffs == {'{"title":{"before":"genomics intern","after":"genomics research intern"}}'}


def test_a_company_task_for_each_fuzzy_row(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Company Name,Title,Link\nAcme Laboratories,Chemist,https://a.example.com/1\nAcme Laboratories,Analyst,https://a.example.com/2\nAcme Laboratories,Old,\n")
    drafts = csv_rows.drafts(csv_rows.read_csv(spark, str(tmp_path / "x.csv")))
    companies = spark.createDataFrame([("c1", "acme laboratory")], "id string, name_key string")
    key = next(r["dedupe_key"] for r in drafts.collect() if r["title"] == "Old")
    old = spark.createDataFrame([{"id": "o1", "company_id": "c1", "review_status": "pending", "public_safe": False, **dict.fromkeys(merge.FLAGGED), "title": "Old", "posting_url": "https://kept.example.com/", "dedupe_key": key, "family_key": "f"}], f"id string, company_id string, review_status string, public_safe boolean, dedupe_key string, family_key string, {FLAGS}")
    r = importing.import_csv(drafts, companies, old, now())
    assert r.tasks.where("type = 'possible_duplicate_company'").count() == 3
    assert [x["posting_url"] for x in r.updated.collect()] == ["https://kept.example.com/"]


def test_alike_new_companies_in_order(spark):
    names = ["brand new labs", "brand new lab", "other house", "brand new labz", "other houses", "quite apart"]
    drafts = spark.createDataFrame([(i + 2, n, None) for i, n in enumerate(names)], "row_number int, company_key string, error string")
    got = {r["company_key"]: (r["kind"], r["company_id"]) for r in importing.resolve_companies(drafts, spark.createDataFrame([], "id string, name_key string")).collect()}
    assert [got[n][0] for n in names] == ["new", "fuzzy", "new", "fuzzy", "fuzzy", "new"]
    assert got["brand new lab"][1] == got["brand new labz"][1] == got["brand new labs"][1] and got["other houses"][1] == got["other house"][1]


def test_payloads_by_content(spark, tmp_path):
    bodies = ["a\nb\r\n", "", "é 日本\n", "a\nb\r\n"]
    rows = spark.createDataFrame([("s", f"r{i % 3}", f"u{i}", b) for i, b in enumerate(bodies)] + [("s", "r9", "u", None)], "source_id string, run_id string, url string, body string")
    stored = sinks.payload_rows(rows)
    for _ in range(2):  # again, as after a run that broke off
        sinks.write_payloads(stored, str(tmp_path))
    for r in stored.where("body is not null").collect():
        assert sinks.read_payload(str(tmp_path), r["path"]) == r["body"]
    assert spark.read.parquet(str(tmp_path / "metadata")).columns == [c for c in stored.columns if c != "body"]


def test_company_is_published_with_its_listing(spark):
    companies = spark.createDataFrame([(i, i == 4) for i in range(1, 6)], "id int, public_safe boolean")
    rows = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None)], "id int, company_id int")
    d = spark.createDataFrame([(10, "approve", "open_verified", True), (11, "approve", "open_verified", False), (12, "approve", "expired", True), (13, "approve", "open_unverified", True)], "id int, action string, target_status string, make_company_public boolean")
    assert {r["id"] for r in merge.publish_companies(companies, rows, d).where("public_safe").collect()} == {1, 4}


def test_similar_names_within_groups(spark):
    from tests.test_functions import plain_dice

    rows = [(g, n) for g in ("x", "y", None) for n in ("lab intern", "lab interns", "lab internship", "chemist", "ab", "a", "", None)] + [("z", "lab interns"), ("z", "laboratory intern")]
    df = spark.createDataFrame(rows, "g string, name string")
    got = {(r["g"], r["l"], r["r"]) for r in resolve.similar_names(df, df, 0.8, "g").where("g is not null").collect()}
    assert got == {(g, a, b) for g, a in rows for h, b in rows if g and g == h and a is not None and b is not None and (a == b or plain_dice(a, b) >= 0.8)}


def test_components(spark):
    from spindrift.operators.graph import components

    edges = [(i, i + 1) for i in range(40, 90)] + [(1, 2), (3, 2), (9, 9), (None, 4), (7, 5), (100, 7)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 40 for i in range(41, 91)} | {2: 1, 3: 1, 7: 5, 100: 5} | {i: 200 for i in range(201, 260)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_names_of_many_groups_meet_once(spark):
    rows = [(f"g{i}", n) for i in range(300) for n in ("research intern summer 1998", "research intern summer 1998 ii")]
    df = spark.createDataFrame(rows, "g string, name string")
    found = resolve.similar_names(df, df, 0.8, "g")
    assert found.count() == 1200 and most_rows(found) <= 2400


@pytest.mark.parametrize("totals", [(9, 9, 9), (9, 10), (9, 9, 10)])
def test_every_way_to_names_of_groups(spark, monkeypatch, totals):
    from tests.test_functions import plain_dice

    rows = {(f"g{i % 7}", f"{a} intern {b}{i % 5}") for i in range(60) for a, b in (("lab", "x"), ("labs", "yy"), ("field", ""))}
    df = spark.createDataFrame(sorted(rows), "g string, name string")
    given = iter(totals)
    monkeypatch.setattr(resolve, "_total", lambda *_: next(given))
    got = [tuple(r)[:3] for r in resolve.similar_names(df, df.where("g <> 'g3'"), 0.8, "g").collect()]
    assert next(given, None) is None
    assert sorted(got) == sorted((g, a, b) for g, a in rows for h, b in rows if g == h != "g3" and (a == b or plain_dice(a, b) >= 0.8))


def test_keys_come_before_alike_titles(spark):
    """A draft that a key has matched isn't compared by title; one of two under one title still gets the alike listing."""
    columns = "posting_url string, dedupe_key string, family_key string, title string, company_id string"
    drafts = spark.createDataFrame([("a", "u1", "x", "x", "Lab Intern", "c"), ("b", None, "x", "x", "Lab Intern", "c"), ("d", None, "x", "x", None, "c"), ("e", None, "x", "x", "Lab Intern", None)], "draft_id string, " + columns)
    e = spark.createDataFrame([(1, "u1", "k", "f", "zzz", "z"), (2, "u2", "k", "f", "lab interns", "c"), (3, "u3", "k", "f", "lab intern", "c"), (4, "u4", "k", "f", "LAB INTERN", "c")], "id bigint, " + columns)
    got = {r["draft_id"]: (r["kind"], r["opportunity_id"], r["score"]) for r in resolve.match_opportunity(drafts, e).collect()}
    assert got == {"a": ("same_url", 1, None), "b": ("fuzzy", 3, 1.0), "d": ("none", None, None), "e": ("none", None, None)}
