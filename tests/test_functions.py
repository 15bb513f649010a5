"""Known values of the scalar functions, edge cases included."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import classify, dates, hashing, score, text, url
from spindrift.functions.similarity import dice


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (text.clean_text, {"  a \t b ": "a b", " ": None, "": None, None: None}),
    (text.company_key, {"Acme, Inc.": "acme", "Acme Co. Inc": "acme co", "Acme Limited": "acme limited", "Foo S.A.": "foo sa", "Café LLC": "café", None: None}),
    (text.employer_name, {"Acme, Inc.": "acme,", "Acme Co. Inc": "acme co.", "Acme Limited": "acme", "Foo S.A.": "foo s.a.", "Café LLC": "café", "": None}),
    (text.title_key, {"R&D Intern — Summer 2026": "rd intern summer 2026", "Ingeniería Intern (Fall)": "ingeniera intern fall", "Biochem &amp; Lab": "biochem amp lab"}),
    (text.title_family, {"R&D Intern — Summer 2026": "rd intern", "Ingeniería Intern (Fall)": "ingeniera intern"}),
    (text.job_title, {"R&D Intern — Summer 2026": "r d intern - summer 2026", "Ingeniería Intern (Fall)": "ingeniería intern fall", "Biochem &amp; Lab": "biochem lab", "": None}),
    (text.job_title_family, {"R&D Intern — Summer 2026": "r d intern -", "Ingeniería Intern (Fall)": "ingeniería intern"}),
    (text.decode_entities, {"&amp;lt; &#65;&#x42; &nope; &#39;": "&lt; AB &nope; '", "&amp;#39;": "'"}),
    (text.html_to_text, {"<p>a</p><script>x()</script>b&nbsp;<b>c</b>": "a b c", "<br>": None, None: None}),
    (text.initials, {"acme 3 bio labs": "AB", "42": "?"}),
    (url.curated_url_exact, {"https://example.com/": "https://example.com", "https://Example.com/a/?utm_source=x&b=a%20b#f": "https://example.com/a/?b=a+b", "https://x.com/a?b=a%20b": "https://x.com/a?b=a+b", "https://x.com/p?q=1/": "https://x.com/p?q=1%2F", "example.com/jobs?UTM_Source=1": "https://example.com/jobs?UTM_Source=1", "HTTP://X.com:80/a": "http://x.com/a", "http://x.com/a?ref=1": "http://x.com/a", "ftp://x.y": None, "not a url": None, "": None, None: None}),
    (url.canonical_url_exact, {"https://example.com/": "https://example.com/", "https://Example.com/a/?utm_source=x&b=a%20b#f": "https://example.com/a/?b=a+b", "https://x.com/a?b=a%20b": "https://x.com/a?b=a%20b", "https://x.com/p?q=1/": "https://x.com/p?q=1", "example.com/jobs?UTM_Source=1": "https://example.com/jobs", "ftp://x.y": None, "not a url": None}),
    (dates.parse_deadline, {"03/15/2026": dt.date(2026, 3, 15), "open until 3/5/26": dt.date(2026, 3, 5), "Rolling until 03/15/2026": dt.date(2026, 3, 15), "March 15, 2026": dt.date(2026, 3, 15), "June 2026": dt.date(2026, 6, 1), "02/31/2026": None, "2026-02-31": None, "Rolling": None, "TBD": None, "2026-03-15": None, "2010-03-15": dt.date(2015, 10, 3), "2026/03/15": None, "": None, None: None}),
    (dates.parse_iso_date, {"2026-07-15T23:30:00-07:00": dt.date(2026, 7, 16), "2026-07-15 10:00:00": dt.date(2026, 7, 15), "7/5/2026": dt.date(2026, 7, 5), "2026/07/05": dt.date(2026, 7, 5), "July 5, 2026": None, "2026-02-30": None, "2026-07-15T10:00:00+0700": None, None: None}),
    (dates.parse_stamp, {"2026-06-15T14:00:00-07:00": "2026-06-15T21:00:00.000Z", "2026-06-15": None, "2026-06-15T25:00:00Z": None}),
    (classify.paid_status, {"Paid": "paid", "Unpaid": "unpaid", "$18/hr": "paid", "stipend $500": "stipend", "Volunteer": "unpaid", "N/A": "unknown", "credit only": "unpaid", "unpaid stipend": "stipend", None: "unknown"}),
    (lambda c: classify.focus_area(c, F.lit(None).cast("string")), {"Cell Culture": "cell biology", "PCR": "molecular biology", "AI": "data science", "Research Intern": "research", "Immunology": None, "Antibody Lab": None, "Data Science": None, "Oncology": None}),
    (lambda c: classify.opportunity_class(c, F.lit(None).cast("string"), F.lit(None).cast("string"))["class"], {"Internship": "internship", "Interns wanted": "other", "Research Fellow": "research", "Financial Analyst": "research", "Associate Director": "other", "New grad engineer": "entry_level"}),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_known_values(spark, k):
    f, cases = CASES[k]
    assert dict(zip(cases, apply(spark, f, list(cases)))) == cases


def test_search_term():
    assert text.search_term(" a,b(c)%_\\.d ") == "a b c d" and text.search_term(" %") is None and text.search_term(None) is None


def test_board_token():
    assert url.board_token(" LabCo-1 ") == "labco-1"
    for bad in ("", "a/b", "-x", "a" * 129):
        with pytest.raises(ValueError):
            url.board_token(bad)


def test_remote_type(spark):
    none = F.lit(None).cast("string")
    cases = {"Remote": ("remote", False), "not remote": ("unknown", True), "hybrid remote": ("hybrid", False), "remote, on-site": ("unknown", True), "in person": ("onsite", False), "Lab": ("unknown", False)}
    got = apply(spark, lambda c: classify.remote_type(none, c, none), list(cases))
    assert {k: tuple(v) for k, v in zip(cases, got)} == cases
    assert tuple(apply(spark, lambda c: classify.remote_type(c, none, none), ["Lab"])[0]) == ("unknown", True)


def test_curated_score_edges(spark):
    now = F.expr("timestamp '2026-07-01 12:00:00'")
    none = F.lit(None).cast("string")
    row = lambda *c: spark.range(1).select(score.curated_score(*c, now).alias("s")).first()["s"]
    empty = row(F.lit(None).cast("date"), none, F.lit("unknown"), none, none, none, none)
    assert (empty["score"], empty["reasons"]) == (22, ["-5: no deadline information", "-3: no location listed", "-10: no application link"])
    full = row(F.lit("2026-07-01").cast("date"), none, F.lit("paid"), F.lit("Chicago, IL"), F.lit("PhD only"), none, F.lit("u"))
    assert full["score"] == 20 and full["reasons"][0] == "-30: deadline passed 1d ago"


def test_material_hash_known_value(spark):
    null = F.lit(None).cast("string")
    fields = {"titleRaw": F.lit("T"), "locationRaw": F.lit("Long Beach"), "canonicalUrl": F.lit("https://x/y"), "departments": F.array(F.lit("B"), F.lit("A")), "offices": F.array().cast("array<string>"), "closesAt": null, "deadlineKind": F.lit("hard"), "descriptionNormalized": F.lit('a "q" é — / \\ end'), "employmentType": null, "classification": F.lit("internship"), "remoteType": F.lit("unknown")}
    assert spark.range(1).select(hashing.material_hash(fields).alias("h")).first()["h"] == "1042c74cea147d786837d3d041682ee6c45ae52a577f86e500d88a04bfeabbba"


def plain_dice(a, b):
    from collections import Counter

    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("abc é", max_size=12), st.text("abc é", max_size=12)), min_size=1, max_size=60))
def test_dice_is_symmetric_and_right(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    rows = df.select("i", dice(F.col("a"), F.col("b")).alias("ab"), dice(F.col("b"), F.col("a")).alias("ba")).orderBy("i").collect()
    for r, (a, b) in zip(rows, pairs):
        assert r["ab"] == r["ba"] == pytest.approx(plain_dice(a, b))


def test_dice_known_values(spark):
    df = spark.createDataFrame([("night", "nacht"), ("aaaa", "aa"), ("a", "b"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(dice(F.col("a"), F.col("b"))).collect()] == [0.25, 0.5, 0.0, 1.0]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.sampled_from(["https://a.com/x/?utm_id=1&b=2", "a.com", "HTTP://B.com/p/#f", "https://c.com/?q=a%20b&ref=z"]), min_size=1))
def test_canonical_url_is_stable(spark, urls):
    once = apply(spark, url.canonical_url_exact, urls)
    assert apply(spark, url.canonical_url_exact, once) == once


def test_case_insensitive_key_and_board_url(spark):
    from spindrift.functions import text, url

    df = spark.createDataFrame([("  Café  BAR ",), (None,)], "x string")
    assert [r["k"] for r in df.select(text.case_insensitive_key(F.col("x")).alias("k")).collect()] == ["café bar", None]
    assert url.board_url(" LabCo ").endswith("/v1/boards/labco/jobs?content=true")
    with pytest.raises(ValueError):
        url.board_url("https://x/labco")
