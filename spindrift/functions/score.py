"""Two additive scorers with itemized reasons, and a personal bonus; rules are data, scores are sums of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.dates import days_until
from spindrift.functions.text import word

LOCAL = "ca|california|carson|hybrid|irvine|long beach|los angeles|orange county|remote|torrance"
STUDENTS = "all majors|bachelor|freshman|junior|senior|sophomore|students|undergrad|undergraduate"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _reasons(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda r: r.isNotNull())


def curated_score(deadline: Column, deadline_text: Column, paid: Column, location: Column, eligibility: Column, focus: Column, url: Column, now: Column, priority: tuple[str, ...] = ()) -> Column:
    """struct(score 0..100, reasons) of a curated row: base 40 and seven rules, reasons "+15: ..." in their order.

    "ca" is a bare substring, so "Chicago" is local; a deadline of today counts as passed (the day begins at midnight UTC).
    """
    days = days_until(deadline, now)
    say = lambda points, *text: F.when(points != 0, F.concat(F.when(points > 0, "+").otherwise(""), points.cast("string"), F.lit(": "), *text))
    n = lambda v: F.lit(v)
    rolling = deadline.isNull() & _text(deadline_text).rlike("(?i)ongoing|rolling|until filled")
    when_points = F.when(days < 0, -30).when(days <= 7, 5).when(days <= 60, 15).when(days.isNotNull(), 10).when(rolling, 10).otherwise(-5)
    when_text = (
        F.when(days < 0, F.concat(n("deadline passed "), (-days).cast("string"), n("d ago")))
        .when(days <= 7, F.concat(n("deadline in "), days.cast("string"), n("d (urgent but applicable)")))
        .when(days <= 60, F.concat(n("deadline in "), days.cast("string"), n("d")))
        .when(days.isNotNull(), F.concat(n("deadline in "), days.cast("string"), n("d (plenty of time)")))
        .when(rolling, "rolling deadline")
        .otherwise("no deadline information")
    )
    pay_points = F.when(paid == "paid", 15).when(paid == "stipend", 10).when(paid == "unpaid", -5).otherwise(0)
    pay_text = F.when(paid == "paid", "paid position").when(paid == "stipend", "stipend offered").otherwise("unpaid")
    place = F.lower(_text(location))
    place_points = F.when((place != "") & place.rlike(LOCAL), 10).when(place == "", -3).otherwise(0)
    place_text = F.when(place == "", "no location listed").otherwise(F.concat(n("accessible location ("), location, n(")")))
    who = F.lower(_text(eligibility))
    open_points = F.when(who.rlike(STUDENTS), 10).otherwise(0)
    closed_points = F.when(who.rlike("graduate students? only|masters? only|phd only"), -15).otherwise(0)
    area = F.lower(_text(focus))
    wanted = F.lit(False)
    for p in priority:
        wanted = wanted | area.contains(p.lower())
    area_points = F.when((area != "") & wanted, 10).otherwise(0)
    link_points = F.when(_text(url) == "", -10).otherwise(0)
    rules = [
        (when_points, when_text), (pay_points, pay_text), (place_points, place_text), (open_points, n("eligibility matches undergraduates")),
        (closed_points, n("restricted to graduate students")), (area_points, F.concat(n("priority focus area ("), focus, n(")"))), (link_points, n("no application link")),
    ]
    total = n(40)
    for points, _ in rules:
        total = total + points
    return F.struct(F.least(n(100), F.greatest(n(0), total)).alias("score"), _reasons(*[say(p, t) for p, t in rules]).alias("reasons"))


def _any_of(terms: str) -> str:
    """Alternation of literal terms, given with bars between."""
    return "|".join(re.escape(t) for t in terms.split("|"))


STRONG = _any_of("biochemistry|bioinformatics|biomanufacturing|biomedical|bioprocess|bioscience|biotech|biotechnology|cell biology|clinical research|clinical trial|crispr|drug discovery|epidemiology|flow cytometry|gene edit|genetic engineer|genomics|immunology|life science|life sciences|medical research|metabolomics|microbiology|molecular biology|neuroscience|oncology|pcr|pharmaceutical|pharmacology|proteomics|public health|regenerative|sequencing|stem cell|transcriptomics|virology")
MODERATE = _any_of("analytical|assay|biology|biophysics|chemistry|data science|lab assistant|lab tech|laboratory|pathology|quality assurance|regulatory affairs|research|research assistant|research associate|science intern|scientist|toxicology")
DEPARTMENTS = _any_of("bioinformatics|biology|cell therapy|chemistry|clinical|discovery|genomics|manufacturing sciences|medical affairs|nonclinical|preclinical|process development|quality|r&d|regulatory|research|research and development|science|translational")
UNRELATED = _any_of("accounting & finance|call center|customer service|food & beverage|food service|graphic design|hospitality|hr|human resources|interior design|legal|marketing|real estate|retail|sales|social media|supply chain|warehouse")
NEARBY = word("anaheim|burbank|camarillo|carson|cerritos|compton|culver city|el segundo|fullerton|gardena|glendale|hawthorne|inglewood|irvine|la jolla|long beach|los angeles|manhattan beach|orange county|pasadena|pomona|san clemente|san diego|santa ana|santa monica|socal|south bay|southern california|thousand oaks|torrance|ventura")
UNDERGRADUATE = _any_of("all majors|ba student|bachelor|bachelor's|bs student|college junior|college senior|college students|current students|freshman|junior standing|junior year|pursuing a bachelor|pursuing a degree|rising junior|rising senior|senior standing|senior year|sophomore|undergrad|undergraduate|university students")
RECENT = _any_of("0-1 year|0-2 year|entry level|entry-level|new grad|new graduates|no experience required|recent graduate")
SENIOR_STRONG = _any_of("chief|director|distinguished|group lead|head of|principal|senior director|staff engineer|vice president|vp ")
SENIOR_SOME = _any_of(" iii | iv | senior |lead |manager|sr |sr.")
GRADUATE_ONLY = _any_of("doctoral students only|graduate students only|must be enrolled in a graduate program|phd students only")
_PHD = r"ph\.?d\.?"
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: ``\b`` by ASCII rules: between a word character and another one or an end.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
DEGREE_NEEDED = [
    rf"{_B}requires?\s+a?\s*{_PHD}{_EDGE}", rf"{_B}must\s+have\s+a?\s*{_PHD}{_EDGE}", rf"{_B}must\s+hold\s+a\s+(?:doctorate|phd|ph\.d\.){_EDGE}", rf"{_B}minimum\s+(?:\w+\s+){{0,4}}{_PHD}{_EDGE}",
    rf"{_B}{_PHD}\s+(?:is\s+)?(?:the\s+)?minimum{_E}", rf"{_B}{_PHD}\s+(?:is\s+)?required{_E}", rf"{_B}{_PHD}\s+or\s+equivalent{_E}", rf"{_B}doctorate\s+(?:is\s+)?required{_E}", rf"{_B}(?:md|m\.d\.?)\s+required{_E}",
]
_POSTDOC = "(?:post-doc|postdoc(?:toral)?)"
_BACHELOR, _MASTER = r"(?:ba|b\.a\.|bs|b\.s\.|bachelor'?s?)", r"(?:ms|m\.s\.|msc|master'?s?)"
EITHER_DEGREE = [rf"{_B}{_BACHELOR}\s*(?:/|{_B}or{_E})\s*{_MASTER}{_EDGE}", rf"{_B}{_MASTER}\s*(?:/|{_B}or{_E})\s*{_BACHELOR}{_EDGE}", rf"{_B}bachelor'?s?\s+or\s+master'?s?\s+degree{_E}"]
MASTERS = word("graduate degree required|graduate students only|master's degree required|master's preferred|master's required|masters required|ms preferred|ms required|msc required")


def _reason(condition: Column, category: str, points: int, text: Column) -> Column:
    """A reason where ``condition`` holds, else null."""
    return F.when(condition, F.struct(F.lit(category).alias("category"), F.lit(points).alias("points"), text.alias("reason")))


def feed_score(title_raw: Column, title: Column, location: Column, department: Column, departments: Column, kind: Column, remote: Column, url: Column, description: Column, closes: Column, flags: Column, now: Column) -> Column:
    """struct(version, total 0..100, raw_total, positive, negative, flags) of a feed posting: base 40 and ten blocks.

    Only the description's first 2000 characters count. Department terms are plain substrings ("hr" is in "three").
    A date-only deadline ends with its day. ``closes`` is a date.
    """
    q = lambda before, c, after='"': F.concat(F.lit(before), _text(c), F.lit(after))
    low_title, low_norm = F.lower(_text(title_raw)), F.lower(_text(title))
    dept, depts = F.lower(_text(department)), F.lower(F.array_join(departments, " "))
    place, text = F.lower(_text(location)), F.lower(F.left(_text(description), F.lit(2000)))
    strong = low_title.rlike(STRONG)
    moderate = ~strong & low_title.rlike(MODERATE)
    shown = F.coalesce(department, F.array_join(departments, ", "))
    has_text = F.coalesce(F.trim(description), F.lit("")) != ""
    under = text.rlike(UNDERGRADUATE)
    recent = ~under & text.rlike(RECENT)
    grad_only = text.rlike(GRADUATE_ONLY)
    missing = F.array_contains(flags, "eligibility_missing") | ~has_text
    unclear = F.array_contains(flags, "eligibility_ambiguous") | (~under & ~recent & has_text & ~grad_only)
    nearby = place.rlike(NEARBY)
    top = low_title.rlike(SENIOR_STRONG)
    some = ~top & F.concat(F.lit(" "), low_norm, F.lit(" ")).rlike(SENIOR_SOME)
    waived = rf"(?i){_B}(?:{_POSTDOC}{_E}(?:\s+\w+){{0,5}}\s+not\s+(?:needed|required)|no\s+{_POSTDOC}{_E}(?:\s+\w+){{0,4}}\s+(?:is\s+)?(?:needed|required)){_E}"
    need = "(?:minimum|must|needed|required)"
    asks = rf"(?i){_B}(?:{_POSTDOC}{_E}(?:\s+\w+){{0,4}}\s+{need}|{need}{_E}(?:\s+\w+){{0,4}}\s+{_POSTDOC}){_E}"
    degree = F.concat_ws(" ", low_title, text).rlike("(?i)" + "|".join(DEGREE_NEEDED)) | low_title.rlike(word("post-doc|postdoc(?:toral)?")) | F.regexp_replace(text, waived, " ").rlike(asks)
    masters = ~degree & ~text.rlike("(?i)" + "|".join(EITHER_DEGREE)) & text.rlike(MASTERS)
    end = F.date_add(closes, 1).cast("timestamp") - F.expr("interval 1 millisecond")
    passed = F.coalesce(end < now, F.lit(False))
    soon = F.coalesce((end >= now) & ((F.unix_millis(end) - F.unix_millis(now)) / F.lit(86_400_000.0) <= 90), F.lit(False))
    lit = F.lit
    positive = [
        (strong, "biotech_relevance", 20, q('strong biotech/life-science signal in title: "', title_raw)),
        (moderate, "biotech_relevance", 10, q('moderate biotech/science signal in title: "', title_raw)),
        (dept.rlike(DEPARTMENTS) | depts.rlike(DEPARTMENTS), "biotech_relevance", 8, q('biotech/life-science department: "', shown)),
        (under, "undergrad_access", 15, lit("explicitly mentions undergraduate eligibility")),
        (recent, "undergrad_access", 8, lit("recent-graduate or entry-level language in description")),
        (kind == "internship", "role_type", 15, lit("classified as internship")),
        (kind == "fellowship", "role_type", 12, lit("classified as fellowship")),
        (kind == "research", "role_type", 8, lit("classified as research role")),
        (kind == "entry_level", "role_type", 10, lit("classified as entry-level role")),
        (remote == "remote", "geography", 10, lit("remote-eligible position")),
        ((remote == "hybrid") & nearby, "geography", 6, q('hybrid position in Southern California: "', location)),
        (~remote.isin("hybrid", "remote") & nearby, "geography", 12, q('Southern California location: "', location)),
        (soon, "deadline", 5, F.concat(lit("deadline upcoming within 90 days: "), closes.cast("string"))),
    ]
    negative = [
        (grad_only, "undergrad_access", -15, lit("description restricts eligibility to graduate students")),
        (top, "seniority", -25, q('senior-leadership title signal: "', title_raw)),
        (some, "seniority", -15, q('moderate seniority signal in title: "', title_raw)),
        (degree, "degree_req", -20, lit("PhD, MD, or postdoc credential required")),
        (masters, "degree_req", -8, lit("master's degree preferred or required")),
        (dept.rlike(UNRELATED) | depts.rlike(UNRELATED), "unrelated_dept", -20, q('department not relevant to the field: "', shown)),
        (missing | unclear, "eligibility", -5, lit("eligibility information is missing or ambiguous")),
        (_text(url) == "", "link_quality", -10, lit("no application URL available")),
        (passed, "deadline", -15, F.concat(lit("deadline has passed: "), closes.cast("string"))),
    ]
    plus, minus = (_reasons(*[_reason(*rule) for rule in rules]) for rules in (positive, negative))
    # of the conditions, not of the reasons: a query that takes no reasons needn't make them
    raw = lit(40)
    for condition, _, points, _ in positive + negative:
        raw = raw + F.when(condition, points).otherwise(0)
    all_flags = F.array_distinct(F.concat(flags, F.filter(F.array(F.when(missing, "eligibility_missing"), F.when(unclear, "eligibility_ambiguous")), lambda f: f.isNotNull())))
    return F.struct(lit(1).alias("version"), F.least(lit(100), F.greatest(lit(0), raw)).alias("total"), raw.alias("raw_total"), plus.alias("positive"), minus.alias("negative"), all_flags.alias("flags"))


def personal_bonus(focus: Column, paid: Column, location: Column, eligibility: Column, start_text: Column, title: Column, *, areas: tuple[str, ...] = (), want_paid: bool = False, want_remote: bool = False, near: bool = False, standing: str | None = None, term: str | None = None) -> Column:
    """struct(points, why): what one reader's preferences add to a listing's score."""
    rules = []
    if areas:
        rules.append((focus.isin(*areas), 15, F.concat(F.lit("matches your focus: "), focus)))
    if want_paid:
        rules.append((paid.isin("paid", "stipend"), 10, F.lit("paid, your preference")))
    if want_remote:
        rules.append((location.rlike("(?i)hybrid|remote"), 10, F.lit("remote or hybrid, your preference")))
    if near:
        rules.append((location.rlike("(?i)carlsbad|carson|irvine|long beach|los angeles|orange|torrance"), 10, F.lit("near Long Beach, your preference")))
    if standing:
        who = F.lower(_text(eligibility))
        rules.append((who.contains(standing), 10, F.lit(f"open to {standing}s")))
        if standing != "graduate":
            rules.append((~who.contains(standing) & who.rlike("all majors|all students|undergrad"), 5, F.lit("open to all undergraduates")))
    if term:
        rules.append((F.lower(F.concat_ws(" ", start_text, title)).contains(term), 8, F.lit(f"{term} term, your preference")))
    total, why = F.lit(0), F.array().cast("array<string>")
    for condition, n, text in rules:
        total = total + F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)
        why = F.concat(why, F.when(F.coalesce(condition, F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.struct(total.alias("points"), why.alias("why"))
