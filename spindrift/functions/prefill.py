"""Fields out of pasted posting text, as one projection over its lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.classify import paid_status
from spindrift.functions.dates import parse_deadline
from spindrift.functions.text import clean_text, word
from spindrift.functions.url import curated_url

LABELS = {
    "company": r"(?:company|employer|org|organization)\s*[:-]\s*",
    "location": r"(?:city|location|site|where)\s*[:-]\s*",
    "deadline_text": r"(?:apply by|closes?|deadline|due date|application deadline)\s*[:-]?\s*",
    "eligibility": r"(?:class standing|eligibility|qualifications|requirements|who can apply)\s*[:-]\s*",
    "focus_area": r"(?:area|category|department|field|focus area|team)\s*[:-]\s*",
    "start_date_text": r"(?:dates|duration|length|start date|term|timeline)\s*[:-]\s*",
    "application_type": r"(?:application method|application type|apply via|how to apply)\s*[:-]\s*",
}


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` worked out a single time, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def prefill(text: Column) -> Column:
    """struct of ten guesses; the first line that fits a field wins, all else stays null.

    The title is the first line of 8 to 90 characters without a colon that isn't a link; "X at Y" gives the company.
    Each field stands by itself, so that a query pays for those it takes.
    """
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = lambda keep: F.get(F.filter(lines, keep), F.lit(0))
    title = first(lambda x: F.length(x).between(8, 90) & ~x.rlike("(?i)^https?://") & ~x.contains(":"))
    at = r"^(.{4,60}?)\s+at\s+([A-Z][A-Za-z0-9_&.,' -]{2,50})$"
    named = lambda t: F.coalesce(t.rlike(at), F.lit(False))
    clean = lambda c: once(c, clean_text)
    labelled = lambda p: clean(F.regexp_extract(first(lambda x: x.rlike(f"(?i)^{p}.+$")), f"(?i)^{p}(.+)$", 1))
    found = {k: labelled(p) for k, p in LABELS.items()}
    due = first(lambda x: x.rlike("(?i)apply by|closes|deadline|due") & parse_deadline(x).isNotNull())
    length = F.regexp_extract(text, f"(?i){word('[0-9]+[ \\t]*(?:month|week)s?')}", 0)
    season = F.regexp_extract(text, f"(?i){word('(?:fall|spring|summer|winter)[ \\t]+20[0-9]{2}')}", 0)
    hybrid, remote = text.rlike("(?i)" + word("hybrid")), text.rlike("(?i)" + word("remote"))
    here = lambda place: F.when(place.isNotNull() & hybrid & ~place.rlike("(?i)hybrid"), F.concat(place, F.lit(" (hybrid)"))).when(place.isNull() & hybrid, "Hybrid").when(place.isNull() & remote, "Remote").otherwise(place)
    url = F.regexp_extract(text, r"(?i)https?://[^\s\"'<>)]+", 0)
    return F.struct(
        once(title, lambda t: F.when(named(t), clean_text(F.regexp_extract(t, at, 1))).otherwise(t)).alias("title"),
        F.coalesce(once(title, lambda t: F.when(named(t), clean_text(F.regexp_extract(t, at, 2)))), found["company"]).alias("company"),
        once(url, lambda u: F.when(u != "", curated_url(u))).alias("posting_url"),
        once(found["location"], here).alias("location"),
        F.coalesce(found["deadline_text"], clean(due)).alias("deadline_text"),
        paid_status(text).alias("paid_guess"),
        found["eligibility"].alias("eligibility"),
        found["focus_area"].alias("focus_area"),
        F.coalesce(found["start_date_text"], clean(length), clean(season)).alias("start_date_text"),
        found["application_type"].alias("application_type"),
    )
