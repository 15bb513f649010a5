"""CSV rows to typed drafts: headers by alias, cells cleaned and parsed, keys built, rows numbered as in the file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.classify import paid_status
from spindrift.functions.dates import parse_deadline
from spindrift.functions.text import clean_text, company_key, title_family, title_key
from spindrift.functions.url import curated_url_exact

#: Fields in the order in which headers are tried against them, and the beginnings that name each.
ALIASES = {
    "company_name": "employer|organization|company|company name",
    "title": "role|title|position|internship title|internship title position",
    "posting_url": "application link|posting url|url|link|link to posting",
    "location": "location city|city|location",
    "eligibility": "class standing|who can apply|requirements|eligibility",
    "focus_area": "category|area|field|focus area|field focus area",
    "deadline": "apply by|due date|deadline|application deadline",
    "start_date_text": "dates|term|duration|start date|start date duration",
    "paid_status": "pay|compensation|paid|paid unpaid",
    "application_type": "application method|apply via|application type",
    "source_status_raw": "state|posting status|status",
    "notes": "additional info|comments|notes",
    "date_added": "date entered|added|date added",
}


def map_headers(headers: list[str]) -> tuple[dict[str, str], list[str]]:
    """({field: header}, headers that name nothing): each header takes the first free field one of whose aliases it begins with."""
    mapping: dict[str, str] = {}
    rest = []
    for header in headers:
        plain = re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\s]", " ", header.lower())).strip()
        for field, aliases in ALIASES.items():
            if field not in mapping and plain.startswith(tuple(aliases.split("|"))):
                mapping[field] = header
                break
        else:
            rest.append(header)
    return mapping, rest


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, with row_number as in the file (the header is row 1), rows without any content left out.

    Order comes from the place in the file, so one file is read as one split; ``multiLine`` does that.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    some = F.lit(False)
    for c in df.columns:
        some = some | (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "")
    kept = df.withColumn("__at", F.monotonically_increasing_id()).where(some)
    return kept.withColumn("row_number", (F.row_number().over(Window.orderBy("__at")) + 1).cast("int")).drop("__at")


def drafts(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """One draft a row (row_number, error, typed fields, dedupe_key, family_key); error says why there is none."""
    mapping = map_headers([c for c in df.columns if c != "row_number"])[0] if mapping is None else mapping
    if not {"company_name", "title"} <= mapping.keys():
        raise ValueError("a file needs columns for company and title")
    get = lambda f: F.coalesce(F.col(f"`{mapping[f]}`"), F.lit("")) if f in mapping else F.lit("")
    text = {f: clean_text(get(f)) for f in ALIASES}
    company, title = text["company_name"], text["title"]
    error = F.when(company.isNull() & title.isNull(), "Empty row").when(company.isNull(), "Missing company name").when(title.isNull(), "Missing title")
    out = df.select(
        "row_number", error.alias("error"), company.alias("company_name"), title.alias("title"), curated_url_exact(get("posting_url")).alias("posting_url"),
        text["location"].alias("location"), text["eligibility"].alias("eligibility"), text["focus_area"].alias("focus_area"), parse_deadline(get("deadline")).alias("deadline"), text["deadline"].alias("deadline_text"),
        text["start_date_text"].alias("start_date_text"), paid_status(get("paid_status")).alias("paid_status"), text["application_type"].alias("application_type"), text["source_status_raw"].alias("source_status_raw"),
        text["notes"].alias("private_notes"), parse_deadline(get("date_added")).alias("date_added"),
    )
    key = company_key(F.col("company_name"))
    return out.withColumns({"company_key": key, "dedupe_key": F.concat_ws("|", key, title_key(F.col("title")), F.coalesce("posting_url", F.lit(""))), "family_key": F.concat_ws("|", key, title_family(F.col("title")))})
