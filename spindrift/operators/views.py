"""Read path: privacy-projecting views, board search, sorts, buckets, counts and the claim of queued runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.dates import days_until
from spindrift.functions.text import search_term

VISIBLE = ("open_unverified", "open_verified")


def visible(public_safe: Column, review_status: Column, status: Column) -> Column:
    """What the public may see; unknown counts as no."""
    return public_safe & (review_status == "approved") & status.isin(*VISIBLE)


def public_opportunities(opportunities: DataFrame, companies: DataFrame, sources: DataFrame) -> DataFrame:
    """Visible listings with company, and the source's name only where the source itself is public."""
    o, c, s = opportunities.alias("o"), companies.alias("c"), sources.alias("s")
    shown = o.where(visible(F.col("o.public_safe"), F.col("o.review_status"), F.col("o.status")))
    joined = shown.join(c, F.col("o.company_id") == F.col("c.id"), "inner").join(s, (F.col("o.source_id") == F.col("s.id")) & F.col("s.public_safe"), "left")
    hidden = {"public_safe", "review_status", "source_id", "private_notes"}
    return joined.select(*[F.col(f"o.{x}").alias(x) for x in opportunities.columns if x not in hidden], F.col("c.name").alias("company_name"), F.col("s.name").alias("source_name"))


def public_companies(companies: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Companies with the number of their visible listings, 0 where there is none."""
    o = opportunities.where(visible(F.col("public_safe"), F.col("review_status"), F.col("status"))).groupBy(F.col("company_id").alias("__c")).agg(F.count("*").alias("__n"))
    return companies.where("public_safe").join(o, F.col("id") == F.col("__c"), "left").select(*companies.columns, F.coalesce("__n", F.lit(0)).cast("bigint").alias("open_count"))


def mask(flag: Column, value: Column) -> Column:
    """The value where its owner consents, null elsewhere."""
    return F.when(flag, value)


def search(df: DataFrame, term: str | None, *columns: str) -> DataFrame:
    """Rows in any of whose columns the sanitized term occurs, in any case; all rows without a term."""
    clean = search_term(term)
    if not clean:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c)).contains(clean.lower())
    return df.where(hit)


SORTS = {"deadline": ("deadline", True), "newest": ("first_seen_at", False), "company": ("company_name", True), "relevance": ("relevance_score", False)}


def board(df: DataFrame, term: str | None = None, sort: str = "relevance", paid: str | None = None, limit: int = 200) -> DataFrame:
    """One page of the board. Unknown sorts fall back to relevance; nulls come last; ``id`` breaks ties."""
    out = search(df, term, "title", "company_name")
    if paid in ("paid", "stipend", "unknown", "unpaid"):
        out = out.where(F.col("paid_status") == paid)
    column, rising = SORTS.get(sort, SORTS["relevance"])
    order = F.col(column).asc_nulls_last() if rising else F.col(column).desc_nulls_last()
    return out.orderBy(order, "id").limit(limit)


def bucket(deadline: Column, first_seen: Column, now: Column) -> Column:
    """closing (0 to 14 whole days left), else fresh (seen less than 7 days ago), else rest."""
    fresh = F.unix_millis(now) - F.unix_millis(first_seen.cast("timestamp")) < 7 * 86_400_000
    return F.when(days_until(deadline, now).between(0, 14), "closing").when(fresh, "fresh").otherwise("rest")


def claim(runs: DataFrame, sources: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """The queued runs to take next: due, of enabled sources, by priority, due time and age; ``id`` breaks ties."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must lie between 1 and 50")
    s = sources.where("enabled").select(F.col("id").alias("__s"), F.col("priority").alias("__p"))
    due = runs.where((F.col("status") == "queued") & (F.col("scheduled_for") <= now))
    return due.join(s, F.col("job_source_id") == F.col("__s")).orderBy("__p", "scheduled_for", "created_at", "id").limit(limit).drop("__s", "__p").withColumns({"status": F.lit("running"), "started_at": now})


def embed(df: DataFrame, other: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """``df`` with the row of ``other`` that its foreign key names as a struct, null where there is none."""
    o = other.select(F.col("id").alias("__e"), F.struct(*columns).alias(name))
    return df.join(o, F.col(key) == F.col("__e"), "left").drop("__e")


def maybe_single(df: DataFrame) -> dict | None:
    """The only row, or None; more than one is an error. Looks at two rows at most."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0].asDict() if rows else None


def single(df: DataFrame) -> dict:
    """The only row; none or more than one is an error."""
    row = maybe_single(df)
    if row is None:
        raise ValueError("no row")
    return row
