"""Policy-guarded merges as new table versions and delta frames: approved public rows are never altered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.state import changed_names

FLAGGED = ("title", "posting_url", "location", "eligibility", "focus_area", "deadline", "deadline_text", "paid_status", "application_type", "source_status_raw")


def insert_if_absent(table: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """``table`` and those rows of ``new`` whose key it hasn't; of several with one key the least row. Null keys conflict with none."""
    w = Window.partitionBy(*key).orderBy(*new.columns)
    void = None
    for k in key:
        void = F.col(k).isNull() if void is None else void | F.col(k).isNull()
    firsts = new.withColumn("__rn", F.row_number().over(w)).where((F.col("__rn") == 1) | void).drop("__rn")
    return table.unionByName(firsts.join(table, list(key), "left_anti").select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` take the place of those with their key; one row a key on either side is assumed."""
    o, n = table.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fresh = F.col(f"n.{key}").isNotNull()
    return joined.select(*[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in table.columns])


def update_policy(review_status: Column, public_safe: Column) -> Column:
    """touch_and_flag for what is approved and public, update_fields for all else."""
    return F.when(F.coalesce((review_status == "approved") & public_safe, F.lit(False)), "touch_and_flag").otherwise("update_fields")


def changed_flagged(left: str, right: str, fields: tuple[str, ...] = FLAGGED) -> Column:
    return changed_names([(f, F.col(f"{left}.{f}"), F.col(f"{right}.{f}")) for f in fields])


def elect_primary(links: DataFrame) -> DataFrame:
    """links (opportunity_id, posting_id, is_primary, seq): a pair counts once; each opportunity has one primary link,
    the one it has, else the first to come."""
    once = links.groupBy("opportunity_id", "posting_id").agg(F.max("is_primary").alias("was"), F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("opportunity_id").orderBy(F.desc("was"), "seq", "posting_id"))
    return once.select("opportunity_id", "posting_id", (rank == 1).alias("is_primary"))


def decide(rows: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Officers' decisions (id, action, target_status, duplicate_of, notes) applied to listings.

    approve sets a visible status and makes the row public; reject and duplicate take it out of sight. A target status
    that an action doesn't allow leaves the row as it is.
    """
    d = decisions.select(F.col("id").alias("__id"), "action", "target_status", F.col("duplicate_of").alias("__of"), "notes")
    j = rows.join(d, F.col("id") == F.col("__id"), "left")
    yes = F.coalesce((F.col("action") == "approve") & F.col("target_status").isin("open_unverified", "open_verified"), F.lit(False))
    no = F.coalesce((F.col("action") == "reject") & F.col("target_status").isin("hidden", "not_relevant"), F.lit(False))
    twin = F.coalesce((F.col("action") == "duplicate") & F.col("__of").isNotNull(), F.lit(False))
    checked = F.when(F.col("target_status") == "open_verified", now)
    out = j.withColumns({
        "status": F.when(yes | no, F.col("target_status")).when(twin, "duplicate").otherwise(F.col("status")),
        "review_status": F.when(yes, "approved").when(no, "rejected").otherwise(F.col("review_status")),
        "public_safe": F.when(yes, True).when(no | twin, False).otherwise(F.col("public_safe")),
        "review_notes": F.when(yes, F.when(F.trim("notes") != "", F.trim("notes"))).otherwise(F.col("review_notes")),
        "last_checked_at": F.when(yes, checked).otherwise(F.col("last_checked_at")),
        "duplicate_of": F.when(twin, F.col("__of")).otherwise(F.col("duplicate_of")),
    })
    return out.select(*rows.columns)


def create_pending(table: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose dedupe_key ``table`` hasn't, one a key, always unreviewed and out of sight, whatever they said."""
    forced = new.withColumns({"status": F.lit("needs_review"), "review_status": F.lit("pending"), "public_safe": F.lit(False)})
    w = Window.partitionBy("dedupe_key").orderBy(*[c for c in new.columns if c != "dedupe_key"])
    firsts = forced.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return firsts.join(table.select("dedupe_key"), "dedupe_key", "left_anti").select(*new.columns)


def quick_add(matches: DataFrame) -> DataFrame:
    """What adding single listings by hand does, from their matches (draft_id, kind, opportunity_id): an exact match is an
    error, a family or fuzzy one inserts and flags, none inserts."""
    exact = F.col("kind").isin("same_url", "strict_key")
    return matches.select("draft_id", F.when(exact, "error").otherwise("insert").alias("action"), F.when(F.col("kind") == "family", "possible_repost").when(F.col("kind") == "fuzzy", "possible_duplicate").alias("task"), F.when(exact, F.col("opportunity_id")).alias("existing_id"))


#: Listings in these states are never altered by a feed, whatever their review says.
PROTECTED = ("closed", "expired", "broken_link", "hidden", "duplicate", "not_relevant", "archive_only")


def may_alter(status: Column, review_status: Column, public_safe: Column) -> Column:
    """Whether a feed may write a listing's fields: not decided on by an officer, not in a protected state, not approved and public."""
    return ~F.coalesce(review_status.isin("approved", "rejected"), F.lit(False)) & ~F.coalesce(status.isin(*PROTECTED), F.lit(False)) & (update_policy(review_status, public_safe) == "update_fields")


def publish_companies(companies: DataFrame, rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``companies`` (id, public_safe, ...) with those made public whose listing (id, company_id) an approval asks it for
    (``make_company_public``). Approvals that name no visible status ask for nothing."""
    asked = decisions.where("action = 'approve' and target_status in ('open_verified', 'open_unverified') and make_company_public").select(F.col("id").alias("__id"))
    public = rows.join(asked, F.col("id") == F.col("__id"), "left_semi").where("company_id is not null").select(F.col("company_id").alias("__company")).distinct()
    j = companies.join(public, F.col("id") == F.col("__company"), "left")
    return j.withColumn("public_safe", F.col("__company").isNotNull() | F.col("public_safe")).select(*companies.columns)


def stamp_updates(before: DataFrame, after: DataFrame, key: str, now: Column) -> DataFrame:
    """``after`` with ``updated_at`` set to ``now`` on rows that were written: new ones, and those in which any column differs."""
    columns = [c for c in after.columns if c not in (key, "updated_at")]
    old = before.select(F.col(key).alias("__key"), F.col("updated_at").alias("__at"), F.struct(*columns).alias("__old"))
    j = after.join(old, F.col(key) == F.col("__key"), "left")
    same = F.col("__key").isNotNull() & F.struct(*columns).eqNullSafe(F.col("__old"))
    return j.withColumn("updated_at", F.when(same, F.col("__at")).otherwise(now)).select(*after.columns)
