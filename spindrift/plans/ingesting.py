"""Feed ingestion end to end: payloads to postings, observations, versions, tasks, counters and the bridge to listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import company_key, title_family, title_key
from spindrift.operators import state
from spindrift.operators.merge import FLAGGED, changed_flagged, may_alter
from spindrift.operators.resolve import feed_company, match_opportunity
from spindrift.session import materialize


@dataclass
class Ingest:
    outcomes: DataFrame
    postings: DataFrame
    versions: DataFrame
    tasks: DataFrame
    counters: DataFrame


def ingest(observations: DataFrame, seed: DataFrame | None = None, open_tasks: DataFrame | None = None, threshold: int = state.THRESHOLD) -> Ingest:
    """All that a batch of observations writes, from one window over them."""
    done = state.outcomes(observations, seed, threshold)
    return Ingest(done, state.latest_state(done), state.versions(done), state.tasks(done, open_tasks), state.counters(done))


MATCHABLE_NOT = ("archive_only", "duplicate", "hidden", "not_relevant")


def keyed_drafts(postings: DataFrame) -> DataFrame:
    """``postings`` with what a listing made of each would be matched by."""
    name = F.coalesce(company_key(F.col("employer")), F.lit("unknown-company"))
    return postings.withColumns({"draft_id": F.col("identity_key"), "posting_url": F.col("canonical_url"), "dedupe_key": F.concat_ws("|", name, title_key(F.col("title")), F.coalesce("canonical_url", F.lit(""))), "family_key": F.concat_ws("|", name, title_family(F.col("title")))})


def bridge(postings: DataFrame, opportunities: DataFrame) -> DataFrame:
    """What each observed posting does to the curated listings: (identity_key, action, opportunity_id, changed, task, link_type, primary).

    Listings out of use don't match. A family or fuzzy match is linked and flagged, without an insert. An exact one updates
    where a feed may alter the listing; a listing that is approved, rejected, closed, expired or broken is only touched, with a
    task where a flagged field differs or the posting's content is new (``material_changed``). No match creates a pending
    listing where the ``score`` reaches the threshold, else nothing ("none"); a fuzzy ``company_kind`` makes that a task.

    postings: identity_key, employer, title, canonical_url, company_id and the flagged fields; material_changed (false), score
    (enough) and company_kind (exact) may be absent. All are matched against the listings as they were before; of those
    that create a listing under one strict key, all link to one.
    """
    absent = {"material_changed": F.lit(False), "score": F.lit(state.THRESHOLD), "company_kind": F.lit("exact")}
    postings = postings.withColumns({k: v for k, v in absent.items() if k not in postings.columns})
    open_ = opportunities.where(~F.col("status").isin(*MATCHABLE_NOT))
    keyed = keyed_drafts(postings)
    found = match_opportunity(keyed.select("draft_id", "posting_url", "dedupe_key", "family_key", "title", "company_id"), open_)
    e = open_.select(F.col("id").alias("__id"), F.struct("status", "review_status", "public_safe", *FLAGGED).alias("e"))
    j = keyed.select("identity_key", "draft_id", "dedupe_key", F.struct("score", "company_kind", "material_changed", *FLAGGED).alias("d")).join(found.select(F.col("draft_id").alias("__d"), "kind", "opportunity_id"), F.col("draft_id") == F.col("__d")).join(e, F.col("opportunity_id") == F.col("__id"), "left")
    exact, none = F.col("kind").isin("same_url", "strict_key"), F.col("kind") == "none"
    touch = exact & ~may_alter(F.col("e.status"), F.col("e.review_status"), F.col("e.public_safe"))
    enough = F.coalesce(F.col("d.score") >= state.THRESHOLD, F.lit(False))
    changed = changed_flagged("d", "e")
    action = F.when(touch, "touch").when(exact, "update").when(none & enough, "insert").when(none, "none").otherwise("link")
    news = (F.size(changed) > 0) | F.coalesce(F.col("d.material_changed"), F.lit(False))
    task = F.when(touch & news, "source_changed").when(F.col("kind") == "family", "possible_repost").when(F.col("kind") == "fuzzy", "possible_duplicate").when(none & enough & (F.col("d.company_kind") == "fuzzy"), "possible_duplicate")
    created = F.sha2(F.concat(F.lit("opportunity|"), "dedupe_key"), 256)
    link = F.when(exact | (none & enough), "exact").when(F.col("kind") == "family", "annual_family").when(F.col("kind") == "fuzzy", "probable")
    target = F.when(none & enough, created).otherwise(F.col("opportunity_id").cast("string"))
    return j.select("identity_key", action.alias("action"), target.alias("opportunity_id"), F.when(touch, changed).alias("changed"), task.alias("task"), link.alias("link_type"), F.coalesce(link == "exact", F.lit(False)).alias("primary"))


def new_links(actions: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Links (opportunity_id, posting_id, match_type, is_primary) that ``bridge`` adds: a pair that exists stays as it is, and only
    an exact match of a listing without a primary link becomes its primary one, the least posting of several."""
    want = actions.where("link_type is not null").select("opportunity_id", F.col("identity_key").alias("posting_id"), F.col("link_type").alias("match_type"), "primary").dropDuplicates(["opportunity_id", "posting_id"])
    taken = F.lit(False)
    if links is not None:
        have = links.groupBy("opportunity_id").agg(F.max("is_primary").alias("__taken"))
        want = want.join(links.select("opportunity_id", "posting_id"), ["opportunity_id", "posting_id"], "left_anti").join(have, "opportunity_id", "left")
        taken = F.coalesce("__taken", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("opportunity_id").orderBy(F.desc("primary"), "posting_id"))
    return want.select("opportunity_id", "posting_id", "match_type", (F.col("primary") & ~taken & (rank == 1)).alias("is_primary"))


def may_resume(status: Column, error_class: Column, log: Column) -> Column:
    """Runs that may be worked on: running ones, and failed ones whose unexpected failure was in writing results."""
    return (status == "running") | ((status == "failed") & (error_class == "unexpected") & F.coalesce(log.rlike("persistenceError|persistence_error"), F.lit(False)))


def admit_runs(fetches: DataFrame, runs: DataFrame) -> DataFrame:
    """fetches (run_id, source, ...) with ``refused``: null where the run may be persisted, else why not.

    runs: id, source, status, error_class, log. A run that is unknown, of another source, finalized (completed, partial or
    cancelled, or failed beyond resuming) or not running yet is refused, so that nothing is written twice.
    """
    r = runs.select(F.col("id").alias("__run"), F.col("source").alias("__source"), F.col("status").alias("__status"), F.col("error_class").alias("__class"), F.col("log").alias("__log"))
    j = fetches.join(r, F.col("run_id") == F.col("__run"), "left")
    over = F.col("__status").isin("completed", "partial", "cancelled", "failed")
    why = F.when(F.col("__run").isNull(), "not_found").when(F.col("__source") != F.col("source"), "wrong_source").when(F.coalesce(may_resume(F.col("__status"), F.col("__class"), F.col("__log")), F.lit(False)), None).when(over, "finalized").otherwise("not_running")
    return j.select(*fetches.columns, why.alias("refused"))


@dataclass
class Persisted:
    """What persisting fetches writes."""

    runs: DataFrame
    ingest: Ingest
    new_companies: DataFrame
    actions: DataFrame
    created: DataFrame
    links: DataFrame


def persist(fetches: DataFrame, postings: DataFrame, runs: DataFrame, job_sources: DataFrame, companies: DataFrame, opportunities: DataFrame, seed: DataFrame | None = None, open_tasks: DataFrame | None = None, links: DataFrame | None = None, threshold: int = state.THRESHOLD) -> Persisted:
    """A feed's whole way: fetches of admitted runs to observations, versions, tasks, companies, listings, links and final runs.

    fetches: run_id, source, ok, seen, issues, skipped. postings: run_id, identity_key, seq, observed_at, hash, score, status, content
    (JSON), employer, title, canonical_url and the flagged fields; job_sources: id (as source), company_id; companies: id, name. Only
    postings of fetches that went well are observed; of those that aren't stale the last one of each identity goes on to
    the listings. A run is final as failed, partial or completed, with its counters, all zero where the fetch failed.
    """
    admitted = materialize(admit_runs(fetches, runs), "fetches")
    go = admitted.where("refused is null")
    rows = postings.join(go.where("ok").select("run_id", "source"), "run_id")
    i = ingest(rows, seed, open_tasks, threshold)
    done = materialize(i.outcomes, "outcomes")
    i = Ingest(done, state.latest_state(done), state.versions(done), state.tasks(done, open_tasks), state.counters(done))
    fresh = done.where("not stale").withColumn("__rn", F.row_number().over(Window.partitionBy("source", "identity_key").orderBy(F.desc("seq")))).where("__rn = 1").drop("__rn")
    fresh = fresh.withColumn("employer_key", F.coalesce(company_key(F.col("employer")), F.lit("")))
    key = F.concat_ws("\u0001", "source", "identity_key")
    resolved = feed_company(fresh.select(key.alias("identity_key"), F.col("source").alias("job_source_id"), F.col("employer_key").alias("employer")), job_sources, companies)
    own = F.sha2(F.concat(F.lit("company|"), "employer_key"), 256)
    known = fresh.withColumn("__key", key).join(resolved.select(F.col("identity_key").alias("__k"), F.col("company_id").alias("__company"), F.col("kind").alias("company_kind")), F.col("__key") == F.col("__k"))
    known = known.withColumn("company_id", F.when(F.col("company_kind") == "new", own).otherwise(F.col("__company").cast("string"))).withColumn("material_changed", F.col("changed"))
    known = materialize(known.drop("__key", "__k", "__company"), "bridged")
    new_companies = known.where("company_kind = 'new'").groupBy("company_id").agg(F.min("employer_key").alias("name_key"), F.min("employer").alias("name")).select(F.col("company_id").alias("id"), "name_key", "name", F.lit(False).alias("public_safe"))
    actions = materialize(bridge(known.drop("status"), opportunities.withColumn("company_id", F.col("company_id").cast("string"))), "actions")
    drafts = keyed_drafts(known).join(actions.where("action = 'insert'").select("identity_key", F.col("opportunity_id").alias("id")), "identity_key")
    created = drafts.groupBy("id").agg(F.min_by(F.struct("company_id", *FLAGGED, "dedupe_key", "family_key", "score"), "identity_key").alias("d")).select("id", "d.*", F.lit("needs_review").alias("status"), F.lit("pending").alias("review_status"), F.lit(False).alias("public_safe"))
    n = ("seen", "new", "changed", "unchanged", "reviewed", "stale")
    counted = i.counters.select("run_id", *[F.col(c).alias(f"__{c}") for c in n])
    final = go.join(counted, "run_id", "left").select("run_id", "source", state.final_status(F.col("ok"), F.col("issues"), F.col("skipped")).alias("status"), "seen", *[F.coalesce(f"__{c}", F.lit(0)).cast("bigint").alias(c) for c in n if c != "seen"])
    return Persisted(final, i, new_companies, actions, created, new_links(actions, links))
