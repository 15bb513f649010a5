"""CSV import end to end: drafts, companies, matching, policy; everything a run writes, as delta frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.score import curated_score
from spindrift.operators.graph import components
from spindrift.operators.merge import FLAGGED, changed_flagged, update_policy
from spindrift.operators.resolve import COMPANY_LEAST, TITLE_LEAST, match_opportunity, similar_names, tier_name
from spindrift.session import materialize


@dataclass
class Import:
    """What an import writes; ids of new rows are derived from their keys, so a repeated run gives the same ones."""

    new_companies: DataFrame
    inserted: DataFrame
    updated: DataFrame
    touched: DataFrame
    tasks: DataFrame
    audit: DataFrame
    summary: DataFrame


def resolve_companies(drafts: DataFrame, companies: DataFrame) -> DataFrame:
    """(company_key, company_id, kind, first_row): existing companies before those that earlier rows of the file created.

    A name that is no one's creates a company, which later names may match. Only pairs of alike new names are walked
    in order, by component; all else is joined. companies: id, name_key.
    """
    names = drafts.where("error is null").groupBy(F.col("company_key").alias("name")).agg(F.min("row_number").alias("first_row"))
    known = companies.select("id", F.col("name_key").alias("name"))
    pairs = similar_names(names, known, COMPANY_LEAST).join(known.withColumnRenamed("name", "r"), "r")
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("score"), "id"))
    old = pairs.withColumn("rn", rank).where("rn = 1").select(F.col("l").alias("name"), F.col("id").alias("old_id"), F.when(F.col("l") == F.col("r"), "exact").otherwise("fuzzy").alias("old_kind"), F.col("score").alias("old_score"))
    named = names.join(old, "name", "left")
    fresh = named.where("old_kind is null or old_kind = 'fuzzy'").select("name", "first_row", "old_score")
    among = similar_names(fresh, fresh, COMPANY_LEAST).where("l <> r")
    f1, f2 = fresh.select(F.col("name").alias("l"), F.col("first_row").alias("l_row"), F.col("old_score").alias("l_old")), fresh.select(F.col("name").alias("r"), F.col("first_row").alias("r_row"), F.col("old_score").alias("r_old"))
    numbered = among.join(f1, "l").join(f2, "r").where("r_row < l_row")
    # only names of one component of alike ones depend on each other; components are told by their least row
    roots = components(numbered.select(F.col("l_row").alias("a"), F.col("r_row").alias("b")))
    edges = numbered.join(roots, F.col("l_row") == F.col("node"))

    def walk(pdf):
        """Rows in order; a name follows the earlier created name it is most like, if that beats what existed before."""
        made = {r for r, old in zip(pdf["r"], pdf["r_old"]) if not old > 0}
        out = []
        for name, part in pdf.sort_values(["l_row", "score", "r_row"], ascending=[True, False, True]).groupby("l", sort=False):
            best = next(((r, score) for r, score in zip(part["r"], part["score"]) if r in made), None)
            old = part["l_old"].iloc[0]
            if best and not (old >= best[1]):
                out.append((name, best[0]))
                made.discard(name)
            elif not old > 0:
                made.add(name)
        return pdf.__class__(out, columns=["name", "follows"])

    follows = edges.groupBy("root").applyInPandas(walk, "name string, follows string")
    j = named.join(follows, "name", "left")
    own = lambda c: F.sha2(F.concat(F.lit("company|"), c), 256)
    kind = F.when(F.col("old_kind") == "exact", "exact").when(F.col("follows").isNotNull(), "fuzzy").otherwise(F.coalesce("old_kind", F.lit("new")))
    chosen = F.when(F.col("old_kind") == "exact", F.col("old_id")).when(F.col("follows").isNotNull(), own(F.col("follows"))).otherwise(F.coalesce("old_id", own(F.col("name"))))
    return j.select(F.col("name").alias("company_key"), chosen.alias("company_id"), kind.alias("kind"), "first_row")


def import_csv(drafts: DataFrame, companies: DataFrame, opportunities: DataFrame, now: Column) -> Import:
    """The file's rows in order against the state before and what earlier rows inserted.

    A row is inserted unless its URL or strict key is known already or comes earlier in the file, so which rows later
    ones can see is decided by two windows instead of a walk. opportunities: id, dedupe_key, family_key, posting_url,
    title, company_id, review_status, public_safe and the flagged fields; ids are text.
    """
    drafts = materialize(drafts, "drafts")  # each cell is parsed once; the plans below read it many times
    resolved = materialize(resolve_companies(drafts, companies), "companies")
    good = drafts.where("error is null").join(resolved.select("company_key", "company_id", F.col("kind").alias("company_kind"), "first_row"), "company_key")
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("row_number")) == 1
    urls = opportunities.where("posting_url is not null").select(F.col("posting_url").alias("__u")).distinct()
    keys = opportunities.where("dedupe_key is not null").select(F.col("dedupe_key").alias("__k")).distinct()
    seen = good.join(urls, F.col("posting_url") == F.col("__u"), "left").join(keys, F.col("dedupe_key") == F.col("__k"), "left")
    new = F.col("__u").isNull() & F.col("__k").isNull() & (F.col("posting_url").isNull() | first("posting_url")) & first("dedupe_key")
    good = materialize(seen.withColumn("is_new", new).drop("__u", "__k"), "good")
    new_id = F.sha2(F.concat(F.lit("opportunity|"), "dedupe_key"), 256)
    mine = good.where("is_new").select(new_id.alias("id"), "posting_url", "dedupe_key", "family_key", "title", "company_id", F.col("row_number").alias("born"))
    theirs = opportunities.select("id", "posting_url", "dedupe_key", "family_key", "title", "company_id", F.lit(0).alias("born"))
    wanted = good.select(F.col("row_number").alias("draft_id"), "posting_url", "dedupe_key", "family_key", "title", "company_id")
    before = match_opportunity(wanted, theirs)
    within = match_opportunity_before(wanted, mine)
    order = lambda k: F.array_position(F.array(*map(F.lit, ("same_url", "strict_key", "family", "fuzzy", "none"))), F.col(k))
    both = before.join(within.toDF("draft_id", "kind2", "opportunity_id2", "score2"), "draft_id")
    later = (order("kind2") < order("kind")) | ((F.col("kind") == "fuzzy") & (F.col("kind2") == "fuzzy") & (F.col("score2") > F.col("score")))
    match = both.select(F.col("draft_id").alias("row_number"), F.when(later, F.col("kind2")).otherwise(F.col("kind")).alias("match"), F.when(later, F.col("opportunity_id2")).otherwise(F.col("opportunity_id")).alias("matched_id"))
    score = curated_score(F.col("deadline"), F.col("deadline_text"), F.col("paid_status"), F.col("location"), F.col("eligibility"), F.col("focus_area"), F.col("posting_url"), now)
    rows = materialize(good.join(match, "row_number").withColumn("relevance", score), "rows")
    e = opportunities.select(F.col("id").alias("__id"), F.struct(*[c for c in opportunities.columns if c != "id"]).alias("e"))
    known = rows.where("match in ('same_url', 'strict_key')").join(e, F.col("matched_id") == F.col("__id"), "left")
    policy = F.when(F.col("e").isNull(), "update_fields").otherwise(update_policy(F.col("e.review_status"), F.col("e.public_safe")))
    known = known.withColumn("policy", policy).withColumn("d", F.struct(*FLAGGED))
    kept_url = F.coalesce("posting_url", "e.posting_url").alias("posting_url")  # a row without a link takes none away
    updated = known.where("policy = 'update_fields'").select("row_number", "matched_id", "match", *[kept_url if c == "posting_url" else c for c in FLAGGED if c != "title"], "relevance")
    touched = known.where("policy = 'touch_and_flag'").select("row_number", "matched_id", "match", changed_flagged("d", "e").alias("changed"))
    inserted = rows.where("match not in ('same_url', 'strict_key')").select(F.col("row_number"), new_id.alias("id"), "company_id", *FLAGGED, "dedupe_key", "family_key", "relevance", "match", "matched_id", F.lit("needs_review").alias("status"), F.lit("pending").alias("review_status"), F.lit(False).alias("public_safe"))
    task = lambda d, kind, about, notes: d.select("row_number", F.lit(kind).alias("type"), about.alias("entity_id"), notes.alias("notes"))
    tasks = task(touched.where("size(changed) > 0"), "changed_fields", F.col("matched_id"), F.array_join("changed", ", "))
    tasks = tasks.unionByName(task(inserted.where("match = 'family'"), "possible_repost", F.col("id"), F.col("matched_id")))
    tasks = tasks.unionByName(task(inserted.where("match = 'fuzzy'"), "possible_duplicate", F.col("id"), F.col("matched_id")))
    tasks = tasks.unionByName(task(rows.where("company_kind = 'fuzzy'"), "possible_duplicate_company", F.col("company_id"), F.col("company_name")))
    created = good.where("company_kind = 'new' and row_number = first_row").select(F.col("company_id").alias("id"), F.col("company_key").alias("name_key"), F.col("company_name").alias("name"))
    outcome = drafts.select("row_number", "error").join(rows.select("row_number", "match", "company_kind"), "row_number", "left").join(known.select("row_number", "policy"), "row_number", "left")
    audit = outcome.select("row_number", F.when(F.col("error").isNotNull(), "error").when(F.col("policy") == "touch_and_flag", "touched").when(F.col("policy").isNotNull(), "updated").otherwise("inserted").alias("outcome"), "error", "match")
    n = lambda o: F.count_if(F.col("outcome") == o)
    summary = audit.agg(F.count("*").alias("rows"), n("inserted").alias("inserted"), (n("updated") + n("touched")).alias("updated"), n("touched").alias("touched"), n("error").alias("errors"), F.count_if(F.col("match").isin("family", "fuzzy")).alias("flagged"))
    return Import(created, inserted, updated, touched, tasks, audit, summary)


def match_opportunity_before(wanted: DataFrame, mine: DataFrame) -> DataFrame:
    """``match_opportunity`` of each row against inserted rows of the same file that come before it; the earliest stands first."""
    # of the rows of one key, or of one title in a company, the earliest one alone can be the match
    earliest = lambda *by: mine.groupBy(*by).agg(F.min(F.struct("born", "id")).alias("m"))
    tiers = []
    for rank, key in enumerate(("posting_url", "dedupe_key", "family_key"), 1):
        firsts = earliest(F.col(key).alias("m_key"))
        tiers.append(wanted.join(firsts, (F.col(key) == F.col("m_key")) & (F.col("m.born") < F.col("draft_id"))).select("draft_id", F.col("m.id").alias("m_id"), F.col("m.born").alias("m_born"), F.lit(rank).alias("tier"), F.lit(1.0).alias("score")))
    titled = earliest(F.col("company_id").alias("m_company"), F.lower("title").alias("m_name"))
    named = lambda d, company, name: d.select(company.alias("c"), name.alias("name"))
    alike = similar_names(named(wanted, F.col("company_id"), F.lower("title")), named(titled, F.col("m_company"), F.col("m_name")), TITLE_LEAST, "c")
    fuzzy = wanted.join(alike, (F.col("company_id") == F.col("c")) & (F.lower("title") == F.col("l"))).join(titled, (F.col("c") == F.col("m_company")) & (F.col("r") == F.col("m_name")) & (F.col("m.born") < F.col("draft_id")))
    every = fuzzy.select("draft_id", F.col("m.id").alias("m_id"), F.col("m.born").alias("m_born"), F.lit(4).alias("tier"), "score")
    for t in tiers:
        every = every.unionByName(t)
    best = every.withColumn("rn", F.row_number().over(Window.partitionBy("draft_id").orderBy("tier", F.desc("score"), "m_born"))).where("rn = 1")
    kind = tier_name(F.col("tier"))
    return wanted.select("draft_id").join(best, "draft_id", "left").select("draft_id", F.coalesce(kind, F.lit("none")).alias("kind"), F.col("m_id").alias("opportunity_id"), F.when(F.col("tier") == 4, F.col("score")).alias("score"))
