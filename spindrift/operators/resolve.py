"""Entity resolution: exact, key, family and fuzzy tiers as joins; the first tier that fits decides."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.similarity import bigrams, dice
from spindrift.functions.text import family_of
from spindrift.session import materialize

COMPANY_LEAST, TITLE_LEAST, FEED_LEAST = 0.85, 0.80, 0.85


def _first(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def _keys(names: DataFrame, least: float) -> DataFrame:
    """(name, key, n): the pairs of rare bigrams by which names (distinct, column ``name``) meet, and how many bigrams they have."""
    # the k-th occurrence of a bigram is an item of its own, so multisets become sets
    grams = names.where("length(name) >= 3").select("name", F.posexplode(bigrams(F.col("name"))).alias("at", "g"))
    items = grams.withColumn("k", F.row_number().over(Window.partitionBy("name", "g").orderBy("at"))).select("name", F.concat_ws("#", "g", "k").alias("item"))
    ranked = items.join(items.groupBy("item").count(), "item")
    n = F.length("name") - 1
    keep = (n - F.ceil(n * least / (2 - least) - 1e-9) + 2).cast("int")
    prefix = ranked.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("count", "item"))).alias("i")).select("name", F.slice(F.col("i.item"), 1, keep).alias("i"))
    places = F.sequence(F.lit(1), F.size("i"))
    pairs = F.flatten(F.transform(places, lambda x: F.transform(F.filter(places, lambda y: y > x), lambda y: F.xxhash64(F.element_at("i", x), F.element_at("i", y)))))
    return prefix.select("name", F.explode(pairs).alias("key"), n.alias("n"))


def _near(left: DataFrame, right: DataFrame, keys: DataFrame, least: float, group: list[str]) -> DataFrame:
    """Pairs of different names (l, r) that share a key, and whose lengths allow the score."""
    a = left.join(keys, "name").select(*group, F.col("name").alias("l"), "key", F.col("n").alias("m"))
    b = right.join(keys, "name").select(*group, F.col("name").alias("r"), "key", "n")
    near = a.join(b, [*group, "key"]).where(F.least("m", "n") >= F.greatest("m", "n") * (least / (2 - least)) - 1e-9)
    return near.where("l <> r").select(*group, "l", "r").distinct()


def _scored(pairs: DataFrame, least: float) -> DataFrame:
    return pairs.withColumn("score", dice(F.col("l"), F.col("r"))).where(F.col("score") >= least)


def _total(df: DataFrame, c: Column) -> int:
    return df.agg(F.sum(c)).first()[0] or 0


def similar_names(left: DataFrame, right: DataFrame, least: float, within: str | None = None) -> DataFrame:
    """(l, r, score) of all pairs of distinct names (column ``name``) with Dice of at least ``least``, equal ones too; with
    ``within``, a column of both sides that comes first in the result, only pairs that agree in it.

    Lossless blocking: two such names share at least s = least * n / (2 - least) of their bigrams as multisets, whichever
    of them has the n (more than one, unless they are equal). Ordered by how many names have them, rarest first, the two
    rarest that they share lie among the first n - s + 2 bigrams of either. So names meet in pairs of bigrams from such
    prefixes, which are some thousand times rarer than single ones, and only where their lengths allow the score.

    With ``within`` a pair of names is scored once, however many groups have it. Names that many groups share are compared
    as such, and their pairs looked up in the groups; where that would take more rows than the keys of all groups' names,
    names meet by key in each group.
    """
    group = [within] if within else []
    distinct = lambda d: d.select(*group, "name").distinct()
    left, right = distinct(left), distinct(right)
    if within:
        left, right = materialize(left, "names"), materialize(right, "names")
    same = left.intersect(right).where("name is not null").select(*group, F.col("name").alias("l"), F.col("name").alias("r"), F.lit(1.0).alias("score"))
    if not within:
        return _scored(_near(left, right, _keys(left.union(right).distinct(), least), least, []), least).unionByName(same)
    lone = lambda d: d.select("name").distinct()
    keys = materialize(_keys(lone(left.union(right)), least), "keys")
    meet = lambda d, c: lone(d).join(keys, "name").groupBy("key").agg(F.count("*").alias(c))
    grouped = _total(left.unionAll(right).join(keys.groupBy("name").agg(F.count("*").alias("k")), "name"), F.col("k"))
    if _total(meet(left, "a").join(meet(right, "b"), "key"), F.col("a") * F.col("b")) <= grouped:
        pairs = materialize(_scored(_near(lone(left), lone(right), keys, least, []), least), "alike")
        if _total(left.join(pairs.groupBy(F.col("l").alias("name")).agg(F.count("*").alias("k")), "name"), F.col("k")) <= grouped:
            met = left.withColumnRenamed("name", "l").join(pairs, "l").join(right.withColumnRenamed("name", "r"), [*group, "r"])
            return met.select(*group, "l", "r", "score").unionByName(same)
    near = materialize(_near(left, right, keys, least, group), "near")
    met = near.join(_scored(near.select("l", "r").distinct(), least), ["l", "r"])
    return met.select(*group, "l", "r", "score").unionByName(same)


def match_company(drafts: DataFrame, companies: DataFrame) -> DataFrame:
    """drafts (draft_id, name) against companies (id, name): (draft_id, kind, company_id, score).

    Exact before fuzzy (Dice >= 0.85, greatest first), ties by the least id; else none. Names are normalized ones.
    """
    pairs = similar_names(drafts, companies, COMPANY_LEAST)
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("r"))
    hits = drafts.join(pairs, drafts["name"] == pairs["l"]).join(c, "r").select("draft_id", "company_id", "score", (F.col("l") == F.col("r")).alias("exact"))
    best = _first(hits, "draft_id", F.desc("exact"), F.desc("score"), F.col("company_id"))
    out = drafts.select("draft_id").join(best, "draft_id", "left")
    return out.select("draft_id", F.when(F.col("exact"), "exact").when(F.col("score").isNotNull(), "fuzzy").otherwise("none").alias("kind"), "company_id", F.when(~F.col("exact"), F.col("score")).alias("score"))


def tier_name(tier: Column) -> Column:
    return F.when(tier == 1, "same_url").when(tier == 2, "strict_key").when(tier == 3, "family").when(tier == 4, "fuzzy")


def match_opportunity(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """(draft_id, kind, opportunity_id, score): same_url > strict_key > family > fuzzy title in company > none.

    drafts: draft_id, posting_url, dedupe_key, family_key, title, company_id; existing: the same with id. The least id
    stands for the first of several; fuzzy is Dice >= 0.80 of lower-case titles, greatest first.
    """
    e = existing.select(*[F.col(c).alias(f"e_{c}") for c in ("id", "posting_url", "dedupe_key", "family_key", "title", "company_id")])
    every = None
    for rank, key in enumerate(("posting_url", "dedupe_key", "family_key"), 1):
        firsts = e.where(f"e_{key} is not null").groupBy(f"e_{key}").agg(F.min("e_id").alias("e_id"))
        hits = drafts.join(firsts, F.col(key) == F.col(f"e_{key}")).select("draft_id", F.struct(F.lit(rank).alias("tier"), "e_id").alias("hit"))
        every = hits if every is None else every.unionByName(hits)
    exact = materialize(every.groupBy("draft_id").agg(F.min("hit").alias("hit")).select("draft_id", "hit.e_id", "hit.tier", F.lit(1.0).alias("score")), "matched")
    # titles of what no key has matched; distinct titles of a company are compared, and stand for their least row
    rest = drafts.select("draft_id", F.col("company_id").alias("c"), F.lower("title").alias("l")).where("c is not null and l is not null")
    rest = materialize(rest.join(exact.select("draft_id"), "draft_id", "left_anti"), "rest")
    titled = e.select(F.col("e_company_id").alias("c"), F.lower("e_title").alias("r"), "e_id").join(rest.select("c").distinct(), "c", "left_semi")
    titled = materialize(titled.groupBy("c", "r").agg(F.min("e_id").alias("e_id")), "titled")
    alike = similar_names(rest.withColumnRenamed("l", "name"), titled.withColumnRenamed("r", "name"), TITLE_LEAST, "c")
    # the best for each title of a company, before its drafts come in
    best = _first(alike.join(titled, ["c", "r"]), ["c", "l"], F.desc("score"), F.col("e_id"))
    fuzzy = rest.join(best, ["c", "l"]).select("draft_id", "e_id", F.lit(4).alias("tier"), "score")
    best = exact.unionByName(_first(fuzzy, "draft_id", F.desc("score"), F.col("e_id")))
    kind = tier_name(F.col("tier"))
    return drafts.select("draft_id").join(best, "draft_id", "left").select("draft_id", F.coalesce(kind, F.lit("none")).alias("kind"), F.col("e_id").alias("opportunity_id"), F.when(F.col("tier") == 4, F.col("score")).alias("score"))


_FIELDS = ("identity_key", "canonical_url", "employer", "title", "location", "material_hash")


def assess_duplicates(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each candidate's likeliest relation to the corpus: identity, URL, probable, annual family, distinct, or unknown.

    Both sides: identity_key, canonical_url, employer, title, location, material_hash (normalized). Result: identity_key,
    match_type, confidence, matched_key, contributing, conflicting (arrays), review. Ties go to the least key in
    Unicode collation. Locations must be equal, or both null, for a probable match; for a family one a null fits all.
    A probable match has half its two scores and 0.05, at most 0.9: always 0.9, as both scores reach 0.85.
    """
    c = candidates.select(*[F.col(x).alias(f"c_{x}") for x in _FIELDS], F.coalesce("employer", F.lit("")).alias("c_e"), F.coalesce("title", F.lit("")).alias("c_t"))
    p = corpus.select(*[F.col(x).alias(f"p_{x}") for x in _FIELDS])
    some = corpus.limit(1).agg((F.count("*") > 0).alias("__some"))
    # only the least key of all that fit equally well is wanted, so of each group of alike rows one stands for all
    row = F.struct(F.expr("p_identity_key collate UNICODE").alias("order"), *[f"p_{x}" for x in _FIELDS])
    firsts = lambda d, *by: d.groupBy(*by).agg(F.min(row).alias("p"))
    by_id = c.join(firsts(p.where("p_identity_key is not null"), F.col("p_identity_key").alias("__key")), F.col("c_identity_key") == F.col("__key"))
    by_url = c.join(firsts(p.where("p_canonical_url is not null"), F.col("p_canonical_url").alias("__key")), F.col("c_canonical_url") == F.col("__key"))
    place = lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("-"))
    named_c = c.where("c_employer <> '' and c_title <> ''").withColumn("place", place(F.col("c_location")))
    named_p = p.where("p_employer <> '' and p_title <> ''")
    kinds_c = materialize(named_c.select("c_employer", "c_title", "place").distinct(), "kinds")
    kinds_p = materialize(firsts(named_p, "p_employer", "p_title", "p_location").select(*[f"p.p_{x}" for x in _FIELDS]), "kinds")
    # the pairs of names are tables of their own: they are used twice, and the plans below stay small
    pair = lambda x, y: materialize(similar_names(kinds_c.select(x.alias("name")), kinds_p.select(y.alias("name")), FEED_LEAST), "alike")
    alike = pair(F.col("c_employer"), F.col("p_employer")).select(F.col("l").alias("c_employer"), F.col("r").alias("p_employer"))
    titles = pair(F.col("c_title"), F.col("p_title")).select(F.col("l").alias("c_title"), F.col("r").alias("p_title"))
    families = pair(family_of(F.col("c_title")), family_of(F.col("p_title"))).select(F.col("l").alias("cf"), F.col("r").alias("pf"))
    c_f, p_f = (d.select(t).distinct().withColumn(f, family_of(F.col(t))) for d, t, f in ((kinds_c, "c_title", "cf"), (kinds_p, "p_title", "pf")))
    kin = c_f.join(families, "cf").join(p_f, "pf").where((F.col("c_title") != F.col("p_title")) & ((F.col("cf") != F.col("c_title")) | (F.col("pf") != F.col("p_title")))).select("c_title", "p_title")

    def least(related: DataFrame, own: Column, theirs: Column) -> DataFrame:
        """Of each kind of candidate the least row that has an alike employer, a related title and a slot in common: first for
        title, slot and the other's employer, whoever the candidate's is, then for the kind."""
        a = kinds_c.withColumn("slot", F.explode(own)).join(alike, "c_employer")
        b = kinds_p.withColumn("slot", F.explode(theirs)).groupBy(F.col("p_employer"), F.col("p_title"), "slot").agg(F.min(row).alias("p"))
        by_title = a.select("c_title", "p_employer", "slot").distinct().join(related, "c_title").join(b, ["p_employer", "p_title", "slot"]).groupBy("c_title", "p_employer", "slot").agg(F.min("p").alias("p"))
        return a.join(by_title, ["c_title", "p_employer", "slot"]).groupBy("c_employer", "c_title", "place").agg(F.min("p").alias("p"))

    nowhere, there = F.lit("-"), place(F.col("p_location"))
    probable = named_c.join(least(titles, F.array("place"), F.array(there)), ["c_employer", "c_title", "place"])
    anywhere = F.when(F.col("place") == nowhere, F.array(F.lit("*"))).otherwise(F.array("place", nowhere))
    annual = named_c.join(least(kin, anywhere, F.array(F.lit("*"), there)), ["c_employer", "c_title", "place"])
    hits = None
    for n, d in enumerate((by_id, by_url, probable, annual), 1):
        d = d.select("c_identity_key", F.struct(F.lit(n).alias("tier"), "p").alias("hit"))
        hits = d if hits is None else hits.unionByName(d)
    best = hits.groupBy("c_identity_key").agg(F.min("hit").alias("hit")).select("c_identity_key", "hit.tier", *[f"hit.p.p_{x}" for x in _FIELDS])
    j = c.join(best, "c_identity_key", "left").crossJoin(F.broadcast(some))
    key = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    differ = lambda x: key(F.col(f"c_{x}")) != key(F.col(f"p_{x}"))
    names = {"employer": "employerNameNormalized", "title": "titleNormalized", "location": "locationNormalized"}
    changed = F.coalesce(F.col("c_material_hash") != F.col("p_material_hash"), F.lit(False))
    conflicts = F.filter(F.array(*[F.when(differ(x), n) for x, n in names.items()]), lambda x: x.isNotNull())
    with_hash = F.when(changed, F.concat(conflicts, F.array(F.lit("materialHash")))).otherwise(conflicts)
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    tier, poor = F.col("tier"), (F.col("c_e") == "") | (F.col("c_t") == "")
    unknown = tier.isNull() & (poor | ~F.col("__some"))
    located = F.when(F.coalesce(F.col("c_location"), F.lit("")) != "", strings("locationNormalized")).otherwise(strings())
    return j.select(
        F.col("c_identity_key").alias("identity_key"),
        F.when(unknown, "insufficient_information").when(tier == 1, "exact_identity").when(tier == 2, "exact_url").when(tier == 3, "probable_same_posting").when(tier == 4, "possible_annual_family").otherwise("likely_distinct").alias("match_type"),
        F.when(unknown, 0.0).when(tier == 1, 1.0).when(tier == 2, 0.95).when(tier == 4, 0.6).otherwise(0.9).alias("confidence"),
        F.col("p_identity_key").alias("matched_key"),
        F.when(tier == 1, strings("identityKey")).when(tier == 2, strings("canonicalUrl")).when(tier == 3, F.concat(strings("employerNameNormalized", "titleNormalized"), located)).when(tier == 4, strings("employerNameNormalized", "titleNormalized (family)")).otherwise(strings()).alias("contributing"),
        F.when(tier <= 2, with_hash).when(tier == 3, conflicts).when(tier == 4, strings("titleNormalized")).otherwise(strings()).alias("conflicting"),
        F.when(tier == 1, changed | (F.col("c_material_hash").isNull() & (F.size(conflicts) > 0))).otherwise(F.coalesce(tier > 1, F.lit(False))).alias("review"),
    )


def duplicate_clusters(rows: DataFrame) -> DataFrame:
    """(pass, key, members) of rows (id, url, dedupe_key, family_key): groups of two and more by URL, then by strict key,
    then by family key, each pass over what no earlier one has taken."""
    out, left = None, rows
    for name in ("url", "dedupe_key", "family_key"):
        groups = left.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("key")).agg(F.array_sort(F.collect_list("id")).alias("members")).where("size(members) >= 2")
        found = groups.select(F.lit(name).alias("pass"), "key", "members")
        out = found if out is None else out.unionByName(found)
        left = left.join(groups.select(F.col("key").alias("__key")), F.col(name) == F.col("__key"), "left_anti")
    return out


def fuzzy_clusters(rows: DataFrame, least: float = TITLE_LEAST) -> DataFrame:
    """(id, other, score): in each company, in order of id, a row that is still free takes the first later free one that is alike.

    Greedy matching is sequential in a company. Distinct titles are compared, by a blocked join; the walk then asks each
    alike title for its next free row, so rows of equal titles never meet as pairs. Rows without a title match none;
    those without a company are one company's, as in the original.
    """
    titled = rows.where("title is not null").select(F.coalesce("company", F.lit("")).alias("company"), "id", F.lower("title").alias("name"))
    # the pairs are a table of their own: a cogroup can't tell columns apart that come from one frame
    alike = materialize(similar_names(titled, titled, least, "company"), "alike")
    kind = dict(rows.dtypes)["id"]

    def greedy(own, pairs):
        near: dict[str, list] = {}
        for a, b, score in zip(pairs["l"], pairs["r"], pairs["score"]):
            near.setdefault(a, []).append((b, score))
        own = own.sort_values("id")
        waiting: dict[str, deque] = {}
        for i, name in zip(own["id"], own["name"]):
            waiting.setdefault(name, deque()).append(i)
        taken, out = set(), []
        for i, name in zip(own["id"], own["name"]):
            if i in taken:
                continue
            best = None
            for other, score in near[name]:
                queue = waiting[other]
                while queue and (queue[0] <= i or queue[0] in taken):
                    queue.popleft()
                if queue and (best is None or queue[0] < best[0]):
                    best = queue[0], score
            if best:
                taken.add(best[0])
                out.append((i, *best))
        return own.__class__(out, columns=["id", "other", "score"])

    return titled.groupBy("company").cogroup(alike.groupBy("company")).applyInPandas(greedy, f"id {kind}, other {kind}, score double")


def feed_company(postings: DataFrame, job_sources: DataFrame, companies: DataFrame) -> DataFrame:
    """(identity_key, company_id, kind): the source's own company, else the employer's by exact or fuzzy name.

    kind is source, exact, fuzzy (to be flagged), new (an employer of 3 letters and more that is no one's) or none.
    postings: identity_key, job_source_id, employer; job_sources: id, company_id; companies: id, name; names normalized.
    """
    s = job_sources.join(companies.select(F.col("id").alias("__c")), F.col("company_id") == F.col("__c")).select(F.col("id").alias("__s"), "company_id")
    own = postings.join(s, F.col("job_source_id") == F.col("__s"), "left").select("identity_key", "employer", F.col("company_id").alias("own_id"))
    drafts = own.where("own_id is null and employer <> ''").select(F.col("identity_key").alias("draft_id"), F.col("employer").alias("name"))
    found = match_company(drafts, companies).select(F.col("draft_id").alias("__d"), "kind", "company_id")
    j = own.join(found, F.col("identity_key") == F.col("__d"), "left")
    kind = F.when(F.col("own_id").isNotNull(), "source").when(F.col("kind").isin("exact", "fuzzy"), F.col("kind")).when(F.length("employer") >= 3, "new").otherwise("none")
    return j.select("identity_key", F.coalesce("own_id", "company_id").alias("company_id"), kind.alias("kind"))
