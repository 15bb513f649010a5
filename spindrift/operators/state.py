"""Observations over time: stale ones are refused, contents are versioned, changes become tasks and counts.

An observation has source, identity_key, run_id, seq (order within equal times), observed_at, hash, score, status.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 35
KEY = ("source", "identity_key")
CLOSED = ("closed", "closure_candidate", "missing")



def outcomes(observations: DataFrame, seed: DataFrame | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """Every observation with what it did: stale, created, changed, reopened, task, status, in order of ``seq`` by key.

    ``seq`` is the order of arrival. An observation older than the newest accepted time is stale and changes
    nothing; an equal time is accepted. ``seed`` (source, identity_key, last_seen_at, hash, current_status, and first_seen_at and
    content where they are known) is the state before; its first_seen_at comes with every observation of its key.
    One window by key; no row of a key is held with others in memory.
    """
    obs = observations.withColumns({"__seed": F.lit(False), "seed_first_seen_at": F.lit(None).cast("timestamp")})
    if seed is not None:
        given = {"observed_at": F.col("last_seen_at"), "status": F.col("current_status"), "seq": F.lit(-1).cast("bigint"), "__seed": F.lit(True)}
        if "first_seen_at" in seed.columns:
            given["seed_first_seen_at"] = F.col("first_seen_at")
        wide = seed.withColumns(given)
        missing = [c for c in obs.columns if c not in wide.columns]
        obs = obs.unionByName(wide.withColumns({c: F.lit(None).cast(dict(obs.dtypes)[c]) for c in missing}).select(*obs.columns))
    by = Window.partitionBy(*KEY).orderBy("seq")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    # the newest accepted time before a row is the newest time at all before it: refused ones are older
    marked = obs.withColumn("stale", F.coalesce(F.col("observed_at") < F.max("observed_at").over(before), F.lit(False)))
    ok = ~F.col("stale")
    last = lambda c: F.last(F.when(ok, c), ignorenulls=True).over(before)
    marked = marked.withColumn("seed_first_seen_at", F.first("seed_first_seen_at", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    past = marked.withColumn("__old", last(F.struct(F.col("hash").alias("hash"), F.col("status").alias("status"))))
    created = ok & F.col("__old").isNull()
    changed = ok & F.col("__old").isNotNull() & ~F.col("hash").eqNullSafe(F.col("__old.hash"))
    reopened = ok & F.coalesce(F.col("__old.status").isin(*CLOSED) & F.col("status").isin("open", "reopened"), F.lit(False))
    task = F.when(created & (F.col("score") >= threshold), "source_new").when(created, None).when(reopened, "source_reopened").when(changed, "source_changed")
    out = past.withColumns({"created": created, "changed": changed, "reopened": reopened, "task": task, "new_status": F.when(reopened & (F.col("status") == "open"), "reopened").otherwise(F.col("status"))})
    if "content" in out.columns:
        out = out.withColumn("seed_content", F.first(F.when(F.col("__seed"), F.col("content")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(~F.col("__seed")).drop("__seed", "__old")


def latest_state(done: DataFrame) -> DataFrame:
    """(key, first_seen_at, last_seen_at, hash, score, current_status): the fold of all accepted observations; what was first seen
    before, by the seed, stays so."""
    ok = done.where("not stale")
    last = lambda c: F.max_by(c, "seq")
    return ok.groupBy(*KEY).agg(F.coalesce(F.max("seed_first_seen_at"), F.min_by("observed_at", "seq")).alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), last("hash").alias("hash"), last("score").alias("score"), last("new_status").alias("current_status"))


def versions(done: DataFrame) -> DataFrame:
    """Append-only history: contents that were new or changed, at most one for each run of a key.

    Where observations have a ``content`` (a JSON object), a version stores it with ``field_diff``: the fields in which it
    differs from the version before, as JSON {field: {before, after}}, {} for a key's first one.
    """
    some = [c for c in ("content", "seed_content") if c in done.columns]
    kept = done.where("created or changed").groupBy(*KEY, "run_id").agg(F.min_by(F.struct("seq", "observed_at", "hash", "created", *some), "seq").alias("v"))
    out = kept.select(*KEY, "run_id", F.col("v.seq").alias("seq"), F.col("v.observed_at").alias("observed_at"), F.col("v.hash").alias("hash"), (~F.col("v.created")).alias("is_material_change"), *[F.col(f"v.{c}").alias(c) for c in some])
    if not some:
        return out
    out = out.withColumn("__old", F.coalesce(F.lag("content").over(Window.partitionBy(*KEY).orderBy("seq")), "seed_content"))
    return out.withColumn("field_diff", F.when(F.col("__old").isNull(), "{}").otherwise(object_diff("__old", "content"))).drop("__old", "seed_content")


def _fields(json: str) -> Column:
    """A JSON object's fields by name, each as JSON text with keys in order; those that are null are left out."""
    each = F.transform_values(F.from_json(json, "map<string,variant>"), lambda _, v: F.regexp_replace(F.to_json(v), r"^(-?\d+)\.0$", "$1"))
    return F.map_filter(F.coalesce(each, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull() & (v != "null"))


def object_diff(before: str, after: str) -> Column:
    """{field: {before, after}} as JSON of the fields of two JSON objects that differ, in order of their names.

    Values differ by type and value, not by the order of keys or by how a number is written; absent and null are the same.
    """
    b, a = _fields(before), _fields(after)
    names = F.array_sort(F.array_distinct(F.concat(F.map_keys(b), F.map_keys(a))))
    apart = F.filter(names, lambda k: ~F.try_element_at(b, k).eqNullSafe(F.try_element_at(a, k)))
    value = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit("null"))
    # a name as JSON text, by way of an array of it
    name = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    each = F.transform(apart, lambda k: F.concat(name(k), F.lit(':{"before":'), value(b, k), F.lit(',"after":'), value(a, k), F.lit("}")))
    return F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))


def tasks(done: DataFrame, open_tasks: DataFrame | None = None) -> DataFrame:
    """Review tasks to open: one for each (key, type, hash) that has none open already."""
    new = done.where("task is not null").groupBy(*KEY, "task", "hash").agg(F.min("seq").alias("seq"))
    return new if open_tasks is None else new.join(open_tasks, [*KEY, "task", "hash"], "left_anti")


def counters(done: DataFrame) -> DataFrame:
    """Per run: seen, new, changed, unchanged (stale ones too), reviewed, stale. Outcomes count, not tasks written."""
    n = lambda c, name: F.count_if(c).alias(name)
    col = F.col
    return done.groupBy("run_id").agg(F.count("*").alias("seen"), n(col("created"), "new"), n(col("changed"), "changed"), n(~col("created") & ~col("changed"), "unchanged"), n(col("task").isNotNull(), "reviewed"), n(col("stale"), "stale"))


def field_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) where a field differs, as text; absent and null are the same."""
    b = before.select(F.col(key), *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    a = after.select(F.col(key), *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("before"), F.col(f"a_{f}").alias("after")) for f in fields]))
    return b.join(a, key, "full").select(key, pairs.alias("d")).select(key, "d.*").where("not (before <=> after)")


def variant_diff(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, field, before, after) of two JSON objects: all top-level fields of either whose values differ.

    Values are told apart as in ``object_diff``: 1 and "1" differ, objects with their keys in another order don't. before and after are
    their texts, without quotes.
    """
    fields = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    named = df.select(key, _fields(before).alias("bj"), _fields(after).alias("aj"), fields(before).alias("b"), fields(after).alias("a"))
    each = named.select(key, "bj", "aj", "b", "a", F.explode(F.array_distinct(F.concat(F.map_keys("bj"), F.map_keys("aj")))).alias("field"))
    at = lambda m: F.try_element_at(F.col(m), F.col("field"))
    return each.where(~at("bj").eqNullSafe(at("aj"))).select(key, "field", at("b").cast("string").alias("before"), at("a").cast("string").alias("after"))


def changed_names(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Names of the fields whose two values differ, null counting as a value, in the given order."""
    return F.filter(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, a, b in pairs]), lambda x: x.isNotNull())


def final_status(ok: Column, issues: Column, skipped: Column) -> Column:
    return F.when(~ok, "failed").when((issues > 0) | (skipped > 0), "partial").otherwise("completed")


def deep_diff(before, after, path: str = "$") -> list[tuple[str, object, object]]:
    """(dotted path, before, after) of two nested objects; lists are compared whole. For single payloads on the driver."""
    if isinstance(before, dict) and isinstance(after, dict):
        parts = ([deep_diff(before.get(k), after.get(k), k if path == "$" else f"{path}.{k}") for k in sorted(before.keys() | after.keys())])
        return reduce(list.__add__, parts, [])
    return [] if before == after else [(path, before, after)]
