"""Job-board payloads: landed JSON to normalized, classified, scored and hashed postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import classify, dates
from spindrift.functions.hashing import material_hash
from spindrift.functions.score import feed_score
from spindrift.functions.text import department_key, html_to_text, identity_key, job_title, location_key
from spindrift.functions.url import board_token, canonical_url_exact

_NAMED = "array<struct<id:bigint,name:string>>"
JOB = f"struct<id:bigint,internal_job_id:bigint,title:string,updated_at:string,requisition_id:string,location:struct<name:string>,absolute_url:string,content:string,departments:{_NAMED},offices:{_NAMED},metadata:variant,language:string,first_published:string,application_deadline:string>"
SCHEMA = f"jobs array<{JOB}>, meta struct<total:bigint>"


def read_payloads(spark: SparkSession, path: str, max_bytes: int = 10 << 20) -> DataFrame:
    """(path, error, jobs) of landed payload files: invalid_json, invalid_shape without a list of jobs, too_large."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = raw.withColumn("p", F.from_json("value", f"{SCHEMA}, broken string", {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}))
    shape = F.expr("is_variant_null(coalesce(variant_get(try_parse_json(value), '$.jobs', 'variant'), parse_json('null')))")
    error = F.when(F.octet_length("value") > max_bytes, "too_large").when(F.expr("try_parse_json(value)").isNull(), "invalid_json").when(shape | F.col("p.jobs").isNull(), "invalid_shape")
    return parsed.select("path", error.alias("error"), F.when(error.isNull(), F.col("p.jobs")).alias("jobs"))


def postings(payloads: DataFrame, token: str, now: Column) -> DataFrame:
    """One row a job: normalized fields, classification, score and hash, or ``issue`` where it can't be used.

    The employer isn't part of such payloads and stays null. Unusable jobs (no numeric id, no HTTP link) keep a row.
    """
    token = board_token(token)
    j = payloads.where("error is null").select("path", F.explode("jobs").alias("j"))
    names = lambda c: F.array_sort(F.transform(F.filter(F.coalesce(F.transform(c, lambda d: d["name"]), F.array().cast("array<string>")), lambda n: F.trim(n) != ""), lambda n: F.trim(n)))
    d = j.select(
        "path", F.col("j.id").cast("string").alias("external_id"), identity_key("greenhouse", F.lit(token), F.col("j.id")).alias("identity_key"), F.col("j.internal_job_id").cast("string").alias("internal_job_id"), F.col("j.requisition_id").alias("requisition_id"),
        F.col("j.title").alias("title_raw"), job_title(F.col("j.title")).alias("title"), F.col("j.location.name").alias("location_raw"), location_key(F.col("j.location.name")).alias("location"),
        canonical_url_exact("j.absolute_url").alias("canonical_url"), html_to_text(F.col("j.content")).alias("description"), F.coalesce(F.col("j.content"), F.lit("")) == "",
        dates.parse_stamp(F.col("j.updated_at")).alias("source_updated_at"), F.col("j.updated_at").isNotNull().alias("__updated"), names(F.col("j.departments")).alias("departments"), names(F.col("j.offices")).alias("offices"),
        dates.parse_iso_date(F.col("j.first_published")).alias("posted_at"), F.col("j.application_deadline").alias("deadline_raw"), dates.parse_iso_date(F.col("j.application_deadline")).alias("closes_at"), F.col("j.language").alias("language"), F.col("j.metadata").alias("metadata"),
    )
    d = d.withColumnRenamed(d.columns[11], "__bare")
    col = F.col
    d = d.withColumns({
        "department": F.coalesce(department_key(F.get("departments", F.lit(0))), F.get("departments", F.lit(0))),
        "deadline_kind": dates.deadline_kind(col("deadline_raw"), col("closes_at")),
        "__class": classify.opportunity_class(col("title_raw"), F.lit(None).cast("string"), col("description")),
        "__remote": classify.remote_type(col("title_raw"), col("location_raw"), col("description")),
        "focus_area": classify.focus_area(col("title_raw"), col("description")),
    })
    empty = lambda c: F.coalesce(col(c), F.lit("")) == ""
    flags = [
        (F.lit(True), "employer_name_missing"), (empty("title_raw"), "title_missing"), (empty("location_raw"), "location_missing"), (col("canonical_url").isNull(), "url_invalid"), (col("__bare"), "description_missing"),
        (col("__updated") & col("source_updated_at").isNull(), "source_updated_at_invalid"), (~empty("deadline_raw") & col("closes_at").isNull(), "deadline_invalid"), (empty("deadline_raw"), "deadline_missing"),
        (col("__class.inferred"), "classification_inferred"), (col("__remote.ambiguous"), "remote_ambiguous"), (F.lit(True), "employment_type_missing"),
    ]
    d = d.withColumn("__flags", F.filter(F.array(*[F.when(c, n) for c, n in flags]), lambda x: x.isNotNull()))
    d = d.withColumn("__url", F.coalesce("canonical_url", F.lit("")))
    score = feed_score(col("title_raw"), col("title"), col("location"), col("department"), col("departments"), col("__class.class"), col("__remote.type"), col("__url"), col("description"), col("closes_at"), col("__flags"), now)
    fields = {"titleRaw": col("title_raw"), "locationRaw": col("location_raw"), "canonicalUrl": col("__url"), "departments": col("departments"), "offices": col("offices"), "closesAt": col("closes_at").cast("string"), "deadlineKind": col("deadline_kind"), "descriptionNormalized": col("description"), "employmentType": F.lit(None).cast("string"), "classification": col("__class.class"), "remoteType": col("__remote.type")}
    d = d.withColumns({"score": score, "material_hash": material_hash(fields), "classification": col("__class.class"), "remote_type": col("__remote.type"), "issue": F.when(col("external_id").isNull(), "invalid_id").when(col("canonical_url").isNull(), "invalid_url")})
    return d.withColumn("flags", col("score.flags")).drop("__bare", "__updated", "__class", "__remote", "__flags", "__url")


def fetch_result(payloads: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, ok, error, seen, normalized, skipped, status) of each payload; all jobs failing fails the fetch."""
    n = rows.groupBy("path").agg(F.count_if(F.col("issue").isNull()).alias("normalized"))
    j = payloads.select("path", "error", F.coalesce(F.size("jobs"), F.lit(0)).alias("seen")).withColumn("seen", F.greatest("seen", F.lit(0))).join(n, "path", "left").withColumn("normalized", F.coalesce("normalized", F.lit(0)))
    ok = F.col("error").isNull() & ((F.col("seen") == 0) | (F.col("normalized") > 0))
    skipped = F.col("seen") - F.col("normalized")
    return j.select("path", ok.alias("ok"), "error", "seen", "normalized", skipped.alias("skipped"), F.when(~ok, "failed").when(skipped > 0, "partial").otherwise("completed").alias("status"))
