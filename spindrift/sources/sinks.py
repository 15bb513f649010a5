"""Sinks: raw payloads by content address, CSV and JSON exports, public submissions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_rows(fetched: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(source_id, run_id, url, body) to rows to store: sha256, size and path source/run/hh/sha.txt; what a run has stored isn't stored again."""
    sha = F.sha2("body", 256)
    rows = fetched.withColumns({"sha256": sha, "bytes": F.octet_length("body"), "path": F.concat_ws("/", "source_id", "run_id", F.left(sha, F.lit(2)), F.concat(sha, F.lit(".txt")))})
    rows = rows.dropDuplicates(["run_id", "sha256", "url"])
    return rows if stored is None else rows.join(stored.select("run_id", "sha256", "url"), ["run_id", "sha256", "url"], "left_anti").select(*rows.columns)


def write_payloads(rows: DataFrame, folder: str) -> None:
    """Bodies as objects at their content paths, byte for byte; then their metadata as Parquet beside them.

    A path is made of the body's own hash, so a task that runs again writes the same bytes to the same place, and a run that broke off
    before the metadata can be done again. ``folder`` is a URI or a path that all executors reach.
    """

    def put(batches):
        fs, base = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist()):
                place = f"{base}/{path}"
                fs.create_dir(place.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(place) as out:
                    out.write(body.encode())
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    uri = _uri(f"{folder}/bodies")
    rows.where("body is not null").select("path", "body").mapInArrow(put, "path string").write.format("noop").mode("overwrite").save()
    rows.drop("body").write.mode("append").parquet(f"{folder}/metadata")


def _uri(folder: str) -> str:
    return f"file://{folder}" if folder.startswith("/") else folder


def read_payload(folder: str, path: str) -> str:
    """One stored body, as it was."""
    fs, base = pafs.FileSystem.from_uri(_uri(f"{folder}/bodies"))
    with fs.open_input_stream(f"{base}/{path}") as f:
        return f.read().decode()


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; exports are small by nature, so order and one partition cost nothing."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, now: Column) -> DataFrame:
    """One row {exported_at, records}."""
    return df.agg(F.to_json(F.struct(now.alias("exported_at"), F.collect_list(F.struct(*df.columns)).alias("records")), {"ignoreNullFields": "false"}).alias("json"))


def submissions(df: DataFrame) -> DataFrame:
    """Submitted forms to rows: a filled trap field or a link that isn't HTTP drops the row; the form is kept as JSON."""
    kept = df.where((F.coalesce(F.trim("trap"), F.lit("")) == "") & F.col("link").rlike("(?i)^https?://"))
    return kept.select(F.to_json(F.struct(*[c for c in df.columns if c != "trap"])).alias("payload"), F.lit("new").alias("status"))
