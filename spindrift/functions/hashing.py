"""Content hashes that don't depend on key order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATERIAL = ("canonicalUrl", "classification", "closesAt", "deadlineKind", "departments", "descriptionNormalized", "employmentType", "locationRaw", "offices", "remoteType", "titleRaw")


def stable_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with keys in order and nulls written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def material_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the eleven fields whose change is worth a review; departments and offices in order."""
    ordered = {k: F.array_sort(fields[k]) if k in ("departments", "offices") else fields[k] for k in MATERIAL}
    return F.sha2(stable_json(ordered), 256)
