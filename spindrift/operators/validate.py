"""Constraints as data-quality checks: one row for each rule with the number of rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations) of SQL predicates; as in CHECK constraints, null passes. All rules in one scan."""
    counts = df.agg(*[F.count_if(F.expr(f"not ({p})")).alias(n) for n, p in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]))
    return counts.select(pairs.alias("p")).select("p.*")


def unique(df: DataFrame, name: str, *key: str) -> DataFrame:
    """(rule, violations): keys that come more than once. Rows with a null in the key don't count."""
    full = df.dropna(subset=list(key))
    return full.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def references(df: DataFrame, name: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(rule, violations): values without a parent row; null passes."""
    keys = parent.select(F.col(parent_key).alias("__k"))
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__k"), "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def append_only(before: DataFrame, after: DataFrame, name: str, key: str) -> DataFrame:
    """(rule, violations): rows of a history that a later version of it changed or lost."""
    kept = [c for c in before.columns if c != key]
    old, new = before.select(key, F.xxhash64(*kept).alias("__h")), after.select(key, F.xxhash64(*kept).alias("__h"))
    return old.join(new, [key, "__h"], "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
