"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, overfull ranges subdivided."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm._common import Positional, materialize

TARGET_BYTES, OVERSAMPLE, SLACK = 32 << 20, 64, 1.25


def _number(x: Column) -> Column:
    """A double as text of the same order: class, exponent and digits, turned round for negative numbers; NaN is last."""
    text = F.format_string("%.17e", F.abs(x))
    exponent = F.lpad((F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int") + 500).cast("string"), 3, "0")
    size = F.when(F.abs(x) == float("inf"), "999").otherwise(F.concat(exponent, F.regexp_extract(text, r"^([\d.]+)e", 1)))
    return F.when(F.isnan(x), "3").when(x == 0, "1").when(x > 0, F.concat(F.lit("2"), size)).otherwise(F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210"), F.lit("~")))


def _text(key: Column, kind: str) -> Column:
    """The key as text that sorts as the key does: numbers, dates and times by value, all else by its text."""
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp"):
        n = F.unix_date(key) if kind == "date" else F.unix_micros(key) if kind == "timestamp" else key
        return F.lpad(F.hex(n.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))), 16, "0")
    if kind in ("float", "double"):
        return _number(key.cast("double"))
    if kind.startswith("decimal"):
        # half a double's digits decide nearly always; the rest is told by the difference to that double, of the same order
        near = key.cast("double")
        return F.concat(_number(near), F.lit("/"), _number((key - near.cast("decimal(38,10)")).cast("double")))
    # no end of a text may pass for a part of a longer one
    return F.concat(F.replace(key.cast("string"), F.lit("\0"), F.lit("\0\u00ff")), F.lit("\0\0"))


def _order_key(key: Column, doc: Column, kind: str) -> Column:
    """Key, then a hash of the id: a string in which nulls come first and rows of one key can still be told apart."""
    tie = F.lpad(F.hex(F.xxhash64(doc)), 16, "0")
    return F.concat(F.when(key.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), _text(key, kind))), F.lit("\u0001"), tie)


def _quantiles(sample: pd.DataFrame, at: np.ndarray) -> list[str]:
    """The keys at which the weight that the samples stand for, in their order, reaches each of ``at``."""
    s = sample.sort_values("k", kind="stable")
    total = s["w"].cumsum().to_numpy()
    if not len(total):
        return []
    return list(dict.fromkeys(s["k"].to_numpy()[np.minimum(np.searchsorted(total, at), len(total) - 1)]))


def _place(spark, splitters: list[str]):
    """Number of splitters up to a key. What is broadcast is one key a range, as with Spark's own range partitioner."""
    shared = spark.sparkContext.broadcast(np.array(splitters, object))

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, k.to_numpy(object), "right").astype(np.int32))

    return place


def _first_marks(samples: DataFrame, parts: int, oversample: int) -> list[str]:
    """parts - 1 weighted quantiles in two levels: about sqrt(parts) coarse ranges, whose samples are cut where they are."""
    spark, coarse = samples.sparkSession, math.ceil(math.sqrt(parts))
    few = samples.where(F.pmod(F.xxhash64("k", F.lit(2)), F.lit(1 << 20)) < max(1, math.ceil((1 << 20) * min(1.0, coarse / parts)))).toPandas()
    bounds = _quantiles(few, few["w"].sum() * np.arange(1, coarse) / coarse) if coarse > 1 else []
    placed = materialize(samples.withColumn("range", _place(spark, bounds)("k")), "samples")
    weight = {r["range"]: r["w"] for r in placed.groupBy("range").agg(F.sum("w").alias("w")).collect()}
    before, total = {}, 0.0
    for r in sorted(weight):
        before[r], total = total, total + weight[r]
    steps = total * np.arange(1, parts) / parts

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["range"].iloc[0])
        own = steps[(steps > before[r]) & (steps <= before[r] + weight[r])] - before[r]
        return pd.DataFrame({"k": _quantiles(pdf, own)}, dtype=object)

    return sorted({r["k"] for r in placed.groupBy("range").applyInPandas(cut, "k string").collect()})


def splitters(df: DataFrame, key_col: str, id_col: str, text_col: str, target_bytes: int = TARGET_BYTES, oversample: int = OVERSAMPLE, slack: float = SLACK) -> list[str]:
    """Sorted order keys that part ``df`` into ranges of about ``target_bytes`` of text.

    A row is drawn with a probability in proportion to its size, by a hash of its id, ``oversample`` rows a range on
    average; boundaries are the samples' weighted quantiles. Ranges that turn out larger than ``slack`` times the
    target are sampled again, four times as densely each round, and cut at their own quantiles, until none is left
    that has more than one order key. Samples stay on the executors but for some for each of sqrt(ranges) coarse ranges; what
    reaches the driver is the boundaries, one key a range, and the extent of overfull ranges.
    """
    p = Positional(df)
    size = F.coalesce(F.octet_length(p.col(text_col)), F.lit(0)).cast("bigint")
    kind = dict(p.df.dtypes)[p.name(key_col)]
    rows = materialize(p.df.select(_order_key(p.col(key_col), p.col(id_col), kind).alias("k"), size.alias("size")), "keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(1, math.ceil(total / target_bytes))
    if parts == 1:
        return []
    chance = (F.xxhash64("k", F.lit(1)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double")) / F.lit(float(1 << 52))
    weight = lambda dense: F.greatest(F.col("size").cast("double"), F.lit(target_bytes / dense))
    draw = lambda d, dense: d.where((F.col("size") > 0) & (chance < F.col("size") * dense / target_bytes))
    marks = _first_marks(draw(rows, oversample).select("k", weight(oversample).alias("w")), parts, oversample)
    dense = oversample
    while True:
        placed = rows.withColumn("shard", _place(df.sparkSession, marks)("k"))
        full = placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.min("k").alias("lo"), F.max("k").alias("hi")).where((F.col("bytes") > slack * target_bytes) & (F.col("lo") < F.col("hi")))
        full = materialize(full, "full")
        most = full.agg(F.max("bytes")).first()[0]
        if most is None:
            return marks
        dense *= 4
        seen = draw(placed.join(full.select("shard", "bytes", "lo"), "shard"), dense).select("shard", "bytes", "lo", "k", weight(dense).alias("w"))

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = math.ceil(pdf["bytes"].iloc[0] / target_bytes)
            # a boundary stands at the right of what it ends, so the range's least key can't be one
            return pd.DataFrame({"k": [k for k in _quantiles(pdf, pdf["w"].sum() * np.arange(1, parts) / parts) if k > pdf["lo"].iloc[0]]}, dtype=object)

        new = [r["k"] for r in seen.groupBy("shard").applyInPandas(cut, "k string").collect()]
        old, marks = marks, sorted({*marks, *new})
        if marks == old and dense > most:
            return marks  # every row has been a sample: what is left is rows larger than the target


def shard(df: DataFrame, key_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with a column ``shard`` (int, from 0), range-partitioned by (key, hash of id) and sorted within shards.

    Shards are ranges of the key, in its order: numbers, dates and times by value (NaN last), all else by its text. A key that is larger than a shard spans several ones. Rows equal in
    key and id stay together. Null keys come first; null texts and empty ones have no size and go where their key
    belongs. A column of that name gives way; all others stay as they are. An empty table stays empty.
    """
    marks = splitters(df, key_col, id_col, text_col, **options)
    p = Positional(df)
    keyed = p.df.withColumn("__k", _order_key(p.col(key_col), p.col(id_col), dict(p.df.dtypes)[p.name(key_col)]))
    keyed = keyed.withColumn("shard", _place(df.sparkSession, marks)("__k"))
    spread = keyed.repartitionById(len(marks) + 1, "shard").sortWithinPartitions("__k")  # one shard, one partition
    return p.restore(spread, ["shard"])
