"""A training corpus in five stages, from documents to packed sequences; each stage is one operator of the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import linededup, packing, quality, simhash, toxicity
from spindrift.llm._common import materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` that the quality classifier keeps, fitted to the quality labels. Null texts go, as nothing speaks for them; without
    labels of both classes all stay. Rows that repeat are judged alike; an empty table stays empty."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` none of whose windows the network finds toxic, fitted to the toxic labels. Null texts and those without words
    stay, and so does all without labels of both classes."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without lines that stood in a document of lesser id, or before in the same one; what loses all its lines goes,
    n_chars follows. Null texts, blank texts and rows without an id stay as they are; rows that repeat an id share their fate."""
    return linededup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` but for those that are near copies of a lesser id: the least id of each group stays, with all its rows. Null and
    blank texts and rows without an id are no one's copies."""
    return simhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, doc_id, piece, start, tokens, place): the training sequences. What has no id or no tokens is in none."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack),
]

#: Trained classifiers and fingerprints have no SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read by the next.

    Nulls in any column, empty and very long texts, rows that repeat and an empty table pass through as each stage says; other
    columns are carried up to the packing, whatever their names. Ties are broken by the least id.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
