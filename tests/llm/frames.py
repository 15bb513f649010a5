"""Small tables with all that a table may hold."""

LONG = "word " * 30_000 + "é" * 5_000
EDGE = [
    (1, "The same line\nanother line of text", "en", "s0", 10),
    (1, "The same line\nanother line of text", "en", "s0", 10),
    (2, "The same line\nanother line of text", "en", "s0", 10),
    (3, None, None, None, None),
    (4, "", "en", "s1", 0),
    (5, " \n\t ", "en", "s1", 4),
    (6, LONG, "en", None, len(LONG)),
    (7, "日本語 😀 é <|endoftext|>  two  spaces", "ja", "s2", 5),
    (None, "no id", "en", "s2", 5),
    (None, None, None, None, None),
    (8, "!!!", "en", "s2", 3),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for themselves or give to their results.
CLASHES = ["keep", "id", "score", "toxic", "shard", "margin", "vec", "grp", "__id", "__runs", "__k", "__s", "__gone", "TEXT", "duplicate_of", "__c0"]


def docs(spark, rows=EDGE, clash=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        df = df.toDF(*df.columns).selectExpr("*", *[f"'x' as `{c}`" for c in CLASHES])
    return df


def empty(spark):
    return docs(spark, [])
