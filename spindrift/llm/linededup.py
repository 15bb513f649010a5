"""Line dedup: range-partitioned hashes with a secondary sort, streamed first occurrences, run-length keep bitmaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spindrift.llm._common import Positional, alone, materialize, pick

#: Lines that are looked through at once before the shuffle.
LOCAL_LINES = 200_000
_LOCAL = "kind tinyint, h1 bigint, h2 bigint, id bigint, pos int"


def _local(batches):
    """Rows (id, pos, n, h1, h2) to rows of three kinds: the first of each hash in a run of lines (0), lines that have
    one before them in the run and so are none of the first (1), and each row's number of lines, as pos (2)."""

    def sift(parts):
        ids, pos, n, h1, h2, blank = map(np.concatenate, zip(*parts))
        start = np.flatnonzero(pos == 0)
        line = np.flatnonzero(~blank)
        order = line[np.lexsort((pos[line], ids[line], h2[line], h1[line]))]
        first = np.ones(len(order), bool)
        first[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
        # a repeated row has the place of the first occurrence itself: it isn't another occurrence
        drop = (ids[order] != ids[lead]) | (pos[order] != pos[lead])
        for kind, on, what in ((0, order[first], pos), (1, order[drop], pos), (2, start, n)):
            h = [pa.array(x[on], mask=np.full(len(on), kind > 0)) for x in (h1, h2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), kind, np.int8)), *h, pa.array(ids[on]), pa.array(what[on])], ["kind", "h1", "h2", "id", "pos"])

    alone("linededup")
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        held.append([*[c.to_numpy(zero_copy_only=False) for c in columns[:3]], *[c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns[3:]], np.asarray(columns[3].is_null())])
        size += batch.num_rows
        if size >= LOCAL_LINES:
            yield from sift(held)
            held, size = [], 0
    if size:
        yield from sift(held)


def _stream(batches):
    """Rows arrive by (h1, h2, id, pos); passes on those that aren't the first occurrence of their hash."""
    alone("linededup")
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        first = np.ones(len(h1), bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last and last[0] == h1[0] and last[1] == h2[0]:
            first[0] = False
        # a repeated row has the place of the first occurrence itself: it isn't another occurrence
        start = np.maximum.accumulate(np.where(first, np.arange(len(h1)), -1))
        old = start < 0
        fid = np.where(old, last[2] if last else 0, ids[start])
        fpos = np.where(old, last[3] if last else 0, pos[start])
        drop = ~first & ((fid != ids) | (fpos != pos))
        yield pa.RecordBatch.from_arrays([pa.array(ids[drop]), pa.array(pos[drop])], ["id", "pos"])
        last = (h1[-1], h2[-1], fid[-1], fpos[-1])


@F.pandas_udf(StringType())
def _runs(n_lines: pd.Series, drops: pd.Series) -> pd.Series:
    alone("linededup")
    out = []
    for n, d in zip(n_lines, drops):
        if d is None or not len(d):
            out.append(str(n))
            continue
        keep = np.ones(n, np.int8)
        keep[np.asarray(d)] = 0
        edges = np.flatnonzero(np.diff(keep)) + 1
        runs = np.diff(np.concatenate([[0], edges, [n]]))
        out.append(("0," if not keep[0] else "") + ",".join(map(str, runs)))
    return pd.Series(out)


def decode_runs(runs: str) -> np.ndarray:
    """Keep flag of each line, from alternating run lengths of which the first one keeps."""
    lengths = np.array(runs.split(","), np.int64)
    return np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_kept, keep_runs): for each document which lines stay.

    A line is what stands between line feeds, without spaces at its ends. The first occurrence in order of (doc_id,
    place) stays, all later ones go, within a document and across documents; lines that are blank always stay.
    keep_runs is the run-length form of the keep bitmap: lengths of alternating runs, kept lines first ("0" first if
    the first line goes).

    Null texts and null ids have no row. An empty text is one blank line. Rows that repeat an id share one bitmap: the
    same line at the same place counts once, and n_lines is that of the longest. Texts of any length are split whole.

    Scale: text is read once, into 28 bytes a line. Of a run of some 200,000 lines only the first of each hash goes on, so
    that a line that is everywhere costs one row a run; those are range-partitioned by hash (a hash stays in one
    sorted run, which is streamed, never held), and only lines that go are grouped by document.
    """
    lines = pick(df, id=id_col, text=text_col).where("id is not null and text is not null").select(F.col("id").cast("bigint").alias("id"), F.split("text", "\n", -1).alias("lines"))
    lines = lines.select("id", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line")).withColumn("line", F.trim("line"))
    blank = F.col("line") == ""
    hashed = lines.select("id", "pos", "n", F.when(~blank, F.xxhash64("line")).alias("h1"), F.when(~blank, F.xxhash64(F.lit(77), "line")).alias("h2"))
    local = materialize(hashed.mapInArrow(_local, _LOCAL), "lines")
    ordered = local.where("kind = 0").select("h1", "h2", "id", "pos").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "id", "pos")
    gone = ordered.mapInArrow(_stream, "id bigint, pos int").unionByName(local.where("kind = 1").select("id", "pos"))
    drops = gone.groupBy("id").agg(F.collect_set("pos").alias("drops"))
    every = local.where("kind = 2").groupBy("id").agg(F.max("pos").alias("n"))
    out = every.join(drops, "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_lines"), (F.col("n") - F.coalesce(F.size("drops"), F.lit(0))).cast("bigint").alias("n_kept"), _runs("n", "drops").alias("keep_runs"))


@F.pandas_udf(StringType())
def _apply(text: pd.Series, runs: pd.Series) -> pd.Series:
    alone("linededup")
    out = []
    for t, r in zip(text, runs):
        if t is None or r is None or "," not in r:
            out.append(t)
            continue
        lines = t.split("\n")
        keep = decode_runs(r)[: len(lines)]
        kept = [x for x, k in zip(lines, keep) if k]
        out.append("\n".join(kept) if any(x.strip(" ") for x in kept) else None)
    return pd.Series(out, dtype=object)


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with repeated lines taken out of its texts; a document that loses every line that isn't blank goes.

    Documents that lose nothing, null texts and blank texts pass as they are. n_chars, where there is such a column,
    is brought up to date for changed texts. All other columns are untouched.
    """
    p = Positional(df)
    maps = keep_bitmaps(df, id_col, text_col).where("n_kept < n_lines").select(F.col("doc_id").alias("__id"), F.col("keep_runs").alias("__runs"))
    text = p.name(text_col)
    joined = p.df.join(maps, p.col(id_col).cast("bigint") == F.col("__id"), "left")
    changed = joined.withColumn("__new", F.when(F.col("__runs").isNotNull(), _apply(F.when(F.col("__runs").isNotNull(), F.col(text)), "__runs"))).where("__runs is null or __new is not null")
    size = {p.name("n_chars"): F.when(F.col("__runs").isNotNull(), F.length("__new").cast("bigint")).otherwise(p.col("n_chars"))} if "n_chars" in df.columns else {}
    return p.restore(changed.withColumns({text: F.when(F.col("__runs").isNotNull(), F.col("__new")).otherwise(F.col(text)), **size}))


ORACLE_BITMAPS = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), k AS (
  SELECT doc_id, pos, (trim(line) = '' OR row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, pos) = 1) AS keep FROM l
), c AS (
  SELECT *, CASE WHEN keep = lag(keep, 1, true) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS turn FROM k
), g AS (
  SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c
), r AS (
  SELECT doc_id, run, count(*) AS n, sum(CASE WHEN keep THEN 1 ELSE 0 END) AS kept FROM g GROUP BY doc_id, run
)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(kept) AS BIGINT) AS n_kept,
       CASE WHEN min(run) = 1 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS keep_runs
FROM r GROUP BY doc_id
"""
