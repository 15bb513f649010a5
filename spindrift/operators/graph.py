"""Connected components of edges that may be many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, root) for nodes that aren't their own root.

    Alternating large-star and small-star steps over narrow rows; root is the least id of a component. Each round is
    written to the shared folder, so no lineage grows, and the table of the round before is deleted then. Least
    neighbours come from aggregates, which combine before they shuffle, and from joins, which are split where a node has very
    many neighbours. Rows with a null or a self loop add nothing.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = stored(e, "edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == tuple(now) or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # both ends of an edge go to the least neighbour of its lesser end
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("far")).join(least, "u").select(F.col("far").alias("u"), F.least("u", "m").alias("v"))
        large, between = stored(large.where("u <> v").distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e, new = stored(small.where("u <> v").distinct(), "edges")
        discard(e.sparkSession, path)
        discard(e.sparkSession, between)
        path = new
