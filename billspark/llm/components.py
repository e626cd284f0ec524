"""Connected components of a graph given as edge rows, by alternating large and small stars.

Each round links every vertex to the smallest one it has met, so the number of rounds grows with the
logarithm of the longest path. Rounds are written to the shared folder, which cuts the lineage; no
edge is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` for every vertex of ``edges`` (``a``, ``b``); the component is its smallest vertex.

    Loops and repeated edges are allowed; edges with a missing end are ignored. Vertices that only
    have loops are not returned.
    """
    now = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        now = materialize(small.select("e.*").filter("u <> v").distinct(), "edges")
    ends = now.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return ends.unionByName(roots)
