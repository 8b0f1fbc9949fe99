"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import hot_join, scratch

_log = logging.getLogger(__name__)


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """Links what is around each vertex u to the smallest m there: the larger neighbours (large star), or the smaller ones and u itself.

    n: the number of edges."""
    pairs = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("uses")), "least")
    around = hot_join(pairs, least, ["u"], "uses", n * (1 + large)).withColumn("m", F.least("u", "m"))
    if large:
        out = around.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = around.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for every vertex u that isn't the smallest of its component, the smallest v.

    edges: (u, v) of one comparable type, in any direction, repeated or not; null ends are left out, and an empty table
    gives an empty result. Alternates large and small stars until nothing changes, O(log^2 n) rounds, each of which is
    logged; the edges never become more, and no vertex's edges are gathered into one row or one task.
    Each round is written to the shared folder."""
    now = scratch(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark, rounds = None, 0
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if seen == mark or not seen["n"]:
            return now
        mark, rounds = seen, rounds + 1
        _log.info("components: round %d, %d edges", rounds, seen["n"])
        half = scratch(_star(now, seen["n"], True), "edges")
        now = scratch(_star(half, half.count(), False), "edges")
