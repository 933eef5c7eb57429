"""Connected components of an edge table, by alternating large and small stars.

Minima are aggregated before the shuffle and joined back, so a node with very many edges is no hot key. Each round's edges
are written to the shared folder; only their number and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.shared import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(near: DataFrame, keep: str) -> DataFrame:
    """Tie each neighbour v of u that passes ``keep`` (and u, for small stars) to the least of u and its neighbours."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    tied = near.join(least, near["u"] == least["w"]).select("u", "v", "m")
    out = tied.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep != "v > u":
        out = out.unionByName(tied.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id`` and ``component``, the least id that its edges reach, for every node of ``edges`` (u, v) but the least ones.

    A round's edges are dropped once the next ones are written; ``scratch`` drops the last, which the result reads."""
    held = Scratch()
    now = held.written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        large = _star(_both(now), "v > u")
        ordered = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        fresh = Scratch()
        now = fresh.written(_star(ordered, "v <> m"), "edges")
        held.drop()
        held = fresh
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == seen:
            scratch.take(held)
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = state
