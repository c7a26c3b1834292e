"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import release, shared_table


def _stars(edges: DataFrame, near: DataFrame, large: bool) -> DataFrame:
    """One half of a round. near(u, v): what each node u sees; edges(u, v) with v < u come out.

    Every node's smallest neighbour (or itself) becomes the neighbour of those above it (large), or of itself and those
    below it (small).
    """
    low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    met = near.where("v > u") if large else near
    made = met.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    if not large:
        made = made.unionByName(low.select("u", F.col("low").alias("v")))
    return made.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of edges(a, b); edges with a null end are ignored.

    Alternating large and small stars: each half round points every node at the smallest neighbour it sees, so edges never
    grow in number and paths shorten by half. A hub is only minimised over (a partial aggregate) or joined (which adaptive
    execution splits). Each round is a stored table that replaces the one before; counts and hashes tell when it is stable.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    down = shared_table(down, "edges")
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    seen = down.agg(mark).first()[0]
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = shared_table(_stars(down, both, True), "edges")
        small = shared_table(_stars(large, large, False), "edges")
        release(down, large)
        down, now = small, small.agg(mark).first()[0]
        if now == seen:
            break
        seen = now
    roots = down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
