"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.materialize import materialize

MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node on an edge
    (a, b); a component's smallest node is returned too.  Alternates large-star and small-star steps, written with minimum
    aggregates and joins, so that no task holds a node's neighbours; each round
    is written to the shared folder.  Self-loops are ignored; nodes that are on
    no other edge are not returned.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                        .distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        edges = materialize(small, "edges")
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == (row["n"], row["h"]):
            return (edges.select(a.alias("node"), b.alias("component"))
                    .unionByName(edges.select(b.alias("node"), b.alias("component")).distinct()))
        seen = (row["n"], row["h"])
    raise RuntimeError("components did not settle")
