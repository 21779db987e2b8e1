"""Connected components by alternating star contraction (Kiveris et al., 2014), as joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.scratch import materialize, release


def _edge_state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", name: str = "components") -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is the smallest node id reachable.

    Each round hangs every neighbour on the smallest id it can see; rounds end when the edge table stops changing.
    Edge tables are written to the shared folder each round, so lineage stays short and lost executors cost one round.
    Self loops and null ends are ignored.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v").distinct()
    now = materialize(now, name)
    state = _edge_state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        before, now = now, materialize(small.where("u > v").distinct(), name)
        release(before, large)
        after = _edge_state(now)
        if after == state:
            break
        state = after
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
