"""Connected components of an edge table, distributed.

Alternating large-star and small-star steps (Kiveris et al., 2014): each round
is two grouped minima with map-side combining and a join on the node; no link
list is ever gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import Scratch


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch, *, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the smallest node.

    Nulls and self-loops are ignored (a node with only a self-loop has no row).
    Repeated and reversed edges count once. No edges: no rows.
    """
    node_type = edges.schema[a].dataType
    links = (
        edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    links = scratch.save(links, "links")
    seen = _mark(links)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u keeps its smallest smaller neighbour, the others are linked to it
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("e"))
        small = small.select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).where("u <> v").distinct()
        after = scratch.save(small, "links")
        now = _mark(after)
        scratch.drop(links)
        links = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return out.select(F.col("node").cast(node_type), F.col("component").cast(node_type))


def _mark(links: DataFrame) -> tuple:
    """Number of edges and an order-free sum that changes when one of them does."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
