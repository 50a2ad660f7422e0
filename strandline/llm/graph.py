"""Connected components by alternating stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Each round makes every node point at the smallest neighbour it knows, first from its larger
    side and then from its smaller one; rounds grow with the logarithm of the component size.
    Loops, repeated and null-ended edges add nothing. Edges stay distributed: each round is written to the
    shared folder, and only a count and a checksum reach the driver. Hubs are joined against one
    row for each node, so that adaptive execution may split them.
    """
    u, v = F.col("u"), F.col("v")
    edges = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where(u != v)
        .distinct()
    )
    edges = written(edges, "edges")
    before = _state(edges)
    for _ in range(max_rounds if before[0] else 0):
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct(u, F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(u != v)
            .distinct()
        )
        edges = written(small, "edges", before[0])
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = edges.select(u.alias("node"), v.alias("root"))
    return roots.unionByName(edges.select(v.alias("node"), v.alias("root")).distinct())
