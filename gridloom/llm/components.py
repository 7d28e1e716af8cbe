"""Connected components by alternating large and small stars.

Each round replaces every edge by edges to the smallest neighbour: large stars
join a node's larger neighbours to the smallest node around it, small stars its
smaller ones. Rounds needed grow with the logarithm of the graph's size. A hub is
a group of edges that a minimum reduces before the shuffle, and the joins with
the minima are plain equi-joins whose skewed side the engine splits. Each round
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import Stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Each node's neighbours (all, or the smaller ones) go to the smallest of them and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    if large:
        found = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        found = both.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        found = found.unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return found.where("a > b").distinct()


def components(stage: Stage, links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of the nodes of links (a, b) of any one type; component is the smallest node. Nulls are no nodes."""
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage.write(edges)
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    for _ in range(limit):
        if not seen[0]:
            break
        wide = stage.write(_star(edges, True))
        after = stage.write(_star(wide, False))
        stage.drop(edges)
        stage.drop(wide)
        now = mark(after)
        edges = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not final after {limit} rounds")
    own = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
