"""Connected components of an edge table by alternating large and small stars, all in DataFrame operations.

Each round joins the edges with the least neighbour of every node (a partial aggregate, so a hub costs one row a
task) and is written to the shared folder. The rounds end when a round changes nothing; their number grows with the
logarithm of the longest chain. No component is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import discard, materialize


def _mark(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's least neighbour."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the least of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.union(least.select("src", F.col("m").alias("dst"))).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node. Loops are ignored."""
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        new = materialize(_small(_large(now)), "stars")
        after = _mark(new)
        discard(now)
        now = new
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
