"""Connected components of a graph given as rows, by alternating stars.

Each round hangs every node's larger neighbours on the smallest node it knows, then its smaller
ones, until the rows no longer change; they are then stars around each component's smallest node.
Rounds are few (about the logarithm of the longest path). Only minima are gathered at a node; they
are written, and other rows meet them in a join that can split a large node, so a node may have any
number of links. Each round is written to the shared folder, which ends its lineage; what a round
has written on its way is deleted after it, and older rounds once the last is known.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.frames import discard, settle


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.select("a", "b").unionByName(turned)
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = settle(least.select("a", F.least("a", "m").alias("m")), "least-known")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = settle(down.groupBy("a").agg(F.min("b").alias("m")), "least-below")
    moved = down.join(least, "a").where("b != m")
    moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is its component's least node.

    Loops and repeated rows are allowed, and no edges give no rows.
    """
    with discard(edges.sparkSession) as keep:
        edges = settle(edges.where("a != b").distinct(), "edges")
        before = None
        while (now := _state(edges)) != before:
            before = now
            with discard(edges.sparkSession) as keep_round:
                edges = keep_round(settle(_small_star(_large_star(edges)), "stars"))
        keep(edges)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(tops).distinct()
