"""How good a separator is, and refining it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import balance_ratio, separator_quality

#: A refinement makes so many passes, and moves a vertex whose sides differ by more than this.
PASSES, MARGIN = 5, 2


def quality(nodes: DataFrame) -> DataFrame:
    """(node_id, quality, balance) of rows with sep_size, a_size and b_size."""
    return nodes.select("node_id", separator_quality(F.col("sep_size"), F.col("a_size"), F.col("b_size")).alias("quality"), balance_ratio(F.col("a_size"), F.col("b_size")).alias("balance"))


def side_counts(sep: DataFrame, sides: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, sep_pos, conn_a, conn_b): entries of each separator vertex that end in A and in B, parallel ones counted."""
    ends = edges.join(sep.select(F.col("v").alias("src")), "src", "left_semi").join(sides.select(F.col("v").alias("dst"), "side"), "dst")
    found = ends.groupBy("src").agg(F.sum(F.when(F.col("side") == "A", 1).otherwise(0)).alias("_a"), F.sum(F.when(F.col("side") == "B", 1).otherwise(0)).alias("_b"))
    return sep.join(found, F.col("v") == F.col("src"), "left").select("v", "sep_pos", F.coalesce("_a", F.lit(0)).cast("long").alias("conn_a"), F.coalesce("_b", F.lit(0)).cast("long").alias("conn_b"))


def refine(sep: DataFrame, sides: DataFrame, edges: DataFrame, passes: int = PASSES) -> DataFrame:
    """(v, sep_pos) without the first vertices, one for each pass, that clearly belong to one side.

    A and B don't change between passes, so neither do the counts: the passes drop the first such vertices at once.
    """
    counts = side_counts(sep, sides, edges)
    lopsided = counts.filter(F.abs(F.col("conn_a") - F.col("conn_b")) > MARGIN).orderBy("sep_pos").limit(passes)
    return sep.join(F.broadcast(lopsided.select("v")), "v", "left_anti").select("v", "sep_pos")


#: Fixed value: passes of the longer refinement.
LONG_PASSES = 10


def kernighan_lin(sep: DataFrame, sides: DataFrame, edges: DataFrame, passes: int = LONG_PASSES) -> DataFrame:
    """The refinement with more passes. Our own definition: it is only declared where the other one is defined."""
    return refine(sep, sides, edges, passes)


def edge_cut(sides: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entries from A to B, which no separator vertex is an end of. Our own definition."""
    a = sides.filter("side = 'A'").select(F.col("v").alias("src"))
    b = sides.filter("side = 'B'").select(F.col("v").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").agg(F.count(F.lit(1)).alias("edge_cut"))
