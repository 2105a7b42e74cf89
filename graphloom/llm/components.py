"""Connected components by alternating large and small stars.

Every round is two aggregates and two joins over edges, which stay distributed; edges shrink to one for each
vertex that isn't the least of its component. A vertex with very many neighbours is one row of an
aggregate and a skewed key of a join. The aggregate is stored before it is joined, so both sides of the join are plain
reads: adaptive execution can split the skewed key, and broadcasts the aggregate while its files are small. Nobody lists a vertex's neighbours in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _toward_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, each once."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every neighbour of u that is above u is tied to u's least neighbour, or to u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts), "least")
    out = stored(_toward_least(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).coalesce(parts), "large")
    discard(least)
    return out


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """u and its neighbours below it are tied to the least of those."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("v")).coalesce(parts), "least")
    mine = least.select("u", F.col("v").alias("m"))
    others = edges.join(mine, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stored(_toward_least(others.unionByName(least)).coalesce(parts), "edges")
    discard(least)
    return out


#: Edges of one file at least, so that few edges make few tasks.
EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for each vertex of edges (u, v) that isn't the least of its component. Each round's edges replace the last one's."""
    edges = stored(_toward_least(edges), "edges")
    mark = None
    while True:
        done = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if done == mark or not done[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        mark = done
        parts = -(-done[0] // EDGES)
        large = _large_star(edges, parts)
        discard(edges)
        edges = _small_star(large, parts)
        discard(large)
