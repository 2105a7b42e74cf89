"""The graph model: one row of scalars and two DataFrames.

vertices(v BIGINT, size INT, weights ARRAY<DOUBLE>), v dense from 0
edges(src BIGINT, dst BIGINT, pos INT, w DOUBLE), a row for each stored adjacency entry, pos its place in src's list
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GraphFormatError(ValueError):
    """A graph file, or arrays of a graph, that break their format."""


@dataclass(frozen=True)
class Meta:
    """A graph file's header: vertices, edges, format code and weights to a vertex."""

    n: int
    m: int
    fmt: int = 0
    ncon: int = 1

    @property
    def has_edge_weights(self) -> bool:
        return bool(self.fmt & 1)

    @property
    def has_vertex_weights(self) -> bool:
        return bool(self.fmt & 2)

    @property
    def has_vertex_sizes(self) -> bool:
        return bool(self.fmt & 4)


@dataclass(frozen=True)
class Graph:
    meta: Meta
    vertices: DataFrame
    edges: DataFrame
    #: Side of the square grid that geometric separators assume; 0 for a general graph.
    grid_size: int = 0

    @property
    def n(self) -> int:
        return self.meta.n

    @classmethod
    def from_edges(cls, spark: SparkSession, n: int, edges: DataFrame, m: int | None = None, grid_size: int = 0) -> Graph:
        """A graph over 0..n-1; edges need src, dst, pos and may have w, 1.0 where it is missing."""
        w = F.coalesce(F.col("w"), F.lit(1.0)) if "w" in edges.columns else F.lit(1.0)
        edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("pos").cast("int"), w.cast("double").alias("w"))
        vertices = spark.range(n).select(F.col("id").alias("v"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<double>").alias("weights"))
        return cls(Meta(n, -1 if m is None else m), vertices, edges, grid_size)
