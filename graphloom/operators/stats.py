"""Degrees, their statistics and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import STRUCTURED_SHARE, fill_reduction, grid_side
from ..model import Graph
from .ranks import running_sums


def degrees(graph: Graph) -> DataFrame:
    """(v, degree) of every vertex. Vertices and entries are summed together: one shuffle, no join."""
    ones = graph.edges.select(F.col("src").alias("v"), F.lit(1).alias("one"))
    zeros = graph.vertices.select("v", F.lit(0).alias("one"))
    return ones.unionByName(zeros).groupBy("v").agg(F.sum("one").cast("long").alias("degree"))


def legacy_degrees(graph: Graph) -> DataFrame:
    """(v, degree) as if row offsets had been shifted twice: v has the degree of v - 1, and 0 has none."""
    moved = degrees(graph).filter(F.col("v") < graph.n - 1).select((F.col("v") + 1).alias("v"), "degree")
    return moved.unionByName(graph.vertices.filter("v = 0").select("v", F.lit(0).cast("long").alias("degree")))


def row_offsets(graph: Graph) -> DataFrame:
    """(v, row_ptr, legacy_row_ptr) for v from 0 to n: entries before row v, and the same shifted once more."""
    degree = degrees(graph).unionByName(graph.vertices.sparkSession.range(1).select(F.lit(graph.n).cast("long").alias("v"), F.lit(0).cast("long").alias("degree")))
    sums = running_sums(degree, [], "v", {"row_ptr": F.col("degree")})
    shifted = sums.filter(F.col("v") < graph.n).select((F.col("v") + 1).alias("v"), F.col("row_ptr").alias("legacy_row_ptr"))
    return sums.join(shifted, "v", "left").select("v", "row_ptr", F.coalesce("legacy_row_ptr", F.lit(0)).cast("long").alias("legacy_row_ptr"))


def degree_histogram(degree: DataFrame) -> DataFrame:
    return degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n_vertices"))


def degree_stats(degree: DataFrame) -> DataFrame:
    """One row: n, nnz, n_edges, avg_degree, min_degree, max_degree, median_degree (the upper one), share of degrees 2 to 4.

    All of it comes from the histogram; the median is the degree at which the running count passes n div 2.
    """
    order = Window.orderBy("degree")
    hist = degree_histogram(degree).withColumn("upto", F.sum("n_vertices").over(order)).withColumn("n", F.sum("n_vertices").over(Window.partitionBy()))
    passed = F.col("upto") > F.shiftright(F.col("n"), 1)
    total = F.sum(F.col("degree") * F.col("n_vertices"))
    return hist.agg(
        F.max("n").alias("n"),
        total.alias("nnz"),
        F.shiftright(total, 1).alias("n_edges"),
        (total / F.max("n")).alias("avg_degree"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
        F.min(F.when(passed, F.col("degree"))).alias("median_degree"),
        (F.sum(F.when(F.col("degree").between(2, 4), F.col("n_vertices")).otherwise(0)) / F.max("n")).alias("share_2_to_4"),
    )


def classified(stats: DataFrame) -> DataFrame:
    """stats with ``structured`` and the estimate of fill reduction."""
    return stats.withColumn("structured", F.col("share_2_to_4") > STRUCTURED_SHARE).withColumn("fill_reduction", fill_reduction(F.col("n"), F.col("nnz"), F.col("structured")))


def detect(graph: Graph, legacy: bool = False) -> Graph:
    """The graph with the grid size that its degrees suggest: 0 unless it is structured."""
    degree = legacy_degrees(graph) if legacy else degrees(graph)
    structured = classified(degree_stats(degree)).first()["structured"]
    return Graph(graph.meta, graph.vertices, graph.edges, grid_side(graph.n) if structured else 0)


def entry_check(n: int, m: int, edges: DataFrame) -> DataFrame:
    """One row: n, m, entries and whether they are off from 2 m by more than a tenth of m."""
    return edges.agg(F.count(F.lit(1)).alias("n_entries")).select(
        F.lit(n).cast("long").alias("n"), F.lit(m).cast("long").alias("m"), "n_entries", (F.abs(F.col("n_entries") - 2 * m) > 0.1 * m).alias("edge_count_warning")
    )


def laplacian(graph: Graph) -> DataFrame:
    """Entries with the Laplacian's values: the row's length on the diagonal, where it is stored, else -1."""
    diagonal = graph.edges.filter("src = dst").join(degrees(graph), F.col("src") == F.col("v")).select("src", "dst", "pos", F.col("degree").cast("double").alias("w"))
    return graph.edges.filter("src <> dst").select("src", "dst", "pos", F.lit(-1.0).alias("w")).unionByName(diagonal)


def matvec(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(v, y): the matrix of edges times x (v, x); rows without entries are left out."""
    return edges.join(x, F.col("dst") == F.col("v")).groupBy("src").agg(F.sum(F.col("w") * F.col("x")).alias("y")).withColumnRenamed("src", "v")


def analysis(spark: SparkSession, graph: Graph) -> str:
    """A report of the statistics, for people."""
    row = classified(degree_stats(degrees(graph))).first()
    kind = f"structured grid, about {graph.grid_size} x {graph.grid_size}" if graph.grid_size else "general graph"
    lines = [
        f"vertices: {row['n']}", f"edges: {row['n_edges']} (undirected)", f"average degree: {row['avg_degree']:g}",
        f"degrees: {row['min_degree']} to {row['max_degree']}, median {row['median_degree']}", f"type: {kind}",
    ]
    lines += [f"vertex weights: {graph.meta.ncon} each"] * graph.meta.has_vertex_weights + ["edge weights: present"] * graph.meta.has_edge_weights + ["vertex sizes: present"] * graph.meta.has_vertex_sizes
    return "\n".join(lines)
