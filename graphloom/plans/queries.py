"""The library's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import grid_dimensions, grid_side, in_cross
from ..operators import ordering, quality, ranks, separators, stats
from ..model import Graph, Meta
from ..sources import grid, metis, tables
from ..storage import scratch

Query = Callable[[SparkSession, str], DataFrame]
#: Sides of the generated grids.
SIDE, SMALL_SIDE = 50, 20
GRAPHS = {"bip": tables.parts_and_suppliers, "path": tables.event_paths, "star": tables.customers_and_orders}


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elimination order of the event paths: degrees, classification, geometric levels, fold."""
    return ordering.order_graph(stats.detect(tables.event_paths(spark, sf_dir)))


def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.degrees(tables.parts_and_suppliers(spark, sf_dir))


def degree_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.legacy_degrees(tables.parts_and_suppliers(spark, sf_dir))


def _all_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [stats.classified(stats.degree_stats(stats.degrees(make(spark, sf_dir)))).select(F.lit(name).alias("graph"), "*") for name, make in GRAPHS.items()]
    return reduce(DataFrame.unionByName, found)


def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _all_stats(spark, sf_dir).select("graph", "n", "nnz", "n_edges", "avg_degree", "min_degree", "max_degree", "median_degree")
    return _rounded(out, "avg_degree")


def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.degree_histogram(stats.degrees(tables.customers_and_orders(spark, sf_dir)))


def classify_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_all_stats(spark, sf_dir).select("graph", "share_2_to_4", "structured"), "share_2_to_4")


def fill_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_stats(spark, sf_dir).select("graph", F.round("fill_reduction", 6).alias("fill_reduction"))


def grid_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") + 1).alias("n")).distinct()
    return n.select("n", grid_dimensions(F.col("n")).alias("d")).select("n", "d.width", "d.height")


def grid_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid(spark, SIDE).edges


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.laplacian(grid.grid(spark, SMALL_SIDE))


def csr_row_ptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.row_offsets(tables.parts_and_suppliers(spark, sf_dir))


def load_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stars' entries as CSR arrays, and back."""
    graph = tables.customers_and_orders(spark, sf_dir)
    offsets = stats.row_offsets(graph).select("v", "row_ptr")
    entries = graph.edges.join(offsets, F.col("src") == F.col("v")).select((F.col("row_ptr") + F.col("pos")).alias("at"), "dst", "w")
    return grid.edges_from_csr(offsets, entries, graph.n)


def geometric_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables.event_paths(spark, sf_dir)
    g = grid_side(graph.n)
    side = F.lit(g).cast("long")
    return graph.vertices.select("v", in_cross(F.col("v"), g, F.lit(0).cast("long"), side, side).cast("int").alias("in_separator"))


def geometric_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables.event_paths(spark, sf_dir)
    g = grid_side(graph.n)
    return separators.geometric(*separators.root_list(graph), g, 0, g, g)


def median_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.spectral(*separators.root_list(tables.parts_and_suppliers(spark, sf_dir)))


def rank_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle twentieth of parts and suppliers by degree."""
    graph = tables.parts_and_suppliers(spark, sf_dir)
    members, size = separators.root_list(graph)
    return separators.by_value(members.join(stats.degrees(graph), "v"), size, "degree")


def general_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.general_geometric(*separators.root_list(tables.customers_and_orders(spark, sf_dir)))


def multilevel_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables.event_paths(spark, sf_dir)
    return separators.multilevel(*separators.root_list(graph), graph.edges)


def alternating_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, size = separators.root_list(tables.customers_and_orders(spark, sf_dir))
    return separators.alternating_split(members, separators.spectral(members, size))


def order_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.order_graph(tables.parts_and_suppliers(spark, sf_dir))


def order_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.order_graph(stats.detect(tables.event_paths(spark, sf_dir)))


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.order_graph(grid.grid(spark, SIDE))


def _general_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.tree(ordering.assignment(spark, tables.customers_and_orders(spark, sf_dir).n))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _general_tree(spark, sf_dir)


def tree_nodes_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = stats.detect(tables.event_paths(spark, sf_dir))
    return ordering.tree(ordering.assignment(spark, graph.n, graph.grid_size))


def separator_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.quality(_general_tree(spark, sf_dir).filter("kind <> 'leaf'")), "quality", "balance")


def _root_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    graph = tables.parts_and_suppliers(spark, sf_dir)
    members, size = separators.root_list(graph)
    sep = separators.spectral(members, size)
    return sep, separators.alternating_split(members, sep), graph.edges


def refine_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.refine(*_root_split(spark, sf_dir))


def edge_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sides, edges = _root_split(spark, sf_dir)
    return quality.edge_cut(sides, edges)


def edge_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the line items, repeated pairs included, would do as the number of edges."""
    graph = tables.parts_and_suppliers(spark, sf_dir)
    return stats.entry_check(graph.n, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count(), graph.edges)


def metis_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stars written as a graph file's lines and parsed again."""
    graph = tables.customers_and_orders(spark, sf_dir)
    lines = metis.format_lines(graph, spark.read.parquet(f"{sf_dir}/orders.parquet").count())
    return metis.parse_lines(spark, lines).edges


def metis_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stars as a graph file with vertex sizes, two vertex weights, edge weights, comments and empty lines, written and read again.

    A row for each entry, or one for a vertex without entries: (v, size, weight_1, weight_2, pos, dst, w).
    """
    graph = tables.customers_and_orders(spark, sf_dir)
    v = F.col("v")
    vertices = graph.vertices.select("v", (v % 11 + 1).cast("int").alias("size"), F.array((v % 3).cast("double"), v % 5 + 0.25).alias("weights"))
    edges = graph.edges.withColumn("w", (F.col("src") + F.col("dst")) % 7 + 0.5)
    whole = Graph(Meta(graph.n, spark.read.parquet(f"{sf_dir}/orders.parquet").count(), 7, 2), vertices, edges)
    lines = metis.format_lines(whole).withColumn("ordinal", F.col("ordinal").cast("double"))
    extra = spark.range(-1, graph.n, 50).select(F.inline(F.array(*[F.struct((F.col("id") + at).alias("ordinal"), F.lit(text).alias("value")) for at, text in ((0.25, "% 1 2 3"), (0.5, ""), (0.75, "%"))])))
    path = scratch(spark, "graph")
    lines.unionByName(extra).orderBy("ordinal").coalesce(1).select("value").write.text(path)
    read = metis.read_graph(spark, path)
    entries = read.edges.withColumnRenamed("src", "v")
    return read.vertices.join(entries, "v", "left").select("v", "size", F.col("weights")[0].alias("weight_1"), F.col("weights")[1].alias("weight_2"), "pos", "dst", "w")


def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stencil of a grid times the vertex numbers."""
    g = grid.grid(spark, SIDE)
    return stats.matvec(g.edges, g.vertices.select("v", F.col("v").cast("double").alias("x")))


def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of the stars by falling degree."""
    return ranks.ranked(stats.degrees(tables.customers_and_orders(spark, sf_dir)), F.desc("degree"), "v")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        degree, degree_legacy, degree_stats, degree_histogram, classify_graph, fill_estimate, grid_dims, grid_stencil, laplacian, csr_row_ptr, load_csr,
        geometric_mask, geometric_separator, median_slice, rank_partition, general_geometric, multilevel_separator, alternating_split, order_general,
        order_structured, order_grid, tree_nodes, tree_nodes_structured, separator_quality, refine_separator, edge_cut, edge_count_check, metis_tokens, metis_file, matvec, global_rank,
    )
}
