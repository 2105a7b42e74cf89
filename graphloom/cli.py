"""Command line: read or generate a graph, order it, report."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalars import fill_reduction
from .model import Graph
from .operators import ordering, stats
from .sources import grid, metis
from .storage import clear

TEST_SIDE = 50


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Elimination orders of sparse graphs.")
    source = p.add_argument_group("source; a file goes before a grid, a grid before the test")
    source.add_argument("-metis", metavar="FILE", help="graph in METIS format")
    source.add_argument("-grid", metavar="SIDE", type=int, help="generated square grid, for example 500")
    source.add_argument("-test", action="store_true", help=f"grid of {TEST_SIDE} with analysis")
    p.add_argument("-analysis", action="store_true", help="print statistics of the graph")
    p.add_argument("-tree", action="store_true", help="print the separator tree")
    p.add_argument("-o", "--output", metavar="DIR", help="write the order as Parquet")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    began = time.time()
    if args.metis:
        graph = stats.detect(metis.read_graph(spark, args.metis))
        analysis = args.analysis
    else:
        side = args.grid if args.grid else TEST_SIDE
        graph: Graph = grid.grid(spark, side)
        analysis = args.analysis or not args.grid
    print(f"graph: {graph.n} vertices, {time.time() - began:.1f} s")
    if analysis:
        print(stats.analysis(spark, graph))
    began = time.time()
    assign = ordering.assignment(spark, graph.n, graph.grid_size).cache()
    size = assign.count()
    print(f"order: {size} vertices, {time.time() - began:.1f} s")
    if args.tree:
        for row in ordering.tree_lines(ordering.tree(assign)).toLocalIterator():
            print(row["line"])
    if args.output:
        assign.select((F.col("off") + F.col("own")).alias("new_idx"), "v").write.parquet(args.output)
    nnz = graph.edges.count()
    row = spark.range(1).select(fill_reduction(F.lit(graph.n), F.lit(nnz), F.lit(graph.grid_size > 0)).alias("x")).first()
    print(f"estimated fill reduction: {row['x']:.4f} %")
    assign.unpersist()
    return 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not args.metis and not (args.grid and args.grid > 0) and not args.test:
        p.print_usage(sys.stderr)
        return 1
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        return run(spark, args)
    except (metis.GraphFormatError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        clear(spark)


if __name__ == "__main__":
    sys.exit(main())
