"""Graphs derived from ordinary tables. Every edge is stored in both directions, neighbours in ascending order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Neighbours of one source that are numbered together: those whose numbers have this quotient in common.
SPAN = 1 << 20


def both_ways(pairs: DataFrame) -> DataFrame:
    """(src, dst, pos) from undirected (a, b): both directions, pos by the neighbour's number.

    A source's neighbours are numbered in spans of their numbers, and a span starts where those before it end, so no task numbers
    a whole hub.
    """
    rows = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))
    rows = rows.withColumn("_span", F.floor(F.col("dst") / SPAN))
    before = Window.partitionBy("src").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("src", "_span").agg(F.count(F.lit(1)).alias("_n")).select("src", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("src", "_span").orderBy("dst")) - 1
    # Only later spans have a start other than 0; a source within the first one needs no partner.
    later = starts.filter("_start > 0")
    return rows.withColumn("_at", inside).join(later, ["src", "_span"], "left").select("src", "dst", (F.col("_at") + F.coalesce("_start", F.lit(0))).cast("int").alias("pos"))


def parts_and_suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts p and suppliers P + s, joined where a line item has both."""
    n_parts = _table(spark, sf_dir, "part").count()
    n = n_parts + _table(spark, sf_dir, "supplier").count()
    pairs = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + n_parts).alias("b")).distinct()
    return Graph.from_edges(spark, n, both_ways(pairs))


def event_paths(spark: SparkSession, sf_dir: str) -> Graph:
    """Events, each joined to its user's next one."""
    events = _table(spark, sf_dir, "events")
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select(F.col("event_id").alias("a"), nxt.alias("b")).filter("b IS NOT NULL")
    return Graph.from_edges(spark, events.count(), both_ways(pairs))


def customers_and_orders(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers c and orders C + o, joined where a customer placed the order."""
    n_customers = _table(spark, sf_dir, "customer").count()
    orders = _table(spark, sf_dir, "orders")
    pairs = orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") + n_customers).alias("b"))
    return Graph.from_edges(spark, n_customers + orders.count(), both_ways(pairs))
