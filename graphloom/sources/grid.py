"""Generated grids and graphs from CSR arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph, GraphFormatError


def grid_edges(spark: SparkSession, g: int, include_diagonal: bool = True) -> DataFrame:
    """The five-point stencil of a g x g grid: (src, dst, pos, w), diagonal 4, neighbours -1, in the order
    diagonal, up, down, left, right. One projection of a range, no shuffle.
    """
    v = F.col("id")
    x, y = F.pmod(v, F.lit(g)), F.expr(f"id div {g}")
    entry = lambda there, at, w: F.when(there, F.struct(at.alias("dst"), F.lit(w).alias("w")))
    cells = [entry(y > 0, v - g, -1.0), entry(y < g - 1, v + g, -1.0), entry(x > 0, v - 1, -1.0), entry(x < g - 1, v + 1, -1.0)]
    if include_diagonal:
        cells.insert(0, entry(F.lit(True), v, 4.0))
    rows = spark.range(g * g).select(v.alias("src"), F.posexplode(F.array_compact(F.array(*cells))).alias("pos", "e"))
    return rows.select("src", F.col("e.dst").alias("dst"), "pos", F.col("e.w").alias("w"))


def grid(spark: SparkSession, g: int, include_diagonal: bool = True) -> Graph:
    """The grid as a graph; its separators are geometric."""
    return Graph.from_edges(spark, g * g, grid_edges(spark, g, include_diagonal), 2 * g * (g - 1), g)


#: Places that one row is spread over at once.
CHUNK = 65_536


def check_csr(n: int, offsets: DataFrame, entries: DataFrame) -> None:
    """Raises GraphFormatError unless offsets (v, row_ptr) are n + 1, dense in v, don't decrease, start at 0 and end where entries (at, dst) do, and every dst is a vertex."""
    step = offsets.alias("a").join(offsets.select((F.col("v") - 1).alias("v"), F.col("row_ptr").alias("_end")), "v", "left")
    o = step.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("dense"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.coalesce(F.bool_or(F.col("_end") < F.col("row_ptr")), F.lit(False)).alias("down"), F.max(F.when(F.col("v") == n, F.col("row_ptr"))).alias("last"), F.max(F.when(F.col("v") == 0, F.col("row_ptr"))).alias("first"),
    ).first()
    if (o["n"], o["dense"], o["lo"], o["hi"]) != (n + 1, n + 1, 0, n):
        raise GraphFormatError("Invalid row_ptr size")
    if o["down"]:
        raise GraphFormatError("Invalid CSR structure - non-monotonic row_ptr")
    e = entries.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("at").alias("dense"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.min(F.when(~F.col("dst").between(0, n - 1), F.col("dst"))).alias("bad")).first()
    if e["bad"] is not None:
        raise GraphFormatError(f"Invalid adjacency index: {e['bad']}")
    if o["first"] != 0 or o["last"] != e["n"] or e["dense"] != e["n"] or (e["n"] and (e["lo"], e["hi"]) != (0, e["n"] - 1)):
        raise GraphFormatError("Invalid row_ptr size")


def edges_from_csr(offsets: DataFrame, entries: DataFrame, n: int | None = None) -> DataFrame:
    """(src, dst, pos, w) from row offsets (v, row_ptr), v from 0 to n, and entries (at, dst, w); with n, the arrays are checked first.

    Row v owns the entries from its offset to the next one. Offsets become ranges, and each range is spread
    over its entries' places, CHUNK of them in a step, so a long row is no long array and the join is an equality.
    """
    if n is not None:
        check_csr(n, offsets, entries)
    nxt = offsets.select((F.col("v") - 1).alias("v"), F.col("row_ptr").alias("end"))
    ranges = offsets.join(nxt, "v").filter("end > row_ptr")
    chunks = ranges.select("v", "row_ptr", "end", F.explode(F.sequence(F.col("row_ptr"), F.col("end") - 1, F.lit(CHUNK).cast("long"))).alias("_from"))
    places = chunks.select(F.col("v").alias("src"), "row_ptr", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + CHUNK, F.col("end")) - 1)).alias("at"))
    return places.join(entries, "at").select("src", "dst", (F.col("at") - F.col("row_ptr")).cast("int").alias("pos"), "w")
