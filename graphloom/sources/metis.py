"""METIS graph files.

The first line that is neither empty nor a comment ('%' in its first column) is the header ``n m [fmt [ncon]]``; each
further one is a vertex: ``[size] [weight]*ncon (neighbour [weight])*``, neighbours counted from 1. The format's
bits say what is there: 1 edge weights, 2 vertex weights, 4 vertex sizes.

Lines are read in pieces and numbered by the piece's offset and the line's place in the piece, so a file may be
larger than any task. Nothing but the header and the counts of a check comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph, GraphFormatError, Meta
from ..storage import stored


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value) of the file's lines but empty ones and comments; ordinal is dense from 0.

    A carriage return belongs to its line, so a line of nothing else is not empty.
    """
    try:
        raw = spark.read.option("lineSep", "\n").text(path)
    except Exception as e:
        raise FileNotFoundError(f"Cannot open file: {path}") from e
    kept = raw.select("value", F.col("_metadata.file_block_start").alias("piece")).filter((F.col("value") != "") & ~F.col("value").startswith("%"))
    rows = stored(kept.withColumn("at", F.monotonically_increasing_id()), "lines")
    pieces = rows.groupBy("piece").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_first"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("piece", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "piece").select((F.col("at") - F.col("_first") + F.col("_start")).alias("ordinal"), "value")


def tokens(line: Column) -> Column:
    """The line's words; an empty array for a blank line."""
    return F.filter(F.split(line, r"[ \t\n\x0b\f\r]+"), lambda t: t != "")


def parse_header(line: str) -> Meta:
    words = line.split()
    try:
        numbers = [int(w) for w in words]
    except ValueError as e:
        raise GraphFormatError(f"Invalid header line format: {line.strip()!r}") from e
    if not 2 <= len(numbers) <= 4:
        raise GraphFormatError("Invalid header line format")
    n, m, fmt, ncon = [*numbers, *[0, 1][len(numbers) - 2 :]]
    if n <= 0 or m < 0 or ncon < 0:
        raise GraphFormatError("Invalid graph dimensions")
    return Meta(n, m, fmt % 8, ncon)


def parse_lines(spark: SparkSession, lines: DataFrame) -> Graph:
    """The graph of (ordinal, value) lines, header first; every broken rule raises GraphFormatError."""
    first = lines.filter("ordinal = 0").first()
    if first is None:
        raise GraphFormatError("Invalid graph dimensions")
    meta = parse_header(first["value"])
    n_lines = lines.filter("ordinal > 0").count()
    if n_lines > meta.n:
        raise GraphFormatError("Too many vertex lines in file")
    if n_lines < meta.n:
        raise GraphFormatError("Number of vertex lines doesn't match header")
    n_size, n_weights = int(meta.has_vertex_sizes), meta.ncon * meta.has_vertex_weights
    head, stride = n_size + n_weights, 1 + meta.has_edge_weights
    rows = lines.filter("ordinal > 0").select((F.col("ordinal") - 1).alias("v"), tokens(F.col("value")).alias("t"))
    entries = F.slice("t", head + 1, F.greatest(F.size("t") - head, F.lit(0)))
    rows = rows.withColumn("e", F.when(F.size("t") >= head, entries).otherwise(F.array().cast("array<string>")))
    neighbours = F.filter("e", lambda _, i: i % stride == 0) if stride > 1 else F.col("e")
    number = lambda t: t.try_cast("long")
    ids = F.transform(neighbours, lambda t: number(t) - 1)
    weights = F.transform(F.filter("e", lambda _, i: i % stride == 1), lambda t: t.try_cast("double")) if stride > 1 else F.transform(neighbours, lambda t: F.lit(1.0))
    size = F.try_element_at("t", F.lit(1)).try_cast("int") if n_size else F.lit(None).cast("int")
    own = F.transform(F.slice("t", n_size + 1, n_weights), lambda t: t.try_cast("double")) if n_weights else F.lit(None).cast("array<double>")
    parsed = rows.select("v", "t", "e", size.alias("size"), own.alias("weights"), neighbours.alias("words"), ids.alias("ids"), weights.alias("ws"))
    bad_id = F.try_element_at(F.filter(F.arrays_zip("words", "ids"), lambda p: p["ids"].isNull() | (p["ids"] < 0) | (p["ids"] >= meta.n)), F.lit(1))["words"]
    at = (F.col("v") + 1).cast("string")  # a file counts its vertices from 1
    problem = F.coalesce(
        F.when(F.lit(bool(n_size)) & (F.size("t") < 1), F.concat(F.lit("Missing vertex size on line for vertex "), at)),
        F.when(F.lit(bool(n_size)) & F.col("size").isNull(), F.concat(F.lit("Invalid vertex size on line for vertex "), at)),
        F.when(F.lit(bool(n_weights)) & (F.size("t") < head), F.concat(F.lit("Missing vertex weight on line for vertex "), at)),
        F.when(F.lit(bool(n_weights)) & F.exists("weights", lambda w: w.isNull()), F.concat(F.lit("Invalid vertex weight on line for vertex "), at)),
        F.when(bad_id.isNotNull(), F.concat(F.lit("Invalid neighbor vertex index: "), bad_id)),
        F.when(F.lit(stride == 2) & (F.size("e") % 2 == 1), F.concat(F.lit("Missing edge weight for vertex "), at)),
        F.when(F.exists("ws", lambda w: w.isNull()), F.concat(F.lit("Invalid edge weight for vertex "), at)),
        F.when(F.exists("ws", lambda w: w <= 0), F.lit("Edge weight must be positive")),
    )
    worst = parsed.select("v", problem.alias("p")).filter("p IS NOT NULL").agg(F.min(F.struct("v", "p")).alias("x")).first()["x"]
    if worst is not None:
        raise GraphFormatError(worst["p"])
    edges = parsed.select(F.col("v").alias("src"), F.posexplode(F.arrays_zip("ids", "ws")).alias("pos", "e")).select("src", F.col("e.ids").alias("dst"), "pos", F.col("e.ws").alias("w"))
    return Graph(meta, parsed.select("v", "size", "weights"), edges)


def read_graph(spark: SparkSession, path: str) -> Graph:
    return parse_lines(spark, read_lines(spark, path))


def format_lines(graph: Graph, m: int | None = None) -> DataFrame:
    """(ordinal, value) of the graph as a file: header, then a line for each vertex, its entries in order.

    A vertex without entries gives a line of one blank, which readers don't skip.
    """
    spark = graph.vertices.sparkSession
    entry = F.concat((F.col("dst") + 1).cast("string"), F.lit(" "), F.col("w").cast("string")) if graph.meta.has_edge_weights else (F.col("dst") + 1).cast("string")
    lists = graph.edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", entry.alias("x")))).alias("l"))
    parts = [F.when(F.lit(graph.meta.has_vertex_sizes), F.col("size").cast("string")), F.array_join(F.transform(F.when(F.lit(graph.meta.has_vertex_weights), F.col("weights")), lambda w: w.cast("string")), " "), F.array_join(F.transform("l", lambda e: e["x"]), " ")]
    rows = graph.vertices.join(lists, F.col("v") == F.col("src"), "left").select((F.col("v") + 1).alias("ordinal"), F.concat_ws(" ", *parts).alias("value"))
    rows = rows.withColumn("value", F.when(F.col("value") == "", " ").otherwise(F.col("value")))
    header = f"{graph.n} {graph.meta.m if m is None else m} {graph.meta.fmt} {graph.meta.ncon}"
    return rows.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("ordinal"), F.lit(header).alias("value")))


def write_graph(graph: Graph, path: str, m: int | None = None) -> None:
    """One text file in a folder; for graphs that one writer can hold on its disk."""
    format_lines(graph, m).orderBy("ordinal").coalesce(1).select("value").write.text(path)
