"""The separator tree and the elimination order.

Without a grid, nothing but a vertex's place in its list decides where it goes, so its whole way down the
tree is a fold over at most ``depth`` steps of arithmetic in its own row: no shuffle, no loop over tables.
With a grid, the nodes of a level whose windows are wide enough are cut on the cross of their window; that
needs the rank of every vertex among the others of its node that stay, which is one keyed running sum for
a level. Below those levels the fold takes over.

Nodes are numbered as in a heap: 1 is the root, 2k and 2k + 1 the children of k.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import LEAF, WINDOW, in_cross, in_slice, slice_size, slice_start
from ..model import Graph
from ..storage import stored
from .ranks import running_sums

STATE = "struct<node: bigint, pos: bigint, size: bigint, off: bigint, level: int, own: bigint, kind: string>"


def depth(n: int) -> int:
    """Levels below a list of n vertices that only the middle slice cuts."""
    levels = 0
    while n > LEAF:
        rest = n - max(1, n // 20)
        n, levels = (rest + 1) // 2, levels + 1
    return levels


def _step(s: Column) -> Column:
    """A vertex's state one level deeper; ``own`` is its place in its node's own list once it has arrived."""
    size, pos = s["size"], s["pos"]
    k, start = slice_size(size), slice_start(size)
    rest = size - k
    a = F.shiftright(rest + 1, 1)
    r = F.when(pos >= start + k, pos - k).otherwise(pos)
    left = r % 2 == 0
    null = F.lit(None).cast("long")

    def state(node: Column, pos: Column, size: Column, off: Column, level: Column, own: Column, kind: Column) -> Column:
        parts = {"node": node, "pos": pos, "size": size, "off": off, "level": level, "own": own, "kind": kind}
        return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(STATE)

    leaf = state(s["node"], pos, size, s["off"], s["level"], pos, F.lit("leaf"))
    sep = state(s["node"], pos, size, s["off"], s["level"], rest + pos - start, F.lit("spectral"))
    child = state(
        s["node"] * 2 + F.when(left, 0).otherwise(1), F.shiftright(r, 1), F.when(left, a).otherwise(rest - a),
        s["off"] + F.when(left, 0).otherwise(a), s["level"] + 1, null, F.lit(None).cast("string"),
    )
    return F.when(s["own"].isNotNull(), s).when(size <= LEAF, leaf).when(in_slice(pos, size), sep).otherwise(child)


def _fold(rows: DataFrame, steps: int) -> DataFrame:
    """(v, node, level, kind, n_in, off, own) for rows (v, node, pos, size, off, level)."""
    start = F.struct("node", "pos", "size", "off", "level", F.lit(None).cast("long").alias("own"), F.lit(None).cast("string").alias("kind")).cast(STATE)
    end = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), start, lambda s, _: _step(s))
    return rows.select("v", end.alias("s")).select("v", "s.node", "s.level", "s.kind", F.col("s.size").alias("n_in"), "s.off", "s.own")


def _geometric_levels(spark: SparkSession, n: int, g: int) -> tuple[list[DataFrame], DataFrame]:
    """(rows that have arrived, rows that go on) after all levels whose windows are wider than WINDOW."""
    rows = spark.range(n).select(
        F.col("id").alias("v"), F.lit(1).cast("long").alias("node"), F.col("id").alias("pos"), F.lit(n).cast("long").alias("size"), F.lit(0).cast("long").alias("off"),
        F.lit(0).alias("level"), F.lit(0).cast("long").alias("sx"),
    )
    arrived, width, level = [], g, 0
    while width > WINDOW and g > WINDOW:
        if n >> level <= LEAF and rows.filter(F.col("size") > LEAF).isEmpty():
            break
        small = rows.filter(F.col("size") <= LEAF)
        arrived.append(small.select("v", "node", "level", F.lit("leaf").alias("kind"), F.col("size").alias("n_in"), "off", F.col("pos").alias("own")))
        cross = in_cross(F.col("v"), g, F.col("sx"), F.lit(width).cast("long"), F.lit(g).cast("long")).cast("long")
        wide = running_sums(rows.filter(F.col("size") > LEAF).withColumn("cross", cross), ["node"], "pos", {"before": F.col("cross")})
        found = wide.groupBy("node").agg(F.sum("cross").alias("n_cross"))
        wide = wide.join(found, "node")
        none = F.col("n_cross") == 0
        is_sep = F.when(none, in_slice(F.col("pos"), F.col("size"))).otherwise(F.col("cross") == 1)
        k = F.when(none, slice_size(F.col("size"))).otherwise(F.col("n_cross"))
        sep_pos = F.when(none, F.col("pos") - slice_start(F.col("size"))).otherwise(F.col("before"))
        passed = F.when(none, F.when(F.col("pos") >= slice_start(F.col("size")), slice_size(F.col("size"))).otherwise(0)).otherwise(F.col("before"))
        cut = stored(wide.select("*", is_sep.alias("is_sep"), (F.col("size") - k).alias("rest"), sep_pos.alias("sep_pos"), (F.col("pos") - passed).alias("r"), none.alias("none")), "level")
        kind = F.when(F.col("none"), "geo_fallback").otherwise("geometric")
        arrived.append(cut.filter("is_sep").select("v", "node", "level", kind.alias("kind"), F.col("size").alias("n_in"), "off", (F.col("rest") + F.col("sep_pos")).alias("own")))
        left, a = F.col("r") % 2 == 0, F.shiftright(F.col("rest") + 1, 1)
        width //= 2
        rows = cut.filter("NOT is_sep").select(
            "v", (F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node"), F.shiftright("r", 1).alias("pos"), F.when(left, a).otherwise(F.col("rest") - a).alias("size"),
            (F.col("off") + F.when(left, 0).otherwise(a)).alias("off"), (F.col("level") + 1).alias("level"), (F.col("sx") + F.when(left, 0).otherwise(width)).alias("sx"),
        )
        level += 1
    return arrived, rows


def assignment(spark: SparkSession, n: int, grid: int = 0) -> DataFrame:
    """(v, node, level, kind, n_in, off, own): the node that owns each vertex, that node's list size and offset in the
    order, and the vertex's place from that offset. Every vertex once.
    """
    columns = ["v", "node", "level", "kind", "n_in", "off", "own"]
    if grid:
        arrived, rows = _geometric_levels(spark, n, grid)
    else:
        arrived, rows = [], spark.range(n).select(F.col("id").alias("v"), F.lit(1).cast("long").alias("node"), F.col("id").alias("pos"), F.lit(n).cast("long").alias("size"), F.lit(0).cast("long").alias("off"), F.lit(0).alias("level"))
    folded = _fold(rows, depth(n))
    return reduce(DataFrame.unionByName, [folded, *arrived]).select(*columns)


def order(spark: SparkSession, n: int, grid: int = 0) -> DataFrame:
    """(new_idx, v): vertex v is eliminated as number new_idx."""
    return assignment(spark, n, grid).select((F.col("off") + F.col("own")).alias("new_idx"), "v")


def order_graph(graph: Graph) -> DataFrame:
    return order(graph.vertices.sparkSession, graph.n, graph.grid_size)


def inverse(perm: DataFrame) -> DataFrame:
    """(v, new_idx) of a permutation, the same rows read the other way."""
    return perm.select("v", "new_idx")


def tree(assign: DataFrame) -> DataFrame:
    """(node_id, level, kind, n_in, sep_size, a_size, b_size, offset); a leaf's own vertices count as its separator."""
    own = assign.groupBy("node").agg(F.first("level").alias("level"), F.first("kind").alias("kind"), F.first("n_in").alias("n_in"), F.first("off").alias("offset"), F.count(F.lit(1)).alias("sep_size"))
    rest = F.col("n_in") - F.col("sep_size")
    a = F.shiftright(rest + 1, 1)
    return own.select(F.col("node").alias("node_id"), "level", "kind", "n_in", "sep_size", a.alias("a_size"), (rest - a).alias("b_size"), "offset")


def tree_lines(nodes: DataFrame) -> DataFrame:
    """(line) in pre-order, two blanks for a level. A node comes before its children, left before right."""
    path = F.rpad(F.substring(F.bin("node_id"), F.lit(2), F.lit(64)), 64, " ")
    text = F.concat(F.repeat(F.lit("  "), "level"), F.lit("level "), "level", F.lit(": separator "), "sep_size", F.lit(", A "), "a_size", F.lit(", B "), "b_size")
    return nodes.orderBy(path).select(text.alias("line"))
