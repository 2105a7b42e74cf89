"""Separators of a vertex list. Lists are (v, pos), pos dense from 0; separators are (v, sep_pos)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LEAF, MULTILEVEL, in_cross, in_slice
from ..model import Graph
from .ranks import ranked, running_sums


def listed(vertices: DataFrame) -> DataFrame:
    """The whole vertex set as a list, in order."""
    return vertices.select("v", F.col("v").alias("pos"))


def _slice(size: int, share: int) -> tuple[int, int]:
    """(start, length) of the middle share % of a list."""
    k = max(1, size * share // 100)
    return size // 2 - k // 2, k


def _cut(rows: DataFrame, at: Column, size: int, share: int) -> DataFrame:
    start, k = _slice(size, share)
    return rows.filter((at >= start) & (at < start + k)).select("v", (at - start).cast("long").alias("sep_pos"))


def median_slice(members: DataFrame, size: int) -> DataFrame:
    """The middle twentieth of the list, at least one vertex."""
    return _cut(members, F.col("pos"), size, 5)


def spectral(members: DataFrame, size: int) -> DataFrame:
    """The middle vertex of a small list, else the middle twentieth.

    The iteration that should move vertices along a spectral vector leaves it constant, and
    a stable order by a constant is the list itself, so nothing is iterated.
    """
    if size <= LEAF:
        return members.filter(F.col("pos") == size // 2).select("v", F.lit(0).cast("long").alias("sep_pos"))
    return median_slice(members, size)


def geometric(members: DataFrame, size: int, grid: int, start_x: int = 0, width: int = 0, height: int = 0) -> DataFrame:
    """The list's vertices on the cross of a grid window, in list order; the middle twentieth if there is
    none and the list is no leaf. Without a grid, the spectral separator.
    """
    if not grid:
        return spectral(members, size)
    cross = in_cross(F.col("v"), grid, F.lit(start_x).cast("long"), F.lit(width).cast("long"), F.lit(height).cast("long"))
    marked = members.filter(cross)
    if marked.isEmpty():
        return median_slice(members, size) if size > LEAF else members.limit(0).select("v", F.col("pos").alias("sep_pos"))
    flagged = running_sums(members.withColumn("_in", cross.cast("long")), [], "pos", {"sep_pos": F.col("_in")})
    return flagged.filter("_in = 1").select("v", "sep_pos")


#: The refined spectral separator is the spectral one.
improved_spectral = spectral


def by_value(members: DataFrame, size: int, value: str) -> DataFrame:
    """The middle twentieth in order of (value, place), in that order. members need the value's column."""
    return _cut(ranked(members, value, "pos"), F.col("rank"), size, 5)


def general_geometric(members: DataFrame, size: int) -> DataFrame:
    """The middle 3 % in order of (v mod root of the size, place); the middle vertex of a small list."""
    if size <= LEAF:
        return spectral(members, size)
    return _cut(ranked(members.withColumn("x", F.pmod("v", F.lit(math.isqrt(size)))), "x", "pos"), F.col("rank"), size, 3)


def multilevel(members: DataFrame, size: int, edges: DataFrame) -> DataFrame:
    """The spectral separator of every second vertex, then its neighbours in the list, in order of first sight."""
    if size <= MULTILEVEL:
        return spectral(members, size)
    coarse = spectral(members.filter(F.col("pos") % 2 == 0).select("v", F.shiftright("pos", 1).alias("pos")), (size + 1) // 2)
    n_coarse = _slice((size + 1) // 2, 5)[1]
    seen = edges.join(coarse, F.col("src") == F.col("v")).select(F.col("dst").alias("v"), F.struct("sep_pos", "pos").alias("sight"))
    new = seen.groupBy("v").agg(F.min("sight").alias("sight")).join(members.select("v"), "v", "left_semi").join(coarse, "v", "left_anti")
    return coarse.unionByName(ranked(new, "sight").select("v", (F.col("rank") + n_coarse).alias("sep_pos")))


def alternating_split(members: DataFrame, sep: DataFrame) -> DataFrame:
    """(v, side, side_pos): what the separator leaves, dealt to A, B, A, B, ... in list order."""
    flag = sep.select("v", F.lit(1).alias("_sep"))
    rows = members.join(flag, "v", "left").withColumn("_keep", F.when(F.col("_sep").isNull(), 1).otherwise(0))
    rows = running_sums(rows, [], "pos", {"r": F.col("_keep")}).filter("_keep = 1")
    side = F.when(F.col("r") % 2 == 0, "A").otherwise("B")
    return rows.select("v", side.alias("side"), F.shiftright("r", 1).alias("side_pos"))


def root_list(graph: Graph) -> tuple[DataFrame, int]:
    return listed(graph.vertices), graph.n


__all__ = ["alternating_split", "by_value", "general_geometric", "geometric", "improved_spectral", "in_slice", "listed", "median_slice", "multilevel", "root_list", "spectral"]
