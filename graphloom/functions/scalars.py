"""Scalar rules, as column expressions and for the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sets up to LEAF vertices are leaves, MULTILEVEL is the coarse separator's least size, windows up to WINDOW wide are not cut geometrically.
LEAF, MULTILEVEL, WINDOW = 128, 256, 8
#: A graph is structured if more than this share of its degrees is 2, 3 or 4.
STRUCTURED_SHARE = 0.8


def slice_size(size: Column) -> Column:
    """A twentieth of the size, at least 1. The quotient is exact: the fraction is dropped, not rounded."""
    return F.greatest(F.lit(1).cast("long"), (size - F.pmod(size, F.lit(20))) / 20).cast("long")


def slice_start(size: Column) -> Column:
    return F.shiftright(size, 1) - F.shiftright(slice_size(size), 1)


def in_slice(pos: Column, size: Column) -> Column:
    """Whether a position belongs to the middle slice of a list."""
    return (pos >= slice_start(size)) & (pos < slice_start(size) + slice_size(size))


def in_cross(v: Column, grid: int, start_x: Column, width: Column, height: Column) -> Column:
    """Whether a grid cell lies in its window, on the window's middle column or row."""
    x = F.pmod(v, F.lit(grid))
    y = F.call_function("div", v - x, F.lit(grid))
    inside = (x >= start_x) & (x < start_x + width) & (y >= 0) & (y < height)
    return inside & ((x - start_x == F.shiftright(width, 1)) | (y == F.shiftright(height, 1)))


def fill_reduction(n: Column, nnz: Column, structured: Column) -> Column:
    """Estimated fill reduction in percent; minus infinity for a general graph without entries."""
    n, nnz = n.cast("double"), nnz.cast("double")
    grid = (1 - n * F.log2(n) / F.pow(n, F.lit(1.5))) * 100
    general = F.least(F.lit(50.0), 10 * F.log10(nnz / n))
    return F.when(structured, grid).when(nnz > 0, general).otherwise(F.lit(float("-inf")))


def separator_quality(sep: Column, a: Column, b: Column) -> Column:
    """Balance of the sides times the share of vertices outside the separator; NaN if both sides are empty."""
    sides = (a + b).cast("double")
    balance = 1 - F.abs(a.cast("double") - b) / sides
    return F.when(sides == 0, F.lit(float("nan"))).otherwise(balance * (1 - sep / (sep + sides)))


def balance_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger side, our own definition; NaN if both are empty."""
    return F.when(F.greatest(a, b) == 0, F.lit(float("nan"))).otherwise(F.least(a, b) / F.greatest(a, b).cast("double"))


def grid_dimensions(n: Column) -> Column:
    """struct(width, height): the least width within 10 of the root that divides n, else the root twice."""
    near = F.floor(F.sqrt(n)).cast("long")  # of a double, so off by one at most
    root = F.when(near * near > n, near - 1).when((near + 1) * (near + 1) <= n, near + 1).otherwise(near)
    fits = F.array_min(F.filter(F.sequence(F.greatest(F.lit(1).cast("long"), root - 10), root + 10), lambda w: F.pmod(n, w) == 0))
    return F.struct(F.coalesce(fits, root).alias("width"), F.coalesce(F.call_function("div", n.cast("long"), fits), root).alias("height"))


def grid_side(n: int) -> int:
    """The greater of a graph's estimated grid dimensions."""
    root = math.isqrt(n)
    width = next((w for w in range(max(1, root - 10), root + 11) if n % w == 0), None)
    return max(width, n // width) if width else root
