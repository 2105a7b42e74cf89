import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.model import Graph, GraphFormatError
from graphloom.operators import quality, ranks, separators, stats
from graphloom.sources import grid, tables


def path_graph(spark, n, closed=False):
    pairs = spark.range(n if closed else n - 1).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"))
    return Graph.from_edges(spark, n, tables.both_ways(pairs))


def row(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize("n,closed,true,legacy", [(10, False, False, False), (11, False, True, True), (5, True, True, False)])
def test_classification(spark, n, closed, true, legacy):
    graph = path_graph(spark, n, closed)
    assert (stats.detect(graph).grid_size > 0) == true and (stats.detect(graph, legacy=True).grid_size > 0) == legacy


@pytest.mark.parametrize("g,nnz,half", [(1, 1, 0), (2, 12, 6), (10, 460, 230), (50, 12300, 6150)])
def test_grid(spark, g, nnz, half):
    got = stats.degree_stats(stats.degrees(grid.grid(spark, g))).first()
    assert (got["nnz"], got["n_edges"]) == (nnz, half)
    assert grid.grid(spark, g, include_diagonal=False).edges.count() == 4 * g * (g - 1)
    if g == 2:
        assert [tuple(r) for r in grid.grid_edges(spark, 2).filter("src = 0").orderBy("pos").collect()] == [(0, 0, 0, 4.0), (0, 2, 1, -1.0), (0, 1, 2, -1.0)]


@pytest.mark.parametrize("n,dims", [(100, (1, 100)), (144, (2, 72)), (200, (4, 50)), (400, (10, 40)), (2500, (50, 50)), (10007, (100, 100)), (100000, (316, 316))])
def test_grid_dimensions(spark, n, dims):
    assert tuple(row(spark, d=scalars.grid_dimensions(F.lit(n).cast("long")))["d"]) == dims
    assert scalars.grid_side(n) == max(dims)


@pytest.mark.parametrize("n,percent", [(1, 100), (4, 0), (9, -5.6642), (16, 0), (100, 33.5614), (2500, 77.4246), (250000, 96.4137)])
def test_fill(spark, n, percent):
    assert round(row(spark, x=scalars.fill_reduction(F.lit(n), F.lit(0), F.lit(True)))["x"], 4) == percent
    assert row(spark, x=scalars.fill_reduction(F.lit(n), F.lit(0), F.lit(False)))["x"] == -math.inf
    assert row(spark, x=scalars.fill_reduction(F.lit(n), F.lit(n * 10**7), F.lit(False)))["x"] == 50


def test_slices(spark):
    sizes = spark.range(1, 5000).select("id", scalars.slice_size(F.col("id")).alias("k"), scalars.slice_start(F.col("id")).alias("s")).collect()
    assert all((r["k"], r["s"]) == (max(1, int(r["id"] * 0.05)), r["id"] // 2 - max(1, int(r["id"] * 0.05)) // 2) for r in sizes)


def in_order(sep):
    return [r["v"] for r in sorted(sep.collect(), key=lambda r: r["sep_pos"])]


def test_separators(spark):
    members = separators.listed(spark.range(1000).toDF("v"))
    x_order = sorted(range(1000), key=lambda v: (v % 31, v))
    assert in_order(separators.general_geometric(members, 1000)) == x_order[485:515]
    small = separators.listed(spark.range(129).toDF("v"))
    assert in_order(separators.general_geometric(small, 129)) == [38, 49, 60]
    assert in_order(separators.spectral(members, 1000)) == list(range(475, 525))
    assert in_order(separators.spectral(separators.listed(spark.range(128).toDF("v")), 128)) == [64]
    assert in_order(separators.by_value(members.withColumn("x", -F.col("v") % 3), 1000, "x")) == sorted(range(1000), key=lambda v: (-(v % 3), v))[475:525]
    graph = path_graph(spark, 300)
    assert in_order(separators.multilevel(separators.listed(graph.vertices), 300, graph.edges)) == [144, 146, 148, 150, 152, 154, 156, 143, 145, 147, 149, 151, 153, 155, 157]
    assert in_order(separators.multilevel(separators.listed(path_graph(spark, 256).vertices), 256, graph.edges)) == list(range(122, 134))
    nine = separators.listed(spark.range(400).toDF("v"))
    cross = [v for v in range(400) if v % 20 == 10 or v // 20 == 10]
    assert in_order(separators.geometric(nine, 400, 20, 0, 20, 20)) == cross
    assert in_order(separators.geometric(nine, 400, 20)) == list(range(190, 210))  # no window: the slice
    assert in_order(separators.geometric(separators.listed(spark.range(9).toDF("v")), 9, 3)) == []
    sides = separators.alternating_split(nine, separators.spectral(nine, 400)).collect()
    rest = [v for v in range(400) if not 190 <= v < 210]
    assert sorted((r["side"], r["side_pos"], r["v"]) for r in sides) == sorted([("A", i, v) for i, v in enumerate(rest[0::2])] + [("B", i, v) for i, v in enumerate(rest[1::2])])


@pytest.mark.parametrize("s,a,b,q", [(99, 1201, 1200, 0.96), (50, 475, 475, 0.95), (1, 3, 1, 0.4), (1, 0, 0, math.nan)])
def test_quality(spark, s, a, b, q):
    got = row(spark, q=scalars.separator_quality(F.lit(s), F.lit(a), F.lit(b)))["q"]
    assert math.isnan(got) if math.isnan(q) else round(got, 4) == q


def test_refine(spark):
    def case(sep, a, b, edges):
        sep = spark.createDataFrame([(v, i) for i, v in enumerate(sep)], "v long, sep_pos long")
        sides = spark.createDataFrame([(v, "A") for v in a] + [(v, "B") for v in b], "v long, side string")
        return in_order(quality.refine(sep, sides, spark.createDataFrame(edges, "src long, dst long")))

    assert case([0], [1, 2, 3], [4], [(0, v) for v in (1, 2, 3, 4)]) == [0]
    assert case([0], [1, 2, 3], [], [(0, v) for v in (1, 2, 3)]) == []
    assert case([0], [1], [], [(0, 1)] * 3) == []  # parallel entries count
    assert case(range(6), [11, 12, 13], [], [(s, v) for s in range(6) for v in (11, 12, 13)]) == [5]


def test_ranks(spark):
    rows = ranks.ranked(spark.range(1000), F.desc(F.col("id") % 7), "id").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted(range(1000), key=lambda v: (-(v % 7), v))
    sums = ranks.running_sums(spark.range(10000).withColumn("k", F.col("id") % 2), ["k"], "id", {"before": F.col("id")}).collect()
    assert all(r["before"] == sum(range(r["id"] % 2, r["id"], 2)) for r in sums)


def test_csr_and_matvec(spark):
    graph = grid.grid(spark, 4)
    offsets = stats.row_offsets(graph).select("v", "row_ptr")
    entries = graph.edges.join(offsets, F.col("src") == F.col("v")).select((F.col("row_ptr") + F.col("pos")).alias("at"), "dst", "w")
    assert sorted(grid.edges_from_csr(offsets, entries).collect()) == sorted(graph.edges.collect())
    y = {r["v"]: r["y"] for r in stats.matvec(graph.edges, graph.vertices.select("v", F.lit(1.0).alias("x"))).collect()}
    assert y[0] == 2 and y[5] == 0
    diagonal = {r["src"]: r["w"] for r in stats.laplacian(graph).filter("src = dst").collect()}
    assert diagonal[0] == 3 and diagonal[5] == 5


def test_numbers_beyond_doubles(spark):
    side = 2**31
    v = 2**61 + 3 * 2**31 + 7
    got = row(spark, x=scalars.in_cross(F.lit(v), side, F.lit(0).cast("long"), F.lit(14).cast("long"), F.lit(2**62).cast("long")), y=scalars.in_cross(F.lit(v + 1), side, F.lit(0).cast("long"), F.lit(14).cast("long"), F.lit(2**62).cast("long")))
    assert got["x"] and not got["y"]
    n = (2**31 - 1) ** 2
    assert tuple(row(spark, d=scalars.grid_dimensions(F.lit(n)))["d"]) == (2**31 - 1, 2**31 - 1) and scalars.grid_side(n) == 2**31 - 1


def test_hubs_are_numbered_in_spans(spark, monkeypatch):
    pairs = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(5, 200), (5, 17)], "a long, b long").repartition(5)
    expected = sorted(tuple(r) for r in tables.both_ways(pairs).collect())
    monkeypatch.setattr(tables, "SPAN", 16)
    assert sorted(tuple(r) for r in tables.both_ways(pairs).collect()) == expected
    assert [p for s, _, p in sorted(expected) if s == 0] == list(range(299))


def csr(spark, offsets, entries):
    return spark.createDataFrame(offsets, "v long, row_ptr long"), spark.createDataFrame([(a, d, 1.0) for a, d in entries], "at long, dst long, w double")


def test_csr_arrays(spark, monkeypatch):
    monkeypatch.setattr(grid, "CHUNK", 2)
    good = csr(spark, [(0, 0), (1, 3), (2, 3), (3, 4)], [(0, 1), (1, 2), (2, 0), (3, 0)])
    assert sorted((r["src"], r["pos"], r["dst"]) for r in grid.edges_from_csr(*good, 3).collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 0), (2, 0, 0)]


@pytest.mark.parametrize(
    "offsets,entries,message",
    [
        ([(0, 0), (1, 1)], [(0, 0)], "Invalid row_ptr size"), ([(0, 0), (1, 1), (3, 1)], [(0, 0)], "Invalid row_ptr size"), ([(0, 0), (1, 1), (2, 2)], [(0, 0)], "Invalid row_ptr size"),
        ([(0, 1), (1, 1), (2, 1)], [(0, 0)], "Invalid row_ptr size"), ([(0, 0), (1, 2), (2, 1)], [(0, 0), (1, 1)], "Invalid CSR structure - non-monotonic row_ptr"),
        ([(0, 0), (1, 1), (2, 2)], [(0, 0), (1, 2)], "Invalid adjacency index: 2"), ([(0, 0), (1, 1), (2, 2)], [(0, -1), (1, 1)], "Invalid adjacency index: -1"),
        ([(0, 0), (1, 1), (2, 2)], [(0, 0), (5, 1)], "Invalid row_ptr size"),
    ],
)
def test_broken_csr_arrays(spark, offsets, entries, message):
    with pytest.raises(GraphFormatError, match=f"^{message}$"):
        grid.edges_from_csr(*csr(spark, offsets, entries), 2)


def test_longer_refinement(spark):
    """Twelve separator vertices that all clearly belong to A: five go, or ten."""
    sep = spark.range(12).select(F.col("id").alias("v"), F.col("id").alias("sep_pos"))
    sides = spark.createDataFrame([(100 + i, "A", i) for i in range(3)], "v long, side string, side_pos long")
    edges = spark.createDataFrame([(s, 100 + i, i, 1.0) for s in range(12) for i in range(3)], "src long, dst long, pos int, w double")
    assert sorted(r["v"] for r in quality.refine(sep, sides, edges).collect()) == list(range(5, 12))
    assert sorted(r["v"] for r in quality.kernighan_lin(sep, sides, edges).collect()) == [10, 11]
    assert separators.improved_spectral is separators.spectral


def test_storage(spark, tmp_path):
    from pathlib import Path

    from graphloom import storage

    df = storage.stored(spark.range(5), "five")
    path = df._stored_at
    assert df.count() == 5 and path.startswith(storage.shared_dir(spark)) and path in storage._paths[spark.sparkContext.applicationId]
    storage.discard(df)
    assert not Path(path.removeprefix("file://").removeprefix("file:")).exists() and path not in storage._paths[spark.sparkContext.applicationId]

    class Cluster:
        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster)
