import pytest

from graphloom.cli import main, parser, run
from graphloom.operators import stats
from graphloom.sources import metis
from graphloom.sources.metis import GraphFormatError

F1 = "% sample\n4 4\n2 3\n1 3\n1 2 4\n3\n"
F2 = "3 2 {} 2\n1 5 2 1.5\n2 6 1 1.5 3 2.5\n3 7 2 2.5\n"
F3 = "3 2 {}\n10 2\n20 1 3\n30 2\n"
F4 = "3 2 {}\n10 1 2 1.5\n20 2 1 1.5 3 2.5\n30 3 2 2.5\n"


def read(spark, tmp_path, text):
    path = tmp_path / "g.graph"
    path.write_bytes(text.encode())
    return metis.read_graph(spark, str(path))


def entries(graph):
    return sorted(map(tuple, graph.edges.select("src", "pos", "dst", "w").collect()))


PLAIN = [(0, 0, 1, 1.0), (0, 1, 2, 1.0), (1, 0, 0, 1.0), (1, 1, 2, 1.0), (2, 0, 0, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 1.0), (3, 0, 2, 1.0)]
WEIGHTED = [(0, 0, 1, 1.5), (1, 0, 0, 1.5), (1, 1, 2, 2.5), (2, 0, 1, 2.5)]


def test_plain(spark, tmp_path):
    for text in (F1, F1.replace("\n", "\r\n"), F1.replace("1 3\n", "1 3\n% between\n\n")):
        graph = read(spark, tmp_path, text)
        assert (graph.n, graph.meta.m) == (4, 4) and entries(graph) == PLAIN
    got = stats.classified(stats.degree_stats(stats.degrees(graph))).first()
    assert (got["nnz"], got["n_edges"], got["min_degree"], got["max_degree"], got["median_degree"], got["avg_degree"]) == (8, 4, 1, 3, 2, 2.0)
    assert not got["structured"] and got["share_2_to_4"] == 0.75 and round(got["fill_reduction"], 4) == 3.0103
    offsets = sorted(stats.row_offsets(graph).collect())
    assert [r["row_ptr"] for r in offsets] == [0, 2, 4, 7, 8] and [r["legacy_row_ptr"] for r in offsets] == [0, 0, 2, 4, 7]
    assert [stats.entry_check(4, m, graph.edges).first()["edge_count_warning"] for m in (4, 5)] == [False, True]


@pytest.mark.parametrize("fmt", ["011", "11", "3"])
def test_edge_and_vertex_weights(spark, tmp_path, fmt):
    graph = read(spark, tmp_path, F2.format(fmt))
    assert [r["weights"] for r in sorted(graph.vertices.collect())] == [[1, 5], [2, 6], [3, 7]] and entries(graph) == WEIGHTED


@pytest.mark.parametrize("fmt", ["100", "4"])
def test_sizes(spark, tmp_path, fmt):
    graph = read(spark, tmp_path, F3.format(fmt))
    assert [r["size"] for r in sorted(graph.vertices.collect())] == [10, 20, 30]
    assert entries(graph) == [(s, p, d, 1.0) for s, p, d, _ in WEIGHTED]


@pytest.mark.parametrize("fmt", ["111", "7"])
def test_everything_and_back(spark, tmp_path, fmt):
    graph = read(spark, tmp_path, F4.format(fmt))
    assert entries(graph) == WEIGHTED and [r["weights"] for r in sorted(graph.vertices.collect())] == [[1], [2], [3]]
    metis.write_graph(graph, str(tmp_path / "out"))
    again = metis.read_graph(spark, str(tmp_path / "out"))
    assert entries(again) == WEIGHTED and sorted(again.vertices.collect()) == sorted(graph.vertices.collect())


def test_isolated_vertices(spark, tmp_path):
    for line in ("\r\n", " \n"):
        graph = read(spark, tmp_path, "3 1\n2\n1\n" + line)
        assert [r["degree"] for r in sorted(stats.degrees(graph).collect())] == [1, 1, 0]


def test_accepted(spark, tmp_path):
    assert len(entries(read(spark, tmp_path, "2 1\n1 2 2\n \n"))) == 3  # a loop, a repeated neighbour, no way back
    assert read(spark, tmp_path, "2 1 10\n-5 2\n1 1\n").vertices.filter("weights[0] = -5").count() == 1


def test_errors_name_the_vertex_as_the_file_counts(spark, tmp_path):
    with pytest.raises(GraphFormatError, match="^Missing edge weight for vertex 3$"):
        read(spark, tmp_path, "3 2 1\n2 1\n1 1 3 1\n2\n")


@pytest.mark.parametrize(
    "text,message",
    [
        ("5\n", "Invalid header line format"), ("5 4 0 1 9\n", "Invalid header line format"), (" % text\n1\n", "Invalid header line format"),
        ("2 1\n2\n1\n1\n", "Too many vertex lines in file"), ("3 1\n2\n1\n", "Number of vertex lines doesn't match header"), ("3 1\n2\n1\n\n", "Number of vertex lines doesn't match header"),
        ("1 0 100\n \n", "Missing vertex size on line for vertex 1"), ("1 0 10 2\n1\n", "Missing vertex weight on line for vertex 1"),
        ("2 1\n0\n1\n", "Invalid neighbor vertex index: 0"), ("2 1\n3\n1\n", "Invalid neighbor vertex index: 3"), ("2 1\n2x\n1\n", "Invalid neighbor vertex index: 2x"),
        ("2 1 1\n2\n1 1\n", "Missing edge weight for vertex 1"), ("2 1 1\n2 0\n1 1\n", "Edge weight must be positive"), ("2 1 1\n2 -1\n1 1\n", "Edge weight must be positive"),
        ("0 0\n", "Invalid graph dimensions"), ("", "Invalid graph dimensions"), ("2 -1\n1\n1\n", "Invalid graph dimensions"),
    ],
)
def test_rejected(spark, tmp_path, text, message):
    with pytest.raises(GraphFormatError, match=f"^{message}"):
        read(spark, tmp_path, text)


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Cannot open file"):
        metis.read_graph(spark, str(tmp_path / "none"))


def test_lines_in_pieces(spark, tmp_path):
    """A file that is read in many pieces keeps its order."""
    n = 3000
    text = f"{n} {n - 1}\n" + "".join(" ".join(str(x) for x in (i - 1, i + 1) if 1 <= x <= n) + "\n" for i in range(1, n + 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        graph = read(spark, tmp_path, text)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["src"], r["dst"]) for r in graph.edges.collect()) == sorted([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)])


def test_cli(spark, tmp_path, capsys):
    path = tmp_path / "g.graph"
    path.write_text(F1)
    assert run(spark, parser().parse_args(["-metis", str(path), "-analysis", "-tree", "-o", str(tmp_path / "perm")])) == 0
    out = capsys.readouterr().out
    assert "vertices: 4" in out and "general graph" in out and "level 0: separator 4" in out
    assert [r["v"] for r in sorted(spark.read.parquet(str(tmp_path / "perm")).collect())] == [0, 1, 2, 3]
    assert run(spark, parser().parse_args(["-test"])) == 0
    out = capsys.readouterr().out
    assert "edges: 6150" in out and "77.4246" in out
    assert main([]) == 1 and main(["-grid", "0"]) == 1
