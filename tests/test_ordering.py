import hashlib

import pytest

from graphloom.operators import ordering

from .simulation import simulate

GOLDEN = [
    (128, 0, "e374288e6fd77688"), (129, 0, "ad9dff370d55bb11"), (210, 0, "0be652fe63d10e47"), (1000, 0, "73abd62cb1fb77ea"), (1650, 0, "a0ae01ce62278123"),
    (2100, 0, "4d174389e167fb86"), (10000, 0, "e9b67850049670f3"), (16500, 0, "8f03870524b8ff49"), (21000, 0, "906a5728670b49a7"), (100000, 0, "68881f3ff8ab6603"),
    (400, 20, "e769d75d5361b580"), (400, 40, "42549925674b531a"), (1000, 40, "b1828190ab08c152"), (2500, 50, "3496f7a177313079"), (4096, 64, "bab4b0346dc28aab"),
    (10000, 100, "3ba5fb0ba1139673"), (100000, 316, "697ed3762824fc52"), (250000, 500, "7a754357d5de65ec"),
]


@pytest.mark.parametrize("n,g,digest", GOLDEN)
def test_order(spark, n, g, digest):
    rows = sorted(ordering.order(spark, n, g).collect())
    assert [r["new_idx"] for r in rows] == list(range(n))
    perm = [r["v"] for r in rows]
    assert perm == simulate(n, g)[0]
    assert hashlib.sha256(",".join(map(str, perm)).encode()).hexdigest()[:16] == digest


@pytest.mark.parametrize("n,g", [(1, 0), (129, 0), (1650, 0), (1000, 40), (2500, 50)])
def test_tree(spark, n, g):
    nodes = ordering.tree(ordering.assignment(spark, n, g))
    got = {r["node_id"]: (r["level"], r["kind"], r["n_in"], r["sep_size"], r["a_size"], r["b_size"]) for r in nodes.collect()}
    assert got == simulate(n, g)[1]
    lines = [r["line"] for r in ordering.tree_lines(nodes).collect()]
    assert len(lines) == len(got) and lines[0].startswith("level 0")
    if n > 1000:
        assert [x.strip().split(":")[0] for x in lines[:3]] == ["level 0", "level 1", "level 2"]
