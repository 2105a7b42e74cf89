import random
import re

import numpy as np
import pytest

from graphloom.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_groups(rows, width, percent):
    """{id: (n, component)} by comparing all pairs."""
    sets = {i: plain_set(t, width) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def result(df, width, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(df, width, percent).collect()}


def random_set(rng, n, frequent, share):
    k = rng.binomial(n, share)
    return np.unique(np.concatenate([rng.integers(0, 2**63, n - k).astype(np.uint64), rng.choice(frequent, min(k, len(frequent)), replace=False)]))


@pytest.mark.parametrize("percent,share", [(80, 0), (85, 0), (80, 0.5), (85, 0.5), (85, 0.9)])
def test_similar_sets_share_a_key(percent, share):
    rng = np.random.default_rng(percent)
    frequent = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    links = 0
    for trial in range(2500):
        x = random_set(rng, int(rng.integers(1, 40 if trial % 2 else 700)), frequent, share)
        n = len(x)
        k = int(rng.integers(0, max(1, n // 4) + 1))
        y = np.delete(x, rng.choice(n, min(n, int(rng.integers(0, k + 1))), replace=False))
        y = np.unique(np.concatenate([y, random_set(rng, int(rng.integers(0, k + 1)), frequent, share)]))
        common = len(np.intersect1d(x, y))
        if len(y) and 100 * common >= percent * (len(x) + len(y) - common):
            a, b = jaccard.parity(x), jaccard.parity(y)
            words = min(len(a), len(b))
            assert np.bitwise_count(jaccard.folded(a, words) ^ jaccard.folded(b, words)).sum() <= jaccard.max_difference(n + len(y), percent)
            if not np.array_equal(x, y):
                links += 1
                assert len(np.intersect1d(jaccard.keys(x, percent, frequent), jaccard.keys(y, percent, frequent)))
    assert links > 300


@pytest.mark.parametrize("percent", [80, 85])
def test_every_pair_that_sizes_allow_is_inside_a_band(percent):
    bands = jaccard.bands(percent, 1 << 12)
    for a in range(1, 2000):
        for b in {a, a + 1, a * 100 // percent}:
            if a * 100 >= b * percent and jaccard.max_difference(a + b, percent) >= max(1, b - a) and (a != b or jaccard.max_difference(2 * a, percent) >= 2 or a + b):
                if jaccard.max_difference(a + b, percent) >= 1:
                    assert any(low <= a and b <= high for low, high, _ in bands), (a, b)


def test_documents_short_of_units_buy_neighbourhoods():
    rng = np.random.default_rng(5)
    frequent = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    more = []
    for share in (0, 0.6):
        count = 0
        for _ in range(300):
            x = random_set(rng, int(rng.integers(60, 300)), frequent, share)
            segments = sum(m for low, high, m in jaccard.bands(85, 512) if low <= len(x) <= high)
            count += len(jaccard.keys(x, 85, frequent)) > segments
        more.append(count)
    assert more[0] == 0 and more[1] > 100


def test_summary_finds_frequent_hashes():
    rng = np.random.default_rng(6)
    common = np.unique(rng.integers(0, 2**63, 20).astype(np.uint64))
    summary = jaccard.Summary(60)
    for _ in range(300):
        summary.add(np.unique(np.concatenate([rng.integers(0, 2**63, 3000).astype(np.uint64), common])))
    summary.settle()
    assert len(summary.hashes) <= 60 and set(common.tolist()) <= set(summary.hashes.tolist()) and summary.counts.max() <= 300


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("the and of to in a is".split()) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    shared = text(60)
    rows = []
    for _ in range(60):
        base = text(rng.choice([1, 3, 4, 5, 9, 15, 40, 120, 400]))
        if rng.random() < 0.4:
            base += shared
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    base = text(150)
    for _ in range(40):  # a group of near copies, each changed in its own place, so that links form chains
        base = list(base)
        base[rng.randrange(len(base))] = word()
        rows.append(base)
    rows = [" ".join(r) for r in rows] + [rows[0][0].upper(), "", None, " \t\n ", "One TWO\tthree\x0bfour five", "one two three four five", "ÄÖ x", "äö x", "x y z", "x y z"]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("width,percent,least,block", [(4, 85, 100, 1024), (5, 80, 100, 16), (4, 85, 4, 8)])
def test_against_all_pairs(spark, width, percent, least, block, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST", least)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(width)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, n int").repartition(3)
    expected = plain_groups(rows, width, percent)
    assert result(df, width, percent) == expected
    assert len({c for _, c in expected.values()}) < len(rows)


def test_small_cases(spark):
    schema = "doc_id long, text string"
    assert result(spark.createDataFrame([], schema), 4, 85) == {}
    assert result(spark.createDataFrame([(1, None), (2, "")], schema), 4, 85) == {1: (0, 1), 2: (0, 2)}
    got = jaccard.near_groups(spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (5, "A b  c d\ne"), (7, "a b c d e")], schema), 4, 85).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got if r["doc_id"]) == [(5, 2, 5), (7, 2, 5), (7, 2, 5)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    long = " ".join(str(i) for i in range(60_000))
    assert result(spark.createDataFrame([(2, long), (1, long + " end"), (3, long[: len(long) // 2])], schema), 4, 85) == {1: (59_998, 1), 2: (59_997, 1), 3: (jaccard.shingles(long[: len(long) // 2].encode(), 4).size, 3)}


def test_an_id_with_several_sets(spark):
    """One text of id 7 equals that of 5, the other is near that of 9: all three are one component."""
    first, second = (" ".join(f"{w}{i}" for i in range(80)) for w in ("a", "b"))
    rows = [(5, first), (7, first), (7, second), (9, second + " end"), (3, "alone with a few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.near_groups(df, 4, 85).collect()} == {(5, 5), (7, 5), (9, 5), (3, 3)}


def test_groups_of_keys_collapse(spark):
    """Keys with the same ids are one group, whatever their number; others stay apart."""
    rows = [(k, i) for k in range(50) for i in (1, 2, 3)] + [(100, 1), (100, 2), (101, 4), (102, 2), (102, 1), (103, 2), (103, 3)]
    got = jaccard.shared_groups(spark.createDataFrame(rows, "key long, id long").repartition(4)).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["g1"], r["g2"]), []).append(r["id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2], [1, 2, 3], [2, 3]]


def test_narrowed_keeps_all(spark):
    from graphloom.llm.common import maybe_in, narrowed

    df = spark.range(-2000, 2000).selectExpr("id as doc", "'x' as id")
    ids = spark.range(-2000, 2000, 7)
    kept = {r["doc"] for r in narrowed(df, "doc", ids).collect()}
    assert set(range(-2000, 2000, 7)) <= kept and len(kept) < 700
    assert maybe_in(df, "doc", ids.limit(0)).filter("_maybe").count() == 0
