import json
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, mixing, sharding, token_counts
from graphloom.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], DOCS)


def plain_targets(sizes, weights, share=1.5, cap=2):
    """{source: target} by sharing the excess again and again."""
    total = share * sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = total, set(sizes)
    while open_ and left > 1e-9:
        whole = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / whole
        left = sum(max(0, target[s] - cap * sizes[s]) for s in open_)
        over = {s for s in open_ if target[s] >= cap * sizes[s]}
        for s in over:
            target[s] = cap * sizes[s]
        open_ -= over
    return target


def corpus():
    rows, i = [], 0
    for source, n in (("b", 400), ("a", 90), ("ä", 30), (None, 60), ("Z", 1), ("empty", 5)):
        for k in range(n):
            text = None if k % 40 == 39 else "" if source == "empty" else " ".join(["w"] * (1 + k * 7 % 50))
            rows.append((i, text, source))
            i += 1
    return [*rows, rows[0], (None, "no id here", "a"), (None, "nor here", "a"), (i, "x " * 3000, "b")]


def test_mixture(spark):
    rows = corpus()
    plan, sources = mixing.mixture(docs(spark, rows), [3, 1, 2])
    got = plan.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    expected = plain_targets(sizes, [3, 1, 2])
    target = {r["source"]: r["target"] for r in sources.collect()}
    assert set(target) == set(expected) and all(abs(target[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in target)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, len((t or "").split())) for i, t, _ in rows)
    taken = Counter()
    for r in got:
        assert len(r["copies"]) <= 2 and len({c["pass"] for c in r["copies"]}) == len(r["copies"])
        taken[r["source"]] += len(r["copies"]) * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max((len((t or "").split()) for _, t, x in rows if x == s)), s
    again, _ = mixing.mixture(docs(spark, rows).repartition(7), [3, 1, 2])
    key = lambda r: (r["doc_id"] or -1, r["size"], str(r["copies"]))
    assert sorted(map(key, again.collect())) == sorted(map(key, got))


def test_shards_split_like_a_draw(spark):
    """Shards get equal numbers of blocks, all blocks once, and each source in about its share."""
    rows = [(i, "w " * 20, f"s{i % 3}") for i in range(9000)]
    plan, _ = mixing.mixture(docs(spark, rows), [1, 1, 1], shard_levels=2)
    mixed = mixing.mixed_rows(plan).collect()
    assert len({(r["doc_id"], r["pass"]) for r in mixed}) == len(mixed) == 13_500
    per = Counter(r["shard"] for r in mixed)
    assert set(per) == {0, 1, 2, 3} and max(per.values()) < 1.2 * min(per.values())
    by = Counter((r["shard"], r["source"]) for r in mixed)
    assert all(700 < n < 1600 for n in by.values()) and len(set(by.values())) > 2
    assert len({r["order"] for r in mixed}) == len(mixed)


def test_quotas_are_exact(spark):
    quotas = spark.createDataFrame([(1, 0, 5), (1, 1, 17), (1, 2, 1)], "node int, src long, quota long")
    leaves = mixing._split(quotas, 3).collect()
    total = Counter()
    per = Counter()
    for r in leaves:
        total[r["src"]] += r["quota"]
        per[r["shard"]] += r["quota"]
    assert total == {0: 5, 1: 17, 2: 1} and sorted(per.values()) == [2, 3, 3, 3, 3, 3, 3, 3]


def test_small_mixtures(spark, tmp_path):
    assert mixing.mixture(docs(spark, []), [3, 1, 2])[0].count() == 0
    plan, _ = mixing.mixture(docs(spark, [(1, None, None), (2, "", "a")]), [3, 1, 2])
    assert [r["copies"] for r in plan.collect()] == [[], []]
    df = docs(spark, [(i, f"{i} words here", "a") for i in range(50)])
    plan, _ = mixing.mixture(df, [1], carry=True)
    assert plan.select("row.*").columns == df.columns and plan.filter("row.text IS NULL").count() == 0
    mixing.write_shards(plan, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 75


def test_mixture_with_clashing_columns(spark):
    """Columns that are named like the operator's own come back whole; null and repeated ids don't fill a block."""
    names = ["size", "src", "block", "copies", "row", "pass", "shard", "order", "_id", "_mark", "_at", "units", "words", "target", "n_blocks", "_source"]
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} " + "w " * (i % 9), "s" if i % 2 else None) for i in range(400)]
    df = spark.createDataFrame([(i, t, s, *(f"{n}{k}" for n in names)) for k, (i, t, s) in enumerate(rows)], ", ".join(["doc_id long, text string, source string", *(f"{n} string" for n in names)]))
    plan, sources = mixing.mixture(df, [3, 1, 2], carry=True)
    got = plan.collect()
    assert sorted(map(str, (tuple(r["row"]) for r in got))) == sorted(map(str, map(tuple, df.collect())))
    about = {r["src"]: r for r in sources.collect()}
    for src, about_one in about.items():
        taken = sum(len(r["copies"]) * r["size"] for r in got if r["src"] == src)
        assert abs(taken - about_one["target"]) <= 12
    shards = mixing.in_shards(plan).select("shard", "row.*").collect()
    assert len(shards) == sum(len(r["copies"]) for r in got)


def test_shards_hold_their_documents_in_order(spark):
    """Written out, a shard's pieces one after the other are its documents in their hashed order."""
    df = docs(spark, [(i, "w " * 5, "a" if i % 3 else "b") for i in range(600)])
    plan, _ = mixing.mixture(df, [1, 1], carry=True)
    order = {(r["shard"], r["order"]): r["doc_id"] for r in mixing.mixed_rows(plan).collect()}
    got = [(r["shard"], r["row"]["doc_id"]) for r in mixing.in_shards(plan).collect()]
    assert got == [(s, order[s, o]) for s, o in sorted(order)] and len({s for s, _ in got}) == 16


def test_mixing_query_reruns_agree(spark):
    a, b = (sorted(map(tuple, mixing.op9_mixing(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert a == b and len(a) == 200


def test_sharding(spark):
    sf = "/root/testdata/sf0.01"
    got = sharding.op10_sharding(spark, sf).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in got:
        text = texts.pop(r["doc_id"])
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 16, zlib.crc32(text), "key")
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert not texts and set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 5 < sum(r["grown_shard"] == 40 for r in got) < 60


def test_weights_confine_movement(spark):
    """A weight that grows draws rows into its subtree only, and in proportion."""
    keys = spark.range(20_000).toDF("k")
    at = lambda **x: {r["k"]: r["shard"] for r in sharding.placed(keys, "k", sharding.Tree(12, 3, 2, **x)).collect()}
    before = at()
    after = at(weights=(1.0,) * 11 + (3.0,))
    assert all(abs(n - 20_000 / 12) < 250 for n in Counter(before.values()).values())
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved and all(b // 6 != 1 or b // 3 != 3 or a == 11 for b, a in moved)  # inside its rack only to it
    assert all(a // 6 == 1 for b, a in moved if b // 6 == 0)  # between regions only into its own
    assert all(a == 11 for _, a in moved)
    one = (2.0,) + (1.0,) * 11  # a shard in the midst of the tree
    assert all(a == 0 for k, a in at(weights=one).items() if before[k] != a) and all(before[k] == 0 for k, a in at(weights=(0.5, *one[1:])).items() if before[k] != a)
    assert abs(Counter(after.values())[11] - 20_000 * 3 / 14) < 400
    gone = at(weights=(1.0,) * 11 + (0.0,))
    assert 11 not in gone.values() and all(before[k] == 11 or gone[k] // 6 != 1 or before[k] // 6 == 1 for k in gone)


def test_sharding_small_cases(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None), (2, None)], "doc_id long, text string")
    got = sharding.shard_rows(df, "doc_id", sharding.Tree(40), ["text"]).collect()
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert len(got) == 5 and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert sharding.shard_rows(df.limit(0), "doc_id", sharding.Tree(40)).count() == 0
    clash = sharding.shard_rows(df.select("doc_id", "text", F.lit("mine").alias("slot"), F.lit(9).alias("_group"), F.lit(8).alias("_own"), F.lit(7).alias("draw")), "doc_id", sharding.Tree(40), ["text"])
    assert clash.columns == ["doc_id", "text", "slot_", "_group", "_own", "draw", "shard", "slot"]
    assert {(r["slot_"], r["_group"], r["_own"], r["draw"]) for r in clash.collect()} == {("mine", 9, 8, 7)}
    assert sorted(map(str, clash.select("doc_id", "text", "shard", "slot").collect())) == sorted(map(str, sharding.shard_rows(df, "doc_id", sharding.Tree(40), ["text"]).collect()))
    words = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "shard string")
    assert sorted(r["slot"] for r in sharding.shard_rows(words, "shard", sharding.Tree(1)).collect()) == [0, 1, 2, 3]


def test_growth_takes_rows_only_into_the_new_shard(spark):
    """For every number of shards: in a rack, as a new rack, as a new region."""
    keys = spark.range(6000).selectExpr("id * 20 as k")
    for n in range(39, 46):
        keys = sharding.placed(keys, "k", sharding.Tree(n), f"n{n}")
    got = keys.collect()
    for n in range(39, 45):
        moved = [(r[f"n{n}"], r[f"n{n + 1}"]) for r in got if r[f"n{n}"] != r[f"n{n + 1}"]]
        assert all(b == n for _, b in moved) and 90 < len(moved) < 210
    for n in (39, 40, 44):
        tree = sharding.Tree(n)
        pairs = keys.select(f"n{n + 1}", sharding.grown(sharding._least(sharding._key("k"), tree), "k", tree).alias("g")).collect()
        assert all(r[0] == r["g"] for r in pairs)
    assert all(90 < c < 210 for c in Counter(r["n40"] for r in got).values())
    shard = F.col("s").cast("int")
    at = {r["s"]: tuple(r["p"]) for r in spark.range(40).toDF("s").select("s", sharding.path(shard, sharding.Tree(40)).alias("p")).collect()}
    assert at[0] == (0, 0) and at[19] == (0, 3) and at[20] == (1, 4) and at[39] == (1, 7)


def test_slots_of_hot_keys_spread_over_groups(spark, monkeypatch):
    """Null keys, keys of a common factor and repeated keys don't fill one group."""
    monkeypatch.setattr(sharding, "GROUP_ROWS", 10)
    df = spark.range(4000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id * 1000 end as doc_id", "cast(id as string) as text")
    got = sharding.shard_rows(df, "doc_id", sharding.Tree(4), ["text"]).collect()
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert len(got) == 4000 and all(sorted(s) == list(range(len(s))) for s in per.values())
    hot = sorted(r["slot"] for r in got if r["doc_id"] is None)
    assert hot[-1] - hot[0] > 1.2 * len(hot)  # among others of the shard, not in a run


def test_slots_across_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 7)
    got = sharding.shard_rows(spark.range(2000).toDF("doc_id"), "doc_id", sharding.Tree(5)).collect()
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in per.values()) and len(got) == 2000


def changes(spark, rows):
    return spark.createDataFrame(rows, token_counts.CHANGES)


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_rollup(spark):
    rollup = token_counts.Rollup(spark, scratch(spark, "rollup"))
    assert totals(rollup) == {}
    first = changes(spark, [("insert", "a", "en", "t1", None, 10), ("insert", "a", "en", "t1", None, 5), ("insert", None, None, "t1", None, None)])
    assert rollup.apply("b-1", first) and not rollup.apply("b-1", first)
    assert totals(rollup) == {("a", "en", "t1"): (2, 15, 2), (None, None, "t1"): (1, 0, 1)}
    assert rollup.apply("b-2", changes(spark, [("delete", "a", "en", "t1", 5, None), ("revise", "a", "en", "t1", 10, 12), ("insert", "a", "en", "t2", None, 7)]))
    assert rollup.apply("b-3", changes(spark, [("delete", None, None, "t1", 0, None)]))
    assert rollup.apply("b-4", changes(spark, []))
    assert totals(rollup) == {("a", "en", "t1"): (1, 12, 4), ("a", "en", "t2"): (1, 7, 1)}
    again = token_counts.Rollup(spark, rollup.path)
    assert totals(again) == totals(rollup) and set(again.committed()) == {"b-1", "b-2", "b-3", "b-4"}


def test_attempts_without_a_marker_do_not_count(spark):
    rollup = token_counts.Rollup(spark, scratch(spark, "rollup"))
    batch = changes(spark, [("insert", "a", "en", "t", None, 3)])
    token_counts.delta(batch).write.parquet(f"{rollup.path}/deltas/b-1-crashed")
    assert totals(rollup) == {}
    assert rollup.apply("b-1", batch) and totals(rollup) == {("a", "en", "t"): (1, 3, 1)}


def test_a_crash_at_any_moment_of_a_commit(spark, monkeypatch):
    """Before the rename nothing has happened, after it all has; the batch can be sent again either way."""
    rollup = token_counts.Rollup(spark, scratch(spark, "rollup"))
    batch = changes(spark, [("insert", "a", "en", "t", None, 3)])
    publish = token_counts.Rollup._publish

    def before(self, place, entry):
        self._fs.mkdirs(self._to(f"{self.path}/commits/.half/{entry}"))  # made, not renamed
        raise RuntimeError("crash")

    def after(self, place, entry):
        publish(self, place, entry)
        raise RuntimeError("crash")

    monkeypatch.setattr(token_counts.Rollup, "_publish", before)
    with pytest.raises(RuntimeError):
        rollup.apply("b-1", batch)
    assert totals(rollup) == {} and rollup.committed() == {}
    monkeypatch.setattr(token_counts.Rollup, "_publish", after)
    with pytest.raises(RuntimeError):
        rollup.apply("b-1", batch)
    monkeypatch.undo()
    assert not rollup.apply("b-1", batch) and totals(rollup) == {("a", "en", "t"): (1, 3, 1)}


def test_the_second_of_two_writers_changes_nothing(spark):
    rollup = token_counts.Rollup(spark, scratch(spark, "rollup"))
    assert rollup._publish("commits/b", "first")
    made = rollup._to(f"{rollup.path}/commits/.late")
    rollup._fs.mkdirs(rollup._to(made, "second"))
    rollup._fs.rename(made, rollup._to(f"{rollup.path}/commits/b"))  # past the check for the folder
    assert rollup.committed() == {"b": "first"} and not rollup._publish("commits/b", "third")


def test_deltas_are_folded(spark, monkeypatch):
    rollup = token_counts.Rollup(spark, scratch(spark, "rollup"), fold=3)
    for i in range(7):
        assert rollup.apply(f"b-{i}", changes(spark, [("insert", "a", None, "t", None, i)]))
    assert totals(rollup) == {("a", None, "t"): (7, 21, 7)}
    base, new = rollup._open()
    assert base and sorted(new) == ["b-6"] and rollup._names("bases") == ["1", "2"]
    assert not rollup.apply("b-0", changes(spark, [("insert", "a", None, "t", None, 100)]))
    monkeypatch.setattr(token_counts.Rollup, "_publish", lambda *a: False)  # a fold that another writer was faster with
    rollup.compact()
    assert totals(rollup) == {("a", None, "t"): (7, 21, 7)}
    assert totals(token_counts.Rollup(spark, rollup.path)) == totals(rollup)


def test_token_counts_of_repeated_rows(spark, tmp_path):
    """The query on repeated and null ids, null columns and columns of clashing names, against its SQL."""
    import duckdb

    rows = [(1, "two words", "en", "a"), (1, "two words", "en", "a"), (1, "now three words", "en", "a"), (2, "bad text", "en", "b"), (2, None, None, None), (None, "no id", "en", "a"), (3, "", "en", "b"), (4, "é " * 5000, None, "b")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, tokenizer string, words int, op int")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 1, None), (4, None, None), (None, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    expected = con.execute(token_counts.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in token_counts.op4_token_counts(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected)) and any(r[5] > 3 for r in got)


def test_bad_batches(spark):
    rollup = token_counts.Rollup(spark, scratch(spark, "rollup"))
    with pytest.raises(Exception, match="no such change"):
        rollup.apply("b", changes(spark, [("upsert", "a", "en", "t", 1, 2)]))
    assert rollup.committed() == {}
    for name in ("", "a/b", ".hidden", "_x"):
        with pytest.raises(ValueError):
            rollup.apply(name, changes(spark, []))


SCHEMAS = {"add": {"a": ("number", True), "b": ("integer", True), "note": ("string", False)}, "list": {"of": ("array", True), "deep": ("boolean", False)}}


def message(conv, turn, role, body):
    return conv, turn, role, body if body is None or isinstance(body, str) else json.dumps(body)


def call(i, name="add", arguments='{"b": 2, "a": 1.5}', depends_on=None):
    return {"id": i, "name": name, "arguments": arguments} | ({"depends_on": depends_on} if depends_on is not None else {})


def linked(spark, messages):
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    return chat.link(*chat.parse_messages(df), SCHEMAS).collect()


def test_linking(spark):
    rows = linked(spark, [
        message(1, 0, "user", "add these"), message(1, 1, "assistant", {"tool_calls": [call("x"), call("y", depends_on=["x"])]}),
        message(1, 2, "tool", {"tool_call_id": "y", "content": 'two "lines"\n'}), message(1, 3, "tool", {"tool_call_id": "x", "content": "3"}),
        message(1, 4, "tool", {"tool_call_id": "x", "content": "later"}), message(1, 5, "tool", {"tool_call_id": "lost", "content": None}),
        message(1, 6, "assistant", {"tool_calls": [call("x"), call(None), call("z", "list", '{"of":[1, {"z":1,"a":null}]}')]}),
        message(2, 0, "assistant", {"tool_calls": [call("x")]}), message(2, 1, None, None), message(2, 2, "assistant", None), message(2, 3, "tool", "no json"),
    ])
    got = {(r["conv_id"], r["seq"], r["call_id"]): r for r in rows}
    assert {k: r["status"] for k, r in got.items()} == {
        (1, 0, "x"): "linked", (1, 1, "y"): "linked", (1, None, "lost"): "orphan", (1, 2, "x"): "repeated", (1, 3, None): "unanswered", (1, 4, "z"): "unanswered", (2, 0, "x"): "unanswered",
    }
    assert got[1, 1, "y"]["json"] == '{"arguments":{"a":1.5,"b":2},"depends_on":["x"],"id":"y","name":"add","result":"two \\"lines\\"\\n"}'
    assert json.loads(got[1, 0, "x"]["json"])["result"] == "3"
    assert got[1, 4, "z"]["json"] == '{"arguments":{"of":[1,{"a":null,"z":1}]},"depends_on":[],"id":"z","name":"list","result":null}'
    assert all(json.loads(r["json"]) for r in rows)


@pytest.mark.parametrize(
    "name,arguments,problems",
    [
        ("add", '{"a":1,"b":2}', ""), ("add", '{"a":1}', "b is missing"), ("add", '{"a":"1","b":2}', "a is no number"), ("add", '{"a":1,"b":2.5}', "b is no integer"),
        ("add", '{"a":1,"b":2,"c":3,"B":1}', "unknown parameters: B, c"), ("add", '{"a":1,"b":2,"note":null}', "note is no string"), ("add", "[1]", "arguments are no JSON object"),
        ("add", None, "arguments are no JSON object"), ("add", "{", "arguments are no JSON object"), ("sub", "{}", "no such tool"), (None, "{}", "no such tool"), ("list", '{"of":[],"deep":true}', ""), ("list", '{"of":{}}', "of is no array"),
    ],
)
def test_schemas(spark, name, arguments, problems):
    assert [r["problems"] for r in linked(spark, [message(1, 1, "assistant", {"tool_calls": [call("x", name, arguments)]})])] == [problems]


def test_topological_order(spark):
    def order(calls):
        rows = [r for r in linked(spark, [message(1, t, "assistant", {"tool_calls": [call(i, depends_on=d) for i, d in turn]}) for t, turn in enumerate(calls)])]
        return [(r["call_id"], r["status"]) for r in sorted(rows, key=lambda r: r["seq"])]

    plain = "unanswered"
    assert order([[("a", []), ("b", ["a"])], [("c", ["a", "b"])]]) == [("a", plain), ("b", plain), ("c", plain)]
    assert order([[("a", ["c"]), ("b", [])], [("c", ["b"])]]) == [("b", plain), ("c", plain), ("a", plain)]
    assert order([[("a", ["b"]), ("b", ["a"]), ("c", ["a"]), ("d", ["unknown"])]]) == [("d", plain), ("a", "cyclic"), ("b", "cyclic"), ("c", "cyclic")]
    assert order([[("a", ["a"]), ("b", [])]]) == [("b", plain), ("a", "cyclic")]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 300 calls in reverse, one with a second branch, and a cycle beside them."""
    rounds = []
    keep = chat.stored
    monkeypatch.setattr(chat, "stored", lambda df, name: rounds.append(name) or keep(df, name))
    n = 300
    nodes = [(1, f"c{i}") for i in range(n)] + [(2, f"d{i}") for i in range(9)]
    edges = [(1, f"c{i}", f"c{i + 1}") for i in range(n - 1)] + [(1, "c0", "c200"), (2, "d0", "d1"), (2, "d1", "d2"), (2, "d2", "d0"), (2, "d3", "d2"), (2, "d4", "d5"), (2, "d4", "d6"), (2, "d5", "d7"), (2, "d6", "d7"), (2, "d8", "d8")]
    got = {(r["conv_id"], r["_id"]): r["depth"] for r in chat.depths(spark.createDataFrame(nodes, "conv_id long, _id string"), spark.createDataFrame(edges, "conv_id long, _from string, _to string")).collect()}
    assert got == {(1, f"c{i}"): n - 1 - i for i in range(n)} | {(2, f"d{i}"): d for i, d in enumerate((None, None, None, None, 2, 1, 1, 0, None))}
    assert rounds.count("seen") <= 13


def test_messages_of_other_roles(spark):
    df = spark.createDataFrame([message(1, 0, "system", 'be "kind"'), message(1, 1, "assistant", {"tool_calls": [call("x")]}), message(1, 2, "tool", {"tool_call_id": "x"}), message(1, 3, "assistant", "done"), message(1, 4, None, None), message(1, 5, "tool", "no json"), message(1, 6, "assistant", {"tool_calls": []})], "conv_id long, turn long, role string, text string")
    rows = chat.link(*chat.parse_messages(df), SCHEMAS, chat.other_messages(df)).collect()
    assert Counter(r["status"] for r in rows) == {"linked": 1, "message": 5}
    assert sorted(json.loads(r["json"])["turn"] for r in rows if r["status"] == "message") == [0, 3, 4, 5, 6]
    assert '{"content":"be \\"kind\\"","role":"system","turn":0}' in {r["json"] for r in rows} and '{"content":null,"role":null,"turn":4}' in {r["json"] for r in rows}


def test_chat_query_has_every_status(spark):
    """The rule yields late dependencies, cycles, repeated ids and every kind of problem, and no message is left out."""
    sf = "/root/testdata/sf0.01"
    rows = chat.op8_chat(spark, sf).collect()
    messages = spark.read.parquet(f"{sf}/conversations.parquet")
    per = Counter(r["status"] for r in rows)
    assert set(per) == {"linked", "unanswered", "repeated", "cyclic", "orphan", "message"}
    taken = sum(json.loads(r["json"]).get("result") is not None for r in rows if r["seq"] is not None)
    assert len(rows) + taken == messages.count()
    assert {p for r in rows for p in r["problems"].split("; ")} == {"", "turn is no integer", "unknown parameters: note", "arguments are no JSON object", "no such tool"}
    assert any(json.loads(r["json"])["depends_on"][1:] for r in rows if r["seq"] is not None)


def test_chat_with_clashing_columns(spark):
    columns = ["pos", "call_id", "name", "arguments", "depends_on", "content", "depth", "seq", "cyclic", "_k", "_n", "status", "json"]
    rows = [(3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", None)]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = plain.select("*", *[F.lit("mine").alias(c) for c in columns])
    one, two = (sorted(map(str, chat.link(*chat.turns_as_calls(d), chat.REPLY, chat.plain_messages(d)).collect())) for d in (plain, df))
    assert one == two and len(one) == 2


def test_chat_small_cases(spark):
    assert linked(spark, [message(1, 0, "user", "x")][:0]) == []
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 5, "assistant", None), (2, 700, "user", None), (2, 702, "user", "x" * 100_000)], "conv_id long, turn long, role string, text string")
    rows = chat.link(*chat.turns_as_calls(df), chat.REPLY).collect()
    assert Counter(r["status"] for r in rows) == {"linked": 1, "repeated": 1, "orphan": 1, "unanswered": 2}
    assert sorted(r["seq"] for r in rows if r["conv_id"] == 2 and r["seq"] is not None) == [0, 1]


def test_no_result_is_lost(spark):
    rows = linked(spark, [
        message(1, 0, "assistant", {"tool_calls": [call("call_0")]}), message(1, 1, "tool", {"tool_call_id": "call_0", "content": "first"}),
        message(1, 2, "assistant", {"tool_calls": [call("call_0")]}), message(1, 3, "tool", {"tool_call_id": "call_0", "content": "second"}),
        message(1, 4, "tool", {"tool_call_id": "call_0", "content": "third"}), message(1, 5, "tool", {"tool_call_id": "call_0", "content": "third"}),
        message(1, 6, "tool", {"tool_call_id": "lost", "content": "a"}), message(1, 7, "tool", {"tool_call_id": "lost", "content": "b"}),
        message(1, 8, "tool", {"tool_call_id": None, "content": "c"}), message(1, 9, "tool", {"content": "c"}), message(1, 10, "tool", {"tool_call_id": None}),
        message(1, 11, "assistant", {"tool_calls": [call(None)]}), message(1, 12, "tool", "no json"), message(1, 13, "tool", "[1]"),
    ])
    got = Counter((r["seq"], r["call_id"], r["status"], json.loads(r["json"])["result"]) for r in rows)
    assert got == {
        (0, "call_0", "linked", "first"): 1, (1, "call_0", "repeated", "second"): 1, (None, "call_0", "repeated", "third"): 2, (None, "lost", "orphan", "a"): 1, (None, "lost", "orphan", "b"): 1,
        (None, None, "orphan", "c"): 2, (None, None, "orphan", None): 1, (2, None, "unanswered", None): 1,
    }
