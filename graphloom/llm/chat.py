"""Chat formatting by tool-call linking (native).

Messages become events: calls (id, name, arguments as JSON, ids of the calls that they depend on) and
results (id of the call, content). Calls and results are joined by a hash of conversation and id. The
k-th result of an id, in message order, goes with the id's k-th call; calls without one, results without
a call, results beyond the calls of their id, ids that occur again and messages that are neither are reported, not dropped.

Calls are ordered topologically inside a conversation. Calls whose dependencies all stand before them
in message order already are in such an order, and nearly all conversations need no more. Only
conversations with a dependency that stands later are ordered by depth, the longest way down their dependencies, then by message order.
Depths are found in rounds of joins: calls without an open dependency are placed, dependencies on placed calls become a
least depth, and a dependency on a call that itself has only one left is replaced by that one, two steps long. So ways are halved
each round, and a chain of n calls takes about log2(n) rounds whatever its order. Calls that are left when a round places
none are in a cycle, or wait for one, and are marked so; they come last.

Arguments are parsed into a map of JSON values and checked against the tool's schema: required
parameters, unknown parameters, and the JSON type of each. Canonical JSON has sorted keys and no blanks
outside strings; the engine's variant type writes it.

Null roles, texts, ids and arguments are allowed: a null argument text is invalid JSON, a null id never
links, so that its results are orphans. Empty tables give empty results. Repeated rows are repeated ids. Other columns of the input
are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

#: JSON type names that a schema may ask for, with the first letters that such a value can have.
FIRST_LETTERS = {"string": '"', "number": "-0123456789", "integer": "-0123456789", "boolean": "tf", "array": "[", "object": "{", "null": "n"}

#: Turns numbered together.
SPAN = 256

#: tool -> parameter -> (JSON type, required)
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

ENVELOPE = "STRUCT<tool_calls: ARRAY<STRUCT<id: STRING, name: STRING, arguments: STRING, depends_on: ARRAY<STRING>>>, tool_call_id: STRING, content: STRING>"


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text).

    An assistant's text of the form {"tool_calls": [{"id", "name", "arguments", "depends_on"}]} holds calls,
    a tool's text {"tool_call_id", "content"} holds a result, with either key alone too. Other messages hold neither.
    """
    keys = F.map_keys(_values("text"))
    has = F.coalesce(F.array_contains(keys, "tool_call_id") | F.array_contains(keys, "content"), F.lit(False))
    parsed = messages.filter(F.col("role").isin("assistant", "tool")).select("conv_id", "turn", "role", F.from_json("text", ENVELOPE).alias("m"), has.alias("_has"))
    calls = parsed.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode("m.tool_calls").alias("pos", "c"))
    calls = calls.select("conv_id", "turn", "pos", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = parsed.filter("role = 'tool' AND (m.tool_call_id IS NOT NULL OR m.content IS NOT NULL OR _has)").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))
    return calls, results


def other_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the messages in which ``parse_messages`` finds neither calls nor a result."""
    keys = F.map_keys(_values("text"))
    m = F.from_json("text", ENVELOPE)
    calls = (F.col("role") == "assistant") & (F.size(m["tool_calls"]) > 0)
    has = F.array_contains(keys, "tool_call_id") | F.array_contains(keys, "content")
    result = (F.col("role") == "tool") & (m["tool_call_id"].isNotNull() | m["content"].isNotNull() | has)
    return messages.filter(~F.coalesce(calls, F.lit(False)) & ~F.coalesce(result, F.lit(False))).select("conv_id", "turn", "role", "text")


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations, which hold no calls, as calls and results, by a rule of turn and conversation number.

    Each user turn asks a tool, with the turn's text and number as arguments; an assistant's turn is the result for the
    turn before it; ``plain_messages`` has the messages of other roles. k = turn div 2 numbers a conversation's user turns.

    - Id: that of the turn; where conversation mod 9 = 8, turns of k mod 4 = 1 use that of the user turn before them again.
    - Dependencies, by conversation mod 4: 0, the user turn before; 1, even k the one after, which stands later, and from k = 2 the one
      before; 2, k mod 4 = 1 the one after, 2 and 3 the one before, so that 1 and 2 are a cycle for which 3 waits; 3, the two before.
    - Tool ``reply``, but ``search``, which has no schema, where (conversation + turn) mod 11 = 5.
    - Results: for the turn before; where (conversation + turn) mod 19 = 7, for an id that no call has.
    - Arguments, by conversation + turn: mod 7 = 3, the number as a string; else mod 13 = 4, a parameter ``note`` more; else mod 17 = 6, no JSON.
    """
    conv, turn = F.col("conv_id"), F.col("turn")

    def id_of(at: Column) -> Column:
        again = F.coalesce((conv % 9 == 8) & (F.floor(at / 2) % 4 == 1), F.lit(False))
        return F.concat_ws("-", F.lit("call"), conv, F.when(again, at - 2).otherwise(at))

    k, before, after, none = F.floor(turn / 2), id_of(turn - 2), id_of(turn + 2), F.array().cast("array<string>")
    kinds = [
        F.when(k >= 1, F.array(before)),
        F.when((k % 2 == 0) & (k >= 2), F.array(before, after)).when(k % 2 == 0, F.array(after)),
        F.when(k % 4 == 1, F.array(after)).when(k % 4 >= 2, F.array(before)),
        F.when(k >= 2, F.array(id_of(turn - 4), before)).when(k == 1, F.array(before)),
    ]
    depends = F.coalesce(*[F.when(conv % 4 == i, kind) for i, kind in enumerate(kinds)], none)
    prompt, n = F.col("text").alias("prompt"), conv + turn
    json = F.when(n % 7 == 3, F.to_json(F.struct(prompt, turn.cast("string").alias("turn")))).when(n % 13 == 4, F.to_json(F.struct(F.lit(True).alias("note"), prompt, "turn")))
    json = json.when(n % 17 == 6, F.lit("no JSON")).otherwise(F.to_json(F.struct(prompt, "turn")))
    name = F.when(n % 11 == 5, "search").otherwise("reply")
    calls = messages.filter("role = 'user'").select("conv_id", "turn", F.lit(0).alias("pos"), id_of(turn).alias("call_id"), name.alias("name"), json.alias("arguments"), depends.alias("depends_on"))
    results = messages.filter("role = 'assistant'").select("conv_id", "turn", F.when(n % 19 == 7, F.concat_ws("-", F.lit("lost"), conv, turn)).otherwise(id_of(turn - 1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def plain_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the messages that ``turns_as_calls`` reads neither as calls nor as results."""
    return messages.filter("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", "turn", "role", "text")


def _problems(schemas: Schemas) -> Column:
    """Array of what is wrong with (name, _arguments), empty for a valid call."""
    out = [F.when(F.col("_arguments").isNull(), F.lit("arguments are no JSON object"))]
    known = F.lit(False)
    for tool, parameters in sorted(schemas.items()):
        here = F.col("name") == tool
        known = known | here
        for p, (kind, required) in sorted(parameters.items()):
            value = F.try_element_at("_arguments", F.lit(p))
            fits = F.instr(F.lit(FIRST_LETTERS[kind]), F.substring(value, 1, 1)) > 0
            if kind == "integer":
                fits = value.rlike(r"^-?[0-9]+$")
            out.append(F.when(here & value.isNotNull() & ~fits, F.lit(f"{p} is no {kind}")))
            if required:
                out.append(F.when(here & F.col("_arguments").isNotNull() & value.isNull(), F.lit(f"{p} is missing")))
        extra = F.array_except(F.map_keys("_arguments"), F.array(*[F.lit(p) for p in sorted(parameters)]).cast("array<string>"))
        out.append(F.when(here & (F.size(extra) > 0), F.concat(F.lit("unknown parameters: "), F.array_join(F.sort_array(extra), ", "))))
    out.append(F.when(~F.coalesce(known, F.lit(False)), F.lit("no such tool")))
    return F.array_compact(F.array(*out))


def _quoted(text: Column) -> Column:
    """A JSON string; null stays null."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


#: A way's length beyond which it only goes round cycles.
FAR = 2**40


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, _id, depth): the longest way down the edges (conv_id, _from, _to) from each of nodes (conv_id, _id); null in or above a cycle."""
    node = ["conv_id", "_id"]
    state = stored(nodes.select(*node, F.lit(0).cast("long").alias("least"), F.lit(None).cast("long").alias("depth")), "state")
    edges = stored(edges.select("conv_id", "_from", "_to", F.lit(1).cast("long").alias("w")).distinct(), "edges")
    while True:
        open_ = edges.groupBy("conv_id", F.col("_from").alias("_id")).agg(F.count(F.lit(1)).alias("n"), F.min("_to").alias("next"), F.max("w").alias("w_next"))
        seen = state.join(open_, node, "left").withColumn("ready", F.col("depth").isNull() & F.col("n").isNull())
        seen = stored(seen.withColumn("depth", F.when(F.col("ready"), F.col("least")).otherwise(F.col("depth"))), "seen")
        discard(state)
        if seen.filter("ready").isEmpty():
            return seen.select(*node, "depth")
        placed, single = F.col("depth").isNotNull(), F.col("n") == 1
        met = edges.join(seen.withColumnRenamed("_id", "_to"), ["conv_id", "_to"]).select(
            "conv_id", "_from",
            F.when(placed, None).when(single, F.col("next")).otherwise(F.col("_to")).alias("_to"),
            F.when(~placed & single, F.least(F.col("w") + F.col("w_next"), F.lit(FAR))).otherwise(F.col("w")).alias("w"),
            F.when(placed, F.col("w") + F.col("depth")).when(single, F.col("w") + F.col("least")).alias("gain"),
        )
        met = stored(met, "met")
        discard(edges)
        gains = met.groupBy("conv_id", F.col("_from").alias("_id")).agg(F.max("gain").alias("gain"))
        state = stored(seen.join(gains, node, "left").select(*node, F.greatest("least", F.coalesce("gain", F.lit(0))).alias("least"), "depth"), "state")
        edges = stored(met.filter("_to IS NOT NULL").groupBy("conv_id", "_from", "_to").agg(F.max("w").alias("w")), "edges")
        discard(seen)
        discard(met)


def topological(calls: DataFrame) -> DataFrame:
    """calls with ``seq``, from 0 in each conversation, and ``cyclic``; calls without a place come last."""
    position = F.struct("turn", "pos")
    deps = calls.select("conv_id", F.col("call_id").alias("_from"), position.alias("_at"), F.explode(F.array_distinct("depends_on")).alias("_to"))
    firsts = calls.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(position).alias("_to_at"))
    edges = deps.join(firsts, (deps["conv_id"] == firsts["conv_id"]) & (deps["_to"] == firsts["call_id"])).select(deps["conv_id"], "_from", "_to", "_at", "_to_at")
    hard = stored(edges.filter("_to_at >= _at").select("conv_id").distinct(), "hard")
    if hard.isEmpty():
        ranked = calls.withColumn("depth", F.lit(0).cast("long")).withColumn("cyclic", F.lit(False))
    else:
        nodes = firsts.join(hard, "conv_id", "left_semi").select("conv_id", F.col("call_id").alias("_id"))
        late = depths(nodes, edges.filter("_from IS NOT NULL").join(hard, "conv_id", "left_semi")).select("conv_id", F.col("_id").alias("call_id"), F.coalesce("depth", F.lit(FAR)).alias("depth"))
        ranked = calls.join(late, ["conv_id", "call_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("cyclic", F.col("depth") == FAR)
    # Numbered inside spans of turns; a span starts where the spans before it end, so no task needs a whole conversation.
    ranked = ranked.withColumn("_span", F.floor(F.col("turn") / SPAN))
    keys = ["conv_id", "depth", "_span"]
    before = Window.partitionBy("conv_id").orderBy("depth", "_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys).orderBy("turn", "pos", "call_id", "arguments")
    numbered = ranked.withColumn("seq", F.row_number().over(inside) - 1)
    same = [numbered[k].eqNullSafe(starts[k]) for k in keys]
    return numbered.join(starts, same).select(*[numbered[c] for c in [*calls.columns, "cyclic"]], (F.col("seq") + F.col("_start")).alias("seq"))


#: Bytes of results in a partition up to which a hash table of them is built.
HASHED = 64 * 2**20


def _hashed(results: DataFrame, text: str) -> DataFrame:
    """results with the hint for a shuffled hash join, if their counted bytes leave partitions small enough; else the planner decides."""
    size = results.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64)).first()[0] or 0
    parts = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return results.hint("shuffle_hash") if size <= HASHED * parts else results


def link(calls: DataFrame, results: DataFrame, schemas: Schemas, others: DataFrame | None = None) -> DataFrame:
    """A row for each call, each result that none takes, and each of others (conv_id, turn, role, text): (conv_id, seq, call_id, name, status, problems, json).

    status: linked, unanswered, repeated (an id that an earlier call has, or a result beyond the calls of its id),
    cyclic, orphan (a result without a call), or message (one of others). A call of a repeated id has its own result, the id's k-th.
    """
    calls = calls.withColumn("_arguments", _values("arguments"))
    place = Window.partitionBy("conv_id", "call_id").orderBy("turn", "content")
    ranked = results.filter("call_id IS NOT NULL").select("conv_id", "call_id", F.row_number().over(place).alias("_k"), F.struct("content").alias("_result"))
    ids = Window.partitionBy("conv_id", "call_id", F.when(F.col("call_id").isNull(), F.col("turn"))).orderBy("turn", "pos", "arguments")
    ordered = topological(calls).withColumn("_k", F.row_number().over(ids)).withColumn("_again", (F.col("_k") > 1) & F.col("call_id").isNotNull())
    linked = ordered.join(_hashed(ranked, "_result.content"), ["conv_id", "call_id", "_k"], "left")
    answered = F.col("_result").isNotNull()
    status = F.when(F.col("_again"), "repeated").when(F.col("cyclic"), "cyclic").when(answered, "linked").otherwise("unanswered")
    null = F.lit("null")
    text = F.concat(
        F.lit('{"arguments":'), F.when(F.col("_arguments").isNotNull(), F.expr("to_json(try_parse_json(arguments))")).otherwise(null),
        F.lit(',"depends_on":'), F.to_json(F.sort_array("depends_on")),
        F.lit(',"id":'), F.coalesce(_quoted(F.col("call_id")), null),
        F.lit(',"name":'), F.coalesce(_quoted(F.col("name")), null),
        F.lit(',"result":'), F.when(answered, F.coalesce(_quoted(F.col("_result.content")), null)).otherwise(null),
        F.lit("}"),
    )
    out = linked.select("conv_id", F.col("seq").cast("long").alias("seq"), "call_id", "name", status.alias("status"), F.array_join(_problems(schemas), "; ").alias("problems"), text.alias("json"))
    per_id = calls.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("_n"))
    beyond = ranked.join(per_id, ["conv_id", "call_id"], "left").filter("_n IS NULL OR _k > _n")
    beyond = beyond.select("conv_id", "call_id", "_result", F.when(F.col("_n").isNull(), "orphan").otherwise("repeated").alias("status"))
    nameless = results.filter("call_id IS NULL").select("conv_id", "call_id", F.struct("content").alias("_result"), F.lit("orphan").alias("status"))
    nothing = F.lit(None).cast("string")
    left = F.concat(F.lit('{"id":'), F.coalesce(_quoted(F.col("call_id")), null), F.lit(',"result":'), F.coalesce(_quoted(F.col("_result.content")), null), F.lit("}"))
    nothing = F.lit(None).cast("string")
    rest = beyond.unionByName(nameless).select("conv_id", "call_id", "status", left.alias("json"))
    if others is not None:
        text = F.concat(F.lit('{"content":'), F.coalesce(_quoted(F.col("text")), null), F.lit(',"role":'), F.coalesce(_quoted(F.col("role")), null), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), null), F.lit("}"))
        rest = rest.unionByName(others.select("conv_id", nothing.alias("call_id"), F.lit("message").alias("status"), text.alias("json")))
    return out.unionByName(rest.select("conv_id", F.lit(None).cast("long").alias("seq"), "call_id", nothing.alias("name"), "status", F.lit("").alias("problems"), "json"))


def _values(col: str) -> Column:
    """A JSON object as a map from key to the JSON text of its value; null if the text is no object."""
    return F.expr(f"transform_values(try_cast(try_parse_json({col}) AS MAP<STRING, VARIANT>), (k, v) -> to_json(v))")


REPLY: Schemas = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of conversations: as a call, as a call's result, or as a row of its own."""
    messages = table(spark, sf_dir, "conversations")
    return link(*turns_as_calls(messages), REPLY, plain_messages(messages))


def _id(turn: str) -> str:
    return f"'call-' || conv_id || '-' || ({turn} - CASE WHEN conv_id % 9 = 8 AND (({turn}) // 2) % 4 = 1 THEN 2 ELSE 0 END)"


_QUOTED = "to_json({})::VARCHAR"
ORACLE_SQL = f"""
WITH RECURSIVE users AS (
  SELECT conv_id, turn, text, turn // 2 AS k, conv_id + turn AS n, {_id("turn")} AS call_id, {_id("turn - 2")} AS before, {_id("turn + 2")} AS after, {_id("turn - 4")} AS before2
  FROM conversations WHERE role = 'user'
), kinds AS (
  SELECT *, CASE WHEN n % 7 = 3 THEN 'string' WHEN n % 13 = 4 THEN 'note' WHEN n % 17 = 6 THEN 'none' ELSE 'whole' END AS kind, CASE WHEN n % 11 = 5 THEN 'search' ELSE 'reply' END AS name,
    list_sort(CASE conv_id % 4 WHEN 0 THEN CASE WHEN k >= 1 THEN [before] ELSE [] END WHEN 1 THEN CASE WHEN k % 2 = 0 AND k >= 2 THEN [before, after] WHEN k % 2 = 0 THEN [after] ELSE [] END
      WHEN 2 THEN CASE WHEN k % 4 = 1 THEN [after] WHEN k % 4 >= 2 THEN [before] ELSE [] END ELSE CASE WHEN k >= 2 THEN [before2, before] WHEN k = 1 THEN [before] ELSE [] END END) AS deps
  FROM users
), calls AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text) AS nth FROM kinds
), nodes AS (
  SELECT conv_id, call_id, min(turn) AS first, count(*) OVER (PARTITION BY conv_id) AS size FROM calls GROUP BY conv_id, call_id
), waits AS (
  SELECT c.conv_id, c.call_id, n.call_id AS needs, n.first >= c.turn AS late FROM (SELECT conv_id, turn, call_id, unnest(list_distinct(deps)) AS dep FROM calls) c JOIN nodes n ON n.conv_id = c.conv_id AND n.call_id = c.dep
), hard AS (
  SELECT DISTINCT conv_id FROM waits WHERE late
), walk AS (
  SELECT conv_id, call_id, 0 AS len, size FROM nodes WHERE conv_id IN (SELECT conv_id FROM hard)
  UNION SELECT w.conv_id, w.call_id, walk.len + 1, walk.size FROM walk JOIN waits w ON w.conv_id = walk.conv_id AND w.needs = walk.call_id WHERE walk.len < walk.size
), depth AS (
  SELECT conv_id, call_id, max(len) AS depth, max(len) >= max(size) AS cyclic FROM walk GROUP BY conv_id, call_id
), ordered AS (
  SELECT c.*, coalesce(d.cyclic, false) AS cyclic, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN coalesce(d.cyclic, false) THEN 1000000 ELSE coalesce(depth, 0) END, turn, call_id, text) - 1 AS seq
  FROM calls c LEFT JOIN depth d USING (conv_id, call_id)
), results AS (
  SELECT conv_id, call_id, text AS content, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text) AS nth FROM (SELECT conv_id, turn, text, CASE WHEN (conv_id + turn) % 19 = 7 THEN 'lost-' || conv_id || '-' || turn ELSE {_id("turn - 1")} END AS call_id FROM conversations WHERE role = 'assistant')
)
SELECT c.conv_id, c.seq::BIGINT AS seq, c.call_id, c.name,
  CASE WHEN c.nth > 1 THEN 'repeated' WHEN c.cyclic THEN 'cyclic' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  array_to_string(list_filter([CASE WHEN kind = 'none' THEN 'arguments are no JSON object' END, CASE WHEN name = 'reply' AND kind <> 'none' AND c.text IS NULL THEN 'prompt is missing' END,
    CASE WHEN name = 'reply' AND kind = 'string' THEN 'turn is no integer' END, CASE WHEN name = 'reply' AND kind = 'note' THEN 'unknown parameters: note' END, CASE WHEN name <> 'reply' THEN 'no such tool' END], lambda x: x IS NOT NULL), '; ') AS problems,
  '{{"arguments":' || CASE WHEN kind = 'none' THEN 'null' ELSE '{{' || CASE WHEN kind = 'note' THEN '"note":true,' ELSE '' END || CASE WHEN c.text IS NULL THEN '' ELSE '"prompt":' || {_QUOTED.format("c.text")} || ',' END
    || '"turn":' || CASE WHEN kind = 'string' THEN '"' || c.turn || '"' ELSE c.turn::VARCHAR END || '}}' END
    || ',"depends_on":' || {_QUOTED.format("deps")} || ',"id":"' || c.call_id || '","name":"' || name || '","result":' || coalesce({_QUOTED.format("r.content")}, 'null') || '}}' AS json
FROM ordered c LEFT JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id AND c.nth = r.nth
UNION ALL
SELECT r.conv_id, NULL, r.call_id, NULL, CASE WHEN n.c IS NULL THEN 'orphan' ELSE 'repeated' END, '', '{{"id":"' || r.call_id || '","result":' || coalesce({_QUOTED.format("r.content")}, 'null') || '}}'
FROM results r LEFT JOIN (SELECT conv_id, call_id, count(*) AS c FROM calls GROUP BY ALL) n ON n.conv_id = r.conv_id AND n.call_id = r.call_id WHERE n.c IS NULL OR r.nth > n.c
UNION ALL
SELECT conv_id, NULL, NULL, NULL, 'message', '', '{{"content":' || coalesce({_QUOTED.format("text")}, 'null') || ',"role":' || coalesce({_QUOTED.format("role")}, 'null') || ',"turn":' || turn || '}}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
