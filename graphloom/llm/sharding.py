"""Sharding by a hierarchical weighted hash tree (native).

A row descends region -> rack -> shard. On each level every child of the node reached has a draw from the row's key
that is exponential with the child's weight as its rate, and the least draw wins, so a child is taken in proportion to its
weight. A shard's draw is ``-ln(u) / weight``, u hashed from the key and the shard's number; a rack's draw is the least of
its shards', a region's the least of its racks', which is such a draw for the sum of their weights. So the draws of a node
change only where a weight below it does: a weight that grows draws rows into its own shard only, one that shrinks lets
rows go from it only, and nothing moves between other subtrees. One more shard, in a rack that isn't full, in a new rack or in a new region,
takes rows only into itself, for every number of shards. One digest of the key serves a whole rack.

The price is a digest for each rack and row, rather than for each child on the way down: independent draws for inner nodes would
cost fewer, but a row that a heavier region wins would then be dealt anew among all shards of the region.

Rows may have keys of any type; null keys are one key, as are equal ones, and go to one shard. Columns of the input that are named like
the operator's own come back with an underscore after their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import draw52, small, stored, table, unused

#: Rows that one slot-numbering group should hold.
GROUP_ROWS = 4096


@dataclass(frozen=True)
class Tree:
    """n shards, so many to a rack and so many racks to a region; weights by shard (default 1)."""

    n: int
    shards_per_rack: int = 5
    racks_per_region: int = 4
    weights: tuple[float, ...] | None = None

    def weight(self, first: int, count: int) -> float:
        w = self.weights or (1.0,) * self.n
        return float(sum(w[first : min(first + count, self.n)]))


#: Hexadecimal digits of a draw; a digest of 32 digits serves so many shards.
DIGITS = 6
DRAWS = 32 // DIGITS


def _digest(key: Column, number: Column) -> Column:
    """The digest from which DRAWS neighbouring shards have their draws."""
    return F.md5(F.concat_ws(":", key, F.lit("shards"), number.cast("string")))


def _least(key: Column, tree: Tree) -> Column:
    """struct(draw, shard) of the shard that a key reaches: least of racks' leasts, of which a region's least is one.

    Shards are drawn over arrays, so generated code doesn't grow with the tree. Ties go to the lower number.
    """
    weights = F.array(*[F.lit(tree.weight(i, 1)) for i in range(tree.n)])

    def shard_draw(digest: Column, first: Column) -> Callable[[Column], Column]:
        def draw(i: Column) -> Column:
            shard = first + i
            w = F.try_element_at(weights, shard + 1)
            u = (F.conv(F.substring(digest, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("double") + 1) / F.lit(float(16**DIGITS + 1))
            return F.when(w > 0, F.struct((-F.ln(u) / w).alias("draw"), shard.alias("shard")))

        return draw

    def some(number: Column) -> Column:
        digest = _digest(key, number)
        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), shard_draw(digest, number * DRAWS)))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit((tree.n - 1) // DRAWS)), some))


def placed(df: DataFrame, key: str, tree: Tree, name: str = "shard") -> DataFrame:
    """df with its shard, as a column of that name; one projection, no shuffle."""
    return df.withColumn(name, _least(_key(key), tree)["shard"])


def path(shard: Column, tree: Tree) -> Column:
    """struct(region, rack) of a shard."""
    per = tree.shards_per_rack
    return F.struct(F.floor(shard / (per * tree.racks_per_region)).cast("int").alias("region"), F.floor(shard / per).cast("int").alias("rack"))


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def grown(reached: Column, key: str, tree: Tree) -> Column:
    """The shard with one more of weight 1, for a row that reaches ``reached`` (from ``_least``): the new one where its draw is less, else the same."""
    n = tree.n
    digest = F.conv(F.substring(_digest(_key(key), F.lit(n // DRAWS)), n % DRAWS * DIGITS + 1, DIGITS), 16, 10).cast("double")
    draw = -F.ln((digest + 1) / F.lit(float(16**DIGITS + 1)))
    return F.when(reached.isNull() | (draw < reached["draw"]), F.lit(n)).otherwise(reached["shard"])


def slots(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """df, which has a shard of n, with ``slot``, gapless from 0 in each shard.

    Slots are numbered inside groups of about GROUP_ROWS rows of a shard, dealt by a hash of the key and the columns of order,
    and each group starts where the groups before it end: no task holds a whole shard. Rows that are equal in all of these have neighbouring slots.
    """
    group, start, own = (unused(n, df.columns) for n in ("_group", "_start", "_own"))
    groups = max(1, -(-df.count() // (GROUP_ROWS * n)))
    number = draw52(F.lit("slot"), *[_key(c) for c in (key, *order)]) % groups
    marked = df.withColumn(group, number)
    sizes = marked.groupBy("shard", group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy("shard", group).orderBy(key, *order)
    numbered = marked.withColumn(own, F.row_number().over(inside).cast("long") - 1)
    joined = numbered.join(small(starts, n * groups), ["shard", group])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(own) + F.col(start)).alias("slot"))


def shard_rows(df: DataFrame, key: str, tree: Tree, order: list[str] = ()) -> DataFrame:
    """df with ``shard`` and ``slot``. df's own columns named shard or slot come back as ``shard_`` and ``slot_``."""
    order = [f"{c}_" if c in ("shard", "slot") else c for c in order]
    key = f"{key}_" if key in ("shard", "slot") else key
    df = df.select(*[F.col(f"`{c}`").alias(f"{c}_" if c in ("shard", "slot") else c) for c in df.columns])
    return slots(placed(df, key, tree), key, order, tree.n)


def op10_sharding(spark: SparkSession, sf_dir: str, n: int = 40) -> DataFrame:
    """Law ``key``: id and number of shards decide, and one more shard takes rows only into itself, whatever n is."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        _least(_key("doc_id"), Tree(n)).alias("reached"),
    )
    thin = stored(docs, "placed").withColumn("shard", F.col("reached.shard"))
    out = slots(thin, "doc_id", ["text_crc32", "size"], n)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown(F.col("reached"), "doc_id", Tree(n)).cast("int").alias("grown_shard"))


def _reached(n: int) -> str:
    """SQL for the shard that a doc_id reaches among n of weight 1."""
    digest = f"md5(coalesce(doc_id::VARCHAR, 'null') || ':shards:' || (s // {DRAWS}))"
    u = f"(('0x' || substr({digest}, (s % {DRAWS} * {DIGITS} + 1)::INTEGER, {DIGITS}))::BIGINT::DOUBLE + 1) / {16**DIGITS + 1}.0::DOUBLE"
    return f"list_min(list_transform(range({n}), lambda s: {{'draw': -ln({u}), 'shard': s}})).shard::INTEGER"


ORACLE_SQL = f"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), b AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 16 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, t
), p AS (SELECT *, {_reached(40)} AS shard, {_reached(41)} AS grown_shard FROM b), n AS (SELECT greatest(1, ceil(count(*) / {GROUP_ROWS * 40}.0))::BIGINT AS groups FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32 || ':' || size), 1, 13))::BIGINT % groups, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM p, n
"""
