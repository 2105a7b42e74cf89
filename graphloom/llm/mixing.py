"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (native).

Each source gets a target in words: its weight's share of the mixture, stopped at ``cap`` times its
own words, the excess reshared by weight. Its documents form about sqrt(rows) blocks, all sources together BLOCKS at most
(but one each), dealt by a hash of id and text, so that neither a null or repeated id nor a text that many documents have fills a block.
A source that is read more than once has a pass for every time; in each pass its blocks are permuted
anew, and the target cuts the last block at a place in its documents' hashed order. The exact numbers of blocks of all
sources are then split down a binary tree over the output shards: on every level half of a node's
draws go left, drawn without replacement, so the left counts by source are one multivariate
hypergeometric draw. A shard's quota of a source is a range of its permuted blocks, and ranges are
disjoint. Inside a shard documents are ordered by hash.

All this is decided on rows of hashes and sizes. Texts only meet the table of blocks, which is broadcast while its
counted rows allow (sources, not documents, decide that), and are shuffled once, when a mixture is written out in its shards' order.

Null sources are a source of their own, last in order; null texts have size 0; rows with equal id and text are one
unit where a block is cut, so all or none of them are taken there. An empty table gives an empty mixture. Columns of any other name are carried in a struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, draw52, small, stored, table, unused, word_count

SEED = 20
#: Blocks of all sources together, but one of each source at least.
BLOCKS = 16_384


def source_targets(sizes: DataFrame, weights: list[int], share: tuple[int, int], cap: int) -> DataFrame:
    """(source, src, weight, source_size, n_docs, n_blocks, target) for rows (source, size).

    Water level: with sources in order of the level at which they reach their cap, the first
    one whose cap is not below the level shared by it and the rest sets the level of all of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("src", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % n + 1).cast("int")).cast("long"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("_words", F.sum("source_size").over(everything) * share[0] / F.lit(float(share[1])))
        .withColumn("_capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap)
        .withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", (F.col("_words") - F.col("_capped")) / F.col("_open"))
        .withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("source_size") * cap, F.struct(F.col("source_size") / F.col("weight"), "src", F.col("_level").alias("at")))).over(everything)["at"])
    )
    capped = (F.col("source_size") * cap).cast("double")
    return per.select(
        "source", "src", "weight", "source_size", "n_docs",
        F.greatest(F.lit(1), F.least(F.ceil(F.sqrt("n_docs")), F.floor(F.lit(BLOCKS) / F.count(F.lit(1)).over(everything)))).cast("long").alias("n_blocks"),
        F.coalesce(F.least(F.col("_level") * F.col("weight"), capped), capped).alias("target"),
    )


def _split(quotas: DataFrame, levels: int) -> DataFrame:
    """(node, src, quota) of the root, split down to the leaves of the tree."""
    for level in range(levels):
        draws = quotas.select("node", "src", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("draw"))
        at = Window.partitionBy("node")
        turn = F.row_number().over(at.orderBy(draw52(F.lit(SEED), F.lit(f"tree{level}"), F.col("node"), F.col("src"), F.col("draw")), "src", "draw"))
        right = (turn * 2 > F.count(F.lit(1)).over(at) + 1).cast("int")
        quotas = draws.select((F.col("node") * 2 + right).alias("node"), "src").groupBy("node", "src").agg(F.count(F.lit(1)).alias("quota"))
    return quotas.select((F.col("node") - 2**levels).alias("shard"), "src", "quota")


def _marks(docs: DataFrame, id_col: str, carry: bool) -> DataFrame:
    """(_id, source, size, _mark) of every row of docs, and with carry ``row``; _mark is the digest of id and text from which all draws of a document come."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    return docs.select(F.col(id_col).alias("_id"), "source", word_count(F.col("text")).alias("size"), digest.alias("_mark"), *row)


def _blocked(rows: DataFrame, about: DataFrame) -> DataFrame:
    """rows (source, _mark) with src and block."""
    block = draw52(F.lit(SEED), F.lit("block"), F.col("_mark")) % F.col("n_blocks")
    return rows.join(about, F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", block).drop("_source", "n_blocks")


def mixture(docs: DataFrame, weights: list[int], share: tuple[int, int] = (3, 2), cap: int = 2, shard_levels: int = 4, id_col: str = "doc_id", carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(plan, sources): plan has every row of docs once, as (id, source, size, src, copies), and with carry a struct ``row`` of all its columns.

    copies lists the shard, pass and order of each time that the mixture takes the document, by pass. ``share`` is the
    mixture's words as a fraction of all words.
    """
    sizes = stored(_marks(docs, id_col, False), "sizes")
    sources = stored(source_targets(sizes, weights, share, cap), "sources")
    n_sources = sources.count()
    about = small(sources.select(F.col("source").alias("_source"), "src", "n_blocks"), n_sources)
    keyed = stored(_blocked(sizes, about), "keyed")
    discard(sizes)
    blocks = stored(keyed.groupBy("src", "block").agg(F.sum("size").alias("words")), "blocks")
    passes = blocks.join(small(sources.select("src", "target", "source_size"), n_sources), "src").select("*", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("pass"))
    in_pass = Window.partitionBy("src", "pass").orderBy(draw52(F.lit(SEED), F.lit("perm"), F.col("src"), F.col("pass"), F.col("block")), "block")
    units = (
        passes.withColumn("_end", F.sum("words").over(in_pass.rowsBetween(Window.unboundedPreceding, 0)) + F.col("pass") * F.col("source_size"))
        .withColumn("_left", F.col("target") - (F.col("_end") - F.col("words")))
        .filter((F.col("_left") > 0) & (F.col("words") > 0))
    )
    in_source = Window.partitionBy("src").orderBy("pass", "_end", "block")
    units = stored(units.select("src", "pass", "block", F.least("_left", F.col("words").cast("double")).alias("room"), "words", F.row_number().over(in_source).alias("rank")), "units")
    # Where a target cuts a block, the documents' hashed order up to which it takes them; one block of a source at most.
    cuts = units.filter("room < words").select("src", "block", "room")
    at = keyed.join(small(cuts, n_sources), ["src", "block"]).groupBy("src", "block", "room", draw52(F.lit(SEED), F.lit("cut"), F.col("_mark")).alias("at")).agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("src", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cut = at.withColumn("_mid", F.sum("size").over(upto) - F.col("size") / 2).filter("_mid <= room").groupBy("src", "block").agg(F.max("at").alias("last"))
    leaves = _split(units.groupBy("src").agg(F.count(F.lit(1)).alias("quota")).select(F.lit(1).alias("node"), "src", "quota"), shard_levels)
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = leaves.withColumn("_from", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    dealt = ranges.select("src", "shard", F.explode(F.sequence((F.col("_from") + 1).cast("int"), (F.col("_from") + F.col("quota")).cast("int"))).alias("rank"))
    whole = F.col("room") >= F.col("words")
    dealt = units.join(dealt, ["src", "rank"]).join(cut, ["src", "block"], "left").withColumn("last", F.when(whole, F.lit(2**53)).otherwise(F.coalesce("last", F.lit(-1))))
    by_block = stored(dealt.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "last"))).alias("units")), "dealt")
    every = _blocked(_marks(docs, id_col, True), about) if carry else keyed
    marked = every.join(small(by_block, by_block.count(), BLOCKS + BROADCAST_ROWS), ["src", "block"], "left").withColumn("_at", draw52(F.lit(SEED), F.lit("cut"), F.col("_mark")))
    taken = F.filter(F.coalesce("units", F.array()), lambda u: F.col("_at") <= u["last"])
    copies = F.transform(taken, lambda u: F.struct(u["shard"].cast("int").alias("shard"), u["pass"].alias("pass"), draw52(F.lit(SEED), F.lit("order"), F.col("_mark"), u["pass"]).alias("order")))
    return marked.select(F.col("_id").alias(id_col), "source", "size", "src", copies.alias("copies"), *["row"] * carry), sources


def mixed_rows(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each copy that the mixture takes: (id, source, size, shard, pass, order), and row if the plan has it."""
    return plan.select(id_col, "source", "size", F.inline("copies"), *["row"] * ("row" in plan.columns))


def in_shards(plan: DataFrame, shard_levels: int = 4) -> DataFrame:
    """The rows of all copies (shard and row) of a plan that carries rows, in order of shard and hashed order across and inside partitions.

    Shards get equal shares of blocks and orders are uniform, so the bounds between partitions are known beforehand: one shuffle, no sampling run.
    """
    rows = mixed_rows(plan).select("shard", "order", "row")
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = (F.col("shard") + F.col("order") / F.lit(float(2**52))) * (parts / 2**shard_levels)
    return rows.repartitionById(parts, F.least(F.floor(at), F.lit(parts - 1)).cast("int")).sortWithinPartitions("shard", "order").select("shard", "row")


def write_shards(plan: DataFrame, path: str) -> None:
    """The mixture's documents, one folder a shard, in its hashed order."""
    name = unused("shard", plan.select("row.*").columns)
    in_shards(plan).select(F.col("shard").alias(name), "row.*").write.partitionBy(name).parquet(path)


WEIGHTS = [3, 1, 2]


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the sizes and targets: the shards of a document's copies, in order of their passes, as the tree deals them."""
    plan, sources = mixture(table(spark, sf_dir, "documents"), WEIGHTS)
    about = sources.select("src", "source_size", "target")
    shards = F.concat_ws(",", F.transform("copies", lambda c: c["shard"].cast("string")))
    return plan.join(small(about, about.count()), "src").select("doc_id", "size", "source_size", "target", (F.size("copies") * F.col("size")).cast("long").alias("taken"), shards.alias("shards"))


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT"


def _tree(levels: int) -> str:
    """SQL for the splitting tree: (shard, src, quota) as the table leaves, from units."""
    out = "l0 AS (SELECT 1 AS node, src, count(*) AS quota FROM units GROUP BY src)"
    for i in range(levels):
        turn = f"row_number() OVER (PARTITION BY node ORDER BY {_draw(str(SEED), f"'tree{i}'", 'node', 'src', 'draw')}, src, draw)"
        out += f""", d{i} AS (SELECT node, src, unnest(range(1, quota + 1)) AS draw FROM l{i}
), l{i + 1} AS (SELECT node, src, count(*) AS quota FROM (SELECT node * 2 + ({turn} * 2 > count(*) OVER (PARTITION BY node) + 1)::INTEGER AS node, src FROM d{i}) GROUP BY ALL)"""
    return f"{out}, leaves AS (SELECT node - {2**levels} AS shard, src, quota FROM l{levels})"


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS mark FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs, greatest(1, least(ceil(sqrt(count(*)))::BIGINT, {BLOCKS} // count(*) OVER ())) AS n_blocks FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM per
), weighed AS (
  SELECT *, CASE src % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM ranked
), summed AS (
  SELECT *, sum(source_size) OVER () * 3 / 2.0::DOUBLE AS words, sum(weight) OVER () AS all_weights,
    coalesce(sum(source_size) OVER (ORDER BY source_size / weight::DOUBLE, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS capped,
    coalesce(sum(weight) OVER (ORDER BY source_size / weight::DOUBLE, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM weighed
), levels AS (
  SELECT *, (words - capped::DOUBLE) / (all_weights - gone)::DOUBLE AS lvl FROM summed
), lev AS (
  SELECT lvl FROM levels WHERE lvl * weight <= source_size * 2 ORDER BY source_size / weight::DOUBLE, src LIMIT 1
), targets AS (
  SELECT source, src, source_size, n_blocks, least(coalesce((SELECT lvl FROM lev) * weight, source_size * 2.0), (source_size * 2)::DOUBLE)::DOUBLE AS target FROM weighed
), keyed AS (
  SELECT doc_id, size, mark, t.*, {_draw(str(SEED), "'block'", "mark")} % n_blocks AS block, {_draw(str(SEED), "'cut'", "mark")} AS place FROM sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source
), blocks AS (
  SELECT src, block, target, source_size, sum(size) AS words FROM keyed GROUP BY ALL
), passes AS (
  SELECT *, sum(words) OVER (PARTITION BY src, pass ORDER BY {_draw(str(SEED), "'perm'", "src", "pass", "block")}, block) + pass * source_size AS ends
  FROM blocks, (VALUES (0), (1)) p(pass)
), units AS (
  SELECT src, pass, block, words, target - (ends - words)::DOUBLE AS room, row_number() OVER (PARTITION BY src ORDER BY pass, ends, block) AS rank
  FROM passes WHERE target - (ends - words)::DOUBLE > 0 AND words > 0
), {_tree(4)}, ranges AS (
  SELECT src, shard, coalesce(sum(quota) OVER (PARTITION BY src ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, quota FROM leaves
), dealt AS (
  SELECT u.*, shard FROM units u JOIN ranges r ON u.src = r.src AND u.rank > first AND u.rank <= first + quota
), mids AS (
  SELECT *, sum(size) OVER (PARTITION BY src, block ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(size) OVER (PARTITION BY src, block, place) / 2 AS mid FROM keyed
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * coalesce(len(shards), 0))::BIGINT AS taken, coalesce(array_to_string(shards, ','), '') AS shards
FROM (SELECT m.*, (SELECT list(shard ORDER BY pass) FROM dealt u WHERE u.src = m.src AND u.block = m.block AND (u.room >= u.words OR m.mid <= u.room)) AS shards FROM mids m)
"""
