"""Embedding near-dedup with a pivot-permutation index.

Equal vectors are one entry of the index, with their number and least id; a 128-bit digest tells them. Pivots are entries
themselves, spread out by farthest-first choice from a bounded sample; their number grows with the square root of the entries' number,
so lists stay short, up to PIVOTS. Every entry is described by its nearest pivots in order, the head of its permutation of pivots. Two
entries become candidates if the heads share at least SHARED pivots. That count is found through inverted
lists: a list for each set of SHARED pivots holds the entries whose heads contain it, so entries meet in some
list exactly if they share that many.

Lists hold descriptions only: the head, and a signature of the sides of random planes that the vector is on. Each list is
looked through in blocks; a list longer than BLOCK entries is cut, and every two pieces meet in a block of their own, so no task holds
a long list. A pair belongs to one of the lists that it meets in, that of the least pivots shared. Entries that have there a partner whose
signature differs in few enough bits (all but one in a billion pairs at the threshold do) go on with their whole vectors, and are
verified by matrix products in double precision. So a vector is shipped for the lists that its candidates belong to, not for all of its lists. A block
gives a row for each entry with a link, (vectors linked here, least entry linked here directly or through others); pairs are never
written out. Components come from those rows.

The index misses links whose entries share fewer pivots; recall is measured in the tests and in the README.
No pair below the threshold is linked. Vectors that are null, zero, empty, or hold a null or non-finite component, and vectors without an id,
link with nothing and are their own component. Vectors of different lengths link with nothing; each length has pivots of its own. Every row is a
vector of its own, rows that repeat an id too; a component is named by its least id. Other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, few, maybe_in, runs, stored, table
from .components import components
from .topk import usable

SAMPLE, PIVOTS, SHARED, BLOCK = 4096, 4096, 2, 512
#: Planes of a signature; a multiple of 32.
PLANES = 192


def n_pivots(n: int) -> int:
    return min(PIVOTS, max(64, math.isqrt(n)))


def prefix_of(pivots: int) -> int:
    """How many pivots a head has: more pivots are nearer to one another in rank, so a longer head keeps the recall."""
    return 6 if pivots <= 512 else 7 if pivots <= 2048 else 8


def units(x: np.ndarray) -> np.ndarray:
    """The rows' unit vectors; scaled by their greatest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(entries: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors from a sample of at most so many entries of one length, each farthest from those chosen before."""
    rows = entries.orderBy(F.xxhash64("h1", "h2"), "h1").limit(sample).select("v").collect()
    x = units(np.array([r["v"] for r in rows], dtype=float))
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        nxt = int(np.argmin(nearest))
        if nearest[nxt] > 0.9:
            break
        chosen.append(nxt)
        nearest = np.maximum(nearest, x @ x[nxt])
    return x[chosen]


def _heads(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first."""
    near = -(x @ pivots.T)
    some = np.argpartition(near, min(prefix, near.shape[1]) - 1, axis=1)[:, :prefix]
    order = np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1).astype(np.int32)


def signatures(x: np.ndarray) -> np.ndarray:
    """A bit for each of PLANES random planes: on which side of it a row is. As unsigned 32-bit integers."""
    planes = np.random.default_rng(x.shape[1]).normal(size=(x.shape[1], PLANES))
    return np.packbits(x @ planes >= 0, axis=1).view("<u4")


def bits_apart(threshold: float) -> int:
    """Differing signature bits that a pair at the threshold stays within, but for one in a billion."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(PLANES * p + 6 * math.sqrt(PLANES * p * (1 - p)))


def postings(entries: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(list, entry, about): a row for each list that an entry is in; about has the signature and the sorted head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 1024):
                part = rows.slice(at, 1024)
                lengths = part.column(1).value_lengths().to_numpy()
                for d in np.unique(lengths):
                    if int(d) not in pivots:
                        continue
                    of = part.filter(pa.array(lengths == d))
                    own = pivots[int(d)]
                    x = units(of.column(1).flatten().to_numpy().astype(float).reshape(of.num_rows, -1))
                    heads = np.sort(_heads(x, own, prefix_of(len(own))), axis=1)
                    sets = np.array(list(itertools.combinations(range(heads.shape[1]), min(SHARED, heads.shape[1]))))
                    numbers = np.full((len(x), len(sets)), int(d), dtype=np.int64)
                    for j in range(SHARED):
                        numbers = numbers * 65_536 + heads[:, sets[:, min(j, sets.shape[1] - 1)]]
                    about = np.concatenate([signatures(x).view(np.uint8), heads.astype("<u2").view(np.uint8).reshape(len(x), -1)], axis=1)
                    width = about.shape[1]
                    packed = about.tobytes()
                    again = np.repeat(np.arange(len(x)), len(sets))
                    all_about = pa.array([packed[i * width : (i + 1) * width] for i in range(len(x))], pa.binary()).take(pa.array(again))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers.ravel()), of.column(0).take(pa.array(again)), all_about], names=["list", "entry", "about"])

    return entries.select("entry", "v").mapInArrow(run, "list bigint, entry bigint, about binary")


def _least_shared(heads: np.ndarray, number: int) -> np.ndarray:
    """Whether the list of that number is the one that a pair belongs to, for every two rows.

    The pivots of the list are shared by all; a pair belongs to it if no other shared pivot is below its last.
    """
    own = [number >> 16 * j & 0xFFFF for j in range(SHARED)]
    below = [p for p in np.unique(heads) if p < max(own) and p not in own]
    if not below:
        return np.ones((len(heads), len(heads)), dtype=bool)
    has = (heads[:, :, None] == np.array(below)[None, None, :]).any(axis=1).astype(np.float32)
    return has @ has.T == 0


def _pairs(side: np.ndarray, heads: np.ndarray, number: int) -> np.ndarray:
    """Which pairs of rows a block is for: not a row with itself, of two pieces only across, and only those that belong to its list."""
    mine = _least_shared(heads, number)
    np.fill_diagonal(mine, False)
    if side[0] >= 0:
        mine &= side[:, None] != side[None, :]
    return mine


def _about(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, heads) of a block's rows, whose column 4 is about."""
    raw = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint8).reshape(group.num_rows, -1)
    return raw[:, : PLANES // 8].copy().view("<u4"), raw[:, PLANES // 8 :].copy().view("<u2").astype(np.int64)


def _labels(entries: np.ndarray, link: np.ndarray) -> np.ndarray:
    """The least entry that each row reaches by links."""
    labels = entries.copy()
    while True:
        lower = np.minimum(labels, np.where(link, labels[None, :], np.iinfo(np.int64).max).min(axis=1))
        if np.array_equal(lower, labels):
            return labels
        labels = lower


def linked(entries: DataFrame, pivots: dict[int, np.ndarray], threshold: float, block: int) -> DataFrame:
    """(entry, links, label) rows of all blocks: vectors linked, and the least entry reached, inside one block each."""
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = bits_apart(threshold)

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "list", "pieces").sortWithinPartitions("list", "pieces")

    lists = postings(entries, pivots)
    long = stored(lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "long")
    placed = lists.join(long, "list", "left").withColumn("k", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")).withColumn("piece", F.pmod(F.xxhash64("entry"), F.col("k")).cast("int"))
    # A row of piece p of k meets the pieces q of its list in the blocks (min(p, q), max(p, q)); (p, p) is its own.
    met = placed.select("list", "entry", "about", "piece", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    pair = F.least("piece", "other").cast("long") * 2**31 + F.greatest("piece", "other")
    side = F.when(F.col("piece") == F.col("other"), -1).otherwise((F.col("piece") > F.col("other")).cast("int"))
    met = met.select("list", pair.alias("pieces"), side.alias("side"), "entry", "about")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for group in runs(batches, 2):
            if group.num_rows == 1:
                continue
            marks, heads = _about(group)
            near = sum(np.bitwise_count(marks[:, None, j] ^ marks[None, :, j]).astype(np.int16) for j in range(marks.shape[1])) <= most
            np.fill_diagonal(near, False)
            some = np.flatnonzero(near.any(axis=1))
            if some.size:
                near = near[np.ix_(some, some)] & _pairs(group.column(2).to_numpy()[some], heads[some], group.column(0)[0].as_py())
                held.append(group.take(pa.array(some[near.any(axis=1)])))
                if len(held) > 500:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    row = "list bigint, pieces bigint, side int, entry bigint, about binary"
    near = stored(in_blocks(met).mapInArrow(candidates, row), "candidates")
    rows = in_blocks(near.join(entries.select("entry", "v", "w"), "entry").select("list", "pieces", "side", "entry", "about", "v", "w"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 2):
            x = units(group.column(5).flatten().to_numpy().astype(float).reshape(group.num_rows, -1))
            link = x @ x.T >= threshold
            link &= _pairs(group.column(2).to_numpy(), _about(group)[1], group.column(0)[0].as_py())
            some = np.flatnonzero(link.any(axis=1))
            if some.size:
                link = link[np.ix_(some, some)]
                own, w = group.column(3).to_numpy()[some], group.column(6).to_numpy()[some]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(link @ w, pa.int64()), pa.array(_labels(own, link))], names=["entry", "links", "label"])

    with few(spark, 2000):
        out = stored(rows.mapInArrow(verified, "entry bigint, links bigint, label bigint"), "links")
    discard(near)
    return out


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of df."""
    good = usable(df.filter(F.col(id_col).isNotNull()), vec_col).filter(F.exists(vec_col, lambda x: x != 0))
    digest = [F.xxhash64(F.col(vec_col), F.lit(k)).alias(f"h{k}") for k in (1, 2)]
    rows = good.select(F.col(id_col).cast("long").alias("id"), *digest, F.col(vec_col).alias("v"))
    copies = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("w")).filter("w > 1").select(F.col("h1").alias("id"))
    # Only vectors that may have copies are grouped by shuffle.
    marked = maybe_in(rows, "h1", stored(copies, "copies"))
    lone = marked.filter("NOT _maybe").select("h1", "h2", "v", F.col("id").alias("low"), F.lit(1).cast("long").alias("w"))
    tied = marked.filter("_maybe").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("low"), F.count(F.lit(1)).alias("w")).select("h1", "h2", "v", "low", "w")
    entries = stored(lone.unionByName(tied).withColumn("entry", F.monotonically_increasing_id()), "entries")
    counts = {r["d"]: r["count"] for r in entries.groupBy(F.size("v").alias("d")).count().filter("count > 1").collect()}
    pivots = {d: choose_pivots(entries.filter(F.size("v") == d), n_pivots(n)) for d, n in sorted(counts.items())}
    found = linked(entries, pivots, threshold, BLOCK if block is None else block)
    links = found.groupBy("entry").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("entry").alias("u"), F.col("label").alias("v")))
    whole = entries.select("entry", "h1", "h2", "low", "w").join(links, "entry", "left").join(comp.withColumnRenamed("id", "entry"), "entry", "left")
    whole = whole.filter("links IS NOT NULL OR w > 1").select("h1", "h2", "low", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component_id", "entry").alias("c"))
    whole = stored(whole, "whole")
    least = whole.groupBy("c").agg(F.min("low").alias("component"))
    results = stored(whole.join(least, "c").select("h1", "h2", "n", "component"), "results")
    keys = df.select(id_col, *[F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(vec_col), F.lit(k))).alias(f"_k{k}") for k in (1, 2)])
    out = keys.join(results, (F.col("_k1") == F.col("h1")) & (F.col("_k2") == F.col("h2")), "left")
    component = F.coalesce("component", F.col(id_col))
    return out.select(id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col(id_col)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
), v AS (
  SELECT r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM e
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT r AS a, r AS b FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), comp AS (
  SELECT reach.a AS r, min(e.vec_id) AS component_id FROM reach JOIN e ON reach.b = e.r GROUP BY reach.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.r) AS n_links, component_id, component_id = e.vec_id AS kept
FROM e JOIN comp USING (r)
"""
