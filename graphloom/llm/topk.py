"""Exact top-k inner-product search with a bit-sliced index.

Every component becomes an integer, floor(``scale`` * x). Rows form blocks, and a block's index holds, for
each attribute, the bits of its (offset, so non-negative) values as bitmaps over the block's rows: slice j has
bit j of all rows. A query's scores are added up in bitmap arithmetic: attribute d times weight q_d is the
attribute's slices shifted by each digit of q_d, written with the fewest digits -1, 0 and 1 (complemented slices
for -1, which differs from the true product by a constant of the query), and all those slices of one significance are summed with
carry-save adders, three bitmaps in, one sum and one carry out. The top k rows are then picked from the most
significant score slice down: rows that are certainly in, rows still tied, until the tied rows fit; rows of one
score at the border are resolved by the smaller id. So results are exact, ties included.

Blocks hold about BLOCK rows of one vector length. A block and the query batches of that length go to one task, the block
first, so its index is built once and then meets batch after batch; a batch is a few dozen kilobytes, so copying batches to
blocks moves far less than blocks to batches would. A block gives k rows for each query at most, and a query's k best
of those are kept, so what is shuffled afterwards grows with blocks times queries, never with pairs.

Integers are as wide as components make them: values are kept as whole doubles, which floor(scale * x) always is. Rows
with a value of WIDE or more don't fit the slices' words and are scored by exact Python integers, against every query; a query
with such a value is scored so against every row. A score among the k best that is no 64-bit integer is an
error, as is a component that overflows a double when it is scaled.

Vectors that are null or hold a null or non-finite component, empty vectors and rows without an id take no part, as query or
candidate. Each vector length is searched apart. Fewer than k candidates give fewer rows. Rows that repeat an id are candidates of
one another's query only by their id: a query never meets rows of its own id; several queries of one id share its k rows. An empty table gives an empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, few, stored, table

BLOCK, QUERY_BATCH = 16_384, 128
#: Components of a vector up to which a block or batch holds so many rows; of longer ones it holds as many bytes.
LENGTH = 64
WORD = 64
#: Values that slices don't hold, and the greatest score.
WIDE, LONG = 2.0**61, 2**63 - 1
#: Blocks (8 MB each at 64 components) or batches that reach Python at once.
ROWS = 8


def usable(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is whole and finite."""
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter(F.col(vec_col).isNotNull() & good & (F.size(vec_col) > 0))


def quantised(vectors: DataFrame, scale: float, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """(id, v): v has floor(scale * x) for each component x, as a whole double, which is exact at every size."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        floor = F.when(F.abs(y) < 2.0**52, F.floor(F.greatest(F.least(y, F.lit(2.0**52)), F.lit(-(2.0**52)))).cast("double")).otherwise(y)
        return F.when(F.abs(y) == float("inf"), F.raise_error(F.lit("a component is too large to be scaled")).cast("double")).otherwise(floor)

    rows = usable(vectors, vec_col).filter(F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, whole).alias("v"))


class SlicedBlock:
    """The bit-sliced index of a block's rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:  # values: int64, below WIDE
        order = np.argsort(ids, kind="stable")  # ties then go to the first row
        self.ids, values = ids[order], values[order]
        self.n, self.dims = values.shape
        self.low = values.min(axis=0)
        shifted = (values - self.low).astype(np.uint64)
        self.bits = max(1, int(shifted.max()).bit_length())
        pad = -self.n % WORD
        self.words = (self.n + pad) // WORD
        slices = np.zeros((self.dims, self.bits, self.words), dtype=np.uint64)
        for j in range(self.bits):
            bit = ((shifted >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)
            bit = np.pad(bit, ((0, pad), (0, 0)))
            slices[:, j] = np.packbits(np.ascontiguousarray(bit.T), axis=1, bitorder="little").view(np.uint64)
        self.all = np.full(self.words, ~np.uint64(0))
        if pad:
            self.all[-1] = np.uint64((1 << (WORD - pad)) - 1)
        self.flat = np.concatenate([slices, ~slices & self.all]).reshape(-1, self.words)

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """(score slices, from the least significant, and the constant to add): exact inner products."""
        constant = int(query.astype(object) @ self.low.astype(object))
        top = (1 << self.bits) - 1
        by_digit = []  # for each digit's place, where the lowest slices start that it adds
        rest = query.astype(np.int64).copy()
        while rest.any():
            digit = np.where(rest & 1, 2 - (rest & 3), 0)  # of the form with fewest digits -1, 0, 1
            rest = (rest - digit) >> 1
            constant -= top * int((digit < 0).sum()) << len(by_digit)
            by_digit.append(np.concatenate([np.flatnonzero(digit > 0), np.flatnonzero(digit < 0) + self.dims]) * self.bits)
        out = []
        carry = np.empty((0, self.words), dtype=np.uint64)
        place = 0
        while place < len(by_digit) + self.bits - 1 or len(carry):
            wanted = [by_digit[b] + (place - b) for b in range(max(0, place - self.bits + 1), min(place + 1, len(by_digit)))]
            place += 1
            stack = np.concatenate([self.flat[np.concatenate(wanted)], carry]) if wanted else carry
            carries = []
            while len(stack) > 2:
                third = len(stack) // 3
                x, y, z = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                both = x ^ y
                carries.append(x & y | both & z)
                both ^= z
                stack = np.concatenate([both, stack[3 * third :]]) if len(stack) > 3 * third else both
            if len(stack) == 2:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(self.words, dtype=np.uint64))
            carry = np.concatenate(carries) if carries else np.empty((0, self.words), dtype=np.uint64)
        while len(out) > 1 and not out[-1].any():
            out.pop()
        return np.array(out), constant

    def top(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k rows of the greatest score but the query's own, ties to the smaller id; in no order."""
        slices, constant = self.scores(query)
        tied = self.all.copy()
        first, last = np.searchsorted(self.ids, [query_id, query_id + 1])
        for row in range(first, last):
            tied[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sure = np.zeros(self.words, dtype=np.uint64)
        n_sure = 0
        for s in slices[::-1]:
            ones = tied & s
            n = n_sure + int(np.bitwise_count(ones).sum())
            if n > k:
                tied = ones
            else:
                sure |= ones
                n_sure = n
                tied = tied & ~s
            if n_sure == k:
                break
        rows = self._rows(sure)
        if n_sure < k:
            rows = np.concatenate([rows, self._rows(tied)[: k - n_sure]])
        values = [sum(int(slices[j][r >> 6] >> np.uint64(r & 63)) % 2 << j for j in range(len(slices))) + constant for r in map(int, rows)]
        return list(zip(self.ids[rows].tolist(), values, strict=True))

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
        w, b = np.nonzero(bits)
        return words[w] * 64 + b


class Block:
    """A block's rows: those whose values fit the slices, and the few that are wider."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        wide = (np.abs(values) >= WIDE).any(axis=1)
        self.ids, self.values, self.wide = ids, values, np.flatnonzero(wide)
        self.sliced = SlicedBlock(ids[~wide], values[~wide].astype(np.int64)) if not wide.all() else None

    def top(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows; scores are Python integers, exact."""
        exact = self.wide
        best = []
        if (np.abs(query) >= WIDE).any():
            exact = range(len(self.ids))
        elif self.sliced:
            best = self.sliced.top(query.astype(np.int64), query_id, k)
        whole = [int(q) for q in query] if len(exact) else []
        best += [(int(self.ids[r]), sum(a * int(b) for a, b in zip(whole, self.values[r], strict=True))) for r in exact if self.ids[r] != query_id]
        return sorted(best, key=lambda p: (-p[1], p[0]))[:k] if len(exact) else best


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """(d, number, numbers, ids, vals): about size rows of length d in each number of 0 to numbers - 1, fewer if they are longer than LENGTH; values are doubles in one binary.

    Rows are dealt by a hash of what they hold and of where they stand, so copies and repeated ids spread over all numbers.
    """
    numbers = vectors.groupBy(F.size("v").alias("_d")).agg(F.ceil(F.count(F.lit(1)) * F.greatest(F.lit(1.0), F.first(F.size("v")) / F.lit(LENGTH)) / size).cast("int").alias("numbers"))

    def pack(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        flat = rows.column("v").combine_chunks().flatten().to_numpy()
        first = rows.slice(0, 1)
        return pa.Table.from_arrays([first.column("d"), first.column("number"), first.column("numbers"), pa.array([ids.astype("<i8").tobytes()]), pa.array([flat.astype("<f8").tobytes()])], names=["d", "number", "numbers", "ids", "vals"])

    rows = vectors.withColumn("d", F.size("v")).join(numbers, F.col("d") == F.col("_d")).drop("_d")
    rows = rows.withColumn("number", F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.col("numbers")).cast("int"))
    return rows.select("d", "number", "numbers", "id", "v").groupBy("d", "number").applyInArrow(pack, "d int, number int, numbers int, ids binary, vals binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, index: type[Block] = Block) -> DataFrame:
    """(query_id, rank, vec_id, score) for quantised vectors and queries (id, v); index(ids, values) is made once for each block."""
    blocks = stored(_packed(vectors, block), "blocks")
    batches = _packed(queries, QUERY_BATCH).select("d", "ids", "vals")
    numbers = blocks.groupBy("d").agg(F.max("numbers").alias("numbers"))
    met = batches.join(numbers, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("numbers") - 1)).alias("number"), F.lit(True).alias("asks"), "ids", "vals")
    rows = blocks.select("d", "number", F.lit(False).alias("asks"), "ids", "vals").unionByName(met)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "d", "number").sortWithinPartitions("d", "number", "asks")

    def search(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in found:
            for at in range(batch.num_rows):
                d, _, asks, ids, vals = (batch.column(i)[at].as_py() for i in range(5))
                who, values = np.frombuffer(ids, "<i8"), np.frombuffer(vals, "<f8").reshape(-1, d)
                if not asks:
                    held = index(who, values)
                    continue
                out = [(int(q), i, s) for q, v in zip(who, values, strict=True) for i, s in held.top(v, int(q), k)]
                # A score may be too wide here and still not be among the k best of all; then it isn't needed as a number.
                texts = [str(s) for _, _, s in out]
                yield pa.RecordBatch.from_arrays([*(pa.array([o[c] for o in out], pa.int64()) for c in range(2)), pa.array([max(-LONG - 1, min(LONG, o[2])) for o in out], pa.int64()), pa.array([t if abs(o[2]) > LONG else None for o, t in zip(out, texts, strict=True)], pa.string())], names=["query_id", "vec_id", "score", "wide"])

    with few(vectors.sparkSession, ROWS):
        found = stored(rows.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint, wide string"), "found")
    discard(blocks)
    # Scores that are clamped to one number tie there; a clamped one among the k best is an error whatever its place.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    score = F.when(F.col("wide").isNull(), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("no 64-bit integer: the score "), F.col("wide"))).cast("long"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"), 1024.0, "vec_id")
    return top_k(vectors, vectors.filter("id % 100 = 0"), 10)


ORACLE_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
