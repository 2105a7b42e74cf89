"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import clear, discard, scratch, stored

__all__ = ["WORD", "clear", "discard", "draw52", "few", "least_hashes", "maybe_in", "narrowed", "row_hash", "runs", "scratch", "short_batches", "slices", "small", "stored", "table", "unused", "within", "word_count"]

#: A word, in the sense of every contract here: a run without ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table may be broadcast; beyond it the planner joins by shuffle.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def word_count(text: Column) -> Column:
    """Words of the whole text as long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw52(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, joined with ':', as long. SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """The groups of equal first columns, one batch each, of rows that are sorted by those (integer) columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)])
        starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(keys[:, s])
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


#: The setting that bounds the rows of a batch.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches that go to Python hold so many rows at most from now on in this session.

    Only operators that return whole texts' scores or tokens lazily call this: their job runs after they
    have returned, and Spark has no narrower place for the setting. It is only ever lowered.
    """
    if not 0 < int(spark.conf.get(BATCH, "10000")) <= rows:
        spark.conf.set(BATCH, str(rows))


@contextmanager
def few(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside, batches that go to Python hold so many rows at most; the caller's setting comes back."""
    before = spark.conf.get(BATCH, None)
    short_batches(spark, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as make it differ from all of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of a row's hash.
HASH_BITS = 53


#: Bits of the filter of ``narrowed``: at most 2 ** (FILTER_BITS - 6) words of 8 bytes, whatever the input's size.
FILTER_BITS = 24


def maybe_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df with a boolean column ``_maybe``: true for every row whose long id occurs in ids (id), and by chance for some others.

    A filter of a bit for each hash value, of fixed size, is formed where the ids are and broadcast. The more ids there are,
    the more other rows pass; nothing but that depends on their number.
    """
    at = lambda c: F.shiftrightunsigned(F.xxhash64(F.col(c).cast("long")), 64 - FILTER_BITS)
    bit = F.expr("shiftleft(1L, cast(_at & 63L as int))")
    words = ids.select(at("id").alias("_at")).select(F.shiftright("_at", 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = df.withColumn("_at", at(column)).withColumn("_here", F.shiftright("_at", 6)).join(F.broadcast(words), F.col("_here") == F.col("_word"), "left")
    return marked.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_at", "_here", "_word", "_bits")


def narrowed(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose long id occurs in ids (id), and by chance some others; df is not shuffled."""
    return maybe_in(df, column, ids).filter("_maybe").drop("_maybe")


def row_hash(*columns: str) -> Column:
    """A hash of HASH_BITS bits, as long: equal rows have equal ones."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - HASH_BITS)


def _map_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def within(limits: Mapping[str | None, int], group: str, h: str) -> Column:
    """Whether a row's hash is within its group's limit."""
    if not limits:
        return F.lit(False)
    limit = F.create_map(*[F.lit(x) for g, b in limits.items() for x in ("" if g is None else f"={g}", b)])
    return F.coalesce(F.col(h) <= F.try_element_at(limit, _map_key(group)), F.lit(False))


def least_hashes(rows: DataFrame, counts: Mapping[str | None, int], quota: int) -> dict[str | None, int]:
    """By group, the hash up to which (inclusive) rows (group, h) belong to its ``quota`` least distinct hashes.

    counts has each group's rows, an upper bound of its distinct ones. Hashes are uniform, so a share of the
    rows that is expected to hold 2 quota + 30 of them holds the least ones; only those reach the driver. A group in which copies
    make that share hold too few is asked again with four times the share.
    """
    out: dict[str | None, int] = {}
    share = {g: min(1.0, (2 * quota + 30) / max(1, n)) for g, n in counts.items()}
    while share:
        below = {g: int(s * 2**HASH_BITS) for g, s in share.items()}
        limit = F.create_map(*[F.lit(x) for g, b in below.items() for x in ("" if g is None else f"={g}", b)])
        found = rows.filter(F.col("h") < F.try_element_at(limit, _map_key("group"))).distinct().collect()
        got: dict[str | None, list[int]] = {g: [] for g in share}
        for r in found:
            got[r["group"]].append(r["h"])
        for g, hashes in got.items():
            if len(hashes) < quota and share[g] < 1:
                share[g] = min(1.0, share[g] * 4)
                continue
            del share[g]
            if hashes:
                out[g] = sorted(hashes)[:quota][-1]
    return out
