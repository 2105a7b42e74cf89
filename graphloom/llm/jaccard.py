"""N-gram Jaccard join by universe partition and the pigeonhole principle, exact.

A document is the set of its word shingles, each a 64-bit hash. Two sets of sizes a and b have a Jaccard
similarity of p % or more exactly if at most D = (100 - p)(a + b) / (100 + p) elements are in one of them
only. Size bands overlap so that every pair that the sizes allow lies inside one band. A band deals
all hashes to m > D segments, so that a set falls into m subsets; two similar sets can't differ in all segments.

A document's allocation says what it indexes in a segment, by what that costs. A subset's cost is the number of
documents that it would meet. Subsets that are empty, or consist of frequent shingles only (boilerplate), meet
crowds: the least document frequencies are counted over all documents with mergeable bounded summaries, and
at most ``FREQUENT`` shingles count as frequent. Which shingles do never changes the result, only the rows.

- a subset with a rare shingle is indexed whole: one row for one unit of the bound;
- any other subset is skipped: no row, no unit;
- a document that lacks units then (it needs D + 1 for the largest partner of its band) buys them by the
  one-deletion neighbourhoods of its subsets with two rare shingles or more: c rows for one unit more each;
- only if units are still lacking, the skipped subsets are indexed, in a space that only such documents use.

If two sets are similar, let x be the one that needs less of this. Its units exceed D, so in some segment the
subsets differ by no more than x allows there. If they are equal there, both index it. If one element is missing
or added in a subset of which x keeps the neighbourhood, at least one rare shingle is common, so the other
document indexes the subset too; and if that document needs no neighbourhoods, the pair is found by its own
allocation. Two documents of the last kind share all segments. m is the least number of segments whose
expected non-empty ones cover the need of a document at the upper end of its band.

Candidates are never written out as all pairs of a key. Keys with the same documents say the same, so only the distinct
sets of documents that share a key are kept, as groups; equal sets of shingles, tied by a 128-bit fingerprint, count as one document
from there on. A group's documents are first tied to the least of them, a row for each. Before sets are compared, a parity bitmap
rules out what it can: each element flips one bit, so the bits in which two bitmaps differ are at most the elements in
which the sets do, and nearly as many. What passes is verified exactly and joined to components. Groups whose documents are
still in several components are then compared in blocks: by bitmap, which leaves the documents that pass with one of another component,
and those by their whole sets; a block gives a spanning forest of the true links across its components, a row for a
document at most. So no link between different texts that would join components is lost, and no pair that isn't a link is
written but one for each document of a group. Groups are compared by themselves; that one document is in several groups ties nothing.

Whole texts are never shuffled: the documents to verify are picked by a broadcast filter of fixed size, their sets made again and
joined by id. A task indexes a set that it meets again only once.

Null and empty texts have the empty set and link with nothing; texts with fewer words than a shingle have
one shingle, all their words. Rows without an id have a set size, no links and no component. Rows that repeat an id are one document
with several sets. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, few, narrowed, runs, slices, stored, table
from .components import components

U = np.uint64
ODD = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
#: Hashed words that a worker remembers.
WORDS_KEPT = 150_000
#: Shingles that may count as frequent, and the documents that such a shingle is in at least.
FREQUENT, LEAST = 4096, 100
#: Documents of a piece of a group; two pieces meet in a block.
BLOCK = 512
#: Rows with whole sets or bitmaps that reach Python at once.
SET_ROWS = 250


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = out
        return out


_WORDS = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * ODD[1]
    x = (x ^ (x >> U(27))) * ODD[2]
    return x ^ (x >> U(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a UTF-8 text; words are lower-cased from A to Z only."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=U)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=U, count=len(words))
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, U(n))
    for i in range(n):
        total = _mixed((total + h[i : len(words) - n + 1 + i]) * ODD[0])
    return np.unique(total)


def max_difference(total: int, percent: int) -> int:
    """The most elements in one set only, of two with so many elements together, that the threshold allows."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(None)
def bands(percent: int, limit: int) -> tuple[tuple[int, int, int], ...]:
    """(least size, greatest size, segments) of bands up to sizes of limit. A pair that sizes allow is inside one."""
    low = 1
    while max_difference(2 * low + 1, percent) < 1:
        low += 1  # smaller sets are similar only if they are equal
    out = []
    while low <= limit:
        high = max(low + 1, low * 17 // 10)
        need = max_difference(2 * high, percent) + 1
        m = need
        while m * (1 - math.exp(-high / m)) < need and m < 2 * need:
            m += 1
        out.append((low, high, max(2, m)))
        # A partner of a size below the next band is at most this large: high covers it.
        low = max(low + 1, high * percent // 100)
    return tuple(out)


def band_numbers(size: int, percent: int) -> list[int]:
    return [k for k, (low, high, _) in enumerate(bands(percent, _rounded(size))) if low <= size <= high]


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bitmap in 64-bit words, twice as many bits as elements at least; every element flips one bit."""
    n_bits = max(256, 1 << (2 * len(hashes)).bit_length())
    flips = np.bincount(((hashes * ODD[1]) >> U(16)).astype(np.int64) & (n_bits - 1), minlength=n_bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, n_words: int) -> np.ndarray:
    """The bitmap that as many fewer bits would have given."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, n_words), axis=0)


def needed_units(size: int, high: int, percent: int) -> int:
    return max_difference(size + min(high, size * 100 // percent), percent) + 1


def keys(hashes: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> np.ndarray:
    """All index keys of a set, by its allocation in each of its bands. frequent: sorted hashes."""
    n = len(hashes)
    rare = np.ones(n, dtype=bool)
    if frequent is not None and len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] != hashes
    out = []
    for number, (low, high, m) in enumerate(bands(percent, _rounded(n))):
        if not low <= n <= high:
            continue
        salt = U(number * 0x1000193 + 1)
        mixed = _mixed(hashes + U(int(salt) * int(ODD[3]) & 2**64 - 1))
        segment = (mixed >> U(33)).astype(np.int64) % m
        order = np.argsort(segment, kind="stable")
        sorted_segments = segment[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_segments[1:] != sorted_segments[:-1]]))
        parts = sorted_segments[starts]
        value = _mixed(mixed * ODD[0])[order]
        sums = np.add.reduceat(value, starts)
        n_rare = np.add.reduceat(rare[order].astype(np.int64), starts)
        space = _mixed(parts.astype(U) * ODD[1] + salt)
        whole = _mixed(sums ^ space)
        keep = n_rare >= 1
        out.append(whole[keep])
        short = needed_units(n, high, percent) - int(keep.sum())
        if short > 0:
            sizes = np.diff(np.concatenate([starts, [n]]))
            again = np.repeat(np.arange(len(parts)), sizes)
            bought = n_rare[again] >= 2
            out.append(_mixed((sums[again] - value)[bought] ^ space[again][bought]))
            if short > int((n_rare >= 2).sum()):
                empty = np.setdiff1d(np.arange(m), parts)
                out.append(_mixed(whole[~keep] + ODD[3]))
                out.append(_mixed(_mixed(empty.astype(U) * ODD[2] + salt) ^ ODD[3]))
    return np.concatenate(out) if out else np.empty(0, dtype=U)


class Summary:
    """Lower bounds of the document frequencies of the commonest hashes, in bounded memory (Misra-Gries, in batches)."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.hashes, self.counts = np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.n_waiting += len(hashes)
        if self.n_waiting > 400_000:
            self.settle()

    def settle(self) -> None:
        new, counts = np.unique(np.concatenate([self.hashes[:0], *self.waiting]), return_counts=True)
        both, where = np.unique(np.concatenate([self.hashes, new]), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([self.counts, counts]), minlength=len(both)).astype(np.int64)
        if len(both) > self.size:
            total -= np.partition(total, len(total) - self.size - 1)[len(total) - self.size - 1]
        left = total > 0
        self.hashes, self.counts, self.waiting, self.n_waiting = both[left], total[left], [], 0


def _rounded(n: int) -> int:
    return 1 << max(4, n.bit_length())


def _ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def sets(texts: DataFrame, width: int, hashes: bool = False) -> DataFrame:
    """(id, n, print, bits) of every row of texts (id, text as binary): set size, 128-bit fingerprint and bitmap, null for the empty set; or (id, hashes).

    With fingerprints, each task adds a row of n -1 whose print packs its summary of frequent shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(FREQUENT)
        for rows in slices(batches):
            found = (shingles(t.as_py(), width) for t in rows.column(1))
            if hashes:
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["id", "hashes"])
            else:
                both = []
                for h in found:
                    summary.add(h)
                    both.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), parity(h).tobytes()) if len(h) else (0, None, None))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([b[i] for b in both], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary())))], names=["id", "n", "print", "bits"])
        _WORDS.clear()  # a worker waits for its next task with little memory
        if not hashes:
            summary.settle()
            packed = np.stack([summary.hashes.view(np.int64), summary.counts]).T.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([packed], pa.binary()), pa.array([None], pa.binary())], names=["id", "n", "print", "bits"])

    return texts.mapInArrow(run, "id bigint, hashes array<bigint>" if hashes else "id bigint, n bigint, print binary, bits binary")


def frequent_shingles(about: DataFrame) -> np.ndarray:
    """The hashes, sorted, that most documents have: FREQUENT at most, each in LEAST documents at least."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for one in rows.column(0).to_pylist():
                both = np.frombuffer(one, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["hash", "n"])

    rows = about.filter("n = -1").select("print").mapInArrow(unpack, "hash bigint, n bigint")
    top = rows.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()
    return np.sort(np.array([r["hash"] for r in top], dtype=np.int64).view(U))


def index_rows(texts: DataFrame, width: int, percent: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(key, id) rows of all documents' allocations, for texts (id, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for rows in slices(batches):
            ids, found, total = [], [], 0
            for own, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                h = shingles(text.as_py(), width)
                mark = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                if mark in seen:
                    continue
                seen.add(mark)
                k = keys(h, percent, frequent)
                if len(k):
                    ids.append(np.full(len(k), own, dtype=np.int64))
                    found.append(k)
                    total += len(k)
                if total > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "id"])
                    ids, found, total = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "id"])
        _WORDS.clear()

    return texts.filter("id IS NOT NULL").mapInArrow(run, "key bigint, id bigint")


def shared_groups(rows: DataFrame) -> DataFrame:
    """(g1, g2, id): the distinct sets of two ids or more that share a key in rows (key, id), each named by 128 bits of a digest."""
    by_key = Window.partitionBy("key")
    shared = rows.withColumn("least", F.min("id").over(by_key)).withColumn("most", F.max("id").over(by_key)).filter("least < most")
    halves = [f(F.xxhash64("id", F.lit(k))) for k in (1, 2) for f in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(0xFFFFFFFF))]
    digest = [F.col("least"), F.col("most"), F.count(F.lit(1)).over(by_key), *[F.sum(h).over(by_key) for h in halves]]
    digest = shared.select("id", *[d.alias(f"d{i}") for i, d in enumerate(digest)])
    names = [f"d{i}" for i in range(7)]
    return digest.select(F.xxhash64(*names).alias("g1"), F.xxhash64(F.lit(1), *reversed(names)).alias("g2"), "id").distinct()


def _passing(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (u, v) that sizes and bitmaps allow."""
    a = about.select(F.col("id").alias("u"), F.col("n").alias("_na"), F.col("bits").alias("_a"))
    b = about.select(F.col("id").alias("v"), F.col("n").alias("_nb"), F.col("bits").alias("_b"))
    fit = (F.col("_na") * 100 >= F.col("_nb") * percent) & (F.col("_nb") * 100 >= F.col("_na") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 2048):
            keep = []
            for na, x, nb, y in zip(*(rows.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U)
                words = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= max_difference(na + nb, percent))
            yield rows.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.distinct().join(a, "u").join(b, "v").filter(fit).select("u", "v", "_na", "_a", "_nb", "_b")
    return both.mapInArrow(run, "u bigint, v bigint").distinct()


def _known(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(id, hashes) of the documents of ids (id), and by chance of some others, made again from their texts."""
    with few(texts.sparkSession):
        return stored(sets(narrowed(texts, "id", ids), width, hashes=True), "hashes")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) that are similar, by their whole sets."""
    with few(texts.sparkSession):
        pairs = stored(pairs, "pairs")
    known = _known(pairs.select(F.explode(F.array("u", "v")).alias("id")), texts, width)
    a = known.select(F.col("id").alias("u"), F.col("hashes").alias("_a"))
    b = known.select(F.col("id").alias("v"), F.col("hashes").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    total = F.size("_a") + F.size("_b")
    both = pairs.join(a, "u").join(b, "v").withColumn("_common", common)
    out = stored(both.filter((total > 0) & (F.col("_common") * 100 >= (total - F.col("_common")) * percent)).select("u", "v"), "links")
    discard(known)
    discard(pairs)
    return out


def _across(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, bits: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, bits in which they differ) of the pairs of a block, in different components, that pass."""
    some = []
    for at in range(0, len(ids), 256):
        part = slice(at, at + 256)
        apart = np.zeros((len(ids[part]), len(ids)), dtype=np.int64)
        for w in range(bits.shape[1]):
            apart += np.bitwise_count(bits[part, w, None] ^ bits[None, :, w])
        ok = apart <= (100 - percent) * (sizes[part, None] + sizes[None, :]) // (100 + percent)
        ok &= (sizes[part, None] * 100 >= sizes[None, :] * percent) & (sizes[None, :] * 100 >= sizes[part, None] * percent)
        ok &= (ids[part, None] > ids[None, :]) & (comps[part, None] != comps[None, :])
        if side[0] >= 0:
            ok &= side[part, None] != side[None, :]
        i, j = np.nonzero(ok)
        some.append((i + at, j, apart[i, j]))
    return tuple(np.concatenate([s[k] for s in some]) for k in range(3))


def _forest(comps: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray, hashes: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs are links that span what all links would join; the likeliest are tried first, and none inside what is joined."""
    root = {int(c): int(c) for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    taken = []
    for k in np.argsort(apart, kind="stable"):
        a, b = find(int(comps[i[k]])), find(int(comps[j[k]]))
        if a != b:
            x, y = hashes[i[k]], hashes[j[k]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common * 100 >= percent * (len(x) + len(y) - common):
                root[max(a, b)] = min(a, b)
                taken.append(k)
    return np.array(taken, dtype=np.int64)


PLACE = ["g1", "g2", "a", "b"]


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows, dealt by block and sorted so that a block's rows stand together."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *PLACE).sortWithinPartitions(*PLACE)


def _links_across(at: DataFrame, about: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): for groups at (g1, g2, id, comp), links that join what all links across components would join."""
    spark = at.sparkSession
    several = at.groupBy("g1", "g2").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("pieces")).filter("_lo < _hi").drop("_lo", "_hi")
    placed = at.join(several, ["g1", "g2"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    side = F.when(F.col("piece") == F.col("other"), -1).when(F.col("piece") < F.col("other"), 0).otherwise(1)
    met = met.select("g1", "g2", F.least("piece", "other").alias("a"), F.greatest("piece", "other").alias("b"), side.alias("side"), "id", "comp")

    def by_bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 4):
            side, ids, comps, sizes = (group.column(i).to_numpy() for i in range(4, 8))
            maps = [np.frombuffer(x, dtype=U) for x in group.column(8).to_pylist()]
            words = min(map(len, maps))
            i, j, _ = _across(ids, comps, sizes, np.array([folded(x, words) for x in maps]), side, percent)
            yield group.select(range(7)).take(pa.array(np.unique(np.concatenate([i, j]))))

    def by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 4):
            side, ids, comps = (group.column(i).to_numpy() for i in range(4, 7))
            lists = group.column(7)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(U)
            hashes = [flat[s:e] for s, e in zip(ends, ends[1:])]
            maps = [parity(h) for h in hashes]
            words = min(map(len, maps))
            i, j, apart = _across(ids, comps, np.array([len(h) for h in hashes]), np.array([folded(x, words) for x in maps]), side, percent)
            take = _forest(comps, i, j, apart, hashes, percent)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[take]], pa.int64()), pa.array(ids[j[take]], pa.int64())], names=["u", "v"])

    row = "g1 bigint, g2 bigint, a int, b int, side int, id bigint, comp bigint"
    rows = _in_blocks(met.join(about.select("id", "n", "bits"), "id").select(*PLACE, "side", "id", "comp", "n", "bits"))
    with few(spark, SET_ROWS):
        passed = stored(rows.mapInArrow(by_bitmap, row), "passed")
    known = _known(passed.select("id"), texts, width)
    rows = _in_blocks(passed.join(known, "id").select(*PLACE, "side", "id", "comp", "hashes"))
    with few(spark, SET_ROWS):
        out = stored(rows.mapInArrow(by_set, "u bigint, v bigint").distinct(), "links")
    discard(known)
    discard(passed)
    return out


def near_groups(df: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of df: the components of all pairs with p % or more.

    The pairs themselves, and how many a document has, are not found: those inside a component are skipped.
    """
    spark = df.sparkSession
    texts = _ids(df, id_col, text_col)
    with few(spark):
        both = stored(sets(texts, width), "sets")
    frequent = frequent_shingles(both)
    about = both.filter("n >= 0")
    full = about.filter("print IS NOT NULL AND id IS NOT NULL")
    # Stored before it is joined, so that the planner can split a fingerprint that very many documents have.
    firsts = stored(full.groupBy("print").agg(F.min("id").alias("v"), F.max("id").alias("_most")).filter("v < _most").select("print", "v"), "firsts")
    ties = stored(full.select("print", "id").join(firsts, "print").filter("id <> v").select(F.col("id").alias("u"), "v").distinct(), "ties")
    with few(spark):
        named = stored(shared_groups(index_rows(texts, width, percent, frequent)), "groups")
    # An id that also has another set keeps its own name in the groups.
    of = full.select(F.col("id").alias("u"), "print").join(ties, "u").groupBy("u", "v").agg(F.min("print").alias("_lo"), F.max("print").alias("_hi")).filter("_lo = _hi").select("u", "v")
    groups = stored(named.join(of, named["id"] == of["u"], "left").select("g1", "g2", F.coalesce("v", "id").alias("id")).distinct(), "groups")
    discard(named)
    near = stored(narrowed(full.select("id", "n", "bits"), "id", groups.select("id")).dropDuplicates(["id", "bits"]), "near")
    least = groups.groupBy("g1", "g2").agg(F.min("id").alias("v"))
    stars = groups.join(least, ["g1", "g2"]).filter("id <> v").select(F.col("id").alias("u"), "v")
    links = _verified(_passing(stars, near, percent), texts, width, percent)
    comp = components(links)
    at = groups.join(comp, "id", "left").select("g1", "g2", "id", F.coalesce("component_id", "id").alias("comp"))
    more = _links_across(at, near, texts, width, percent)
    comp = components(ties.unionByName(links).unionByName(more))
    out = about.join(comp, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), 4, 85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
), comp AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN comp USING (doc_id)
"""
