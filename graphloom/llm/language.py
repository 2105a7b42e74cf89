"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's letters are lower-cased, everything else counts as a word border, and its one- to three-letter
subwords (borders included at the ends) are hashed into buckets. Every bucket has an embedding; a text is
the average of its subwords' embeddings, and a linear softmax over that average gives the languages. Both
layers are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows, whose
bound is ``LangParams.rows``; each sampled text also gives a few shorter spans, since short texts are harder.
A temperature is then fitted on a calibration part that training doesn't see, and a text is rejected if
its calibrated probability is below a threshold which keeps all but ``reject`` of the right answers there.

Every text is read whole. Null texts and texts without a letter get the language ``und`` with score 0 and
are rejected. Rows without a language are predicted but not learned from. Ties go to the first language in
code-point order. If there is no labelled row at all, every text with a letter is ``und`` with score 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, least_hashes, row_hash, short_batches, slices, table, within

BITS = 14
UNDETERMINED = "und"


def _letter_table() -> np.ndarray:
    """By code point of the basic plane: the code point of a lower-case letter, or 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x10000)], dtype=np.uint64)


_LETTERS = _letter_table()
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of a text, with repeats; empty for a text without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if points.size and points.max() >= 0x10000:
        low = np.minimum(points, 0xFFFF)
        letters = np.where(points < 0x10000, _LETTERS[low], np.where(np.array([chr(p).isalpha() for p in points]), points, 0).astype(np.uint64))
    else:
        letters = _LETTERS[points]
    keep = np.empty(letters.size + 2, dtype=bool)
    padded = np.zeros(letters.size + 2, dtype=np.uint64)
    padded[1:-1] = letters
    keep[0] = True
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)  # one border between words
    c = padded[keep]
    if c.size < 2:
        return np.empty(0, dtype=np.int64)
    inner = c != 0
    with np.errstate(over="ignore"):
        a, b, d = (c * m for m in _MULTIPLIERS)
        one = a[inner]
        two = a[:-1] + b[1:]
        three = (a[:-2] + b[1:-1] + d[2:])[inner[1:-1]] if c.size > 2 else np.empty(0, np.uint64)
        h = np.concatenate([one, two ^ np.uint64(0x5851F42D4C957F2D), three ^ np.uint64(0x14057B7EF767814F)])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text."""
    return np.unique(subwords(text), return_counts=True)


def text_column(keep: list[str]) -> tuple[int, list[Column]]:
    """(where the text is, the columns to read) so that the text travels once."""
    if "text" in keep:
        return keep.index("text"), [F.col(c) for c in keep]
    return len(keep), [*(F.col(c) for c in keep), F.col("text").alias("_whole_text")]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LangParams:
    """rows bounds the labelled rows of the sample, over all languages together."""

    rows: int = 2400
    dims: int = 16
    epochs: int = 12
    rate: float = 0.5
    spans: tuple[int, ...] = (3, 8, 25)
    reject: float = 0.001
    seed: int = 7


@dataclass
class LangModel:
    labels: list[str]
    scores: np.ndarray  # bucket -> logits, the product of both layers
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    stats: dict = field(default_factory=dict)

    def logits(self, text: str) -> np.ndarray:
        ids = subwords(text)
        if not ids.size:
            return self.bias
        return np.bincount(ids, minlength=1 << BITS) @ self.scores / ids.size + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        k = int(np.argmax(p))
        return self.labels[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Bags:
    """Sampled bags of subwords, in flat arrays: bag i has the buckets and counts from starts[i] to starts[i + 1]."""

    lang: list[str]
    turn: np.ndarray
    starts: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, shares) of a bag."""
        part = slice(self.starts[i], self.starts[i + 1])
        return self.buckets[part], self.counts[part] / self.counts[part].sum()


BAG = "lang string, h bigint, part int, buckets array<int>, counts array<int>"


def sample_bags(docs: DataFrame, params: LangParams) -> Bags:
    """Bags of the sampled rows and of their spans: as many rows of each language, those of the least hashes of id and text.

    Rows equal in both count once, so the bound holds for repeated ids and copies too. No language meets in one
    task: the hash up to which a language's rows are taken is found from a counted share of them (``least_hashes``).
    At most ``params.rows`` languages are learned, the commonest.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", row_hash("doc_id", "text").alias("h"), "text")
    counts = {r["lang"]: r["count"] for r in docs.filter("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(params.rows).collect()}
    limits = least_hashes(known.select(F.col("lang").alias("group"), "h"), counts, max(1, params.rows // max(1, len(counts)))) if counts else {}
    chosen = known.filter(within(limits, "lang", "h")).dropDuplicates(["lang", "h"])
    spans, seed = params.spans, params.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            out = {"lang": [], "h": [], "part": [], "buckets": [], "counts": []}
            for lang, h, text in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.split()
                rng = np.random.default_rng([seed, h & 0xFFFFFFFF, h >> 32])
                texts = [text]
                for size in spans:
                    at = int(rng.integers(max(1, len(words) - size)))
                    texts.append(" ".join(words[at : at + size]))
                for part, t in enumerate(texts):
                    buckets, n = bag(t)
                    if buckets.size:
                        for k, v in (("lang", lang), ("h", h), ("part", part), ("buckets", buckets.astype(np.int32)), ("counts", n.astype(np.int32))):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("h", pa.int64()), ("part", pa.int32()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))

    with few(docs.sparkSession):
        got = chosen.mapInArrow(run, BAG).toArrow()
    got = got.sort_by([("lang", "ascending"), ("h", "ascending"), ("part", "ascending")]).combine_chunks()
    lang, h = got.column("lang").to_pylist(), got.column("h").to_numpy()
    first = np.array([i == 0 or lang[i] != lang[i - 1] for i in range(len(lang))], dtype=bool)
    new = first | np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
    row = np.cumsum(new)
    turn = row - np.maximum.accumulate(np.where(first, row, 0)) + 1 if len(h) else row
    flat = [np.concatenate([np.empty(0, np.int32), *(c.flatten().to_numpy() for c in got.column(k).chunks)]) for k in ("buckets", "counts")]
    sizes = np.concatenate([np.empty(0, np.int32), *(c.value_lengths().to_numpy() for c in got.column("buckets").chunks)])
    return Bags(lang, turn, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), *flat)


def fit(bags: Bags, params: LangParams) -> LangModel:
    """Trains on the sampled bags; every fifth sampled row of a language is kept for calibration."""
    labels = sorted(set(bags.lang))
    if not labels:
        return LangModel([], np.zeros((1 << BITS, 0)), np.zeros(0))
    rng = np.random.default_rng(params.seed)
    number = {lang: k for k, lang in enumerate(labels)}
    y = np.array([number[lang] for lang in bags.lang])
    every = np.arange(len(y))
    train = every[bags.turn % 5 != 0] if len(y) >= 20 else every
    held = every[bags.turn % 5 == 0] if (bags.turn % 5 == 0).any() else every
    emb = rng.normal(0, 0.1, (1 << BITS, params.dims))
    out, bias = rng.normal(0, 0.1, (params.dims, len(labels))), np.zeros(len(labels))
    steps, step = params.epochs * len(train), 0
    for _ in range(params.epochs):
        for i in train[rng.permutation(len(train))]:
            buckets, share = bags[i]
            rate = params.rate * (1 - step / steps)
            step += 1
            h = share @ emb[buckets]
            g = _softmax(h @ out + bias)
            g[y[i]] -= 1
            back = out @ g
            out -= rate * np.outer(h, g)
            bias -= rate * 0.1 * g
            emb[buckets] -= (rate * 20) * np.outer(share, back)
    model = LangModel(labels, emb @ out, bias)
    z = np.array([share @ model.scores[b] + bias for b, share in map(bags.__getitem__, held)])
    y = y[held]
    grid = np.geomspace(0.2, 5, 60)
    loss = [-np.mean(np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12)) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    # Never above one half: a text that is likelier than not of its language is kept.
    model.threshold = float(min(0.5, right[int(params.reject * len(right))])) if len(right) else 0.0
    model.stats = {"train": len(train), "held": len(held), "accuracy": float(np.mean(p.argmax(axis=1) == y))}
    return model


def is_held_out(doc_id: Column, of: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; null ids count as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == part


def train(docs: DataFrame, params: LangParams = LangParams()) -> LangModel:
    """A model learned from text and lang of the rows outside the held-out part."""
    return fit(sample_bags(docs.filter(~is_held_out(F.col("doc_id"), 4, 2)), params), params)


def predict(docs: DataFrame, model: LangModel, keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """docs' columns (or those to keep) with the predicted language, its probability and whether it is accepted.

    names are the new columns' names; docs' own columns of those names don't come back, so callers that need
    them give others. One pass over whole texts, no shuffle; the text column is all that a prediction sees.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    text_at, read = text_column(keep)
    short_batches(docs.sparkSession)
    send = (model.labels, model.scores.astype(np.float32), model.bias, model.temperature, model.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LangModel(*send)
        for rows in slices(batches):
            found = [m.predict(t) for t in rows.column(text_at).to_pylist()]
            accepted = [lang != UNDETERMINED and s >= m.threshold for lang, s in found]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *new], names=[*keep, *names])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*read).mapInArrow(run, f"{kept}`{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return predict(marked, train(docs), keep=["doc_id", "held_out"])
