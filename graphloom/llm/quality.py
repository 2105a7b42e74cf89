"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Texts with a positive label are trusted; everything else, labelled or not, counts as unlabelled web
text. With class prior ``pi``, positives' mean losses ``R+`` (as positive) and ``R-`` (as negative) and
the unlabelled mean loss as negative ``U-``, training minimises ``pi R+ + max(0, U- - pi R-)``; where the
difference is below 0 the step goes against it, so that the model can't be rewarded for a negative risk.
The prior is estimated: a first discriminator of positives from unlabelled texts gives every text a rank,
and the prior is the least ratio, over all cuts, of the unlabelled share above the cut (with a margin of
error added to it) to the positives' share above it.

A text is described by rates over the whole of it: character classes and pairs of classes, word shapes,
repetition of words and of lines, sizes. The model is one hidden layer over standardised rates, trained
with numpy on a bounded sample (``QualityParams.rows`` of either kind).

Null and empty texts have the rates of an empty text and get a score as any other. Rows without a label
are scored. Ties and repeated rows have equal scores. Without any positive label all scores are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, least_hashes, row_hash, short_batches, slices, table, within
from .language import is_held_out, text_column

#: Character classes: 0 other, 1 blank, 2 line feed, 3 lower ASCII, 4 upper ASCII, 5 digit, 6 stop, 7 comma, 8 bracket or quote, 9 symbol, 10 lower beyond ASCII, 11 upper beyond ASCII, 12 other letter
CLASSES = 13


def _class_of(c: str) -> int:
    if c.isspace():
        return 2 if c == "\n" else 1
    if c.isalpha():
        if c.islower():
            return 3 if c < "\x80" else 10
        if c.isupper():
            return 4 if c < "\x80" else 11
        return 12
    if c.isdigit():
        return 5
    for k, members in ((6, ".!?"), (7, ",;:"), (8, "()[]{}\"'«»-")):
        if c in members:
            return k
    return 9 if c < "\x80" else 0


_CLASS = np.array([_class_of(chr(c)) for c in range(0x10000)], dtype=np.uint8)
N_RATES = CLASSES * CLASSES + CLASSES + 14


def rates(text: str | None) -> np.ndarray:
    """The N_RATES rates of a text."""
    out = np.zeros(N_RATES)
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    classes = _CLASS[np.minimum(points, 0xFFFF)].astype(np.int64)
    n = classes.size
    single = np.bincount(classes, minlength=CLASSES) / n
    pairs = np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=CLASSES * CLASSES) / n
    out[:CLASSES], out[CLASSES : CLASSES + CLASSES**2] = np.sqrt(single), np.sqrt(pairs)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    w = len(words)
    if w:
        seen = Counter(words)
        top = sum(k for _, k in seen.most_common(3))
        again = [sum(map(str.__eq__, words, words[k:])) / w for k in (1, 2, 3, 4)]
        same_letters = len({x.casefold() for x in seen})
        out[CLASSES + CLASSES**2 :] = [
            len(seen) / w,
            np.log(len(seen) + 1) / np.log(w + 1),
            same_letters / len(seen),
            top / w,
            *again,
            sum(map(len, words)) / w / 10,
            np.log1p(w) / 10,
            len(lines) / w,
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            len({x[-1] for x in seen}) / 10,
            sum(k for x, k in seen.items() if len(x) > 1 and x.isupper()) / w,
        ]
    return out


@dataclass(frozen=True)
class QualityParams:
    """rows bounds the positives and, apart from them, the unlabelled texts of the sample."""

    rows: int = 4000
    hidden: int = 24
    epochs: int = 60
    batch: int = 256
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11
    threshold: float = 0.3


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    prior: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ a + b) @ c + d

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.layers is None:
            return np.zeros(len(texts))
        x = np.array([rates(t) for t in texts]).reshape(-1, N_RATES)
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> np.ndarray:
    """The step's gradient by the margins of positive and of unlabelled texts.

    Logistic losses: as positive log(1 + exp(-z)), as negative log(1 + exp(z)). While the negative part of the risk is not
    below 0 it is the gradient of the whole risk; else that of the negative part with its sign turned.
    """
    n_p, n_u = len(zp), len(zu)
    negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
    as_neg = np.concatenate([-prior * _sigmoid(zp) / n_p, _sigmoid(zu) / n_u])
    as_pos = np.concatenate([prior * (_sigmoid(zp) - 1) / n_p, np.zeros(n_u)])
    return as_pos + as_neg if negative >= 0 else -as_neg


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, params: QualityParams) -> tuple:
    """The layers after Adam steps on the non-negative risk, or, without a prior, on telling pos from unl."""
    rng = np.random.default_rng(params.seed)
    k = pos.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(k), (k, params.hidden)), np.zeros(params.hidden), rng.normal(0, 1 / np.sqrt(params.hidden), params.hidden), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    t = 0
    for epoch in range(params.epochs):
        order = rng.permutation(len(unl))
        for at in range(0, len(unl), params.batch):
            u = unl[order[at : at + params.batch]]
            p = pos[rng.integers(len(pos), size=min(len(pos), params.batch))]
            x = np.vstack([p, u])
            h = np.tanh(x @ w[0] + w[1])
            z = h @ w[2] + w[3]
            s = _sigmoid(z)
            zp, zu, n_p, n_u = z[: len(p)], z[len(p) :], len(p), len(u)
            g = np.concatenate([(s[:n_p] - 1) / n_p, s[n_p:] / n_u]) if prior is None else risk_gradient(zp, zu, prior)
            back = np.outer(g, w[2]) * (1 - h * h)
            grads = [x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]
            t += 1
            rate = params.rate * (1 - epoch / params.epochs) + 1e-4
            for i, grad in enumerate(grads):
                grad = grad + params.decay * w[i]
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                w[i] = w[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return w[0], w[1], w[2], float(w[3][0])


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in unl, from scores of texts that no training has seen."""
    cuts = np.quantile(pos, np.linspace(0.0, 0.9, 91))
    above_p = np.array([np.mean(pos >= c) for c in cuts])
    above_u = np.array([np.mean(unl >= c) for c in cuts])
    margin = np.sqrt(np.log(2 / 0.1) / 2) * (1 / np.sqrt(len(unl)) + 1 / np.sqrt(len(pos)))
    best = int(np.argmin((above_u + margin * 0.5) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, params: QualityParams = QualityParams()) -> QualityModel:
    if not len(pos) or not len(unl):
        return QualityModel(np.zeros(N_RATES), np.ones(N_RATES), None)
    everything = np.vstack([pos, unl])
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    p, u = ((np.clip((x - mean) / scale, -8, 8)) for x in (pos, unl))
    half = QualityParams(**{**params.__dict__, "epochs": max(1, params.epochs // 4)})
    a, b, c, d = _train(p[::2], u[::2], None, half)
    held = [np.tanh(x[1::2] @ a + b) @ c + d if len(x) > 1 else np.tanh(x @ a + b) @ c + d for x in (p, u)]
    prior = estimate_prior(*held)
    return QualityModel(mean, scale, _train(p, u, prior, params), prior)


def _sampled(docs: DataFrame, n: int, n_rows: int) -> np.ndarray:
    """Rates of the n rows of docs (doc_id, text) whose hash of id and text is least, in that order; rows equal in both count once.

    n_rows is docs' number of rows or more. Hashes are chosen before rates are taken, so no more than n rows' rates reach the driver.
    """
    hashed = docs.select(row_hash("doc_id", "text").alias("h"), "text", F.lit(None).cast("string").alias("group"))
    limits = least_hashes(hashed.select("group", "h"), {None: n_rows}, n) if n_rows else {}
    chosen = hashed.filter(within(limits, "group", "h")).select("h", "text").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [rates(t).astype(np.float32) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float32()))], names=["h", "rates"])

    with few(docs.sparkSession):
        got = chosen.mapInArrow(run, "h bigint, rates array<float>").toArrow().sort_by("h")
    flat = [c.flatten().to_numpy() for c in got.column("rates").chunks]
    return np.concatenate([np.empty(0, np.float32), *flat]).astype(float).reshape(-1, N_RATES)


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Learns from the labels outside the held-out fifth, and from unlabelled texts outside it.

    Of the ids with a positive label, those of the params.rows least hashes are looked up among docs, so what is
    broadcast has that bound; of the rows found (an id may have many) as many are taken again.
    """
    learn = ~is_held_out(F.col("doc_id"), 5, 0)
    positive = labels.filter(learn & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id", row_hash("doc_id").alias("h"), F.lit(None).cast("string").alias("group"))
    n_positive = positive.count()
    limits = least_hashes(positive.select("group", "h"), {None: n_positive}, params.rows) if n_positive else {}
    ids = positive.filter(within(limits, "group", "h")).select("doc_id").distinct()
    trusted = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    pos = _sampled(trusted, params.rows, trusted.select("doc_id").count())
    others = docs.filter(learn & F.col("doc_id").isNotNull()).select("doc_id", "text")
    unl = _sampled(others, params.rows, others.select("doc_id").count())
    return fit(pos, unl, params)


def score(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, threshold: float = QualityParams.threshold, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs' columns (or those to keep) with the score and the prediction; one pass over whole texts, no shuffle.

    names are the new columns' names; docs' own columns of those names don't come back, so callers that need them give others.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    text_at, read = text_column(keep)
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            s = model.scores(rows.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*keep, *names])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*read).mapInArrow(run, f"{kept}`{names[0]}` double, `{names[1]}` int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marked = docs.select("doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    return score(marked, train(docs, labels), keep=["doc_id", "held_out"])
