"""Quality classifier by supervised subword embeddings.

Words, pairs of neighbouring words and character 3- to 5-grams within words are hashed to buckets.
Each bucket has a learned vector; a document is the mean of its features' vectors, a softmax layer
gives the class. Vectors and layer are trained together by stochastic gradient descent in numpy.
The mean and the layer are linear, so scoring folds them into one number per bucket, and a document
costs one table look-up per feature. A pair of equal words hashes to one common bucket, which lets
the model learn that repetition itself is a sign.

Training uses a bounded sample of labelled rows, ``per_class`` of each label (chosen by a hash of the
id); the classes' shares over *all* labelled rows set the prior. Every fifth row is kept apart from training, and
a line through the margins of those, fitted by logistic regression, makes the scores probabilities.
Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlake.llm.bytesops import U64, blocks, code_points, gram_hash, mix, prefix_hash, range_hash
from drawlake.llm.common import hash_share, held_out

BITS = 18
GRAMS = (3, 4, 5)
#: Fewest rows of each label from which some are kept apart.
APART = 50
_BLANK = np.zeros(128, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def features(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, offset of each text's first feature) for each kind of feature."""
    chars, rows = code_points(data, starts)
    blank = (chars < 128) & _BLANK[np.minimum(chars, 127)]
    prefix = prefix_hash(mix(chars.astype(U64) + U64(0x51ED27)))
    shift = U64(64 - BITS)
    inner = np.zeros(len(chars) + 1, np.int32)
    np.cumsum(blank, out=inner[1:])
    for n in GRAMS:
        hashed = gram_hash(prefix, n)
        # blanks may stand at either end, as marks of a word's edge
        own = inner[n - 1 : n - 1 + len(hashed)] == inner[1 : 1 + len(hashed)]
        last = rows[1:] - 1  # the blank after a text: what starts there is the next text's
        own[last[last < len(own)]] = False
        whole = np.flatnonzero(own)
        yield ((hashed[whole] * U64(0x9E3779B97F4A7C15 + 2 * n)) >> shift).astype(np.int32), np.searchsorted(whole, rows)
    edge = np.flatnonzero(np.diff((~blank).view(np.int8), prepend=0))
    begin, end = edge[::2], edge[1::2]
    word = mix(range_hash(prefix, begin, end))
    at = np.searchsorted(begin, rows)
    yield (word >> shift).astype(np.int32), at
    pair = word[:-1] ^ word[1:]
    own = np.ones(len(pair), bool)
    last = at[1:-1] - 1
    own[last[(last >= 0) & (last < len(own))]] = False
    keep = np.flatnonzero(own)
    yield ((mix(pair[keep] ^ U64(0xA5A5))) >> shift).astype(np.int32), np.searchsorted(keep, np.minimum(at, len(pair)))


@dataclass
class Model:
    """One weight per bucket and a bias; the score of an empty text is the prior."""

    weights: np.ndarray
    bias: float

    def score_block(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(starts) - 1), np.zeros(len(starts) - 1)
        for ids, at in features(data, starts):
            sums = np.zeros(len(ids) + 1)
            np.cumsum(self.weights[ids], out=sums[1:])
            total += sums[at[1:]] - sums[at[:-1]]
            count += at[1:] - at[:-1]
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(count, 1))))


def train(texts: list[str], labels: list[int], prior: float, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 1) -> Model:
    """Fit by stochastic gradient descent on class-balanced texts; ``prior`` is the share of label 1 to expect."""
    rng = np.random.default_rng(seed)
    docs = []
    for _, _, data, starts in blocks(pa.array(texts, pa.string())):
        parts = list(features(data, starts))
        for i in range(len(starts) - 1):
            ids, n = np.unique(np.concatenate([x[at[i] : at[i + 1]] for x, at in parts]), return_counts=True)
            docs.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    labels = np.asarray(labels, np.int64)
    apart = np.zeros(len(docs), bool)
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        apart[own[4::5]] = min(np.bincount(labels, minlength=2)) >= APART
    size = np.bincount(labels[~apart], minlength=2)
    weight = size.sum() / (2 * np.maximum(size, 1))
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    squares = np.full(1 << BITS, 1e-3, np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    layer += rng.normal(0, 0.5, layer.shape).astype(np.float32)
    used = np.flatnonzero(~apart)
    steps = epochs * len(used)
    for step, i in enumerate(x for _ in range(epochs) for x in rng.permutation(used)):
        ids, share = docs[i]
        if not len(ids):
            continue
        mean = share @ vectors[ids]
        z = layer @ mean + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[labels[i]] -= 1
        error = p * weight[labels[i]]
        now = rate * (1 - step / steps)
        toward = layer.T @ error
        # gradients of a bucket are scaled by their own history, so that rare features learn as fast
        squares[ids] += share * share * float(toward @ toward)
        vectors[ids] -= (now * share / np.sqrt(squares[ids]))[:, None] * toward
        layer -= 0.2 * now * np.outer(error, mean)
        bias -= 0.02 * now * error
    margin = layer[1] - layer[0]
    shift = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    weights, offset = (vectors @ margin).astype(np.float32), float(bias[1] - bias[0] + shift)
    held = np.flatnonzero(apart)
    if len(held):
        z = np.array([offset + docs[i][1] @ weights[docs[i][0]] for i in held])
        slope, moved = calibrate(z, labels[held], prior)
        weights, offset = weights * np.float32(slope), slope * offset + moved
    return Model(weights, offset)


def calibrate(margin: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of Platt's logistic regression, classes weighed by ``prior``; 1 and 0 if margins do not rise with the label."""
    n = np.bincount(labels, minlength=2)
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(labels == 1, prior / n[1], (1 - prior) / n[0]) * len(labels)
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip((x * at).sum(1), -500, 500)))
        slope = ((weight * (p - target))[:, None] * x).sum(0)
        bend = np.einsum("n,ni,nj->ij", weight * p * (1 - p), x, x) + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 and np.isfinite(at).all() else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, parts: int = 5, seed: int = 11) -> Model:
    """Train on at most about ``per_class`` rows of each label whose id is not held out.

    Rows with a null id or label take no part. With one label only, or none, every text gets the prior.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"), parts, 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    size = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    if not n0 or not n1:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    share = F.when(F.col("quality") == 0, per_class / n0).otherwise(per_class / n1)
    chosen = known.where(hash_share(F.col("doc_id"), seed) < share)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").collect()
    return train([r["text"] for r in rows], [r["quality"] for r in rows], prior)


def _score(model: Model, inside: int | None):
    """``inside``: the place of the text within the struct of kept columns, if it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1) if inside is None else batch.column(0).field(inside)
            scores = [model.score_block(data, starts) for _, _, data, starts in blocks(text)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["kept", "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``(kept, score)``: the columns ``keep`` as a struct, and the probability of label 1; null text is empty, rows stay as they are."""
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col("text").cast("string").alias("text"))
    inside = keep.index("text") if "text" in keep and docs.schema["text"].dataType == T.StringType() else None
    if inside is not None:  # a text goes to the workers once
        read = read.select("kept")
    return read.mapInArrow(_score(model, inside), f"kept {read.schema['kept'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    Null, empty and blank texts get the prior; very long ones are scored whole. A null doc_id is kept, never held
    out and never learned from; repeated rows get equal scores; a doc_id with several labels counts once, with the
    smallest. A score equal to ``cut`` counts as 1. With no rows there is no result; with no labels every text gets the
    same score. Other columns are ignored, whatever their names.
    """
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select("kept.doc_id", held_out(F.col("kept.doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows that score ``cut`` or more, each by its own text (see ``classify``), with their columns unchanged."""
    return score(docs, fit(docs, labels), docs.columns).where(F.col("score") >= cut).select("kept.*")
