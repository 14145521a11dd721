"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams over lower-cased letters (anything else is one blank) are hashed to buckets,
weighted by their share in the text times the inverse document frequency, and fed to a multinomial
logistic regression trained with follow-the-regularised-leader (per-coordinate rates, L1 and L2
penalties), so most weights are exactly zero. Training goes on until an epoch gains little. A temperature
fitted on learning rows that were kept apart calibrates the probabilities; its targets are smoothed by one
row, since rows that are all told apart would otherwise drive it to zero.

Document frequencies count every learning document. Weights are fitted on a bounded sample of about
``per_lang`` rows of each language, chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlake.llm.bytesops import U64, blocks, code_points, gram_hash, mix, prefix_hash
from drawlake.llm.common import hash_share, held_out

BITS = 16
GRAMS = (1, 2, 3)
_FOLD = np.full(1 << 16, 0x20, np.uint32)
for _c in range(1 << 16):
    if chr(_c).isalpha():
        _low = chr(_c).lower()
        _FOLD[_c] = ord(_low) if len(_low) == 1 else _c


def grams(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, offset of each text's first) for each n."""
    chars, rows = code_points(data, starts)
    chars = np.where(chars < 1 << 16, _FOLD[np.minimum(chars, 0xFFFF)], chars)
    keep = np.ones(len(chars), bool)  # runs of blanks count once
    keep[1:] = (chars[1:] != 0x20) | (chars[:-1] != 0x20)
    kept = np.flatnonzero(keep)
    chars, rows = chars[kept], np.searchsorted(kept, rows)
    prefix = prefix_hash(mix(chars.astype(U64) + U64(0xC0FFEE)))
    for n in GRAMS:
        hashed = gram_hash(prefix, n)
        own = np.ones(len(hashed), bool)
        for back in range(1, n):  # none across two texts
            last = rows[1:] - back
            own[last[(last >= 0) & (last < len(own))]] = False
        at = np.flatnonzero(own)
        yield ((mix(hashed[at] + U64(n))) >> U64(64 - BITS)).astype(np.int32), np.searchsorted(at, rows)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x buckets, times the idf
    bias: np.ndarray
    temperature: float

    def block(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((len(starts) - 1, len(self.languages)))
        count = np.zeros(len(starts) - 1)
        for ids, at in grams(data, starts):
            for k, weights in enumerate(self.weights):
                sums = np.zeros(len(ids) + 1)
                np.cumsum(weights[ids], out=sums[1:])
                total[:, k] += sums[at[1:]] - sums[at[:-1]]
            count += at[1:] - at[:-1]
        z = (self.bias + total / np.maximum(count, 1)[:, None]) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, mark = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for _, _, data, starts in blocks(batch.column(0)):
            parts = list(grams(data, starts))
            for i in range(len(starts) - 1):
                ids = np.concatenate([x[at[i] : at[i + 1]] for x, at in parts])
                here = np.arange(len(ids))
                mark[ids] = here
                df[ids[mark[ids] == here]] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["bucket", "df"])


def log_loss(logits: np.ndarray, targets: np.ndarray, temperature: float) -> float:
    """Mean cross entropy of target distributions under softmax(logits / temperature)."""
    z = logits / temperature
    z = z - z.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(1)) - (targets * z).sum(1)))


def calibrate(logits: np.ndarray, labels: np.ndarray, limits: tuple[float, float] = (-12.0, 12.0)) -> float:
    """The temperature with the least log loss on smoothed targets; the loss is convex in 1 / temperature, so bisection finds it."""
    n, k = logits.shape
    rest = 1 / (n + 2)  # as in Platt's scaling
    targets = np.full((n, k), rest / (k - 1))
    targets[np.arange(n), labels] = 1 - rest
    low, high = limits
    for _ in range(60):
        mid = (low + high) / 2
        z = logits * np.exp(mid)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        low, high = (mid, high) if ((p - targets) * logits).sum() < 0 else (low, mid)
    return float(np.exp(-(low + high) / 2))


def train(texts: list[str], labels: list[int], languages: list[str], idf: np.ndarray, epochs: int = 40, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-4, gain: float = 0.02, seed: int = 3) -> Model:
    """Follow-the-regularised-leader with elastic-net penalties, then the temperature on every fifth row kept apart.

    Training ends with the first epoch that lowers the loss by less than the share ``gain``.
    """
    rng = np.random.default_rng(seed)
    docs = []
    for _, _, data, starts in blocks(pa.array(texts, pa.string())):
        parts = list(grams(data, starts))
        for i in range(len(starts) - 1):
            ids, n = np.unique(np.concatenate([x[at[i] : at[i + 1]] for x, at in parts]), return_counts=True)
            docs.append((ids, n / max(n.sum(), 1) * idf[ids]))
    k = len(languages)
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    bias = np.log((np.bincount(labels, minlength=k) + 1) / (len(labels) + k))

    def weight(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[ids])) / alpha + l2))

    apart = np.arange(len(docs)) % 5 == 4 if len(docs) >= 20 else np.zeros(len(docs), bool)
    scale = 30.0  # shares are small numbers
    before = np.inf
    for _ in range(epochs):
        total = 0.0
        for i in rng.permutation(np.flatnonzero(~apart)):
            ids, x = docs[i]
            if not len(ids):
                continue
            w = weight(ids)
            s = bias + scale * (x @ w)
            p = np.exp(s - s.max())
            p /= p.sum()
            total -= np.log(max(p[labels[i]], 1e-300))
            p[labels[i]] -= 1
            g = scale * x[:, None] * p
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g * g
        if total > (1 - gain) * before:
            break
        before = total
    w = scale * weight(np.arange(1 << BITS))
    held = np.flatnonzero(apart)
    logits = np.array([bias + docs[i][1] @ w[docs[i][0]] for i in held]).reshape(-1, k)
    temperature = calibrate(logits, np.asarray(labels)[held]) if len(held) and k > 1 else 1.0
    return Model(languages, np.ascontiguousarray((w * idf[:, None]).astype(np.float32).T), bias, temperature)


def fit(docs: DataFrame, per_lang: int = 600, parts: int = 4, part: int = 2, seed: int = 5) -> Model | None:
    """A model from rows with text, lang and an id that is not held out; None if there are none."""
    known = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"), parts, part)).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not size:
        return None
    languages = sorted(size)
    df = np.zeros(1 << BITS)
    for r in known.select("text").mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + sum(size.values())) / (1 + df)) + 1
    share = F.element_at(F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, per_lang / size[x]))]), F.col("lang"))
    rows = known.where(hash_share(F.col("doc_id"), seed) < share).orderBy("doc_id", "text").collect()
    if not rows:
        rows = known.limit(per_lang).collect()
    return train([r["text"] for r in rows], [languages.index(r["lang"]) for r in rows], languages, idf)


def _predict(model: Model):
    names = np.array(model.languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            for _, _, data, starts in blocks(batch.column(batch.num_columns - 1)):
                b, s = model.block(data, starts)
                best.append(b)
                score.append(s)
            names_out = names[np.concatenate(best)] if best else np.zeros(0, object)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names_out, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs(doc_id, text, lang, ...)``.

    A text that is null or has no letter gets ``und`` and score 0, as does every text if nothing could
    be learned. Equal probabilities go to the language first in order. Repeated rows get equal answers, very
    long texts are read whole, no rows give no rows; a null doc_id is kept and never held out, and is not
    learned from. Other columns are ignored, whatever their names.
    """
    model = fit(docs, parts=parts, part=part)
    text = F.col("text").cast("string")
    read = docs.select("doc_id", F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.alias("_text"))
    if model is None:
        out = read.select("doc_id", F.lit(False).alias("letters"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        out = read.mapInArrow(_predict(model), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, letters boolean, lang_pred string, score double")
    known = F.col("letters")
    return out.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), F.when(known, F.col("lang_pred")).otherwise(F.lit("und")).alias("lang_pred"), F.when(known, F.col("score")).otherwise(F.lit(0.0)).alias("score"))
