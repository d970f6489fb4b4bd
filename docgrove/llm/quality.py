"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, word pairs and
character n-grams (hashed into a fixed table); a softmax over two classes reads
the average. It is trained by mini-batch stochastic gradient descent in numpy.
A pair of equal neighbours hashes to one feature whatever the word, so that
repetition is seen on words not met in training.

Because the softmax reads an average, a trained feature's effect on the
difference of the two logits is one number; scoring sums these numbers, the
n-grams' once for each distinct word of a chunk, which gives the same result as
averaging the vectors.

Scale: training takes a bounded, documented sample: the ``max_rows`` labelled
training rows with the smallest hash of their id; the texts of just these rows
come from one scan with a broadcast of at most ``max_rows`` ids, and one task
trains on them. The model (``BUCKETS`` floats) is broadcast; scoring is a map
over the scan, whole texts in bounded chunks, no shuffle.

Defined cases: a null or empty text has no features and gets the score of the
bias alone; null labels and labels other than 0 and 1 aren't trained on; with no
usable labels (or one class only) all documents score that class's share, 0.5
with none; repeated rows score alike; an empty table gives no rows; other
columns pass through, ``score`` and ``predicted`` replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans as S
from .common import lean, unused

BUCKETS = 1 << 18
DIM = 8
MAX_ROWS = 6000
NGRAMS = (3, 4)
THRESHOLD = 0.3
_SAME = np.uint64(0xA5A5A5A55A5A5A5A)
_KIND = {"word": np.uint64(0x1F), "pair": np.uint64(0x2F), "gram": np.uint64(0x3F)}


def _bucket(h: np.ndarray, kind: str) -> np.ndarray:
    return (S.mix(h ^ _KIND[kind]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character (byte) n-grams of words set between brackets, and their number for each word."""
    length = ends - starts
    size = length + 2
    at = np.concatenate([[0], np.cumsum(size)])
    text = np.empty(at[-1], np.uint8)
    text[at[:-1]] = 0x02
    text[at[1:] - 1] = 0x03
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(at[:-1] + 1, length) + inner] = data[np.repeat(starts, length) + inner]
    found, owner = [], []
    for n in NGRAMS:
        k = np.maximum(size - n + 1, 0)
        i = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(at[:-1], k)
        code = np.zeros(len(i), np.uint64)
        for j in range(n):
            code = code * np.uint64(257) + text[i + j]
        found.append(_bucket(code + np.uint64(n << 60), "gram"))
        owner.append(np.repeat(np.arange(len(starts)), k))
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(starts))


def _read(data: np.ndarray, offsets: np.ndarray):
    """Of a chunk: each word's distinct id and document, distinct words' buckets and n-grams, pairs' buckets and documents."""
    starts, ends, counts = S.words(data, offsets)
    h = S.hash_spans(data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), counts)
    distinct, first, word = np.unique(h, return_index=True, return_inverse=True)
    grams, n_grams = _grams(data, starts[first], ends[first])
    near = np.flatnonzero(doc[1:] == doc[:-1])
    a, b = h[near], h[near + 1]
    pairs = _bucket(np.where(a == b, _SAME, S.pair_hash(a, b)), "pair")
    return word, doc, _bucket(distinct, "word"), grams, n_grams, pairs, doc[near]


@dataclass
class Model:
    effect: np.ndarray  # of each bucket on the logit of label 1 less that of label 0
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        word, doc, buckets, grams, n_grams, pairs, pair_doc = _read(data, offsets)
        of_gram = np.bincount(np.repeat(np.arange(len(buckets)), n_grams), self.effect[grams], minlength=len(buckets))
        value = self.effect[buckets] + of_gram
        total = np.bincount(doc, value[word], minlength=n) + np.bincount(pair_doc, self.effect[pairs], minlength=n)
        count = np.bincount(doc, (1 + n_grams)[word], minlength=n) + np.bincount(pair_doc, minlength=n)
        logit = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: distinct buckets, their share of all its features; and the documents' borders among these."""
    n = len(offsets) - 1
    word, doc, buckets, grams, n_grams, pairs, pair_doc = _read(data, offsets)
    ids, share, border = [], [], [0]
    gram_at = np.concatenate([[0], np.cumsum(n_grams)])
    by_doc, by_pair = np.searchsorted(doc, np.arange(n + 1)), np.searchsorted(pair_doc, np.arange(n + 1))
    for d in range(n):
        w, c = np.unique(word[by_doc[d] : by_doc[d + 1]], return_counts=True)
        k = n_grams[w]
        g = grams[np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(gram_at[w], k)] if len(w) else grams[:0]
        p = pairs[by_pair[d] : by_pair[d + 1]]
        raw = np.concatenate([buckets[w], g, p])
        times = np.concatenate([c, np.repeat(c, k), np.ones(len(p), np.int64)])
        u, inverse = np.unique(raw, return_inverse=True)
        f = np.bincount(inverse, times, minlength=len(u))
        ids.append(u)
        share.append(f / max(f.sum(), 1))
        border.append(border[-1] + len(u))
    return np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32), np.concatenate([*share, np.zeros(0)]).astype(np.float32), np.array(border)


def train(ids: np.ndarray, share: np.ndarray, border: np.ndarray, label: np.ndarray, epochs: int = 12, rate: float = 1.0, batch: int = 64, seed: int = 10) -> Model:
    """Mini-batch SGD with a falling rate on vectors, output weights and bias."""
    effect = np.zeros(BUCKETS, np.float32)
    n = len(label)
    ones = int(label.sum())
    if n == 0 or ones in (0, n):
        return Model(effect, 0.0 if n == 0 else (700.0 if ones else -700.0))
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([n - ones, ones]) / n).astype(np.float32)
    steps, step = epochs * -(-n // batch), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            docs = order[lo : lo + batch]
            size = border[docs + 1] - border[docs]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(border[docs], size)
            i, s, d = ids[at], share[at], np.repeat(np.arange(len(docs)), size)
            rows = vectors[i]
            hidden = np.stack([np.bincount(d, s * rows[:, k], minlength=len(docs)) for k in range(DIM)], 1).astype(np.float32)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), label[docs]] -= 1
            lr = rate * (1 - step / steps)
            step += 1
            grad = (p @ out.T).astype(np.float32)
            out -= lr * (hidden.T @ p) / len(docs)
            bias -= lr * 0.1 * p.mean(0)
            # features that a batch shares are summed; a sparse feature's step isn't divided by the batch
            np.subtract.at(vectors, i, (lr * 4) * s[:, None] * grad[d])
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _train_task(epochs: int, seed: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels, top = [], [], 0
        for b in it:
            data, offsets = S.flat(b.column(0))
            for lo, hi in S.chunks(offsets):
                f = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                parts.append((f[0], f[1], f[2][:-1] + top))
                top += len(f[0])
            labels += b.column(1).to_pylist()
        if parts:
            ids, share = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            model = train(ids, share, np.concatenate([*[p[2] for p in parts], [top]]), np.array(labels, np.int64), epochs, seed=seed)
            yield pa.RecordBatch.from_arrays([pa.array([model.effect.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["effect", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = 5, held: int = 0, epochs: int = 12, seed: int = 10, text: str = "text") -> Model:
    """Train on at most ``max_rows`` labelled rows whose crc32(doc_id as text) mod ``folds`` isn't ``held``."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != held)).select("doc_id", F.col("quality").cast("int").alias("_label"))
    chosen = chosen.orderBy(rank, "_label").limit(max_rows)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(rank, F.xxhash64("_text"), "_label").limit(max_rows).select("_text", "_label").coalesce(1)
    got = rows.mapInArrow(lean(_train_task(epochs, seed)), "effect binary, bias double").collect()
    if not got:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(got[0]["effect"], np.float32), got[0]["bias"])


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all), ``score`` in 0..1 and ``predicted`` 0 or 1."""
    carried = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast((model.effect, model.bias))
    n = len(carried)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in it:
            data, offsets = S.flat(b.column(n))
            parts = [own.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in S.chunks(offsets)]
            score = np.concatenate([*parts, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [*b.schema.names[:n], "score", "predicted"])

    rows = docs.select(*carried, F.col(text).cast("string").alias(unused(docs, "read")[0]))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(lean(run), schema)
