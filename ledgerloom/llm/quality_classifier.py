"""Quality classifier: random-indexing word vectors, mean-pooled, then a two-layer network.

Training (bounded sample, see labelled.sample): every hashed word and every hashed
word *shape* has a sparse ternary index vector; its word vector is the sum of the
index vectors of its neighbours up to two words away in the sample (random
indexing), scaled to length one.  A document is the mean vector of its words beside
the mean vector of its shapes.  A numpy network (tanh hidden layer, logistic
output) is fitted by Adam; its logits are divided by a temperature chosen on a
validation part so that the outputs are probabilities.

Scoring reads whole texts, needs no shuffle and broadcasts tables of a fixed size
(WORDS + SHAPES rows of DIM half floats, about 10 MB), whatever the corpus.  Word
vectors are gathered CHUNK words at a time, so memory does not grow with a text or
with the sample.

Edge cases: a null or empty text has the zero vector and gets that vector's score;
repeated rows are scored alike; an empty table gives no rows; without usable labels
of both classes every score is the training share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import labelled, shared, textkernel as tk

WORDS, SHAPES, DIM, HIDDEN = 1 << 16, 1 << 14, 64, 24
MOST_PER_CLASS = 3000
CHUNK = 1 << 16
THRESHOLD = 0.7

#: Bits of a word's shape by byte.
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 4
for _i, _c in enumerate("%*$#&|!.,<>=@/_-"):
    _CLASS[ord(_c)] = 8 << _i
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = 8 << 16
#: Letters only, folded: a word and the same word before a comma are one.
_LETTERS = np.where((_CLASS & 3) > 0, tk.FOLDED_VALUE, np.uint64(0)).astype(np.uint64)


def tokens(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape numbers of every word of a slice."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = words.hashes(_LETTERS)
    kinds = _CLASS[words.data]
    mask = np.bitwise_or.reduceat(kinds, words.start).astype(np.uint64)
    length = np.minimum(words.end - words.start, 24).astype(np.uint64) >> np.uint64(2)
    doc = words.doc()
    again = np.zeros(n, np.uint64)
    for back in (1, 2, 3):
        if n > back:
            again[back:] |= ((h[back:] == h[:-back]) & (doc[back:] == doc[:-back])).astype(np.uint64) << np.uint64(back - 1)
    shape = tk.mix(mask | length << np.uint64(32) | again << np.uint64(40))
    return (h % np.uint64(WORDS)).astype(np.int64), (shape % np.uint64(SHAPES)).astype(np.int64) + WORDS


def index_vectors() -> np.ndarray:
    """The sparse ternary index vectors, the same on every machine."""
    r = np.random.default_rng(77)
    out = np.zeros((WORDS + SHAPES, DIM), np.int8)
    for sign in (1, -1, 1, -1):
        out[np.arange(len(out)), r.integers(0, DIM, len(out))] = sign
    return out


def word_vectors(streams: tuple[np.ndarray, np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Random indexing over the sample: neighbours' index vectors, summed for each word and shape, CHUNK words at a time."""
    index = index_vectors()
    total = np.zeros((WORDS + SHAPES, DIM), np.float32)
    for ids in streams:
        for first in range(0, len(ids), CHUNK):
            for step in (1, 2):
                a = np.arange(first, min(first + CHUNK, len(ids) - step))
                a = a[doc[a] == doc[a + step]]
                for x, y in ((ids[a], ids[a + step]), (ids[a + step], ids[a])):
                    if len(x):
                        order = np.argsort(x, kind="stable")
                        x, y = x[order], y[order]
                        cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                        total[x[cut]] += np.add.reduceat(index[y].astype(np.float32), cut, axis=0)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return np.where(length > 0, total / np.maximum(length, 1e-9), 0).astype(np.float16)


def pooled(ids: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the ids of each document, CHUNK words at a time; zeros for none."""
    count = np.diff(first)
    out = np.zeros((len(count), DIM), np.float32)
    doc = np.repeat(np.arange(len(count)), count)
    for a in range(0, len(ids), CHUNK):
        own = doc[a : a + CHUNK]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[cut]] += np.add.reduceat(vectors[ids[a : a + CHUNK]].astype(np.float32, copy=False), cut, axis=0)
    return out / np.maximum(count, 1)[:, None]


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _fit(y: np.ndarray, weight: np.ndarray, texts: list[str]) -> bytes:
    if len(y) < 4 or y.min() == y.max():
        return _packed(share=np.array(float((y * weight).sum() / weight.sum()) if len(y) else 0.5))
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    ids, shapes, count = [], [], []
    for _, _, data, offs in tk.slices(pa.array(texts, pa.large_string())):
        words = tk.Words(data, offs)
        for out, part in zip((ids, shapes), tokens(words)):
            out.append(part.astype(np.int32))
        count.append(words.count)
    streams, count = (np.concatenate(ids), np.concatenate(shapes)), np.concatenate(count)
    vectors = word_vectors(streams, np.repeat(np.arange(len(count), dtype=np.int32), count))
    x = np.concatenate([pooled(s, np.r_[0, np.cumsum(count)], vectors) for s in streams], axis=1)
    mean, sd = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / sd
    r = np.random.default_rng(5)
    order = r.permutation(len(y))
    valid, train = order[: len(y) // 5], order[len(y) // 5 :]
    if len(set(y[valid])) < 2 or len(set(y[train])) < 2:
        valid = train = order
    params = [r.normal(0, (2 * DIM) ** -0.5, (2 * DIM, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    params = [p.astype(np.float32) for p in params]
    moment, square, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = max(600, 12 * len(train) // 64)
    for _ in range(steps):
        at = train[r.integers(0, len(train), 64)]
        a, b, c, d = params
        hidden = np.tanh(x[at] @ a + b)
        p = 1 / (1 + np.exp(-np.clip(hidden @ c + d, -30, 30)))
        g = (p - y[at]) * weight[at] / weight[at].sum()
        back = g[:, None] * c * (1 - hidden**2)
        t += 1
        for k, grad in enumerate([x[at].T @ back + 1e-3 * a, back.sum(0), hidden.T @ g + 1e-3 * c, g.sum(keepdims=True)]):
            moment[k] = 0.9 * moment[k] + 0.1 * grad
            square[k] = 0.999 * square[k] + 0.001 * grad**2
            params[k] = params[k] - 0.01 * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    a, b, c, d = params
    logit = np.tanh(x[valid] @ a + b) @ c + d
    loss = {}
    for temperature in np.geomspace(0.25, 8, 41):
        z = logit / temperature
        loss[temperature] = float((weight[valid] * (np.logaddexp(0, z) - y[valid] * z)).sum())
    return _packed(vectors=vectors, mean=mean, sd=sd, a=a, b=b, c=c, d=d, temperature=np.array(min(loss, key=loss.get)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, most_per_class: int = MOST_PER_CLASS) -> bytes:
    """Fits the model in one task on at most 2 * most_per_class labelled documents of labelled.MOST_BYTES together."""
    return labelled.fitted(labelled.sample(docs, labels, label, modulus, held_out, most_per_class), _fit)


def score(docs: DataFrame, model: bytes, out: str = "score", text: str = "text") -> DataFrame:
    """Appends the probability of label 1; all columns of `docs` stay (a column named `out` is replaced, `text` too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = dict(np.load(io.BytesIO(held.value))) if held.value else {"share": np.array(0.5)}
        for batch in batches:
            scores = np.full(batch.num_rows, float(m.get("share", 0.5)))
            if "vectors" in m:
                for i, j, data, offs in tk.slices(batch.column(batch.num_columns - 1), 1 << 19):
                    words = tk.Words(data, offs)
                    x = np.concatenate([pooled(s, words.first, m["vectors"]) for s in tokens(words)], axis=1)
                    z = np.tanh((x - m["mean"]) / m["sd"] @ m["a"] + m["b"]) @ m["c"] + m["d"]
                    scores[i:j] = 1 / (1 + np.exp(-np.clip(z / m["temperature"], -40, 40)))
            yield shared.appended(batch, pa.array(scores), out)

    held = docs.sparkSession.sparkContext.broadcast(model)
    return shared.with_text(docs, text, out).mapInArrow(shared.lean(run), shared.schema_with(docs, out, "double"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: doc_id, held_out, score, predicted for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(labelled.fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
