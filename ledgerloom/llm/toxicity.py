"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a document: the distinct hashed words with their stems (first STEMS
bytes, so that inflected forms share weights), word pairs and pairs with one word
between them (letters only, folded), of the whole text, and which of them come again.
Training runs over a bounded sample (labelled.sample) in one task, example by example,
with a learning rate for each coordinate and L1 and L2 terms; the L1 term is chosen by
the loss of a validation part.  It leaves a few thousand weights, which are all that is
broadcast (at most 2**BITS floats).  Scoring needs no shuffle.

Edge cases: a null or empty text gets the score of the bias; repeated rows are
scored alike; an empty table gives no rows; without labels of both classes every
score is the training share of label 1 (0 without labels).
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import labelled, shared, textkernel as tk
from ledgerloom.llm.quality_classifier import _LETTERS, _packed

BITS = 20
MOST_PER_CLASS = 6000
STEMS = (5, 6, 7, 8)
#: How often a feature must come in a text to count as another one too, and what tells the two apart.
AGAIN = ((2, 0x5A5A5), (3, 0x33CC3))
EPOCHS = 3
ALPHA, BETA, L2 = 0.3, 1.0, 0.5
#: Documents that must have a feature, and the values of L1 to choose from, in proportion to the sample's size.
LEAST_SHARE, L1_SHARES = 0.004, (0.0009, 0.0018, 0.003, 0.005)
THRESHOLD = 0.5


def features(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a slice and the document of each; a feature may come again."""
    doc = words.doc()
    h, *stems = words.prefix_hashes(_LETTERS, *STEMS)
    ids, of = [h, *(s + tk.SHINGLE_WEIGHT[10 + i] for i, s in enumerate(stems))], [doc] * (1 + len(stems))
    for gap, salt in ((1, 3), (2, 5)):
        if len(h) > gap:
            near = doc[gap:] == doc[:-gap]
            ids.append(tk.mix(h[:-gap] * tk.SHINGLE_WEIGHT[salt] + h[gap:] * tk.SHINGLE_WEIGHT[salt + 1])[near])
            of.append(doc[gap:][near])
    return (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)


def repeated(pairs: np.ndarray) -> np.ndarray:
    """The distinct pairs (text, feature), and for those that come again a feature of each number in AGAIN that they reach."""
    once, count = np.unique(pairs, return_counts=True)
    return np.unique(np.concatenate([once, *(once[count >= k] ^ salt for k, salt in AGAIN)]))


def _pairs(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, text of the slice, feature): the distinct features of every text, by slices."""
    for i, j, data, offs in tk.slices(texts, size):
        ids, doc = features(tk.Words(data, offs))
        pairs = repeated(doc << BITS | ids)
        yield i, j, pairs >> BITS, pairs & ((1 << BITS) - 1)


def ftrl(x: list[np.ndarray], y: np.ndarray, l1: np.ndarray, size: int, epochs: int, seed: int = 11) -> np.ndarray:
    """FTRL-proximal over examples of active coordinates; one column of weights for each L1, the last row the bias."""
    z, n = np.zeros((size + 1, len(l1))), np.zeros((size + 1, len(l1)))
    bias = np.array([size])

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The last row is the bias, which has no L1."""
        least = np.repeat(l1[None, :], len(z), 0)
        least[-1] = 0
        return np.where(np.abs(z) <= least, 0.0, -(z - np.sign(z) * least) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in r.permutation(len(y)):
            at = np.concatenate([x[i], bias])
            za, na = z[at], n[at]
            w = weights(za, na)
            g = 1 / (1 + np.exp(-np.clip(w.sum(0), -30, 30))) - y[i]
            more = na + g * g
            z[at] = za + g - (np.sqrt(more) - np.sqrt(na)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def _fit(y: np.ndarray, weight: np.ndarray, texts: list[str]) -> bytes:
    if len(y) < 4 or y.min() == y.max():
        return _packed(share=np.array(float((y * weight).sum() / weight.sum()) if len(y) else 0.0))
    x = []
    for i, j, doc, ids in _pairs(pa.array(texts, pa.large_string())):
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        x += [ids[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
    # A coordinate learns only if several documents have it: what one document alone has only memorises it.
    seen = np.zeros(1 << BITS, np.int64)
    for a in x:
        seen[a] += 1
    kept = np.flatnonzero(seen >= max(3, LEAST_SHARE * len(y)))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    x = [s[s >= 0] for s in (slot[a] for a in x)]
    # L1 by the loss of a fifth of the sample that the others were fitted without; then all of it.
    prior = np.log((weight[y == 1].sum() / weight[y == 0].sum()) / ((y == 1).sum() / (y == 0).sum()))
    l1 = np.maximum(0.5, np.array(L1_SHARES) * len(y))
    valid = np.random.default_rng(3).permutation(len(y))
    valid, train = valid[: len(y) // 5], valid[len(y) // 5 :]
    best = len(l1) - 1
    if min(len(set(y[valid])), len(set(y[train]))) == 2:
        w = ftrl([x[i] for i in train], y[train], l1 * 0.8, len(kept), EPOCHS)
        z = np.array([w[x[i]].sum(0) for i in valid]) + w[-1] + prior
        best = int(np.argmin((weight[valid, None] * (np.logaddexp(0, z) - y[valid, None] * z)).sum(0)))
    w = ftrl(x, y, l1[best : best + 1], len(kept), EPOCHS)[:, 0]
    live = np.flatnonzero(w[:-1])
    # The sample's shares are not those of all rows: the bias alone carries the difference.
    return _packed(at=np.r_[kept[live], 1 << BITS].astype(np.int32), w=np.r_[w[live], w[-1] + prior].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, most_per_class: int = MOST_PER_CLASS) -> bytes:
    """Fits the model in one task on at most 2 * most_per_class labelled documents of labelled.MOST_BYTES together."""
    return labelled.fitted(labelled.sample(docs, labels, label, modulus, held_out, most_per_class), _fit)


def score(docs: DataFrame, model: bytes, out: str = "score", text: str = "text") -> DataFrame:
    """Appends the probability of label 1; all columns of `docs` stay (a column named `out` is replaced, `text` too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = dict(np.load(io.BytesIO(held.value))) if held.value else {"share": np.array(0.0)}
        table = np.zeros((1 << BITS) + 1, np.float32)
        if "at" in m:
            table[m["at"]] = m["w"]
        wanted = table[:-1] != 0
        every = np.arange(1 << BITS)
        wanted = np.logical_or.reduce([wanted, *(wanted[every ^ salt] for _, salt in AGAIN)])
        for batch in batches:
            scores = np.full(batch.num_rows, float(m.get("share", 0.0)))
            if "at" in m:
                for i, j, data, offs in tk.slices(batch.column(batch.num_columns - 1), 1 << 19):
                    ids, doc = features(tk.Words(data, offs))
                    live = np.flatnonzero(wanted[ids])
                    pairs = repeated(doc[live] << BITS | ids[live])
                    total = np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], minlength=j - i) + table[-1]
                    scores[i:j] = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            yield shared.appended(batch, pa.array(scores), out)

    held = docs.sparkSession.sparkContext.broadcast(model)
    return shared.with_text(docs, text, out).mapInArrow(shared.lean(run), shared.schema_with(docs, out, "double"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: doc_id, held_out, score, predicted for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(labelled.fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
