"""A bounded, documented sample of labelled documents for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import shared

MOST_BYTES = 48 << 20


def fold_of(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most_per_class: int) -> DataFrame:
    """(label, n, order, text) of at most `most_per_class` labelled training ids of each class; n: ids of the class in all.

    The ids with the smallest xxhash64 are taken, so the sample is the same on every
    run and does not depend on partitioning.  An id with both labels counts as 1.
    Only ids and labels are sorted; the sample of ids is bounded by 2 * most_per_class
    and may therefore be broadcast against the documents.
    """
    rows = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & (fold_of("_id", modulus) != held_out))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    of_class = rows.groupBy("_label").agg(F.count("*").alias("_n"))
    taken = None
    for c in (0, 1):
        part = rows.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(most_per_class)
        taken = part if taken is None else taken.unionByName(part)
    taken = taken.join(F.broadcast(of_class), "_label")
    return docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(taken), "_id").select(F.col("_label").alias("label"), F.col("_n").alias("n"), F.xxhash64("_id").alias("order"), "text")


def fitted(rows: DataFrame, fit: Callable[[np.ndarray, np.ndarray, list[str]], bytes], most_bytes: int = MOST_BYTES) -> bytes:
    """fit(label, weight, text) in one task, over the rows of sample() in their order.

    Texts are whole; once those of a class have most_bytes / 2 its later ones are left
    out, so the task's memory is bounded whatever the texts.  `weight` undoes both
    bounds: the weighted class shares are those of all labelled training rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, texts, size, n = [], [], [0, 0], [0, 0]
        for batch in batches:
            for y, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                n[y] = k
                if 2 * size[y] < most_bytes:
                    t = t.as_py() or ""
                    size[y] += len(t)
                    label.append(y)
                    texts.append(t)
        y = np.array(label, np.int64)
        weight = np.array([n[0] / max(1, (y == 0).sum()), n[1] / max(1, (y == 1).sum())])[y] if len(y) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array([fit(y, weight, texts)], pa.binary())], ["model"])

    made = rows.repartition(1).sortWithinPartitions("order", "label", "text").mapInArrow(shared.lean(run), "model binary").collect()
    return bytes(made[0][0]) if made else b""
