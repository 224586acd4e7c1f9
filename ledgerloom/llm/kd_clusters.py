"""Centroid clustering: exact k-means over integer components by kd-tree filtering.

1.  Vectors of the right length without null or non-finite components become integers,
    floor(SCALE * component).
2.  Each partition of them is turned into kd-trees of BLOCK vectors at most, written
    once to the shared folder.  A node holds its count, the integer sums and the box
    of its vectors.
3.  A round walks every tree level by level with the candidate centroids of each node.
    A centroid that is farther than another from the box's corner most in its favour
    is farther from every vector of the box, and is pruned; a node with one candidate
    left is assigned whole by its count and sums; leaves are resolved vector by vector.
    Each task sends one row a centroid on, Spark sums them, and the new centroids
    (CENTROIDS x COMPONENTS integers, whatever the input) come back to the driver.
4.  The last pass assigns the vectors and measures their distances.

The trees never change, so a round reads them once and shuffles CENTROIDS rows a task.
All comparisons that decide are in integers; the choice of the centroid that others
are compared with is free, and made in floating point.

Edge cases: vectors that are null, of another length, or with a null, NaN or infinite
component are left out; a component beyond LIMIT / SCALE counts as that limit, since
squared distances must fit a long; repeated rows are vectors of their own and equal
vectors share a cluster; a null vec_id is kept and drawn as the text `3:`; ids drawn
alike are told apart by their components; fewer vectors than centroids leave fewer
centroids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import shared

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BLOCK, LEAF = 4096, 32
LIMIT = 1 << 27
_FAR = np.iinfo(np.int64).max

#: The arrays of a tree: vectors, then nodes in breadth-first order (first and end vector, first child or -1, boxes, sums).
_ARRAYS = {"points": np.int32, "first": np.int32, "end": np.int32, "child": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}


def quantized(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that count, as integers."""
    raw = F.col(f"`{vector}`")
    sound = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(raw, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return vectors.where((F.size(raw) == components) & sound).select(F.col(f"`{vec_id}`").alias("vec_id"), whole.alias("v"))


def first_centroids(kept: DataFrame, number: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in the order of those hashes."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(drawn.alias("_h"), "v").orderBy("_h", "v").limit(number).collect()
    return np.array([r["v"] for r in rows], np.int64)


# --- 2: trees


def tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points in the tree and its arrays: nodes are halved at the median of their widest side."""
    order = np.arange(len(points))
    first, end, child, low, high, sums = [0], [len(points)], [], [], [], []
    node = 0
    while node < len(first):
        a, b = first[node], end[node]
        mine = points[order[a:b]]
        lo, hi = mine.min(axis=0), mine.max(axis=0)
        low.append(lo)
        high.append(hi)
        sums.append(mine.sum(axis=0, dtype=np.int64))
        if b - a <= leaf or (lo == hi).all():
            child.append(-1)
        else:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(mine[:, int((hi - lo).argmax())], half)]
            child.append(len(first))
            first += [a, a + half]
            end += [a + half, b]
        node += 1
    return order, {"points": points[order], "first": np.array(first), "end": np.array(end), "child": np.array(child), "low": np.array(low), "high": np.array(high), "sums": np.array(sums)}


def _trees(batches: Iterator[pa.RecordBatch], block: int, leaf: int) -> Iterator[pa.RecordBatch]:
    """One row a tree: the ids of its vectors, and its arrays as bytes."""

    def built(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        order, arrays = tree(np.concatenate(rows), leaf)
        ids = pa.concat_arrays(ids).take(pa.array(order))
        listed = pa.ListArray.from_arrays([0, len(ids)], ids)
        return pa.RecordBatch.from_arrays([listed, *(pa.array([arrays[k].astype(t).tobytes()], pa.binary()) for k, t in _ARRAYS.items())], ["ids", *_ARRAYS])

    ids, rows, held = [], [], 0
    for batch in batches:
        values = batch.column(1)
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(values), -1)
        at = 0
        while at < len(flat):
            more = min(block - held, len(flat) - at)
            ids.append(batch.column(0).slice(at, more))
            rows.append(flat[at : at + more])
            at, held = at + more, held + more
            if held == block:
                yield built(ids, rows)
                ids, rows, held = [], [], 0
    if held:
        yield built(ids, rows)


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            arrays = {k: np.frombuffer(batch.column(c)[i].as_py(), t).astype(np.int64) for c, (k, t) in enumerate(_ARRAYS.items(), 1)}
            for k in ("points", "low", "high", "sums"):
                arrays[k] = arrays[k].reshape(-1, width)
            yield batch.column(0)[i].values, arrays


# --- 3: filtering


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every centroid, exact."""
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def filtered(t: dict[str, np.ndarray], centroids: np.ndarray, cluster: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums by centroid of a tree's vectors; also their centroids, if `cluster` is given to be filled."""
    k = len(centroids)
    count, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
    node, open_ = np.array([0]), np.ones((1, k), bool)
    while len(node):
        low, high = t["low"][node], t["high"][node]
        # Any candidate may be the one that others are compared with; the one nearest to the middle prunes most.
        middle = (low + high) / 2
        far = np.stack([((middle - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        far[~open_] = np.inf
        best = far.argmin(axis=1)
        near = centroids[best]
        for j, c in enumerate(centroids):
            corner = np.where(c > near, high, low)
            open_[:, j] &= ~(((corner - c) ** 2).sum(axis=1) > ((corner - near) ** 2).sum(axis=1))
        whole = open_.sum(axis=1) == 1
        size = t["end"][node] - t["first"][node]
        np.add.at(count, best[whole], size[whole])
        np.add.at(sums, best[whole], t["sums"][node[whole]])
        if cluster is not None:
            for n, j in zip(node[whole].tolist(), best[whole].tolist()):
                cluster[t["first"][n] : t["end"][n]] = j
        leaf = ~whole & (t["child"][node] < 0)
        if leaf.any():
            length = size[leaf]
            at = np.arange(int(length.sum())) + np.repeat(t["first"][node[leaf]] - (np.cumsum(length) - length), length)
            mine = t["points"][at]
            apart = _distances(mine, centroids)
            apart[~np.repeat(open_[leaf], length, axis=0)] = _FAR
            nearest = apart.argmin(axis=1)
            count += np.bincount(nearest, minlength=k)
            np.add.at(sums, nearest, mine)
            if cluster is not None:
                cluster[at] = nearest
        down = ~whole & ~leaf
        left = t["child"][node[down]]
        node, open_ = np.concatenate([left, left + 1]), np.concatenate([open_[down], open_[down]])
    return count, sums


def _gathered(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cluster, n, sums) of all trees of a task."""
    count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for _, t in _read(batches, centroids.shape[1]):
        n, s = filtered(t, centroids)
        count += n
        sums += s
    had = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(had.astype(np.int32)), pa.array(count[had]), pa.array(sums[had].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(vec_id, cluster, distance) of all vectors of a task."""
    for ids, t in _read(batches, centroids.shape[1]):
        cluster = np.zeros(len(t["points"]), np.int64)
        filtered(t, centroids, cluster)
        distance = ((t["points"] - centroids[cluster]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])


def clusters(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, number: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that counts, as a written table, and the final centroids."""
    kept = shared.written(quantized(vectors, vec_id, vector, components, scale), "vectors")
    kind = kept.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(kept, number, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids
    trees = shared.written(kept.mapInArrow(shared.lean(lambda b: _trees(b, BLOCK, LEAF)), f"ids array<{kind}>, " + ", ".join(f"{k} binary" for k in _ARRAYS)), "trees")
    for _ in range(rounds):
        gathered = trees.mapInArrow(shared.lean(lambda b, c=centroids: _gathered(b, c)), "cluster int, n long, sums array<long>")
        total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(components)]
        centroids = centroids.copy()
        for r in gathered.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():  # a row a centroid
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(components)]
    final = centroids
    return shared.written(trees.mapInArrow(shared.lean(lambda b: _assigned(b, final)), f"vec_id {kind}, cluster int, distance long"), "clusters"), final


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every vector with the inertia of its cluster and of all, and the digest of its centroid; null where a sum is no long."""
    rows = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a centroid
    inertia = {r["cluster"]: int(r["s"]) for r in rows}
    fits = lambda n: n if n < 1 << 63 else None
    table = [(j, fits(n), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in inertia.items()]
    of = assigned.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the cluster of every sound vector."""
    return report(*clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
