"""N-gram Jaccard join by grouped prefixes, exact, and its connected components.

1.  Word shingles are counted in a sketch of SLOTS counters (fixed size) over all
    documents; a shingle far above the mean count is `frequent`.  The order
    (frequency class, hash) is the same everywhere, which is all that prefix
    filtering needs, and keeps passages that many documents share out of prefixes.
2.  Documents with identical prefixes and size fall into one group.  Every group is
    posted under its prefix shingles; postings meet by shingle.
3.  In a short posting list all group pairs that pass the size and position filters
    become candidates.  In a long one each group is first paired with one anchor.
4.  Candidates are expanded to the distinct sets of the two groups and verified, first
    against an exact bound by parity bitmaps, then on the whole sets: 100 *
    intersection >= percent * union.
5.  Long lists, large groups and pairs of groups that still hold several components
    are worked through in pieces, twice.  First every member gets its nearest partner by
    bitmap in another component.  Then the members that still have a possible partner
    in another component are gathered into clumps, the components of what the bitmaps
    leave possible, and each clump is verified on whole sets, piece against piece,
    joining components as it goes and giving only the links that join two.  So
    neither copies nor near copies are ever expanded into rows of pairs, and no link
    between different components is lost.
6.  Components by alternating large-star and small-star steps over verified links.

Texts are read by three narrow passes; only postings, candidate texts and ids are
shuffled.  Documents with equal sets are one node, named by the set's fingerprint.

Edge cases: a text without words (null, empty, blank) has the empty set, n_shingles 0
and links with nothing; a text of 1 to n-1 words is one shingle; rows that share a
doc_id are linked; a null doc_id is kept in its row and its text still links other
rows, but never names a component: component_id is null only where no row of the
component has an id; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import shared, textkernel as tk
from ledgerloom.llm.components import components

N, PERCENT = 5, 80
SLOT_BITS = 22
PARTS = 64
SHORT_LIST = 64
LONG_LIST = 4096
PIECE = 2048
#: Shingles in a piece of a clump: at least, at most, and pieces before they grow.
CLUMP_LEAST, CLUMP_MOST, CLUMP_PIECES = 1 << 17, 1 << 21, 64


def _least(size, percent: int):
    """ceil(percent% of size)."""
    return -(-np.asarray(size, np.int64) * percent // 100)


def _need(a, b, percent: int):
    """The least intersection of sets of sizes a and b that link."""
    return -(-(np.asarray(a, np.int64) + b) * percent // (100 + percent))


def ordered(values: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set in the global order: rare first, then by hash."""
    kind = classes[(values >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    if kind.any():
        return values[np.lexsort((values, kind))]
    return values


def group_of(prefix: np.ndarray, size: int) -> int:
    """Names the group of a prefix and a set size."""
    return tk.fingerprint(np.concatenate([np.sort(prefix), np.array([size], np.uint64)]))


# --- pass 1: the sketch


def _sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Document rows (doc_id, n, fp), then the task's counters (part, form, blob); a set that comes again is counted once."""
    total = np.zeros(1 << SLOT_BITS, np.uint32)
    seen: set[int] = set()
    names = ["doc_id", "n", "fp", "part", "form", "blob"]
    for batch in batches:
        sizes, fps = [], []
        for _, _, data, offs in tk.slices(batch.column(1)):
            fresh = []
            for s in tk.shingle_sets(tk.Words(data, offs), n):
                f = tk.fingerprint(s)
                sizes.append(len(s))
                fps.append(f)
                if f not in seen:
                    seen.add(f)
                    fresh.append(s)
            if fresh:
                slot = (np.concatenate(fresh) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                at, count = np.unique(slot, return_counts=True)
                total[at] += count.astype(np.uint32)
        k = len(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
    if not seen:
        return
    per = len(total) // PARTS
    for p in range(PARTS):
        piece = total[p * per : (p + 1) * per]
        at = np.flatnonzero(piece)
        dense = len(at) * 3 > per
        small = piece.max(initial=0) < 256
        if dense:
            blob = piece.astype(np.uint8).tobytes() if small else piece.tobytes()
        else:
            blob = np.array([len(at)], np.uint32).tobytes() + at.astype(np.uint32).tobytes() + piece[at].tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([p], pa.int32()), pa.array([(1 if small else 2) if dense else 0], pa.int32()), pa.array([blob], pa.binary())], names)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, form, blob in zip(*(c.to_pylist() for c in batch.columns)):
            mine = total.setdefault(p, np.zeros((1 << SLOT_BITS) // PARTS, np.uint64))
            if form:
                mine += np.frombuffer(blob, np.uint8 if form == 1 else np.uint32)
            else:
                k = int(np.frombuffer(blob, np.uint32, 1)[0])
                mine[np.frombuffer(blob, np.uint32, k, 4)] += np.frombuffer(blob, np.uint32, k, 4 + 4 * k)
    for p, mine in total.items():
        log = np.zeros(len(mine), np.uint8)
        full = mine > 0
        log[full] = np.floor(np.log2(mine[full].astype(float))).astype(np.uint8) + 1
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([float(mine.sum())]), pa.array([log.tobytes()], pa.binary())], ["part", "total", "log"])


def frequency_classes(counters: DataFrame) -> np.ndarray:
    """One byte a slot from (part, form, blob): 0 for ordinary shingles, else the base-2 order of a frequent one's count."""
    rows = counters.repartition(min(PARTS, shared.partitions(counters.sparkSession)), "part").mapInArrow(shared.lean(_merged), "part int, total double, log binary").collect()  # PARTS rows of a fixed size, 4 MB together
    per = (1 << SLOT_BITS) // PARTS
    out, count = np.zeros(1 << SLOT_BITS, np.uint8), 0.0
    for r in rows:
        out[r["part"] * per : (r["part"] + 1) * per] = np.frombuffer(r["log"], np.uint8)
        count += r["total"]
    mean = count / len(out)
    floor = max(5, math.floor(math.log2(mean)) + 3 if mean > 1 else 0)
    out[out < floor] = 0
    return out


# --- pass 2: postings


class _Outgoing:
    """Postings of a task, by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, group: int, size: int, prefix: np.ndarray) -> None:
        self.parts.append((group, size, prefix))
        self.size += len(prefix)

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        count = np.array([len(p) for _, _, p in self.parts], np.int64)
        token = np.concatenate([p for _, _, p in self.parts])
        own = np.repeat(np.arange(len(count)), count)
        pos = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
        group = np.array([g for g, _, _ in self.parts], np.uint64)
        size = np.array([s for _, s, _ in self.parts], np.uint32)
        bucket = (tk.mix(token) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            at = order[cut[b] : cut[b + 1]]
            if not len(at):
                continue
            mine, k = np.unique(own[at], return_counts=True)
            head = np.array([len(mine), len(at)], np.uint32).tobytes()
            yield b, head + group[mine].tobytes() + size[mine].tobytes() + k.astype(np.uint32).tobytes() + pos[at].astype(np.uint32).tobytes() + (token[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
        self.parts, self.size = [], 0


def decoded(blob: bytes) -> tuple[np.ndarray, ...]:
    """token, group, size, position of every posting of a blob."""
    m, k = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    at = 8
    group = np.frombuffer(blob, np.uint64, m, at)
    size = np.frombuffer(blob, np.uint32, m, at + 8 * m)
    count = np.frombuffer(blob, np.uint32, m, at + 12 * m)
    pos = np.frombuffer(blob, np.uint32, k, at + 16 * m)
    token = np.frombuffer(blob, np.uint32, k, at + 16 * m + 4 * k)
    return token, np.repeat(group, count), np.repeat(size, count), pos


def _postings(batches: Iterator[pa.RecordBatch], classes: np.ndarray, n: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Posting rows (bucket, blob), and member rows (bucket, grp, fp, blob: its bitmap) of the groups."""
    out, groups, seen = _Outgoing(buckets), set(), set()
    names = ["bucket", "grp", "fp", "blob"]

    def blobs() -> Iterator[pa.RecordBatch]:
        if out.parts:
            made = list(out.blobs())
            k = len(made)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([x for _, x in made], pa.binary())], names)

    for batch in batches:
        members, bits = [], []
        for _, _, data, offs in tk.slices(batch.column(1)):
            for s in tk.shingle_sets(tk.Words(data, offs), n):
                f = tk.fingerprint(s)
                if not len(s) or f in seen:
                    continue
                seen.add(f)
                prefix = ordered(s, classes)[: len(s) - int(_least(len(s), percent)) + 1]
                g = group_of(prefix, len(s))
                members.append((g, f))
                bits.append(parity(s))
                if g not in groups:
                    groups.add(g)
                    out.add(g, len(s), prefix)
        if members:
            m = np.array(members, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((m[:, 0] % np.uint64(buckets)).astype(np.int32)), pa.array(m[:, 0].copy().view(np.int64)), pa.array(m[:, 1].copy().view(np.int64)), pa.array(bits, pa.binary())], names)
        if out.size > 4_000_000:
            yield from blobs()
    yield from blobs()


# --- candidates


def _passes(a, b, i, j, percent: int):
    """May sets of sizes a <= b that meet at positions i and j of their orders be linked?"""
    short = i < a - _least(a * 2, 100 * percent // (100 + percent)) + 1
    return (a * 100 >= b * percent) & short & (np.minimum(a - i, b - j) >= _need(a, b, percent))


def passing(size: np.ndarray, pos: np.ndarray, percent: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (smaller, larger set) of a list in order of size that pass, by blocks of rows; with labels, of different ones only."""
    m = len(size)
    for first in range(0, m, 256):
        i = np.arange(first, min(m, first + 256))
        end = int(np.searchsorted(size * percent, size[i[-1]] * 100, "right"))
        j = np.arange(first, end)
        ok = _passes(size[i][:, None], size[j][None, :], pos[i][:, None], pos[j][None, :], percent) & (i[:, None] < j[None, :])
        if label is not None:
            ok &= label[i][:, None] != label[j][None, :]
        x, y = np.nonzero(ok)
        yield i[x], j[y]


def group_pairs(token: np.ndarray, group: np.ndarray, size: np.ndarray, pos: np.ndarray, percent: int, short: int = SHORT_LIST) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Distinct candidate pairs of groups, and the long lists (groups, sizes, positions) of which only anchors are among them.

    In a long list every group is paired with the smallest-named group that passes
    with it: as many pairs as groups, and enough when the list is one component.
    Beyond LONG_LIST the partner is the neighbour by size, so a list takes linear time.
    """
    size, pos = size.astype(np.int64), pos.astype(np.int64)
    order = np.lexsort((group, size, token))
    token, group, size, pos = token[order], group[order], size[order], pos[order]
    if not len(token):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), []
    fresh = np.r_[True, (token[1:] != token[:-1]) | (group[1:] != group[:-1])]
    token, group, size, pos = token[fresh], group[fresh], size[fresh], pos[fresh]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[first, len(token)])
    of = np.repeat(length, length)
    left, right, lists = [], [], []
    small = np.flatnonzero((of > 1) & (of <= short))
    for step in range(1, short):
        i = small[small + step < len(token)]
        i = i[token[i + step] == token[i]]
        if not len(i):
            break
        ok = _passes(size[i], size[i + step], pos[i], pos[i + step], percent)
        left.append(group[i[ok]])
        right.append(group[i[ok] + step])
    for f, m in zip(first[length > short], length[length > short]):
        g, z, p = group[f : f + m], size[f : f + m], pos[f : f + m]
        if m > LONG_LIST:  # neighbours by size, in time linear in the list
            i = np.flatnonzero(_passes(z[:-1], z[1:], p[:-1], p[1:], percent))
            left.append(g[i])
            right.append(g[i + 1])
            if (z[:-1] * 100 >= z[1:] * percent).any():
                lists.append((g, z, p))
            continue
        anchor = np.arange(m)
        name = np.argsort(np.argsort(g))
        some = False
        for i, j in passing(z, p, percent):
            some |= bool(len(i))
            best = np.full(m, m)
            np.minimum.at(best, i, name[j])
            np.minimum.at(best, j, name[i])
            anchor = np.where(best < name[anchor], np.argsort(name)[np.minimum(best, m - 1)], anchor)
        own = np.flatnonzero(anchor != np.arange(m))
        left.append(g[own])
        right.append(g[anchor[own]])
        if some:
            lists.append((g, z, p))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
    low, high = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([low, high], 1), axis=0) if len(low) else np.zeros((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1], lists


_MEMBER = pa.struct([("g", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])


def _meet(batches: Iterator[pa.RecordBatch], percent: int, short: int) -> Iterator[pa.RecordBatch]:
    """Buckets of a partition: candidate rows (g1, g2), long lists (g1, list), and member rows (g1, fp), each once."""
    names = ["g1", "g2", "fp", "bits", "list"]
    none = lambda k, *kinds: [pa.nulls(k, t) for t in kinds]
    lists_of = pa.list_(_MEMBER)
    blobs: dict[int, list[bytes]] = {}
    members: dict[tuple[int, int], bytes] = {}
    for batch in batches:
        for b, g, f, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if g is not None:
                members[g, f] = blob
            else:
                blobs.setdefault(b, []).append(blob)
    if members:
        m = np.array(list(members), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(m[:, 0].copy()), *none(len(m), pa.int64()), pa.array(m[:, 1].copy()), pa.array(list(members.values()), pa.binary()), *none(len(m), lists_of)], names)
        members.clear()
    for b in sorted(blobs):
        columns = [np.concatenate(c) for c in zip(*map(decoded, blobs.pop(b)))]
        left, right, lists = group_pairs(*columns, percent, short)
        k = len(left)
        if k:
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), *none(k, pa.int64(), pa.binary(), lists_of)], names)
        for g, z, p in lists:
            row = pa.StructArray.from_arrays([pa.array(g.view(np.int64)), pa.array(z.astype(np.int32)), pa.array(p.astype(np.int32))], fields=list(_MEMBER))
            name = tk.fingerprint(np.concatenate([np.sort(g), z.astype(np.uint64), p.astype(np.uint64)]))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.uint64()).view(pa.int64()), *none(1, pa.int64(), pa.int64(), pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(g)], pa.int32()), row)], names)


class _Bitmaps:
    """Bitmaps of sets in order of size, folded to each length that occurs."""

    def __init__(self, bits: list[bytes]):
        self.length = np.array([len(b) for b in bits], np.int64)
        self.first, self.rows = {}, {}
        for n in np.unique(self.length).tolist():
            first = int(np.searchsorted(self.length, n))
            rows = np.zeros((len(bits) - first, n), np.uint8)
            for r, b in enumerate(bits[first:]):
                x = np.frombuffer(b, np.uint8)
                while len(x) > n:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                rows[r] = x
            self.first[n], self.rows[n] = first, rows.view(np.uint64)

    def differ(self, i: int, j: np.ndarray) -> np.ndarray:
        """At least so many elements are in one of the sets i and j alone; j: later rows."""
        n = int(self.length[i])
        rows, first = self.rows[n], self.first[n]
        return np.bitwise_count(rows[j - first] ^ rows[i - first]).sum(axis=1, dtype=np.int64)


def _partners(size: np.ndarray, pos: np.ndarray | None, root: np.ndarray, side: np.ndarray, bits: list[bytes], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, later rows, differences) of sets in order of size: possible partners in other components by size, position and bitmap.

    `root` may change between rows.  Rows of one side are not compared if there are two.
    """
    m, maps = len(size), _Bitmaps(bits)
    two = m > 0 and side.min() != side.max()
    ends = np.searchsorted(size * percent, size * 100, "right")
    for i in range(m - 1):
        ok = root[i + 1 : ends[i]] != root[i]
        if two:
            ok &= side[i + 1 : ends[i]] != side[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j) and pos is not None:
            j = j[_passes(size[i], size[j], pos[i], pos[j], percent)]
        if not len(j):
            continue
        differ = maps.differ(i, j)
        keep = differ <= size[i] + size[j] - 2 * _need(size[i], size[j], percent)
        if keep.any():
            yield i, j[keep], differ[keep]


def _across(batches: Iterator[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of possible partners in different components, of two pieces (l1, l2) of a list; a null l2 pairs l1 with itself.

    With `nearest`, each member with the one that differs least.  Else as many pairs
    as span what is possible: whoever has a possible partner is in one of them.
    """
    for batch in batches:
        for one, two in zip(batch.column(0), batch.column(1)):
            parts = [x.values for x in (one, two) if x.is_valid]
            fp, size, pos, root = (np.concatenate([np.asarray(p.field(k)) for p in parts]) for k in range(4))
            bits = [b for p in parts for b in p.field(4).to_pylist()]
            side = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.lexsort((fp, size))
            fp, size, pos, root, side = fp[order], size[order].astype(np.int64), pos[order].astype(np.int64), root[order], side[order]
            bits = [bits[k] for k in order.tolist()]
            m = len(fp)
            best = np.full(m, np.iinfo(np.int64).max)
            clump = np.arange(m)
            left, right = [], []
            for i, j, differ in _partners(size, pos, root, side, bits, percent):
                if nearest:
                    far = (differ << 16) // (size[i] + size[j]) << 24
                    best[j] = np.minimum(best[j], far | i)
                    best[i] = min(best[i], int((far | j).min()))
                    continue
                for k in j[clump[j] != clump[i]].tolist():
                    if clump[k] != clump[i]:
                        clump[clump == clump[k]] = clump[i]
                        left.append(i)
                        right.append(k)
            if nearest:
                left = np.flatnonzero(best < np.iinfo(np.int64).max)
                right = best[left] & 0xFFFFFF
            if len(left):
                x, y = fp[left], fp[right]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["f1", "f2"])


def _clump(table: pa.Table, percent: int) -> pa.Table:
    """Links (f1, f2) that join the components of a clump's members (part, fp, root, bits, set), verified on whole sets."""
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
    size = np.array([len(x) for x in sets], np.int64)
    fp, root, part = (table.column(c).to_numpy() for c in ("fp", "root", "part"))
    order = np.lexsort((fp, size))
    bits, sets = table.column("bits").to_pylist(), [sets[k] for k in order.tolist()]
    bits = [bits[k] for k in order.tolist()]
    fp, size = fp[order], size[order]
    root = np.unique(root[order], return_inverse=True)[1]
    left, right = [], []
    for i, js, _ in _partners(size, None, root, part[order], bits, percent):
        for a in range(0, len(js), 1024):
            j = js[a : a + 1024]
            j = j[root[j] != root[i]]
            if not len(j):
                continue
            every = np.concatenate([sets[k] for k in j.tolist()])
            at = np.minimum(np.searchsorted(sets[i], every), size[i] - 1)
            common = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum(size[j]) - size[j])
            for k in j[100 * common >= percent * (size[i] + size[j] - common)].tolist():
                if root[k] != root[i]:
                    root[root == root[k]] = root[i]
                    left.append(i)
                    right.append(k)
    return pa.table([pa.array(fp[left], pa.int64()), pa.array(fp[right], pa.int64())], ["f1", "f2"])


def parity(values: np.ndarray) -> bytes:
    """A bitmap of a set, a power of two of at least twice its size long: each bit is the parity of the elements that fall on it."""
    bits = 64
    while bits < 2 * len(values):
        bits *= 2
    count = np.bincount((values >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """At least so many elements are in one of two sets alone."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offs in tk.slices(batch.column(0)):
            sets = tk.shingle_sets(tk.Words(data, offs), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([tk.fingerprint(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "set"])


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for enough common elements; exact, none that links is lost."""
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
        keep = [_differ(x, y) <= a + b - 2 * int(_need(a, b, percent)) for a, x, b, y in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["f1", "f2"]).filter(pa.array(keep, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["f1", "f2"]).filter(pa.array(keep, pa.bool_()))


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (f1, f2) that the bitmaps of their sets leave possible."""
    bits = lambda k: nodes.select(F.col("fp").alias(f"f{k}"), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}"))
    return pairs.join(bits(1), "f1").join(bits(2), "f2").select("f1", "f2", "n1", "b1", "n2", "b2").mapInArrow(shared.lean(lambda b: _possible(b, percent)), "f1 long, f2 long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (f1, f2) whose whole sets link."""
    whole = lambda k: sets.select(F.col("fp").alias(f"f{k}"), F.col("set").alias(f"s{k}")).join(pairs.select(f"f{k}").distinct(), f"f{k}", "left_semi")
    return pairs.join(whole(1), "f1").join(whole(2), "f2").select("f1", "f2", "s1", "s2").mapInArrow(shared.lean(lambda b: _verified(b, percent)), "f1 long, f2 long")


_ROW_BITS = 17


def _may_hold(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id may be among `ids`, by a bitmap of a fixed size (2 MB); narrow.

    What passes wrongly is left to the join after it; the bitmap only keeps most
    other texts out of the shuffle.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 24)).cast("int")
    rows = ids.select(slot("doc_id").alias("s")).distinct().groupBy(F.shiftright("s", _ROW_BITS).alias("r")).agg(F.collect_list(F.col("s").bitwiseAND((1 << _ROW_BITS) - 1)).alias("s"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                bits = np.zeros(1 << _ROW_BITS, np.uint8)
                bits[np.asarray(s.values)] = 1
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["r", "b"])

    every = np.zeros(1 << 24 - _ROW_BITS, object)
    every[:] = bytes((1 << _ROW_BITS) // 8)
    for r in rows.mapInArrow(shared.lean(pack), "r int, b binary").collect():
        every[r["r"]] = bytes(r["b"])
    held = docs.sparkSession.sparkContext.broadcast(b"".join(every))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            s = batch.column(2).to_numpy()
            yield batch.filter(pa.array((bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1).astype(bool))).select(["doc_id", "text"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", slot("doc_id").alias("_slot")).mapInArrow(shared.lean(keep), "doc_id long, text string")


def similarity_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, percent: int = PERCENT, short: int = SHORT_LIST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`."""
    return _classes(docs, text, doc_id, n, percent, short).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of every component, with all columns: one with the smallest doc_id, any of several such rows.

    Rows without words link with nothing and stay.  Of a component without any id one
    row stays.
    """
    classes = shared.written(_classes(docs, text, doc_id, n, percent), "classes")
    mark = shared.fresh(docs, "_class")
    key, wordy = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    linked_ids = classes.where("n_shingles > 0 AND doc_id IS NOT NULL")
    gone = linked_ids.where("component_id <> doc_id").select(F.col("doc_id").alias(mark)).distinct()
    held = docs.join(gone, (key.cast("long") == F.col(mark)) & wordy, "left_anti")
    # Several rows of the id that stays, and rows without an id: rare, so looked for first.
    again = linked_ids.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(mark))
    if again.limit(1).count():
        again = shared.written(again, "again")
        several = docs.join(again, (key.cast("long") == F.col(mark)) & wordy, "left_semi").groupBy(key.cast("long")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias(mark))
        held = held.join(again, (key.cast("long") == F.col(mark)) & wordy, "left_anti").unionByName(several.select(f"{mark}.*"))
    if classes.where("n_shingles > 0 AND doc_id IS NULL").limit(1).count():
        one = classes.where("n_shingles > 0 AND doc_id IS NULL AND component_id IS NULL").groupBy("root").agg(F.min("fp").alias(mark)).select(mark)

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = [tk.fingerprint(s) for _, _, data, offs in tk.slices(batch.column(batch.num_columns - 1)) for s in tk.shingle_sets(tk.Words(data, offs), n)]
                yield shared.appended(batch, pa.array(np.array(fps, np.uint64).view(np.int64)), fp)

        fp = shared.fresh(docs, "_fp")
        bare = shared.with_text(docs.where(key.isNull() & wordy), text, fp).mapInArrow(shared.lean(named), shared.schema_with(docs, fp, "long"))
        bare = bare.join(one, F.col(fp) == F.col(mark), "left_semi").groupBy(fp).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias(mark))
        held = held.where(key.isNotNull() | ~wordy).unionByName(bare.select(f"{mark}.*"))
    return held


def _classes(docs: DataFrame, text: str, doc_id: str, n: int, percent: int, short: int = SHORT_LIST) -> DataFrame:
    """similarity_classes() with the set (fp) and the component (root) of every row."""
    spark = docs.sparkSession
    buckets = shared.partitions(spark)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counted = shared.written(docs.mapInArrow(shared.lean(lambda b: _sketch(b, n)), "doc_id long, n int, fp long, part int, form int, blob binary"), "counted")
    rows = counted.where("n IS NOT NULL").select("doc_id", "n", "fp")
    held = spark.sparkContext.broadcast(frequency_classes(counted.where("part IS NOT NULL").select("part", "form", "blob")))
    met = docs.mapInArrow(shared.lean(lambda b: _postings(b, held.value, n, percent, buckets)), "bucket int, grp long, fp long, blob binary").repartition(buckets, "bucket").mapInArrow(shared.lean(lambda b: _meet(b, percent, short)), "g1 long, g2 long, fp long, bits binary, list array<struct<g:long,size:int,pos:int>>")
    met = shared.written(met, "candidates")
    groups = met.where("fp IS NOT NULL").select("fp", F.col("g1").alias("grp"), "bits")
    nodes = shared.written(rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")).join(groups, "fp"), "nodes")

    # Groups of one set are the rule; a larger group is a list of its own, and so is a pair that holds one.
    large = shared.written(nodes.groupBy("grp").agg(F.count("*").alias("k"), F.min("fp").alias("first")).where("k > 1"), "groups")
    pairs = met.where("g2 IS NOT NULL").select("g1", "g2").distinct()
    head = nodes.groupBy("grp").agg(F.min("fp").alias("f"))
    first = pairs.join(head.select(F.col("grp").alias("g1"), F.col("f").alias("f1")), "g1").join(head.select(F.col("grp").alias("g2"), F.col("f").alias("f2")), "g2").select("f1", "f2")
    inside = nodes.join(large, "grp").where("fp <> first").select(F.col("first").alias("f1"), F.col("fp").alias("f2"))
    with_large = pairs.join(large.select(F.col("grp").alias("g1")), "g1", "left_semi").unionByName(pairs.join(large.select(F.col("grp").alias("g2")), "g2", "left_semi")).distinct()
    lists = (
        met.where("list IS NOT NULL").dropDuplicates(["g1"]).select(F.col("g1").alias("list"), F.explode("list").alias("m")).select("list", F.col("m.g").alias("grp"), F.col("m.pos").alias("pos"))
        .unionByName(large.select(F.xxhash64("grp").alias("list"), "grp", F.lit(0).alias("pos")))
        .unionByName(with_large.select(F.xxhash64("g1", "g2").alias("list"), F.explode(F.array("g1", "g2")).alias("grp"), F.lit(0).alias("pos")))
    )
    tried = shared.written(possible(first.unionByName(inside).select(F.least("f1", "f2").alias("f1"), F.greatest("f1", "f2").alias("f2")).distinct(), nodes, percent), "pairs")

    def sets_of(fps: DataFrame) -> DataFrame:
        """(fp, set) of those fingerprints, each read from one row, and of some others."""
        reps = nodes.join(fps.distinct(), "fp", "left_semi").select("fp", F.col("rep").alias("doc_id"))
        known = reps.where("doc_id IS NOT NULL").select("doc_id").distinct()
        texts = _may_hold(docs, known).join(known, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select("text")
        if reps.where("doc_id IS NULL").limit(1).count():
            texts = texts.unionByName(docs.where("doc_id IS NULL").select("text").distinct())
        return shared.written(texts.mapInArrow(shared.lean(lambda b: _sets(b, n)), "fp long, set binary").dropDuplicates(["fp"]), "sets")

    ends = lambda these: these.select(F.explode(F.array("f1", "f2")).alias("fp"))
    edges = lambda these: these.select(F.col("f1").alias("a"), F.col("f2").alias("b"))

    def split(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The sets with the roots that the links give so far, and the pairs of pieces (l1, l2) of the lists that hold several."""
        roots = components(edges(links), 1)
        named = shared.written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "grp", "n", "bits", F.coalesce("root", "fp").alias("root")), "named")
        member = lists.join(named.select("grp", "fp", "root"), "grp")
        several = member.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("list", F.ceil(F.col("k") / PIECE).alias("pieces"))
        part = F.pmod(F.xxhash64("fp"), F.col("pieces"))
        open_ = lists.join(several, "list").join(named, "grp").groupBy("list", part.alias("part")).agg(F.collect_set(F.struct("fp", F.col("n").alias("size"), "pos", "root", "bits")).alias("l"))
        open_ = shared.written(open_, "open")
        alone = open_.select(F.col("l").alias("l1"), F.lit(None).cast(open_.schema["l"].dataType).alias("l2"))
        x, y = (open_.select("list", F.col("part").alias(f"p{i}"), F.col("l").alias(f"l{i}")) for i in (1, 2))
        between = x.join(y, "list").where("p1 < p2").select("l1", "l2")
        return named, alone.unionByName(between)

    links = shared.written(linked(tried, sets_of(ends(tried)), percent), "verified")
    same_id = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("f1"), F.max("fp").alias("_f")).where("f1 < _f").select("doc_id", "f1")
    same_id = rows.where("n > 0").join(same_id, "doc_id").where("fp <> f1").select("f1", F.col("fp").alias("f2"))
    links = shared.written(links.unionByName(same_id), "verified")
    # Lists whose members still lie in several components: first the nearest partner of each.
    _, pieces = split(links)
    more = shared.written(pieces.mapInArrow(shared.lean(lambda b: _across(b, percent, True)), "f1 long, f2 long").distinct().join(tried, ["f1", "f2"], "left_anti"), "pairs")
    if more.limit(1).count():
        links = links.unionByName(shared.written(linked(more, sets_of(ends(more)), percent), "verified"))
        # What is still apart and possible, clump by clump.
        named, pieces = split(links)
        may = shared.written(pieces.mapInArrow(shared.lean(lambda b: _across(b, percent, False)), "f1 long, f2 long").distinct(), "possible")
        if may.limit(1).count():
            links = links.unionByName(shared.written(_clumped(may, named, sets_of(ends(may)), percent), "verified"))
    roots = components(edges(links))
    named = shared.written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    last = rows.join(named, F.when(F.col("n") > 0, F.col("fp")) == F.col("_fp"), "left")
    return last.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "fp", "root")


def _clumped(may: DataFrame, named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (f1, f2) among the sets of each clump of possible pairs `may` that join different roots."""
    clumps = components(may.select(F.col("f1").alias("a"), F.col("f2").alias("b")))
    member = clumps.select(F.col("node").alias("fp"), F.col("root").alias("clump")).unionByName(clumps.select(F.col("root").alias("fp"), F.col("root").alias("clump")).distinct())
    member = shared.written(member.join(named.select("fp", "n", "root"), "fp"), "clumps")
    shingles = F.least(F.greatest(F.col("_n") / CLUMP_PIECES, F.lit(CLUMP_LEAST)), F.lit(CLUMP_MOST))
    pieces = member.groupBy("clump").agg(F.sum("n").alias("_n")).select("clump", F.ceil(F.col("_n") / shingles).cast("int").alias("pieces"))
    dealt = member.join(pieces, "clump").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    # A piece meets itself and every other one.
    pair = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("p1"), F.greatest(k, F.col("part")).alias("p2")))
    dealt = dealt.select("clump", "fp", "root", "part", F.explode(pair).alias("p")).select("clump", "p.*", "part", "fp", "root")
    whole = dealt.join(named.select("fp", "bits").join(sets, "fp"), "fp")
    return whole.groupBy("clump", "p1", "p2").applyInArrow(shared.lean_table(lambda t: _clump(t, percent)), "f1 long, f2 long")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: doc_id, n_shingles, component_id of every document."""
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
