"""Suffix-array dedup: repeated byte strings across documents by merging Burrows-Wheeler transforms.

A byte goes when some LENGTH-byte string that covers it also starts in a document with
a smaller doc_id; everything is judged on the input texts.

1.  Every LENGTH-byte window names an anchor: the smallest hash of its GRAM-byte
    pieces.  Equal windows have equal anchors, so all copies of a window meet under
    one anchor.  Anchors are exchanged as bare hashes by block of documents; those
    seen in one document only cannot hold a repeat across documents.
2.  The stretches of windows under the other anchors are cut out.  Equal stretches
    are collapsed within a block of documents before anything is shuffled, and again
    where they meet, keeping the smallest doc_id.
3.  Stretches of one anchor in different contexts form shards by block of documents.
    Each shard's Burrows-Wheeler transform is interleaved with the others by
    iterative refinement: a round deals the suffixes out in the order of the round
    before, which doubles the bytes that they are ordered by, and marks where
    neighbours begin to differ, which bounds their common prefix.  A round ranks the
    suffixes that are not settled yet anew, over all shards.  Once LENGTH bytes are
    read, the runs without a mark are the repeated intervals; each gets its smallest
    doc_id.
4.  The verdicts go back to the blocks, where covered bytes are counted and removed.

Texts are shuffled once, by block; the other exchanges carry hashes, stretches and
verdicts.  Anchors are independent, so buckets are worked through in pieces of
PIECE bytes.

Edge cases: null texts are empty and keep their row; texts under LENGTH bytes lose
nothing; rows with one doc_id never remove each other; a null doc_id neither removes
nor loses anything; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import shared, textkernel as tk

LENGTH, GRAM = 50, 24
PIECE = 1 << 18
SHARDS = 16
U32, U64 = np.uint32, np.uint64
_LOW = U64(0xFFFFFFFF)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each position: a weighted sum of them, by doubling, mixed at the end."""
    h, n = tk.BYTE_VALUE[data], 1
    while n < size:
        step = min(n, size - n)
        longer = h[: len(h) - step] * tk.SHINGLE_WEIGHT[n]
        longer += h[step:]
        h, n = longer, n + step
    return tk.mix(h)


def stretches(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, document, first window and number of windows of every stretch of equal anchors."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, U64), none, none, none
    m, n, wide = _gram_hashes(data, gram), 1, length - gram + 1
    while n < wide:
        step = min(n, wide - n)
        m = np.minimum(m[: len(m) - step], m[step:])
        n += step
    counts = np.maximum(np.diff(offs) - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(doc):
        return np.zeros(0, U64), none, none, none
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offs[:-1], counts)
    m = m[at]
    cut = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])])
    return m[cut], doc[cut], at[cut], np.diff(np.r_[cut, len(m)])


def _row_key(doc_id: int, text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8, key=str(doc_id).encode()).digest(), "little")


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (tk.mix(anchor ^ tk.SHINGLE_WEIGHT[7]) >> U64(33)).astype(np.int64) % buckets


# --- 1: anchors


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, blob) of distinct (anchor, block), with a flag where two documents of the batch share the anchor."""
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        a, d = [], []
        for i, _, data, offs in tk.slices(batch.column(2), 1 << 19):
            anchor, doc, _, _ = stretches(data, offs, length, gram)
            a.append(anchor)
            d.append(doc + i)
        if not a or not sum(map(len, a)):
            continue
        a, d = np.concatenate(a), np.concatenate(d)
        live = ~np.asarray(batch.column(1).is_null())[d]
        a, d = a[live], d[live]
        if not len(a):
            continue
        order = np.lexsort((d, a))
        a, d = a[order], d[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        last = np.r_[first[1:], len(a)] - 1
        shared_here = np.repeat(d[first] != d[last], last - first + 1)
        b = block[d].astype(U32)
        bucket = _bucket(a, buckets)
        order = np.lexsort((a & _LOW, b, bucket))
        bucket, b, h, flag = bucket[order], b[order], (a[order] & _LOW).astype(U32), shared_here[order]
        fresh = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (b[1:] != b[:-1]) | (h[1:] != h[:-1])])
        flag = np.logical_or.reduceat(flag, fresh)
        bucket, b, h = bucket[fresh], b[fresh], h[fresh]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        ids, blobs = [], []
        for k in range(buckets):
            s = slice(cut[k], cut[k + 1])
            if cut[k + 1] > cut[k]:
                own, count = np.unique(b[s], return_counts=True)
                ids.append(k)
                blobs.append(np.array([len(own), len(h[s])], U32).tobytes() + own.astype(U32).tobytes() + count.astype(U32).tobytes() + h[s].tobytes() + np.packbits(flag[s]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    held: dict[int, list] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(row[0], []).append(row[1:])
    for k in sorted(held):
        yield k, held.pop(k)


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bucket, hashes): the anchors of a block that some other document has too."""
    for bucket, blobs in _by_bucket(batches):
        hs, bs, fs = [], [], []
        for (blob,) in blobs:
            m, k = (int(x) for x in np.frombuffer(blob, U32, 2))
            bs.append(np.repeat(np.frombuffer(blob, U32, m, 8), np.frombuffer(blob, U32, m, 8 + 4 * m)))
            hs.append(np.frombuffer(blob, U32, k, 8 + 8 * m))
            fs.append(np.unpackbits(np.frombuffer(blob, np.uint8, -1, 8 + 8 * m + 4 * k), count=k).astype(bool))
        h, b, f = np.concatenate(hs), np.concatenate(bs), np.concatenate(fs)
        order = np.argsort(h, kind="stable")
        h, b, f = h[order], b[order], f[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        keep = np.repeat((size > 1) | np.logical_or.reduceat(f, first), size)
        h, b = h[keep], b[keep]
        order = np.lexsort((h, b))
        h, b = h[order], b[order]
        blocks, cut = np.unique(b, return_index=True)
        parts = np.split(h, cut[1:]) if len(blocks) else []
        yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array([bucket] * len(blocks), pa.int32()), pa.array([np.unique(p).tobytes() for p in parts], pa.binary())], ["block", "bucket", "blob"])


# --- 2: stretches


def _cut_out(docs: pa.Table, wanted: pa.Table, length: int, gram: int, buckets: int) -> pa.Table:
    """(bucket, block, blob): the distinct stretches of a block under the wanted anchors, with their places."""
    names = ["bucket", "block", "blob"]
    kinds = [pa.int32(), pa.int32(), pa.binary()]
    keys = [np.frombuffer(x.as_py(), U32).astype(U64) | U64(k.as_py()) << U64(32) for k, x in zip(wanted.column("bucket"), wanted.column("blob"))]
    if not keys or not docs.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names)
    keys = np.sort(np.concatenate(keys))
    block = docs.column("block")[0].as_py()
    ids = docs.column("doc_id").to_pylist()
    out: dict[int, list] = {}
    seen: dict[bytes, list] = {}
    rows: dict[int, int] = {}
    for i, _, data, offs in tk.slices(docs.column("text"), 1 << 19):
        anchor, doc, at, windows = stretches(data, offs, length, gram)
        if not len(anchor):
            continue
        bucket = _bucket(anchor, buckets)
        mine = (anchor & _LOW) | bucket.astype(U64) << U64(32)
        hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, mine), len(keys) - 1)] == mine)
        raw = data.tobytes()
        start = offs.tolist()
        for a, d, p, w, b in zip(anchor[hit].tolist(), doc[hit].tolist(), at[hit].tolist(), windows[hit].tolist(), bucket[hit].tolist()):
            doc_id = ids[i + d]
            if doc_id is None:
                continue
            key = rows.get(i + d)
            if key is None:
                key = rows[i + d] = _row_key(doc_id, raw[start[d] : start[d + 1]])
            s = raw[p : p + w + length - 1]
            entry = seen.get(s)
            if entry is None:
                seen[s] = entry = [a, doc_id, []]
                out.setdefault(b, []).append((s, entry))
            elif doc_id < entry[1]:
                entry[1] = doc_id
            entry[2].append((key, p - start[d]))
    made = []
    for b, parts in out.items():
        places = [x for _, e in parts for x in e[2]]
        blob = (
            np.array([len(parts), len(places)], U32).tobytes()
            + np.array([e[0] for _, e in parts], U64).tobytes()
            + np.array([e[1] for _, e in parts], np.int64).tobytes()
            + np.array([x[0] for x in places], U64).tobytes()
            + np.array([len(s) for s, _ in parts], U32).tobytes()
            + np.array([len(e[2]) for _, e in parts], U32).tobytes()
            + np.array([x[1] for x in places], U32).tobytes()
            + b"".join(s for s, _ in parts)
        )
        made.append((b, block, blob))
    return pa.table([pa.array([m[c] for m in made], t) for c, t in enumerate(kinds)], names)


def _stretch_blob(blob: bytes) -> tuple:
    """anchors, doc ids, row keys, lengths, numbers of places, offsets and bytes of a blob of _cut_out."""
    m, k = (int(x) for x in np.frombuffer(blob, U32, 2))
    at, out = 8, []
    for kind, n in ((U64, m), (np.int64, m), (U64, k), (U32, m), (U32, m), (U32, k)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return (*out, blob[at:])


# --- 3: transforms


def transform(strings: list[bytes], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a shard, and the place of each suffix in its joined strings.

    Suffixes are ordered by their first `depth` bytes at least.  A byte is its value + 1;
    0 ends a string.  UTF-8 has no byte 255, so values fit in a byte.
    """
    size = np.array([len(s) for s in strings], np.int64)
    joined = np.zeros(int(size.sum()) + len(strings), np.uint8)
    end = np.cumsum(size + 1) - 1
    body = np.ones(len(joined), bool)
    body[end] = False
    joined[body] = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    n = len(joined)
    padded = np.zeros(n + depth + 16, U64)
    padded[:n] = joined
    left = np.repeat(end, size + 1) - np.arange(n)  # bytes before the end of the string
    word = np.zeros(n + depth + 8, U64)
    for k in range(8):
        word |= padded[k : k + len(word)] << U64(56 - 8 * k)
    # Ends have no bytes and come first, in the order of their strings; then suffixes by content,
    # eight bytes at a time for those that are still equal.
    order, tied, group = np.arange(n), np.arange(n), np.zeros(n, np.int64)
    for first in range(0, depth, 8):
        at = order[tied]
        rest = np.clip(left[at] - first, 0, 8)  # bytes of this key that belong to the string
        key = word[at + first] & np.where(rest > 0, ~U64(0) << (U64(8) * (8 - np.maximum(rest, 1)).astype(U64)), U64(0))
        dealt = np.lexsort((key, group))
        order[tied], key = at[dealt], key[dealt]
        new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
        again = ~(new & np.r_[new[1:], True]) & (key > 0)
        group = np.cumsum(new)[again]
        tied = tied[again]
        if not len(tied):
            break
    before = np.r_[np.uint8(0), joined[:-1]]
    return before[order], order


def interleave(transforms: list[np.ndarray], ends: list[int], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms: the suffixes (numbered shard by shard) in their common order, and how far each agrees with the one before.

    The first round reads all transforms once and deals the suffixes before them out by
    the byte read, which orders suffixes by one byte; within a shard the k-th of a byte
    is the k-th suffix that begins with it.  A further round reads the order by h bytes
    and deals the suffixes h bytes longer out within their intervals, which orders them
    by 2h bytes; 50 bytes take seven rounds.  An interval of one suffix is settled and
    is dealt no more, so suffixes are never compared as strings or sorted again.  The
    depth at which an interval divides is what its parts have in common, to the round:
    at most their common prefix, and `depth` where they never divide.
    """
    total, head = sum(map(len, transforms)), int(sum(ends))
    every = np.concatenate(transforms)
    one = np.zeros(total, np.int32)  # the suffix one byte longer; -1 before a string's first
    ending = np.empty(head, np.int32)
    at = k = 0
    for t, n in zip(transforms, ends):
        one[at + np.argsort(t, kind="stable")] = np.arange(at, at + len(t), dtype=np.int32)
        ending[k : k + n] = np.arange(at, at + n)
        at, k = at + len(t), k + n
    one[every == 0] = -1
    body = np.ones(total, bool)
    body[ending] = False
    order = np.concatenate([ending, np.flatnonzero(body).astype(np.int32)])
    read = every[order]
    dealt = np.argsort(read, kind="stable")[head:]
    order[head:] = one[order[dealt]]
    read = read[dealt]
    new = np.ones(total, bool)
    new[head + 1 :] = read[1:] != read[:-1]
    lcp = np.where(new, 0, depth).astype(np.uint8)
    longer = {1: one}  # the suffix so many bytes longer
    place, first = np.arange(total, dtype=np.int32), np.empty(total, np.int32)
    known = 1
    while known < depth:
        start = np.maximum.accumulate(np.where(new, place, 0))
        first[order] = start
        many = ~(new & np.r_[new[1:], True])  # positions in intervals of several suffixes
        if not many.any():
            break
        if known > 1:
            longer[known] = _farther(longer[known // 2], longer[known // 2])
        step = min(known, depth - known)
        ahead = None
        for power in longer:
            if step & power:
                ahead = longer[power] if ahead is None else _farther(ahead, longer[power])
        unsettled = np.zeros(total + 1, bool)  # by suffix; the last for none
        unsettled[order[many]] = True
        x = ahead[order]
        source = np.flatnonzero(unsettled[x])
        x = x[source]
        dealt = first[x].astype(np.int64) << 32 | source  # interval, then the order read
        dealt.sort()
        source = dealt & 0xFFFFFFFF
        interval = start[source]
        spot = np.flatnonzero(many)
        fresh = spot[1:][(interval[1:] != interval[:-1]) & ~new[spot[1:]]]
        order[spot] = ahead[order[source]]
        new[fresh] = True
        lcp[fresh] = known
        known += step
    return order, lcp


def _farther(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The steps of `a`, then those of `b`; -1 stays."""
    out = b[a]
    out[a < 0] = -1
    return out


def smallest_holders(shards: list[tuple[list[bytes], np.ndarray]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string, shard by shard: runs of its windows with the smallest id among the strings that hold each.

    Gives the number of runs of each string, their lengths and their ids.  A shard is
    (strings, ids).  This is the merged transforms' reading: neighbouring suffixes
    whose common prefix reaches `length` are one repeated interval.
    """
    made = [transform(strings, length) for strings, _ in shards]
    order, lcp = interleave([t for t, _ in made], [len(strings) for strings, _ in shards], length)
    size = np.array([len(s) + 1 for strings, _ in shards for s in strings])
    ids = np.concatenate([i for _, i in shards])
    # Suffix numbers to places in the joined strings of all shards.
    bases = np.cumsum([0, *(len(t) for t, _ in made)])
    place = np.concatenate([p + base for (_, p), base in zip(made, bases)])
    owner = np.repeat(ids, size)
    run = np.cumsum(lcp < length) - 1
    cut = np.flatnonzero(lcp < length)
    least = np.minimum.reduceat(owner[place[order]], cut)
    found = np.empty(len(order), np.int64)
    found[place[order]] = least[run]
    windows = size - length
    string = np.repeat(np.arange(len(size)), windows)
    at = np.arange(len(string)) + np.repeat(np.cumsum(size) - size - (np.cumsum(windows) - windows), windows)
    value = found[at]
    cut = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (string[1:] != string[:-1])])
    return np.bincount(string[cut], minlength=len(size)), np.diff(np.r_[cut, len(value)]), value[cut]


def _judge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(block, blob): for every place of every stretch, runs of windows with their smallest doc_id."""
    for _, rows in _by_bucket(batches):
        blobs = [(block, _stretch_blob(blob)) for block, blob in sorted(rows)]
        content: dict[bytes, int] = {}
        strings: list[bytes] = []
        named: list[np.ndarray] = []
        fresh: list[int] = []
        for _, (_, _, _, sizes, _, _, data) in blobs:
            at, mine, n0 = 0, [], len(strings)
            for n in sizes.tolist():
                x = data[at : at + n]
                at += n
                k = content.setdefault(x, len(strings))
                if k == len(strings):
                    strings.append(x)
                mine.append(k)
            named.append(np.array(mine, np.int64))
            fresh.append(len(strings) - n0)
        content.clear()
        every = np.concatenate(named)
        low = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(low, every, np.concatenate([b[1] for _, b in blobs]))
        anchor = np.empty(len(strings), U64)
        anchor[every] = np.concatenate([b[0] for _, b in blobs])
        home = np.repeat(np.arange(len(blobs)), fresh) * SHARDS // len(blobs)
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        order = np.argsort(anchor, kind="stable")
        first = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
        alone = np.diff(np.r_[first, len(order)]) == 1
        # One context: all copies are this stretch, and its smallest holder is known.
        lone = order[first[alone]]
        count = np.zeros(len(strings), np.int64)
        start = np.zeros(len(strings), np.int64)
        count[lone], start[lone] = 1, np.arange(len(lone))
        spans, lows, made = [size[lone] - length + 1], [low[lone]], len(lone)
        # The others in pieces of whole anchors, their strings by shard.
        group = np.repeat(np.cumsum(~alone) - 1, np.diff(np.r_[first, len(order)]))
        many = order[np.repeat(~alone, np.diff(np.r_[first, len(order)]))]
        if len(many):
            total = np.cumsum(size[many])
            g = group[np.repeat(~alone, np.diff(np.r_[first, len(order)]))]
            last = np.flatnonzero(np.r_[g[1:] != g[:-1], True])
            cuts, held = [0], 0
            for e in last.tolist():
                if total[e] - held >= PIECE:
                    cuts.append(e + 1)
                    held = total[e]
            if cuts[-1] != len(many):
                cuts.append(len(many))
            for a, b in zip(cuts[:-1], cuts[1:]):
                piece = many[a:b]
                piece = piece[np.argsort(home[piece], kind="stable")]
                parts = np.split(piece, np.flatnonzero(np.diff(home[piece])) + 1)
                n, span, ids = smallest_holders([([strings[k] for k in p.tolist()], low[p]) for p in parts], length)
                count[piece] = n
                start[piece] = made + np.cumsum(n) - n
                spans.append(span)
                lows.append(ids)
                made += len(span)
        span, ids = np.concatenate(spans).astype(U32), np.concatenate(lows)
        for (block, (_, _, keys, _, places, offsets, _)), mine in zip(blobs, named):
            n = count[mine]
            run = np.repeat(start[mine], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            blob = (
                np.array([len(mine), len(keys), len(run)], U32).tobytes() + keys.tobytes() + ids[run].tobytes()
                + places.tobytes() + offsets.tobytes() + n.astype(U32).tobytes() + span[run].tobytes()
            )
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([blob], pa.binary())], ["block", "blob"])


# --- 4: removal


def _covered(docs: pa.Table, verdicts: pa.Table, length: int) -> Iterator[tuple[int | None, bytes, np.ndarray]]:
    """(doc_id, text, removed bytes as a mask) of every document of a block."""
    keys, starts, spans, least = [], [], [], []
    for blob in verdicts.column("blob"):
        blob = blob.as_py()
        m, k, r = (int(x) for x in np.frombuffer(blob, U32, 3))
        at, parts = 12, []
        for kind, n in ((U64, k), (np.int64, r), (U32, m), (U32, k), (U32, m), (U32, r)):
            parts.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        key, low, places, offset, count, span = (x if x.dtype == U64 else x.astype(np.int64) for x in parts)
        # Runs of each stretch, repeated for each of its places.
        stretch = np.repeat(np.arange(m), places)
        first = np.cumsum(count) - count
        n = count[stretch]
        run = np.repeat(first[stretch], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        within = np.cumsum(span) - span
        keys.append(np.repeat(key, n))
        starts.append(np.repeat(offset, n) + within[run] - np.repeat(within[first[stretch]], n))
        spans.append(span[run])
        least.append(low[run])
    if keys:
        key, start, span, low = (np.concatenate(x) for x in (keys, starts, spans, least))
        order = np.argsort(key, kind="stable")
        key, start, span, low = key[order], start[order], span[order], low[order]
    else:
        key = np.zeros(0, U64)
    for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, np.int32)
        if doc_id is not None and len(data) >= length and len(key):
            mine = U64(_row_key(doc_id, data))
            a, b = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
            hit = np.flatnonzero(low[a:b] < doc_id) + a
            if len(hit):
                np.add.at(gone, start[hit], 1)
                np.add.at(gone, start[hit] + span[hit] + length - 1, -1)
        yield doc_id, data, np.cumsum(gone[:-1]) > 0


def _removed(docs: pa.Table, verdicts: pa.Table, length: int, with_text: bool) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
    rows = []
    for doc_id, data, mask in _covered(docs, verdicts, length):
        kept = np.frombuffer(data, np.uint8)[~mask].tobytes() if mask.any() else data
        spans = int(np.count_nonzero(mask & ~np.r_[False, mask[:-1]])) if len(mask) else 0
        rows.append((doc_id, len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of `docs`."""
    spark = docs.sparkSession
    buckets = shared.partitions(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(4 * buckets)).cast("int").alias("block"), "doc_id", "text")
    several = rows.mapInArrow(shared.lean(lambda b: _anchors(b, length, gram, buckets)), "bucket int, blob binary").repartition(buckets, "bucket").mapInArrow(shared.lean(_several), "block int, bucket int, blob binary")
    by_block = rows.groupBy("block")
    cut = by_block.cogroup(several.groupBy("block")).applyInArrow(lambda x, y: _cut_out(x, y, length, gram, buckets), "bucket int, block int, blob binary")
    judged = cut.repartition(buckets, "bucket").mapInArrow(shared.lean(lambda b: _judge(b, length)), "block int, blob binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return by_block.cogroup(judged.groupBy("block")).applyInArrow(lambda x, y: _removed(x, y, length, with_text), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: what every document loses to documents with smaller ids."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
