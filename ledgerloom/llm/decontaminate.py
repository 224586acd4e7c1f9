"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Words are compared by their letters and digits, folded.  Seeds are all SEED-word
n-grams of the benchmark items, however many items share them (an item with fewer
words seeds with its whole sequence).  Whole documents are searched for seeds; hits of
one item near one diagonal make a window, and the window is aligned with the item
(match +2, mismatch -1, gap -1) unless too few of its words occur in the item for the
score asked; where no window is a full copy, windows as wide as the gaps that the score
allows are aligned, so words put into a copy do not hide it.  A document holds an item when the best alignment scores at least `least`
of the score of a full copy.

The benchmark is a stated query set: it is taken in blocks of at most BLOCK_BYTES
of text, each indexed on the driver and broadcast, and every block scans all
documents; the usual benchmark is one block, and the blocks do not change what is
found.  There is no shuffle and no limit on hits, items or text length; hits are worked
through in groups of about HITS_AT_ONCE.

Edge cases: null or empty texts hold nothing; null or wordless items are never held;
items that are equal are all reported; a repeated document row is reported for each
row; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import shared, textkernel as tk
from ledgerloom.llm.quality_classifier import _CLASS

SEED = 4
LEAST = 0.45
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
PAD = 8
HITS_AT_ONCE = 1 << 18
_BITS = 22
_ALNUM = np.where((_CLASS & 7) > 0, tk.FOLDED_VALUE, np.uint64(0)).astype(np.uint64)

# Two-byte UTF-8 capitals (lead byte, first and last second byte) and their small letters (lead byte, first second byte).
CAPITALS = (
    (0xC3, 0x80, 0x96, 0xC3, 0xA0), (0xC3, 0x98, 0x9E, 0xC3, 0xB8),  # Latin
    (0xCE, 0x91, 0x9F, 0xCE, 0xB1), (0xCE, 0xA0, 0xA9, 0xCF, 0x80),  # Greek
    (0xD0, 0x80, 0x8F, 0xD1, 0x90), (0xD0, 0x90, 0x9F, 0xD0, 0xB0), (0xD0, 0xA0, 0xAF, 0xD1, 0x80),  # Cyrillic
)


_LEAD = np.isin(np.arange(256), [c[0] for c in CAPITALS])


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with capitals of CAPITALS made small, in as many bytes; A-Z are folded by their hash."""
    at = np.flatnonzero(_LEAD[data[:-1]]) if len(data) else []
    if not len(at):
        return data
    lead, second, out = data[at], data[at + 1], data.copy()
    for capital, first, last, small, begin in CAPITALS:
        mine = (lead == capital) & (second >= first) & (second <= last)
        out[at[mine]] = small
        out[at[mine] + 1] = second[mine] - first + begin
    return out


def index(items: list[tuple[int, str | None]], seed: int = SEED) -> dict:
    """Sorted seeds with the items and positions that have them, by n-gram size."""
    items = [(i, t) for i, t in items if t]
    texts = pa.array([t for _, t in items], pa.large_string())
    hashes: list[np.ndarray] = []
    for _, _, data, offs in tk.slices(texts):
        w = tk.Words(folded(data), offs)
        h = w.hashes(_ALNUM)
        hashes += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    seeds: dict[int, list[tuple[int, int, int]]] = {}
    for k, h in enumerate(hashes):
        n = min(seed, len(h))
        for p in range(len(h) - n + 1 if n else 0):
            g = int(tk.mix((h[p : p + n] * tk.SHINGLE_WEIGHT[:n]).sum(dtype=np.uint64, keepdims=True))[0])
            seeds.setdefault(n, []).append((g, k, p))
    grams, item, pos, base = {}, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for n, rows in seeds.items():
        g = np.array([r[0] for r in rows], np.uint64)
        k, p = (np.array([r[c] for r in rows], np.int64) for c in (1, 2))
        order = np.lexsort((p, k, g))
        value, first = np.unique(g[order], return_index=True)
        grams[n] = (value, base + first, base + np.r_[first[1:], len(g)])
        item.append(k[order])
        pos.append(p[order])
        base += len(g)
    return {"ids": [i for i, _ in items], "words": hashes, "grams": grams, "item": np.concatenate(item), "pos": np.concatenate(pos)}


def _tables(idx: dict) -> dict[int, np.ndarray]:
    out = {}
    for n, (value, *_) in idx["grams"].items():
        t = np.zeros(1 << _BITS, bool)
        t[(value & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        out[n] = t
    return out


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair, all pairs at once, row by row."""
    if not items:
        return np.zeros(0, np.int32)
    m, w = max(map(len, items)), max(map(len, windows))
    a = np.zeros((len(items), m), np.uint64)
    b = np.zeros((len(items), w), np.uint64)
    live, there = np.zeros((len(items), m), bool), np.zeros((len(items), w), bool)
    for r, (x, y) in enumerate(zip(items, windows)):
        a[r, : len(x)], b[r, : len(y)] = x, y
        live[r, : len(x)], there[r, : len(y)] = True, True
    slope = np.arange(w, dtype=np.int32) * GAP
    row = np.zeros((len(items), w), np.int32)
    best = np.zeros(len(items), np.int32)
    for i in range(m):
        same = (b == a[:, i : i + 1]) & there & live[:, i : i + 1]
        step = np.zeros_like(row)
        step[:, 1:] = row[:, :-1]
        step += np.where(same, MATCH, MISMATCH)
        np.maximum(step, row + GAP, out=step)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step - slope, axis=1) + slope
        best = np.maximum(best, row.max(axis=1))
    return best


def _expand(at: np.ndarray, first: np.ndarray, last: np.ndarray, idx: dict, part: int, parts: int) -> tuple[np.ndarray, ...]:
    """(word, item, position in the item) of the hits, of every `parts`-th item."""
    out = []
    count = last - first
    group = (np.cumsum(count) - count) // HITS_AT_ONCE
    for a, b in zip(*_runs(group)):
        n = count[a:b]
        entry = np.repeat(first[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where, item = np.repeat(at[a:b], n), idx["item"][entry]
        mine = item % parts == part if parts > 1 else slice(None)
        out.append((where[mine], item[mine], idx["pos"][entry][mine]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal values."""
    begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return begin, np.r_[begin[1:], len(x)]


def _hits(words: tk.Words, h: np.ndarray, idx: dict, tables: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Groups of (document, word, item, position) of the seeds found; those of one document and item are in one group."""
    found = []
    for n, (value, first, last) in idx["grams"].items():
        g, where = words.grams(h, n)
        maybe = np.flatnonzero(tables[n][(g & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        if not len(maybe):
            continue
        slot = np.minimum(np.searchsorted(value, g[maybe]), len(value) - 1)
        hit = value[slot] == g[maybe]
        maybe, slot = maybe[hit], slot[hit]
        found.append((where[maybe], first[slot], last[slot]))
    if not found:
        return
    at, first, last = (np.concatenate(x) for x in zip(*found))
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    at, first, last = at[order], first[order], last[order]
    begin, end = _runs(np.searchsorted(words.first, at, "right") - 1)
    total = np.r_[0, np.cumsum(last - first)]
    a = 0
    while a < len(begin):
        b = a + 1
        while b < len(begin) and total[end[b]] - total[begin[a]] <= HITS_AT_ONCE:
            b += 1
        own = slice(begin[a], end[b - 1])
        parts = int(-(-(total[end[b - 1]] - total[begin[a]]) // HITS_AT_ONCE))
        for part in range(parts):
            where, item, pos = _expand(at[own], first[own], last[own], idx, part, parts)
            if len(where):
                yield np.searchsorted(words.first, where, "right") - 1, where, item, pos
        a = b


def _shared(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """How many words of each window occur in its item, or more: no alignment has more matches."""
    key = lambda parts: np.concatenate(parts) + np.repeat(np.arange(len(parts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), [len(x) for x in parts])
    there = np.isin(key(windows), key(items))
    return np.add.reduceat(np.r_[there, False].astype(np.int64), np.cumsum([0, *(len(x) for x in windows[:-1])]))


def held_items(words: tk.Words, idx: dict, tables: dict[int, np.ndarray], least: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(document of the slice, item, share of the full score, first word, last word) of what the documents hold."""
    h = words.hashes(_ALNUM)
    for doc, at, item, pos in _hits(words, h, idx, tables):
        diagonal = at - pos
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        fresh = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > PAD)]
        begin = np.flatnonzero(fresh)
        end = np.r_[begin[1:], len(doc)] - 1
        low, high = diagonal[begin] - PAD, diagonal[end] + PAD
        scores = np.zeros(len(begin))
        for at_once in _batches(low, high):
            for i, *row, s in _aligned(words, h, idx, doc[begin], item[begin], low, high, at_once, least):
                scores[i] = s
                if s >= least:
                    yield int(doc[begin[i]]), int(item[begin[i]]), s, *row
        # A copy with words put between lies on several diagonals, or on one with parts too short to seed: windows as
        # wide as the gaps that still leave `least` may cost, neighbours together, where the windows alone fall short of a full copy.
        size = np.array([len(x) for x in idx["words"]])[item[begin]]
        reach = np.floor((MATCH * size * (1 - least)) / -GAP).astype(np.int64)
        low, high = diagonal[begin] - reach, diagonal[end] + reach
        apart = np.r_[True, (doc[begin[1:]] != doc[begin[:-1]]) | (item[begin[1:]] != item[begin[:-1]]) | (low[1:] > high[:-1])]
        first = np.flatnonzero(apart)
        last = np.r_[first[1:], len(begin)] - 1
        best = np.maximum.reduceat(scores, first)
        low, high, mine = low[first], high[last], begin[first]
        short = np.flatnonzero(best < 1)
        for at_once in _batches(low[short], high[short]):
            for i, *row, s in _aligned(words, h, idx, doc[mine], item[mine], low, high, short[at_once], least):
                if s >= least:
                    yield int(doc[mine[i]]), int(item[mine[i]]), s, *row


def _batches(low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
    """Windows to align at once: 512 at most, of like width, fewer where they are wide."""
    order = np.argsort(high - low, kind="stable")
    a = 0
    while a < len(order):
        b = min(len(order), a + 512)
        while b > a + 1 and (b - a) * int((high - low)[order[b - 1]]) > 1 << 18:
            b = a + (b - a) // 2
        yield order[a:b]
        a = b


def _aligned(words: tk.Words, h: np.ndarray, idx: dict, doc: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, which: np.ndarray, least: float) -> list[tuple]:
    """(window, first word, last word, share of the full score) of those windows that can reach `least`; low, high: diagonals."""
    own = [idx["words"][k] for k in item[which]]
    size = np.array([len(x) for x in own])
    start = words.first[doc[which]]
    lo = np.maximum(start, low[which])
    hi = np.minimum(words.first[doc[which] + 1], high[which] + size)
    near = [h[x:y] for x, y in zip(lo, hi)]
    able = np.flatnonzero(np.minimum(_shared(own, near), size) >= least * size)
    score = align([own[i] for i in able], [near[i] for i in able]) / (MATCH * size[able])
    return [(int(which[i]), int(lo[i] - start[i]), int(hi[i] - start[i]), float(s)) for i, s in zip(able, score)]


def _scan(docs: DataFrame, idx: dict, least: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(idx)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = held.value
        tables = _tables(mine)
        for batch in batches:
            rows = []
            for i, _, data, offs in tk.slices(batch.column(1)):
                best: dict[tuple[int, int], tuple] = {}
                for d, k, s, x, y in held_items(tk.Words(folded(data), offs), mine, tables, least):
                    if s > best.get((d, k), (-1.0,))[0]:
                        best[d, k] = (s, x, y)
                rows += [(i + d, mine["ids"][k], *v) for (d, k), v in sorted(best.items())]
            if rows:
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64())))], ["doc_id", "item_id", "score", "first_word", "last_word"])

    return docs.mapInArrow(shared.lean(run), "doc_id long, item_id long, score double, first_word long, last_word long")


def held(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) for every document and item it holds."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = None
    for rows in _blocks(benchmark, item_id, item_text, block_bytes):
        found = _scan(docs, index(rows), least)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about `block_bytes` of text at most."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size * 2 // block_bytes)) if size > block_bytes else 1
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield [(r["i"], r["t"]) for r in mine.orderBy("i", "t").collect()]


def without(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns; narrow."""
    for rows in _blocks(benchmark, item_id, item_text, block_bytes):
        idx = index(rows)
        held = docs.sparkSession.sparkContext.broadcast(idx)
        at = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], held=held, at=at) -> Iterator[pa.RecordBatch]:
            mine = held.value
            tables = _tables(mine)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, data, offs in tk.slices(batch.column(at)):
                    for d, *_rest in held_items(tk.Words(folded(data), offs), mine, tables, least):
                        clean[i + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(shared.lean(run), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """op9: one row for every document and benchmark item that it holds."""
    return held(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
