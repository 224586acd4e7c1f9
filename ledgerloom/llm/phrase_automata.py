"""Substring dedup by repeated-phrase automata: words covered by a recurring passage of WINDOW words go, everywhere.

A window is WINDOW consecutive words of one document.  A window recurs if its words
also start anywhere else, in another document or in its own.

1.  Every window names an anchor: the smallest hash of its GRAM-word pieces.  Equal
    windows have equal anchors, and neighbours mostly share theirs: a stretch is a run
    of windows with one anchor.  Anchors are counted over the corpus as bare hashes;
    one that occurs once cannot hold a recurring window.
2.  The stretches of the other anchors are cut out of each block of documents; equal
    ones are collapsed there, with the places they stand at.
3.  Stretches are dealt by anchor.  A task reads them in order of anchor and takes
    whole anchors until PIECE bytes are full: a shard.  It confirms the shard's
    recurring passages word by word: a stretch whose text stands in two places
    throughout, else the windows counted twice or more.  From these it compiles an
    Aho-Corasick automaton over word numbers, and streams all stretches of the shard
    through it, which locates every occurrence.
4.  The covered words of each place go back to the blocks, where they are removed.

An anchor with more than CONTEXTS stretches is split first: each of its windows becomes
a stretch with an anchor of its own, drawn from all its words.  Equal windows still
meet, and no phrase, however common, keeps more than its exact copies in one shard.
Blocks take about BLOCK_BYTES of text, so their number follows the input.

Edge cases: a null or empty text, or one of fewer than WINDOW words, loses nothing and
keeps its row; null and repeated doc_ids are rows like others, judged by their text;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import shared, textkernel as tk

WINDOW, GRAM = 35, 12
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20
CONTEXTS = 4096
SLICE = 1 << 19
U32, U64 = np.uint32, np.uint64


class Stretches:
    """The stretches of a slice of texts: anchor, document, first word and number of windows, and whether the anchor may recur in the slice."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int, gram: int):
        self.words = words = tk.Words(data, offs)
        self.anchor, self.again = np.zeros(0, U64), np.zeros(0, bool)
        self.doc = self.first = self.windows = np.zeros(0, np.int64)
        hashes = words.hashes(tk.BYTE_VALUE)
        if len(hashes) < window:
            return
        g = hashes[: len(hashes) - gram + 1] * tk.SHINGLE_WEIGHT[0]
        for k in range(1, gram):
            g += hashes[k : len(hashes) - gram + 1 + k] * tk.SHINGLE_WEIGHT[k]
        g = tk.mix(g)
        m, n, wide = g, 1, window - gram + 1
        while n < wide:
            step = min(n, wide - n)
            m = np.minimum(m[: len(m) - step], m[step:])
            n += step
        counts = np.maximum(words.count - window + 1, 0)
        doc = np.repeat(np.arange(len(counts)), counts)
        if not len(doc):
            return
        at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(words.first[:-1], counts)
        m = m[at]
        cut = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])])
        self.anchor, self.doc, self.first, self.windows = m[cut], doc[cut], at[cut], np.diff(np.r_[cut, len(m)])
        # A piece of words that stands twice in the slice may make its stretch, or two of them, hold a window twice.
        g = np.sort(g)
        twice = np.unique(g[1:][g[1:] == g[:-1]])
        if len(twice):
            self.again = twice[np.minimum(np.searchsorted(twice, self.anchor), len(twice) - 1)] == self.anchor
        else:
            self.again = np.zeros(len(cut), bool)


# --- 1: anchors


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(anchor, block, n): the distinct anchors of each block in a batch, with their stretches, two if one may recur."""
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        anchors, blocks, sizes = [], [], []
        for i, _, data, offs in tk.slices(batch.column(1), SLICE):
            s = Stretches(data, offs, window, gram)
            anchors.append(s.anchor)
            blocks.append(block[i + s.doc])
            sizes.append(1 + s.again.astype(np.int64))
        if not anchors:
            continue
        a, b, n = np.concatenate(anchors), np.concatenate(blocks), np.concatenate(sizes)
        if not len(a):
            continue
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        yield pa.RecordBatch.from_arrays([pa.array(a[cut].view(np.int64)), pa.array(b[cut]), pa.array(np.add.reduceat(n, cut))], ["anchor", "block", "n"])


# --- 2: stretches


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


_PLACE = np.dtype([("text", "V16"), ("word", U32)])


def _cut_out(docs: pa.Table, wanted: pa.Table, window: int, gram: int, contexts: int) -> pa.Table:
    """(anchor, phrase, n, block, places): the distinct stretches of a block under the wanted anchors."""
    kinds = {"anchor": pa.int64(), "phrase": pa.binary(), "n": pa.int64(), "block": pa.int32(), "places": pa.binary()}
    if not docs.num_rows or not wanted.num_rows:
        return pa.table({k: pa.array([], t) for k, t in kinds.items()})
    block = docs.column("block")[0].as_py()
    keys = wanted.column("anchor").to_numpy().view(U64)
    order = np.argsort(keys)
    keys, many = keys[order], (wanted.column("n").to_numpy() > contexts)[order]
    found: dict[bytes, list] = {}
    for i, _, data, offs in tk.slices(docs.column("text"), SLICE):
        s = Stretches(data, offs, window, gram)
        if not len(s.anchor):
            continue
        at = np.minimum(np.searchsorted(keys, s.anchor), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == s.anchor)
        if not len(hit):
            continue
        raw, first = data.tobytes(), s.words.first
        start, end = s.words.start, s.words.end
        digests: dict[int, bytes] = {}
        for a, d, w, n, split in zip(s.anchor[hit].tolist(), s.doc[hit].tolist(), s.first[hit].tolist(), s.windows[hit].tolist(), many[at[hit]].tolist()):
            if d not in digests:
                digests[d] = _digest(raw[offs[d] : offs[d + 1]])
            for w, n in [(w + k, 1) for k in range(n)] if split else [(w, n)]:
                phrase = b" ".join(raw[start[w] : end[w + n + window - 2]].split())
                entry = found.get(phrase)
                if entry is None:
                    found[phrase] = entry = [int.from_bytes(_digest(phrase)[:8], "little") if split else a, []]
                entry[1].append((digests[d], w - first[d]))
    columns = [
        pa.array(np.array([e[0] for e in found.values()], U64).view(np.int64)), pa.array(list(found), pa.binary()), pa.array([len(e[1]) for e in found.values()], pa.int64()),
        pa.array([block] * len(found), pa.int32()), pa.array([np.array(e[1], _PLACE).tobytes() for e in found.values()], pa.binary()),
    ]
    return pa.table(columns, list(kinds))


# --- 3: automata


def confirmed(phrases: list[tuple[int, ...]], times: list[int], window: int) -> list[tuple[int, ...]]:
    """The passages of one anchor's distinct stretches that recur: whole stretches, or their windows where contexts differ."""
    if len(phrases) == 1 and times[0] > 1:
        return [phrases[0]]
    count: Counter = Counter()
    for p, n in zip(phrases, times):
        for k in range(len(p) - window + 1):
            count[p[k : k + window]] += n
    return [w for w, n in count.items() if n > 1]


def occurrences(phrases: list[tuple[int, ...]], passages: list[tuple[int, ...]]) -> list[list[tuple[int, int]]]:
    """For each phrase the runs of words (start, end) that occurrences of the passages cover."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        machine.add_word(p, len(p))
    if not len(machine):
        return [[] for _ in phrases]
    machine.make_automaton()
    out = []
    for p in phrases:
        runs: list[tuple[int, int]] = []
        for last, size in machine.iter(p):
            a, b = last + 1 - size, last + 1
            while runs and a <= runs[-1][1]:
                a0, b0 = runs.pop()
                a, b = min(a, a0), max(b, b0)
            runs.append((a, b))
        out.append(runs)
    return out


def _shard(rows: list[tuple], window: int) -> pa.RecordBatch:
    """(block, places, runs) of the rows (anchor, phrase, n, block, places) of whole anchors, where any words are covered."""
    number: dict[bytes, int] = {}
    phrases: list[tuple[int, ...]] = []
    times: list[int] = []
    index: dict[bytes, int] = {}
    of: list[int] = []
    by_anchor: dict[int, list[int]] = {}
    for anchor, phrase, n, _, _ in rows:
        k = index.setdefault(phrase, len(phrases))
        if k == len(phrases):
            phrases.append(tuple([number.setdefault(w, len(number)) for w in phrase.split(b" ")]))
            times.append(0)
            by_anchor.setdefault(anchor, []).append(k)
        times[k] += n
        of.append(k)
    passages: list[tuple[int, ...]] = []
    for mine in by_anchor.values():
        passages += confirmed([phrases[k] for k in mine], [times[k] for k in mine], window)
    runs = [np.array(r, U32).tobytes() for r in occurrences(phrases, passages)]
    hit = [(r[3], r[4], runs[k]) for r, k in zip(rows, of) if runs[k]]
    return pa.RecordBatch.from_arrays([pa.array([h[c] for h in hit], t) for c, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["block", "places", "runs"])


def _located(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Shards of whole anchors from rows sorted by anchor."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held >= PIECE and row[0] != rows[-1][0]:
                yield _shard(rows, window)
                rows, held = [], 0
            rows.append(row)
            held += len(row[1])
    if rows:
        yield _shard(rows, window)


# --- 4: removal


def _removed(docs: pa.Table, located: pa.Table, window: int, with_text: bool) -> pa.Table:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of the documents of a block."""
    spans: dict[bytes, list[tuple[int, int]]] = {}
    for places, runs in zip(located.column("places").to_pylist(), located.column("runs").to_pylist()):
        covered = np.frombuffer(runs, U32).reshape(-1, 2).tolist()
        for p in np.frombuffer(places, _PLACE):
            w = int(p["word"])
            spans.setdefault(p["text"].tobytes(), []).extend((w + a, w + b) for a, b in covered)
    rows = []
    for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
        raw = (text or "").encode()
        words = raw.split()
        n = len(words)
        if n >= window and spans and (mine := spans.get(_digest(raw))):
            gone = np.zeros(n + 1, np.int32)
            at = np.array(mine)
            np.add.at(gone, at[:, 0], 1)
            np.add.at(gone, at[:, 1], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        kept = b" ".join(words)
        rows.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
    kinds = [docs.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
    return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(kinds)])


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int = GRAM, contexts: int = CONTEXTS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of `docs`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(shared.partitions(spark), -(-size // BLOCK_BYTES))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "text", "doc_id")
    seen = rows.select("block", "text").mapInArrow(shared.lean(lambda b: _anchors(b, window, gram)), "anchor long, block int, n long")
    seen = shared.written(seen, "anchors")
    several = seen.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    wanted = seen.select("anchor", "block").join(several, "anchor").select("block", "anchor", "n")
    by_block = rows.groupBy("block")
    cut = by_block.cogroup(wanted.groupBy("block")).applyInArrow(shared.lean_tables(lambda x, y: _cut_out(x, y, window, gram, contexts)), "anchor long, phrase binary, n long, block int, places binary")
    located = cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shared.lean(lambda b: _located(b, window)), "block int, places binary, runs binary")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return by_block.cogroup(located.groupBy("block")).applyInArrow(shared.lean_tables(lambda x, y: _removed(x, y, window, with_text)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: what every document loses to passages that recur."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
