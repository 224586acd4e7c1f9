"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The vocabulary file is a parameter; nothing is trained or copied.  A text is marked as
SentencePiece does (a space in front, spaces become U+2581) and cut into marked words
wherever no piece can cross: before a marker that follows another character, and
around characters that no piece has.  The distinct words of a batch are sorted, which
lays them out as a trie in depth-first order; the Viterbi state of a word (best score
and live pieces at each position) is kept for the prefix that the next word shares
and only the rest is computed.  Characters without a piece become byte pieces.  Equal
scores prefer the earlier start, as the library's unigram search does.

Decoding concatenates the bytes of the pieces and drops the space in front; every text
comes back exactly, including a literal U+2581 (as bytes), tabs and line ends.

Narrow: no shuffle; the broadcast is the vocabulary alone, of at most MOST_BYTES.
A task builds the automaton of its vocabulary; words are remembered up to REMEMBERED
characters of words and ids, transitions up to TRANSITIONS, and nothing beyond the task.

Edge cases: a null or empty text has no pieces and decodes to an empty text; repeated
rows are encoded alike; very long words are searched in time linear in their length;
an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm import shared

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LITERAL = "\uffff"  # stands before a marker that is the text's own
MOST_BYTES = 64 << 20
REMEMBERED = 6_000_000
TRANSITIONS = 200_000
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces with scores from a SentencePiece model file, searched as a unigram model."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(data)
        pieces: list[tuple[str, float, int]] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.unknown = 0
        scores = []
        chars: set[str] = set()
        for k, p in enumerate(model.pieces):
            if p.type in (1, 4):  # normal, user defined
                pieces.append((p.piece, float(p.score), k))
                chars.update(p.piece)
                scores.append(float(p.score))
                self.bytes_of.append(p.piece.replace(MARK, " ").encode())
            elif p.type == 6:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value] = k
                self.bytes_of.append(bytes([value]))
            else:
                if p.type == 2:
                    self.unknown = k
                self.bytes_of.append(b"")
        self.has_bytes = any(self.byte_ids)
        self.unknown_score = (min(scores) if scores else 0.0) - UNKNOWN_PENALTY
        chars.discard(MARK)
        chars.discard(" ")
        known = "".join(re.escape(c) for c in sorted(chars))
        # A word: markers, then characters that some piece has; or markers alone; or one other character.
        self.word = re.compile(f"{MARK}*[{known}]+|{MARK}+|[^{MARK}]" if known else f"{MARK}+|[^{MARK}]", re.S)
        size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.length, self.first = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.is_byte = np.zeros(len(size), bool)
        if self.has_bytes:
            self.is_byte[self.byte_ids] = True
        self._automaton(pieces)

    def other(self, text: str) -> list[int]:
        """Ids of characters without a piece."""
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")] if self.has_bytes else [self.unknown]

    def _automaton(self, pieces: list[tuple[str, float, int]]) -> None:
        """The trie with failure links, by number of state: `next` by state and character, `failure`, and `ends`.

        `ends` are the pieces that end in a state, longest first, as (length, score,
        id).  Flat tables instead of a node for each state keep a worker small.
        """
        self.next: dict[int, int] = {}
        depth, own, order = [0], [None], []
        for piece, score, k in pieces:
            state = 0
            for c in piece:
                key = state << 21 | ord(c)
                after = self.next.get(key)
                if after is None:
                    after = self.next[key] = len(depth)
                    order.append((depth[state] + 1, state, ord(c), after))
                    depth.append(depth[state] + 1)
                    own.append(None)
                state = after
            own[state] = (len(piece), score, k)
        self.failure = array("i", [-1]) * len(depth)
        self.ends: dict[int, tuple] = {}
        for _, state, c, after in sorted(order):
            back = self.failure[state]
            while back >= 0 and (back << 21 | c) not in self.next:
                back = self.failure[back]
            back = self.next[back << 21 | c] if back >= 0 else 0
            self.failure[after] = back
            ends = ((own[after],) if own[after] else ()) + self.ends.get(back, ())
            if ends:
                self.ends[after] = ends
        self.through: dict[int, int] = {}  # transitions through failure links, remembered

    def _step(self, key: int) -> int:
        """The state that a state and a character without a transition of their own lead to."""
        c, link = key & 0x1FFFFF, self.failure[key >> 21]
        while link >= 0 and (link << 21 | c) not in self.next:
            link = self.failure[link]
        if len(self.through) >= TRANSITIONS:
            self.through.clear()
        after = self.through[key] = self.next[link << 21 | c] if link >= 0 else 0
        return after

    def search(self, words: list[str]) -> list[bytes]:
        """Little-endian int32 ids of sorted words, depth first: the state of a shared prefix is computed once."""
        out, before, following, through, ends_of = [], "", self.next, self.through, self.ends
        best, back, states = [0.0], [(0, -1)], [0]
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :], states[shared + 1 :]
            state, j = states[shared], shared
            for c in word[shared:] if shared else word:
                key = state << 21 | ord(c)
                state = following.get(key)
                if state is None:
                    state = through.get(key)
                    if state is None:
                        state = self._step(key)
                j += 1
                top, step, n = -1e300, None, 0
                for n, piece, k in ends_of.get(state, ()):
                    score = best[j - n] + piece
                    if score > top:
                        top, step = score, (n, k)
                if n != 1:  # no piece for this character alone
                    score = best[j - 1] + self.unknown_score
                    if score > top:
                        top, step = score, (1, -1)
                best.append(top)
                back.append(step)
                states.append(state)
            ids = array("i")
            while j:
                n, k = back[j]
                j -= n
                if k < 0:
                    ids.extend(reversed(self.other(" " if word[j] == MARK else word[j])))
                else:
                    ids.append(k)
            ids.reverse()
            out.append(ids.tobytes())
            before = word
        return out

    def words(self, text: str) -> list[str]:
        """The marked words of a text; a literal marker stands alone as U+FFFF + marker."""
        if not text:
            return []
        if MARK not in text:
            return self.word.findall(MARK + text.replace(" ", MARK))
        out: list[str] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(LITERAL + MARK)
            marked = part.replace(" ", MARK)
            out += self.word.findall(MARK + marked if not k else marked)
        return out


class Encoder:
    """A vocabulary with the words of a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        """Drops the remembered words."""
        self.known, self.size = {LITERAL + MARK: np.array(self.vocabulary.other(MARK), np.int32).tobytes()}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of every text."""
        words = [self.vocabulary.words(t) for t in texts]
        if self.size > REMEMBERED:
            self.forget()
        fresh = sorted({w for ws in words for w in ws if w not in self.known})
        coded = self.vocabulary.search(fresh)
        self.known.update(zip(fresh, coded))
        known = self.known
        out = [b"".join([known[w] for w in ws]) for ws in words]
        for w, x in zip(fresh, coded):
            if len(w) > 64:
                del known[w]
            else:
                self.size += len(w) + len(x)
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The UTF-8 text of each little-endian int32 sequence; the space in front goes."""
        v = self.vocabulary
        every = np.frombuffer(b"".join(ids), np.int32)
        n = v.length[every]
        ends = np.cumsum(n)
        at = np.repeat(v.first[every] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        data = v.flat[at].tobytes()
        cut = np.r_[0, ends][np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(cut[:-1], cut[1:])]


def load(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, on the driver; too large a file is refused rather than broadcast."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return data


def _pieces(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    """The batch's texts, about `size` characters at a time."""
    part, chars = [], 0
    for t in texts:
        t = t.as_py() or ""
        part.append(t)
        chars += len(t)
        if chars >= size:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode(docs: DataFrame, text: str = "text", out: str = "pieces", vocabulary: bytes | None = None) -> DataFrame:
    """Appends the ids (array<int>) of every text; all columns stay (one named `out` is replaced, `text` too)."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(held.value))
        for batch in batches:
            ids = [x for part in _pieces(batch.column(batch.num_columns - 1)) for x in encoder.encode(part)]
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield shared.appended(batch, pa.ListArray.from_arrays(pa.array(offsets), values), out)

    return shared.with_text(docs, text, out).mapInArrow(shared.lean(run), shared.schema_with(docs, out, "array<int>"))


def decode(rows: DataFrame, pieces: str = "pieces", out: str = "text", vocabulary: bytes | None = None) -> DataFrame:
    """Appends the text of the ids (a column named `out` is replaced, `pieces` too); null ids give an empty text."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(held.value))
        for batch in batches:
            ids = [np.array(x.as_py() or [], np.int32).tobytes() for x in batch.column(batch.num_columns - 1)]
            texts = [t.decode("utf-8", "replace") for t in encoder.decode(ids)]
            yield shared.appended(batch, pa.array(texts, pa.string()), out)

    return shared.with_text(rows, pieces, out).mapInArrow(shared.lean(run), shared.schema_with(rows, out, "string"))


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: bytes | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, a digest of the ids and whether decoding gives the text again.

    encode() and decode() in one pass, for when the ids need not leave the workers.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(held.value))
        for batch in batches:
            rows = []
            for part in _pieces(batch.column(1)):
                coded = encoder.encode(part)
                for t, data, again in zip(part, coded, encoder.decode(coded)):
                    ids = np.frombuffer(data, np.int32)
                    rows.append((len(ids), int(encoder.vocabulary.is_byte[ids].sum()), hashlib.sha256(data).hexdigest(), again == t.encode("utf-8", "surrogatepass")))
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["doc_id", "n_pieces", "n_byte_pieces", "pieces_sha256", "exact"])

    return docs.select(f"`{doc_id}`", f"`{text}`").mapInArrow(shared.lean(run), "doc_id long, n_pieces long, n_byte_pieces long, pieces_sha256 string, exact boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document encoded, decoded and compared."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
