"""Byte-level BPE: a lazily determinised transducer for encoding, a streaming UTF-8 decoder.

Encoding.  In byte-pair encoding, dropping the last token of an encoded text leaves the
encoding of the shorter text.  So the encodings of all prefixes form a tree, and the last
token of a prefix is the one vocabulary entry ending there that the merges leave standing
next to the last token before it.  The transducer reads bytes left to right.  A state is
the last token already certain, and the bytes after it; reading a byte finds that
byte's last token, follows the tree from every position that a later token can still start
from (the bytes after it begin some vocabulary entry), and emits what all those paths
share.  No token is longer than the longest vocabulary entry, so the lookahead is bounded.  States and transitions are made when first
reached and kept, up to a bound at which the table is started afresh.

Decoding.  Ids are turned to bytes in pieces; a table-driven UTF-8 automaton tells after
every piece how many trailing bytes belong to a character that is not complete yet, and
holds them back until the next piece.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import ship

#: Bounds on what a worker keeps, about 500 MB in all; a full table is dropped and filled again.
#: Smaller ones cost time: with a third of each, half as much memory and a third more time.
MAX_STATES = 300_000
MAX_WORDS = 400_000
#: Rest of a word that is read without making states for it.
SHORT = 64
#: Ids decoded at a time.
PIECE = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes byte strings with the merges that a rank table defines."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.max_states = max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Every token and every beginning of one: its rank or -1, and whether a token goes on from it.
        self.known: dict[bytes, tuple[int, bool]] = {token: (rank, False) for token, rank in ranks.items()}
        for token in ranks:
            for k in range(1, len(token)):
                self.known[token[:k]] = (ranks.get(token[:k], -1), True)
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.fits: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        # A state: the certain last token or -1, the bytes after it, for each of their ends its last
        # token, and the places from which what was read since begins a token.
        self.nodes: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...]]] = [(-1, b"", (), ())]
        self.number: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        #: By state * 256 + byte: the next state and the tokens emitted.
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: list[tuple[int, ...] | None] = [()]

    def merge(self, data: bytes) -> list[int]:
        """Apply merges by rank, lowest first, leftmost among equals."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stands(self, left: int, right: int) -> bool:
        """Whether the merges leave this pair of tokens as it is."""
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= self.max_states:
                self.fits.clear()
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self.fits[pair] = known
        return known

    def _alone(self, token: int) -> bool:
        """Whether the merges make this token of its bytes."""
        known = self.fits.get(token | 1 << 62)
        if known is None:
            known = self.fits[token | 1 << 62] = self.merge(self.tokens[token]) == [token]
        return known

    def _path(self, lasts: Sequence[int], end: int) -> list[int]:
        """The tokens on the way to ``end``, in order."""
        out = []
        while end > 0:
            token = lasts[end - 1]
            out.append(token)
            end -= self.lengths[token]
        return out[::-1]

    def _read(self, data: bytes, n: int, certain: int, lasts: Sequence[int], alive: Sequence[int]) -> tuple[int, list[int]]:
        """The last token of the first ``n`` bytes, and the places from which they begin a token that goes on."""
        last, going, known = -1, [], self.known
        # A token ending here starts where the bytes read so far could begin one; longest first.
        for start in (*alive, n - 1):
            found = known.get(data[start:n])
            if found is None:
                continue
            token, more = found
            if last < 0 <= token:
                before = lasts[start - 1] if start else certain
                fit = self.fits.get(before << 32 | token) if before >= 0 else self._alone(token)
                if fit or (fit is None and self.stands(before, token)):
                    last = token
            if more:
                going.append(start)
        if last < 0:
            raise ValueError("the rank table lacks a single byte")
        return last, going

    def _finish(self, state: int, rest: bytes) -> list[int]:
        """The tokens of a state's bytes and a short rest, without making further states."""
        certain, data, lasts, alive = self.nodes[state]
        whole, lasts = data + rest, list(lasts)
        for n in range(len(data) + 1, len(whole) + 1):
            last, alive = self._read(whole, n, certain, lasts, alive)
            lasts.append(last)
        return self._path(lasts, len(lasts))

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        certain, data, lasts, alive = self.nodes[state]
        data += bytes((byte,))
        n = len(data)
        last, going = self._read(data, n, certain, lasts, alive)
        lasts += (last,)
        emitted: tuple[int, ...] = ()
        if not going:  # nothing read so far can begin a token: all of it is certain
            emitted = tuple(self._path(lasts, n))
            certain, data, lasts = last, b"", ()
        elif going[0]:
            # What the paths of all ends share, from which a later token can still start, is certain.
            ends, lengths = {*going, n}, self.lengths
            while len(ends) > 1:
                end = max(ends)
                ends.remove(end)
                ends.add(end - lengths[lasts[end - 1]])
            start = ends.pop()
            if start:
                emitted = tuple(self._path(lasts, start))
                certain, data, lasts, going = emitted[-1], data[start:], lasts[start:], [p - start for p in going]
        key = (certain, data)
        number = self.number.get(key)
        if number is None:
            number = self._adopt((certain, data, lasts, tuple(going)))
        out = self.moves[state << 8 | byte] = (number, emitted)
        return out

    def _adopt(self, node: tuple[int, bytes, tuple[int, ...], tuple[int, ...]]) -> int:
        number = len(self.nodes)
        self.number[node[:2]] = number
        self.nodes.append(node)
        self.ends.append(None)
        return number

    def encode(self, data: bytes) -> list[int]:
        if len(self.nodes) > self.max_states:
            self._restart()
        out: list[int] = []
        state, move = 0, self.moves.get
        for at, byte in enumerate(data):
            step = move(state << 8 | byte)
            if step is None:
                state, emitted = self._step(state, byte)
                out.extend(emitted)
                if len(data) - at <= SHORT:
                    # A word adds one transition; those that come often are determinised in full.
                    out.extend(self._finish(state, data[at + 1 :]))
                    return out
                if len(self.nodes) > 4 * self.max_states:  # one very long word alone: keep its place only
                    node = self.nodes[state]
                    self._restart()
                    move, state = self.moves.get, self._adopt(node)
            else:
                state = step[0]
                if step[1]:
                    out.extend(step[1])
        tail = self.ends[state]
        if tail is None:
            lasts = self.nodes[state][2]
            tail = self.ends[state] = tuple(self._path(lasts, len(lasts)))
        out.extend(tail)
        return out


class _Words(dict):
    """Encoded pre-tokens as little-endian unsigned 32-bit ids, made when first asked for.

    When ``most`` have come in, they become the older generation and the one before is
    dropped; a word met again moves up, so frequent words stay.
    """

    def __init__(self, machine: Transducer, most: int = MAX_WORDS):
        super().__init__()
        self.machine = machine
        self.most = most
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            ids = self.machine.encode(word.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:  # longer ones hardly come again, and the bound is a count
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


#: UTF-8 automaton (RFC 3629): state 0 is between characters, 8 an error; a row for each
#: state, a list of (first byte, last byte, next state).
UTF8_RANGES = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
        (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0x80, 0xBF, 1)],
    3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)],
    5: [(0x80, 0x9F, 1)],
    6: [(0x90, 0xBF, 2)],
    7: [(0x80, 0x8F, 2)],
}
UTF8_ERROR = 8


@functools.cache
def _utf8_table() -> list[bytes]:
    rows = []
    for state in range(8):
        row = bytearray([UTF8_ERROR] * 256)
        for low, high, to in UTF8_RANGES[state]:
            row[low : high + 1] = bytes([to]) * (high - low + 1)
        rows.append(bytes(row))
    return rows


class StreamDecoder:
    """Turns ids into text piece by piece; a character's bytes may be split between pieces."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.held = b""
        self.state = 0

    def feed_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of all characters completed by these ids; raises on what is not UTF-8."""
        tokens, table = self.codec.by_id, _utf8_table()
        parts = [tokens[i] for i in ids.tolist()]
        state = self.state
        # Only tokens that don't hold whole characters, or come within one, move the automaton.
        for k in np.flatnonzero(~self.codec.whole[ids]).tolist():
            for byte in parts[k]:
                state = table[state][byte]
                if state == UTF8_ERROR:
                    raise UnicodeDecodeError("utf-8", bytes(parts[k]), 0, 1, "not UTF-8")
        data = self.held + b"".join(parts)
        self.state = state
        keep = len(data)
        if state:
            keep -= 1
            while data[keep] & 0xC0 == 0x80:
                keep -= 1
        self.held = data[keep:]
        return data[:keep]

    def finish(self) -> bytes:
        """Bytes of a last character that never got complete, as they are."""
        out, self.held, self.state = self.held, b"", 0
        return out


class Codec:
    """A vocabulary ready for use: pattern, transducer and decoder tables."""

    def __init__(self, path: str, pattern: str, max_words: int = MAX_WORDS, max_states: int = MAX_STATES):
        self.machine = Transducer(load_ranks(path), max_states)
        self.words = _Words(self.machine, max_words)
        self.split = regex.compile(pattern).findall
        top = max(self.machine.tokens, default=-1) + 1
        self.by_id = [self.machine.tokens.get(i, b"") for i in range(top)]
        table = _utf8_table()
        whole = []
        for token in self.by_id:
            state = 0
            for byte in token:
                state = table[state][byte] if state != UTF8_ERROR else state
            whole.append(state == 0)
        self.whole = np.array(whole, dtype=bool)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode_stream(self, packed: bytes) -> Iterator[bytes]:
        ids = np.frombuffer(packed, dtype="<u4")
        stream = StreamDecoder(self)
        for at in range(0, len(ids), PIECE):
            yield stream.feed_bytes(ids[at : at + PIECE])
        yield stream.finish()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.decode_stream(np.array(list(ids), dtype="<u4").tobytes())).decode()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str, max_words: int = MAX_WORDS, max_states: int = MAX_STATES) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path, pattern, max_words, max_states)


def _sha256(parts: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def tokenize(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    max_words: int = MAX_WORDS,
    max_states: int = MAX_STATES,
) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if wanted, ``ids``.

    ``path`` names the rank file, which every worker must see at that place; ``pattern``
    splits a text before the merges.  Special tokens are ordinary text.  Null counts as
    the empty text, which has no tokens.  Rows map one to one: repeated rows repeat,
    null ids stay, an empty table gives an empty result, other columns are dropped.
    Nothing is shuffled; a worker holds one batch of texts and its bounded tables.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern, max_words, max_states)
        gc.disable()  # the tables hold millions of small objects and no cycles
        try:
            yield from encoded(tool, batches)
        finally:
            gc.enable()

    def encoded(tool: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids_sha, text_sha, all_ids = [], [], [], []
            for value in batch.column(1):
                packed = tool.encode_bytes(value.as_py())
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(_sha256(tool.decode_stream(packed)))
                if keep_ids:
                    all_ids.append(np.frombuffer(packed, dtype="<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def detokenize(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the ``text`` of its ids; null ids give the empty text, bytes that are not UTF-8 an error."""
    ship(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            texts = [tool.decode(ids.as_py() or ()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col)).mapInArrow(run, f"doc_id {kind}, text string")
