"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

Merging by rank has a left-to-right form.  A sequence of tokens is what merging gives exactly if every two neighbours, merged by
themselves, stay those two tokens.  So each prefix of a piece has one encoding, and whether a token may follow depends on the token
before it alone.  The nondeterministic transducer's configurations are (token before, place in the trie of tokens since); a
configuration that reaches a token which may follow starts the next one.  The determinised state is the tuple of all configurations
alive after some bytes, and each step tells the last token of the prefix so far.  Tokens that all live configurations share are sent,
every WINDOW bytes and at the piece's end; no configuration is longer than the longest token.  States and steps are made when a text
first needs them and dropped all together at MOST_STATES, so memory has a bound and the time is linear in the bytes, for a piece of
a million letters too.  Pieces that were met are kept with their ids, two generations of MOST_PIECES, of LONG_PIECE characters at most.

Decoding is a stream too: a machine over the bytes of UTF-8 whose steps by whole tokens are kept, so a character may be cut over tokens.

The vocabulary file (base64 token and rank a line) is a parameter, read on the driver, at most FILE_BYTES, and broadcast.

Defined cases
* A null text is the empty text: no ids.  Special tokens' strings are ordinary text.  A piece that is a token as a whole is that token.
* Whole texts are read, PIECES pieces at a time.  Repeated rows and ties: each row is worked on by itself.
* Null ids decode to empty bytes; an id that the vocabulary lacks raises ValueError.  Bytes that are no UTF-8 decode to U+FFFD in texts, and stay in bytes.
* An empty table gives an empty table.  Extra columns pass through; results replace columns of their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, table

FILE_BYTES = 64 << 20
MOST_STATES, MOST_PIECES, LONG_PIECE, PIECES, WINDOW = 1 << 18, 1 << 19, 64, 1 << 16, 1 << 10
VOCABULARY = "byte_bpe_50k.tiktoken"
_ints = struct.Struct("<i")


def read_ranks(path: str) -> bytes:
    """The file's bytes, if its size is within the bound for a broadcast."""
    if os.path.getsize(path) > FILE_BYTES:
        raise ValueError(f"{path} is larger than {FILE_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def merged(token: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """Merging by lowest rank, leftmost first, as the vocabulary defines it, until so many parts are left: the transducer is built from it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > until:
        low, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + 1), i) for i in range(len(parts) - 1))
        if low > len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Ids of one piece's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        # The trie: child by node and byte, whether a node has children, its depth, and the token that ends there, if any.
        self.child: dict[int, int] = {}
        self.inner, self.depth, self.ends = [True], [0], [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                self.inner[node] = True
                node, before = self.child.setdefault(node << 8 | b, len(self.ends)), node
                if node == len(self.ends):
                    self.inner.append(False)
                    self.depth.append(self.depth[before] + 1)
                    self.ends.append(-1)
            self.ends[node] = rank
        self.shift = len(self.ends).bit_length()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.plain: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.restarts = 0
        self._clear()

    def _clear(self) -> None:
        # A state is a tuple of configurations, oldest first: the token before it plus 1 (0 at the start), shifted, and its node.
        self.states: list[tuple[int, ...]] = [(0,)]
        self.number = {self.states[0]: 0}
        #: By state and byte: the next state, shifted, and the last token of the prefix.
        self.steps: dict[int, int] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge to this one last; None for a single byte and for a token that merging never gives."""
        if token not in self.halves:
            raw = self.tokens[token]
            parts = merged(raw, self.ranks, until=2)
            good = len(raw) > 1 and len(parts) == 2
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if good else None
        return self.halves[token]

    def ordered(self, token: int) -> bool:
        """Whether every merge inside the token has a higher rank than the merges it needs, so that merging goes by rising ranks."""
        if token not in self.plain:
            halves = self.split(token)
            single = len(self.tokens[token]) == 1
            self.plain[token] = single or (halves is not None and all((len(self.tokens[x]) == 1 or x < token) and self.ordered(x) for x in halves))
        return self.plain[token]

    def follows(self, last: int, token: int) -> bool:
        """Whether merging leaves the token, and the two tokens (-1: none before), as they are.

        The merges of both are taken back, latest first.  Before each, the tokens that touch would have merged if their rank is
        lower, or as low and further left.
        """
        if len(self.tokens[token]) > 1 and self.split(token) is None:
            return False
        if last < 0:
            return True
        a, b = last, token
        text, rank = self.tokens, self.ranks.get
        if not (self.ordered(a) and self.ordered(b)):
            return merged(text[a] + text[b], self.ranks) == [text[a], text[b]]
        if text[a] + text[b] in self.ranks:
            return False
        while True:
            left, right = self.halves.get(a), self.halves.get(b)
            if left and (not right or a > b):
                low, a = a, left[1]
            elif right:
                low, b = b + 1, right[0]
            else:
                return True
            if rank(text[a] + text[b], low) < low:
                return False

    def _step(self, state: int, byte: int) -> int:
        """The state after a byte, shifted, and the last token of the prefix that ends with it."""
        alive: list[int] = []
        shift, found, ends, inner = self.shift, -1, self.ends, self.inner
        low = (1 << shift) - 1
        child, pairs = self.child.get, self.pairs
        for config in self.states[state]:
            node = child((config & low) << 8 | byte)
            if node is None:
                continue
            last = config >> shift
            if found < 0 and (end := ends[node]) >= 0:
                pair = last << 32 | end
                good = pairs.get(pair)
                if good is None:
                    if len(pairs) >= 2 * MOST_STATES:
                        pairs.clear()
                    good = pairs[pair] = self.follows(last - 1, end)
                if good:
                    found = end
            if inner[node]:
                alive.append(last << shift | node)
        alive.append(found + 1 << shift)
        key = tuple(alive)
        number = self.number.get(key)
        if number is None:
            if len(self.states) >= MOST_STATES:
                # All that was learnt goes; only the new state is needed to go on.
                self._clear()
                self.restarts += 1
                state = -1
            number = self.number[key] = len(self.states)
            self.states.append(key)
        out = number << 32 | found
        if state >= 0:
            self.steps[state << 8 | byte] = out
        return out

    def _back(self, ending: list[int], at: int) -> list[int]:
        """The tokens of the prefix of `at` bytes, last first."""
        out = []
        while at > 0:
            out.append(ending[at - 1])
            at -= len(self.tokens[out[-1]])
        return out

    def run(self, piece: bytes) -> list[int]:
        return self._short(piece) if len(piece) < WINDOW else self._long(piece)

    def _short(self, piece: bytes) -> list[int]:
        """Nothing is sent before the end."""
        known, size, state, steps, last = self.steps.get, self.size, 0, [], []
        for byte in piece:
            step = known(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
                known = self.steps.get
            state = step >> 32
            steps.append(step)
        at = len(steps)
        while at:
            token = steps[at - 1] & 0xFFFFFFFF
            last.append(token)
            at -= size[token]
        last.reverse()
        return last

    def _long(self, piece: bytes) -> list[int]:
        out: list[int] = []
        #: The last token of each prefix, from the end of what was sent.
        ending: list[int] = []
        state = 0
        for at in range(0, len(piece), WINDOW):
            known = self.steps.get
            for byte in piece[at : at + WINDOW]:
                step = known(state << 8 | byte)
                if step is None:
                    step = self._step(state, byte)
                    known = self.steps.get
                state = step >> 32
                ending.append(step & 0xFFFFFFFF)
            if len(ending) >= WINDOW:
                sent = self._settled(ending, state)
                out += sent
                del ending[: sum(len(self.tokens[x]) for x in sent)]
        last, at = [], len(ending)
        while at:
            token = ending[at - 1]
            last.append(token)
            at -= self.size[token]
        last.reverse()
        return out + last if out else last

    def _settled(self, ending: list[int], state: int) -> list[int]:
        """The tokens that all configurations of the state share, whatever bytes follow."""
        low = (1 << self.shift) - 1
        chains = [self._back(ending, len(ending) - self.depth[c & low])[::-1] for c in self.states[state]]
        shared = 0
        for column in zip(*chains, strict=False):
            if any(x != column[0] for x in column):
                break
            shared += 1
        return chains[0][:shared]


class Kept(dict):
    """Ids of pieces by piece; one that is missing is made, and kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        return self.make(piece)


class Codec:
    """Ids of texts, and bytes and texts of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.bytes_of = {v: k for k, v in ranks.items()}
        #: Ids of pieces met, and those of the generation before: what is met again moves to the new one.
        self.kept = Kept(self.piece_ids)
        self.former: dict[str, bytes] = {}
        self.table = pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)], pa.large_binary())
        #: Decoding: machine states by number, and the step of (state, token) to (state, text).
        self.after: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    def piece_ids(self, piece: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        out = self.former.get(piece)
        if out is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            out = _ints.pack(whole) if whole is not None else struct.pack(f"<{len(ids := self.transducer.run(raw))}i", *ids)
        if len(piece) <= LONG_PIECE:
            if len(self.kept) >= MOST_PIECES:
                # In place, as a text's pieces are being looked up in it.
                self.former = dict(self.kept)
                self.kept.clear()
            self.kept[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as in piece_ids."""
        if len(text) <= PIECES:
            return b"".join(map(self.kept.__getitem__, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := list(islice(found, PIECES)):
            out.append(b"".join(map(self.kept.__getitem__, part)))
        return b"".join(out)

    def decode_all(self, ids: np.ndarray, size: np.ndarray) -> pa.Array:
        """Bytes of the lists of so many ids that lie side by side in ids: tokens taken from the table, and their borders left out."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.table):
            raise ValueError(f"no token has the id {ids[(ids < 0) | (ids >= len(self.table))][0]}")
        taken = self.table.take(pa.array(ids))
        if taken.null_count:
            raise ValueError(f"no token has the id {ids[taken.is_null().to_numpy(zero_copy_only=False)][0]}")
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        places = ends[np.cumsum([0, *size], dtype=np.int64)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(places), taken.buffers()[2] or pa.py_buffer(b"")]).cast(pa.binary())

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0].as_py()

    def text_stream(self, ids: list[int]) -> Iterator[str]:
        """The text token by token; a character that tokens cut comes with its last byte."""
        state = b""
        for i in ids:
            step = self.after.get((state, i))
            if step is None:
                if i not in self.bytes_of:
                    raise ValueError(f"no token has the id {i}")
                step = feed(state, self.bytes_of[i])
                if len(self.after) < 8 * MOST_STATES:
                    self.after[state, i] = step
            state = step[0]
            if step[1]:
                yield step[1]
        if state:
            yield "�"


def bounds(open_: bytes) -> tuple[int, int, int]:
    """What an unfinished character still takes: number of bytes, and the lowest and highest value of the next (0 bytes: it can't be one)."""
    lead = open_[0]
    size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
    if len(open_) > 1 or not size:
        return size - len(open_) if size else 0, 0x80, 0xBF
    # Overlong forms, surrogates and what lies beyond the last code point are excluded by the second byte.
    return size - 1, {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)


def feed(state: bytes, more: bytes) -> tuple[bytes, str]:
    """One step of the UTF-8 machine by some bytes: the unfinished character after them, and the text before it."""
    out, open_ = [], state
    for b in more:
        if open_:
            left, low, high = bounds(open_)
            if low <= b <= high:
                open_ += bytes([b])
                if left == 1:
                    out.append(open_.decode())
                    open_ = b""
                continue
            out.append("�")
            open_ = b""
        if b < 0x80:
            out.append(chr(b))
        elif bounds(bytes([b]))[0]:
            open_ = bytes([b])
        else:
            out.append("�")
    return open_, "".join(out)


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary file, made once a process."""
    key = hashlib.sha256(raw).digest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec({base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}, pattern)
    return _codecs[key]


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_ranks(path))


def _mapped(df: DataFrame, col: str, name: str, kind: T.DataType, make) -> DataFrame:
    """df with the column `name` that make(array of col) gives; a column of this name is replaced."""
    arrow_batches(df.sparkSession)
    at, kept = df.columns.index(col), [i for i, c in enumerate(df.columns) if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), make(b.column(at))], names=[*(b.schema.names[i] for i in kept), name])

    return df.mapInArrow(run, T.StructType([*(df.schema[i] for i in kept), T.StructField(name, kind)]))


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a list array, and the number of each list (0 for null)."""
    return ids.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids, an array of integers."""
    held = vocabulary(df.sparkSession, path)
    return _mapped(df, text_col, ids_col, T.ArrayType(T.IntegerType()), lambda texts: _lists([codec(held.value, pattern).encode(x or "") for x in texts.to_pylist()]))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the bytes of ids."""
    held = vocabulary(df.sparkSession, path)

    return _mapped(df, ids_col, bytes_col, T.BinaryType(), lambda ids: codec(held.value, pattern).decode_all(*_flat(ids)))


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df without its texts, with the ids and the bytes decoded from them, as `encode` and then `decode` give them.

    One pass: a worker has one codec and learns its states once, and ids don't travel between two.
    """
    arrow_batches(df.sparkSession)
    held = vocabulary(df.sparkSession, path)
    at, kept = df.columns.index(text_col), [i for i, c in enumerate(df.columns) if c not in (text_col, ids_col, bytes_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value, pattern)
        for b in batches:
            ids = _lists([c.encode(x or "") for x in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), ids, c.decode_all(*_flat(ids))], names=[*(b.schema.names[i] for i in kept), ids_col, bytes_col])

    return df.mapInArrow(run, T.StructType([*(df.schema[i] for i in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(bytes_col, T.BinaryType())]))


def decode_text(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded_text") -> DataFrame:
    """df with the text of ids, put together by the UTF-8 machine."""
    held = vocabulary(df.sparkSession, path)

    def make(ids: pa.Array) -> pa.Array:
        c = codec(held.value, pattern)
        flat, size = _flat(ids)
        return pa.array(["".join(c.text_stream(x.tolist())) for x in np.split(flat, np.cumsum(size)[:-1])][: len(ids)], pa.string())

    return _mapped(df, ids_col, out_col, T.StringType(), make)


def op13_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    d = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op13_bpe": op13_bpe}
SQL: dict[str, str] = {}
