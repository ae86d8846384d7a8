"""Byte-level BPE: texts to token ids and back.

Texts are cut before merging by the rule of the rank files (contractions, runs of letters,
numbers or other characters with at most one space before them, white space). No regular
expression runs over the texts: every code point gets a class, each class (with a look at its
neighbours) is a function from state to state of a machine of four states, and a scan that
composes those functions gives the state at every code point of a portion at once. A function
of four states fits one byte, so composing two is one lookup.

Defined results: a null or empty text has no tokens; decoding no tokens gives no bytes; a text
of any length is encoded whole (one text is the unit of work, so memory grows with the longest).
Columns of the input whose names the operator makes are replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import others, portions, schema, with_columns

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Pieces whose tokens a Python worker remembers; it starts anew beyond that.
REMEMBERED = 500_000
# Pieces of more bytes are merged with a heap.
LONG_PIECE = 48

LETTER, NUMBER, SPACE, BLANK, OTHER = range(5)
# States: nothing special, in a run of other characters, one or two letters of a contraction to come.
PLAIN, RUN, ONE_MORE, TWO_MORE = range(4)
# Fixed values of the pattern: letters that make a contraction after an apostrophe.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")
CODE_POINTS = 0x110000


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own Unicode tables have it."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, CODE_POINTS)]))
    single = {bytes([i]): i for i in range(256)}
    table = np.full(CODE_POINTS, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = probe.decode_bytes(probe.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[ord(" ")] = SPACE
    return table


def _function(*to: int) -> int:
    return sum(state << (2 * i) for i, state in enumerate(to))


# Transition functions by kind of code point, given for the states in order.
STEP_PLAIN = _function(PLAIN, PLAIN, PLAIN, ONE_MORE)
STEP_RUN = _function(RUN, RUN, RUN, RUN)
STEP_ONE = _function(ONE_MORE, RUN, RUN, RUN)
STEP_TWO = _function(TWO_MORE, RUN, RUN, RUN)


@functools.cache
def _compositions() -> np.ndarray:
    """Table whose entry [f, g] is the function that applies f, then g."""
    functions = np.arange(256)
    table = np.zeros((256, 256), np.uint8)
    for state in range(4):
        after = functions >> (2 * state) & 3
        table |= ((functions[None, :] >> (2 * after[:, None]) & 3) << (2 * state)).astype(np.uint8)
    return table.ravel()


def _scan(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """Compositions of every prefix: rows of ``width`` side by side, then the rows' totals."""
    n = len(functions)
    if n <= 1:
        return functions
    table = _compositions()
    rows = -(-n // width)
    identity = _function(0, 1, 2, 3)
    grid = np.full(rows * width, identity, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for i in range(1, width):
        grid[i] = table[grid[i - 1].astype(np.uint16) << 8 | grid[i]]
    if rows > 1:
        before = _scan(grid[-1], width)[:-1].astype(np.uint16) << 8
        grid[:, 1:] = table[before[None, :] | grid[:, 1:]]
    return grid.T.ravel()[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a piece starts. ``first``: True at the first code point of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kinds = classes()[points]
    last = np.append(first[1:], True)

    def after(values: np.ndarray, steps: int) -> np.ndarray:
        """What stands so many places later in the same text, else 0."""
        out = np.zeros_like(values)
        out[:-steps or None] = values[steps:]
        out[last] = 0
        if steps == 2:
            out[:-1][last[1:]] = 0
        return out

    functions = np.full(n, STEP_PLAIN, np.uint8)
    functions[kinds == OTHER] = STEP_RUN
    quotes = np.flatnonzero(points == ord("'"))
    one, two = after(points, 1)[quotes], after(points, 2)[quotes]
    functions[quotes[np.isin(one, [ord(c) for c in ONE_LETTER])]] = STEP_ONE
    pairs = [ord(a) << 32 | ord(b) for a, b in TWO_LETTERS]
    functions[quotes[np.isin(one.astype(np.int64) << 32 | two, pairs)]] = STEP_TWO
    next_kind = after(kinds + np.uint8(1), 1)  # 0: the text ends
    functions[(kinds == SPACE) & (next_kind == OTHER + 1)] = STEP_RUN
    # A text begins in the plain state, whatever came before.
    functions[first] = (functions[first] & 3) * np.uint8(_function(1, 1, 1, 1))
    states = np.empty(n, np.uint8)  # before each code point
    states[0] = PLAIN
    states[1:] = _scan(functions)[:-1] & 3
    states[first] = PLAIN

    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, kinds[:-1]
    blank_before = (before == SPACE) | (before == BLANK)
    blank = (kinds == SPACE) | (kinds == BLANK)
    joined = (before == kinds) | (before == SPACE)  # letters, numbers: to their like or a space before
    joined[kinds == OTHER] = ((states == RUN) | (before == SPACE))[kinds == OTHER]
    # White space stays together, but its last character leaves the run if something follows.
    joined[blank] = (blank_before & ((next_kind == 0) | (next_kind == SPACE + 1) | (next_kind == BLANK + 1)))[blank]
    ended = np.zeros(n, bool)
    ended[1:] = states[:-1] == ONE_MORE  # a contraction ended just before
    joined[ended] = False
    joined[(states == ONE_MORE) | (states == TWO_MORE)] = True
    return first | ~joined


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


class Merger(dict):
    """Token ids of a piece as packed little-endian 32-bit numbers; remembers pieces it has met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        rank = self.ranks.get(piece)
        ids = [rank] if rank is not None else [self.ranks[part] for part in self.parts(piece)]
        packed = np.array(ids, "<u4").tobytes()
        self[piece] = packed
        return packed

    def parts(self, piece: bytes) -> list[bytes]:
        """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
        if len(piece) > LONG_PIECE:
            return self._parts_of_long(piece)
        get, none = self.ranks.get, CODE_POINTS
        cuts = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (lowest := min(pairs)) != none:
            i = pairs.index(lowest)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
        return [piece[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def _parts_of_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap of pairs and links between neighbours."""
        n, ranks = len(piece), self.ranks
        ends = list(range(1, n + 1))  # where the part that starts here ends; 0: part of an earlier one
        starts_before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                starts_before[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if i > 0 and (r := ranks.get(piece[starts_before[i] : end])) is not None:
                heapq.heappush(heap, (r, starts_before[i], end))
        parts, i = [], 0
        while i < n:
            parts.append(piece[i : ends[i]])
            i = ends[i]
        return parts


class Vocabulary:
    def __init__(self, raw: bytes):
        self.ranks = read_ranks(raw)
        self.merger = Merger(self.ranks)
        by_id: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(token) for token in by_id], np.int64)
        self.places = np.append(0, np.cumsum(self.lengths))[:-1]
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Packed ids of each text."""
        data = b"".join(texts)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        places = np.cumsum(sizes) - sizes
        text_ends = np.cumsum([len(text) for text in texts])
        first = np.zeros(len(points) + 1, bool)
        first[np.searchsorted(places, np.append(0, text_ends))] = True
        first = first[:-1]
        cuts = places[boundaries(points, first)]
        per_text = np.searchsorted(cuts, np.append(0, text_ends))
        cuts = [*cuts.tolist(), len(data)]
        merged = self.merger
        for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist(), strict=True):
            own = cuts[a : b + 1]
            yield b"".join([merged[data[x:y]] for x, y in zip(own, own[1:], strict=False)])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token begins."""
        lengths = self.lengths[ids]
        return (np.cumsum(lengths) - lengths).astype("<u4")

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        offsets = offsets.astype(np.int64) - int(offsets[0])
        source = np.repeat(self.places[ids] - offsets, lengths) + np.arange(int(offsets[-1] + lengths[-1]))
        return self.bytes[source].tobytes()


@functools.lru_cache(4)
def _vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def read_vocabulary(path: str | None = None) -> bytes:
    """A rank file (under a megabyte; it is sent to the executors whole)."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return file.read()


def _mapped(df: DataFrame, make: Callable, made: str, kept: list[str]) -> DataFrame:
    return df.mapInArrow(make, schema(df, kept, made))


def encode(df: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``token_ids`` and ``token_offsets``, packed little-endian 32-bit numbers.

    ``token_offsets`` has the byte of the text at which each token begins. ``keep`` names the
    columns to hand on (default: all).
    """
    made = ["token_ids", "token_offsets"]
    kept = others(df.select(*keep) if keep is not None else df, made)
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(raw.value)
        for batch, texts in portions(batches, text):
            ids = list(vocabulary.encode(texts))
            offsets = [vocabulary.offsets(np.frombuffer(x, "<u4")).tobytes() for x in ids]
            yield with_columns(batch, kept, dict(zip(made, (pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())), strict=True)))

    return _mapped(df.select(*dict.fromkeys([*kept, text])), work, "token_ids binary, token_offsets binary", kept)


def decode(df: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded``: the bytes of ``token_ids``, placed by ``token_offsets``.

    Any stretch of a text can be decoded: give the same stretch of ids and of offsets.
    """
    made = ["decoded"]
    kept = others(df.select(*keep) if keep is not None else df, made)
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(raw.value)
        for batch, packed in portions(batches, "token_ids"):
            places = batch.column("token_offsets").to_pylist()
            texts = [
                vocabulary.decode(np.frombuffer(ids, "<u4"), np.frombuffer(offsets or b"", "<u4"))
                for ids, offsets in zip(packed, places, strict=True)
            ]
            yield with_columns(batch, kept, {"decoded": pa.array(texts, pa.binary())})

    return _mapped(df.select(*dict.fromkeys([*kept, "token_ids", "token_offsets"])), work, "decoded binary", kept)


def ids_array(packed: str = "token_ids"):
    """Column expression: the packed ids as an array of numbers."""
    digits = F.hex(packed)
    places = F.when(F.length(packed) > 0, F.sequence(F.lit(0), (F.length(packed) / 4 - 1).cast("int")))
    turned = lambda i: F.concat(*(F.substring(digits, (i * 8 + k).cast("int"), F.lit(2)) for k in (7, 5, 3, 1)))
    return F.transform(places.otherwise(F.array().cast("array<int>")), lambda i: F.conv(turned(i), 16, 10).cast("long"))


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass, so that a task has one Python worker and not two."""
    made = ["token_ids", "token_offsets", "decoded"]
    kept = others(df.select(*keep) if keep is not None else df, made)
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(raw.value)
        for batch, texts in portions(batches, text):
            columns: dict[str, list[bytes]] = {name: [] for name in made}
            for packed in vocabulary.encode(texts):
                ids = np.frombuffer(packed, "<u4")
                offsets = vocabulary.offsets(ids)
                for name, value in zip(made, (packed, offsets.tobytes(), vocabulary.decode(ids, offsets)), strict=True):
                    columns[name].append(value)
            yield with_columns(batch, kept, {name: pa.array(values, pa.binary()) for name, values in columns.items()})

    kinds = ", ".join(f"{name} binary" for name in made)
    return _mapped(df.select(*dict.fromkeys([*kept, text])), work, kinds, kept)


def digests(df: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """Encode and decode; one row per text with counts and digests of both."""
    return round_trip(df, path=path, keep=keep).select(
        *keep,
        F.floor(F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
