"""Benchmark passages in documents, by Wu-Manber search for many strings.

Documents and items are reduced to their words (A-Z lower-cased, runs of digits, letters a-z and
whatever is not ASCII), joined by single spaces with a space at either end. The strings looked for
are the items' windows of consecutive words in the same form. Strings of similar length (within a
factor of two) share a table: m is their least length, and for every block of bytes in their first
m bytes the table has how far the block stands from place m. Reading the block that ends at the
present place, a search moves on by that many bytes, or by m - block + 1 where no string has the
block. Only where the shift is 0, so the block is the last of a string's first m bytes, the
strings with that block are compared with the text itself.

The benchmark is cut into parts of at most PART window starts, which overlap by a window less one
word, and equal parts are one. They are dealt with in blocks of about BLOCK_TEXT bytes, each sent to
the executors whole; as parts are short, a long item or one that is repeated makes no block larger.
The documents pass by one block after the other (written in between if there are several) and are
never shuffled.

Defined results: null or wordless texts have no words and no windows; an item of fewer words than
a window is one window; rows that repeat an item_id are parts of one item; an item whose id is
null can be hit but is not listed. A document of any length is searched whole.
Repeated rows are searched one by one. Columns of the input named like an output column are replaced, all others are
kept. Without documents there are no rows, without items nothing is hit.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import others, portions, schema, with_columns, written

WINDOW = 10
# Bytes that a shift table looks at (fewer where strings are shorter).
BLOCK = 8
# Benchmark text sent to the executors at a time. Its tables take some two hundred times as much.
BLOCK_TEXT = 1 << 20
# Window starts of an item that stay together.
PART = 2_000

_KEEP = {*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_TO_WORDS = bytes(b if b in _KEEP else ord(" ") for b in bytes(range(256)).lower())

MADE = "n_words long, n_hit long, spans array<struct<first: int, stop: int>>, items array<string>"
_NAMES = ["n_words", "n_hit", "spans", "items"]


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def windows(item: bytes, size: int = WINDOW) -> list[bytes]:
    """The windows of an item as byte strings with a space at either end."""
    found = words(item)
    return [b" %b " % b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))] if found else []


class ShiftTable:
    """Strings of similar length: shifts by block, and strings by the last block of their first m bytes."""

    def __init__(self, strings: list[bytes]):
        self.m = min(map(len, strings))
        self.block = min(BLOCK, self.m)
        self.furthest = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.strings: dict[bytes, list[bytes]] = defaultdict(list)
        for string in strings:
            for end in range(self.block, self.m + 1):
                part = string[end - self.block : end]
                self.shift[part] = min(self.shift.get(part, self.furthest), self.m - end)
            self.strings[string[self.m - self.block : self.m]].append(string)

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(place, string) of every occurrence."""
        shift, furthest, block, m, strings = self.shift.get, self.furthest, self.block, self.m, self.strings
        end, n = m, len(text)
        while end <= n:
            part = text[end - block : end]
            step = shift(part, furthest)
            if step:
                end += step
                continue
            for string in strings[part]:
                if text.startswith(string, end - m):
                    yield end - m, string
            end += 1


class Matcher:
    def __init__(self, items: Iterable[tuple[str | None, bytes]], size: int):
        self.items: dict[bytes, set[str | None]] = defaultdict(set)
        for item, text in items:
            for window in windows(text, size):
                self.items[window].add(item)
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for window in self.items:
            by_length[len(window).bit_length()].append(window)
        self.tables = [ShiftTable(strings) for strings in by_length.values()]

    def hits(self, found: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """(which words of a document are inside an occurrence, the items that occur)."""
        text = b" %b " % b" ".join(found)
        marks = np.zeros(len(found) + 1, np.int64)
        items: set[str | None] = set()
        ends = None
        for table in self.tables:
            for place, window in table.search(text):
                if ends is None:
                    ends = np.cumsum([len(word) + 1 for word in found])  # the space after each word
                first = int(np.searchsorted(ends, place, "right"))
                marks[first] += 1
                marks[first + window.count(b" ") - 1] -= 1
                items |= self.items[window]
        return np.cumsum(marks[:-1]) > 0, items


@functools.lru_cache(1)
def _matcher(items: tuple[tuple[str | None, bytes], ...], size: int) -> Matcher:
    return Matcher(items, size)


def parts(item: bytes, size: int = WINDOW, most: int = PART) -> list[bytes]:
    """An item's words in parts; every window of the item is in one of them, and no others are."""
    found = words(item)
    starts = range(0, max(1, len(found) - size + 1), most) if found else ()
    return [b" ".join(found[i : i + most + size - 1]) for i in starts]


def _part_rows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(item, text): the different parts of all items."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    most = PART

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            cut = [parts(raw, size, most) for raw in texts]
            owners = np.repeat(np.arange(len(cut)), [len(own) for own in cut])
            found = pa.array([part for own in cut for part in own], pa.binary())
            yield with_columns(batch.select(["item"]).take(pa.array(owners)), ["item"], {"text": found})

    return rows.mapInArrow(work, "item string, text binary").distinct()


def _blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[tuple[tuple[str | None, bytes], ...]]:
    """The benchmark in blocks of bounded text, whatever its size; one empty block if it has none."""
    rows = written(_part_rows(benchmark, item, text, size), "benchmark-parts")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_TEXT))
    place = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for i in range(n):
        yield tuple((r.item, bytes(r.text)) for r in rows.where(place == i).collect())


def _pass(df: DataFrame, items: tuple, text: str, size: int, kept: list[str]) -> DataFrame:
    """Search one block of the benchmark; adds to what earlier blocks have found."""
    block = df.sparkSession.sparkContext.broadcast(items)
    found_before = "spans" in df.columns
    types = {field.name: to_arrow_type(field.dataType) for field in schema(df, [], MADE)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block.value, size)
        for batch, texts in portions(batches, text):
            earlier = zip(*(batch.column(c).to_pylist() for c in ("spans", "items")), strict=True) if found_before else None
            made: dict[str, list] = {name: [] for name in _NAMES}
            for document in texts:
                found = words(document)
                inside, names = matcher.hits(found)
                if earlier:
                    spans, more = next(earlier)
                    for span in spans:
                        inside[span["first"] : span["stop"]] = True
                    names |= set(more)
                edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).tolist()
                made["n_words"].append(len(found))
                made["n_hit"].append(int(inside.sum()))
                made["spans"].append([{"first": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                made["items"].append(sorted(names - {None}))
            yield with_columns(batch, kept, {name: pa.array(made[name], kind) for name, kind in types.items()})

    return df.mapInArrow(work, schema(df, kept, MADE))


def search(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    size: int = WINDOW,
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add n_words, n_hit, ``spans`` of words inside occurrences and ``items``, the sorted ids that occur."""
    kept = others(df.select(*keep) if keep is not None else df, _NAMES)
    carried = list(dict.fromkeys([*kept, text]))
    found = df.select(*carried)
    blocks = _blocks(benchmark, item, item_text, size)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        last = after is None
        found = _pass(found, block, text, size, kept if last else carried)
        if not last:
            found = written(found, "benchmark-hits")
        block = after
    return found


def report(df: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of words hit and of items, one row per document."""
    return search(df, benchmark, keep=keep).select(
        *keep,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df`` in which no window of the benchmark occurs."""
    return search(df, benchmark).where("n_hit = 0").select(*df.columns)
