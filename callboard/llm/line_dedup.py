"""Repeated runs of lines, found by winnowing over line hashes.

A run of at least LINES consecutive lines that stands earlier in the corpus too is deleted where it
stands later; so are fewer neighbouring lines that have LONG_LINE words together, down to a single line.
"Earlier" is by doc_id, then place. Blank lines are stepped over and stay. All is judged on the input,
not on what is left.

Every LINES neighbouring line hashes are a window, and so are as many lines from any line on as it takes to
LONG_LINE words, if they are fewer. A window selects its least hash (the first of equals) as fingerprint.
A selected position is one row, whichever windows select it, so there is one for about every second line:

1. Only fingerprints that stand at two positions or more go on. Equal windows have equal fingerprints at
   equal places, so no repeated window is without one.
2. Positions of equal fingerprints are matched by extending both ways, over the lines before and after
   that the windows which selected them cover; windows agree if all their line hashes do.
3. Of windows that agree the earliest stays, and the lines of every other are deleted. Longer runs are unions of
   windows.

Lines and windows are compared by 128-bit hashes. No group of equal windows is ever gathered: only counted,
and its least position taken. What is counted is written before it is joined, so either side of a join is
a plain shuffle and a line that very many documents have is divided over tasks.

Defined results: null and empty texts have no lines and stay as they are; rows that share a doc_id
are ordered by the hash of their text, and equal rows keep the same lines; a null doc_id comes
before all others. Of a very long text only one has to fit a task. Columns of the input stay, but for n_lines
and n_removed, which are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, others, portions, schema, with_columns, written

LINES = 3
LONG_LINE = 50
# Fixed value: characters that do not make a word.
BLANKS = r"[\x20\x09-\x0D]+"
# Names for a join with a frame of any columns.
_JOINED = ["__doc", "__print_of", "__later"]


def full_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """(lines, numbers of those with words)."""
    lines = text.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.split(None, 1)]


def positions(text: bytes, size: int = LINES, long_line: int = LONG_LINE) -> Iterator[tuple[int, int, list[tuple[int, int, bytes]]]]:
    """(place, fingerprint, windows that select it) of each selected line; a window is (first, lines, hash of them all).

    Places count lines with words.
    """
    lines, full = full_lines(text)
    prints = [xxhash.xxh3_128_digest(lines[i]) for i in full]
    words = [len(lines[i].split()) for i in full]
    selected: dict[int, list[tuple[int, int, bytes]]] = {}

    def select(first: int, n: int) -> None:
        own = prints[first : first + n]
        at = first + own.index(min(own))
        selected.setdefault(at, []).append((first, n, xxhash.xxh3_128_digest(b"".join(own), n)))

    for first in range(len(full)):
        if first + size <= len(full):
            select(first, size)
        total = 0
        # From ``size`` lines on, the window above covers the passage.
        for n, more in enumerate(words[first : first + max(1, size - 1)], 1):
            total += more
            if total >= long_line:
                select(first, n)
                break
    for at, found in selected.items():
        yield at, int.from_bytes(prints[at][:8], "little", signed=True), found


_WINDOW = pa.struct([("first", pa.int32()), ("lines", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])


def _position_rows(rows: DataFrame, size: int, long_line: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            found = [(i, *row) for i, text in enumerate(texts) for row in positions(text, size, long_line)]
            own = [window for *_, chosen in found for window in chosen]
            hashes = np.frombuffer(b"".join([window[2] for window in own]), "<i8").reshape(-1, 2)
            columns = [pa.array([window[i] for window in own], pa.int32()) for i in range(2)]
            columns += [pa.array(np.ascontiguousarray(hashes[:, i])) for i in range(2)]
            offsets = pa.array(np.cumsum([0, *(len(chosen) for *_, chosen in found)]), pa.int32())
            made = {
                "place": pa.array([row[1] for row in found], pa.int32()),
                "fingerprint": pa.array([row[2] for row in found], pa.int64()),
                "windows": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_WINDOW))),
            }
            owners = pa.array([row[0] for row in found], pa.int64())
            yield with_columns(batch.select(["doc", "print"]).take(owners), ["doc", "print"], made)

    made = "place int, fingerprint long, windows array<struct<first: int, lines: int, h: long, g: long>>"
    return rows.mapInArrow(work, schema(rows, ["doc", "print"], made))


def later_windows(df: DataFrame, key: str, text: str, size: int, long_line: int) -> DataFrame:
    """(doc, print of the text, later): windows (first, lines) that stand earlier too."""
    rows = df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    found = written(_position_rows(rows, size, long_line), "line-positions")

    place = F.struct("doc", "print", "place")
    spread = found.groupBy("fingerprint").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = written(spread.where("first != last").select("fingerprint"), "line-fingerprints")
    matched = found.join(repeated.hint("merge"), "fingerprint", "left_semi").select("doc", "print", F.inline("windows"))

    here = F.struct("doc", "print", "first")
    least = matched.groupBy("lines", "h", "g").agg(F.min(here).alias("least"), F.max(here).alias("most"))
    least = written(least.where("least != most").select("lines", "h", "g", "least"), "line-windows")
    later = matched.join(least.hint("merge"), ["lines", "h", "g"]).where(here > F.col("least"))
    # A set, made inside tasks first: rows that repeat each other add nothing to it.
    later = written(later.groupBy("doc", "print").agg(F.collect_set(F.struct("first", "lines")).alias("later")), "later-lines")
    for done in (found, repeated, least):
        discard(done)
    return later


def deduplicated(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = LINES, long_line: int = LONG_LINE
) -> DataFrame:
    """``df`` with the later lines taken out of ``text``, and n_lines and n_removed added."""
    made = ["n_lines", "n_removed"]
    # One plan at every size: a side that is small for now is not sent to all tasks.
    found = later_windows(df, key, text, size, long_line).toDF(*_JOINED).hint("merge")
    rows = df.select(*others(df, made), F.xxhash64(text).alias("__print"))
    rows = rows.join(found, rows[key].eqNullSafe(found[_JOINED[0]]) & (rows["__print"] == found[_JOINED[1]]), "left")
    plain = others(df, [*made, text])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, text):
            left, counts, removed = [], [], []
            for before, is_null, later in zip(texts, batch.column(text).is_null(), batch.column(_JOINED[2]).to_pylist(), strict=True):
                lines, full = full_lines(before)
                gone = {i for window in later or () for i in full[window["first"] : window["first"] + window["lines"]]}
                left.append(None if is_null.as_py() else b"\n".join([x for i, x in enumerate(lines) if i not in gone]).decode())
                counts.append(len(lines) if before else 0)
                removed.append(len(gone))
            yield with_columns(
                batch,
                plain,
                {text: pa.array(left, pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())},
            )

    made_schema = schema(rows, plain, f"`{text}` string, n_lines long, n_removed long")
    return rows.select(*plain, text, _JOINED[2]).mapInArrow(work, made_schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, counts of lines, and the digest of what is left of every text."""
    left = deduplicated(df.select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_repeats(df: DataFrame) -> DataFrame:
    """``df`` with later lines taken out; texts of which nothing but blanks is left go, if lines were taken out."""
    left = deduplicated(df)
    emptied = (F.col("n_removed") > 0) & (F.length(F.regexp_replace("text", BLANKS, "")) == 0)
    return left.where(~emptied).select(*df.columns)
