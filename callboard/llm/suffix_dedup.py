"""Exact removal of long repeated byte strings, by grouping suffixes bucket by bucket.

A byte goes if a string of MATCH bytes that covers it also starts anywhere else in the corpus. That
is a question about neighbours in the suffix array: does the suffix that starts here share its
first MATCH bytes with another? Sorting all suffixes would move many times the corpus, so they are
dealt into buckets by content, most buckets are settled without looking at single suffixes, and
long ties are settled by ranks of a sample instead of by their bytes. Within a bucket nothing is
sorted: equal suffixes are all that is looked for, so grouping by 128-bit hashes of their bytes takes
the place of the sort and of ranks with an order. Equal rows then combine inside tasks, and no bucket
has to be gathered and put in order:

1. *Buckets.* A suffix belongs to the bucket of the least hash among the GRAM-byte strings in its
   first MATCH bytes (the first of equals), its anchor. Suffixes that agree on MATCH bytes have the
   same anchor at the same distance, and neighbouring suffixes mostly share theirs, so a whole
   stretch of suffixes is one row: a block. A bucket with a single block has no repeat. Blocks with
   equal bytes repeat whole; one of them stands for all from here on.
2. *Cover sample.* In buckets with different blocks, every PERIOD-th position before the anchor is a
   sample position. The anchor fixes the phase: suffixes that may agree have equal distances to it,
   so one residue covers every difference (0) that can occur, and each suffix has a sample position
   at most PERIOD - 1 bytes on. The MATCH - PERIOD + 1 bytes from there get a rank (equal strings,
   equal ranks; a 128-bit hash serves), which stands for the long middle of PERIOD suffixes.
3. *Ties.* What is left of a suffix is fewer than PERIOD bytes on both sides of that middle. Only
   where a rank occurs more than once with different sides are suffixes taken one by one, as rank
   and side bytes, and those that occur twice are repeats.

Every step counts and joins by content, so memory is bounded by a portion of text in the workers,
and a bucket of any size is only ever counted, never gathered. Texts longer than a portion are cut
into overlapping portions; that splits blocks, not results.

Defined results: null and empty texts have no bytes; texts shorter than MATCH keep everything;
repeated rows repeat each other; rows that share a doc_id are told apart by their text.
Columns of the input named like an output column are replaced, all others are kept under any name. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, discard, mixed, others, portions, schema, small_batches, with_columns, written

# Suffixes looked at together; positions below this many bits share a number with their hash.
STRETCH = 1 << 18
_PLACE_BITS = np.uint64(21)
_PLACE = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
_HASHER = Hasher(1)


@dataclass(frozen=True)
class Sizes:
    """Bytes of a match, of the strings that anchor buckets, and between sample positions."""

    match: int = 400
    gram: int = 48
    period: int = 32

    @property
    def middle(self) -> int:
        return self.match - self.period + 1


DEFAULT = Sizes()


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima of rows of that width in both directions."""
    n = len(values)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def find_blocks(data: np.ndarray, ends: np.ndarray, sizes: Sizes) -> Iterator[tuple[np.ndarray, ...]]:
    """(first suffix, last suffix, anchor, bucket) of the blocks in texts put end to end; ``ends`` has their ends."""
    total = len(data)
    for begin in range(0, total - sizes.match + 1, STRETCH):
        part = data[begin : begin + STRETCH + sizes.match - 1]
        n = len(part)
        sums = _HASHER.prepare(part)
        grams = n - sizes.gram + 1
        hashes = mixed((sums[sizes.gram :] - sums[:grams]) * _HASHER.powers.down[:grams])
        packed = (hashes & ~_PLACE) | np.arange(grams, dtype=np.uint64)
        anchors = (sliding_least(packed, sizes.match - sizes.gram + 1) & _PLACE).astype(np.int64)
        count = len(anchors)
        # The suffixes of a text end before its last bytes; no array as long as the text is needed for that.
        for end in ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, begin + count + sizes.match, "left") + 1].tolist():
            anchors[max(0, end - sizes.match + 1 - begin) : max(0, end - begin)] = -1
        edges = np.flatnonzero(np.diff(anchors)) + 1
        first = np.append(0, edges)
        last = np.append(edges, count) - 1
        own = anchors[first] >= 0
        first, last = first[own], last[own]
        at = anchors[first]
        yield first + begin, last + begin, at + begin, hashes[at].view(np.int64)


def _numbers(digests: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(2)]


def blocks(rows: DataFrame, sizes: Sizes = DEFAULT) -> DataFrame:
    """Blocks of every text: place in it, bucket, and a 128-bit hash (c1, c2) of all its bytes."""
    made = "first int, last int, anchor int, bucket long, c1 long, c2 long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            raw = b"".join(texts)
            ends = np.cumsum([len(text) for text in texts])
            keys = batch.select(["doc", "print"])
            for first, last, anchor, bucket in find_blocks(np.frombuffer(raw, np.uint8), ends, sizes):
                owner = np.searchsorted(ends, first, "right")
                begin = (np.append(0, ends)[owner]).astype(np.int64)
                digest, more = xxhash.xxh3_128_digest, sizes.match
                content = [digest(raw[a : b + more], c - a) for a, b, c in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)]
                places = {name: pa.array(x - begin, pa.int32()) for name, x in (("first", first), ("last", last), ("anchor", anchor))}
                c1, c2 = _numbers(content)
                yield with_columns(
                    keys.take(pa.array(owner)), ["doc", "print"], {**places, "bucket": pa.array(bucket), "c1": c1, "c2": c2}
                )

    return rows.mapInArrow(work, schema(rows, ["doc", "print"], made))


def settled(rows: DataFrame, bucket: list[str], content: list[str], carried: list[str]) -> DataFrame:
    """(bucket, content, n, variants, one): contents of buckets with two rows or more.

    ``n`` rows have the content, the bucket has ``variants`` of them, ``one`` has the ``carried``
    columns of one of the rows.
    """
    counts = rows.groupBy(*bucket, *content).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*carried)).alias("one"))
    totals = counts.groupBy(*bucket).agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("total"))
    return written(counts.join(totals.where("total > 1").drop("total"), bucket), "contents")


def samples(rows: DataFrame, sizes: Sizes = DEFAULT) -> DataFrame:
    """Sample positions of the blocks listed in ``todo`` (first, last, anchor).

    Each stands for the suffixes that start 0 to period - 1 bytes before it: (m1, m2) is the rank of
    the middle from there, ``before`` and ``after`` are the bytes around it, and the suffixes are
    those from ``least`` to ``most`` bytes back.
    """
    made = "place int, least int, most int, m1 long, m2 long, before binary, after binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, period, middle = xxhash.xxh3_128_digest, sizes.period, sizes.middle
        for batch, texts in portions(batches, "text"):
            owners, places, least, most, ranks, before, after = [], [], [], [], [], [], []
            for i, (text, todo) in enumerate(zip(texts, batch.column("todo").to_pylist(), strict=True)):
                for block in todo:
                    first, last, anchor = block["first"], block["last"], block["anchor"]
                    for turn in range((anchor - last) // period, (anchor - first) // period + 1):
                        place = anchor - turn * period
                        low, high = max(0, place - last), min(period - 1, place - first)
                        owners.append(i)
                        places.append(place)
                        least.append(low)
                        most.append(high)
                        ranks.append(digest(text[place : place + middle], turn))
                        before.append(text[place - high : place])
                        after.append(text[place + middle : place + middle + period - 1 - low])
            m1, m2 = _numbers(ranks)
            yield with_columns(
                batch.select(["doc", "print"]).take(pa.array(owners, pa.int64())),
                ["doc", "print"],
                {
                    "place": pa.array(places, pa.int32()),
                    "least": pa.array(least, pa.int32()),
                    "most": pa.array(most, pa.int32()),
                    "m1": m1,
                    "m2": m2,
                    "before": pa.array(before, pa.binary()),
                    "after": pa.array(after, pa.binary()),
                },
            )

    return rows.mapInArrow(work, schema(rows, ["doc", "print"], made))


def _with_text(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Texts joined to what was found for them (``doc``, ``print`` and one more column)."""
    renamed = found.withColumnsRenamed({"doc": "__doc", "print": "__print"})
    same = rows["doc"].eqNullSafe(renamed["__doc"]) & (rows["print"] == renamed["__print"])
    return rows.join(renamed, same, how).drop("__doc", "__print")


def repeats(rows: DataFrame, sizes: Sizes = DEFAULT) -> DataFrame:
    """(doc, print, todo): stretches of bytes covered by repeated matches, from rows (doc, print, text).

    They are written before the texts are moved again, and what led to them is removed.
    """
    with small_batches(rows.sparkSession):
        return _repeats(rows, sizes)


def _repeats(rows: DataFrame, sizes: Sizes) -> DataFrame:
    key = ["doc", "print"]
    whole = written(blocks(rows, sizes), "blocks")
    contents = settled(whole, ["bucket"], ["c1", "c2"], [*key, "first", "last", "anchor"])
    equal = contents.where("n > 1").select("bucket", "c1", "c2")
    in_blocks = whole.join(equal, ["bucket", "c1", "c2"], "left_semi").select(
        *key, F.col("first").alias("start"), (F.col("last") + sizes.match).alias("stop")
    )

    open_blocks = contents.where("variants > 1").select("one.*")
    todo = open_blocks.groupBy(*key).agg(F.collect_list(F.struct("first", "last", "anchor")).alias("todo"))
    sampled = written(samples(_with_text(rows, todo, "inner"), sizes), "samples")
    rank, sides = ["m1", "m2"], ["least", "most", "before", "after"]
    ranks = settled(sampled, rank, sides, [*key, "place"])
    in_samples = sampled.join(ranks.where("n > 1").select(*rank, *sides), [*rank, *sides], "left_semi").select(
        *key,
        (F.col("place") - F.col("most")).alias("start"),
        (F.col("place") - F.col("least") + sizes.match).alias("stop"),
    )

    single = ranks.where("variants > 1").select(*rank, *sides, "one.*")
    single = single.withColumn("back", F.explode(F.sequence("least", "most")))
    left = F.substring("before", F.col("most") - F.col("back") + 1, F.col("back"))
    right = F.substring("after", F.lit(1), sizes.period - 1 - F.col("back"))
    suffixes = single.select(*key, "place", "back", *rank, left.alias("left"), right.alias("right"))
    same = [*rank, "back", "left", "right"]
    twice = suffixes.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    alone = suffixes.join(twice, same, "left_semi").select(
        *key,
        (F.col("place") - F.col("back")).alias("start"),
        (F.col("place") - F.col("back") + sizes.match).alias("stop"),
    )
    stretches = in_blocks.unionByName(in_samples).unionByName(alone)
    # A set, made inside tasks first: rows that repeat each other add nothing to it.
    found = written(stretches.groupBy(*key).agg(F.collect_set(F.struct("start", "stop")).alias("todo")), "repeats")
    for table in (whole, contents, sampled, ranks):
        discard(table)
    return found


def merged(stretches: list[dict]) -> list[tuple[int, int]]:
    """Stretches in order, those that meet or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


MADE = "kept binary, n_bytes long, removed array<struct<start: int, stop: int>>"


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", sizes: Sizes = DEFAULT, keep: list[str] | None = None) -> DataFrame:
    """Kept columns (default: all but the text), the bytes left, the length before, and the stretches removed."""
    names = ["kept", "n_bytes", "removed"]
    kept = others(df.select(*keep) if keep is not None else df.drop(text), names)
    rows = df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    whole = df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("print"), F.col(text).alias("text"), F.struct(*kept).alias("kept"))
    joined = _with_text(whole, repeats(rows, sizes), "left")
    fields = {field.name: field for field in df.select(*kept).schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            left, spans = [], []
            for raw, todo in zip(texts, batch.column("todo").to_pylist(), strict=True):
                own = merged(todo or [])
                cuts = [0, *(x for span in own for x in span), len(raw)]
                left.append(b"".join([raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]))
                spans.append([{"start": a, "stop": b} for a, b in own])
            carried = batch.column("kept")
            columns = {name: carried.field(i) for i, name in enumerate(fields)}
            made = {
                "kept": pa.array(left, pa.binary()),
                "n_bytes": pa.array([len(raw) for raw in texts], pa.int64()),
                "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            }
            both = columns | made
            yield pa.RecordBatch.from_arrays(list(both.values()), names=list(both))

    return joined.select("text", "todo", "kept").mapInArrow(work, schema(df, kept, MADE))


def digests(df: DataFrame, sizes: Sizes = DEFAULT) -> DataFrame:
    """doc_id, length, bytes and runs removed, and the digest of what is left of every text.

    The digests are written, so that the pass over the texts runs with small batches.
    """
    found = removed(df, sizes=sizes, keep=["doc_id"])
    with small_batches(df.sparkSession):
        return written(_digested(found), "digests")


def _digested(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
