"""Periodic stretches of words, found with string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are equal) that holds the period
at least twice and has SHORTEST words or more, and that no neighbouring word extends. All runs of a
text are found, whatever their period:

1. *Small periods.* For every period below SMALL the words are compared with those that many places
   on. The stretches of equality are the runs of that period, and the highly periodic regions that
   the first synchronising sets leave out.
2. *Synchronising sets* at scales t = SMALL/3, twice that, and so on. Position i is in the set if the
   least hash among the windows of t words that start at i to i + t is that of the first or the last
   of them; windows with a period of t/3 or less are left out. Whether i is in the set depends on the
   2t words from i alone (its context), and every 3t - 1 neighbouring words that have no period of
   t/3 or less have a position of the set among the first t. A run with a period p from 3t to below 6t
   that does not begin in a highly periodic region thus has two positions of equal context p apart.
   One that does begin in such a region has them about the place where the region ends.
3. *Pairs.* Positions with equal contexts less than 6t apart propose their distance as a period. Equal
   contexts are more than t/3 apart, since they are not highly periodic, so each meets at most 18
   others. Where both halves of a run are highly periodic themselves, no position may be left in
   them; those runs lie around two neighbouring regions of one period q, and the distances that bring
   the second into step with the first, every q-th number, are proposed too.
4. *Extension.* A proposal is extended both ways by comparing hashes of slices, in steps that halve.
   Of stretches with the same bounds the one with the smallest period is the run.

The highly periodic regions of a scale are runs found at the scales before. Words are compared by
64-bit hashes with random byte values, slices of words by 64-bit hashes of those.

Texts are taken a portion at a time and never cross tasks: memory is bounded by a portion or by the
longest text. There is no shuffle, so a hot source or group of copies changes nothing.

Defined results: a null, empty or blank text has no words, no runs and an empty ``collapsed``.
Repeated rows and ids are treated one by one. Columns of the input named like an output column are
replaced; all others are kept as they are. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, Powers, mixed, others, portions, schema, with_columns
from .suffix_dedup import sliding_least

SHORTEST = 12
# Periods below this are looked for one by one. A multiple of three.
SMALL = 12

MADE = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_NAMES = ["n_words", "runs", "collapsed"]
_WORDS = Hasher(11)
_NONE = np.iinfo(np.uint64).max
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


class Slices:
    """Hashes of slices of a sequence of 64-bit symbols."""

    powers = Powers(0x2545F4914F6CDD1D)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.powers.reach(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self.powers.up[:n], out=self.sums[1:])

    def windows(self, size: int, n: int) -> np.ndarray:
        """Hash of every window of ``size`` among the first ``n`` symbols."""
        return mixed((self.sums[size : n + 1] - self.sums[: n + 1 - size]) * self.powers.down[: n + 1 - size])

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return mixed((self.sums[starts + size] - self.sums[starts]) * self.powers.down[starts])

    def extend(self, places: np.ndarray, periods: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the stretch around each place in which symbols a period apart are equal."""
        right, left = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for step in (1 << bit for bit in range(max(n, 1).bit_length() - 1, -1, -1)):
            begin = places + right
            fits = np.flatnonzero(begin + periods + step <= n)
            right[fits[self.at(begin[fits], step) == self.at(begin[fits] + periods[fits], step)]] += step
            begin = places - left - step
            fits = np.flatnonzero(begin >= 0)
            left[fits[self.at(begin[fits], step) == self.at(begin[fits] + periods[fits], step)]] += step
        return places - left, places + periods + right


def small_runs(symbols: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in which symbols ``period`` apart are equal: runs, or three periods and more."""
    if len(symbols) <= period:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = symbols[period:] == symbols[:-period]
    edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2] + period
    long = stops - starts >= max(2 * period, min(SHORTEST, 3 * period))
    return starts[long], stops[long]


def synchronising_set(hashes: np.ndarray, left_out: np.ndarray, size: int) -> np.ndarray:
    """Positions whose window of ``size`` symbols, or the next that does not overlap it, has the least hash of both and all between."""
    values = np.where(left_out, _NONE, hashes)
    if len(values) <= size:
        return np.zeros(0, np.int64)
    least = sliding_least(values, size + 1)
    n = len(least)
    return np.flatnonzero((least != _NONE) & ((least == values[:n]) | (least == values[size : size + n])))


def _covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """True in the places from any start up to its stop."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    return np.cumsum(steps[:-1]) > 0


def equal_contexts(contexts: np.ndarray, places: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, distance) of equal contexts that are 3 to below 6 scales apart."""
    order = np.argsort(contexts, kind="stable")
    contexts, places = contexts[order], places[order]
    lag = 1
    while lag < len(places):
        distance = places[lag:] - places[:-lag]
        near = (contexts[lag:] == contexts[:-lag]) & (distance < 6 * scale)
        if not near.any():
            return
        far = near & (distance >= 3 * scale)
        yield places[:-lag][far], distance[far]
        lag += 1


def steps_between(slices: Slices, regions: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, distance) proposed by regions (start, stop, period) of one period that touch or overlap."""
    regions = regions[np.lexsort((regions[:, 0], regions[:, 2]))]
    here, there = regions[:-1], regions[1:]
    touch = (here[:, 2] == there[:, 2]) & (there[:, 0] <= here[:, 1])
    for (start, stop, period), (begin, _, _) in zip(here[touch].tolist(), there[touch].tolist(), strict=True):
        turns = np.arange(stop - 2 * period, stop - period)
        equal = turns[slices.at(turns, period) == slices.at(np.array([begin]), period)]
        for turn in equal.tolist():
            least = (begin - turn) % period
            least += -((least - 3 * scale) // period) * period
            distances = np.arange(least, min(6 * scale, stop - start + 1), period)
            yield stop - distances, distances


def find_runs(symbols: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, stop, period) of all runs of texts put end to end, in order of start and period.

    ``sizes`` has their lengths with the symbol that ends each and stands nowhere else, longest first.
    """
    ends = np.cumsum(sizes)
    found = [np.zeros((0, 3), np.int64)]

    def keep(starts: np.ndarray, stops: np.ndarray, periods: np.ndarray) -> None:
        """Add stretches to those found; equal bounds keep the smallest period."""
        both = np.concatenate([found[0], np.stack([starts, stops, periods], axis=1).astype(np.int64)])
        both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
        first = np.ones(len(both), bool)
        first[1:] = (both[1:, :2] != both[:-1, :2]).any(axis=1)
        found[0] = both[first]

    small = [(starts, stops, np.full(len(starts), p)) for p in range(1, SMALL) for starts, stops in [small_runs(symbols, p)]]
    keep(*(np.concatenate(part) for part in zip(*small, strict=True)))
    slices = Slices(symbols) if len(sizes) and sizes[0] > 2 * SMALL else None
    scale = SMALL // 3
    while slices is not None:
        # Only texts that can hold two periods of this scale.
        own = int(np.searchsorted(-sizes, -6 * scale, "left"))
        if not own:
            break
        n = int(ends[own - 1])
        regions = found[0][(found[0][:, 2] <= scale // 3) & (found[0][:, 1] <= n)]
        regions = regions[regions[:, 1] - regions[:, 0] >= scale]
        hashes = slices.windows(scale, n)
        left_out = _covered(regions[:, 0], regions[:, 1] - scale + 1, len(hashes))
        places = synchronising_set(hashes, left_out, scale)
        proposed = list(equal_contexts(slices.at(places, 2 * scale), places, scale))
        proposed += steps_between(slices, regions[regions[:, 1] - regions[:, 0] >= 3 * scale - 1], scale)
        if proposed:
            places, periods = (np.concatenate(part) for part in zip(*proposed, strict=True))
            starts, stops = slices.extend(places, periods, n)
            whole = stops - starts >= 2 * periods
            keep(starts[whole], stops[whole], periods[whole])
        scale *= 2
    runs = found[0]
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(shortest, 2 * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    change = np.diff(_BLANK[data].astype(np.int8), prepend=1)
    starts, stops = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    ends = np.cumsum([len(text) + 1 for text in texts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return _WORDS.slices(_WORDS.prepare(data), starts, stops), counts


def runs_of_texts(texts: list[bytes], shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each text (start, stop, period) of its runs, in words."""
    hashes, counts = word_hashes(texts)
    # Longest texts first, each followed by a symbol of its own.
    order = np.argsort(-counts, kind="stable")
    begins = np.cumsum(counts) - counts
    sizes = counts[order] + 1
    offsets = np.cumsum(sizes) - sizes
    symbols = np.empty(int(sizes.sum()), np.uint64)
    symbols[offsets + sizes - 1] = mixed(np.arange(len(texts), dtype=np.uint64) + np.uint64(0x5DEECE66D << 20))
    inner = np.ones(len(symbols), bool)
    inner[offsets + sizes - 1] = False
    symbols[inner] = hashes[np.repeat(begins[order] - (np.cumsum(counts[order]) - counts[order]), counts[order]) + np.arange(len(hashes))]
    runs = find_runs(symbols, sizes, shortest)
    cuts = np.searchsorted(runs[:, 0], np.append(offsets, len(symbols)))
    out: list[np.ndarray] = [runs[:0]] * len(texts)
    for i, text in enumerate(order.tolist()):
        out[text] = runs[cuts[i] : cuts[i + 1]] - np.array([offsets[i], offsets[i], 0])
    return out


def collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The words of a text joined by spaces, of every run the first period only."""
    words = text.split()
    if not len(runs):
        return b" ".join(words)
    gone = _covered(runs[:, 0] + runs[:, 2], runs[:, 1], len(words))
    return b" ".join([word for word, drop in zip(words, gone.tolist(), strict=True) if not drop])


def periodic_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None, shortest: int = SHORTEST) -> DataFrame:
    """Kept columns (default: all), ``n_words``, ``runs`` by start and period, and ``collapsed`` text without their repeats."""
    kept = others(df.select(*keep) if keep is not None else df, _NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, text):
            found = runs_of_texts(texts, shortest)
            every = np.concatenate(found)
            columns = [pa.array(x) for x in (every[:, 0], every[:, 1] - every[:, 0], every[:, 2])]
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            made = {
                "n_words": pa.array([len(raw.split()) for raw in texts], pa.int64()),
                "runs": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_RUN))),
                "collapsed": pa.array([collapsed(raw, runs).decode() for raw, runs in zip(texts, found, strict=True)], pa.string()),
            }
            yield with_columns(batch, kept, made)

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(work, schema(df, kept, MADE))


def digests(df: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest (ties: least start, then period) and digests of runs and of what is left."""
    rows = periodic_runs(df, keep=["doc_id"])
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less")))
    )
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest.alias("longest"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        (-F.col("longest.back")).alias("start"),
        "longest.length",
        (-F.col("longest.less")).alias("period"),
        F.floor(F.lit(1000) * F.col("longest.length") / -F.col("longest.less")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
