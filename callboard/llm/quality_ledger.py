"""Quality rules as a ledger of bits.

Every measurement of a text is taken once, every rule is evaluated once on them and leaves one
bit in ``failed``. A policy is a version name and the rules that count under it; applying one, or
asking what each of its rules does alone, is bit arithmetic on the ledger and reads no text again.

Defined results: a null or empty text has no words and one line; all its measurements are 0 but
``n_lines``. Rules that divide by words are written as products, so that 0 words fail only the
rules that say so. Repeated rows are measured one by one. Equality of words and lines inside a
text is decided by 64-bit hashes with random byte values. A text is measured whole, so the longest has to fit a
task. Columns of the input named like a measurement or ``failed`` are replaced, all others are kept; an empty table
gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hasher, mixed, others, portions, schema, with_columns

# Fixed values of the measurements.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
)
_NAMES = [part.split()[0] for part in MEASURES.split(", ")]
_HASHER = Hasher(5)


def _member(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_BLANK, _SYMBOL = _member(BLANKS), _member(SYMBOLS)
_CONTINUES = np.arange(256) & 0xC0 == 0x80


def _again(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys occur twice or more with one owner, which of them are not the first)."""
    order = np.lexsort((keys, owners))
    same = (keys[order][1:] == keys[order][:-1]) & (owners[order][1:] == owners[order][:-1])
    repeated, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True  # lexsort is stable: the first of equals stays out
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    return repeated, later


def measure_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Measurements of each text. Texts are put in one line-separated string and measured together."""
    n = len(texts)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(text) + 1 for text in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags, dtype=np.int64))
        return sums[ends] - sums[begins]

    blank = _BLANK[data]
    change = np.diff(blank.astype(np.int8), prepend=1)
    starts, stops = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    owner = np.searchsorted(ends, starts, "right")
    sums = _HASHER.prepare(data)
    words = _HASHER.slices(sums, starts, stops)

    covered = np.zeros(len(words), bool)
    if len(words) >= WINDOW:
        last = len(words) - WINDOW + 1
        windows = reduce(lambda h, i: mixed(h) + words[i : last + i], range(WINDOW), np.zeros(last, np.uint64))
        whole = np.flatnonzero(owner[:last] == owner[WINDOW - 1 :])
        repeated, _ = _again(windows[whole], owner[whole])
        for i in range(WINDOW):
            covered[whole[repeated] + i] = True

    line_stops = np.flatnonzero(data == ord("\n"))
    line_starts = np.append(0, line_stops[:-1] + 1)
    line_owner = np.searchsorted(ends, line_starts, "right")
    with_word = np.searchsorted(starts, line_stops) > np.searchsorted(starts, line_starts)
    lines = _HASHER.slices(sums, line_starts[with_word], line_stops[with_word])
    _, later = _again(lines, line_owner[with_word])

    def per_text(owners: np.ndarray) -> np.ndarray:
        return np.bincount(owners, minlength=n)

    return {
        "n_words": per_text(owner),
        "word_chars": total(~blank & ~_CONTINUES[data]),
        "n_symbols": total(_SYMBOL[data]),
        "n_lines": per_text(line_owner),
        "n_dup_lines": per_text(line_owner[with_word][later]),
        "n_repeat_words": per_text(owner[covered]),
    }


def measured(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (default: all) and the measurements of each text."""
    kept = others(df.select(*keep) if keep is not None else df, _NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, text):
            found = measure_texts(texts)
            yield with_columns(batch, kept, {k: pa.array(found[k], pa.int64()) for k in _NAMES})

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(work, schema(df, kept, MEASURES))


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on the measurements; its place in the list of rules is its bit."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that count in it."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("2", ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words")),
)
CURRENT = POLICIES[-1]


def ledger(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``failed``: bit i is set where rule i fails (a rule that is null does not fail)."""
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules)]
    failed = reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))
    return df.select(*others(df, ["failed"]), failed.alias("failed"))


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    places = {rule.name: i for i, rule in enumerate(rules)}
    return sum(1 << places[name] for name in set(policy.rules))


def passes(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(entries: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule does in each policy: rows it fails, rows that only it fails.

    The ledger is first counted by its bits, so the texts behind it are not needed and at most
    2^rules rows are left to work on, whatever its size.
    """
    counted = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("rows"))
    asked = F.array(
        *(
            F.struct(
                F.lit(policy.version).alias("version"),
                F.lit(rule.name).alias("rule"),
                F.lit(1 << i).cast("long").alias("bit"),
                F.lit(mask(policy, rules)).cast("long").alias("mask"),
            )
            for policy in policies
            for i, rule in enumerate(rules)
            if rule.name in policy.rules
        )
    )
    each = counted.select("failed", "rows", F.inline(asked))
    relevant = F.col("failed").bitwiseAND(F.col("mask"))
    return each.groupBy("version", "rule").agg(
        F.sum(F.when(relevant.bitwiseAND(F.col("bit")) != 0, F.col("rows")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(relevant == F.col("bit"), F.col("rows")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(relevant == 0, F.col("rows")).otherwise(0)).alias("n_kept"),
        F.sum("rows").alias("n_rows"),
    )


def judged(df: DataFrame, keep: list[str], policy: Policy = CURRENT) -> DataFrame:
    """Measurements, failure bits, ``base_failed`` and ``kept`` of every row."""
    entries = ledger(measured(df, keep=keep))
    return entries.withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(policy)})
