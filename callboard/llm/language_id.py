"""Language of texts, by n-gram filters that answer with all languages at once.

Training counts the letter n-grams of every labelled text by language. A language *contains* an
n-gram if it makes up at least LEAST of its n-grams and at least SHARE of its rate in the language
that uses it most (stray sentences in another language thus put nothing into the filter). One Bloom
filter holds all languages: each slot has one bit per language, sliced into bytes, and an n-gram
sets its languages' bits in HASHES slots. Looking an n-gram up is the bitwise AND of its slots: the
set of languages that contain it. A text's n-grams are counted by language; as a language whose
bits fill a share f of the slots answers wrongly with probability f^HASHES, its count c out of n is
corrected to (c/n - f^HASHES) / (1 - f^HASHES), and the greatest wins (of equals, the first name).

The filter has a fixed size, SLOTS times one bit per language, whatever the corpus; it is what is
sent to the driver and the executors.

Defined results: ``und`` and score 0 where the text is null or has no letter; ``und`` everywhere if
nothing was learned. Letters outside any learned n-gram only lower the score. A document without
a doc_id is neither held out nor learned from. A text is looked at whole, so the longest has to fit a task.
Repeated rows are counted and predicted one by one; of equal counts the first language by name wins. Columns of the
input named like an output column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, others, portions, schema, with_columns, written

GRAM = 4
SLOTS = 1 << 20
HASHES = 3
LEAST = 1e-5
SHARE = 0.3
UNKNOWN = "und"
HELD_OUT_PARTS, HELD_OUT_PART = 4, 2
# n-grams that a task gathers before it counts them and hands the counts on.
COUNTED = 1 << 21


@functools.cache
def letters() -> np.ndarray:
    """True for code points that are letters."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, index of its text, number of letters of each text).

    Texts are lower-cased and everything but letters is a space. An n-gram has letters in all
    places but the first and the last, so it is within one word or at its edge.
    """
    lowered = " ".join([text.decode().lower() for text in texts] + [""])
    points = np.frombuffer(lowered.encode("utf-32-le"), np.uint32)
    is_letter = letters()[points]
    points = np.where(is_letter, points, ord(" "))
    sizes = np.array([len(text.decode().lower()) + 1 for text in texts], np.int64)
    ends = np.cumsum(sizes)
    sums = np.append(0, np.cumsum(is_letter))
    n_letters = sums[ends] - sums[ends - sizes]
    n = len(points) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    inner = np.ones(n, bool)
    for i in range(1, GRAM - 1):
        inner &= is_letter[i : n + i]
    hashes = np.zeros(n, np.uint64)
    for i in range(GRAM):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + points[i : n + i]
    places = np.flatnonzero(inner)
    return mixed(hashes[places]), np.searchsorted(ends, places, "right"), n_letters


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram."""
    return [(mixed(hashes + np.uint64(i + 1)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(HELD_OUT_PARTS)) == HELD_OUT_PART


def gram_counts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each language has each n-gram. Tasks count before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}

        def flushed(names: list[str]) -> Iterator[pa.RecordBatch]:
            for name in names:
                found, n = np.unique(np.concatenate(waiting.pop(name)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"],
                )

        for batch, texts in portions(batches, text):
            languages = batch.column(lang).to_pylist()
            for name in set(languages):
                own = [t for t, other in zip(texts, languages, strict=True) if other == name]
                waiting.setdefault(name, []).append(grams(own)[0])
            if sum(len(x) for parts in waiting.values() for x in parts) >= COUNTED:
                yield from flushed(list(waiting))
        yield from flushed(list(waiting))

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias(lang), text)
    return rows.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def contained(counts: DataFrame) -> DataFrame:
    """(lang, gram) for the n-grams that a language contains."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # one row per language
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= LEAST)
    # A row per language at most meets here, and at most 1/LEAST n-grams of each.
    best = F.max("rate").over(Window.partitionBy("gram"))
    return rates.withColumn("best", best).where(F.col("rate") >= SHARE * F.col("best")).select("lang", "gram")


class Filter:
    """The bit-sliced filter: ``bits`` has a row per slot and a bit per language."""

    def __init__(self, languages: list[str], bits: np.ndarray):
        self.languages, self.bits = languages, bits
        n = len(languages)
        filled = np.unpackbits(bits, axis=1, bitorder="little")[:, :n].mean(axis=0) if n else np.zeros(0)
        self.wrong = filled**HASHES

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        hashes, owner, n_letters = grams(texts)
        n, width = len(texts), len(self.languages)
        if not width:
            return [UNKNOWN] * n, np.zeros(n)
        counts = np.zeros((n, width))
        first, *more = slots(hashes)
        for byte in range(self.bits.shape[1]):
            answer = self.bits[first, byte]
            for other in more:
                answer = answer & self.bits[other, byte]
            table = np.bincount(owner * 256 + answer, minlength=n * 256).reshape(n, 256)
            own = range(8 * byte, min(width, 8 * byte + 8))
            for language in own:
                counts[:, language] = table[:, np.arange(256) >> (language - 8 * byte) & 1 == 1].sum(axis=1)
        total = np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
        scores = np.clip((counts / total - self.wrong) / (1 - np.minimum(self.wrong, 0.999)), 0, 1)
        best = scores.argmax(axis=1)
        known = n_letters > 0
        return (
            [self.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)],
            np.where(known, scores[np.arange(n), best], 0.0),
        )


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Filter:
    """The filter of all labelled rows; null languages are passed over."""
    counts = written(gram_counts(labelled, text, lang), "gram-counts")
    languages = sorted(r.lang for r in labelled.select(F.col(lang).cast("string").alias("lang")).distinct().collect() if r.lang is not None)
    width = -(-len(languages) // 8)
    places = {name: i for i, name in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = slots(batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64))
            mine = np.array([places[name] for name in batch.column("lang").to_pylist()], np.int64)
            for each in where:
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(mine)], names=["slot", "language"])

    set_bits = contained(counts).mapInArrow(work, "slot long, language long")
    bits = np.zeros((SLOTS, width), np.uint8)
    # One number per slot and byte of languages: at most SLOTS of each come to the driver.
    set_bits = set_bits.withColumn("byte", F.floor(F.col("language") / 8))
    value = F.bit_or(F.expr("cast(shiftleft(1, cast(language % 8 as int)) as int)"))
    sliced = written(set_bits.groupBy("byte", "slot").agg(value.alias("bits")), "filter-bits")
    for byte in range(width):
        part = sliced.where(F.col("byte") == byte).select("slot", "bits").toArrow()
        bits[part.column("slot").to_numpy(), byte] = part.column("bits").to_numpy().astype(np.uint8)
    return Filter(languages, bits)


def predict(df: DataFrame, model: Filter, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns (default: all), ``lang_pred`` and ``score``. Only the text decides."""
    made = ["lang_pred", "score"]
    kept = others(df.select(*keep) if keep is not None else df, made)
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(*sent.value)
        for batch, texts in portions(batches, text):
            names, scores = own.predict(texts)
            yield with_columns(batch, kept, dict(zip(made, (pa.array(names), pa.array(scores)), strict=True)))

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(work, schema(df, kept, "lang_pred string, score double"))


def identified(documents: DataFrame) -> DataFrame:
    """Predictions for every document by a filter learned from those not held out."""
    model = learn(documents.where(~held_out()))
    rows = documents.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return predict(rows, model, keep=["doc_id", "held_out"])
