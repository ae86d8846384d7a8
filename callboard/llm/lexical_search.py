"""Ranked search for words: the documents that score highest for each item, by hybrid TAAT-DAAT.

*Index.* Documents are taken as they come and gathered to shards of about SHARD words. A shard is one
row: its documents (those with a term, in order of id) with their lengths, and for every term the
documents that hold it and how often. It is written once, for all terms, and serves any number of items.
A task holds one shard at a time, however many it writes or reads: each is a row group of its own, and
Arrow batches end at BATCH bytes.

*Statistics.* Numbers of documents and of words, and for the items' terms the documents that hold them,
are sums over the shards.

*Search.* Every shard is searched by itself, for all items, with the statistics of the whole corpus. An
item's lists in the shard are ordered by length:

1. Term at a time: the shortest lists, SHORT postings together, are added up to one accumulator per
   document. From here on they are one iterator with a greatest score in each window of documents.
2. Document at a time, a window of WINDOW documents after the other: where the greatest score of the
   accumulators and of the long lists in a window do not reach the item's least score so far, the window
   is skipped. In others, long lists are merged, greatest bound first, while those left could carry a
   document by themselves; after that the lists left are only looked into for documents that can still
   reach the least score, and these become fewer with each list.

A task carries the least scores on from shard to shard and hands on its best documents of each item,
K at most. Those are cut to K by item and part first, then by item, so no task sees more than K rows of
each part for an item.

Items are dealt with in blocks of about BLOCK pairs of item and term, each sent to the executors
whole, so a long list of items takes several passes over the index and never over the texts.

Terms are compared by 64-bit hashes with random byte values. Scores are whole numbers, exact and
independent of how documents are dealt to shards.

Defined results: a null or wordless text is no document, a null or wordless item finds nothing. Rows
of documents that share an id are documents of their own; a null id comes last among equal scores. Rows
of items that share an id (or have none) are one item with all their terms. Of a very long document or
item only one has to fit a task. Ids of documents must be whole numbers. No column of the input is
handed on but the ids, so names cannot clash. Empty tables on either side give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import PORTION_BYTES, Hasher, byte_batches, hashed_words, portions, written

K = 10
# Words of a shard; postings of the lists that are added up first, documents of a window.
SHARD = 1 << 20
# Documents of a shard, where so many have fewer words.
DOCS = 1 << 14
SHORT = 1 << 10
WINDOW = 1 << 9
# Pairs of item and term that are sent to the executors at a time.
BLOCK = 1 << 18
# Parts that an item's best documents are cut to K in before they meet.
PARTS = 64
# Bytes at which an Arrow batch is handed to a Python worker.
BATCH = PORTION_BYTES
# A shard is some ten megabytes; row groups of many would be held whole by a task that writes or reads them.
ALONE = {"parquet.block.row.count.limit": "1"}

INDEX = (
    "n_words long, ids array<long>, lengths array<int>, terms array<long>, offsets array<int>, "
    "docs array<int>, times array<int>"
)
_HASHER = Hasher(13)
# Terms are runs of digits, of a-z (A-Z become those) and of whatever is not ASCII.
_KEEP = {*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
TERMS = bytes(b if b in _KEEP else ord(" ") for b in bytes(range(256)).lower())


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term in order, terms of each text)."""
    return hashed_words(texts, _HASHER, TERMS)


def _shard(ids: pa.Array, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """The index of some documents as one row."""
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    order = order[counts[order] > 0]
    place = np.zeros(len(counts), np.int64)
    place[order] = np.arange(len(order))
    terms, term = np.unique(hashes, return_inverse=True)
    keys, times = np.unique(term * len(order) + np.repeat(place, counts), return_counts=True)
    offsets = np.searchsorted(keys, np.arange(len(terms) + 1) * len(order))
    columns = {
        "ids": ids.take(pa.array(order)),
        "lengths": pa.array(counts[order], pa.int32()),
        "terms": pa.array(terms.view(np.int64)),
        "offsets": pa.array(offsets, pa.int32()),
        "docs": pa.array(keys % max(1, len(order)), pa.int32()),
        "times": pa.array(times, pa.int32()),
    }
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array([len(hashes)], pa.int64()), *lists], names=["n_words", *columns])


def index(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index of all documents, a row per shard, not yet written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts, n, n_docs = [], [], [], 0, 0
        for batch, texts in portions(batches, "text"):
            found, each = term_hashes(texts)
            own = np.flatnonzero(each)
            ids.append(batch.column("key").take(pa.array(own)))  # a slice would keep the batch with its texts
            hashes.append(found)
            counts.append(each[own])
            n += len(found)
            n_docs += len(own)
            if n >= SHARD or n_docs >= DOCS:
                yield _shard(pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(counts))
                ids, hashes, counts, n, n_docs = [], [], [], 0, 0
        if n:
            yield _shard(pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(counts))

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(work, INDEX)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times): the terms of all items."""
    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text"))
    kind = T.StructType([rows.schema["item"], *T.StructType.fromDDL("term long, times long").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            found, counts = term_hashes(texts)
            owners = pa.array(np.repeat(np.arange(len(texts)), counts))
            columns = [batch.column("item").take(owners), pa.array(found.view(np.int64)), pa.array(np.ones(len(found), np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "term", "times"])

    return rows.mapInArrow(work, kind).groupBy("item", "term").agg(F.sum("times").alias("times"))


@dataclass
class Block:
    """Some items with the statistics of their terms; what an executor needs to search a shard."""

    items: list[tuple[object, np.ndarray, np.ndarray]]  # id, places of its terms in `terms`, times
    terms: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_words: int


def weight(n_docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def _row_of(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _present(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``wanted`` are among the sorted ``terms``, their places there)."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    here = np.flatnonzero(terms[at] == wanted)
    return here, at[here]




class Shard:
    """The lists of a block's terms in one shard, with the score that each posting adds."""

    def __init__(self, block: Block, lengths: np.ndarray, terms: np.ndarray, offsets: np.ndarray, docs: np.ndarray, times: np.ndarray):
        self.n = len(lengths)
        here, at = _present(terms, block.terms)
        useful = block.weights[here] > 0
        here, at = here[useful], at[useful]
        self.list_of = np.full(len(block.terms), -1)
        self.list_of[here] = np.arange(len(here))
        self.sizes = (offsets[at + 1] - offsets[at]).astype(np.int64)
        ends = np.cumsum(self.sizes)
        own = np.repeat(offsets[at] - (ends - self.sizes), self.sizes) + np.arange(int(self.sizes.sum()))
        self.docs = docs[own].astype(np.int64)
        held = times[own].astype(np.int64)
        length = 25 + 75 * lengths.astype(np.int64) * block.n_docs // block.n_words
        self.adds = np.repeat(block.weights[here], self.sizes) * (1_000_000_000 * held // (1000 * held + 8 * length[self.docs]))
        # Where each list enters each window, and the most that it adds there.
        self.windows = -(-self.n // WINDOW)
        place = np.repeat(np.arange(len(here)), self.sizes) * self.windows + self.docs // WINDOW
        bounds = np.searchsorted(place, np.arange(len(here) * self.windows + 1))
        most = np.zeros(len(here) * self.windows, np.int64)
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            most[filled] = np.maximum.reduceat(self.adds, bounds[filled])
        self.begins = bounds[:-1].reshape(len(here), self.windows)
        self.stops = bounds[1:].reshape(len(here), self.windows)
        self.most = most.reshape(len(here), self.windows)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Offer to ``best`` every document of the shard that may be among an item's best."""
        lists = self.list_of[terms]
        times = times[lists >= 0]
        lists = lists[lists >= 0]
        order = np.argsort(self.sizes[lists], kind="stable")
        lists, times = lists[order], times[order]
        n_short = int(np.searchsorted(np.cumsum(self.sizes[lists]), SHORT, "right"))
        sums = np.zeros(self.windows * WINDOW, np.int64)
        for i in range(n_short):
            begin, stop = self.begins[lists[i], 0], self.stops[lists[i], -1]
            sums[self.docs[begin:stop]] += times[i] * self.adds[begin:stop]
        lists, times = lists[n_short:], times[n_short:]
        bounds = self.most[lists] * times[:, None]
        reach = sums.reshape(self.windows, WINDOW).max(axis=1) + bounds.sum(axis=0)
        for window in np.flatnonzero(reach >= best.least).tolist():
            if reach[window] >= best.least:
                self._window(window, lists, times, bounds[:, window], sums, best)

    def _window(self, window: int, lists: np.ndarray, times: np.ndarray, bounds: np.ndarray, sums: np.ndarray, best: Best) -> None:
        first = window * WINDOW
        scores = sums[first : first + WINDOW]
        left = int(bounds.sum())
        candidates = None
        for i in np.argsort(-bounds, kind="stable").tolist():
            if not bounds[i]:
                break
            begin, stop = self.begins[lists[i], window], self.stops[lists[i], window]
            docs, adds = self.docs[begin:stop], self.adds[begin:stop]
            if candidates is None and left < best.least:
                # A document that is in none of the lists so far cannot get there any more.
                candidates = np.flatnonzero(scores + left >= best.least)
            if candidates is None:
                scores[docs - first] += times[i] * adds
            else:
                candidates = candidates[scores[candidates] + left >= best.least]
                if not len(candidates):
                    return
                at = np.minimum(np.searchsorted(docs, candidates + first), len(docs) - 1)
                held = docs[at] == candidates + first
                scores[candidates[held]] += times[i] * adds[at[held]]
            left -= int(bounds[i])
        found = np.flatnonzero(scores >= best.least) if candidates is None else candidates[scores[candidates] >= best.least]
        if len(found):
            best.offer(found + first, scores[found])


class Best:
    """The K best documents of an item so far: greatest score, then least id, null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.names: tuple[np.ndarray, np.ndarray] | None = None

    def enter(self, ids: np.ndarray, missing: np.ndarray) -> Best:
        """Documents are offered by their place in these."""
        self.names = ids, missing
        return self

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        ids, missing = self.names
        first = np.argsort(-scores, kind="stable")[: self.k]  # a shard is in order of ids
        self.scores = np.append(self.scores, scores[first])
        self.ids = np.append(self.ids, ids[docs[first]])
        self.missing = np.append(self.missing, missing[docs[first]])
        order = np.lexsort((self.ids, self.missing, -self.scores))[: self.k]
        self.scores, self.ids, self.missing = self.scores[order], self.ids[order], self.missing[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def holders(shards: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many documents hold each of some terms; as many numbers as terms come to the driver."""
    sent = shards.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        n = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                here, at = _present(_row_of(batch, "terms", i).view(np.uint64), wanted)
                n[here] += np.diff(_row_of(batch, "offsets", i))[at]
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], names=["term", "n"])

    rows = shards.select("terms", "offsets").mapInArrow(work, "term long, n long")
    return dict(rows.groupBy("term").agg(F.sum("n")).collect())


def _blocks(pairs: DataFrame) -> Iterator[list[tuple[object, np.ndarray, np.ndarray]]]:
    """Items with their terms and times, in blocks of about BLOCK pairs."""
    n = max(1, -(-pairs.count() // BLOCK))
    place = F.pmod(F.xxhash64("item"), F.lit(n))
    for i in range(n):
        rows: dict[object, list[tuple[int, int]]] = {}
        for row in pairs.where(place == i).collect():
            rows.setdefault(row.item, []).append((row.term, row.times))
        items = []
        for item, own in rows.items():
            terms, times = np.array(own, np.int64).T
            items.append((item, np.ascontiguousarray(terms).view(np.uint64), times))
        yield items


def _searched(shards: DataFrame, block: Block, kind: T.StructType, k: int) -> DataFrame:
    """(item, doc_id, score): the best documents of every item in the shards of each task."""
    sent = shards.sparkSession.sparkContext.broadcast(block)
    item_type = to_arrow_type(kind["item"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        best = [Best(k) for _ in own.items]
        for batch in batches:
            for i in range(batch.num_rows):
                named = batch.column("ids")[i].values
                ids, missing = named.fill_null(0).to_numpy(zero_copy_only=False), named.is_null().to_numpy(zero_copy_only=False)
                parts = [_row_of(batch, name, i) for name in ("lengths", "terms", "offsets", "docs", "times")]
                parts[1] = parts[1].view(np.uint64)
                shard = Shard(own, *parts)
                for (_, terms, times), found in zip(own.items, best, strict=True):
                    shard.search(terms, times, found.enter(ids, missing))
        for (item, _, _), found in zip(own.items, best, strict=True):
            n = len(found.scores)
            if n:
                columns = [pa.array([item] * n, item_type), pa.array(found.ids, mask=found.missing), pa.array(found.scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return shards.drop("n_words").mapInArrow(work, kind)


def ranked(documents: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id (named as ``item``), rank, doc_id and score of the ``k`` best documents of every item."""
    with byte_batches(documents.sparkSession, BATCH):
        return _ranked(documents, items, k, key, text, item, item_text)


def _ranked(documents: DataFrame, items: DataFrame, k: int, key: str, text: str, item: str, item_text: str) -> DataFrame:
    shards = written(index(documents, key, text), "index", **ALONE)
    n_docs, n_words = shards.agg(F.sum(F.size("lengths")), F.sum("n_words")).first()
    pairs = written(item_terms(items, item, item_text), "item-terms")
    kind = T.StructType([pairs.schema["item"], *T.StructType.fromDDL("doc_id long, score long").fields])
    found = []
    for own in _blocks(pairs):
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(each for _, each, _ in own)]))
        held = holders(shards, terms)
        weights = np.array([weight(n_docs or 0, held.get(i, 0)) for i in range(len(terms))], np.int64)
        placed = [(name, np.searchsorted(terms, each), times) for name, each, times in own]
        block = Block(placed, terms, weights, n_docs or 0, n_words or 1)
        found.append(written(_searched(shards, block, kind, k), "ranked"))
    rows = reduce(DataFrame.unionByName, found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    near = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    near = near.where(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return last.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
