"""Toxicity of texts by their nearest labelled examples.

*Examples.* Of each label the SAMPLE different texts of least hash are the examples, or all there are.
Each counts for all labelled rows that have its text and for its label's rows that are in no example, so
that the examples hold each label in the share it has among all labelled rows.

*Vectors.* Terms are words (A-Z lower-cased, runs of digits, letters a-z and whatever is not ASCII) and
the first STEMS bytes of longer words, so that unseen forms of a word still have something in common with it.
A text is a vector over the terms that tell the labels apart: those that LEAST examples or more hold, and so
much more often under one label that the difference is SIGMAS times its standard error. A term weighs (1 + ln times) * (1 + ln((1 + documents) / (1 + documents with the term))), counted over all
documents, and a vector is scaled to length 1. Texts without any of those terms have no direction; they
get the rate of label 1 among the examples that have none.

*Search.* The examples' different vectors are put in order of their strongest terms and cut into
blocks of BLOCK. A term's inverted list knows its greatest weight in each block, so the products with a
text's weights bound what a block can hold. Blocks are scored exactly, greatest bound first, until no
bound reaches the K-th cosine found. The result is the K nearest, exact; of equal cosines the first in order.

*Score.* Every neighbour votes with its rows, weighted by the fourth power of its cosine, and the rate of all
rows votes with the weight of PRIOR rows. Votes are calibrated: every example is scored by the others,
and in each of BINS ranges of the vote the rate of label 1, again with the vote itself for PRIOR rows, takes
its place, made to rise with the vote and joined by straight lines. The nearest examples are the evidence.

Texts are read once to gather their terms; what is sent to the driver and the executors is the vectors
of 2 * SAMPLE examples at most. No join or group has text in its key, and copies are counted before they move.

Defined results: null, empty and wordless texts have no terms, as above. Without any label the score is
0, with one label only it is that label. Labels other than 0 and 1, and null ones, are passed over. Rows
with a null doc_id are scored, not held out, and never learned from (no label joins them); repeated rows are
scored one by one. Of a very long text only one has to fit a task. The result has the named columns alone,
so names cannot clash. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Hasher, mixed, portions, schema, with_columns, word_bounds, written
from .lexical_search import TERMS

SAMPLE = 10_000
STEMS = (4, 5, 6, 7, 8)
LEAST = 5
SIGMAS = 6.0
K = 15
BLOCK = 64
PRIOR = 0.3
BINS = 20
TOXIC = 0.7
HELD_OUT_PARTS, HELD_OUT_PART = 3, 1
# Vectors that a task remembers the score of.
REMEMBERED = 1 << 14

EVIDENCE = "array<struct<doc_id: long, similarity: double, rate: double>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("rate", pa.float64())]))
_HASHER = Hasher(12)


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term, index of its text)."""
    data, starts, stops, counts = word_bounds(texts, TERMS)
    sums = _HASHER.prepare(data)
    owner = np.repeat(np.arange(len(texts)), counts)
    hashes, owners = [_HASHER.slices(sums, starts, stops)], [owner]
    for size in STEMS:
        longer = np.flatnonzero(stops - starts > size)
        # A stem is no word of the same letters.
        hashes.append(mixed(_HASHER.slices(sums, starts[longer], starts[longer] + size) + np.uint64(size)))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def held_out(key: str = "doc_id") -> Column:
    part = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(HELD_OUT_PARTS)) == HELD_OUT_PART
    return F.coalesce(part, F.lit(False))


def labelled_texts(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(print, label, weight, doc_id): different texts of labelled documents, how many rows have each, and the least id."""
    prints = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"))
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = prints.join(known.where("label IN (0, 1)"), "doc_id")
    return rows.groupBy("print", "label").agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("doc_id"))


def examples(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(text, label, weight, doc_id): the examples; weights add up to each label's rows."""
    pairs = written(labelled_texts(documents, labels, key, text, label), "labelled-texts")
    order = ["order", "print"]
    pairs = pairs.withColumn("order", F.xxhash64("print", "label"))
    rows = dict(pairs.groupBy("label").agg(F.sum("weight")).collect())
    chosen = None
    for kind in (0, 1):
        own = written(pairs.where(F.col("label") == kind).orderBy(*order).limit(sample), "examples")
        total = own.agg(F.sum("weight")).first()[0] or 1
        own = own.withColumn("weight", F.col("weight") * (rows.get(kind, 0) / total))
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most 2 * sample rows of four numbers are sent.
    sent = F.broadcast(chosen.select("print", "label", "weight", "doc_id"))
    texts = documents.select(F.xxhash64(text).alias("print"), F.col(text).alias("text")).join(sent, "print")
    # Copies of a text become one inside tasks.
    return texts.groupBy("print", "label", "weight", "doc_id").agg(F.min("text").alias("text")).drop("print")


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, clean, toxic): how many examples of each label hold each term. Tasks count a portion before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, "text"):
            hashes, owners = terms_of(texts)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            terms, term = np.unique(hashes, return_inverse=True)
            held = np.unique(term * len(texts) + owners)
            term, label = held // max(1, len(texts)), labels[held % max(1, len(texts))]
            toxic = np.bincount(term, label, len(terms)).astype(np.int64)
            clean = np.bincount(term, minlength=len(terms)) - toxic
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(clean), pa.array(toxic)], names=["term", "clean", "toxic"])

    rows = rows.select("text", "label").mapInArrow(work, "term long, clean long, toxic long")
    return rows.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def telling_terms(rows: DataFrame) -> np.ndarray:
    """Hashes of the terms that tell the labels apart, in order. They are terms of the examples, so they are bounded too."""
    of_label = dict(rows.groupBy("label").count().collect())
    if len(of_label) < 2:
        return np.zeros(0, np.uint64)
    share = of_label[1] / (of_label[0] + of_label[1])
    n = F.col("clean") + F.col("toxic")
    far = F.abs(F.col("toxic") - n * share) >= SIGMAS * F.sqrt(n * share * (1 - share))
    found = term_counts(rows).where((n >= LEAST) & far).select("term").toArrow().column("term").to_numpy()
    return np.sort(found.view(np.uint64))


def term_lists(df: DataFrame, terms: np.ndarray, kept: list[str]) -> DataFrame:
    """Kept columns, ``terms`` (places in ``terms``, ascending) and ``times`` of every text."""
    sent = df.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch, texts in portions(batches, "text"):
            hashes, owners = terms_of(texts)
            at = np.searchsorted(wanted, hashes)
            own = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == hashes) if len(wanted) else at[:0]
            keys, times = np.unique(owners[own] * len(wanted) + at[own], return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) * len(wanted)), pa.int32())
            lists = (pa.array(keys % max(1, len(wanted)), pa.int32()), pa.array(times, pa.int32()))
            made = dict(zip(("terms", "times"), (pa.ListArray.from_arrays(offsets, x) for x in lists), strict=True))
            yield with_columns(batch, kept, made)

    return df.select(*dict.fromkeys([*kept, "text"])).mapInArrow(work, schema(df, kept, "terms array<int>, times array<int>"))


@dataclass
class Vectors:
    """Different unit vectors of examples in order, as inverted lists with the greatest weight in each block.

    ``begins[t] : begins[t + 1]`` are the entries of a term's list (``owners``, ``values``);
    ``first[t] : first[t + 1]`` those of its blocks (``blocks``, where each begins, greatest weight).
    """

    n: int
    begins: np.ndarray
    owners: np.ndarray
    values: np.ndarray
    first: np.ndarray
    blocks: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> Vectors:
        owners = np.repeat(np.arange(len(rows)), [len(terms) for terms, _ in rows])
        terms = np.concatenate([np.zeros(0, np.int64), *(terms for terms, _ in rows)]).astype(np.int64)
        values = np.concatenate([np.zeros(0), *(values for _, values in rows)])
        order = np.lexsort((owners, terms))
        terms, owners, values = terms[order], owners[order], values[order]
        begins = np.searchsorted(terms, np.arange(n_terms + 1))
        in_block = terms * (len(rows) // block + 1) + owners // block
        starts = np.flatnonzero(np.diff(in_block, prepend=-1))
        most = np.maximum.reduceat(values, starts) if len(starts) else values
        first = np.searchsorted(terms[starts], np.arange(n_terms + 1))
        return cls(len(rows), begins, owners, values, first, owners[starts] // block, starts, np.append(starts[1:], len(terms)), most)

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, cosines) of the ``k`` nearest that share a term, greatest cosine first, then first in order."""
        begin = self.first[terms]
        places, counts = spread(begin, self.first[terms + 1] - begin)
        forces = np.repeat(values, counts)
        bounds = np.bincount(self.blocks[places], forces * self.most[places], -(-self.n // block))
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        # The most promising blocks give a least cosine; after that all that can reach it are looked at together.
        first = -(-2 * k // block)
        while len(order):
            chosen, order = order[:first], order[first:]
            rank = np.full(len(bounds), -1)
            rank[chosen] = np.arange(len(chosen))
            own = np.flatnonzero(rank[self.blocks[places]] >= 0)
            entries, sizes = spread(self.starts[places[own]], self.stops[places[own]] - self.starts[places[own]])
            owners = self.owners[entries]
            at = rank[owners // block] * block + owners % block
            sums = np.bincount(at, np.repeat(forces[own], sizes) * self.values[entries], len(chosen) * block)
            near = np.flatnonzero(sums > 0)
            found, cosines = np.append(found, chosen[near // block] * block + near % block), np.append(cosines, sums[near])
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
            if len(found) == k:
                # Sums in another order may differ in their last digits.
                order = order[bounds[order] >= cosines[-1] - 1e-9]
            first = max(2 * first, 16)
        return found, cosines


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places from each start on, as many as its size; the sizes)."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


@dataclass
class Judge:
    """What is learned: terms with their rarity, the examples' vectors with rows of label 1 and of both, and calibration."""

    terms: np.ndarray
    rarity: np.ndarray
    vectors: Vectors
    toxic: np.ndarray
    rows: np.ndarray
    ids: np.ndarray
    rate: float
    without: float
    # Least weight of an example of label 0 and of label 1: a row that is left out.
    unit: tuple[float, float] = (1.0, 1.0)
    knots: np.ndarray | None = None
    k: int = K

    def weighed(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        values = (1 + np.log(times)) * self.rarity[terms]
        return values / math.sqrt(float(values @ values))

    def vote(self, near: np.ndarray, cosines: np.ndarray, less: tuple[int, int] | None = None) -> float:
        """Rate of label 1 among neighbours; ``less``: without one row (of this label) of this vector."""
        toxic, rows = self.toxic[near], self.rows[near]
        if less is not None:
            own = near == less[0]
            rows = rows - np.where(own, np.minimum(rows, self.unit[less[1]]), 0)
            toxic = toxic - np.where(own & (less[1] == 1), np.minimum(toxic, self.unit[1]), 0)
        force = cosines**4
        return float((force @ toxic + PRIOR * self.rate) / (force @ rows + PRIOR))

    def score(self, terms: np.ndarray, times: np.ndarray) -> tuple[float, list[dict]]:
        """Calibrated score and evidence of one text's terms."""
        if not len(terms):
            return self.without, []
        near, cosines = self.vectors.nearest(terms, self.weighed(terms, times), self.k)
        vote = self.vote(near, cosines)
        if self.knots is not None:
            vote = float(np.interp(vote, np.linspace(0, 1, len(self.knots)), self.knots))
        rates = self.toxic[near] / self.rows[near]
        evidence = [
            {"doc_id": d, "similarity": min(1.0, s), "rate": r}
            for d, s, r in zip(self.ids[near].tolist(), cosines.tolist(), rates.tolist(), strict=True)
        ]
        return min(1.0, max(0.0, vote)), evidence


def _merged(rows: list, rarity: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """(different vectors in order of their strongest terms, rows of label 1, rows, least id) of example rows."""
    groups: dict[tuple[bytes, bytes], list] = {}
    for row in rows:
        terms, times = np.array(row.terms, np.int64), np.array(row.times)
        values = (1 + np.log(times)) * rarity[terms]
        values /= math.sqrt(float(values @ values))
        own = groups.setdefault((terms.tobytes(), values.round(9).tobytes()), [terms, values, 0.0, 0.0, row.doc_id])
        own[2] += row.weight * row.label
        own[3] += row.weight
        own[4] = min(own[4], row.doc_id)

    def strongest(own: list) -> tuple:
        order = np.lexsort((own[0], -own[1]))
        return tuple(own[0][order].tolist()), own[4]

    ordered = sorted(groups.values(), key=strongest)
    columns = [np.array([own[i] for own in ordered], kind) for i, kind in ((2, float), (3, float), (4, np.int64))]
    return [(own[0], own[1]) for own in ordered], *columns


def calibration(spark, judge: Judge) -> np.ndarray:
    """Score at evenly spaced votes, from the votes that examples get from the others. Spark's tasks share the examples."""
    sent = spark.sparkContext.broadcast(judge)
    edges = BINS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        vectors = own.vectors
        term_of = np.repeat(np.arange(len(vectors.begins) - 1), np.diff(vectors.begins))
        order = np.argsort(vectors.owners, kind="stable")
        begins = np.searchsorted(vectors.owners[order], np.arange(vectors.n + 1))
        toxic, rows = np.zeros(edges), np.zeros(edges)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                mine = order[begins[i] : begins[i + 1]]
                near, cosines = vectors.nearest(term_of[mine], vectors.values[mine], own.k + 1)
                for label, held in ((1, own.toxic[i]), (0, own.rows[i] - own.toxic[i])):
                    if held <= 0:
                        continue
                    last = own.rows[i] <= own.unit[label] * (1 + 1e-9)
                    kept = near != i if last else np.ones(len(near), bool)
                    vote = own.vote(near[kept][: own.k], cosines[kept][: own.k], (i, label))
                    place = min(edges - 1, int(vote * edges))
                    rows[place] += held
                    toxic[place] += held * label
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(edges)), pa.array(toxic), pa.array(rows)], names=["bin", "toxic", "rows"])

    # As many parts as a bounded number of examples needs.
    numbers = spark.range(0, judge.vectors.n, 1, max(1, min(32, judge.vectors.n // 256)))
    counted = numbers.mapInArrow(work, "bin long, toxic double, rows double").groupBy("bin")
    found = {r.bin: (r.toxic, r.rows) for r in counted.agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows")).collect()}
    middles = (np.arange(edges) + 0.5) / edges
    toxic, rows = (np.array([found.get(b, (0.0, 0.0))[i] for b in range(edges)]) for i in (0, 1))
    rates = rising((toxic + PRIOR * middles) / (rows + PRIOR), rows + PRIOR)
    return np.interp(np.linspace(0, 1, 2 * edges + 1), middles, rates)


def rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest sequence that does not fall (neighbours that do are pooled)."""
    pools: list[list[float]] = []
    for value, weight in zip(values.tolist(), weights.tolist(), strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v, w, n = pools.pop()
            u, x, m = pools[-1]
            pools[-1] = [(u * x + v * w) / (x + w), x + w, n + m]
    return np.repeat([v for v, _, _ in pools], [n for _, _, n in pools])


def learn(features: DataFrame, chosen: DataFrame, terms: np.ndarray) -> Judge:
    """From the term lists of all documents (``features``) and the examples (``chosen``, written)."""
    spark = features.sparkSession
    n = features.count()
    holders = dict(features.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    rarity = np.array([1 + math.log((1 + n) / (1 + holders.get(i, 0))) for i in range(len(terms))])
    listed = term_lists(chosen, terms, ["label", "weight", "doc_id"])
    rows = listed.where(F.size("terms") > 0).collect()  # of at most 2 * SAMPLE examples
    sums = chosen.groupBy("label").agg(F.sum("weight"), F.count(F.lit(1))).collect()
    weight = {label: (total, count) for label, total, count in sums}
    total = sum(x for x, _ in weight.values())
    rate = weight.get(1, (0.0, 0))[0] / total if total else 0.0
    of_label = [sum(r.weight for r in rows if r.label == label) for label in (0, 1)]
    no_toxic = max(0.0, weight.get(1, (0.0, 0))[0] - of_label[1])
    no_rows = max(0.0, total - sum(of_label))
    without = (no_toxic + PRIOR * rate) / (no_rows + PRIOR)
    vectors, toxic, held, ids = _merged(rows, rarity)
    unit = tuple(min((r.weight for r in rows if r.label == label), default=1.0) for label in (0, 1))
    judge = Judge(terms, rarity, Vectors.of(vectors, len(terms)), toxic, held, ids, rate, without, unit=unit)
    judge.knots = calibration(spark, judge) if vectors else None
    return judge


def predict(features: DataFrame, judge: Judge, kept: list[str]) -> DataFrame:
    """Kept columns, ``score`` and ``evidence`` of texts given by their term lists."""
    sent = features.sparkSession.sparkContext.broadcast(judge)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value

        @functools.lru_cache(REMEMBERED)
        def answer(terms: bytes, times: bytes) -> tuple[float, list[dict]]:
            return own.score(np.frombuffer(terms, np.int32), np.frombuffer(times, np.int32))

        for batch in batches:
            lists = [batch.column(name) for name in ("terms", "times")]
            found = [answer(*(x[i].values.to_numpy().tobytes() for x in lists)) for i in range(batch.num_rows)]
            scores, evidence = (list(x) for x in zip(*found, strict=True)) if found else ([], [])
            yield with_columns(batch, kept, {"score": pa.array(scores, pa.float64()), "evidence": pa.array(evidence, _EVIDENCE)})

    made = schema(features, kept, f"score double, evidence {EVIDENCE}")
    return features.select(*kept, "terms", "times").mapInArrow(work, made)


def scored(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, ``held_out``, ``score``, ``predicted`` and ``evidence`` of every document; held-out labels are not learned."""
    chosen = written(examples(documents, labels.where(~held_out(key)), key, text, label, sample), "toxicity-examples")
    terms = telling_terms(chosen)
    rows = documents.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    features = written(term_lists(rows, terms, ["doc_id", "held_out"]), "toxicity-terms")
    judged = predict(features, learn(features, chosen, terms), ["doc_id", "held_out"])
    return judged.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")
