import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from callboard.llm import common
from callboard.llm import lexical_search as search

from frames import empty_documents, odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(documents, items, k=10):
    """All scores of all pairs. ``documents`` and ``items`` are lists of (id, text)."""
    docs = [(doc_id, Counter(terms(text))) for doc_id, text in documents]
    docs = [(doc_id, tf, sum(tf.values())) for doc_id, tf in docs if tf]
    n, words = len(docs), sum(size for _, _, size in docs)
    df = Counter(term for _, tf, _ in docs for term in tf)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, times in asked.items():
        scored = []
        for doc_id, tf, size in docs:
            m = 100 - 75 + 75 * size * n // words
            score = 0
            for term, count in times.items():
                if term in tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += count * w * (1_000_000_000 * tf[term] // (1000 * tf[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort(key=lambda x: x[:3])
        out += [(item, i + 1, doc_id, -score) for i, (score, _, _, doc_id) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def texts(df, key):
    return [(r[key], r.text) for r in df.collect()]


ITEMS = [
    ("a", "One two, THREE three words9 é日本"),
    ("b", "word1 word1 word2 and3 don't 12.5%"),
    ("b", "more of b: seven"),
    (None, "text without an id"),
    ("c", ""),
    ("d", None),
    ("e", "nothingofthis anywhereatall"),
    ("f", " ".join(f"word{i % 700}" for i in range(900)) + " zwölf"),
]


def test_frames_against_brute_force(spark):
    docs = odd_documents(spark, [(None, "A text without an id", "en", "c", 5), (9, "seven text", "en", "a", 1)])
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert rows_of(search.ranked(docs, items)) == brute(texts(docs, "doc_id"), ITEMS)


def corpus(rng, n, vocabulary):
    """Texts with a few very common words, many rare ones, equal texts and equal scores."""
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    made = [" ".join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(n)]
    made += [made[0]] * (n // 3)
    ids = list(range(len(made)))
    rng.shuffle(ids)
    return list(zip(ids, made, strict=True))


@pytest.mark.parametrize("short, window, k", [(0, 4, 10), (16, 8, 3), (40, 64, 10), (1 << 20, 16, 1), (64, 512, 10)])
def test_pruned_search_against_brute_force(monkeypatch, short, window, k):
    """Lists all long, all short and mixed, over several shards with the least scores carried on."""
    monkeypatch.setattr(search, "SHORT", short)
    monkeypatch.setattr(search, "WINDOW", window)
    rng = random.Random(short + window)
    for _ in range(6):
        documents = corpus(rng, 240, 300)
        items = [(f"i{i}", " ".join(rng.choices([f"w{j}" for j in range(300)], k=rng.randint(1, 25)))) for i in range(12)]
        items += [("common", "w0 w1 w2 w0"), ("copy", documents[0][1])]
        hashed = [search.term_hashes([text.encode()]) for _, text in items]
        shards = []
        for first in range(0, len(documents), 90):
            part = documents[first : first + 90]
            found, counts = search.term_hashes([text.encode() for _, text in part])
            shards.append(search._shard(pa.array([doc_id for doc_id, _ in part], pa.int64()), found, counts))
        all_terms = np.unique(np.concatenate([found for found, _ in hashed]))
        n_docs = sum(len(shard.column("ids")[0]) for shard in shards)
        held = Counter()
        for shard in shards:
            here, at = search._present(search._row_of(shard, "terms", 0).view(np.uint64), all_terms)
            held.update(dict(zip(here.tolist(), np.diff(search._row_of(shard, "offsets", 0))[at].tolist(), strict=True)))
        own = []
        for (name, _), (found, _) in zip(items, hashed, strict=True):
            each, times = np.unique(found, return_counts=True)
            own.append((name, np.searchsorted(all_terms, each), times))
        weights = np.array([search.weight(n_docs, held[i]) for i in range(len(all_terms))], np.int64)
        block = search.Block(own, all_terms, weights, n_docs, sum(shard.column("n_words")[0].as_py() for shard in shards))
        best = [search.Best(k) for _ in items]
        for row in shards:
            parts = [search._row_of(row, name, 0) for name in ("lengths", "terms", "offsets", "docs", "times")]
            parts[1] = parts[1].view(np.uint64)
            shard = search.Shard(block, *parts)
            ids = search._row_of(row, "ids", 0)
            for (_, at, times), found in zip(own, best, strict=True):
                shard.search(at, times, found.enter(ids, np.zeros(len(ids), bool)))
        got = [
            (name, i + 1, doc_id, score)
            for (name, _), found in zip(items, best, strict=True)
            for i, (doc_id, score) in enumerate(zip(found.ids.tolist(), found.scores.tolist(), strict=True))
        ]
        assert sorted(got, key=repr) == brute(documents, items, k)


def test_windows_are_skipped(monkeypatch):
    """Once the least score is high, windows without a promising document are not entered."""
    monkeypatch.setattr(search, "WINDOW", 16)
    documents = [(i, "rare common common" if i < 12 else "common other words here") for i in range(400)]
    found, counts = search.term_hashes([text.encode() for _, text in documents])
    row = search._shard(pa.array([i for i, _ in documents], pa.int64()), found, counts)
    wanted = np.unique(search.term_hashes([b"rare common"])[0])
    block = search.Block([("i", np.arange(2), np.ones(2, np.int64))], wanted, np.array([700, 700]), 400, len(found))
    parts = [search._row_of(row, name, 0) for name in ("lengths", "terms", "offsets", "docs", "times")]
    parts[1] = parts[1].view(np.uint64)
    shard = search.Shard(block, *parts)
    entered = []
    whole = shard._window
    monkeypatch.setattr(shard, "_window", lambda window, *more: entered.append(window) or whole(window, *more))
    ids = search._row_of(row, "ids", 0)
    best = search.Best(10).enter(ids, np.zeros(len(ids), bool))
    shard.search(np.arange(2), np.ones(2, np.int64), best)
    assert best.ids.tolist() == list(range(10)) and entered == [0]


def test_several_blocks_of_items_and_shards(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 20)
    monkeypatch.setattr(search, "SHARD", 500)
    rng = random.Random(4)
    documents = corpus(rng, 150, 120)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(120)], k=12))) for i in range(15)]
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string")
    assert rows_of(search.ranked(docs, asked)) == brute(documents, items)


def test_a_task_holds_one_shard_at_a_time(spark, monkeypatch):
    """Of the many shards of a task each is a row group and an Arrow batch of its own."""
    monkeypatch.setattr(search, "SHARD", 500)
    monkeypatch.setattr(search, "BATCH", 1, raising=False)
    row_of, written, kept = search._row_of, search.written, {}

    def alone(batch, name, i):
        assert batch.num_rows == 1
        return row_of(batch, name, i)

    def noted(df, name, **options):
        kept[name] = written(df, name, **options)
        return kept[name]

    monkeypatch.setattr(search, "_row_of", alone)
    monkeypatch.setattr(search, "written", noted)
    rng = random.Random(5)
    documents = [*corpus(rng, 150, 120), (1000, None), (1001, "., -"), (None, "w1 w2")]
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(120)], k=12))) for i in range(15)]
    docs = spark.createDataFrame(documents, "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame(items, "item_id int, text string")
    with common.small_batches(spark, 10):
        assert rows_of(search.ranked(docs, asked)) == brute(documents, items)
    files = [pq.ParquetFile(file.removeprefix("file://")).metadata for file in kept["index"].inputFiles()]
    assert sum(file.num_rows for file in files) > 5
    assert [file.num_row_groups for file in files] == [file.num_rows for file in files]


def test_shards_of_short_documents_end_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(search, "DOCS", 50, raising=False)
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    spark.conf.set(common.BATCH, "20")
    try:
        found = search.index(docs.unionByName(docs.select("doc_id", F.lit("-").alias("text"))).coalesce(1)).select("ids").collect()
    finally:
        spark.conf.unset(common.BATCH)
    assert [len(row.ids) for row in found] == [60] * 6 + [40]
    assert sorted(i for row in found for i in row.ids) == list(range(400))


def test_batches_end_by_bytes_and_the_setting_is_put_back(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    for before in (None, "5000000"):
        if before:
            spark.conf.set(common.BATCH_BYTES, before)
        with common.byte_batches(spark, 10_000):
            assert {row.n for row in rows.mapInArrow(sizes, "n long").collect()} == {10}
        assert spark.conf.get(common.BATCH_BYTES, None) == before
    spark.conf.unset(common.BATCH_BYTES)


def test_empty_tables_and_clashing_columns(spark):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert search.ranked(empty_documents(spark), items).collect() == []
    assert search.ranked(odd_documents(spark), nothing).collect() == []
    assert search.ranked(empty_documents(spark), nothing).collect() == []
    docs = odd_documents(spark).selectExpr("*", "'x' AS item", "1 AS score", "2 AS rank", "3 AS `key`", "4 AS part")
    assert rows_of(search.ranked(docs, items.selectExpr("*", "1 AS doc_id", "2 AS score", "3 AS item"))) == rows_of(
        search.ranked(odd_documents(spark), items)
    )
