import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from callboard.llm import run_detection
from callboard.llm.queries import planted

from frames import empty_documents, multiset, odd_documents, texts_of


def brute(words, shortest=12):
    """Every stretch of equality at every distance; of equal bounds the smallest distance."""
    best = {}
    for p in range(1, len(words)):
        i = 0
        while i + p < len(words):
            first = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - first >= max(shortest, 2 * p):
                best.setdefault((first, i + p), p)
            i += 1
    return sorted((s, e, p) for (s, e), p in best.items())


def left(words, runs):
    gone = {i for s, e, p in runs for i in range(s + p, e)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts_of_kind(rng, kind, n):
    letters = rng.choice(["ab", "abcdefghijkl"])
    if kind == "random":
        return [rng.choice(letters) for _ in range(n)]
    if kind == "one period":
        return ([rng.choice(letters) for _ in range(rng.randint(1, 90))] * 400)[:n]
    if kind == "fibonacci":
        return fibonacci(n) if n else []
    if kind == "powers":
        words = []
        while len(words) < n:
            words += ([rng.choice(letters) for _ in range(rng.randint(1, 6))] * 100)[: rng.randint(1, 90)]
        return words
    if kind == "periods of periods":
        inner = []
        for _ in range(rng.randint(1, 4)):
            inner += ([rng.choice("ab") for _ in range(rng.randint(1, 4))] * 100)[: rng.randint(1, 60)]
        return (inner * 20)[:n]
    words = [rng.choice(letters) for _ in range(n)]  # a periodic tail
    a = rng.randrange(n + 1)
    p = 1 + (n - a) // rng.randint(3, 10)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


KINDS = ["random", "one period", "fibonacci", "powers", "periods of periods", "periodic tail"]


@pytest.mark.parametrize("kind", KINDS)
def test_all_runs_against_brute_force(kind):
    rng = random.Random(KINDS.index(kind))
    for _ in range(60):
        texts = [texts_of_kind(rng, kind, rng.randint(0, 400)) for _ in range(rng.randint(1, 5))]
        found = run_detection.runs_of_texts([" ".join(words).encode() for words in texts])
        for words, runs in zip(texts, found, strict=True):
            assert sorted(map(tuple, runs.tolist())) == brute(words)
            assert run_detection.collapsed(" ".join(words).encode(), runs).decode() == left(words, brute(words))


def test_two_halves_that_are_highly_periodic():
    # Neither half has a position of a synchronising set where its own period is left out.
    for half in (60, 61, 200, 331):
        words = (["a", "b"] * half)[:half] * 2
        got = [tuple(r) for r in run_detection.runs_of_texts([" ".join(words).encode()])[0].tolist()]
        assert sorted(got) == brute(words)


def test_a_long_period_in_a_text_longer_than_a_portion():
    unit = [f"w{i * 7919 % 100_003}" for i in range(90_000)]
    text = " ".join(["head"] + unit * 3 + unit[:5]).encode()
    assert len(text) > 1 << 20
    assert run_detection.runs_of_texts([b"x", text, b"y"])[1].tolist() == [[1, 1 + 270_005, 90_000]]


def test_synchronising_sets_are_consistent_and_dense():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 3, 4_000).astype(np.uint64)
    symbols[1_000:1_500] = symbols[3_000:3_500]
    for size in (4, 8, 16):
        slices = run_detection.Slices(symbols * np.uint64(0x9E3779B97F4A7C15))
        hashes = slices.windows(size, len(symbols))
        places = run_detection.synchronising_set(hashes, np.zeros(len(hashes), bool), size)
        inside = set(places.tolist())
        for i in range(500 - 2 * size + 1):
            assert (1_000 + i in inside) == (3_000 + i in inside)
        # Nothing was left out, so any `size` places in a row have one (ends excepted).
        assert max(np.diff(places)) <= size


def test_frame_against_brute_force(spark):
    more = [
        (30, "la " * 40, "en", "a", 1),
        (31, "x y z\n" * 5 + "end", "en", "a", 1),
        (31, "x y z\n" * 5 + "end", "en", "a", 1),
        (32, "one two three four five six seven eight nine ten eleven twelve thirteen " * 3, "en", "a", 1),
        (33, "é日 ü\t" * 9, None, "a", 1),
        (34, "a b " * 5, None, "a", 1),
        (35, "a b " * 6, None, "a", 1),
    ]
    df = odd_documents(spark, more).where("doc_id IS NULL OR doc_id <> 5")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in run_detection.periodic_runs(df).collect()]
    want = []
    for doc_id, text in texts_of(df):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.decode())
        runs = brute(words)
        want.append((doc_id, len(words), [(s, e - s, p) for s, e, p in sorted(runs, key=lambda r: (r[0], r[2]))], left(words, runs)))
    assert multiset(got) == multiset(want)


def test_very_long_text(spark):
    row = run_detection.digests(odd_documents(spark).where("doc_id = 5")).first()
    # word{i % 700} and{i % 31}: 21,700 pairs are a period.
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 120_000, 43_400, 2764)


def test_longest_and_its_ties(spark):
    df = spark.createDataFrame([(1, "a " * 13 + "x " + "b " * 13 + "y " + "c d " * 6), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in run_detection.digests(df).collect()}
    assert (rows[1].n_runs, rows[1].start, rows[1].length, rows[1].period, rows[1].exponent_milli) == (3, 0, 13, 1, 13_000)
    assert (rows[2].n_runs, rows[2].start, rows[2].length, rows[2].period, rows[2].exponent_milli) == (0, None, None, None, None)
    assert rows[2].runs_sha256 == rows[2].collapsed_sha256 == spark.sql("SELECT sha2('', 256)").first()[0]


def test_planting(spark):
    words = [f"w{i}" for i in range(50)]
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("  ".join(words)).alias("text"))
    import zlib

    changed = 0
    for row in planted(df).collect():
        h = zlib.crc32(str(row.doc_id).encode())
        g = h // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        own = [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
        changed += h % 10 == 0
        assert row.text.split() == (own if h % 10 == 0 else words)
    assert changed > 5
    assert multiset(planted(odd_documents(spark).where("doc_id < 5")).select("doc_id").collect()) == multiset(
        odd_documents(spark).where("doc_id < 5").select("doc_id").collect()
    )


def test_empty_table_and_clashing_columns(spark):
    assert run_detection.digests(planted(empty_documents(spark))).collect() == []
    df = odd_documents(spark).selectExpr("*", "'x' AS Runs", "7 AS n_words", "'k' AS start", "1 AS longest")
    row = run_detection.periodic_runs(df).where("doc_id = 1").first()
    assert (row.n_words, row.runs, row.start, row.longest) == (12, [], "k", 1)
    assert run_detection.digests(df).count() == df.count()
