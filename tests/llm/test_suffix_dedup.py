import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from callboard.llm import suffix_dedup
from callboard.llm.suffix_dedup import Sizes

from frames import SCHEMA, empty_documents, multiset, odd_documents, texts_of


def brute(documents, match):
    counts = Counter(raw[i : i + match] for _, raw in documents for i in range(len(raw) - match + 1))
    out = []
    for doc, raw in documents:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - match + 1):
            if counts[raw[i : i + match]] > 1:
                gone[i : i + match] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        n_spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(scale):
    """Passages copied whole, in part, shifted, inside one text, with small edits, and at text ends."""
    random.seed(scale)
    letters = "abcdeé "
    word = lambda n: "".join(random.choices(letters, k=n))
    passages = [word(random.randint(scale // 2, 4 * scale)) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(random.randint(0, 4)):
            passage = random.choice(passages)
            a, b = sorted(random.choices(range(len(passage) + 1), k=2))
            parts.append(random.choice([passage, passage[a:b], passage[:b], passage[a:], word(random.randint(0, 3 * scale))]))
            if random.random() < 0.3 and parts[-1]:
                i = random.randrange(len(parts[-1]))
                parts[-1] = parts[-1][:i] + "Z" + parts[-1][i + 1 :]
        texts.append("".join(parts))
    texts += ["a" * (3 * scale), "ab" * (2 * scale), "a" * (scale - 1), "b" * scale, "b" * scale, "c" * scale]
    texts += [texts[0], texts[1], texts[1]]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(100 + i, text, "en", "s", 1) for i, text in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("sizes", [Sizes(20, 5, 4), Sizes(40, 40, 8), Sizes(64, 8, 64), Sizes(17, 3, 1)])
def test_small_sizes_against_brute_force(spark, sizes):
    df = odd_documents(spark, [(100 + i, t, "en", "s", 1) for i, t in enumerate(corpus(sizes.match))]).where("doc_id <> 5 OR doc_id IS NULL")
    got = multiset(map(tuple, suffix_dedup.digests(df, sizes).collect()))
    assert got == multiset(brute(texts_of(df), sizes.match))


def test_default_sizes_against_brute_force(spark):
    df = frame(spark, corpus(400))
    assert multiset(map(tuple, suffix_dedup.digests(df).collect())) == multiset(brute(texts_of(df), 400))


def test_portions_and_stretches_do_not_matter(spark, monkeypatch):
    df = frame(spark, corpus(400))
    whole = multiset(suffix_dedup.digests(df).collect())
    monkeypatch.setattr(suffix_dedup, "STRETCH", 333)
    data = [t for _, t in texts_of(df)]
    raw, ends = b"".join(data), np.cumsum([len(t) for t in data])
    suffixes = set()
    for first, last, _, _ in suffix_dedup.find_blocks(np.frombuffer(raw, np.uint8), ends, suffix_dedup.DEFAULT):
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            own = set(range(a, b + 1))
            assert not own & suffixes
            suffixes |= own
    begins = ends - [len(t) for t in data]
    assert suffixes == {i for a, b in zip(begins.tolist(), ends.tolist(), strict=True) for i in range(a, b - 400 + 1)}
    assert multiset(suffix_dedup.digests(df).collect()) == whole


def test_odd_rows(spark):
    df = odd_documents(spark)
    got = multiset(map(tuple, suffix_dedup.digests(df).collect()))
    assert got == multiset(brute(texts_of(df), 400))


def test_columns_and_empty_table(spark):
    assert suffix_dedup.digests(empty_documents(spark)).collect() == []
    df = odd_documents(spark).selectExpr("*", "1 AS doc", "2 AS print", "3 AS todo", "4 AS Kept", "5 AS first")
    found = suffix_dedup.removed(df)
    assert set(found.columns) == (set(df.columns) - {"text", "Kept"}) | {"kept", "n_bytes", "removed"}
    rows = {(r.doc, r.first) for r in found.collect()}
    assert rows == {(1, 5)} and found.count() == df.count()
