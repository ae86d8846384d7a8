import random
import re
from itertools import combinations

import pytest
import xxhash

from callboard.llm import simhash
from callboard.llm.components import connected

from frames import empty_documents, odd_documents, texts_of


def brute_print(raw):
    text = re.sub(r"[A-Z]", lambda m: m[0].lower(), raw.decode())
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    root = {key: key for key, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(prints, 2):
        if (x ^ y).bit_count() <= distance:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {key: find(key) for key, _ in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    df = odd_documents(spark)
    got = sorted(repr((r.doc_id, r.fingerprint)) for r in simhash.near_duplicates(df).collect())
    assert got == sorted(repr((doc_id, f"{brute_print(text):016x}")) for doc_id, text in texts_of(df))


def test_empty_texts_are_linked(spark):
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd_documents(spark)).collect()}
    assert found[2] == found[3] == found[4] == 2
    assert found[None] is None


def planted(n, centre_share=0.6):
    """Fingerprints in chains and in one dense cluster of the kind that fills blocks."""
    random.seed(n)
    centre, values = random.getrandbits(64), []
    for _ in range(n):
        if random.random() < centre_share:
            values.append(centre ^ sum(1 << b for b in set(random.choices(range(64), k=random.randint(0, 4)))))
        elif values and random.random() < 0.5:
            values.append(random.choice(values) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
        else:
            values.append(random.getrandbits(64))
    return list(enumerate(values))


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("paired", [2, simhash.PAIRED])
def test_components_against_brute_force(spark, monkeypatch, paired, distance):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    prints = planted(500)
    df = spark.createDataFrame([(k, signed(x)) for k, x in prints], "doc_id long, simhash long")
    got = {r.doc_id: r.component_id for r in simhash.grouped(df, distance=distance).collect()}
    assert got == brute_components(prints, distance)


def test_every_close_pair_shares_a_block():
    masks = simhash.block_masks()
    for a, b in combinations(range(64), 2):
        changed = signed((1 << a) | (1 << b))
        assert any(m & changed == 0 for m in masks)


def test_one_of_each_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(200))
    more = [(50, text, "en", "a", 1), (40, text + " ", "en", "a", 1), (60, text, "en", "a", 1)]
    df = odd_documents(spark, more).selectExpr("*", "1 AS simhash", "2 AS component_id", "3 AS fingerprint")
    kept = simhash.one_of_each(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns
    assert 40 in ids and 50 not in ids and 60 not in ids and 1 in ids


def test_one_of_each_with_repeated_rows_and_null_ids(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(200)) for c in "xy")
    rows = [(8, text, "en"), (8, text, "en"), (8, text + " ", "en"), (9, text, "en"), (None, text, "en")]
    rows += [(None, other, "en"), (None, other, "en"), (None, "quite another text", None), (3, None, None), (3, None, None), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [(r.doc_id, (r.text or "").strip()) for r in simhash.one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([(8, text), (None, other), (None, "quite another text"), (3, "")], key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(empty_documents(spark)).collect() == []


def test_connected_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 2), (None, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}
